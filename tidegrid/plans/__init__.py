"""Registered queries. Importing the package registers those of all its modules in ``registry``."""

from tidegrid.plans import registry, sessions, views  # noqa: F401
