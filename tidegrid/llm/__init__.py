"""Operators for preparing training data, each usable on its own; see the README for the list."""
