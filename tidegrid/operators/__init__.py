"""Operators from tables to tables: each declares a plan and leaves its execution to Spark."""
