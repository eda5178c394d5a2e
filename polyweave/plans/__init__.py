"""Composed jobs, queries and the command line."""
