"""Queries over the tables of a case."""
