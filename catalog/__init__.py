"""Registered queries over the given tables, and SQL that computes the same."""
