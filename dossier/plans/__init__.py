"""Queries over the given tables, with SQL that must agree."""
