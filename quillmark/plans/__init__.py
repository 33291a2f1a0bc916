"""Queries over the standard tables, each with the SQL it is held against."""
