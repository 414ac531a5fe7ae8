"""Queries over the driver's tables, with the SQL that gives the same rows."""
