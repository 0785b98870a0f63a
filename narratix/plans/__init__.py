"""Queries by name and the SQL that each must agree with."""
