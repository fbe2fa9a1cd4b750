"""Registered queries and the SQL each must equal."""
