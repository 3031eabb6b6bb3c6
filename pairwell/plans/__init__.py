"""Queries: each operator applied to the driver's tables, with the SQL that checks it."""
