"""Queries over the test tables, one for each operator, and the SQL they are checked against."""
