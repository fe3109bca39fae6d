"""Compositions of operators: the project dashboard and the named tools."""
