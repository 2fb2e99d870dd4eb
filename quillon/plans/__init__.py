"""Queries and rules: the logical side of a search, checked and put in canonical form on the driver."""
