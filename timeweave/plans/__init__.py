"""Registered queries: each module holds QUERIES and ORACLES over the given tables."""
