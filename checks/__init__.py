"""Inputs derived from the given tables, the registered queries, and the SQL each is compared with."""
