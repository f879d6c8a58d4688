"""Registered queries and the SQL each one is compared with."""
