"""Registered queries, their SQL, and SQL names."""
