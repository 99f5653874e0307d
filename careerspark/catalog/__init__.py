"""Registered queries on the order tables, each next to the SQL that must give the same rows."""
