"""Registered queries: their plans, and the SQL that each is held against."""
