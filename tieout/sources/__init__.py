"""Canonical tables: what each one holds and how it is read."""
