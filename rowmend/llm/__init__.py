"""Operators for building training text, each one usable on any table with a text column."""
