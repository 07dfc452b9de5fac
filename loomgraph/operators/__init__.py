"""Relational operators on graphs."""
