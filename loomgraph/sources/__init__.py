"""Readers that give property graphs."""
