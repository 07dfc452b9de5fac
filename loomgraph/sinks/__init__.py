"""Exports and layouts."""
