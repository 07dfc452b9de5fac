"""Query front end and plan helpers."""
