"""Readers for input tables, the stage store, and inputs derived from test tables."""
