"""Readers of the tables to compare."""
