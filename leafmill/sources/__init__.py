"""Readers, writers and the tables derived from pages."""
