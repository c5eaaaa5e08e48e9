"""Readers, and the adapter from relational tables to products."""
