"""Relational operators of the object store."""
