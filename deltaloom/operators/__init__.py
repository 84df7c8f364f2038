"""Relational operators over records, regions, checks and byte images."""
