"""Dimension tables and composed plans."""
