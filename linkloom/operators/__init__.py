"""Relational and numeric operators."""
