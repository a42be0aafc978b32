"""Relational operators over design matrices."""
