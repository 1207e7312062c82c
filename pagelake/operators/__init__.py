"""Relational operators over page, link, history and index tables."""
