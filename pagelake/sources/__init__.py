"""Readers and writers: raw tables, page snapshots, the page store, index files."""
