"""Structured Streaming forms of scraping and recrawl suppression."""
