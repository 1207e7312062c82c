"""Column expressions: URLs, timestamps, HTML text, term analysis, scoring."""
