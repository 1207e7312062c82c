"""pagelake: crawl planning, page history, extraction and ranked search on Spark."""

__version__ = "0.1.0"
