"""From raw pages to ranked hits: scrape, index, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions import html as html_text
from pagelake.operators.index import Index, IndexField
from pagelake.sources.index_files import CREATE, add_documents, read_index

PAGE_FIELDS = [
    IndexField("url", indexed=True, stored=True),
    IndexField("title", indexed=True, stored=True, tokenized=True),
    IndexField("n_chars", "int", indexed=True, stored=True),
    IndexField("fulltext", indexed=True, tokenized=True),
]


def scrape_pages(pages: DataFrame) -> DataFrame:
    """Title and visible text of every page."""
    texts = pages.select(
        "page_id",
        "url",
        html_text.title(F.col("html")).alias("title"),
        html_text.plaintext(F.col("html")).alias("fulltext"),
    )
    return texts.withColumn("n_chars", F.length("fulltext"))


def index_pages(spark: SparkSession, pages: DataFrame, path: str) -> Index:
    """Scrape the pages and index them under ``path``."""
    add_documents(scrape_pages(pages), "page_id", PAGE_FIELDS, path, CREATE)
    return read_index(spark, path)
