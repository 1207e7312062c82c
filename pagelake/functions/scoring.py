"""Relevance arithmetic: inverse document frequency and the coarse length norm."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DIGITS = 6


def idf(n_docs: int, doc_freq: int) -> float:
    return 1.0 + math.log(n_docs / (doc_freq + 1.0)) if n_docs else 0.0


def idf_column(n_docs: Column, doc_freq: Column) -> Column:
    return F.lit(1.0) + F.ln(n_docs / (doc_freq + F.lit(1.0)))


def length_norm(n_terms: Column) -> Column:
    """``1/sqrt(n)`` kept to two binary digits after the leading one.

    The tiny subtraction keeps powers of four on an exact power of two, whatever the
    rounding of the logarithm.
    """
    exact = F.lit(1.0) / F.sqrt(n_terms.cast("double"))
    half_bits = F.ceil(F.log2(n_terms.cast("double")) / 2.0 - 1e-12)
    scale = F.pow(F.lit(2.0), -half_bits)
    return F.floor(exact / scale * 4.0) / 4.0 * scale
