"""Index build and search queries over all documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import analysis, scoring
from pagelake.operators import index as index_ops
from pagelake.operators import search
from pagelake.operators.index import IndexField
from pagelake.plans.corpus import index_pages
from pagelake.session import new_run_dir
from pagelake.sources import index_files
from registry import pages as page_queries
from registry import shared

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


# --- index build -------------------------------------------------------------------------

_TYPED_FIELDS = [
    IndexField("key", "long", source="o_orderkey", indexed=True, stored=True),
    IndexField("customer", "int", source="o_custkey", indexed=True, stored=True),
    IndexField("price", "double", source="o_totalprice", indexed=True, stored=True),
    IndexField("rough_price", "float", source="o_totalprice", stored=True),
    IndexField("placed", "date", source="placed_text", indexed=True, stored=True),
    IndexField("status", "unheard-of", source="o_orderstatus", indexed=True, stored=True),
]


@query("i1_typed_projection", """
SELECT o_orderkey AS doc_id, o_orderkey AS key, CAST(o_custkey AS BIGINT) AS customer,
       o_totalprice AS price,
       round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 2) AS rough_price,
       epoch_ms(o_orderdate) AS placed, o_orderstatus AS status
FROM orders""")
def i1_typed_projection(spark, sf):
    orders = shared.table(spark, sf, "orders").withColumn(
        "placed_text",
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )
    typed = index_ops.project(orders, "o_orderkey", tuple(_TYPED_FIELDS))
    return typed.withColumns({
        "customer": F.col("customer").cast("bigint"),
        "rough_price": F.round(F.col("rough_price").cast("double"), 2),
    })


@query("i2_stored_projection", "SELECT doc_id, lang, source, n_chars FROM documents")
def i2_stored_projection(spark, sf):
    """The text is indexed but not stored, so it does not come back."""
    return shared.document_index(spark, sf).stored()


@query("i3_text_analysis", f"""
WITH occurrences AS ({shared.terms_sql("documents", "doc_id", "text")})
SELECT term, count(*) AS uses, count(DISTINCT doc_id) AS n_docs FROM occurrences GROUP BY term""")
def i3_text_analysis(spark, sf):
    words = shared.documents(spark, sf).select(
        "doc_id", F.explode(analysis.terms(F.col("text"))).alias("term")
    )
    per_doc = words.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("uses"))
    return per_doc.groupBy("term").agg(
        F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("n_docs")
    )


@query("q1_postings", f"""
WITH {shared.POSTINGS_SQL}
SELECT term, doc_id, tf, n_terms, round(norm, 6) AS norm, first_position, last_position
FROM postings""")
def q1_postings(spark, sf):
    """The inverted index of all documents, built from their text."""
    text_only = tuple(field for field in shared.DOCUMENT_FIELDS if field.tokenized)
    projected = index_ops.project(shared.documents(spark, sf), "doc_id", text_only)
    return index_ops.build_postings(projected, text_only).select(
        "term", "doc_id", F.col("tf").cast("bigint"), F.col("n_terms").cast("bigint"),
        F.round(scoring.length_norm(F.col("n_terms")), 6).alias("norm"),
        F.element_at("positions", 1).cast("bigint").alias("first_position"),
        F.element_at("positions", -1).cast("bigint").alias("last_position"),
    )


_DICTIONARY_SQL = f"""
WITH {shared.POSTINGS_SQL}
SELECT 'text' AS field, term, df FROM dictionary
UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source"""


@query("s4_index_write", _DICTIONARY_SQL)
def s4_index_write(spark, sf):
    """Index all documents to disk and read the dictionary back."""
    path = new_run_dir(spark, "index")
    index_files.add_documents(
        shared.documents(spark, sf), "doc_id", shared.DOCUMENT_FIELDS, path,
        index_files.CREATE,
    )
    return index_files.read_index(spark, path).terms


@query("s5_write_modes", f"""
WITH both_texts AS (
  SELECT conv_id * 1000 + turn AS id, text FROM conversations
  UNION ALL SELECT 1000000000 + item_id, text FROM benchmark),
occurrences AS ({shared.terms_sql("both_texts", "id", "text")})
SELECT term, count(DISTINCT id) AS df, count(DISTINCT id) AS n_postings,
       (SELECT count(*) FROM both_texts) AS n_docs, (SELECT count(*) FROM both_texts) AS doc_rows
FROM occurrences GROUP BY term""")
def s5_write_modes(spark, sf):
    """Conversations create an index, a second create replaces it, benchmark is appended."""
    path = new_run_dir(spark, "index")
    fields = [IndexField("text", indexed=True, tokenized=True)]
    turns = shared.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    items = shared.table(spark, sf, "benchmark").select(
        (F.lit(1_000_000_000) + F.col("item_id")).alias("id"), "text"
    )
    for rows, mode in (
        (items, index_files.CREATE_OR_APPEND),
        (turns, index_files.CREATE),
        (items, index_files.APPEND),
    ):
        index_files.add_documents(rows, "id", fields, path, mode)
    both = index_files.read_index(spark, path)
    n_docs = both.corpus.agg(F.sum("n_docs")).first()[0]
    found = both.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n_postings"))
    return both.terms.groupBy("term").agg(F.sum("df").alias("df")).join(
        found, "term", "full"
    ).withColumns({
        "n_docs": F.lit(n_docs).cast("bigint"),
        "doc_rows": F.lit(both.docs.count()).cast("bigint"),
    })


@query("s6_index_scan", "SELECT doc_id, lang, source, n_chars FROM documents")
def s6_index_scan(spark, sf):
    """A written index next to one that was never written, which reads as empty."""
    absent = index_files.read_index(
        spark, new_run_dir(spark, "nothing-here"), shared.DOCUMENT_FIELDS
    )
    return shared.document_index(spark, sf).stored().unionByName(absent.stored())


@query("s7_index_upsert", f"""
WITH changed AS (
  SELECT doc_id, text, lang, source FROM documents
  WHERE lang <> 'de' AND doc_id NOT IN (SELECT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, string_agg(text, ' ' ORDER BY turn), 'talk', 'conversations'
  FROM conversations GROUP BY conv_id),
occurrences AS ({shared.terms_sql("changed", "doc_id", "text")}),
counts AS (
SELECT 'text' AS field, term, count(DISTINCT doc_id) AS df FROM occurrences GROUP BY term
UNION ALL SELECT 'lang', lang, count(*) FROM changed GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM changed GROUP BY source)
SELECT *, df AS n_postings, (SELECT count(*) FROM changed) AS doc_rows FROM counts""")
def s7_index_upsert(spark, sf):
    """All German documents make way for conversations, which also replace equal ids.

    The index is updated where it lies.
    """
    talks = shared.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("turn", "text"))),
                lambda entry: entry["text"],
            ),
            " ",
        ).alias("text")
    )
    rows = talks.select(
        F.col("conv_id").alias("doc_id"), "text", F.lit("talk").alias("lang"),
        F.lit("conversations").alias("source"), F.length("text").cast("bigint").alias("n_chars"),
    )
    path = new_run_dir(spark, "index")
    index_files.add_documents(
        shared.documents(spark, sf), "doc_id", shared.DOCUMENT_FIELDS, path,
        index_files.CREATE,
    )
    index_files.update_documents(rows, "doc_id", path, "lang", "de")
    changed = index_files.read_index(spark, path)
    found = changed.postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n_postings"))
    return changed.terms.groupBy("field", "term").agg(F.sum("df").alias("df")).filter(
        "df > 0"
    ).join(found, ["field", "term"], "full").withColumn(
        "doc_rows", F.lit(changed.docs.count()).cast("bigint")
    )


# --- search ------------------------------------------------------------------------------

def _ranked(result: search.SearchResult) -> DataFrame:
    return result.to_df().select(
        F.col("rank").cast("bigint"), "doc_id", "score", "lang", "source", "n_chars",
        "total_hits",
    )


def _ranked_sql(scored: str, limit: int, where: str = "true", offset: int = 0) -> str:
    """Rank rows of (doc_id, score); the score is rounded before it is compared."""
    return f"""
rounded AS (SELECT doc_id, round(score, 6) AS score FROM ({scored})),
ranked AS (
  SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total_hits,
         doc_id, score, lang, source, n_chars
  FROM rounded JOIN documents USING (doc_id) WHERE {where})
SELECT place - {offset} AS rank, doc_id, score, lang, source, n_chars, total_hits
FROM ranked WHERE place > {offset} AND place <= {offset} + {limit}"""


def _one_term_sql(term: str) -> str:
    return f"""SELECT doc_id, sqrt(tf) * idf * norm AS score
FROM postings JOIN dictionary USING (term) WHERE term = '{term}'"""


@query("q2_ranked_search", f"WITH {shared.POSTINGS_SQL}," + _ranked_sql(
    _one_term_sql("tion"), 10))
def q2_ranked_search(spark, sf):
    return _ranked(search.search_text(shared.document_index(spark, sf), "text", "tion", 10))


def _has(test: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM postings WHERE {test})"


_ERST, _TION, _BLE = (_has(f"term = '{word}'") for word in ("erst", "tion", "ble"))
_EN_LA = """doc_id IN (SELECT a.doc_id FROM occurrences a JOIN occurrences b
  ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.term = 'en' AND b.term = 'la')"""

#: Query texts, and which documents they find.
_QUERY_TEXTS = {
    "+tion -ble": f"{_TION} AND NOT {_BLE}",
    "tion AND erst": f"{_TION} AND {_ERST}",
    '"en la" erst': f"({_EN_LA} OR {_ERST})",
    "(tion OR erst) AND NOT ble": f"({_TION} OR {_ERST}) AND NOT {_BLE}",
    "que* NOT que": _has("term LIKE 'que%'") + " AND NOT " + _has("term = 'que'"),
    "lang:de AND erst^2": f"lang = 'de' AND {_ERST}",
    "+[tha TO thb] +th?t*on": _has("term BETWEEN 'tha' AND 'thb'") + " AND "
                              + _has("term LIKE 'th_t%on'"),
    "+{erst TO es} +[tion TO *]": _has("term > 'erst' AND term < 'es'") + " AND " + _has("term >= 'tion'"),
    "[* TO and}": _has("term < 'and'"),
}


@query("q2_query_text", f"WITH {shared.POSTINGS_SQL}" + " UNION ALL ".join(
    f"""
SELECT '{asked}' AS asked, doc_id FROM documents WHERE {test}"""
    for asked, test in _QUERY_TEXTS.items()))
def q2_query_text(spark, sf):
    """Everything that several query texts find."""
    index = shared.document_index(spark, sf)
    found = [
        search.search_text(index, "text", asked, None).matched.select(
            F.lit(asked).alias("asked"), "doc_id"
        )
        for asked in _QUERY_TEXTS
    ]
    return reduce(DataFrame.unionByName, found)


@query("q3_search_after", f"WITH {shared.POSTINGS_SQL}," + _ranked_sql(
    _one_term_sql("tion"), 10, offset=10))
def q3_search_after(spark, sf):
    """The second page: what comes after the last hit of the first."""
    index = shared.document_index(spark, sf)
    last = search.search_text(index, "text", "tion", 10).hits.orderBy(F.desc("rank")).first()
    after = (last["score"], last["doc_id"])
    return _ranked(search.search_text(index, "text", "tion", 10, after=after))


@query("q4_fetch_document", f"""
WITH {shared.POSTINGS_SQL},
best AS (
  SELECT doc_id FROM ({_one_term_sql("erst")}) ORDER BY round(score, 6) DESC, doc_id LIMIT 1)
SELECT doc_id, lang, source, n_chars FROM documents JOIN best USING (doc_id)""")
def q4_fetch_document(spark, sf):
    """The stored fields of the best hit, by its id."""
    index = shared.document_index(spark, sf)
    best = search.search_text(index, "text", "erst", 1).hits.first()
    return index_files.fetch_document(index, best["doc_id"])


@query("q5_fetch_in_order", """
SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, doc_id,
       CAST(n_chars AS DOUBLE) AS score, lang, source, n_chars
FROM documents JOIN labels USING (doc_id)""")
def q5_fetch_in_order(spark, sf):
    """Stored fields of all labelled documents, in a given order: longest first."""
    index = shared.document_index(spark, sf)
    labelled = shared.table(spark, sf, "labels").select("doc_id")
    wanted = index.docs.join(labelled, "doc_id", "left_semi").select(
        F.lit(None).cast("int").alias("rank"), "doc_id",
        F.col("n_chars").cast("double").alias("score"),
    )
    fetched = search.fetch_hits(index, wanted)
    placed = search.ranked_rows(fetched.drop("rank"), ["score", "doc_id"], [True, False])
    return placed.select(
        F.col("rank").cast("bigint"), "doc_id", "score", "lang", "source", "n_chars"
    )


@query("p2_exact_term", f"""
WITH {shared.POSTINGS_SQL}
SELECT 'text' AS field, doc_id, round(sqrt(tf) * idf * norm, 6) AS score
FROM postings JOIN dictionary USING (term) WHERE term = 'que'
UNION ALL
SELECT 'source', doc_id, round(1 + ln((SELECT n_docs FROM corpus) / (count(*) OVER () + 1)), 6)
FROM documents WHERE source = 'src3'""")
def p2_exact_term(spark, sf):
    """One term of an analysed field, and one whole value of an unanalysed one."""
    index = shared.document_index(spark, sf)
    asked = [search.term_query("text", "que"), search.term_query("source", "src3")]
    return reduce(DataFrame.unionByName, [
        search.matching(index, term).select(F.lit(term.field).alias("field"), "doc_id", "score")
        for term in asked
    ])


@query("p5_boolean_query", f"""
WITH {shared.POSTINGS_SQL},
weights AS (
  SELECT 1 / sqrt(sum(idf * idf)) AS query_norm FROM dictionary
  WHERE term IN ('tion', 'ing', 'ther')),
found AS (
  SELECT doc_id, sum(sqrt(tf) * idf * idf * norm) AS sum, count(*) AS matched,
         count(*) FILTER (term = 'tion') AS n_must
  FROM postings JOIN dictionary USING (term)
  WHERE term IN ('tion', 'ing', 'ther')
    AND doc_id NOT IN (SELECT doc_id FROM postings WHERE term = 'la')
  GROUP BY doc_id)
SELECT doc_id, round(sum * matched / 3 * query_norm, 6) AS score
FROM found, weights WHERE n_must = 1""")
def p5_boolean_query(spark, sf):
    asked = search.boolean_query(
        search.term_query("text", "tion"), search.MUST,
        search.term_query("text", "ing"), search.SHOULD,
        search.term_query("text", "ther"), search.SHOULD,
        search.term_query("text", "la"), search.MUST_NOT,
    )
    return search.matching(shared.document_index(spark, sf), asked)


@query("p6_filtered_search", f"WITH {shared.POSTINGS_SQL}," + _ranked_sql(
    _one_term_sql("tion"), 20, "n_chars BETWEEN 500 AND 3000"))
def p6_filtered_search(spark, sf):
    """Hits within a length range; their scores are those of the unfiltered search."""
    within = search.numeric_range_query("n_chars", 500, 3000)
    return _ranked(
        search.search_text(shared.document_index(spark, sf), "text", "tion", 20, within)
    )


_ANY_WORD = "thing que der ble que"


@query("q6_any_word_search", f"""
WITH {shared.POSTINGS_SQL},
asked AS (
  SELECT term, count(*) AS uses
  FROM (SELECT unnest(string_split('{_ANY_WORD}', ' ')) AS term) GROUP BY term),
weighed AS (
  SELECT term, uses, coalesce(idf, 1 + ln((SELECT n_docs FROM corpus))) AS idf
  FROM asked LEFT JOIN dictionary USING (term)),
weights AS (
  SELECT 1 / sqrt(sum(uses * idf * idf)) AS query_norm, sum(uses) AS n_clauses FROM weighed),
{_ranked_sql('''
SELECT doc_id, sum(uses * sqrt(tf) * idf * idf * norm) * sum(uses) / any_value(n_clauses)
       * any_value(query_norm) AS score
FROM postings JOIN weighed USING (term), weights GROUP BY doc_id''', 25).strip()}""")
def q6_any_word_search(spark, sf):
    """Several words, any of which may match; one of them counts twice."""
    return _ranked(
        search.search_text(shared.document_index(spark, sf), "text", _ANY_WORD, 25)
    )


_PHRASE = ("en", "la")


@query("q7_phrase", f"""
WITH {shared.POSTINGS_SQL},
weights AS (SELECT sum(idf) AS idf FROM dictionary WHERE term IN {_PHRASE}),
phrases AS (
  SELECT a.doc_id, count(*) AS tf
  FROM occurrences a JOIN occurrences b
    ON a.doc_id = b.doc_id AND b.position = a.position + 1
  WHERE a.term = '{_PHRASE[0]}' AND b.term = '{_PHRASE[1]}' GROUP BY a.doc_id)
SELECT doc_id, round(sqrt(p.tf) * w.idf * norm, 6) AS score
FROM phrases p JOIN (SELECT DISTINCT doc_id, norm FROM postings) USING (doc_id), weights w""")
def q7_phrase(spark, sf):
    index = shared.document_index(spark, sf)
    return search.matching(index, search.Phrase("text", _PHRASE))


@query("q8_prefix_and_wildcard", f"""
WITH {shared.POSTINGS_SQL}
SELECT DISTINCT 'que*' AS pattern, doc_id, CAST(1 AS DOUBLE) AS score FROM postings
WHERE term LIKE 'que%'
UNION ALL
SELECT DISTINCT 'th?t*on', doc_id, CAST(1 AS DOUBLE) FROM postings WHERE term LIKE 'th_t%on'""")
def q8_prefix_and_wildcard(spark, sf):
    index = shared.document_index(spark, sf)
    asked = {
        "que*": search.Prefix("text", "que"),
        "th?t*on": search.Wildcard("text", "th?t*on"),
    }
    return reduce(DataFrame.unionByName, [
        search.matching(index, found).select(F.lit(pattern).alias("pattern"), "doc_id", "score")
        for pattern, found in asked.items()
    ])


@query("q9_fuzzy", f"""
WITH {shared.POSTINGS_SQL}
SELECT DISTINCT doc_id, CAST(1 AS DOUBLE) AS score FROM postings
WHERE levenshtein(term, 'thingonn') <= 2""")
def q9_fuzzy(spark, sf):
    return search.matching(
        shared.fuzzy_index(spark, sf), search.Fuzzy("text", "thingonn")
    )


@query("q10_term_range", f"""
WITH {shared.POSTINGS_SQL}
SELECT DISTINCT doc_id, CAST(1 AS DOUBLE) AS score FROM postings
WHERE term BETWEEN 'thingea' AND 'thingha'""")
def q10_term_range(spark, sf):
    return search.matching(
        shared.document_index(spark, sf), search.TermRange("text", "thingea", "thingha")
    )


@query("q11_batch_search", f"""
WITH {shared.POSTINGS_SQL},
asked AS ({shared.terms_sql("benchmark", "item_id", "text")}),
weighed AS (
  SELECT item_id, term, count(*) AS uses, any_value(df) AS df,
         coalesce(any_value(idf), 1 + ln((SELECT n_docs FROM corpus))) AS idf
  FROM asked LEFT JOIN dictionary USING (term) GROUP BY item_id, term),
weights AS (
  SELECT item_id, sum(uses) AS n_clauses, sqrt(sum(uses * idf * idf)) AS length
  FROM weighed GROUP BY item_id),
summed AS (
  SELECT item_id, doc_id, sum(uses * sqrt(tf) * idf * idf * norm) AS sum, sum(uses) AS matched
  FROM postings JOIN weighed USING (term) GROUP BY item_id, doc_id),
scored AS (
  SELECT item_id AS query_id, doc_id, round(sum * matched / n_clauses / length, 6) AS score
  FROM summed JOIN weights USING (item_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM scored)
SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10""")
def q11_batch_search(spark, sf):
    """Every benchmark text as a query against all documents."""
    asked = shared.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), "text"
    )
    found = search.search_batch(shared.document_index(spark, sf), asked, "text", 10)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("bigint"))


# --- the whole path ----------------------------------------------------------------------

_PAGE_TEXT_SQL = page_queries._TEXT_SQL


@query("q12_pages_to_hits", f"""
WITH texts AS (
  SELECT page_id, url, {_PAGE_TEXT_SQL} AS fulltext,
         trim({page_queries._H1_SQL.format(t='title')}) AS title
  FROM pages),
occurrences AS ({shared.terms_sql("texts", "page_id", "fulltext")}),
lengths AS (SELECT page_id, count(*) AS n_terms FROM occurrences GROUP BY page_id),
scored AS (
  SELECT page_id AS doc_id, round(sqrt(count(*)) * any_value({shared.NORM_SQL})
    * (1 + ln((SELECT count(*) FROM pages) / (count(*) OVER () + 1))), 6) AS score
  FROM occurrences JOIN lengths USING (page_id) WHERE term = 'tion' GROUP BY page_id)
SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score, url, title,
       CAST(length(fulltext) AS BIGINT) AS n_chars, count(*) OVER () AS total_hits
FROM scored JOIN texts ON page_id = doc_id QUALIFY rank <= 10""")
def q12_pages_to_hits(spark, sf):
    """Raw pages to ranked hits: scrape, index, search."""
    index = index_pages(spark, shared.pages(spark, sf), new_run_dir(spark, "pages-index"))
    found = search.search_text(index, "fulltext", "tion", 10)
    return found.to_df().select(
        F.col("rank").cast("bigint"), "doc_id", "score", "url", "title",
        F.col("n_chars").cast("bigint"), "total_hits",
    )
