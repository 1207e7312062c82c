"""One query per text operator over the given tables, and the SQL it is checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from pagelake.llm import (
    bpe, debruijn, hamming, language, line_dedup, main_text, packing, pivot_codes, repetition,
    set_join, simhash, spelling, url_filter,
)
from pagelake.llm.tables import read, short_batches

QUERIES = {}
ORACLES = {}

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_LOWER = "'abcdefghijklmnopqrstuvwxyz'"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"'[^\x20\x09-\x0D]+'"


def query(name: str, sql: str | None = None):
    def register(run):
        def prepared(spark, sf_dir):
            short_batches(spark)
            return run(spark, sf_dir)

        QUERIES[name] = prepared
        if sql is not None:
            ORACLES[name] = sql
        return prepared
    return register


# --- op3: lines that at least ten documents share -----------------------------------------

@query("op3_line_dedup", f"""
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, {_WHITE}), {_UPPER}, {_LOWER}) AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), ''))
         AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key) GROUP BY doc_id""")
def op3_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_frequent_lines(docs, min_docs=10)
    return kept.select(
        "doc_id", "line_counts.n_lines", "line_counts.n_dropped",
        F.sha2(F.encode("line_kept", "UTF-8"), 256).alias("kept_sha256"),
    )


# --- op6: quality rules -------------------------------------------------------------------

@query("op6_quality_rules", f"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
), windows AS (
  SELECT doc_id, size, pos, list_aggregate(w[pos:pos + size - 1], 'string_agg', ' ') AS window_text
  FROM words, (VALUES (3), (10), (101)) AS s(size),
       LATERAL (SELECT unnest(generate_series(1, len(w) - size + 1)) AS pos)
  WHERE len(w) >= size
), again AS (
  SELECT doc_id, size, pos FROM (
    SELECT *, count(*) OVER (PARTITION BY doc_id, size, window_text) AS n FROM windows
  ) WHERE n > 1
), covered AS (
  SELECT doc_id, size, count(DISTINCT pos + step) AS n
  FROM again, LATERAL (SELECT unnest(generate_series(0, size - 1)) AS step)
  WHERE size < 101 GROUP BY doc_id, size
), longest AS (
  SELECT DISTINCT doc_id FROM again WHERE size = 101
), dup_lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words
  ) WHERE regexp_matches(line, {_WORD}) GROUP BY doc_id
), measured AS (
  SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(d.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         coalesce(t.n, 0) AS covered, l.doc_id IS NOT NULL AS too_long
  FROM words w LEFT JOIN dup_lines d ON d.doc_id = w.doc_id
  LEFT JOIN covered c ON c.doc_id = w.doc_id AND c.size = 3
  LEFT JOIN covered t ON t.doc_id = w.doc_id AND t.size = 10
  LEFT JOIN longest l ON l.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND covered <= 0.3 * n_words AND NOT too_long AS kept
FROM measured""")
def op6_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = repetition.judge_quality(docs)
    fields = (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept",
    )
    return judged.select("doc_id", *[f"quality.{name}" for name in fields])


# --- op9: URL rules and character language models -----------------------------------------

def _rule_sql(column: int) -> str:
    """A field of the longest rule that fits, as a CASE over host and path."""
    choices = []
    for verdict, rule in sorted(url_filter.RULES, key=lambda pair: -len(pair[1])):
        host, slash, rest = rule.partition("/")
        choices.append(
            f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) "
            f"AND starts_with(path, '{slash}{rest}') THEN '{(rule, verdict)[column]}'"
        )
    return f"CASE {' '.join(choices)} END"


def _markov_sql() -> str:
    """Tables p0 .. pN of both models' probabilities from the counts in cN."""
    order, weight, alphabet = url_filter.ORDER, url_filter.WEIGHT, url_filter.ALPHABET
    parts = [
        f"""c{k} AS (SELECT substr(gram, 2) AS gram, sum(a) AS a, sum(b) AS b FROM c{k + 1} GROUP BY 1)"""
        for k in range(order - 1, -1, -1)
    ]
    parts.append(f"""p0 AS (
  SELECT gram, (a + {weight / alphabet}) / (all_a + {weight}) AS pa,
         (b + {weight / alphabet}) / (all_b + {weight}) AS pb
  FROM c0, (SELECT sum(a) AS all_a, sum(b) AS all_b FROM c0))""")
    for k in range(1, order + 1):
        parts.append(f"""p{k} AS (
  SELECT c.gram, (c.a + {weight} * p.pa) / (x.a + {weight}) AS pa,
         (c.b + {weight} * p.pb) / (x.b + {weight}) AS pb
  FROM c{k} c JOIN p{k - 1} p ON p.gram = substr(c.gram, 2)
  JOIN (SELECT left(gram, {k}) AS context, sum(a) AS a, sum(b) AS b FROM c{k} GROUP BY 1) x
    ON x.context = left(c.gram, {k}))""")
    return ",\n".join(parts)


@query("op9_url_filter", f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            {_UPPER}, {_LOWER}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), ruled AS (
  SELECT *, host || path AS place, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS label FROM parts
), texts AS (
  SELECT DISTINCT place, label,
         CAST('0x' || left(md5(place), 8) AS BIGINT) % {url_filter.HELD_OUT} = 0 AS held FROM ruled
), grams AS (
  SELECT place, label, held, substr('{"^" * url_filter.ORDER}' || place || '$', at_place,
                                    {url_filter.ORDER + 1}) AS gram
  FROM texts, LATERAL (SELECT unnest(generate_series(1, length(place) + 1)) AS at_place)
), c{url_filter.ORDER} AS (
  SELECT gram, CAST(count(*) FILTER (WHERE label = 'allow' AND NOT held) AS DOUBLE) AS a,
         CAST(count(*) FILTER (WHERE label = 'block' AND NOT held) AS DOUBLE) AS b
  FROM grams GROUP BY gram
), {_markov_sql()},
scores AS (
  SELECT place, label, held, round(sum(ln(pa) - ln(pb)) / count(*), 9) AS score
  FROM grams JOIN p{url_filter.ORDER} USING (gram) GROUP BY place, label, held
), bins AS (
  SELECT CAST(greatest(-800, least(800, floor(score * 100))) AS INT) AS bin,
         count(*) FILTER (WHERE label = 'allow') AS good,
         count(*) FILTER (WHERE label = 'block') AS bad
  FROM scores WHERE held AND label IS NOT NULL GROUP BY 1
), cuts AS (
  SELECT bin, sum(coalesce(good, 0)) OVER () AS goods, sum(coalesce(bad, 0)) OVER () AS bads,
         coalesce(sum(coalesce(good, 0)) OVER before, 0) AS lost,
         coalesce(sum(coalesce(bad, 0)) OVER before, 0) AS caught
  FROM (SELECT unnest(generate_series(-800, 800)) AS bin) LEFT JOIN bins USING (bin)
  WINDOW before AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT bin / 100.0 AS threshold FROM cuts
  ORDER BY CASE WHEN goods > 0 AND bads > 0 THEN
             round((goods - lost) / goods, 9) + round(caught / bads, 9) ELSE 0 END DESC,
           abs(bin), bin LIMIT 1
)
SELECT page_id, host, path, rule,
       coalesce(r.label, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled r JOIN scores s USING (place), cut""")
def op9_url_filter(spark, sf_dir):
    judged = url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    fields = ("host", "path", "rule", "verdict")
    return judged.select("page_id", *[f"url_verdict.{name}" for name in fields])


# --- op5: packing into sequences of 2048 tokens -------------------------------------------

@query("op5_pack")
def op5_pack(spark, sf_dir):
    return packing.pack_documents(
        read(spark, sf_dir, "documents").select("doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.json"), 2048,
        ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


# --- op8: encoding and decoding -----------------------------------------------------------

@query("op8_bpe_round_trip")
def op8_bpe_round_trip(spark, sf_dir):
    encoded = bpe.encode_documents(
        read(spark, sf_dir, "documents").select("doc_id", "text"),
        public_tokenizers.path("word_bpe_49k.json"),
    )
    ids = F.col("bpe.ids")
    return encoded.select(
        "doc_id", F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(ids.cast("array<string>"), " "), "UTF-8"), 256)
        .alias("ids_sha256"),
        F.sha2(F.encode("bpe.decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


# --- op2: main text of pages --------------------------------------------------------------

@query("op2_html_extract")
def op2_html_extract(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = pages.select(
        "page_id", "url", main_text.extract_main_text(F.col("html")).alias("text")
    )
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


# --- op4: languages -----------------------------------------------------------------------

@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    model = language.LanguageModel.fit(docs.where(~held_out))
    found = docs.select(
        "doc_id", held_out.alias("held_out"), model.predict(F.col("text")).alias("mixture")
    )
    return found.select(
        "doc_id", "held_out", F.col("mixture.lang").alias("lang_pred"), "mixture.score",
        F.col("mixture.langs").alias("langs"), F.col("mixture.shares").alias("shares"),
    )


# --- op1: near duplicates by fingerprint --------------------------------------------------

@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, width=3, radius=3)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


# --- op10: nearest codes ------------------------------------------------------------------

@query("op10_topk_search", """
WITH pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         list_sum(list_transform(generate_series(1, 64), lambda i:
           CASE WHEN (q.embedding[i] > 0) <> (r.embedding[i] > 0) THEN 1 ELSE 0 END))
           AS distance
  FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
  FROM pairs
)
SELECT query_id, rank, vec_id, CAST(distance AS BIGINT) AS distance FROM ranked
WHERE rank <= 10""")
def op10_topk_search(spark, sf_dir):
    codes = read(spark, sf_dir, "embeddings").select(
        "vec_id", hamming.sign_code(F.col("embedding")).alias("code")
    )
    return hamming.top_k(codes, codes.where("vec_id % 100 = 0"), 10, key="vec_id")


# --- op7: passages of twenty words found earlier ------------------------------------------

@query("op7_substring_dedup", f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
), windows AS (
  SELECT doc_id, pos, list_aggregate(w[pos:pos + 19], 'string_agg', ' ') AS passage
  FROM words, LATERAL (SELECT unnest(generate_series(1, len(w) - 19)) AS pos)
  WHERE len(w) >= 20
), later AS (
  SELECT doc_id, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY passage ORDER BY doc_id, pos) AS n FROM windows
  ) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + step AS pos
  FROM later, LATERAL (SELECT unnest(generate_series(0, 19)) AS step)
), single AS (
  SELECT doc_id, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS word FROM words
), kept AS (
  SELECT s.doc_id, count(g.pos) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY s.pos) FILTER (WHERE g.pos IS NULL), '') AS k
  FROM single s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.pos = s.pos GROUP BY s.doc_id
)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id""")
def op7_substring_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = debruijn.remove_repeats(docs, window=20)
    return kept.select(
        "doc_id", "repeats.n_words", "repeats.n_removed",
        F.sha2(F.encode("repeats.kept", "UTF-8"), 256).alias("kept_sha256"),
    )


# --- op11: sets of shingles with a Jaccard similarity of 0.9 ------------------------------

@query("op11_jaccard_join", f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_WORD}) AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2),
                                      lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  END AS shingles FROM words
), single AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM single a JOIN single b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
""")
def op11_jaccard_join(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return set_join.similar_sets(docs, width=3, percent=90)


# --- op12: product codes of vectors -------------------------------------------------------

def _assigned_sql(step: int) -> str:
    """a{step}: for each part of a vector, 64 times its least distance plus the entry."""
    return f"""a{step} AS (
  SELECT vec_id, label, part, min(64 * error + entry) AS best FROM (
    SELECT p.vec_id, any_value(p.label) AS label, p.part, c.entry,
           sum((p.x - c.x) * (p.x - c.x)) AS error
    FROM parts p JOIN c{step} c ON c.part = p.part AND c.pos = p.pos
    GROUP BY p.vec_id, p.part, c.entry
  ) GROUP BY vec_id, label, part
)"""


def _improved_sql(step: int) -> str:
    """c{step + 1}: the floors of the means; unused entries stay."""
    return f"""c{step + 1} AS (
  SELECT c.part, c.entry, c.pos, coalesce(m.x, c.x) AS x FROM c{step} c LEFT JOIN (
    SELECT p.part, a.best % 64 AS entry, p.pos, CAST(floor(sum(p.x)::DOUBLE / count(*)) AS BIGINT) AS x
    FROM parts p JOIN a{step} a ON a.vec_id = p.vec_id AND a.part = p.part
    GROUP BY p.part, a.best % 64, p.pos
  ) m ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos
)"""


@query("op12_pivot_codes", f"""
WITH vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, (at_place - 1) // (len(v) // 16) AS part, (at_place - 1) % (len(v) // 16) AS pos,
         v[at_place] AS x
  FROM vectors, LATERAL (SELECT unnest(generate_series(1, len(v))) AS at_place)
), c0 AS (
  SELECT part, entry, pos, x FROM parts
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM vectors
        ORDER BY vec_id LIMIT 64) USING (vec_id)
), {_assigned_sql(0)}, {_improved_sql(0)}, {_assigned_sql(1)}, {_improved_sql(1)}, {_assigned_sql(2)},
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', best % 64)), '' ORDER BY part) AS code,
         CAST(sum(best // 64) AS BIGINT) AS error
  FROM a2 GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c2) AS codebooks_sha256
FROM coded""")
def op12_pivot_codes(spark, sf_dir):
    found = pivot_codes.pivot_codes(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


# --- op13: spelling variants --------------------------------------------------------------

@query("op13_spelling_variants", f"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS step FROM generate_series(0, 255) AS g(i)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1
  FROM bits WHERE step < 8
), crc_table AS (
  SELECT list(c ORDER BY byte) AS t FROM bits WHERE step = 8
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}),
                                           '[a-zÀ-ÿ]+')) AS run FROM documents
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY doc_id, run
), keyed AS (
  SELECT *, hex(encode(doc_id::VARCHAR || ':' || run)) AS digits FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(generate_series(1, length(digits) // 2),
      lambda i: CAST('0x' || substr(digits, 2 * i - 1, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]))) AS h
  FROM keyed, crc_table
), changed AS (
  SELECT n, CASE WHEN h % 31 = 0
    THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 7
  GROUP BY word HAVING sum(n) >= 2
), shorter AS (
  SELECT word, n, at_place, left(word, at_place - 1) || substr(word, at_place + 1) AS rest
  FROM words, LATERAL (SELECT unnest(generate_series(1, length(word))) AS at_place)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM shorter a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON b.word = a.rest
  UNION SELECT a.word, a.n, b.word, b.n FROM shorter a
    JOIN shorter b ON a.rest = b.rest AND a.at_place = b.at_place AND a.word <> b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS form, max(m) AS form_n, n
  FROM near GROUP BY word, n
), forms AS (
  SELECT word, form, form_n FROM best WHERE form_n >= 10 * n
), followed AS (
  SELECT word, word AS root, 0 AS step FROM words
  UNION ALL SELECT f.word, o.form, step + 1 FROM followed f JOIN forms o ON o.word = f.root
), roots AS (
  SELECT word, arg_max(root, step) AS root FROM followed GROUP BY word
)
SELECT w.word, f.form, r.root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w JOIN roots r ON r.word = w.word LEFT JOIN best b ON b.word = w.word
LEFT JOIN forms f ON f.word = w.word""")
def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))
