import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelake.functions import analysis, scoring
from pagelake.operators import batch_search, fuzzy
from pagelake.operators import search as s
from pagelake.operators.index import IndexField, build_index, project, update_index
from pagelake.sources import index_files
from pagelake.sources.index_files import add_documents, read_index, save_index

FIELDS = [
    IndexField("name", indexed=True, stored=True),
    IndexField("grower", indexed=True, stored=True),
    IndexField("weight", "long", indexed=True, stored=True),
    IndexField("strength", "double", indexed=True, stored=True),
    IndexField("price", "double", indexed=True, stored=True),
    IndexField("picked", "date", indexed=True, stored=True),
    IndexField("fulltext", indexed=True, tokenized=True),
]
TEAS = [
    (0, "Assam 10", "Assam", 70, 46.0, 9.9, "2012-01-01T00:00:00Z", "Assam 10yo\nAssam tea"),
    (1, "Keemun 30", "Keemun", 70, 54.3, 25.0, "2012-02-01T00:00:00Z", "Keemun 30yo\nKeemun tea"),
    (2, "Yunnan 30", "Yunnan", 70, 49.3, 15.0, "2012-03-01T00:00:00Z", "Yunnan 30yo\nYunnan tea"),
    (3, "Uva Hills 30", "Uva Hills", 70, 56.4, 35.0, "2012-04-01T00:00:00Z", "Uva Hills 30yo\nUva Hills tea"),
    (4, "Ceylon 30", "Ceylon", 70, 41.3, 10.0, "2012-05-01T00:00:00Z", "Ceylon 30yo\nCeylon tea"),
]
COLUMNS = "id bigint, name string, grower string, weight bigint, strength double, price double, picked string, fulltext string"


@pytest.fixture(scope="module")
def teas(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "teas")
    add_documents(spark.createDataFrame(TEAS, COLUMNS), "id", FIELDS, path)
    return read_index(spark, path)


def hits(result):
    return [(row["doc_id"], row["score"]) for row in result.docs.collect()]


def text_index(spark, texts, path, mode=index_files.CREATE, start=0):
    rows = spark.createDataFrame([(start + at, text) for at, text in enumerate(texts)], "id bigint, t string")
    add_documents(rows, "id", [IndexField("t", indexed=True, stored=True, tokenized=True)], path, mode)
    return read_index(spark, path)


def test_golden_scores(teas):
    found = s.search_text(teas, "fulltext", "tea", 10)
    assert found.total_hits == 5
    assert hits(found) == [(0, 0.408839), (1, 0.408839), (2, 0.408839), (4, 0.408839), (3, 0.306629)]
    row = found.to_df().first()
    assert row["total_hits"] == 5 and row["rank"] == 1 and row["price"] == 9.9
    assert "fulltext" not in row.asDict()


def test_filter_leaves_scores(teas):
    cheap = s.numeric_range_query("price", 5.0, 20.0)
    found = s.search_text(teas, "fulltext", "tea", 10, cheap)
    assert found.total_hits == 3
    assert hits(found) == [(0, 0.408839), (2, 0.408839), (4, 0.408839)]


def test_three_pages(spark, tmp_path):
    index = text_index(spark, ["test"] * 30, str(tmp_path / "thirty"))
    after, seen = None, []
    for _ in range(3):
        found = s.search_text(index, "t", "test", 10, after=after)
        assert found.total_hits == 30
        page = hits(found)
        assert {score for _, score in page} == {0.967210}
        seen += [doc for doc, _ in page]
        after = (0.9672102, page[-1][0])
    assert seen == list(range(30))
    assert hits(s.search_text(index, "t", "test", 10, after=after)) == []


def test_input_contract(spark, teas, tmp_path):
    absent = read_index(spark, str(tmp_path / "absent"), FIELDS)
    for index, text in ((absent, "tea"), (teas, ""), (teas, None), (teas, "*ea"), (teas, "?ea"), (teas, "the")):
        found = s.search_text(index, "fulltext", text, 10)
        assert found.total_hits == 0 and hits(found) == []
    assert s.search_text(teas, "fulltext", "\"'foo", 10) is None
    assert hits(s.search_text(teas, "fulltext", "zzz", 10)) == []


def test_length_norm_is_the_byte_encoding(spark):
    import numpy as np
    rows = spark.range(1, 70_000).select("id", scoring.length_norm(F.col("id")).alias("n")).toPandas()
    exact = (1 / np.sqrt(rows["id"].to_numpy(dtype=float))).astype(np.float32)
    kept = ((exact.view(np.int32) >> 21) << 21).astype(np.int32).view(np.float32)
    assert (kept == rows["n"].to_numpy(dtype=np.float32)).all()


@pytest.mark.parametrize("text, expected", [
    ("The Quick, brown FOX!", ["quick", "brown", "fox"]),
    ("don't 3.14 1,000 a.b.c example.com.", ["don't", "3.14", "1,000", "a.b.c", "example.com"]),
    ("x_y 30yo 1.a", ["x_y", "30yo", "1"]),
    ("Straße naïve 茶葉 tea", ["straße", "naïve", "茶", "葉", "tea"]),
    ("", []), (" .. -- ", []), ("x" * 256 + " y", ["x" * 256, "y"]),
])
def test_analysis(spark, text, expected):
    row = spark.range(1).select(analysis.terms(F.lit(text)).alias("v")).first()
    assert row["v"] == expected


def test_long_tokens_do_not_overflow_the_matcher(spark):
    text = "a1" * 200_000 + " " + "b.c" * 100_000 + " end"
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(analysis.terms(F.col("t"), 255).alias("v")).first()["v"] == ["end"]
    assert [len(w) for w in frame.select(analysis.terms(F.col("t")).alias("v")).first()["v"]] == [400_000, 300_000, 3]


def test_documents_of_one_row_group_are_analysed_by_many_tasks(spark, tmp_path):
    from registry import searching
    rows = [(i, f"tea {i % 7} green tea {i}", "en", "a", 20) for i in range(400)]
    spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"
    ).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = searching.q1_postings(spark, str(tmp_path))
    tasks = found.withColumn("task", F.spark_partition_id()).select("task", "doc_id").distinct()
    per_task = [row["count"] for row in tasks.groupBy("task").count().collect()]
    assert len(per_task) == 4 and sum(per_task) == 400 and max(per_task) < 200
    tea = found.filter("doc_id = 8 AND term = 'tea'").collect()
    assert [(row["tf"], row["first_position"], row["last_position"]) for row in tea] == [(2, 0, 3)]


def test_a_task_sorts_its_postings_by_term_in_runs(spark, monkeypatch):
    from pagelake.operators import index as index_ops
    texts = ["tea green tea", None, "", "the of", "zebra apple TEA", "apple " * 5]
    rows = spark.createDataFrame(
        [(i if i < 5 else None, text, "en" if i else None) for i, text in enumerate(texts)],
        "doc_id bigint, text string, lang string",
    ).coalesce(1)
    fields = (IndexField("text", indexed=True, tokenized=True), IndexField("lang", indexed=True))
    expected = {
        ("text", "tea", 0, 2, (0, 2), 3), ("text", "green", 0, 1, (1,), 3),
        ("text", "zebra", 4, 1, (0,), 3), ("text", "apple", 4, 1, (1,), 3),
        ("text", "tea", 4, 1, (2,), 3), ("text", "apple", None, 5, (0, 1, 2, 3, 4), 5),
        ("lang", "en", None, 1, (0,), 1),
    } | {("lang", "en", i, 1, (0,), 1) for i in range(1, 5)}
    for most, runs in ((1_000_000, 1), (3, 3)):
        monkeypatch.setattr(index_ops, "ENTRIES_AT_ONCE", most)
        found = [tuple(row) for row in index_ops.build_postings(rows, fields).collect()]
        assert len(found) == len(expected)
        assert {(*row[:4], tuple(row[4]), row[5]) for row in found} == expected
        terms = [row[1] for row in found if row[0] == "text"]
        assert 1 + sum(a > b for a, b in zip(terms, terms[1:])) <= runs
    assert not index_ops.build_postings(rows.limit(0), fields).collect()


def test_tasks_that_analyse_documents_follow_their_bytes(spark, tmp_path, monkeypatch):
    from registry import shared
    rows = [(i, f"tea {i} " * 50, "en", "a", 20) for i in range(400)]
    spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"
    ).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    few = shared.documents(spark, str(tmp_path)).rdd.getNumPartitions()
    monkeypatch.setattr(shared, "BYTES_PER_TASK", 500)
    assert few == 4 and shared.documents(spark, str(tmp_path)).rdd.getNumPartitions() > 10


def test_typed_projection(spark):
    rows = spark.createDataFrame([("7", 1.5, "2012-05-21T04:21:33.248Z", "drop")], "a string, b double, c string, d string")
    fields = (IndexField("n", "int", "a"), IndexField("f", "float", "b"), IndexField("published", "date", "c"), IndexField("t", "odd", "a"))
    frame = project(rows.withColumn("id", F.lit(1)), "id", fields)
    assert dict(frame.dtypes) == {"doc_id": "bigint", "n": "int", "f": "float", "published": "bigint", "t": "string"}
    assert frame.first()["published"] == 1337574093248


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "modes")
    with pytest.raises(FileNotFoundError):
        text_index(spark, ["one"], path, index_files.APPEND)
    text_index(spark, ["one two"], path, index_files.CREATE_OR_APPEND)
    both = text_index(spark, ["two three"], path, index_files.APPEND, start=10)
    assert s.search_text(both, "t", "two").total_hits == 2
    assert both.corpus.agg(F.sum("n_docs")).first()[0] == 2
    fresh = text_index(spark, ["four"], path, index_files.CREATE)
    assert s.search_text(fresh, "t", "two").total_hits == 0
    assert fresh.stored().count() == 1
    with pytest.raises(ValueError):
        text_index(spark, ["x"], path, "replace")


def _documents(spark, ids, text="one two"):
    return spark.createDataFrame([(n, text) for n in ids], "id long, t string")


def _state(spark, path):
    """Ids in the document table, the corpus size, and df of ``two`` with its postings."""
    index = read_index(spark, path)
    docs = sorted(row["doc_id"] for row in index.docs.collect())
    df = index.terms.filter("term = 'two'").groupBy().sum("df").first()[0] or 0
    assert df == index.postings.filter("term = 'two'").count()
    assert index.corpus.groupBy().sum("n_docs").first()[0] == len(docs)
    return docs


FAILING_FIELDS = [IndexField("t", indexed=True, stored=True, tokenized=True)]


def test_unfinished_writes_are_never_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "broken")
    index_files.add_documents(_documents(spark, range(5)), "id", FAILING_FIELDS, path, buckets=8)

    class Stopped(Exception):
        pass

    def stop(*_):
        raise Stopped

    # Both an append and a create end just before their last write.
    with monkeypatch.context() as patched:
        patched.setattr(index_files, "fields_to_json", stop)
        for mode in (index_files.APPEND, index_files.CREATE):
            with pytest.raises(Stopped):
                index_files.add_documents(_documents(spark, range(20, 30)), "id", FAILING_FIELDS, path, mode)
    assert _state(spark, path) == [0, 1, 2, 3, 4]
    index_files.add_documents(_documents(spark, [9]), "id", FAILING_FIELDS, path, index_files.APPEND)
    assert _state(spark, path) == [0, 1, 2, 3, 4, 9]
    index_files.add_documents(_documents(spark, [3]), "id", FAILING_FIELDS, path, index_files.CREATE)
    assert _state(spark, path) == [3]


def test_appends_are_checked(spark, tmp_path):
    path = str(tmp_path / "checked")
    index_files.add_documents(_documents(spark, range(5)), "id", FAILING_FIELDS, path, buckets=8)
    with pytest.raises(ValueError, match="ids"):
        index_files.add_documents(_documents(spark, [7, 4]), "id", FAILING_FIELDS, path, index_files.APPEND)
    with pytest.raises(ValueError, match="fields"):
        index_files.add_documents(
            _documents(spark, [7]), "id", [IndexField("t", indexed=True)], path, index_files.APPEND
        )
    assert _state(spark, path) == [0, 1, 2, 3, 4]


def test_update_in_place(spark, tmp_path):
    path = str(tmp_path / "index")
    index_files.add_documents(_documents(spark, range(6)), "id", FAILING_FIELDS, path, buckets=8)
    index_files.add_documents(_documents(spark, [6, 7], "two red"), "id", FAILING_FIELDS, path)
    index_files.update_documents(_documents(spark, [0, 20], "two new"), "id", path, "t", "red")
    assert _state(spark, path) == [0, 1, 2, 3, 4, 5, 20]
    # A document that an earlier update deleted comes back.
    index_files.update_documents(_documents(spark, [6], "two again"), "id", path, "t", "new")
    assert _state(spark, path) == [1, 2, 3, 4, 5, 6]
    assert {h[0] for h in hits(s.search_text(read_index(spark, path), "t", "two", None))} == {1, 2, 3, 4, 5, 6}
    index_files.merge_index(spark, path)
    assert _state(spark, path) == [1, 2, 3, 4, 5, 6]
    # Saving a lazy update over the index it was read from.
    replacement = build_index(_documents(spark, [30], "two red"), "id", FAILING_FIELDS)
    save_index(update_index(read_index(spark, path), "t", "again", replacement), path)
    assert _state(spark, path) == [1, 2, 3, 4, 5, 30]


def test_all_hits_are_ranked(teas):
    found = s.search_text(teas, "fulltext", "tea", None).hits.orderBy("rank").collect()
    assert [row["rank"] for row in found] == list(range(1, len(found) + 1)) and len(found) > 1
    assert [row["score"] for row in found] == sorted((row["score"] for row in found), reverse=True)


def test_fetch(spark, teas):
    assert index_files.fetch_document(teas, 3).first()["name"] == "Uva Hills 30"
    assert index_files.fetch_document(teas, 99).count() == 0
    wanted = spark.createDataFrame([(1, 4, 1.0), (2, 0, 0.5), (3, 2, 0.1)], "rank int, doc_id bigint, score double")
    assert [row["doc_id"] for row in s.fetch_hits(teas, wanted).collect()] == [4, 0, 2]
    assert [row["doc_id"] for row in s.fetch_hits(teas, wanted).collect()] == [4, 0, 2]


def test_update(spark, teas, tmp_path):
    row = [(7, "Nilgiri 5", "Nilgiri", 70, 40.0, 8.0, None, "Nilgiri tea tea"), (0, "Assam 11", "Assam", 70, 1.0, 1.0, None, "Assam")]
    replacement = build_index(spark.createDataFrame(row, COLUMNS), "id", FIELDS)
    path = str(tmp_path / "updated")
    save_index(update_index(teas, "grower", "Keemun", replacement), path)
    updated = read_index(spark, path)
    assert {r["doc_id"] for r in updated.stored().collect()} == {0, 2, 3, 4, 7}
    assert s.search_text(updated, "fulltext", "keemun").total_hits == 0
    assert s.search_text(updated, "fulltext", "tea").total_hits == 4
    counted = updated.terms.filter("field = 'fulltext'").collect()
    recounted = updated.postings.filter("field = 'fulltext'").groupBy("term").count().collect()
    assert {r["term"]: r["df"] for r in counted} == {r["term"]: r["count"] for r in recounted}


def test_range_builders(spark):
    assert s.numeric_range_query("n", 3, 42) == s.NumericRange("n", 3, 42)
    for low, high in ((42, 3), (42, None), (None, 42), (42.5, 3.5), (1, 2.0)):
        assert s.numeric_range_query("n", low, high) is None
    found = s.date_range_query(spark, "d", "1985-08-04T09:00:00.0Z", "2012-01-15T17:54:45.0Z")
    assert (found.low, found.high) == (491994000000, 1326650085000)
    assert s.date_range_query(spark, "d", "nonsense", "2012-01-15T17:54:45.0Z") is None


def test_boolean_builder():
    foo = s.term_query("foo", "bar")
    assert s.boolean_query() is None and s.boolean_query(foo) is None
    assert s.boolean_query(foo, s.MUST).clauses == ((foo, s.MUST),)
    with pytest.raises(ValueError):
        s.boolean_query(foo, "must-shot")


def test_ranges_and_dates_select(spark, teas):
    def found(query):
        return sorted(row["doc_id"] for row in s.matching_ids(teas, query).collect())

    assert found(s.numeric_range_query("weight", 70, 70)) == [0, 1, 2, 3, 4]
    assert found(s.numeric_range_query("price", 10.0, 25.0)) == [1, 2, 4]
    assert found(s.date_range_query(spark, "picked", "2012-02-01T00:00:00Z", "2012-04-01T00:00:00Z")) == [1, 2, 3]
    assert found(s.term_query("grower", "Uva Hills")) == [3]
    assert found(s.term_query("grower", "uva")) == []
    assert found(s.boolean_query(
        s.term_query("fulltext", "tea"), s.MUST, s.term_query("fulltext", "30yo"), s.MUST_NOT)) == [0]
    assert found(s.boolean_query(s.term_query("fulltext", "tea"), s.MUST_NOT)) == []
    nested = s.boolean_query(
        s.boolean_query(s.term_query("fulltext", "assam"), s.SHOULD, s.term_query("fulltext", "ceylon"), s.SHOULD), s.MUST,
        s.numeric_range_query("price", 9.95, 100.0), s.MUST)
    assert found(nested) == [4]


TEXTS = [
    "red tea and green tea", "green tea", "tea green red", "black coffee", "red red red",
    "green leaves of the tea plant", "teapot teacup tease", "", "tea tea tea tea tea tea", "gren teas",
]


def tokens(text):
    return [(at, word) for at, word in enumerate(text.split()) if word not in analysis.STOP_WORDS]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    return text_index(spark, TEXTS, str(tmp_path_factory.mktemp("texts") / "index"))


def norm(count):
    exact = 1 / math.sqrt(count)
    scale = 2.0 ** math.floor(math.log2(exact))
    return math.floor(exact / scale * 4) / 4 * scale


def idf(*words):
    return sum(
        1 + math.log(len(TEXTS) / (1 + sum(word in [w for _, w in tokens(t)] for t in TEXTS))) for word in words
    )


def test_any_word_against_brute_force(texts):
    words = ["red", "tea", "absent"]
    query_norm = 1 / math.sqrt(sum(idf(word) ** 2 for word in words))
    expected = {}
    for doc, text in enumerate(TEXTS):
        counts = Counter(word for _, word in tokens(text))
        matched = [word for word in words if counts[word]]
        if matched:
            total = sum(math.sqrt(counts[w]) * idf(w) ** 2 * norm(sum(counts.values())) for w in matched)
            expected[doc] = total * query_norm * len(matched) / len(words)
    found = dict(hits(s.search_text(texts, "t", " ".join(words), None)))
    assert found == pytest.approx(expected, abs=1e-6)
    best = sorted(expected, key=lambda doc: (-round(expected[doc], 6), doc))[:2]
    assert [doc for doc, _ in hits(s.search_text(texts, "t", " ".join(words), 2))] == best


@pytest.mark.parametrize("phrase", ["green tea", "red red", "leaves of the tea", "tea green red", "coffee tea"])
def test_phrase_against_brute_force(texts, phrase):
    wanted = tokens(phrase)
    start = wanted[0][0]
    expected = {}
    for doc, text in enumerate(TEXTS):
        placed = dict(tokens(text))
        count = sum(
            all(placed.get(at + offset - start) == word for offset, word in wanted) for at in placed
        )
        if count:
            expected[doc] = math.sqrt(count) * idf(*[w for _, w in wanted]) * norm(len(placed))
    found = dict(hits(s.search_text(texts, "t", f'"{phrase}"', None)))
    assert found == pytest.approx(expected, abs=1e-6)


def test_expanding_queries(texts):
    def found(query):
        return sorted(row["doc_id"] for row in s.matching_ids(texts, query).collect())

    assert found(s.Prefix("t", "teac")) == [6]
    assert found(s.Prefix("t", "tea")) == [0, 1, 2, 5, 6, 8, 9]
    assert found(s.Wildcard("t", "t?a")) == [0, 1, 2, 5, 8]
    assert found(s.Wildcard("t", "te*p")) == [6]
    assert found(s.Wildcard("t", "tea")) == [0, 1, 2, 5, 8]
    assert found(s.Fuzzy("t", "green", 1)) == [0, 1, 2, 5, 9]
    assert found(s.TermRange("t", "black", "coffee")) == [3]
    with pytest.raises(ValueError):
        found(s.Wildcard("t", "*ea"))
    assert {score for _, score in hits(s.search(texts, s.Prefix("t", "tea")))} == {1.0}


def test_batch_equals_single_searches(spark, texts):
    asked = [(1, "red tea"), (2, "coffee"), (3, "green green leaves"), (4, "the"), (5, "absent tea")]
    batch = s.search_batch(texts, spark.createDataFrame(asked, "query_id int, text string"), "t", 3)
    found = {}
    for row in batch.orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["doc_id"], row["score"]))
    for query_id, text in asked:
        assert found.get(query_id, []) == hits(s.search_text(texts, "t", text, 3))


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_fuzzy_by_neighbourhoods(spark, tmp_path, monkeypatch):
    """Every term within the distance is found, and no distance is taken of most others."""
    monkeypatch.setattr(fuzzy, "ROWS_PER_FILE", 2000)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    plain = text_index(spark, [" ".join(words[at:at + 5]) for at in range(0, 400, 5)], str(tmp_path / "f"))
    index = fuzzy.with_neighbours(plain)
    known = {row["term"] for row in plain.terms.collect()}
    for edits in (0, 1, 2):
        for value in [*rng.sample(words, 3), "abcabc", "dab", "", "zzzzzzzzz"]:
            expected = {term for term in known if _distance(term, value) <= edits}
            assert {row["term"] for row in fuzzy.close_terms(index, "t", value, edits).collect()} == expected
            assert {row["term"] for row in fuzzy.close_terms(plain, "t", value, edits).collect()} == expected
    text = fuzzy.close_terms(index, "t", "abcabc", 2)._jdf.queryExecution().optimizedPlan().toString()
    lines = text.splitlines()
    filters = [line for line in lines if "levenshtein" in line]
    assert len(filters) == 1 and lines.index(filters[0]) < next(
        at for at, line in enumerate(lines) if "LeftSemi" in line
    ) or "LeftSemi" in text
    found = s.Fuzzy("t", words[0], 1)
    assert sorted(row["doc_id"] for row in s.matching_ids(index, found).collect()) == sorted(
        row["doc_id"] for row in s.matching_ids(plain, found).collect()
    )
    monkeypatch.setattr(s, "CONSTANT_TERMS", 0)
    assert s.matching_ids(index, found).count() == s.matching_ids(plain, found).count() > 0


def test_one_run_per_search(spark, teas):
    """The total comes from the run that selects the hits."""
    result = s.search_text(teas, "fulltext", "tea", 2)
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-search", "", False)
    ranked, total = result._run
    jobs = before.getJobIdsForGroup("one-search")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert total == result.total_hits == result.matched.count() == 5 and ranked.count() == 2
    assert len(jobs) <= 2
    after = s.search_text(teas, "fulltext", "tea", 2, after=(0.408839, 1))
    assert [doc for doc, _ in hits(after)] == [2, 4] and after.total_hits == 5


def _zipf_texts(rng, count):
    """Texts of very different lengths in which a few words are everywhere."""
    vocabulary = [f"w{n}" for n in range(3000)]
    weights = [1 / (n + 1) for n in range(3000)]
    return [
        " ".join(rng.choices(vocabulary, weights, k=rng.choice([5, 20, 60, 200])))
        for _ in range(count)
    ]


def test_batch_scores_few_documents(spark, tmp_path, monkeypatch):
    """The same answers as scoring all pairs that share a word, from a small part of them."""
    monkeypatch.setattr(batch_search, "PART_DOCS", 20)
    rng = random.Random(5)
    corpus = _zipf_texts(rng, 1500)
    index = text_index(spark, corpus, str(tmp_path / "zipf"))
    asked = [(n, " ".join(rng.sample(corpus[n * 7].split(), 5) + ["w0", "w1", "w2"])) for n in range(40)]
    asked += [(100, "w0"), (101, "w0 w0 w1"), (102, "absent"), (103, "the"), (104, "w2999 w2998"), (105, None)]
    found = batch_search.search_batch(
        index, spark.createDataFrame(asked, "query_id int, text string"), "t", 5
    )
    got = {}
    for row in found.hits.collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["doc_id"], row["score"]))
    counts = [Counter(text.split()) for text in corpus]
    in_docs = Counter(word for count in counts for word in count)
    sharing = 0
    for query_id, text in asked:
        uses = Counter((text or "").split())
        idfs = {w: 1 + math.log(len(corpus) / (in_docs[w] + 1)) for w in uses}
        total = math.sqrt(sum(n * idfs[w] ** 2 for w, n in uses.items()))
        scores = []
        for doc, count in enumerate(counts):
            matched = [w for w in uses if count[w]]
            if matched:
                value = sum(uses[w] * math.sqrt(count[w]) * idfs[w] ** 2 for w in matched)
                value *= norm(sum(count.values())) * sum(uses[w] for w in matched)
                scores.append((-round(value / sum(uses.values()) / total, 6), doc))
        sharing += len(scores)
        best = [(at, doc, -score) for at, (score, doc) in enumerate(sorted(scores)[:5], 1)]
        assert [row[:2] for row in sorted(got.get(query_id, []))] == [row[:2] for row in best]
        assert [row[2] for row in sorted(got.get(query_id, []))] == pytest.approx([row[2] for row in best])
    assert found.scored.count() < 0.2 * sharing < found.looked_at.count()


def test_boost(texts):
    plain = dict(hits(s.search(texts, s.boolean_query(s.Term("t", "red"), s.SHOULD, s.Term("t", "green"), s.SHOULD), None)))
    keen = dict(hits(s.search(texts, s.boolean_query(s.Term("t", "red", 4.0), s.SHOULD, s.Term("t", "green"), s.SHOULD), None)))
    assert keen[4] > plain[4] and keen[1] < plain[1]


def test_postings_are_computed_once(spark, tmp_path, monkeypatch):
    """No sampling of the postings; ranges of terms by file, a frequent start in several."""
    from pagelake.operators.index import build_index as build
    rng = random.Random(2)
    corpus = [
        " ".join(rng.choices(["tea", "teapot", "aaa", "zebra", "mmm", f"x{n}"], [30, 5, 4, 3, 2, 1], k=20))
        for n in range(400)
    ]
    rows = spark.createDataFrame(list(enumerate(corpus)), "id bigint, t string")
    fields = [IndexField("t", indexed=True, tokenized=True)]
    monkeypatch.setattr(index_files, "SAMPLE", 4)
    monkeypatch.setattr(index_files, "POSTINGS_PER_FILE", 100)
    index = build(rows, "id", fields)
    plan = index_files._dealt(index.postings, None)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    parts = index_files._dealt(index.postings, None).select(
        F.spark_partition_id().alias("part"), "term", "doc_id"
    ).collect()
    held = {}
    for row in parts:
        held.setdefault(row["term"][:3], set()).add(row["part"])
    assert len(parts) == index.postings.count() and len(held["tea"]) > 1
    # Starts that the sample has not seen may lie anywhere.
    order = sorted(name for name in held if name[0] != "x")
    assert all(max(held[a]) <= min(held[b]) + 1 for a, b in zip(order, order[1:]))
    path = str(tmp_path / "dealt")
    add_documents(rows, "id", fields, path)
    more = spark.createDataFrame([(1000, "tea new"), (1001, "")], "id bigint, t string")
    add_documents(more, "id", fields, path)
    stored = read_index(spark, path)
    assert stored.postings.count() == len(parts) + 2
    assert s.matching(stored, s.Term("t", "new")).count() == 1
    monkeypatch.setattr(index_files, "MOST_PLACES", 0)
    assert index_files._dealt(index.postings, None).count() == len(parts)


def _moved(lists, slop):
    """The same count, going through the places with one pointer a word."""
    at = [0] * len(lists)
    if not all(lists):
        return 0.0
    total = 0.0
    while True:
        now = [places[place] for places, place in zip(lists, at)]
        first = min(range(len(lists)), key=lambda n: (now[n], n))
        others = [now[n] for n in range(len(lists)) if n != first]
        end, nearest, length = max(now), min(others), max(now) - now[first]
        while True:
            at[first] += 1
            if at[first] == len(lists[first]):
                return total + (1 / (1 + length) if length <= slop else 0)
            if lists[first][at[first]] > nearest:
                break
            length = end - lists[first][at[first]]
        total += 1 / (1 + length) if length <= slop else 0


def test_moved_phrases(spark, tmp_path):
    rng = random.Random(21)
    corpus = [" ".join(rng.choice("pqrsu") + "x" for _ in range(rng.randrange(1, 25))) for _ in range(80)]
    index = text_index(spark, corpus, str(tmp_path / "moved"))
    for words, slop in ((["px", "qx"], 1), (["px", "qx"], 4), (["px", "qx", "rx"], 3), (["sx", "px", "ux"], 6)):
        found = {
            row["doc_id"]: row["score"]
            for row in s.matching(index, s.Phrase("t", tuple(words), slop=slop)).collect()
        }
        in_docs = Counter(word for text in corpus for word in set(text.split()))
        idfs = sum(1 + math.log(len(corpus) / (in_docs[word] + 1)) for word in words)
        expected = {}
        for doc, text in enumerate(corpus):
            tokens_of = text.split()
            lists = [[at - n for at, w in enumerate(tokens_of) if w == word] for n, word in enumerate(words)]
            count = _moved(lists, slop)
            if count:
                expected[doc] = round(math.sqrt(count) * idfs * norm(len(tokens_of)), 6)
        assert found == pytest.approx(expected, abs=2e-6) and expected


def test_query_texts(spark, tmp_path):
    index = text_index(spark, ["red tea pot", "green cup red", "tea green", "red tea green cup"], str(tmp_path / "texts"))

    def found(text):
        result = s.search_text(index, "t", text, None)
        return None if result is None else sorted(row["doc_id"] for row in result.matched.collect())

    assert found('"red tea" "green cup"') == [0, 1, 3]
    assert found('pot "green cup"') == [0, 1, 3]
    assert found("red NOT tea") == [1] and found("red -tea") == [1]
    assert found("+red +green") == [1, 3] and found("red AND green") == [1, 3]
    assert found("pot OR (green AND cup)") == [0, 1, 3]
    assert found("+t:tea -(pot OR cup)") == [2]
    assert found("gr*") == [1, 2, 3] and found("te?") == [0, 2, 3] and found("gren~1") == [1, 2, 3]
    assert found("[green TO pot]") == [0, 1, 2, 3] and found("other:red") == []
    assert found("{cup TO red}") == [0, 1, 2, 3] and found("{pot TO red}") == [] and found("[pot TO red}") == [0]
    assert found("{cup TO pot]") == [0, 1, 2, 3] and found("[pot TO *]") == [0, 1, 2, 3]
    assert found("{red TO *]") == [0, 2, 3] and found("[* TO cup]") == [1, 3] and found("{* TO cup}") == []
    assert found('"red green"~1') == [3] and found('"red green"') == [] and found('"green red"~1') == [1]
    assert found('"green red"~2') == [1] and found('"tea cup"~1') == [3] and found('"green red"~4') == [1, 3]
    assert found('"tea pot"~0') == [0] and found("tew~0.5") == [0, 2, 3] and found("tea~0.9") == [0, 2, 3]
    assert found(r"re\d") == [0, 1, 3] and found(r"\(red\)") == [0, 1, 3] and found(r"t\:tea") == []
    assert found(r"te\*") == [] and found(r"te\**") == [] and found(r'"red \"tea\""') == [0, 3]
    assert found("the") == [] and found("*ea") == []
    for text in ('"red tea"~x', '"red red"~2', "[a TO", "{a TO b", "a~b", "a~1.5", "te*~", "red\\", "{a}", "]", '"red', "(red", "red)", "AND red", "red AND", "red [a b]", "+", "red ^", "a: "):
        assert found(text) is None, text
    plain, keen = (dict(hits(s.search_text(index, "t", t, None))) for t in ("pot cup", "pot^4 cup"))
    assert keen[0] / keen[1] > plain[0] / plain[1]
