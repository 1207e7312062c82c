"""The pipeline's stages, one after the other, against brute force."""

import collections
import random

import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
import text_cases
from test_text_operators import _check_packing, _covered, _kept, _roots, _simhash, _without_frequent
from pagelake.llm import packing

#: Stands for a missing doc_id, which comes last among near copies.
LAST = 10**9

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("component_id", T.StringType()),
])


def _documents():
    rng = random.Random(13)
    say = lambda n: text_cases.sentence(rng, n)
    passage = say(70)
    texts = [say(rng.randrange(60, 160)) for _ in range(25)]
    near = [texts[n].split() for n in (1, 2, 3)]
    for n, found in enumerate(near):
        found[20] = f"other{n}"
    texts += [" ".join(found) for found in near]
    texts += [texts[4], texts[5].upper(), None, "", "short", "loop a b " * 60]
    texts += [say(70) + " " + passage + " " + say(30 + n) for n in range(4)]
    texts += [f"{say(60)}\n The Licence \n{say(10)}\n\n{say(20)}" for _ in range(11)]
    texts += [say(3000)]
    rows = [(n, t, "en", "s", None if t is None else len(t), "x") for n, t in enumerate(texts)]
    return rows + [rows[7], (None, say(90), None, None, 5, None)]


def _expected(docs):
    """(doc_id, text) after each of the first four stages."""
    def good(text):
        found = text_cases.words(text)
        if len(found) < 50 or 100 * len(_covered(found, 3)) > 50 * len(found):
            return False
        return len(_covered(found, 10)) <= 0.3 * len(found) and not _covered(found, 101)
    kept = [(key, text) for key, text in docs if good(text)]
    yield kept
    kept = [(key, text) for key, text, *_ in _without_frequent(kept, 10)]
    yield kept
    order = {(LAST if key is None else key): text for key, text in kept}
    prints = {key: _simhash(text, 3) for key, text in order.items()}
    edges = [(a, b) for a in order for b in order
             if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    roots = _roots(order, edges)
    kept = [(None if key == LAST else key, text) for key, text in order.items() if roots[key] == key]
    yield kept
    texts = {(-1 if key is None else key): text for key, text in kept}
    yield [
        (key, words if gone else texts[-1 if key is None else key])
        for key, _, gone, words in _kept(kept, 20)
    ]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(_documents(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_every_stage(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = list(_expected([(row[0], row[1]) for row in _documents()]))
    sizes = [len(rows) for rows in expected]
    assert sizes[0] < len(_documents()) and sizes[2] < sizes[1]
    for number, ((name, stage), rows) in enumerate(zip(corpus_pipeline.STAGES, expected)):
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns, name
        found.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        got = docs.select("doc_id", "text", "n_chars").collect()
        assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted(rows, key=repr), name
        if number in (1, 3):
            assert all(r[2] == len(r[1]) for r in got)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    _check_packing(pieces, packing.Capacities(2048, 2048, 2048**2))
    lengths = collections.Counter()
    for piece in pieces:
        lengths[piece.doc_id] += piece.length
    assert lengths == {
        key: len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        for key, text in expected[3]
    }


def test_keys_are_no_texts(spark):
    """Rows with one doc_id, or none, go through the stages by their texts."""
    rng = random.Random(29)
    a, b, c, d, e = (text_cases.sentence(rng, 100) for _ in range(5))
    shared = text_cases.sentence(rng, 40)
    docs = [
        (None, a), (None, b), (None, b), (None, c), (7, d), (7, e), (7, e.upper()), (8, e),
        (9, shared + " " + text_cases.sentence(rng, 60)), (None, shared + " " + a),
        (9, text_cases.sentence(rng, 100)),
    ]
    frame = spark.createDataFrame([(k, t, "en", "s", 1, "x") for k, t in docs], SCHEMA)
    found = corpus_pipeline.near_duplicates(spark, frame.repartition(3), "").collect()
    texts = [row.text.lower() for row in found]
    assert sorted(texts) == sorted({text.lower() for _, text in docs})
    kept = spark.createDataFrame(found, SCHEMA).repartition(3)
    left = corpus_pipeline.shared_passages(spark, kept, "").collect()
    assert len(left) == len(found)
    words = collections.Counter(word for row in left for word in row.text.lower().split())
    expected = {word for text in texts for word in text.split()}
    # Every passage is still there, once.
    assert set(words) == expected
    assert sum(len(row.text.split()) for row in left) == sum(map(len, map(str.split, {a, b, c, d, e}))) + 40 + 60 + 100


def test_whole_run(spark, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    expected = list(_expected([(row[0], row[1]) for row in _documents()]))[3]
    assert {row.doc_id for row in found} == {key for key, _ in expected}


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []
