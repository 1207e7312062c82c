"""Each text operator against a brute-force version, on awkward documents."""

import collections
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import text_cases
from pagelake.llm import (
    bpe, debruijn, hamming, language, line_dedup, packing, repetition, simhash, url_filter,
)


def collected(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# --- line dedup ---------------------------------------------------------------------------

def _lines(text):
    return (text or "").split("\n")


def _key(line):
    stripped = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in stripped)


def _without_frequent(docs, least):
    counts = collections.Counter(
        key for _, text in docs for key in {_key(line) for line in _lines(text)} if key
    )
    out = []
    for doc_id, text in docs:
        kept = [line for line in _lines(text) if counts[_key(line)] < least]
        lines = _lines(text)
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_frequent_lines_go(awkward):
    docs = [(row[0], row[1]) for row in text_cases.rows()]
    found = line_dedup.drop_frequent_lines(awkward, min_docs=10)
    assert found.columns[:len(awkward.columns)] == awkward.columns
    got = collected(found.select("doc_id", "line_kept", "line_counts.*"))
    assert got == _without_frequent(docs, 10)
    assert any(row[3] for row in got)


def test_many_lines_in_one_document(spark):
    """The time grows with the lines, not with their square."""
    lines = [f"line {n}" for n in range(40_000)]
    docs = [(0, "\n".join(lines + ["shared"]))] + [(n, "shared") for n in range(1, 12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    began = time.monotonic()
    found = collected(
        line_dedup.drop_frequent_lines(frame, 10).select("doc_id", "line_kept", "line_counts.*")
    )
    assert time.monotonic() - began < 60
    assert found == _without_frequent(docs, 10)


def test_runs_settle_and_compact(spark):
    runs = line_dedup.LineRuns(spark, min_docs=4)
    batches = [[(1, 1), (2, 2)], [(1, 3), (3, 1)], [(3, 1), (4, 9)], [(1, 5), (2, 1)],
               [(2, 1), (3, 2)]]
    for batch in batches:
        runs.add(spark.createDataFrame([(h, h, n) for h, n in batch], "h1 long, h2 long, n long"))
    assert len(runs.settled) == 1 and len(runs.levels[1]) == 1
    # 1 and 4 settled at the first compaction; 2 and 3 reach the limit over two levels.
    assert [row[0] for row in collected(runs.frequent())] == [1, 2, 3, 4]
    settled = {row.h1 for row in runs.done.read(runs.settled).collect()}
    assert settled == {1, 4}
    assert all(row.h1 not in settled for row in runs.open.read(runs.levels[0]).collect())
    runs.close()


def test_runs_are_merged_where_they_lie(spark):
    """Neither the anti-join of a batch nor a compaction shuffles the runs."""
    runs = line_dedup.LineRuns(spark, min_docs=3, buckets=4)
    rng = random.Random(1)
    for _ in range(4):
        rows = [(rng.randrange(50), 0, 1) for _ in range(20)]
        runs.add(spark.createDataFrame(sorted(set(rows)), "h1 long, h2 long, n long"))
    assert len(runs.settled) == 1 and len(runs.levels[0]) == len(runs.levels[1]) == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        batch = runs.open.read(runs.levels[0])
        plans = [runs.below(batch), runs.merged(runs.levels[0] + runs.levels[1])]
        texts = [plan._jdf.queryExecution().executedPlan().toString() for plan in plans]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for text in texts:
        assert "SortMergeJoin" in text and "Exchange" not in text
    runs.close()


def test_runs_are_kept_between_calls(spark):
    """Documents that come later complete what earlier ones began."""
    rng = random.Random(3)
    docs = [(n, "\n".join(f"line {rng.randrange(40)}" for _ in range(6))) for n in range(60)]
    runs = line_dedup.LineRuns(spark, min_docs=8)
    seen = []
    for first in range(0, 60, 20):
        part = docs[first:first + 20]
        frame = spark.createDataFrame(part, "doc_id long, text string")
        found = line_dedup.drop_frequent_lines(frame, 8, runs=runs)
        got = {row.doc_id: row.line_kept for row in found.collect()}
        seen += part
        expected = {row[0]: row[1] for row in _without_frequent(seen, 8)}
        assert got == {key: expected[key] for key, _ in part}
    assert runs.settled and sum(map(len, runs.levels)) > 1
    runs.close()


def test_lines_of_no_documents(no_docs):
    assert line_dedup.drop_frequent_lines(no_docs, min_docs=10).collect() == []


# --- quality rules ------------------------------------------------------------------------

def _covered(found, size):
    counts = collections.Counter(tuple(found[a:a + size]) for a in range(len(found) - size + 1))
    return {
        at + step for at in range(len(found) - size + 1)
        if counts[tuple(found[at:at + size])] > 1 for step in range(size)
    }


def test_repetition_by_suffix_array():
    rng = random.Random(3)
    texts = [t for t in text_cases.texts()]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    got = repetition._measured(texts, 4)
    for text, row in zip(texts, got.tolist()):
        found = text_cases.words(text)
        longest = 0
        if len(found) < 500:
            while _covered(found, longest + 1):
                longest += 1
        else:
            longest = row[4]
        assert row[0] == len(found)
        assert row[1] == len(_covered(found, 3))
        assert row[3] == len(_covered(found, 4))
        assert row[4] == (longest if longest >= 4 else 0)


def test_maximal_repeats_are_counted():
    # "a b c d" occurs twice with other neighbours; its parts occur no more often.
    row = repetition._measured(["x a b c d y a b c d z"], 2)[0].tolist()
    assert row[2:] == [1, 8, 4]


def test_quality_verdicts(awkward, no_docs):
    judged = repetition.judge_quality(awkward)
    verdict = {row.text: row._quality for row in judged.select("text", "_quality").collect()}
    assert not verdict[None].kept and verdict[None].base_failed
    assert not verdict["x " * 400].kept
    assert verdict[text_cases.texts()[10]].kept
    # A repeated passage of sixty words covers a good half.
    assert not verdict[text_cases.texts()[13]].kept
    assert repetition.judge_quality(no_docs).collect() == []


# --- SimHash ------------------------------------------------------------------------------

def _simhash(text, width):
    found = [w.lower() for w in text_cases.words(text)]
    runs = [b" ".join(found[a:a + width]) for a in range(max(1, len(found) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(run, 42) for run in runs] if found else []
    return sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def _roots(nodes, edges):
    root = {node: node for node in nodes}

    def find(node):
        while root[node] != node:
            node = root[node]
        return node
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {node: find(node) for node in nodes}


def test_near_duplicates(awkward, no_docs):
    docs = [(row[0], row[1]) for row in text_cases.rows() if row[0] is not None]
    prints = {doc: _simhash(text, 3) for doc, text in docs}
    edges = [(a, b) for a in prints for b in prints
             if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = _roots(prints, edges)
    found = simhash.near_duplicates(awkward.where("doc_id IS NOT NULL"))
    got = {(row.doc_id, row.fingerprint % (1 << 64), row.component_id) for row in found.collect()}
    assert got == {(doc, prints[doc], roots[doc]) for doc in prints}
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("radius", [3, 2])
def test_links_lose_nothing(spark, radius):
    rng = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(8):
            flips = sum(1 << bit for bit in rng.sample(range(64), rng.randrange(1, 5)))
            prints.add(base ^ flips)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    expected = [
        (a, b) for a in signed for b in signed
        if a < b and ((a ^ b) % (1 << 64)).bit_count() <= radius
    ]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    assert collected(simhash.links(frame, radius)) == sorted(expected, key=repr)
    grouped = simhash.components(spark.createDataFrame(expected, "a long, b long")).collect()
    roots = _roots({x for edge in expected for x in edge}, expected)
    classes = collections.defaultdict(set)
    for row in grouped:
        classes[row.root].add(roots[row.node])
    assert len(grouped) == len(roots) and all(len(c) == 1 for c in classes.values())
    assert len(classes) == len(set(roots.values()))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(n, n + 1) for n in range(200)], "a long, b long")
    found = simhash.components(edges).collect()
    assert len(found) == 201 and len({row.root for row in found}) == 1


def test_one_of_each_component(spark, awkward, no_docs):
    found = simhash.one_of_each(awkward, width=3)
    assert found.columns == awkward.columns
    texts = {row[0]: row[1] for row in text_cases.rows()}
    prints = {key: _simhash(text, 3) for key, text in texts.items()}
    last = 10**9
    nodes = {last if key is None else key: fp for key, fp in prints.items()}
    edges = [(a, b) for a in nodes for b in nodes
             if a < b and bin(nodes[a] ^ nodes[b]).count("1") <= 3]
    roots = _roots(nodes, edges)
    stays = {None if key == last else key for key in nodes if roots[key] == key}
    assert sorted((row.doc_id for row in found.collect()), key=repr) == sorted(stays, key=repr)
    assert simhash.one_of_each(no_docs).collect() == []


def test_one_of_each_of_rows_with_one_key(spark):
    rng = random.Random(29)
    a, b, c = (text_cases.sentence(rng, 100) for _ in range(3))
    docs = [(None, a), (None, b), (None, b), (1, a.upper()), (7, b), (7, c), (7, c), (8, c)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = [(row.doc_id, row.text) for row in simhash.one_of_each(frame).collect()]
    assert sorted(found) == sorted([(1, a.upper()), (7, b), (7, c)])


# --- substring dedup ----------------------------------------------------------------------

def _kept(docs, window):
    """Brute force; a null key comes first, a repeated row is the same place."""
    pairs = [(-1 if key is None else key, text_cases.words(text)) for key, text in docs]
    first = text_cases.first_places(pairs, window)
    out = []
    for (key, _), (place, found) in zip(docs, pairs):
        gone = {
            at + step for at in range(len(found) - window + 1)
            if first[tuple(found[at:at + window])] < (place, at) for step in range(window)
        }
        kept = b" ".join(w for at, w in enumerate(found) if at not in gone)
        out.append((key, len(found), len(gone), kept.decode()))
    return sorted(out, key=repr)


def test_repeated_passages_go(awkward, no_docs):
    docs = [(row[0], row[1]) for row in text_cases.rows()]
    found = debruijn.remove_repeats(awkward)
    assert collected(found.select("doc_id", "repeats.*")) == _kept(docs, 20)
    assert debruijn.remove_repeats(no_docs).collect() == []


def _ordered_by_hash(spark, docs):
    """Rows as debruijn orders them: by key, a missing one first, then by hashes of the text."""
    frame = spark.createDataFrame(docs, "doc_id long, text string").distinct()
    own = debruijn.identified(F.col("doc_id"), F.col("text"))
    return [tuple(row) for row in frame.orderBy(*own).collect()]


def test_passages_of_rows_with_one_key(spark):
    """Different texts with one key, or none, are documents of their own."""
    rng = random.Random(31)
    a, u, p, q = (text_cases.sentence(rng, 40) for _ in range(4))
    thirty = " ".join(p.split()[:30])
    tail = text_cases.sentence(rng, 25)
    docs = [
        (1, a), (5, a), (5, u), (5, u), (None, p), (None, p + " " + q),
        (3, thirty + " x " + tail), (4, "y " + thirty), (6, "A\tone " + q), (6, q + "  A one"),
    ]
    found = debruijn.remove_repeats(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    )
    got = {(row.doc_id, row.text): row.repeats for row in found.collect()}
    order = _ordered_by_hash(spark, docs)
    expected = _kept([(n, text) for n, (_, text) in enumerate(order)], 20)
    for (n, n_words, n_removed, kept), row in zip(sorted(expected), order):
        assert tuple(got[row]) == (n_words, n_removed, kept), row
    assert got[5, u].n_removed == 0 and got[5, a].n_removed == 40
    assert got[3, thirty + " x " + tail].n_removed == got[4, "y " + thirty].n_removed == 30


def test_branching_passages(spark):
    """Few words and a short window: many branches, loops and overlaps."""
    rng = random.Random(11)
    docs = [
        (n, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for n in range(40)
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = debruijn.remove_repeats(frame, window=4)
    assert collected(found.select("doc_id", "repeats.*")) == _kept(docs, 4)


# --- packing ------------------------------------------------------------------------------

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_ids_of_pieces(awkward):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    pieces = packing.token_pieces(awkward, BYTE_BPE, 256, ranks_path=RANKS, with_ids=True)
    by_doc = collections.defaultdict(list)
    for row in pieces.collect():
        by_doc[row.doc_id].append(row)
    for doc_id, text, *_ in text_cases.rows():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        rows = sorted(by_doc[doc_id], key=lambda row: row.piece)[:len(packing.cut_lengths(len(ids), 256))]
        if doc_id != 6:  # a repeated row: two of each piece
            assert [i for row in rows for i in row.ids] == ids
        for row in by_doc[doc_id]:
            assert list(row.ids) == ids[row.start:row.start + row.length]


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a   b\n  c", "x\n y", "\n\n z  ", "it's  'll", "\u00a0 a"])
def test_words_cut_at_blanks_give_the_same_ids(text):
    whole = Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.token_bytes(BYTE_BPE, RANKS, text), "<u4").tolist() == whole


def _check_packing(rows, limits):
    by_sequence = collections.defaultdict(list)
    for row in rows:
        by_sequence[row.sequence_id].append(row)
    for found in by_sequence.values():
        found.sort(key=lambda row: row.offset)
        at = 0
        for row in found:
            assert row.offset == at
            at += row.length
        assert at <= limits.tokens and len(found) <= limits.documents
        assert sum(row.length**2 for row in found) <= limits.cost
    return len(by_sequence)


@pytest.mark.parametrize("limits", [
    packing.Capacities(100, 100, 10_000), packing.Capacities(100, 3, 10_000),
    packing.Capacities(100, 10, 10_000, rule="dot"),
    packing.Capacities(100, 10, 10_000, weights=(1.0, 0.2, 0.5)),
])
def test_packing_holds_every_capacity(spark, limits):
    rng = random.Random(2)
    rows = [(n % 900, n // 900, 0, rng.choice([1, 3, 7, 20, 33, 34, 50, 66, 80, 100]), n)
            for n in range(1000)]
    pieces = spark.createDataFrame(
        rows, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    found = packing.pack(pieces, limits).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in found) == sorted(
        (r[0], r[1], r[3]) for r in rows
    )
    used = _check_packing(found, limits)
    if limits.documents == 100:
        assert used <= 1.01 * sum(row[3] for row in rows) / 100 + 1


def test_packing_of_documents(awkward, no_docs):
    found = packing.pack_documents(awkward, BYTE_BPE, 512, ranks_path=RANKS).collect()
    _check_packing(found, packing.Capacities(512, 512, 512 * 512))
    assert packing.pack_documents(no_docs, BYTE_BPE, 512).collect() == []


# --- encoding -----------------------------------------------------------------------------

@pytest.mark.parametrize("leaf_chars", [bpe.LEAF_CHARS, 700])
def test_encoding_is_the_librarys(awkward, no_docs, leaf_chars):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    found = bpe.encode_documents(awkward, WORD_BPE, leaf_chars=leaf_chars)
    rows = found.select("doc_id", "text", "_bpe").collect()
    assert len(rows) == len(text_cases.rows())
    for _, text, result in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert list(result.ids) == ids
        assert result.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(no_docs, WORD_BPE).collect() == []


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_concatenation_of_any_cut(path):
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(4)
    alphabet = ["ab", "the", "ing", "'s", "'", "é", "e\u0301", "9", " ", "<|endoftext|>", "日本", "aa"]
    for size in (40, 300, 1500):
        for _ in range(12):
            letters = rng.sample(alphabet, 4)
            text = "".join(rng.choice(letters) for _ in range(size))
            cut = rng.randrange(len(text) + 1)
            parts = [bpe.Encoding.of(tokenizer, part) for part in (text[:cut], text[cut:])]
            found = bpe.concatenate(tokenizer, *parts).ids.tolist()
            assert found == tokenizer.encode(text, add_special_tokens=False).ids


def test_windows_stay_small(monkeypatch):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(4)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(40_000))
    parts = [bpe.Encoding.of(tokenizer, part) for part in (text[:20_000], text[20_000:])]
    seen = []
    encode = bpe.Encoding.of.__func__
    monkeypatch.setattr(bpe.Encoding, "of", classmethod(
        lambda cls, tok, part: seen.append(len(part)) or encode(cls, tok, part)
    ))
    found = bpe.concatenate(tokenizer, *parts).ids.tolist()
    assert max(seen) < 4000
    monkeypatch.undo()
    assert found == tokenizer.encode(text, add_special_tokens=False).ids


# --- languages ----------------------------------------------------------------------------

def test_languages(spark, no_docs):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "ro", "ti"], "bb": ["schu", "gen", "ver"], "cc": ["oux", "eau", "lé"]}

    def text(lang, size):
        return " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(size))
    train = [(text(lang, 60), lang) for lang in syllables for _ in range(20)]
    train += [(None, "aa"), ("no language", None)]
    model = language.LanguageModel.fit(spark.createDataFrame(train, "text string, lang string"))
    assert model.langs == ["aa", "bb", "cc"]
    mixed = text("aa", 60) + " " + text("bb", 30)
    asked = [text("cc", 4), mixed, None, "", "1234 !!", text("bb", 3000)]
    found = [
        row.m for row in spark.createDataFrame(enumerate(asked), "n int, text string")
        .select("n", model.predict(F.col("text")).alias("m")).orderBy("n").collect()
    ]
    assert found[0].lang == "cc" and found[0].langs == ["cc"]
    assert found[1].lang == "aa" and found[1].langs == ["aa", "bb"]
    assert abs(found[1].score - 2 / 3) < 0.05
    assert [f.lang for f in found[2:5]] == ["und"] * 3 and found[2].score == 0
    assert found[5].lang == "bb" and found[5].score == 1.0
    empty = language.LanguageModel.fit(no_docs)
    assert empty.langs == []
    frame = spark.createDataFrame([("some text",)], "text string")
    assert frame.select(empty.predict(F.col("text")).alias("m")).first().m.lang == "und"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    model = language.LanguageModel.fit(docs.where(~fold))
    right = docs.where(fold).select(
        (model.predict(F.col("text"))["lang"] == F.col("lang")).cast("int").alias("right")
    ).agg(F.avg("right")).first()[0]
    assert right >= 0.97


# --- URLs ---------------------------------------------------------------------------------

def test_rules_and_parts(spark):
    urls = [
        "http://A.org/x", "https://sub.Example.ORG/es/1", "http://example.org/en/12#z",
        "http://example.org/en/2", "x://net.com/fr/", "http://com/de/", "http://com?/de/",
        None, "no scheme", "http://org", "a://b://org/", "",
    ]
    frame = spark.createDataFrame([(n, u, "x") for n, u in enumerate(urls)],
                                  "page_id int, url string, place string")
    rows = url_filter.judge_urls(frame).orderBy("page_id").collect()
    found = [row.url_verdict for row in rows]
    assert [(f.host, f.path) for f in found[:3]] == [
        ("a.org", "/x"), ("sub.example.org", "/es/1"), ("example.org", "/en/12")]
    assert [f.rule for f in found] == [
        "org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None,
        None, None, None, None, None]
    assert [f.verdict for f in found[:6]] == ["allow", "block", "block", "allow", "allow", "block"]
    assert (found[7].host, found[7].path, found[8].host) == ("", "", "")
    assert (found[6].host, found[6].path) == ("com", "") and found[10].host == "b:"
    assert all(f.verdict in ("allow", "block") for f in found)


def _brute_scores(accepted, rejected, order, places):
    logs = []
    for known in (accepted, rejected):
        counts = [collections.Counter() for _ in range(order + 1)]
        for place in known:
            padded = "^" * order + place + "$"
            for at in range(len(place) + 1):
                for k in range(order + 1):
                    counts[k][padded[at + order - k:at + order + 1]] += 1

        def log(gram, counts=counts):
            p = 1 / url_filter.ALPHABET
            for k in range(order + 1):
                part = gram[order - k:]
                total = sum(n for g, n in counts[k].items() if g[:-1] == part[:-1])
                p = (counts[k][part] + url_filter.WEIGHT * p) / (total + url_filter.WEIGHT)
            return np.log(p)
        logs.append(log)
    out = {}
    for place in places:
        padded = "^" * order + place + "$"
        grams = [padded[at:at + order + 1] for at in range(len(place) + 1)]
        out[place] = np.mean([logs[0](g) - logs[1](g) for g in grams])
    return out


def test_url_scores_and_cut(spark):
    rng = random.Random(9)
    urls = [f"http://{rng.choice(['good', 'fine'])}{n}.org/a/{n}" for n in range(40)]
    urls += [f"http://{rng.choice(['spam', 'pill'])}{n}.com/de/{n}" for n in range(40)]
    urls += [f"http://{name}{n}.net/z/{n}" for n in range(5) for name in ("good", "spam", "ä")]
    frame = spark.createDataFrame([(u,) for u in urls + urls[:3]], "url string")
    rows = [row.url_verdict for row in url_filter.judge_urls(frame).collect()]
    assert len(rows) == len(urls) + 3
    by_place = {row.host + row.path: row for row in rows}
    fit = {p: r for p, r in by_place.items() if r.rule and int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % 5}
    expected = _brute_scores(
        [p for p, r in fit.items() if r.verdict == "allow"],
        [p for p, r in fit.items() if r.verdict == "block"], url_filter.ORDER, by_place,
    )
    for place, row in by_place.items():
        assert row.score == pytest.approx(expected[place], abs=1e-8)
        if place.startswith(("good", "spam")):
            assert row.verdict == ("allow" if place.startswith("good") else "block")


# --- nearest codes ------------------------------------------------------------------------

def _one_word(frame):
    """Codes as arrays of one word."""
    return frame.withColumn("code", F.when(F.col("code").isNotNull(), F.array("code")))


@pytest.mark.parametrize("segments", [4, 8])
def test_top_k(spark, segments):
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    codes = [centre ^ (1 << rng.randrange(64)) for _ in range(40)]
    codes += [rng.getrandbits(64) for _ in range(160)] + [centre] * 30
    rows = [(n, code - (1 << 64) if code >> 63 else code) for n, code in enumerate(codes)]
    rows += [rows[5], (None, rows[0][1]), (900, None)]
    frame = _one_word(spark.createDataFrame(rows, "id long, code long"))
    queries = [row for row in rows if row[0] is not None and row[0] % 50 == 0]
    expected = []
    for query, code in queries:
        if code is None:
            continue
        near = sorted(
            (((code ^ other) % (1 << 64)).bit_count(), -1 if other_id is None else other_id)
            for other_id, other in rows if other is not None
        )[:7]
        expected += [
            (query, rank + 1, None if near_id < 0 else near_id, distance)
            for rank, (distance, near_id) in enumerate(near)
        ]
    asked = _one_word(spark.createDataFrame(queries, "id long, code long"))
    found = hamming.top_k(frame, asked, 7, segments=segments)
    assert collected(found) == sorted(expected, key=repr)


def test_fewer_rows_than_k(spark):
    frame = _one_word(spark.createDataFrame([(1, 0), (2, -1)], "id long, code long"))
    assert collected(hamming.top_k(frame, frame, 5)) == [
        (1, 1, 1, 0), (1, 2, 2, 64), (2, 1, 2, 0), (2, 2, 1, 64)]
    nothing = frame.where("id > 5")
    assert hamming.top_k(nothing, nothing, 5).collect() == []
    assert hamming.top_k(nothing, frame, 5).collect() == []


def test_codes_of_vectors(spark):
    frame = spark.createDataFrame(
        [([1.0, -1.0, 0.0, 2.0],), (None,), ([1.0] * 65,), ([],), ([None, 1.0] + [-1.0] * 62,)], "v array<double>"
    )
    assert [row[0] for row in frame.select(hamming.sign_code(F.col("v"))).collect()] == [
        [9 << 60 | -(1 << 63)], None, [-1, -(1 << 63)], [0], [1 << 62]]


@pytest.mark.parametrize("size", [96, 128])
def test_top_k_of_long_vectors(spark, size):
    """Codes of two words, some vectors shorter; nothing is left out."""
    rng = random.Random(size)
    centre = [rng.choice([-1.0, 1.0]) for _ in range(size)]
    vectors = [[-x if rng.random() < rng.choice([0.05, 0.5]) else x for x in centre] for _ in range(150)]
    vectors += [centre, centre[:64], centre[:30], [], None]
    frame = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>")
    codes = frame.select("id", hamming.sign_code(F.col("v")).alias("code"))
    asked = [0, 50, 150, 151, 153, 154]
    found = hamming.top_k(codes, codes.where(F.col("id").isin(asked)), 6)

    def positive(vector):
        return {at for at, x in enumerate(vector) if x > 0}
    expected = []
    for query in asked[:-1]:
        near = sorted(
            (len(positive(vectors[query]) ^ positive(vector)), at)
            for at, vector in enumerate(vectors) if vector is not None
        )[:6]
        expected += [(query, rank, at, distance) for rank, (distance, at) in enumerate(near, 1)]
    assert collected(found) == sorted(expected, key=repr)


# --- main text ----------------------------------------------------------------------------

def test_main_text_of_pages():
    from pagelake.llm.main_text import main_text

    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
    <header class=top>Site name <nav><ul><li><a href=/>Home</a><li><a>News</a></ul></nav></header>
    <div id="cookie-notice">We use cookies on this site to make it better for everyone.</div>
    <aside class="sidebar"><p>Popular stories that many people have read this week, a long list.</aside>
    <main><article><header><h1>The  title</h1></header>
    <p>First paragraph with <b>bold</b>&nbsp;text &amp; an <a href=x>inline link</a>, long enough.
    <p>Short.</p><ul><li>One</li><li>Two</li></ul><div class="ad">Buy now, a very good product!</div>
    <script>var x = "</p>";</script><form><label>Mail</label><input></form>
    <table><tr><td>Cell</td><td>Other</td></tr></table>
    <p>The last paragraph is here.<br>Second line.</p></article>
    <section class="comments"><article class="comment"><p>I like this article very much indeed!</p>
    </article></section></main><footer>&copy; 2020 all rights reserved</footer></body></html>"""
    assert main_text(page) == (
        "The title First paragraph with bold text & an inline link, long enough. Short. One Two "
        "Cell Other The last paragraph is here. Second line."
    )
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("plain words only") == "plain words only"
    unclosed = "<nav><ul><li><a>Home</a><article><h1>H</h1><p>One<p>Two</article><footer>f</footer>"
    assert main_text(unclosed) == "H One Two"


def test_main_text_without_article_element():
    from pagelake.llm.main_text import main_text

    body = "".join(f"<p>{'A sentence of the story with enough words. ' * 4}{n}</p>" for n in range(4))
    links = "".join(f"<li><a href=/{n}>Link number {n}</a></li>" for n in range(12))
    page = f"<body><ul>{links}</ul><div><h2>Headline</h2>{body}</div><ul>{links}</ul></body>"
    found = main_text(page)
    assert found.startswith("Headline A sentence") and found.endswith(" 3") and "Link" not in found


def test_articles_of_the_given_pages(spark):
    """The given pages hold their text in an article element."""
    import html
    import re

    from pagelake.llm.main_text import extract_main_text

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in pages.select("html", extract_main_text(F.col("html")).alias("text")).collect():
        article = re.search(r"(?s)<article>(.*?)(</article>|$)", row.html)[1]
        blocks = re.split(r"</?(?:h1|p|br)\b[^>]*>", article)
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert row.text == " ".join(b for b in plain if b)


def test_passages_are_compacted(spark):
    """A passage in three texts is one path, and a branch splits it."""
    rng = random.Random(17)
    passage = text_cases.sentence(rng, 200)
    head, tail = passage.split()[:90], passage.split()[90:]
    docs = [(n, f"{text_cases.sentence(rng, 40)} {passage} {text_cases.sentence(rng, 40)}") for n in range(3)]
    docs += [(9, " ".join(head) + " " + text_cases.sentence(rng, 30))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = frame.select(*debruijn.identified(F.col("doc_id"), F.col("text")), "text")
    sequences = rows.select(*debruijn.IDENTITY, F.lit(300).cast("bigint").alias("n"))
    places = debruijn.Places(sequences)
    nothing = rows.select(*debruijn.IDENTITY).limit(0)
    edges = debruijn.repeated_edges(debruijn.candidate_windows(rows, nothing, places, 20))
    found = [(row.size, places) for row in debruijn.paths(edges, places, 20).collect()]
    # 71 windows of the head; 110 of the rest, the first 19 of which overlap it.
    assert sorted(size for size, _ in found) == [90, 129]
    assert edges.count() == 181


def test_short_blocks_of_a_region_without_article_stay():
    from pagelake.llm.main_text import main_text

    long = [f"<p>{'words of a long paragraph ' * 30}</p>"] * 6
    blocks = ["<p>By A. Writer</p>", *long, "<ul><li><a href=s>A source</a></li></ul>", *long,
              "<p>The end.</p>", "<p>One more.</p>", "<p>Last.</p>"]
    page = f"<html><body><nav><a href=m>Menu</a></nav><div>{''.join(blocks)}</div></body></html>"
    found = main_text(page)
    assert found.startswith("By A. Writer words") and "A source" in found
    assert found.endswith("The end. One more. Last.") and "Menu" not in found


def _renamed(page):
    """A page whose elements do not say what they hold."""
    import re
    return re.sub(r"<(/?)(article|main|nav|aside|footer|header)\b", r"<\1div", page)


def test_the_clustering_selects(monkeypatch):
    """Without names the given articles are found, and each part of the method is needed."""
    import pyarrow.parquet as pq

    from pagelake.llm import main_text

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    articles = [main_text.main_text(page) for page in pages]

    def wrong():
        return sum(
            main_text.main_text(_renamed(page), prior=False) != article
            for page, article in zip(pages, articles)
        )
    assert wrong() <= 2
    for name, without in (
        ("smooth", lambda ratios, sigma=0: ratios), ("content_threshold", lambda smoothed: 0.0),
        ("text_tag_ratios", lambda lines: np.array([1.0] * len(lines))),
        ("_narrowed", lambda region, chosen: region),
    ):
        with monkeypatch.context() as patch:
            patch.setattr(main_text, name, without)
            assert wrong() > 2, name


def test_menus_of_plain_elements():
    from pagelake.llm.main_text import main_text

    menu = "<div>" + "".join(f'<div><a href="/{n}">Entry {n}</a></div>' for n in range(12)) + "</div>"
    blocks = [f"<p>{text_cases.sentence(random.Random(n), 30)}</p>" for n in range(5)]
    article = "<div><div>A title</div>" + "".join(blocks) + "<p>Short end.</p></div>"
    page = f"<html><body>{menu}<div>Buy now.</div>{article}{menu}<div>Imprint</div></body></html>"
    expected = " ".join(["A title", *[b[3:-4] for b in blocks], "Short end."])
    assert main_text(page) == main_text(page, prior=False) == expected
