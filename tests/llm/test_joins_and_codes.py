"""Set joins, product codes and spelling variants against brute-force versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import text_cases
from pagelake.llm import pivot_codes, set_join, spelling


def collected(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# --- op11: similar sets -------------------------------------------------------------------

def _shingles(text):
    words = [w.lower() for w in text_cases.words(text)]
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[at:at + 3]) for at in range(len(words) - 2)}


def _joined(docs):
    """(key, n, component) of rows (key, text) with distinct or missing keys, by all pairs."""
    sets = [_shingles(text) for _, text in docs]
    root = list(range(len(docs)))

    def find(node):
        while root[node] != node:
            node = root[node]
        return node
    for a in range(len(docs)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 90 * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    least = {}
    for at, (key, _) in enumerate(docs):
        if key is not None:
            least[find(at)] = min(key, least.get(find(at), key))
    return sorted(
        ((key, len(sets[at]), least.get(find(at)) if sets[at] else key)
         for at, (key, _) in enumerate(docs)), key=repr,
    )


def test_sets_of_awkward_documents(awkward, no_docs):
    docs = [(row[0], row[1]) for row in text_cases.rows()]
    assert collected(set_join.similar_sets(awkward)) == _joined(docs)
    assert set_join.similar_sets(no_docs).collect() == []


def _edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def _crowds(rng):
    """Tight groups, stars, chains at the limit, and documents made of common passages."""
    texts = []
    for size in (60, 90):  # pairs of copies that share their edits, far from the others
        base = text_cases.sentence(rng, size).split()
        for _ in range(25):
            twin = _edited(rng, base, rng.randrange(3, 9))
            texts += [twin, _edited(rng, twin.split(), rng.randrange(3))]
    for size in (20, 60, 150):
        base = text_cases.sentence(rng, size).split()
        texts.append(" ".join(base))
        texts += [_edited(rng, base, rng.randrange(1, 4)) for _ in range(60)]
    chain = text_cases.sentence(rng, 120).split()
    for step in range(45):
        chain[(7 * step) % 120] = f"step{step}"
        texts.append(" ".join(chain))
    passages = [text_cases.sentence(rng, 12) for _ in range(8)]
    for _ in range(150):
        texts.append(" ".join(rng.sample(passages, 5)))
    for _ in range(40):
        texts.append(" ".join(passages[:3]) + " " + text_cases.sentence(rng, rng.randrange(5, 60)))
    texts += [text_cases.sentence(rng, rng.randrange(3, 30)) for _ in range(30)]
    texts += ["one", "ONE", "one two", "one  two", "one two three", "two one", None, ""]
    for n in range(9, 13):  # similarities of exactly and nearly nine tenths
        words = [f"w{n}x{at}" for at in range(n + 2)]
        texts += [" ".join(words), " ".join(words[:-1])]
    return texts


def test_sets_in_crowds(spark):
    rng = random.Random(41)
    texts = _crowds(rng)
    keys = rng.sample(range(10**6), len(texts))
    docs = [(None if n % 17 == 0 else key, text) for n, (key, text) in enumerate(zip(keys, texts))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    expected = _joined(docs)
    sizes = collections.Counter(row[2] for row in expected)
    assert sizes.most_common(1)[0][1] > set_join.SHORT
    assert collected(set_join.similar_sets(frame)) == expected


@pytest.mark.parametrize("short", [0, 1, 10**6])
def test_lists_of_any_length(spark, monkeypatch, short):
    """Heads alone, heads and pairs, and pairs alone find the same links."""
    monkeypatch.setattr(set_join, "SHORT", short)
    monkeypatch.setattr(set_join, "FREQUENT", 3)
    monkeypatch.setattr(set_join, "GROWTH", 2)
    rng = random.Random(43)
    base = text_cases.sentence(rng, 70).split()
    texts = [_edited(rng, base, rng.randrange(0, 4)) for _ in range(25)]
    texts += [text_cases.sentence(rng, 20) for _ in range(5)]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert collected(set_join.similar_sets(frame)) == _joined(docs)


def test_overlaps_follow_from_differences(spark):
    rng = random.Random(47)
    rows = []
    for _ in range(50):
        head = set(rng.sample(range(100), 40))
        one, other = (
            (head - set(rng.sample(range(100), 15))) | set(rng.sample(range(100), 6)) for _ in "ab"
        )
        rows.append((len(head), list(head - one), list(one - head), list(head - other),
                     list(other - head), len(one & other)))
    frame = spark.createDataFrame(
        rows, "size int, a array<long>, b array<long>, c array<long>, d array<long>, shared long"
    )
    found = frame.select("shared", set_join._derived(F.col("size"), *map(F.col, "abcd")).alias("got"))
    assert all(row.got == row.shared for row in found.collect())


@pytest.mark.parametrize("edits", [1, 4])
def test_heads_spare_pairs(spark, monkeypatch, edits):
    """A group of 300 copies takes far fewer comparisons than it has pairs, whether the
    copies are similar to each other or only to the text they were made from."""
    counted = []
    compare = set_join._Verifier.compare

    def counting(self, pairs, keep):
        counted.append(pairs.count())
        return compare(self, pairs, keep)
    monkeypatch.setattr(set_join._Verifier, "compare", counting)
    rng = random.Random(53)
    base = text_cases.sentence(rng, 150).split()
    docs = [(n, _edited(rng, base, edits)) for n in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = collected(set_join.similar_sets(frame))
    assert found == _joined(docs)
    assert sum(counted) < 300 * 299 / 2 / 10


def test_least_lonely_set_leads(spark, monkeypatch):
    """Copies with 1 to 12 edits are not dealt to several leaders that are far from the text
    they were made from, whose parts would be paired off."""
    class Led(Exception):
        pass
    led = set_join._led

    def first(compared, left):
        raise Led(led(compared, left))
    monkeypatch.setattr(set_join, "_led", first)
    rng = random.Random(59)
    base = text_cases.sentence(rng, 150).split()
    # Rows are numbered from 0 in one partition; those of least hash have the most edits.
    hashed = spark.range(200).orderBy(F.xxhash64("id")).collect()
    edits = {row.id: 12 - 12 * rank // 200 for rank, row in enumerate(hashed)}
    docs = [(n, _edited(rng, base, edits[n])) for n in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    with pytest.raises(Led) as found:
        set_join.similar_sets(frame)
    sizes = found.value.args[0].groupBy("leader").count().collect()
    assert max((row["count"] for row in sizes), default=0) > 100


# --- op12: product codes ------------------------------------------------------------------

def _coded(rows, parts=16, entries=64, rounds=2):
    """Brute force over rows (id, vector, label) of one size, in whole numbers."""
    kept = [
        (key, [int(np.floor(256 * float(x))) for x in vector], label)
        for key, vector, label in rows
        if vector is not None and all(x is not None and np.isfinite(x) for x in vector)
    ]
    kept.sort(key=lambda row: (row[0] is None, row[0] or 0, row[1]))
    cuts = np.array_split(np.arange(len(kept[0][1])), parts)
    split = lambda v: [tuple(v[at] for at in cut) for cut in cuts]
    books = [list(book) for book in zip(*[split(v) for _, v, _ in kept[:entries]])]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), at) for at, entry in enumerate(book))
    for _ in range(rounds):
        groups = [collections.defaultdict(list) for _ in books]
        for _, vector, _ in kept:
            for number, part in enumerate(split(vector)):
                groups[number][nearest(part, books[number])[1]].append(part)
        for number, found in enumerate(groups):
            for entry, members in found.items():
                books[number][entry] = tuple(sum(x) // len(members) for x in zip(*members))
    out = []
    for key, vector, label in kept:
        found = [nearest(part, book) for part, book in zip(split(vector), books)]
        out.append((key, "".join(f"{at:02x}" for _, at in found), sum(d for d, _ in found), label))
    totals = collections.Counter()
    for _, _, error, label in out:
        totals[label] += error
    digest = hashlib.sha256(
        ",".join(str(x) for book in books for entry in book for x in entry).encode()
    ).hexdigest()
    return [(key, code, error, label, totals[label], digest) for key, code, error, label in out]


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, id int"


def _vectors(rng, count, size):
    rows = []
    for n in range(count):
        scale = rng.choice([0.05, 1.0, 30.0])
        vector = [float(np.float32(rng.gauss(0, scale))) for _ in range(size)]
        rows.append((n if n % 11 else None, vector, rng.choice([None, 1, 1, 1, 2, 3]), "x", "y", 1))
    rows += rows[:7]
    return rows


@pytest.mark.parametrize("size", [32, 40, 7, 0])
def test_codes_are_the_nearest_entries(spark, size):
    rng = random.Random(size)
    rows = _vectors(rng, 150, size)
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    found = pivot_codes.pivot_codes(frame)
    assert collected(found) == sorted(_coded([row[:3] for row in rows]), key=repr)


def test_vectors_of_any_kind(spark):
    """Incomplete vectors go, sizes are apart, ties and large components have their place."""
    rng = random.Random(3)
    nan, inf = float("nan"), float("inf")
    odd = [(500, None, 1), (501, [1.0, None] * 8, 1), (502, [nan] * 16, 1), (503, [inf] * 16, None),
           (504, [1.0] * 15 + [-inf], 2)]
    same = [(n, [float(n % 3)] * 16, n % 2) for n in range(90)]
    large = [(n, [1e30 if n % 2 else -1e30] * 24, None) for n in range(200, 204)]
    rows = [(*row, "x", "y", 1) for row in odd + same + large]
    rng.shuffle(rows)
    found = collected(pivot_codes.pivot_codes(spark.createDataFrame(rows, VECTORS)))
    expected = _coded([row for row in odd if row[1] is None] + same)
    assert [row[:4] for row in found if row[0] < 200] == [
        row[:4] for row in sorted(expected, key=repr)
    ]
    assert len(found) == len(same) + len(large)
    assert all(row[1][:2] in ("00", "01") and row[2] == 0 for row in found if row[0] >= 200)
    assert pivot_codes.pivot_codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert pivot_codes.pivot_codes(spark.createDataFrame(
        [(*row, "x", "y", 1) for row in odd], VECTORS)).collect() == []


def test_bounds_spare_distances():
    rng = np.random.default_rng(5)
    book = rng.integers(-200, 200, (64, 4))
    points = book[rng.integers(0, 64, 3000)] + rng.integers(-12, 13, (3000, 4))
    pivots = pivot_codes.choose_pivots(book, pivot_codes.PIVOTS)
    entry, error, evaluated = pivot_codes.nearest_entries(
        points, pivot_codes.distances(points, pivots), book, pivot_codes.distances(pivots, book)
    )
    all_errors = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (error == all_errors.min(axis=1)).all() and (entry == all_errors.argmin(axis=1)).all()
    assert evaluated < 0.2 * 3000 * 64


# --- op13: spelling variants --------------------------------------------------------------

def _runs(text):
    run = ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
            run += c.lower() if c <= "Z" else c
        elif run:
            yield run
            run = ""


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:at] + b[at + 1:] == a for at in range(len(b)))


def _variants(docs):
    counts = collections.Counter()
    for key, text in docs:
        for run in _runs(text):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                counts[run] += 1
    counts = {word: n for word, n in counts.items() if n >= 2}
    near = {word: [other for other in counts if _near(word, other)] for word in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda other: (-counts[other], other), default=None)
        form[word] = best if best and counts[best] >= 10 * counts[word] else None
    out = []
    for word, n in counts.items():
        root = word
        while form[root]:
            root = form[root]
        out.append((word, form[word], root, n, len(near[word]), counts.get(form[word])))
    return sorted(out, key=repr)


def test_variants_of_awkward_documents(awkward, no_docs):
    docs = [(row[0], row[1]) for row in text_cases.rows()]
    assert collected(spelling.spelling_variants(awkward)) == _variants(docs)
    assert spelling.spelling_variants(no_docs).collect() == []


def test_variants_of_all_kinds(spark):
    """Every edit, letters beyond ASCII, chains of forms, ties and anagrams."""
    rng = random.Random(59)
    base = ["planning", "überzahl", "ñandúñandú", "aaaaaaaa", "abababab", "reported", "éclairés"]
    words = list(base)
    for word in base:
        for _ in range(25):
            at = rng.randrange(len(word))
            letter = rng.choice("abéñüz")
            words.append(rng.choice([
                word[:at] + word[at + 1:], word[:at] + letter + word[at:],
                word[:at] + letter + word[at + 1:], word[:at] + letter + word[at:][::-1],
            ]))
    docs = []
    for n in range(400):
        chosen = [rng.choice(words) for _ in range(20)] + [rng.choice(base) for _ in range(15)]
        docs.append((n if n % 9 else None, " ".join(chosen).upper() + "×÷ x_planning9reported"))
    chain = [("chaining", 2), ("chainings", 30), ("xchainings", 400)]
    docs += [(1000 + n, " ".join([word] * count)) for n, (word, count) in enumerate(chain)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    expected = _variants(docs)
    assert any(row[1] and row[1] != row[2] for row in expected)
    assert collected(spelling.spelling_variants(frame)) == expected


def test_near_words_share_a_signature():
    rng = random.Random(61)
    for _ in range(400):
        word = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 15)))
        at, letter = rng.randrange(len(word)), rng.choice("abcdexyz")
        edits = [word[:at] + word[at + 1:], word[:at] + letter + word[at:],
                 word[:at] + letter + word[at + 1:]]
        found = [set(row.tolist()) for row in spelling.word_signatures([word, *edits])]
        assert all(found[0] & other for other in found[1:])
