"""Documents with every awkward case, and brute-force versions of the operators."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that operators might use themselves.
    T.StructField("h", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("quality", T.StringType()), T.StructField("bpe", T.StringType()),
])


def sentence(rng, size):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(size))


def texts():
    rng = random.Random(7)
    passage = sentence(rng, 60)
    base = [sentence(rng, 120) for _ in range(6)]
    near = base[0].split()
    near[50] = "changed"
    found = [
        None, "", " \t\n ", "\n\n", "one", "two words", base[0], base[0], " ".join(near),
        base[1] + "\nShared Line\n" + base[2], base[1], passage, base[3] + " " + passage,
        passage + " " + base[4] + "  " + passage, "x " * 400, "loop the loop " * 60,
        "ÀÉ ñandú ß ﬁ é́ 日本語 " * 12, base[5].upper(), base[5],
        "a" * 3000, "tab\tand\x0bvertical\x0cfeed\rreturn " * 5,
        " ".join(sentence(rng, 1) for _ in range(4000)),
        "<|endoftext|> and <|startoftext|> in a text",
    ]
    found += [f"{sentence(rng, 30)}\n  SHARED line \t\n{sentence(rng, 30)}" for _ in range(12)]
    return found


def rows():
    out = [(n, t, "en", "s", None, "h", "k", "q", "b") for n, t in enumerate(texts())]
    out.append(out[6])  # a repeated row
    out.append((None, "a null key with words", None, None, None, None, None, None, None))
    return out


def words(text):
    return (text or "").encode().split()


def first_places(pairs, size):
    """Earliest (key, position) of each run of ``size`` words of (key, words) pairs."""
    seen = {}
    for key, found in pairs:
        for at in range(len(found) - size + 1):
            run = tuple(found[at:at + size])
            seen[run] = min(seen.get(run, (key, at)), (key, at))
    return seen
