"""URL rules, and a ratio of two character language models for URLs without a rule.

Both models are variable-order Markov models over the characters of host and path: the
probability of a character mixes what followed its last ``ORDER`` characters with what
followed ever shorter contexts,

    p_k(c) = (n(context_k c) + WEIGHT * p_{k-1}(c)) / (n(context_k) + WEIGHT),

so an unseen context falls back to the longest one that was seen. URLs that rules accept
train one model, URLs that rules reject the other. The score of a URL is the difference of
its log-likelihoods divided by its length. The cut between accepted and rejected is
calibrated on a fifth of the labelled URLs that the models have not seen: it maximises the
mean of both classes' accuracies there.

Everything is joins and sums of built-in expressions. Counts are tables, joined by n-gram;
no model is sent through the driver, and its size may grow with the URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.llm.tables import LOWER, UPPER, discard, free_name, settle

#: Characters of context, the weight of the shorter context, and the size of the alphabet
#: that the empty context is spread over.
ORDER = 4
WEIGHT = 2.0
ALPHABET = 256

#: One URL in so many is kept from training, for the calibration.
HELD_OUT = 5

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What lies between the first ``://`` and ``/ ? #`` or the end, A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(found, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    choices = []
    for verdict, rule in sorted(rules, key=lambda pair: -len(pair[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(
            slash + rest
        )
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        choices.append(F.when(fits, found))
    return F.coalesce(*choices)


def _grams(text: Column, order: int) -> Column:
    """Each character with its ``order`` predecessors; ^ stands before, $ after the text."""
    padded = F.concat(F.lit("^" * order), text, F.lit("$"))
    places = F.sequence(F.lit(1), F.length(text) + 1)
    return F.transform(places, lambda at: F.substring(padded, at, order + 1))


def _probabilities(counts: DataFrame, order: int) -> DataFrame:
    """(gram, p_accepted, p_rejected) for every gram of ``order + 1`` characters."""
    sides = ("accepted", "rejected")
    levels = {order: counts}
    for k in range(order - 1, -1, -1):
        levels[k] = (
            levels[k + 1].groupBy(F.expr("substring(gram, 2)").alias("gram"))
            .agg(*[F.sum(side).alias(side) for side in sides])
        )
    totals = levels[0].agg(*[F.sum(side).alias(f"all_{side}") for side in sides])
    # One row of totals, so the join is with a single row.
    known = levels[0].crossJoin(F.broadcast(totals)).select(
        "gram",
        *[
            ((F.col(side) + WEIGHT / ALPHABET) / (F.col(f"all_{side}") + WEIGHT)).alias(f"p_{side}")
            for side in sides
        ],
    )
    for k in range(1, order + 1):
        contexts = levels[k].groupBy(F.expr(f"left(gram, {k})").alias("context")).agg(
            *[F.sum(side).alias(f"all_{side}") for side in sides]
        )
        shorter = known.select(F.col("gram").alias("shorter"), *[f"p_{side}" for side in sides])
        known = (
            levels[k]
            .join(shorter, F.expr("substring(gram, 2)") == F.col("shorter"))
            .join(contexts, F.expr(f"left(gram, {k})") == F.col("context"))
            .select(
                "gram",
                *[
                    (
                        (F.col(side) + WEIGHT * F.col(f"p_{side}"))
                        / (F.col(f"all_{side}") + WEIGHT)
                    ).alias(f"p_{side}")
                    for side in sides
                ],
            )
        )
    return known


def _scores(texts: DataFrame, order: int) -> DataFrame:
    """``texts`` (distinct ``place``, and ``label``) with ``score`` per character."""
    training = F.col("label").isNotNull() & ~_held_out(F.col("place"))
    counts = settle(
        texts.select(
            F.explode(_grams(F.col("place"), order)).alias("gram"),
            F.when(training & (F.col("label") == "allow"), 1).otherwise(0).alias("a"),
            F.when(training & (F.col("label") == "block"), 1).otherwise(0).alias("b"),
        )
        .groupBy("gram")
        .agg(F.sum("a").alias("accepted"), F.sum("b").alias("rejected")),
        "url-grams",
    )
    ratio = settle(
        _probabilities(counts, order).select(
            "gram", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio")
        ),
        "url-ratios",
    )
    scored = (
        texts.select("place", "label", F.explode(_grams(F.col("place"), order)).alias("gram"))
        .hint("merge").join(ratio, "gram").groupBy("place", "label")
        # Rounding takes the order of the additions out of the result.
        .agg(F.round(F.sum("ratio") / F.count("ratio"), 9).alias("score"))
    )
    scored = settle(scored, "url-scores")
    discard(counts, ratio)
    return scored


def _held_out(place: Column) -> Column:
    digits = F.substring(F.md5(F.encode(place, "UTF-8")), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") % HELD_OUT == 0


def _threshold(scored: DataFrame) -> DataFrame:
    """One row: the score from which URLs are accepted, from the held-out labelled URLs.

    Scores are counted in bins of 0.01 between -8 and 8, which bounds the table. Among the
    best cuts the one nearest to zero wins, then the lower one. Without held-out URLs of
    both labels the cut is zero.
    """
    held = scored.where(F.col("label").isNotNull() & _held_out(F.col("place")))
    bins = held.groupBy(
        F.greatest(F.lit(-800), F.least(F.lit(800), F.floor(F.col("score") * 100)))
        .cast("int").alias("bin")
    ).agg(
        F.sum(F.when(F.col("label") == "allow", 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("label") == "block", 1).otherwise(0)).alias("bad"),
    )
    cuts = bins.sparkSession.range(-800, 801).select(F.col("id").cast("int").alias("bin"))
    counted = cuts.join(bins, "bin", "left").na.fill(0)
    # 1,601 rows at most, however many URLs there are.
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    summed = counted.select(
        "bin",
        F.sum("good").over(everything).alias("goods"), F.sum("bad").over(everything).alias("bads"),
        F.coalesce(F.sum("good").over(below), F.lit(0)).alias("lost"),
        F.coalesce(F.sum("bad").over(below), F.lit(0)).alias("caught"),
    )
    value = F.when(
        (F.col("goods") > 0) & (F.col("bads") > 0),
        F.round((F.col("goods") - F.col("lost")) / F.col("goods"), 9)
        + F.round(F.col("caught") / F.col("bads"), 9),
    ).otherwise(F.lit(0.0))
    order = F.struct(value.alias("value"), -F.abs(F.col("bin")), -F.col("bin"))
    return summed.agg((F.max_by("bin", order) / 100).alias("threshold"))


def judge_urls(
    pages: DataFrame, *, url: str = "url", rules=RULES, order: int = ORDER
) -> DataFrame:
    """The rows of ``pages`` with a struct column ``url_verdict`` (underscores if taken).

    Fields: host, path, rule (null if none fits), score (log-likelihood difference per
    character, rounded) and verdict, ``allow`` or ``block``: the rule's or the models'.
    A URL without a rule is allowed if its score reaches the calibrated threshold.

    A null URL, or one without ``://``, has an empty host and path and is judged by the
    models as the empty text. Equal places are scored once; repeated rows stay. Null keys
    are not looked at. An empty table gives an empty table.
    """
    place = F.concat(url_host(F.col(url)), url_path(F.col(url)))
    found = matching_rule(url_host(F.col(url)), url_path(F.col(url)), rules)
    texts = pages.select(place.alias("place"), found["verdict"].alias("label")).distinct()
    scored = _scores(texts, order)
    scored = scored.crossJoin(F.broadcast(_threshold(scored)))
    judged = scored.select(
        "place", "score",
        F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block").alias("guess"),
    )
    on = F.concat(url_host(F.col(f"p.{url}")), url_path(F.col(f"p.{url}"))) == F.col("j.place")
    rule = matching_rule(url_host(F.col(f"p.{url}")), url_path(F.col(f"p.{url}")), rules)
    verdict = F.struct(
        url_host(F.col(f"p.{url}")).alias("host"), url_path(F.col(f"p.{url}")).alias("path"),
        rule["rule"].alias("rule"), F.col("j.score").alias("score"),
        F.coalesce(rule["verdict"], F.col("j.guess")).alias("verdict"),
    )
    return pages.alias("p").join(judged.alias("j"), on, "left").select(
        "p.*", verdict.alias(free_name(pages, "url_verdict"))
    )
