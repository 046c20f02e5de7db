"""Quality rules by weak supervision: rules vote, expectation-maximisation weighs the votes.

Each rule reads counts of one text and votes good (1), bad (-1) or abstains (0). Without any
label, EM estimates how often each rule gives each vote on good and on bad texts, and the
share of good texts; a document stays if its posterior probability of being good is at least
`threshold`. Votes are counted per pattern first: with R rules there are at most 3^R patterns
whatever the corpus holds (6,561 for the eight rules here), and EM runs on that table.

Everything up to the pattern table and everything after it is JVM expressions without a
shuffle of text. Three-word windows are compared by 64-bit hashes inside one text.

Defined cases: null text counts as a text without words; texts without words fail the base
rule; repeated rows are judged alike; an empty table gives an empty table; other columns of
the input, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.common import ROW, carried, stash

GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
RULES = ("length", "word_length", "symbols", "letters", "dup_lines", "repeats", "capitals", "marks")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_letters", "n_capitals", "n_marks")
METRICS = (*COUNTS, *MORE)


def _count(text: str, kind: str) -> Column:
    """Characters of a class, as what is left when the others go."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")


def with_counts(df: DataFrame, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """(__row, counts): the input's row as one column, and one long per name in METRICS."""
    out = df.select(carried(df, carry), F.coalesce(df[text].cast("string"), F.lit("")).alias("t"))
    out = out.withColumn("words", F.array_remove(F.split("t", GAP), ""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("lines", lines).withColumn("n", F.size("words"))
    # windows of three words, sorted by their hash: equal ones become neighbours
    windows = F.transform(
        F.sequence(F.lit(0), F.col("n") - 3),
        lambda i: F.struct(
            F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")
        ),
    )
    out = out.withColumn("w", F.when(F.col("n") >= 4, F.sort_array(windows)))
    twice = F.filter(
        "w",
        lambda x, j: (x["h"] == F.get(F.col("w"), j - 1)["h"]).eqNullSafe(True)
        | (x["h"] == F.get(F.col("w"), j + 1)["h"]).eqNullSafe(True),
    )
    covered = F.array_distinct(
        F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    )
    return out.select(
        ROW,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", GAP, "")).cast("long").alias("word_chars"),
        _count("t", r"#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("w").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _count("t", r"\p{L}").alias("n_letters"),
        _count("t", r"\p{Lu}").alias("n_capitals"),
        _count("t", "|!").alias("n_marks"),
    )


def votes() -> list[Column]:
    """One vote per rule of RULES, on the columns of METRICS; rates are in percent."""
    c = {m: F.col(m) for m in METRICS}
    words, chars = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
    mean = c["word_chars"] / words
    symbols, marks = 100 * c["n_symbols"] / words, 100 * c["n_marks"] / words
    letters, capitals = 100 * c["n_letters"] / chars, 100 * c["n_capitals"] / chars
    dup = 100 * c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1))
    repeats = 100 * c["n_repeat_words"] / words
    return [
        F.when(c["n_words"] < 20, -1).when(c["n_words"] >= MIN_WORDS, 1).otherwise(0),
        F.when((mean < 2) | (mean > 15), -1).otherwise(0),
        F.when(symbols > 20, -1).when(symbols <= 5, 1).otherwise(0),
        F.when(letters < 80, -1).when(letters >= 92, 1).otherwise(0),
        F.when(dup > 30, -1).otherwise(0),
        F.when(repeats > 40, -1).otherwise(0),
        F.when(capitals > 40, -1).otherwise(0),
        F.when(marks > 30, -1).otherwise(0),
    ]


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 100, tolerance: float = 1e-9) -> dict[tuple[int, ...], float]:
    """Posterior of "good" per vote pattern, by EM over pattern counts.

    Model: votes are independent given the class. Start: a good text draws a good vote nine
    times as often as a bad one, and the other way round; most texts are good. One
    pseudo-count per outcome, laid out like the start, keeps the classes from changing sides.
    """
    if not patterns:
        return {}
    start = {1: {1: 0.81, 0: 0.1, -1: 0.09}, 0: {1: 0.09, 0: 0.1, -1: 0.81}}
    width = len(next(iter(patterns)))
    table = {y: [dict(start[y]) for _ in range(width)] for y in (0, 1)}
    prior, last = 0.8, -math.inf
    posterior: dict[tuple[int, ...], float] = {}
    total = sum(patterns.values())
    for _ in range(rounds):
        likelihood = 0.0
        for votes_, count in patterns.items():
            log = {
                y: math.log(p) + sum(math.log(table[y][r][v]) for r, v in enumerate(votes_))
                for y, p in ((1, prior), (0, 1 - prior))
            }
            top = max(log.values())
            evidence = top + math.log(sum(math.exp(x - top) for x in log.values()))
            posterior[votes_] = math.exp(log[1] - evidence)
            likelihood += count * evidence
        if abs(likelihood - last) <= tolerance * abs(likelihood):
            break
        last = likelihood
        weight = {y: sum(c * (posterior[v] if y else 1 - posterior[v]) for v, c in patterns.items()) for y in (0, 1)}
        prior = (weight[1] + 8) / (total + 10)
        for y in (0, 1):
            for r in range(width):
                for vote in (1, 0, -1):
                    seen = sum(c * (posterior[v] if y else 1 - posterior[v]) for v, c in patterns.items() if v[r] == vote)
                    table[y][r][vote] = (seen + 10 * start[y][vote]) / (weight[y] + 10)
    return posterior


def judge(
    df: DataFrame, text: str = "text", threshold: float = 0.5, carry: Sequence[str] | None = None
) -> DataFrame:
    """(__row, METRICS, base_failed, p_good, kept) for every row; __row holds the columns named in `carry`, or all."""
    counted = with_counts(df, text, carry).withColumn("votes", F.concat_ws(",", *[v.cast("string") for v in votes()]))
    counted = stash(counted, "quality")
    seen = counted.groupBy("votes").count().collect()  # at most 3^len(RULES) rows
    posterior = estimate({tuple(map(int, r["votes"].split(","))): r["count"] for r in seen})
    spark = df.sparkSession
    known = spark.createDataFrame(
        [(",".join(map(str, v)), float(p)) for v, p in posterior.items()], "votes string, p_good double"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        counted.join(F.broadcast(known), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_good") >= threshold))
        .drop("votes")
    )


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents judged good, with their own columns."""
    return judge(docs, text, threshold).where("kept").select(f"{ROW}.*")
