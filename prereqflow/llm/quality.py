"""Weak supervision of document quality: rules vote or abstain, expectation-maximisation estimates how often each
is right, and a posterior probability decides (native DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, words_of

SPAN = 8


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Counts over the whole text of each row; a null text has no words. All in one pass, row by row, without a shuffle.
    Null ids stay, repeated rows are counted each, an empty table gives no row; columns that aren't named are ignored.

    Repeated windows are found by their 64-bit hashes: a set tells whether there are any, and only then are they sorted.
    """
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), has_word).alias("l"))
    n = F.size("w")
    hashes = F.when(n >= span, F.transform(F.sequence(F.lit(1), n - span + 1), lambda i: F.xxhash64(F.slice("w", i, span))))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"[.!?]['\")]*[\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
        F.regexp_count("t", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        hashes.alias("h"),
    )
    again = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("s", F.when(again, F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    h_at = lambda j: F.get(F.col("s"), j)["h"]
    twice = F.filter("s", lambda x, j: (x.h == h_at(j - 1)) | (x.h == h_at(j + 1)))
    rows = rows.withColumn("p", F.array_sort(F.transform(twice, lambda x: x.i)))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a.n + i + span - F.greatest(a.end, i)).alias("n"), (i + span).alias("end")),
    ).n
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("h", "s", "p")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


def rules() -> dict[str, Column]:
    """Each votes 1 (good), -1 (bad) or 0 (abstains) on the columns of features()."""
    n, per = F.col("n_words"), lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    lines, mean = F.greatest(F.col("n_lines"), F.lit(1)), per("word_chars")
    return {
        "length": _vote(n >= 50, n < 20),
        "word_length": _vote((mean >= 3) & (mean <= 11), (mean < 2.2) | (mean > 16)),
        "symbols": _vote(per("n_symbols") <= 0.02, per("n_symbols") > 0.15),
        "lines": _vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") > 0.3 * lines),
        "repetition": _vote(per("n_repeat_words") <= 0.1, per("n_repeat_words") > 0.25),
        "endings": _vote(F.col("n_ended") >= 0.6 * lines, F.col("n_ended") < 0.1 * lines),
        "digits": _vote(F.col("n_digits") <= 0.05 * F.col("word_chars"), F.col("n_digits") > 0.25 * F.col("word_chars")),
        "variety": _vote(F.col("n_distinct") >= 0.15 * n, F.col("n_distinct") < 0.08 * n),
    }


def _log_odds(prior: float, shares: dict[str, dict[int, tuple[float, float]]]) -> Column:
    """Log odds of good, given the votes; shares: for each rule and vote its probability among the good and among the
    bad documents on which the rule votes. Who abstains says nothing."""
    total = F.lit(math.log(prior / (1 - prior)))
    for rule, by in shares.items():
        gain = {v: math.log(good / bad) for v, (good, bad) in by.items()}
        total = total + F.when(F.col(rule) > 0, gain[1]).when(F.col(rule) < 0, gain[-1]).otherwise(0.0)
    return total


def estimate(patterns: DataFrame, names: list[str], rounds: int = 15) -> tuple[float, dict[str, dict[int, tuple[float, float]]]]:
    """Share of good documents, and how each rule votes on good and on bad ones, from counts `n` of vote patterns.

    There are 3 ** rules patterns at most, whatever the input (6,561 for eight rules): that table comes to the driver once, and rounds are
    arithmetic on it. Starts from: a document that any rule votes against is bad. Every round takes the posterior of each
    pattern under the last estimates, then new estimates from it, smoothed by one document per vote. No pattern: even odds.
    """
    rows = sorted((tuple(r[x] for x in names), r["n"]) for r in patterns.select(*names, "n").toLocalIterator())
    q, prior, shares = [0.1 if min(votes) < 0 else 0.95 for votes, _ in rows], 0.5, {x: dict.fromkeys((-1, 1), (0.5, 0.5)) for x in names}
    total = sum(n for _, n in rows)
    for _ in range(rounds if total else 0):
        good = math.fsum(n * p for (_, n), p in zip(rows, q, strict=True))
        prior = (good + 1) / (total + 2)
        for i, x in enumerate(names):
            sums = {v: [1 + math.fsum(n * (p if side else 1 - p) for (votes, n), p in zip(rows, q, strict=True) if votes[i] == v) for side in (1, 0)] for v in (-1, 1)}
            shares[x] = {v: tuple(sums[v][side] / (sums[-1][side] + sums[1][side]) for side in (0, 1)) for v in (-1, 1)}
        gains = [{v: math.log(g / b) for v, (g, b) in shares[x].items()} for x in names]
        q = [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(gain.get(v, 0.0) for gain, v in zip(gains, votes, strict=True))))) for votes, _ in rows]
    return prior, shares


def judge(df: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the features, a vote per rule, base_failed, p_good, kept (not base_failed and p_good >= least).

    Null text or no word: n_words 0, so base_failed. Null id: judged. Repeated rows: each judged. Empty input: no row.
    The features (numbers only) are checkpointed once. Estimates come from the vote patterns of the rows that don't
    fail the base test, as the rest is decided; posteriors are taken of every row.
    """
    votes = [f"{x}_vote" for x in rules()]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = features(df, id_col, text_col).withColumns({f"{k}_vote": v for k, v in rules().items()})
    voted = durable(counted.withColumn("base_failed", failed))
    prior, shares = estimate(voted.where("NOT base_failed").groupBy(*votes).agg(F.count("*").alias("n")), votes)
    p = 1 / (1 + F.exp(-_log_odds(prior, shares)))
    return voted.withColumn("p_good", p).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() over all documents: the same rows, nulls and ties as there."""
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))
