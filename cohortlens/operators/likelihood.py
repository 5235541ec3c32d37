"""Signals of generated work: flags of an author, fused signals of files, texts of a member."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scalar import weighted_fusion

# What an author's flags add to the heuristic score; names in one entry count once.
FLAG_POINTS = ((("SINGLE_COMMIT_DUMP",), 0.30), (("EMPTY_DESCRIPTION",), 0.20), (("LOW_SURVIVAL_RATE",), 0.20), (("COSMETIC_REWRITE_ACTOR", "COSMETIC_REWRITE"), 0.20))


def heuristic_scores(prs: DataFrame, flags: DataFrame) -> DataFrame:
    """pr, score: points of the author's flags in the pull request's sprint, 1 at most; 0 without an author, a sprint or flags. prs: pr, author, sprint; flags: member, sprint, flag."""
    f = flags.groupBy(F.col("member").alias("m2"), F.col("sprint").alias("s2")).agg(F.collect_set("flag").alias("flags"))
    x = prs.join(f, (F.col("author") == F.col("m2")) & (F.col("sprint") == F.col("s2")), "left")
    has = lambda names: F.coalesce(F.arrays_overlap("flags", F.array(*map(F.lit, names))), F.lit(False))
    score = reduce(lambda a, p: a + F.when(has(p[0]), p[1]).otherwise(0.0), FLAG_POINTS, F.lit(0.0))
    return x.select("pr", F.least(score, F.lit(1.0)).alias("score"))


def fused_files(signals: DataFrame, weights: dict[str, float], elevated: float = 0.40, high: float = 0.65) -> DataFrame:
    """path, score, confidence (high from four signals, medium from three), risk, of each file with a signal: the weighted mean of the signals that are there, each from 0 to 1. signals: path, signal, value; the mean of a signal's values counts."""
    wide = signals.filter(F.col("signal").isin(*weights)).groupBy("path").pivot("signal", sorted(weights)).agg(F.avg("value"))
    score, n = weighted_fusion({k: (F.col(k), w) for k, w in weights.items()}, (0.0, 1.0))
    x = wide.withColumns({"score": score, "n": n}).filter("n > 0")
    confidence = F.when(F.col("n") >= 4, "high").when(F.col("n") >= 3, "medium").otherwise("low")
    return x.select("path", "score", confidence.alias("confidence"), F.when(F.col("score") > high, "high").when(F.col("score") > elevated, "elevated").otherwise("low").alias("risk"))


def labelled(prs: DataFrame, scores: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row for each pull request with a text, a score and a vector: pr, score (the latest), vector. prs: pr, body; scores: pr, score, at; vectors: pr, vector."""
    s = scores.filter("score is not null").groupBy("pr").agg(F.max_by("score", "at").alias("score"))
    return prs.filter("trim(coalesce(body, '')) != ''").select("pr").distinct().join(s, "pr").join(vectors, "pr")
