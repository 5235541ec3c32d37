"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontam, jaccard_join, langid, mixing, secret_scan
from cohortlens.llm.common import materialize

#: Texts whose best language is less than this many times as likely as by chance are rejected; with one language none is.
MIN_LANGUAGE_GAIN = 1.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, hold no letter or fit no language. Where no text has a language to learn from, only the first two go."""
    model = langid.fit(docs)
    if model is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    taken = {c.lower() for c in docs.columns}
    lang, score = (next(n for n in (name + "_" * i for i in range(1, 99)) if n not in taken) for name in ("lang", "score"))
    least = MIN_LANGUAGE_GAIN / len(model.langs) if len(model.langs) > 1 else 0.0
    found = langid.predict(docs, model, (lang, score))
    return found.filter((F.col(lang) != "und") & (F.col(score) >= least)).drop(lang, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group."""
    return jaccard_join.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets inside texts; all documents stay."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the final mix: rows by shard, with shard and copy (added or replaced)."""
    return mixing.mix(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mixture", mixture)]

#: The stages cannot be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
