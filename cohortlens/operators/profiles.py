"""Profiles of how members write, added up from their messages; no text is ever joined to another.

A message gives counts: words, letters, sentences, bits of phrases. Members' counts are sums of those of their distinct
messages (told apart by a digest), and their vocabulary is counted word by word, so a member with a third of all messages is
spread over tasks like any other.

The counts are those of one text that holds the messages of a kind after the other (commits first), put apart by blanks. A sentence
goes on from a message without an end mark into the next if that doesn't begin with one; how often that happens follows from how
many messages of each shape there are, as the order within a kind is by shape: only marks, open on both sides, ended,
closed on both sides, begun by a mark. Phrases and passive forms count within a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import text as T
from cohortlens.functions.scalar import safe_divide
from cohortlens.operators.cohort import consistency

KINDS = ("commit", "description")
#: Shapes of messages, in the order in which they are thought to follow each other.
MARKS, OPEN, ENDED, CLOSED, BEGUN = range(5)
SUMS = ("words", "letters", "sentences", "passives", "hedges")


def message_counts(messages: DataFrame) -> DataFrame:
    """messages (member, period, kind, text) without blank ones, as member, period, kind, digest, shape, the counts of SUMS, bits, has_contraction, has_emoji, has_abbreviation, vocabulary (distinct words)."""
    x = messages.filter(F.col("member").isNotNull() & F.col("text").rlike(r"\S")).select("member", "period", "kind", "text", T.tokens(F.col("text")).alias("w"), F.split("text", r"[.!?]+").alias("s"))
    filled = lambda s: s.rlike(r"\S")
    x = x.withColumns({"sentences": F.size(F.filter("s", filled)), "first": filled(F.element_at("s", 1)), "last": filled(F.element_at("s", -1))})
    shape = F.when(F.col("sentences") == 0, MARKS).when(F.col("first") & F.col("last"), OPEN).when(F.col("first"), ENDED).when(F.col("last"), BEGUN).otherwise(CLOSED)
    text = F.col("text")
    return x.select(
        "member", "period", "kind", F.sha2("text", 256).alias("digest"), shape.alias("shape"), F.size("w").alias("words"),
        F.aggregate("w", F.lit(0), lambda a, v: a + F.length(v)).alias("letters"), "sentences", F.regexp_count(text, F.lit(T.PASSIVE)).alias("passives"), T.hedges(F.col("w")).alias("hedges"),
        T.phrase_bits(text).alias("bits"), text.rlike(T.CONTRACTION).alias("has_contraction"), text.rlike(T.EMOJI).alias("has_emoji"), text.rlike(T.ABBREVIATION).alias("has_abbreviation"), F.array_distinct("w").alias("vocabulary"),
    )


def carried_over() -> Column:
    """How many sentences go on from one message into the next, from the numbers of messages by kind and shape (n_<kind>_<shape>)."""
    n = lambda kind, shape: F.col(f"n_{kind}_{shape}")
    inside = sum((F.greatest(n(k, OPEN) - 1, F.lit(0)) + ((n(k, OPEN) > 0) & (n(k, ENDED) > 0)).cast("int") for k in KINDS), F.lit(0))
    one, two = KINDS
    # A kind ends with its last shape that is there, and begins with its first.
    ends_open = (n(one, BEGUN) > 0) | ((n(one, CLOSED) == 0) & (n(one, ENDED) == 0) & (n(one, OPEN) > 0))
    begins_open = (n(two, MARKS) == 0) & ((n(two, OPEN) > 0) | (n(two, ENDED) > 0))
    return inside + (ends_open & begins_open).cast("int")


def profiles(counts: DataFrame, by: list[str], least_words: int = 100) -> DataFrame:
    """By group with ``least_words`` words: words, sentences, avg_sentence_length, avg_word_length, richness, formality, contractions, emoji, abbreviations, avg_description_length (words a description; 0 without any). counts: as of ``message_counts``."""
    once = counts.drop("vocabulary").dropDuplicates([*by, "kind", "digest"])
    shapes = [F.count_if((F.col("kind") == k) & (F.col("shape") == s)).alias(f"n_{k}_{s}") for k in KINDS for s in range(5)]
    flags = {"contractions": "has_contraction", "emoji": "has_emoji", "abbreviations": "has_abbreviation"}
    of = F.col("kind") == KINDS[1]
    x = once.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in SUMS], *shapes, F.bit_or("bits").alias("bits"), *[F.bool_or(v).alias(k) for k, v in flags.items()],
        F.sum(F.when(of, F.col("words"))).alias("description_words"), F.count_if(of).alias("descriptions"),
    )
    words = counts.select(*by, F.explode("vocabulary").alias("word")).distinct().groupBy(*[F.col(c).alias(f"{c}_v") for c in by]).agg(F.count("*").alias("vocabulary"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_v")) for c in by]
    x = x.filter(F.col("words") >= least_words).join(words, same, "left").withColumn("sentences", F.col("sentences") - carried_over())
    n = F.col("words")
    return x.select(
        *by, n, "sentences", (n / F.greatest("sentences", F.lit(1))).alias("avg_sentence_length"), safe_divide(F.col("letters"), n).alias("avg_word_length"), safe_divide(F.col("vocabulary"), n).alias("richness"),
        T.formality_of(n, F.col("sentences"), F.col("bits"), F.col("passives"), F.col("hedges")).alias("formality"), *flags, safe_divide(F.col("description_words"), F.col("descriptions")).alias("avg_description_length"),
    )


def period_consistency(counts: DataFrame, least_words: int = 10, base_words: int = 100) -> DataFrame:
    """member, period, the period's formality, richness, avg_sentence_length and avg_description_length, and score: how far the first three are from the member's profile over all periods, 0 to 1."""
    terms = {"formality": 0.4, "richness": 0.3, "avg_sentence_length": 0.3}
    base = profiles(counts, ["member"], base_words).select(F.col("member").alias("m0"), *[F.col(c).alias(f"{c}_0") for c in terms])
    own = profiles(counts, ["member", "period"], least_words).join(base, F.col("member") == F.col("m0"))
    score = consistency([(F.col(c), F.col(f"{c}_0"), w) for c, w in terms.items()])
    return own.select("member", "period", *terms, "avg_description_length", score.alias("score"))


def gathered(messages: DataFrame, least_words: int = 100) -> DataFrame:
    """member, messages, chars: the distinct texts that are not blank of members with ``least_words`` words (apart by white space), and their length. messages: member, text."""
    usable = F.col("member").isNotNull() & (F.trim("text") != "")
    x = messages.filter(usable).select("member", F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"), F.regexp_count("text", F.lit(r"\S+")).alias("n"))
    x = x.groupBy("member", "digest").agg(F.max("chars").alias("chars"), F.max("n").alias("n"))
    return x.groupBy("member").agg(F.count("*").alias("messages"), F.sum("chars").alias("chars"), F.sum("n").alias("n")).filter(F.col("n") >= least_words).drop("n")
