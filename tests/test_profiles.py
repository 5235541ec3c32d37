"""Profiles added up from messages against the same counts of joined texts."""

import random
import re

from cohortlens.functions import text as T
from cohortlens.operators import profiles
from pyspark.sql import functions as F

MESSAGE = "member string, period string, kind string, text string"


def shape(text):
    s = re.split(r"[.!?]+", text)
    if not any(x.strip() for x in s):
        return 0
    return {(True, True): 1, (True, False): 2, (False, False): 3, (False, True): 4}[bool(s[0].strip()), bool(s[-1].strip())]


def test_profiles_equal_those_of_joined_texts(spark):
    rng = random.Random(8)
    pieces = ["fix the login. Then test", "it's done!", "...", ". was closed", "!?. open again", "wanna merge this", "The file was changed. perhaps!", "lol 😀", "FYI see notes"]
    rows = [(f"m{rng.randrange(40)}", rng.choice(("a", "b")), rng.choice(profiles.KINDS), " ".join(rng.sample(pieces, rng.randint(1, 3)))) for _ in range(400)]
    rows += [("m0", "a", "commit", None), ("m0", "a", "commit", "  "), (None, "a", "commit", "lost words here")] + rows[:30]
    got = {r.member: r for r in profiles.profiles(profiles.message_counts(spark.createDataFrame(rows, MESSAGE)), ["member"], 1).collect()}
    joined = {}
    for m in {r[0] for r in rows} - {None}:
        mine = {(k, t) for who, _, k, t in rows if who == m and t and t.strip()}
        joined[m] = " ".join(t for k, s, t in sorted((k, shape(t), t) for k, t in mine))
    df = spark.createDataFrame(list(joined.items()), "member string, text string")
    want = df.select("member", F.size(T.tokens(F.col("text"))).alias("n"), F.size(T.sentences(F.col("text"))).alias("s"), T.richness(F.col("text")).alias("r"), T.formality(F.col("text")).alias("f"), F.col("text").rlike(T.EMOJI).alias("e"), F.col("text").rlike(T.ABBREVIATION).alias("a"), F.col("text").rlike(T.CONTRACTION).alias("c")).collect()
    assert len(got) == len(joined) and sum(r.n for r in want) > 1000
    for r in want:
        g = got[r.member]
        assert (g.words, g.sentences, g.emoji, g.abbreviations, g.contractions) == (r.n, r.s, r.e, r.a, r.c), r.member
        assert abs(g.richness - r.r) < 1e-12 and abs(g.formality - r.f) < 1e-12


def test_consistency_of_periods(spark):
    even = [("m", p, "commit", f"alpha beta gamma {i} delta.") for p in "ab" for i in range(30)]
    other = [("m", "c", "description", "Furthermore the comprehensive work was checked and likely closed " * 3)]
    got = {r.period: r.score for r in profiles.period_consistency(profiles.message_counts(spark.createDataFrame(even + other, MESSAGE))).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] > got["a"] == got["b"]
    assert profiles.period_consistency(profiles.message_counts(spark.createDataFrame([], MESSAGE))).count() == 0
