"""Spelling variants by anagram hashing.

1. Words are counted by partial aggregates, so frequent words cost no more than rare ones.
2. A word's key is the sum of the fifth powers of its letters' code points (modulo a prime, so
   that long words don't overflow): the same for all orders of its letters. Beside it a word sends its
   key less each of its distinct letters. Two words whose keys differ by one letter added or removed
   meet where the one's whole key is the other's lessened key; by one letter exchanged,
   where lessened keys of both are equal. So a word sends a row for each distinct letter, not
   one for each exchange of letters that the alphabet allows.
3. Words that meet are near if the order of their letters allows it: edit distance exactly one.
   No two sums of powers of two letters are equal, so a pair meets once.
4. A word's form is its most frequent near word, if that is ``ratio`` times as frequent at least;
   ties go to the least in code-point order. Counts grow along forms by that ratio each time, so chains are
   short, and pointers are doubled until all end at a root.

Rows with a null word or count take no part; repeated words add their counts up; of the rest only
words of at least ``least_chars`` code points and ``least_count`` occurrences are returned, one row each.
Extra columns are ignored. Texts may be null, empty or of any length. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, reduced

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POWER = 5
PRIME = (1 << 61) - 1
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5


def runs(docs: DataFrame, pattern: str = LETTERS) -> DataFrame:
    """doc_id, run: the maximal runs of letters in ``doc_id, text``, with A to Z in lower case; a row for each occurrence."""
    docs = reduced(docs, "doc_id", "text")
    run = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run"))
    return run.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))


def drop_letters(found: DataFrame, every: int = 199) -> DataFrame:
    """word: the runs of ``doc_id, run``; where ``every`` divides the crc32 h of "doc_id:run", without code point h % length. A null doc_id is empty text."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return found.select("run", h.alias("h")).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words of a column ``word`` (a row for each occurrence, or with counts ``n``)."""
    n = F.sum("n") if "n" in words.columns else F.count("*")
    return words.filter(F.length("word") >= least_chars).groupBy("word").agg(n.cast("bigint").alias("n")).filter(F.col("n") >= least_count)


def power(letter: Column) -> Column:
    code = F.ascii(letter).cast("bigint")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def anagram_keys(words: DataFrame) -> DataFrame:
    """word, n, whole (the word's key) and key: the whole key, and the key less each distinct letter."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    whole = F.aggregate("letters", F.lit(0).cast("bigint"), lambda total, c: (total + power(c)) % PRIME)
    keyed = words.select("word", "n", letters.alias("letters")).select("*", whole.alias("whole"))
    less = F.transform(F.array_distinct("letters"), lambda c: F.pmod(F.col("whole") - power(c), F.lit(PRIME)))
    return keyed.select("word", "n", "whole", F.explode(F.concat(F.array("whole"), less)).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: both directions of each pair of words at an edit distance of exactly one."""
    keys = materialize(anagram_keys(words), "anagram-keys")
    a, b = (keys.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("word", "n", "whole")]) for side in "ab")
    met = a.join(b, "key").filter("word_a < word_b and whole_a != whole_b")
    near = met.filter(F.levenshtein("word_a", "word_b", 1) == 1)
    sides = F.array(*[F.struct(*[F.col(f"{c}_{s}").alias(name) for s, c, name in ((x, "word", "word"), (x, "n", "n"), (y, "word", "other"), (y, "n", "other_n"))]) for x, y in ("ab", "ba")])
    return near.select(F.explode(sides).alias("p")).select("p.*")


def roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """word, root: from the pointers ``word, form``, the last word of each chain."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "pointers")
    for _ in range(rounds):
        onward = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        now = materialize(now.join(onward, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "pointers")
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")
    raise RuntimeError("chains of forms did not end")


def variant_groups(words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """words: word (and n). One row for each distinct word that is long and frequent enough: word, form, root, n, n_near, form_n."""
    words = materialize(count_words(words, least_chars, least_count), "words")
    first = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first"))
    near = near.select(F.col("word").alias("w"), "n_near", F.col("first.form").alias("near"), (-F.col("first.minus")).alias("near_n"))
    joined = words.join(near, F.col("word") == F.col("w"), "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    found = joined.select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n"))
    found = materialize(found, "forms")
    ends = roots(found.filter("form is not null").select("word", "form")).select(F.col("word").alias("w"), "root")
    return found.join(ends, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
