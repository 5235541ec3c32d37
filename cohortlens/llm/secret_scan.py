"""Secret scan: fixed patterns plus sliding-window Shannon entropy, in DataFrame functions only.

Base kinds, leftmost and non-overlapping each: ``assign`` (a keyword, a separator and a
value of 6+ characters), ``access`` (AKIA and upper-case letters or digits, 20+
characters), ``hex`` (24+ lower-case hex digits). Their positions follow from the lengths
of the pieces between the matches, in one linear pass.

Entropy kinds: candidates are runs of 20+ characters of the base64 alphabets with a digit.
A window of 20 characters slides over each candidate; counts by character of the class
change by the one that enters and the one that leaves, and with them the sum of
c * log2(c), so the entropy log2(w) - sum / w never needs a recount. Windows wholly inside a class
and at or over its threshold are merged to spans (``entropy_hex``, ``entropy_base64``,
``entropy_lower`` and ``entropy_upper`` with digits, ``entropy_alnum``); a stretch may have several kinds.
Candidates that match the allow-list give none, nor do windows that overlap a stretch of
``ALLOW_INSIDE``, nor spans inside a base span.

Positions are code points, ends exclusive. Null text counts as empty and has no spans; rows
are independent, so repeated rows repeat their result; an empty table gives none. Other columns of any name pass through.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import packed, unpacked

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper", "entropy_alnum")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Class alphabet and least entropy in bits of a window: a smaller alphabet has a lower limit, since its random windows repeat more.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 3.0),
    "entropy_base64": (_UPPER + _LOWER + _DIGITS + "+/=_-", 3.8),
    "entropy_lower": (_LOWER + _DIGITS, 3.4),
    "entropy_upper": (_UPPER + _DIGITS, 3.35),
    "entropy_alnum": (_UPPER + _LOWER + _DIGITS, 3.6),
}
#: Harmless candidates, each as a whole: numbers, UUIDs, words joined by marks with a short number.
ALLOW = (
    r"^[0-9=+/_-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9]*[/_=+-]*[A-Za-z][A-Za-z/_=+-]*[0-9]{0,4}$",
)
#: Harmless stretches inside a candidate, from the left: digits and letters in order, one character repeated. No window may overlap one.
ALLOW_INSIDE = r"(?i:0123456789|abcdefghij)|(.)\1{7,}"


_SPAN = "start:int,k:int,end:int,kind:string"
#: Items of an array folded together; an append copies no more than one chunk and the list of chunks.
CHUNK = 256


def _pairs(text: Column, pattern: str) -> Column:
    """array<struct<gap, value>>: each match and what lies before it, then the rest of the text; null without a match."""
    return F.when(text.rlike(pattern), F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value")))


def _append_fold(items: Column, item: str, step) -> Column:
    """array<struct<item>> built by a left fold over items from position 0: step(at, x) gives the next position, whether to append, and what. Null items give an empty array."""
    none = f"array<struct<{item}>>"

    def one(acc: Column, x: Column) -> Column:
        at, keep, value = step(acc["at"], x)
        return F.struct(at.alias("at"), F.when(keep, F.concat(acc["out"], F.array(value))).otherwise(acc["out"]).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), F.expr(f"cast(array() as {none})").alias("out")), one)
        # The one-item array names the result, so that it is computed once.
        return F.get(F.transform(F.array(done), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), F.lit(0))

    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{none}>)").alias("out"))
    folded = F.flatten(F.aggregate(parts, zero, chunk, lambda acc: acc["out"]))
    return F.when(items.isNull() | (F.size(items) == 0), F.expr(f"cast(array() as {none})")).otherwise(folded)


def _blanked(value: Column, pattern: str) -> Column:
    """value with as many spaces in place of each match of pattern; a space is in no class."""
    blank = F.transform(_pairs(value, pattern), lambda x: F.concat(x["gap"], F.repeat(F.lit(" "), F.coalesce(F.length(x["value"]), F.lit(0)))))
    return F.coalesce(F.array_join(blank, ""), value)


def _placed(pairs: Column, kind: str, ok=None) -> Column:
    """array<struct<start, k, end, kind, value>> of all matches that satisfy ok, in order."""

    def step(at: Column, x: Column):
        start = at + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("k"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return end, x["value"].isNotNull() & (ok(x["value"]) if ok else F.lit(True)), span

    return _append_fold(pairs, f"{_SPAN},value:string", step)


def _uncovered(spans: Column) -> Column:
    """spans, in order, without the entropy spans that lie inside a base span; at holds the furthest end of base spans so far."""

    def step(at: Column, s: Column):
        base = s["k"] < 3
        return F.when(base, F.greatest(at, s["end"])).otherwise(at), base | (s["end"] > at), s

    return _append_fold(spans, _SPAN, step)


def _hot_windows(value: Column, alphabet: str, least: float, window: int) -> Column:
    """array<struct<start, end>>: merged windows of value inside the class whose entropy reaches least."""
    weigh = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.split(value, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(alphabet), c)))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    first = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(alphabet) + 1).alias("n"), F.lit(0.0).cast("double").alias("s"), F.expr("cast(array() as array<int>)").alias("last"), none.alias("out"))

    def step(acc: Column, code: Column) -> Column:
        # last holds the codes inside the window, oldest first; index 0 of n counts characters outside the class.
        full = F.size(acc["last"]) >= window
        gone = F.when(full, F.element_at(acc["last"], 1)).otherwise(F.lit(-1))
        i = acc["i"] + 1
        same = gone == code
        up, down = F.get(acc["n"], code), F.coalesce(F.get(acc["n"], gone), F.lit(0))
        s = F.when(same, acc["s"]).otherwise(acc["s"] + F.get(weigh, up + 1) - F.get(weigh, up) + F.when(full, F.get(weigh, down - 1) - F.get(weigh, down)).otherwise(F.lit(0.0)))
        n = F.when(same, acc["n"]).otherwise(F.transform(acc["n"], lambda v, j: v + F.when(j == code, 1).otherwise(0) - F.when(j == gone, 1).otherwise(0)))
        last = F.concat(F.when(full, F.slice(acc["last"], 2, window)).otherwise(acc["last"]), F.array(code))
        return F.struct(i.alias("i"), n.alias("n"), s.alias("s"), last.alias("last"), acc["out"].alias("out"))

    def judged(acc: Column, code: Column) -> Column:
        nxt = step(acc, code)
        hot = (nxt["i"] >= window) & (F.get(nxt["n"], F.lit(0)) == 0) & (F.lit(math.log2(window)) - nxt["s"] / window >= least)
        before = F.element_at(F.concat(F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))), acc["out"]), -1)
        joined = (F.size(acc["out"]) > 0) & (before["end"] >= nxt["i"] - window)
        span = F.struct(F.when(joined, before["start"]).otherwise(nxt["i"] - window).alias("start"), nxt["i"].alias("end"))
        kept = F.when(joined, F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0)))).otherwise(acc["out"])
        return nxt.withField("out", F.when(hot, F.concat(kept, F.array(span))).otherwise(acc["out"]))

    return F.aggregate(codes, first, judged, lambda acc: acc["out"])


def _found(docs: DataFrame, window: int, classes: dict[str, tuple[str, float]], allow: tuple[str, ...], inside: str) -> DataFrame:
    """row (all columns of docs), text, base and spans."""
    work = packed(docs, text=F.coalesce(F.col("text").cast("string"), F.lit("")))
    work = work.withColumns({f"pairs_{name}": _pairs(F.col("text"), pattern) for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("cand", CANDIDATE))})
    work = work.withColumns(
        {
            "assign": _placed(F.col("pairs_assign"), "assign", lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6),
            "access": _placed(F.col("pairs_access"), "access"),
            "hex": _placed(F.col("pairs_hex"), "hex"),
            "cand": _placed(F.col("pairs_cand"), "entropy_base64", lambda v: ~F.greatest(*[v.rlike(a) for a in allow]) if len(allow) > 1 else (~v.rlike(allow[0]) if allow else F.lit(True))),
        }
    )
    work = work.withColumn("cand", F.transform("cand", lambda c: c.withField("value", _blanked(c["value"], inside))))
    strip = lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))
    work = work.withColumn("base", F.transform(F.array_sort(F.concat("assign", "access", "hex")), strip))
    hot = []
    for kind, (alphabet, least) in classes.items():
        k = KINDS.index(kind)
        spans = F.flatten(
            F.transform(
                F.col("cand"),
                lambda c: F.transform(
                    F.when(c["value"].rlike(f"[{re.escape(alphabet)}]{{{window}}}"), _hot_windows(c["value"], alphabet, least, window)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)")), lambda s: F.struct((c["start"] + s["start"]).alias("start"), F.lit(k).alias("k"), (c["start"] + s["end"]).alias("end"), F.lit(kind).alias("kind"))
                ),
            )
        )
        hot.append(spans)
    work = work.withColumn("found", F.when(F.size("cand") > 0, F.array_sort(F.concat(F.col("base"), *hot))))
    every = F.when(F.col("found").isNotNull(), _uncovered(F.col("found"))).otherwise(F.col("base"))
    return work.select("row", "text", "base", every.alias("spans"))


def scan(docs: DataFrame, window: int = WINDOW, classes: dict[str, tuple[str, float]] = CLASSES, allow: tuple[str, ...] = ALLOW, inside: str = ALLOW_INSIDE, names: tuple[str, str] = ("base_spans", "spans")) -> DataFrame:
    """docs with two arrays of struct<start, k, end, kind> added or replaced: base spans, and all spans, by start, then kind in the order of KINDS."""
    return unpacked(_found(docs, window, classes, allow, inside), **dict(zip(names, (F.col("base"), F.col("spans")))))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns and rows, with each maximal stretch of overlapping spans in text replaced by mark, and n_chars, if there, set anew for changed texts."""
    found = _found(docs, WINDOW, CLASSES, ALLOW, ALLOW_INSIDE)

    def step(acc: Column, s: Column) -> Column:
        cut = s["start"] >= acc["at"]  # else it overlaps the stretch before
        out = F.when(cut, F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    text = F.aggregate(F.col("spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    new = found.withColumn("new", F.when(F.size("spans") > 0, text))
    cols = []
    for f in docs.schema.fields:
        old = F.col("row").getField(f.name)
        value = F.coalesce("new", old) if f.name == "text" else F.coalesce(F.length("new").cast(f.dataType), old) if f.name == "n_chars" else old
        cols.append(value.alias(f.name))
    return new.select(*cols)
