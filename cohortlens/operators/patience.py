"""Line differences of whole sets of files by patience: unique lines anchor, only what lies between anchors is compared.

1. Lines that a segment (at first the file) has once on both sides meet by a join on file, segment and line.
2. Of these anchors the longest run that keeps its order on both sides stays (a task's rows are one file's anchors, two
   numbers each).
3. Anchors cut the file in smaller segments, in which more lines are unique; this goes on until no segment has a new anchor.
4. What is left on both sides of a segment is compared by longest common subsequence, 64 lines a machine word, in halves once
   rows of bits would take too much memory.

Lines are compared by a 64-bit hash and their length. Where all lines of a file are unique, or only lines between anchors
repeat, the result is a longest common subsequence; else it can match fewer lines, as patience does. A round carries on
only lines that can still be matched. A null text is a file that isn't there;
an empty one has one empty line. A path given more than once counts once (its greatest text).
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.sources.scratch import written

#: Bytes of stored rows of bits up to which a comparison isn't halved.
ROW_BYTES = 64 << 20


def longest_increasing(x: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(x):
        k = bisect_left(ends, v)
        before.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(v)
            at.append(i)
        else:
            ends[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _places(a: list) -> dict:
    """For each value of a, a number whose bits are its places."""
    out: dict = {}
    for i, v in enumerate(a):
        out[v] = out.get(v, 0) | 1 << i
    return out


def common_length(a: list, b: list) -> int:
    """The length of a longest common subsequence: a row of bits for each item of b."""
    places, full = _places(a), (1 << len(a)) - 1
    row = full
    for v in b:
        if u := row & places.get(v, 0):
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _prefix_lengths(a: list, b: list) -> np.ndarray:
    """Common lengths of b with each prefix of a, the empty one first."""
    places, full = _places(a), (1 << len(a)) - 1
    row = full
    for v in b:
        if u := row & places.get(v, 0):
            row = (row + u | row - u) & full
    bits = np.unpackbits(np.frombuffer((full ^ row).to_bytes(len(a) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(bits.astype(np.int64))])


def matched(a: list, b: list, limit: int = ROW_BYTES) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence."""
    if not a or not b:
        return []
    if len(b) > 1 and len(a) * len(b) // 8 > limit:
        half = len(b) // 2
        best = int(np.argmax(_prefix_lengths(a, b[:half]) + _prefix_lengths(a[::-1], b[half:][::-1])[::-1]))
        return matched(a[:best], b[:half], limit) + [(i + best, j + half) for i, j in matched(a[best:], b[half:], limit)]
    places, full = _places(a), (1 << len(a)) - 1
    rows = [full]
    for v in b:
        row = rows[-1]
        u = row & places.get(v, 0)
        rows.append((row + u | row - u) & full if u else row)
    out, i, j = [], len(a), len(b)
    while i and j:
        # A cleared bit of row j adds one to the length of the prefix that ends there.
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return out[::-1]


LINE = ("hash", "length")
#: A line of the template (side 0) or of the student's file (side 1), not matched yet; or an anchor (i, no) of side 1.
STATE = ("path", "side", "no", "segment", *LINE, "i")


def _sides(files: DataFrame) -> DataFrame:
    """path, side, no, hash, length, whole (hash of the file's text) of both texts (path, old, new), written: they are made and read once."""
    one = files.groupBy("path").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    texts = F.array(*[F.struct(F.lit(side).alias("side"), F.col(name).alias("text")) for side, name in enumerate(("old", "new"))])
    each = one.select("path", F.explode(texts).alias("t")).filter("t.text is not null")
    each = each.select("path", "t.side", F.xxhash64("t.text").alias("whole"), F.posexplode(F.split("t.text", "\n")))
    return written(each.select("path", "side", (F.col("pos") + 1).alias("no"), F.xxhash64("col").alias("hash"), F.length("col").alias("length"), "whole"))


def _both(template: DataFrame, student: DataFrame) -> DataFrame:
    old, new = (x.filter("text is not null").groupBy(F.col("path").alias(k)).agg(F.max("text").alias(name)) for x, k, name in ((template, "p0", "old"), (student, "p1", "new")))
    return old.join(new, F.col("p0") == F.col("p1"), "full").select(F.coalesce("p0", "p1").alias("path"), "old", "new")


def _files(sides: DataFrame) -> DataFrame:
    """path, old, new (numbers of lines, null where the file isn't there), same (whether both texts are equal)."""
    of = lambda side, v: F.when(F.col("side") == side, v)
    x = sides.groupBy("path").agg(F.max(of(0, F.col("no"))).alias("old"), F.max(of(1, F.col("no"))).alias("new"), F.max(of(0, F.col("whole"))).alias("w0"), F.max(of(1, F.col("whole"))).alias("w1"))
    return x.select("path", "old", "new", F.coalesce((F.col("old") == F.col("new")) & (F.col("w0") == F.col("w1")), F.lit(False)).alias("same"))


def _round(state: DataFrame) -> DataFrame:
    """New anchors, and the lines that can still be matched: those that repeat, on both sides of the segments cut by the anchors."""
    dealt = state.filter("i is null").drop("i").repartition("path")
    of = lambda side, v: F.when(F.col("side") == side, v)
    once = dealt.groupBy("path", "segment", *LINE).agg(F.count(of(0, F.col("no"))).alias("a"), F.count(of(1, F.col("no"))).alias("b"), F.min(of(0, F.col("no"))).alias("i"), F.min(of(1, F.col("no"))).alias("j"))
    met = once.filter("a = 1 and b = 1").select("path", "i", "j")

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pdf.iloc[longest_increasing(pdf["j"].tolist())][["path", "i", "j"]]

    # Segments follow each other on both sides, so a file's longest run is made of its segments' ones.
    anchors = met.groupBy("path").applyInPandas(keep, "path string, i int, j int")
    ends = anchors.select("path", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("i").alias("no")), F.struct(F.lit(1).alias("side"), F.col("j").alias("no")))).alias("e"), "i")
    # A met line that is no anchor crosses one (else the run could be longer), so its two ends part into other segments.
    same = Window.partitionBy("path", "segment", *LINE)
    repeats = dealt.withColumns({"a": F.count(of(0, F.col("no"))).over(same), "b": F.count(of(1, F.col("no"))).over(same)}).filter("a > 0 and b > 0 and a + b > 2").drop("a", "b")
    x = repeats.unionByName(ends.select("path", "e.side", "e.no", "i"), allowMissingColumns=True).repartition("path")
    # A segment bears the template's line number of the anchor before it.
    x = x.withColumn("before", F.max("i").over(Window.partitionBy("path", "side").orderBy("no")))
    x = x.filter("i is null or side = 1").withColumn("segment", F.when(F.col("i").isNull(), F.greatest("segment", "before")))
    x = x.withColumns({"least": F.min("side").over(same), "most": F.max("side").over(same)})
    return x.filter("i is not null or least != most").select(*STATE)


def _aligned(sides: DataFrame, rounds: int = 30) -> DataFrame:
    """path, i, j: matched lines. sides: path, side, no, hash, length, of files that both have."""
    state = sides.withColumns({"segment": F.lit(0), "i": F.lit(None).cast("int")}).select(*STATE)
    found = []
    for _ in range(rounds):
        state = written(_round(state))
        more = state.filter("i is not null")
        if not more.limit(1).count():
            break
        found.append(more.select("path", "i", F.col("no").alias("j")))
    left = state.filter("i is null")
    # What repeats is small but takes time to compare, so the number of tasks doesn't follow its bytes. Columns of their own for each side; a cogroup mixes up those that both have from one table.
    tasks = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    old, new = (left.filter(F.col("side") == side).select(*[F.col(c).alias(c) for c in ("path", "segment", "no", *LINE)]).repartition(tasks, "path") for side in (0, 1))

    def rest(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for x in (a, b):
            x = x.sort_values("no")
            x = x.iloc[np.argsort(x["segment"].to_numpy(), kind="stable")]
            segment, start = np.unique(x["segment"].to_numpy(), return_index=True)
            items = list(zip(x["no"].tolist(), zip(x["hash"].tolist(), x["length"].tolist())))
            sides.append({k: items[i:j] for k, i, j in zip(segment.tolist(), start.tolist(), [*start[1:].tolist(), len(items)])})
        out = []
        for k in sides[0].keys() & sides[1].keys():
            one, two = sides[0][k], sides[1][k]
            out += [(key[0], one[i][0], two[j][0]) for i, j in matched([v for _, v in one], [v for _, v in two])]
        return pd.DataFrame(out, columns=["path", "i", "j"])

    rest_of = old.groupBy("path").cogroup(new.groupBy("path")).applyInPandas(rest, "path string, i int, j int")
    return reduce(DataFrame.unionByName, found, rest_of)


def aligned(template: DataFrame, student: DataFrame, rounds: int = 30) -> DataFrame:
    """path, i, j: lines of the template's file that are matched with lines of the student's. Both: path, text."""
    sides = _sides(_both(template, student))
    return _aligned(sides.join(_files(sides).filter("old is not null and new is not null").select("path"), "path", "left_semi"), rounds)


def template_diff(template: DataFrame, student: DataFrame) -> DataFrame:
    """path, status (added, modified, template_only; files without an added line are left out), added_lines (how many of the student's lines the template lacks), added (their numbers), total_lines. Both: path, text."""
    return text_changes(_both(template, student))


def text_changes(texts: DataFrame) -> DataFrame:
    """The same of files with both texts in a row: path, old, new."""
    sides = _sides(texts)
    files = written(_files(sides))
    changed = files.filter("old is not null and new is not null and not same").select("path")
    found = _aligned(sides.join(changed, "path", "left_semi")).groupBy(F.col("path").alias("p2")).agg(F.collect_list("j").alias("js"))
    of = files.filter("new is not null and not same").join(found, F.col("path") == F.col("p2"), "left")
    none = F.expr("cast(array() as array<int>)")
    out = of.select("path", F.when(F.col("old").isNull(), "added").otherwise("modified").alias("status"), F.array_except(F.sequence(F.lit(1), "new"), F.coalesce("js", none)).alias("added"), F.col("new").cast("bigint").alias("total_lines"))
    out = out.select("path", "status", F.size("added").cast("bigint").alias("added_lines"), "added", "total_lines").filter("added_lines > 0")
    gone = files.filter("new is null").select("path", F.lit("template_only").alias("status"), F.lit(0).cast("bigint").alias("added_lines"), none.alias("added"), F.lit(0).cast("bigint").alias("total_lines"))
    return out.unionByName(gone)
