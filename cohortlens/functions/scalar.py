"""Scalar column functions: guarded arithmetic, bands, maps and grids."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def safe_divide(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, ``default`` where b is 0 or null."""
    return F.when(b.isNull() | (b == 0), F.lit(default).cast("double")).otherwise(a / F.when(b != 0, b))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def linear_map(x: Column, x0: Column | float, x1: Column | float, y0: float, y1: float) -> Column:
    """Maps x0..x1 to y0..y1; the middle of y where the span is 0."""
    x0, x1 = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x0, x1))
    return F.when(x1 == x0, F.lit((y0 + y1) / 2)).otherwise(F.lit(y0) + (x - x0) * (y1 - y0) / F.when(x1 != x0, x1 - x0))


def absolute_map(x: Column, low: float, high: float) -> Column:
    """Position between two anchors on a scale of 0 to 10, clamped."""
    return clamp(linear_map(x, low, high, 0.0, 10.0), 0.0, 10.0)


def hybrid_normalize(x: Column, p10: Column, p90: Column, floor: Column | float, ceiling: Column | float) -> Column:
    """0..2 below p10 down to the floor, 2..8 between the percentiles, 8..10 above up to the ceiling; 5 in a flat cohort."""
    mid = linear_map(x, p10, p90, 2.0, 8.0)
    low, high = clamp(linear_map(x, floor, p10, 0.0, 2.0), 0.0, 2.0), clamp(linear_map(x, p90, ceiling, 8.0, 10.0), 8.0, 10.0)
    return F.when(p10 == p90, F.lit(5.0)).when(x < p10, low).when(x > p90, high).otherwise(mid)


def sigmoid(x: Column, slope: float, middle: float, nonpositive: float | None = None) -> Column:
    """1 / (1 + exp(-slope (x - middle))); a fixed value for x <= 0 if given."""
    y = 1 / (1 + F.exp(-slope * (x - middle)))
    return y if nonpositive is None else F.when(x <= 0, F.lit(nonpositive)).otherwise(y)


def banded(x: Column, bands: list[tuple[float, str]], last: str) -> Column:
    """The first band whose lower bound x reaches; ``last`` below all; null for null."""
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(reduce(lambda c, b: c.when(x >= b[0], b[1]), bands[1:], F.when(x >= bands[0][0], bands[0][1])).otherwise(last))


def snap(x: Column, levels: list[float]) -> Column:
    """The nearest level, the first on ties; the lowest for NaN."""
    best = F.array_min(F.array(*[F.struct(F.abs(x - v).alias("d"), F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(levels)]))["v"]
    return F.when(F.isnan(x.cast("double")), F.lit(float(min(levels)))).otherwise(best)


def quantize(x: Column, step: float) -> Column:
    """The nearest multiple of step, halves up."""
    return F.floor(x / step + 0.5) * step


def maintainability_index(volume: Column, complexity: Column, loc: Column, comment_share: Column) -> Column:
    """171 - 5.2 ln V - 0.23 CC - 16.2 ln LOC + 50 sin sqrt(2.4 c), clamped to 0..100; 100 where V or LOC <= 0."""
    ok = (volume > 0) & (loc > 0)
    raw = 171 - 5.2 * F.ln(F.when(ok, volume)) - 0.23 * complexity - 16.2 * F.ln(F.when(ok, loc)) + 50 * F.sin(F.sqrt(2.4 * comment_share))
    return F.when(ok, clamp(raw, 0.0, 100.0)).otherwise(F.lit(100.0))


def dot(values: Column, weights: list[float], intercept: float = 0.0) -> Column:
    """intercept + sum of weights times values; NaN if the lengths differ."""
    pairs = F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a.cast("double") * b)
    total = F.aggregate(pairs, F.lit(float(intercept)), lambda acc, x: acc + x)
    return F.when(F.size(values) == len(weights), total).otherwise(F.lit(float("nan")))


def weighted_fusion(signals: dict[str, tuple[Column, float]], clamp_to: tuple[float, float] | None = None) -> tuple[Column, Column]:
    """(mean over the signals that are not null, weights renormalised; how many there are). Null if there is none."""
    # greatest and least skip nulls, so a missing signal must not reach them.
    fit = {k: (F.when(v.isNotNull(), clamp(v, *clamp_to)) if clamp_to else v, w) for k, (v, w) in signals.items()}
    total = reduce(lambda a, b: a + b, [F.coalesce(v * w, F.lit(0.0)) for v, w in fit.values()])
    weight = reduce(lambda a, b: a + b, [F.when(v.isNull(), F.lit(0.0)).otherwise(F.lit(float(w))) for v, w in fit.values()])
    count = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v, _ in fit.values()])
    return safe_divide(total, weight, None), count


def minutes_of(text: Column) -> Column:
    """Minutes of an interval such as 15m, 3h or 2d; null for other text."""
    n, unit = F.regexp_extract(text, r"^(\d+)[mhd]$", 1), F.regexp_extract(text, r"^\d+([mhd])$", 1)
    return F.try_to_number(n, F.lit("9999999999")).cast("bigint") * F.when(unit == "m", 1).when(unit == "h", 60).when(unit == "d", 1440)


def round_half_even(digits: int):
    """A column function that rounds the exact binary value to digits, halves to even, as formatting does; JVM rounding goes by the shortest decimal text instead. NaN and infinities stay."""

    @F.pandas_udf(DoubleType())
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if pd.isna(v) or v in (float("inf"), float("-inf")) else round(v, digits))

    return rounded


def round_half_away(x: Column, digits: int, step: float = 0.0) -> Column:
    """Halves away from zero, by scaling; then to the nearest multiple of step if that is above 0."""
    away = lambda v: F.signum(v) * F.floor(F.abs(v) + 0.5)
    out = away(x * 10.0**digits) / 10.0**digits
    return away(out / step) * step if step > 0 else out


def format_float(x: Column, digits: int) -> Column:
    """Up to ``digits`` decimals, none if the rounded value is whole; None for null."""
    text = F.format_string(f"%.{digits}f", x)
    whole = text.rlike(r"^-?\d+(\.0*)?$")
    return F.when(x.isNull(), "None").when(whole, F.regexp_replace(text, r"\..*$", "")).otherwise(text)


def parse_iso(text: Column) -> Column:
    """Timestamp of RFC 3339 text with an offset, or of YYYY-MM-DDThh:mm with a Z; null for other text."""
    full = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    minute = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}Z$"
    return F.when(text.rlike(full), F.try_to_timestamp(F.upper(text))).when(text.rlike(minute), F.try_to_timestamp(F.regexp_replace(text, "Z$", ":00Z")))


def day_offset(at: Column, anchor: Column) -> Column:
    """Whole days from anchor, rounded down also before it."""
    return F.floor((F.unix_seconds(at) - F.unix_seconds(anchor)) / 86400)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_seconds(later) - F.unix_seconds(earlier)) / 3600.0


def local_time(text: Column, zone: str = "Europe/Madrid", names: tuple[str, str] = ("CET", "CEST")) -> Column:
    """1 March 2026, 09:05 CET: ISO text in a zone's own time, with its winter and summer names; other text as it is."""
    at = parse_iso(text)
    local = F.from_utc_timestamp(at, zone)
    summer = F.unix_seconds(local) - F.unix_seconds(at) > 3600
    return F.coalesce(F.concat(F.date_format(local, "d MMMM yyyy, HH:mm "), F.when(summer, names[1]).otherwise(names[0])), text)


def first_time(at: Column) -> Column:
    """Aggregate: the least time above 0, in seconds; null if there is none."""
    return F.min(F.when(at > 0, at))


def nearest_rank(values: Column, percent: int) -> Column:
    """Of an array, the item at (percent * n - 1) // 100 in order; 0 for an empty one."""
    n, ordered = F.size(values), F.array_sort(values)
    at = F.floor(F.greatest(F.lit(percent) * n - 1, F.lit(0)) / 100)
    return F.when(n > 0, F.get(ordered, F.least(at, n - 1).cast("int"))).otherwise(0)


def jittered(thresholds: dict[str, float], day: str, course: int, share: float = 0.1) -> dict[str, float]:
    """Thresholds moved by up to ``share`` of themselves, the same all day for a course: SplitMix64 over a digest of day, course and name."""
    import hashlib

    out = {}
    for name, value in sorted(thresholds.items()):
        x = int.from_bytes(hashlib.sha256(f"{day}|{course}|{name}".encode()).digest()[:8], "big")
        x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & (2**64 - 1)
        out[name] = value * (1 + share * (2 * ((x ^ (x >> 31)) / 2**64) - 1))
    return out
