"""Numbers of members, teams and the whole cohort together, contexts of a bounded size, sprints in a course's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.stats import inequality

LEVELS = ("member", "team", "cohort")


def dashboards(facts: DataFrame, team: str, member: str, measures: dict[str, Column]) -> DataFrame:
    """level, team, member and the aggregates in ``measures``, of members, teams and the cohort from one pass over facts (grouping sets). A null team or member is a group of its own, told from a total by level."""
    keys = [F.col(team), F.col(member)]
    x = facts.groupingSets([keys, keys[:1], []], team, member)
    level = F.when(F.grouping_id() == 0, LEVELS[0]).when(F.grouping_id() == 1, LEVELS[1]).otherwise(LEVELS[2])
    out = x.agg(level.alias("level"), *[v.alias(k) for k, v in measures.items()])
    return out.select("level", F.col(team).alias("team"), F.col(member).alias("member"), *measures)


def all_inequality(members: DataFrame, facts: DataFrame, measures: dict[str, Column], least: int = 2) -> DataFrame:
    """team, metric, n, gini, hoover, cv, max_min_ratio over a team's members, for each measure; members without facts count as 0. members: team, member; facts: member and what the measures aggregate."""
    own = facts.groupBy(F.col("member").alias("__m")).agg(*[v.alias(k) for k, v in measures.items()])
    x = members.select("team", "member").distinct().join(own, F.col("member") == F.col("__m"), "left")
    metric = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias("value")) for k in measures]))
    return inequality(x.select("team", metric.alias("m")).select("team", "m.metric", "m.value"), ["team", "metric"], "value", least)


def truncate(text: Column, most: int | Column) -> Column:
    """At most ``most`` characters, then an ellipsis if some were cut."""
    most = most if isinstance(most, Column) else F.lit(most)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), most), F.lit("…")))


def packed_context(rows: DataFrame, by: list[str], order: list[Column], text: Column, budget: int) -> DataFrame:
    """by, rows (how many of a group's are in, whole or cut), all_rows, context: the group's texts in order, apart by line breaks, up to ``budget`` characters. A text that passes the budget is cut and ends in an ellipsis, so that the context then has exactly ``budget`` characters; later ones are left out. Null texts count as empty.

    A row takes a character at least, so a group's first ``budget`` rows are enough: others go before the shuffle (the filter on the row number limits each task's groups)."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = rows.select(*by, F.coalesce(text, F.lit("")).alias("__t"), F.row_number().over(w).alias("__i")).filter(F.col("__i") <= budget)
    end = F.sum(F.length("__t") + 1).over(Window.partitionBy(*by).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)) - 1
    x = x.withColumn("__end", end).withColumn("__room", budget - (F.col("__end") - F.length("__t"))).filter("__room > 0")
    cut = F.when(F.col("__end") <= budget, F.col("__t")).otherwise(F.concat(F.substring("__t", F.lit(1), (F.col("__room") - 1).cast("int")), F.lit("…")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("__i", cut.alias("t")))), lambda s: s["t"])
    got = x.groupBy(*by).agg(F.count("*").alias("rows"), F.array_join(parts, "\n").alias("context"))
    n = rows.groupBy(*[F.col(c).alias(f"{c}__n") for c in by]).agg(F.count("*").alias("all_rows"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}__n")) for c in by]
    return got.join(n, same).select(*by, "rows", "all_rows", "context")


def seconds(at: Column) -> Column:
    """Seconds since 1970 of a time without zone, which the session's zone doesn't touch."""
    return F.unix_date(at.cast("date")).cast("bigint") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at).cast("bigint")


def sprint_windows(courses: DataFrame, zone: str = "Europe/Madrid") -> DataFrame:
    """course, sprint (from 1), starts, ends (without zone, in UTC, both inside), hours: ``sprints`` windows of ``days`` local days from the local midnight of ``first_day``, up to the second before the next one. A window over a clock change has an hour less or more. courses: course, first_day (date), days, sprints."""
    x = courses.filter("sprints > 0 and days > 0 and first_day is not null").select("course", "first_day", "days", F.explode(F.sequence(F.lit(1), F.col("sprints").cast("int"))).alias("sprint"))
    utc = lambda n: F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_add("first_day", n.cast("int")).cast("timestamp_ntz"))
    starts, following = utc((F.col("sprint") - 1) * F.col("days")), utc(F.col("sprint") * F.col("days"))
    length = seconds(following) - seconds(starts)
    return x.select("course", "sprint", starts.alias("starts"), (following - F.expr("interval 1 second")).alias("ends"), (length / 3600).alias("hours"))


def window_problems(windows: DataFrame) -> DataFrame:
    """course, sprint, problem, seconds: windows that end before they start or lack an end (invalid), start later than a second after all earlier ones have ended (gap) or no later than one of them ends (overlap). windows: course, sprint, starts, ends."""
    good = F.col("starts").isNotNull() & F.col("ends").isNotNull() & (F.col("ends") >= F.col("starts"))
    earlier = Window.partitionBy("course").orderBy("starts", "ends", "sprint").rowsBetween(Window.unboundedPreceding, -1)
    x = windows.filter(good).withColumn("reached", F.max("ends").over(earlier))
    apart = seconds(F.col("starts")) - seconds(F.col("reached"))
    kind = F.when(apart > 1, "gap").when(apart <= 0, "overlap")
    size = F.when(apart > 1, apart - 1).otherwise(1 - apart)
    found = x.select("course", "sprint", kind.alias("problem"), size.alias("seconds")).filter("problem is not null")
    bad = windows.filter(~F.coalesce(good, F.lit(False))).select("course", "sprint", F.lit("invalid").alias("problem"), F.lit(None).cast("bigint").alias("seconds"))
    return found.unionByName(bad)


def temporal_spread(commits: DataFrame, windows: DataFrame, by: list[str], cramming_hours: int = 48) -> DataFrame:
    """by, course, sprint, early, mid, late, cramming, spread (the same as JSON): commits by third of their window; those from ``cramming_hours`` before its end on are cramming, also after it. commits: by, course, sprint, at; windows without a length, and commits without a time, count nothing. Times have no zone and are UTC."""
    w = windows.select(F.col("course").alias("c2"), F.col("sprint").alias("s2"), seconds(F.col("starts")).alias("a"), seconds(F.col("ends")).alias("z")).filter("z > a")
    x = commits.filter("at is not null").join(w, (F.col("course") == F.col("c2")) & (F.col("sprint") == F.col("s2")))
    at, third = seconds(F.col("at")).cast("double"), (F.col("z") - F.col("a")) / 3.0
    kind = F.when(at >= F.col("z") - cramming_hours * 3600, "cramming").when(at < F.col("a") + third, "early").when(at < F.col("a") + 2 * third, "mid").otherwise("late")
    kinds = ("early", "mid", "late", "cramming")
    n = x.withColumn("kind", kind).groupBy(*by, "course", "sprint").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return n.withColumn("spread", F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), F.col(k).cast("string")) for k in kinds]), F.lit("}")))


def left_out_deviation(features: DataFrame, least: int = 3) -> DataFrame:
    """author, file, feature, value (the file's mean), n (the author's other rows), mean, sd (sample) of these, z: |value - mean| / sd, 0 where sd is none. Files whose author has fewer than ``least`` other rows of a feature are left out. features: author, file, feature, value; rows with a null are skipped.

    The others' moments are the author's less the file's own, so no file is compared with each of the others."""
    x = features.filter("author is not null and value is not null").select("author", "file", "feature", F.col("value").cast("double").alias("v"))
    moments = lambda p: [F.count("*").alias(f"n{p}"), F.avg("v").alias(f"m{p}"), (F.var_pop("v") * F.count("*")).alias(f"q{p}")]
    own = x.groupBy("author", "file", "feature").agg(*moments("_f"))
    # An author's moments are merged from those of the files.
    n, mean = F.sum("n_f"), F.sum(F.col("n_f") * F.col("m_f")) / F.sum("n_f")
    whole = own.groupBy(F.col("author").alias("a2"), F.col("feature").alias("f2")).agg(n.alias("n_a"), mean.alias("m_a"))
    both = own.join(whole, (F.col("author") == F.col("a2")) & F.col("feature").eqNullSafe(F.col("f2"))).drop("a2", "f2")
    off = F.col("m_f") - F.col("m_a")
    q = both.groupBy(F.col("author").alias("a2"), F.col("feature").alias("f2")).agg(F.sum(F.col("q_f") + F.col("n_f") * off * off).alias("q_a"))
    both = both.join(q, (F.col("author") == F.col("a2")) & F.col("feature").eqNullSafe(F.col("f2")))
    rest = F.col("n_a") - F.col("n_f")
    both = both.filter(rest >= least).withColumns({"n": rest, "mean": F.col("m_a") - off * F.col("n_f") / rest})
    apart = F.col("m_f") - F.col("mean")
    left = F.greatest(F.col("q_a") - F.col("q_f") - apart * apart * F.col("n_f") * F.col("n") / F.col("n_a"), F.lit(0.0))
    sd = F.sqrt(left / F.greatest(F.col("n") - 1, F.lit(1)))
    return both.withColumn("sd", sd).select("author", "file", "feature", F.col("m_f").alias("value"), "n", "mean", "sd", F.when(F.col("sd") < 1e-9, 0.0).otherwise(F.abs(apart) / F.col("sd")).alias("z"))
