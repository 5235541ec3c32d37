"""Who wrote the statements that a repository holds, and what of each sprint's work survives.

Files are (repo, path). Lines count from 1, both ends of a span or run belong to it. Spans and runs with a null or
reversed end overlap nothing. Everything is keyed by file and line bucket, so a repository, however large, is no
one task's row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scalar import safe_divide

FILE = ("repo", "path")
STATEMENT = (*FILE, "statement")
#: Lines of a bucket of the range join.
BUCKET = 128


def blame_runs(lines: DataFrame) -> DataFrame:
    """repo, path, first, last, commit, email: the maximal runs of successive lines of one commit and author. lines: repo, path, line_no, commit, email."""
    w = Window.partitionBy(*FILE, "commit", "email").orderBy("line_no")
    island = F.col("line_no") - F.row_number().over(w)
    x = lines.filter("line_no is not null").select(*FILE, "line_no", "commit", "email").distinct().withColumn("island", island)
    return x.groupBy(*FILE, "commit", "email", "island").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last")).drop("island")


def _met(spans: DataFrame, runs: DataFrame, bucket: int) -> DataFrame:
    """A row for each piece of a span that meets a piece of a run: repo, path, statement, b, commit, email, shared (lines), at (the first of them). Both are cut at the bounds of buckets of lines and meet by equality of file and bucket."""

    def cut(df: DataFrame, first: str, last: str) -> DataFrame:
        number = lambda c: F.floor(c / bucket)
        x = df.filter("first is not null and last >= first").withColumn("b", F.explode(F.sequence(number(F.col("first")), number(F.col("last")))))
        return x.withColumns({first: F.greatest("first", F.col("b") * bucket), last: F.least("last", F.col("b") * bucket + bucket - 1)})

    s = cut(spans.select(*STATEMENT, "first", "last"), "s1", "s2").select(*STATEMENT, "b", "s1", "s2")
    r = cut(runs.select(*FILE, "first", "last", "commit", "email"), "r1", "r2").select(*FILE, "b", "r1", "r2", "commit", "email")
    met = s.join(r, [*FILE, "b"]).filter("s1 <= r2 and r1 <= s2")
    return met.select(*STATEMENT, "b", "commit", "email", (F.least("s2", "r2") - F.greatest("s1", "r1") + 1).alias("shared"), F.greatest("s1", "r1").alias("at"))


def overlaps(spans: DataFrame, runs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Each span (repo, path, statement, first, last) with each run (repo, path, first, last, commit, email) it shares lines with: repo, path, statement, commit, email, lines, at (the first shared line).

    The pieces' shared lines are added up again, so no pair is met twice and no pair outside a bucket is looked at.
    """
    return _met(spans, runs, bucket).groupBy(*STATEMENT, "commit", "email").agg(F.sum("shared").cast("bigint").alias("lines"), F.min("at").cast("bigint").alias("at"))


def intervals(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """Spans (repo, path, statement, first, last) and runs (repo, path, first, last, commit, email) as rows of one frame, without what the other kind has: repo, path, first, last, is_run, statement, commit, email."""
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    place = [*FILE, F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last")]
    s = spans.select(*place, F.lit(False).alias("is_run"), "statement", none(runs, "commit"), none(runs, "email"))
    return s.unionByName(runs.select(*place, F.lit(True).alias("is_run"), none(spans, "statement"), "commit", "email"))


def blamed(lines: DataFrame, bucket: int = BUCKET, by: tuple[str, ...] = FILE, kept: tuple[str, ...] = ()) -> DataFrame:
    """The blame of each statement, of spans and runs as ``intervals`` has them: ``by``, statement, commit, email, unanimous, lines as in ``statement_blame``, and the columns ``kept`` of the statement's span. Without a column email, email and unanimous are not asked for.

    ``by`` begins with the file; what follows (a snapshot, say) keeps several histories of a file apart. Rows that lie
    together by file, or by repository, are not shuffled: a bucket's spans get its runs from a window, and all votes are
    counted where they were cast. So a file's rows are one task's (sorted, not held), and a bucket's runs one row's:
    a line has one commit, so these are no more than the bucket has lines.
    """
    statement, voters = [*by, "statement"], [c for c in ("commit", "email") if c in lines.columns]
    number = lambda c: F.floor(F.col(c) / bucket)
    x = lines.filter("repo is not null and path is not null and first is not null and last >= first").withColumn("b", F.explode(F.sequence(number("first"), number("last"))))
    x = x.withColumns({"first": F.greatest("first", F.col("b") * bucket), "last": F.least("last", F.col("b") * bucket + bucket - 1)})
    x = x.withColumn("runs", F.collect_list(F.when(F.col("is_run"), F.struct("first", "last", *voters))).over(Window.partitionBy(*by, "b"))).filter("not is_run")
    x = x.select(*statement, *kept, "first", "last", F.explode("runs").alias("r")).filter("first <= r.last and r.first <= last")
    votes = x.select(*statement, *kept, *[F.col(f"r.{c}").alias(c) for c in voters], (F.least("last", "r.last") - F.greatest("first", "r.first") + 1).alias("n"))
    if "email" in voters:
        votes = votes.withColumn("email", F.coalesce("email", F.lit("")))
    for c in voters:
        votes = votes.withColumn(f"by_{c}", F.sum("n").over(Window.partitionBy(*statement, c)))
    most = lambda of: F.min(F.struct((-F.col(f"by_{of}")).alias("minus"), F.col(of).alias("v")))["v"]
    authors = [F.nullif(most("email"), F.lit("")).alias("email"), (F.min("email") == F.max("email")).alias("unanimous")] if "email" in voters else []
    return votes.groupBy(*statement).agg(most("commit").alias("commit"), *authors, F.sum("n").alias("lines"), *[F.first(c).alias(c) for c in kept])


def statement_blame(spans: DataFrame, runs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """repo, path, statement, commit and email (each the one with most lines of the statement, ties to the lesser), unanimous (one author only), lines (blamed ones). Statements without a blamed line are left out. Lines without an author's address vote as such.

    Spans and runs are dealt out by file once; nothing is shuffled after that.
    """
    return blamed(intervals(spans, runs).repartition(*FILE), bucket)


def identity_keys(identities: DataFrame) -> DataFrame:
    """key, member, login: addresses and logins in lower case, logins also as the host's no-reply address. Of several entries of a key the least (member, then one with a login) counts. identities: member, kind (login, email), value."""
    login = F.when(F.col("kind") == "login", F.col("value"))
    lower = F.lower("value")
    keys = F.when(F.col("kind") == "login", F.array(lower, F.concat(lower, F.lit("@users.noreply.github.com")))).otherwise(F.array(lower))
    x = identities.filter("value is not null").select("member", login.alias("login"), F.explode(keys).alias("key"))
    return x.groupBy("key").agg(F.min(F.struct("member", F.col("login").isNull().alias("none"), "login")).alias("s")).select("key", "s.member", "s.login")


def resolve_authors(blames: DataFrame, commits: DataFrame, identities: DataFrame) -> DataFrame:
    """blames (commit, email) with pr (of the commit; the least if several have it), author (the commit's login, else the login of the address's member) and member. commits: sha, pr, login; identities: member, kind, value."""
    of = commits.filter("sha is not null").groupBy("sha").agg(F.min(F.struct("pr", "login")).alias("c")).select("sha", "c.pr", F.col("c.login").alias("own_login"))
    x = blames.join(of, F.col("commit") == F.col("sha"), "left").join(identity_keys(identities), F.lower("email") == F.col("key"), "left")
    return x.withColumn("author", F.coalesce("own_login", "login")).drop("sha", "key", "own_login", "login")


def stale_repos(before: DataFrame, now: DataFrame) -> DataFrame:
    """repo: those whose head differs from the one stored before, or that had none. Both: repo, head."""
    old = before.select(F.col("repo").alias("r2"), F.col("head").alias("h2"))
    return now.join(old, F.col("repo") == F.col("r2"), "left").filter(F.col("h2").isNull() | ~F.col("head").eqNullSafe(F.col("h2"))).select("repo")


def refreshed_blame(stored: DataFrame, before: DataFrame, now: DataFrame, spans: DataFrame, runs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The blame of all repositories in ``now`` (repo, head): stored rows where the head is that of ``before``, computed anew elsewhere; spans and runs of other repositories are not joined. What is stored of repositories that ``now`` lacks goes."""
    return refreshed(stored, before, now, intervals(spans, runs), bucket)


def refreshed(stored: DataFrame, before: DataFrame, now: DataFrame, lines: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``refreshed_blame`` of spans and runs as ``intervals`` has them."""
    stale = stale_repos(before, now)
    fresh = blamed(lines.join(stale, "repo", "left_semi"), bucket)
    kept = stored.join(now.select("repo"), "repo", "left_semi").join(stale, "repo", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


KINDS = ("raw", "normalized", "methods")


def surviving_at(fingerprints: DataFrame, commits: DataFrame, times: list[str]) -> DataFrame:
    """By pull request with a commit, for each of ``times``: raw_* (statements blamed on its commits), normalized_* and methods_* (distinct fingerprints of these), 0 without any. fingerprints: commit, normalized, method, and for each of ``times`` a column of the number of such statements; commits: pr, sha.

    Fingerprints go to their commits once and to the pull request once, whatever the number of times; both kinds are
    counted there as rows of their own, which distinct counts of two columns would shuffle in three copies.
    """
    of = commits.filter("pr is not null and sha is not null").select("pr", "sha").repartition("sha").distinct()
    x = of.join(fingerprints.select("commit", "normalized", "method", *times), F.col("sha") == F.col("commit"), "left").select("pr", "normalized", "method", *times).repartition("pr")
    value = [F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in (("normalized", "normalized"), ("methods", "method"))]
    x = x.select("pr", F.explode(F.array(*value)).alias("v"), *times).groupBy("pr", "v.kind", "v.value").agg(*[F.sum(c).alias(c) for c in times])
    count = lambda kind, n: F.coalesce(F.sum(F.when(F.col("kind") == kind, n)), F.lit(0)).cast("bigint")
    raw = [count("normalized", F.col(c)).alias(f"raw_{c}") for c in times]
    distinct = [count(kind, (F.col("value").isNotNull() & (F.col(c) > 0)).cast("int")).alias(f"{kind}_{c}") for kind in KINDS[1:] for c in times]
    return x.groupBy("pr").agg(*raw, *distinct)


def surviving(fingerprints: DataFrame, commits: DataFrame) -> DataFrame:
    """By pull request with a commit: raw (statements blamed on its commits), normalized and methods (distinct fingerprints of these), 0 without any. fingerprints: commit, normalized, method; commits: pr, sha."""
    x = surviving_at(fingerprints.select("commit", "normalized", "method", F.lit(1).alias("now")), commits, ["now"])
    return x.select("pr", *[F.col(f"{k}_now").alias(k) for k in KINDS])


def measured_again(now: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """By pull request: surviving_* of now, and added_*: what was added when first measured. before: pr, added_*; pull requests that now lacks go."""
    x = now.select("pr", *[F.col(k).alias(f"surviving_{k}") for k in KINDS])
    if before is None:
        return x.select("*", *[F.col(f"surviving_{k}").alias(f"added_{k}") for k in KINDS])
    old = before.select(F.col("pr").alias("p2"), *[F.col(f"added_{k}").alias(f"a_{k}") for k in KINDS])
    x = x.join(old, F.col("pr") == F.col("p2"), "left")
    first = lambda k: F.when(F.col("a_raw").isNull(), F.col(f"surviving_{k}")).otherwise(F.col(f"a_{k}"))
    return x.select("pr", *[F.col(f"surviving_{k}") for k in KINDS], *[first(k).alias(f"added_{k}") for k in KINDS])


def member_survival(prs: DataFrame, authors: DataFrame, points: DataFrame) -> DataFrame:
    """By member of ``authors``: sums of added_* and surviving_* (equal tuples of a member's pull requests count once), rate_raw and rate_normalized (0 without added ones), points and density (surviving normalized statements a point; 0 without points). authors: pr, member; points: member, points."""
    columns = [f"{what}_{k}" for what in ("added", "surviving") for k in KINDS]
    have = prs.select(F.col("pr").alias("p2"), *columns)
    rows = authors.select("pr", "member").join(have, F.col("pr") == F.col("p2"), "left").select("member", *columns).distinct()
    x = rows.groupBy("member").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in columns])
    known = points.groupBy(F.col("member").alias("m2")).agg(F.sum("points").alias("points"))
    x = x.join(known, F.col("member").eqNullSafe(F.col("m2")), "left").withColumn("points", F.coalesce("points", F.lit(0))).drop("m2")
    rate = lambda k: safe_divide(F.col(f"surviving_{k}"), F.col(f"added_{k}"))
    return x.withColumns({"rate_raw": rate("raw"), "rate_normalized": rate("normalized"), "density": safe_divide(F.col("surviving_normalized"), F.col("points"))})
