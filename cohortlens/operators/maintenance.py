"""Table maintenance: checksums, diffs, merges and scoped purges, each from one table to the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(c: str, kind: str) -> Column:
    """A text for each cell in which null, NaN, infinities and values differ."""
    x = F.col(c)
    if kind in ("double", "float"):
        x = F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "+INF").otherwise("-INF")).otherwise(x.cast("string"))
    return F.coalesce(x.cast("string"), F.lit("\u0000NULL"))


def checksum(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """rows and an order-independent digest: the sum of 64 bits of each row's SHA-256, so it needs no sort and combines on the map side."""
    cols = sorted(set(df.columns) - set(ignore))
    kinds = dict(df.dtypes)
    row = F.sha2(F.concat_ws("\u001f", *[cell(c, kinds[c]) for c in cols]), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(part.alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))


def diff(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """keys and status: ONLY-A, ONLY-B or DIFF, for rows that are not equal; null keys match null keys. Numbers may differ by ``tolerance``, absolute or relative."""
    values = [c for c in a.columns if c not in keys]
    kinds = dict(a.dtypes)
    x = a.select(*keys, F.struct(*values).alias("a"), F.lit(True).alias("in_a"))
    y = b.select(*[F.col(k).alias(f"{k}__b") for k in keys], F.struct(*values).alias("b"), F.lit(True).alias("in_b"))
    both = x.join(y, [F.col(k).eqNullSafe(F.col(f"{k}__b")) for k in keys], "full")
    # A null key of a matched pair is null on both sides.
    both = both.withColumns({k: F.coalesce(k, f"{k}__b") for k in keys})

    def same(c: str) -> Column:
        p, q = F.col("a")[c], F.col("b")[c]
        eq = p.eqNullSafe(q)
        if tolerance and kinds[c] in ("double", "float"):
            eq = eq | F.coalesce(F.abs(p - q) <= tolerance * F.greatest(F.lit(1.0), F.abs(p), F.abs(q)), F.lit(False))
        return eq

    equal = F.lit(True)
    for c in values:
        equal = equal & same(c)
    status = F.when(F.col("in_b").isNull(), "ONLY-A").when(F.col("in_a").isNull(), "ONLY-B").when(~equal, "DIFF")
    return both.select(*keys, status.alias("status")).filter("status is not null")


def compare(a: dict[str, DataFrame], b: dict[str, DataFrame], ignore: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Two stores table by table: name, rows_a, rows_b, status (OK, COUNT, CHECKSUM, ONLY-A or ONLY-B). Columns in ``ignore`` don't count. Each table is read once and summed up where it lies; no rows of the two sides meet."""
    ignore = ignore or {}

    def sums(tables: dict[str, DataFrame], side: str) -> DataFrame:
        one = [checksum(df, ignore.get(name, ())).select(F.lit(name).alias(f"name_{side}"), F.col("n_rows").alias(f"rows_{side}"), F.col("digest").alias(f"digest_{side}")) for name, df in tables.items()]
        return reduce(DataFrame.unionByName, one)

    x = sums(a, "a").join(sums(b, "b"), F.col("name_a") == F.col("name_b"), "full")
    status = F.when(F.col("name_b").isNull(), "ONLY-A").when(F.col("name_a").isNull(), "ONLY-B")
    status = status.when(F.col("rows_a") != F.col("rows_b"), "COUNT").when(F.col("digest_a") != F.col("digest_b"), "CHECKSUM").otherwise("OK")
    count = lambda side: F.when(F.col(f"name_{side}").isNotNull() & F.col("name_a").isNotNull() & F.col("name_b").isNotNull(), F.col(f"rows_{side}")).alias(f"rows_{side}")
    return x.select(F.coalesce("name_a", "name_b").alias("name"), count("a"), count("b"), status.alias("status"))


def cell_diffs(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 0.0, ignore: tuple[str, ...] = ()) -> DataFrame:
    """keys, column, a, b: each cell that differs between rows of the same keys, both values as text (null: null). Nulls equal nulls, NaN equals NaN; numbers may differ by ``tolerance``, absolute or relative. Rows of one side only are for ``diff``."""
    values = [c for c in a.columns if c not in {*keys, *ignore} and c in b.columns]
    kinds = dict(a.dtypes)
    x = a.select(*keys, F.struct(*values).alias("a"))
    y = b.select(*[F.col(k).alias(f"{k}__b") for k in keys], F.struct(*values).alias("b"))
    both = x.join(y, [F.col(k).eqNullSafe(F.col(f"{k}__b")) for k in keys])

    def cell_of(c: str) -> Column:
        p, q = F.col("a")[c], F.col("b")[c]
        same = p.eqNullSafe(q)
        if tolerance and kinds[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(p - q) <= tolerance * F.greatest(F.lit(1.0), F.abs(p), F.abs(q)), F.lit(False))
        return F.when(~same, F.struct(F.lit(c).alias("column"), p.cast("string").alias("a"), q.cast("string").alias("b")))

    cells = F.array_compact(F.array(*[cell_of(c) for c in values]))
    return both.select(*keys, F.explode(cells).alias("d")).select(*keys, "d.*")


def remove_missing(old: DataFrame, scopes: DataFrame, listed: DataFrame, scope: str, key: str) -> DataFrame:
    """old without rows of the scopes (such as sprints) fetched anew whose key is no longer listed there; a scope that lists none loses all its rows, others keep theirs. scopes: scope; listed: scope, key."""
    there = listed.select(F.col(scope).alias("__s"), F.col(key).alias("__k")).distinct()
    fetched = scopes.select(F.col(scope).alias("__f")).distinct()
    gone = old.join(fetched, F.col(scope) == F.col("__f"), "left_semi").select(F.col(scope).alias("__s"), F.col(key).alias("__k")).distinct()
    gone = gone.join(there.withColumnsRenamed({"__s": "__s2", "__k": "__k2"}), F.col("__s").eqNullSafe(F.col("__s2")) & F.col("__k").eqNullSafe(F.col("__k2")), "left_anti")
    return old.join(gone, F.col(scope).eqNullSafe(F.col("__s")) & F.col(key).eqNullSafe(F.col("__k")), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: str = "replace") -> DataFrame:
    """The merged table. policy: replace (the new row wins), ignore (the old row wins) or coalesce (new values where not null, column by column). Both sides hold each key once; null keys match null keys."""
    if policy in ("replace", "ignore"):
        win, lose = (new, old) if policy == "replace" else (old, new)
        known = win.select(*[F.col(k).alias(f"{k}__w") for k in keys])
        return win.unionByName(lose.join(known, [F.col(k).eqNullSafe(F.col(f"{k}__w")) for k in keys], "left_anti").select(*win.columns))
    x = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    return x.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key; ties by all columns."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version), *sorted(set(df.columns) - {*keys, version}))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def replace_slice(old: DataFrame, new: DataFrame, grain: list[str]) -> DataFrame:
    """Idempotent rewrite: rows of the slices that new holds are replaced by new's."""
    return old.join(new.select(*grain).distinct(), grain, "left_anti").unionByName(new)


def purge(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], root: str, doomed: DataFrame) -> dict[str, DataFrame]:
    """Cascading delete: links are (child, child column, parent, parent column), parents first; doomed are rows of the root. Returns the tables without what hangs on them."""
    gone = {root: doomed}
    for child, cc, parent, pc in links:
        if parent in gone:
            hit = tables[child].join(gone[parent].select(F.col(pc).alias("__p")).distinct(), F.col(cc) == F.col("__p"), "left_semi")
            gone[child] = gone[child].unionByName(hit) if child in gone else hit
    out = {}
    for name, table in tables.items():
        if name in gone:  # rows are told by all their columns, nulls included
            dead = gone[name].select(*[F.col(f"`{c}`").alias(f"{c}__g") for c in table.columns]).distinct()
            table = table.join(dead, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{c}__g`")) for c in table.columns], "left_anti")
        out[name] = table
    return out


def doomed_counts(tables: dict[str, DataFrame], left: dict[str, DataFrame]) -> DataFrame:
    """What a purge would delete, without deleting: name, rows, doomed."""
    one = lambda name: tables[name].agg(F.lit(name).alias("name"), F.count("*").alias("rows")).join(left[name].agg(F.count("*").alias("kept")))  # noqa: E731  one row each
    every = [one(name).select("name", "rows", (F.col("rows") - F.col("kept")).alias("doomed")) for name in tables]
    return reduce(DataFrame.unionByName, every)


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows whose version differs from what was last seen, or that were never seen."""
    s = seen.select(*keys, F.col(version).alias("__v"))
    return rows.join(s, keys, "left").filter(~F.col(version).eqNullSafe(F.col("__v"))).drop("__v")


def key_candidates(df: DataFrame, columns: list[list[str]]) -> DataFrame:
    """Which sets of columns name rows: columns (comma-joined), rows, distinct, nulls (rows with a null in them), unique (no nulls and all distinct). One pass for all sets."""
    one = []
    for cs in columns:
        null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cs])
        one.append(F.struct(F.lit(",".join(cs)).alias("columns"), F.count("*").alias("rows"), F.countDistinct(F.when(~null, F.struct(*cs))).alias("distinct"), F.count_if(null).alias("nulls")))
    x = df.agg(*[s.alias(f"c{i}") for i, s in enumerate(one)])
    x = x.select(F.explode(F.array(*[f"c{i}" for i in range(len(one))])).alias("c")).select("c.*")
    return x.withColumn("unique", (F.col("nulls") == 0) & (F.col("distinct") == F.col("rows")))


def reset_scores(table: DataFrame, scope: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """table with ``columns`` set to null in the rows whose keys are in scope."""
    inside = scope.select(*[F.col(k).alias(f"{k}__s") for k in keys]).distinct().withColumn("__in", F.lit(True))
    x = table.join(inside, [F.col(k).eqNullSafe(F.col(f"{k}__s")) for k in keys], "left")
    return x.select(*[F.when(F.col("__in"), F.lit(None)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def purge_cache(cache: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """The cache without entries that nothing uses any more."""
    return cache.join(used.select(*[F.col(k).alias(f"{k}__u") for k in keys]).distinct(), [F.col(k).eqNullSafe(F.col(f"{k}__u")) for k in keys], "left_semi")
