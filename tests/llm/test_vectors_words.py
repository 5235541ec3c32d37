"""Whitening, spelling variants and p-stable near-duplicates against brute force and SQL, with edge cases."""

import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import pstable, queries, spelling, whitening

VEC = "id bigint, label int, vec array<float>"


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors(spark):
    """Random vectors, groups of near copies at all angles around the threshold, exact copies, and rows that can't link."""
    rng = np.random.default_rng(5)
    base = unit(rng.standard_normal((60, 24)))
    near = [unit(base[i : i + 1] + scale * unit(rng.standard_normal((1, 24))))[0] for i in range(40) for scale in (0.05, 0.1, 0.19, 0.2, 0.21, 0.3)]
    hot = unit(base[:1] + 0.08 * unit(rng.standard_normal((90, 24))))
    many = np.concatenate([base, near, hot, base[:10], base[:10], 3 * base[10:15], np.tile(base[50], (30, 1))]).astype(np.float32)
    rows = [(i, int(i % 2), v.tolist()) for i, v in enumerate(many)]
    rows += [(900, 1, None), (901, 1, []), (902, 1, [0.0] * 24), (903, 1, [1.0] * 23 + [None]), (904, 1, [1.0] * 23 + [float("nan")]), (905, 1, [float("inf")] * 24), (906, None, many[0].tolist()), (907, 1, [1.0] * 5)]
    return spark.createDataFrame(rows, VEC), rows


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)


def brute_links(rows, threshold=0.98):
    links, parent = Counter(), {r[0]: r[0] for r in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    good = [(i, x, np.asarray(v, dtype=np.float32).astype(float)) for i, x, v in rows if x is not None and usable(v) and any(v)]
    for (i, x, v), (j, y, w) in itertools.combinations(good, 2):
        if x == y and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= threshold:
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return links, {i: find(i) for i in parent}


@pytest.mark.parametrize("block", [2048, 16])
def test_near_vectors_equal_brute_force(vectors, block):
    df, rows = vectors
    links, least = brute_links(rows)
    assert sum(links.values()) > 2000
    got = {r.id: r for r in pstable.near_vectors(df.withColumn("key", F.lit(1)).withColumn("bucket", F.lit("x")), block=block).collect()}
    assert {i: r.n_links for i, r in got.items()} == {r[0]: links[r[0]] for r in rows}
    assert {i: r.component_id for i, r in got.items()} == least
    assert all(r.kept == (r.id == r.component_id) for r in got.values())


def test_near_vectors_sql(spark, vectors, tmp_path):
    df, _ = vectors
    df = df.filter("id not in (900, 901, 907)").select(F.col("id").alias("vec_id"), F.col("vec").alias("embedding"), "label")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"select vec_id, n_links, component_id, kept, copies from ({queries.ORACLE['op13_embedding_near_dedup']})").fetchall()
    got = queries.op13_embedding_near_dedup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept", "copies").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_near_vectors_edge_cases(spark):
    assert pstable.near_vectors(spark.createDataFrame([], VEC)).count() == 0
    rows = [(None, 1, [1.0, 2.0]), (3, 1, [1.0, 2.0]), (3, 1, [1.0, 2.0]), (None, None, None), (5, 1, [1e-30, 2e-30]), (6, 1, [-0.0, 1.0]), (7, 1, [0.0, 1.0]), (8, 2, [0.0, 1.0])]
    got = sorted(((r.id or 0), r.n_links, r.component_id or 0, r.kept) for r in pstable.near_vectors(spark.createDataFrame(rows, VEC)).collect())
    assert got == [(0, 0, 0, True), (0, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (5, 3, 3, False), (6, 1, 6, True), (7, 1, 6, False), (8, 0, 8, True)]


def test_tables_reach_recall():
    hashes, tables = pstable.choose_tables(1000)
    rng = np.random.default_rng(1)
    x = unit(rng.standard_normal((4000, 64)))
    y = unit(x + 0.2 * unit(rng.standard_normal((4000, 64))))
    cos = (x * y).sum(axis=1)
    y = unit(y + (cos < 0.98)[:, None] * 0.05 * x)
    t = pstable.Tables(64, hashes, tables)
    a, b = (t.buckets(v, np.zeros(4000, dtype=np.uint64)) for v in (x, y))
    assert (a == b).any(axis=1).mean() > 0.999
    met = (a == b[::-1]).mean(axis=0).mean() * 1000
    assert met < 0.2  # strangers in a table


def brute_whitening(vecs, k=4):
    x = np.floor(256 * np.asarray(vecs, dtype=np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    values, v = np.linalg.eigh(y.T @ y / n)
    values, v = values[::-1], v[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ v[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    v = (rng.standard_normal((300, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2]) + 7).astype(np.float32)
    v = np.concatenate([v, v[:50], v[:1].repeat(40, axis=0)])
    bad = [(1001, 0, None), (1002, 0, [1.0] * 5 + [None]), (1003, 0, [float("nan")] * 6), (1004, 0, []), (1005, 0, [1.0] * 5)]
    df = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)] + bad, VEC).withColumn("x", F.lit(1)).withColumn("d", F.lit("x"))
    got = whitening.whiten(df.repartition(5)).orderBy("id", "component").collect()
    n, dev, white, explained = brute_whitening(v)
    assert [(r.id, r.component) for r in got] == [(i, c) for i in range(len(v)) for c in (1, 2, 3, 4)]
    assert {r.n for r in got} == {n} and [int(r.deviation) for r in got[::4]] == dev.tolist()
    w = np.array([r.whitened for r in got]).reshape(-1, 4)
    assert np.allclose(w * np.sign((w * white).sum(axis=0)), white, atol=1e-9)
    assert np.allclose([r.explained for r in got[:4]], explained, rtol=1e-9) and got[0].identity_error < 1e-9


def test_whitening_edge_cases(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, VEC)).orderBy("id", "component").collect()
    assert make([]) == [] and make([(1, 0, None)]) == []
    one = make([(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0])])
    assert [(r.id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    flat = make([(1, 0, [1.0, 2.0]), (2, 0, [3.0, 2.0]), (None, 0, [1.0, 2.0])])  # one constant dimension, a null id
    assert [r.whitened for r in flat if r.component == 2] == [None] * 3 and sorted(round(abs(r.whitened), 9) for r in flat if r.component == 1) == [1.0] * 3
    huge = make([(1, 0, [1e30, 0.0]), (2, 0, [-1e30, 0.5]), (3, 0, [0.0, 0.0])])  # entries count as 2**22 at most
    limit = 1 << 30
    assert [int(r.deviation) for r in huge[::2]] == [(3 * limit) ** 2 + 128**2, (3 * limit) ** 2 + (3 * 128 - 128) ** 2, 128**2]


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[1 << 30, -5], [3, 7]])
    n, s = 10**9, [12345678901234567, -17]
    assert whitening.deviations(x, n, s) == [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x]


def brute_variants(words):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        found = [x for x in words if x != w and near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out[w] = (n, len(found))

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, k, words.get(form[w])) for w, (n, k) in out.items()}


def test_spelling_equals_brute_force(spark):
    rng = random.Random(3)
    letters = "abcdeéÉ×ÿ"
    words = Counter()
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        words[w] += rng.choice((5, 30, 200, 2000))
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(w))
            v = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]))
            words[v] += rng.choice((2, 5, 6, 40))
            words[w[::-1]] += 5  # the same letters in another order
            w = rng.choice((w, v))
    words.update({"qqqqqq": 5, "qqqqqr": 25, "qqqqsr": 125})  # a chain of forms
    words["anders" * 1_500] = words["anders" * 1_500 + "s"] = 7  # very long
    rows = [(w, n) for w, n in words.items()] + [(None, 9), ("", 50), ("nullen", None), ("zweimal", 3), ("zweimal", 2)]
    want = brute_variants({w: n for w, n in [*words.items(), ("zweimal", 5)] if len(w) >= 6 and n >= 5})
    got = spelling.variant_groups(spark.createDataFrame(rows, "word string, n bigint").withColumn("key", F.lit(1))).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert sum(v[0] is not None for v in want.values()) > 10 and any(v[0] and v[0] != v[1] for v in want.values())


def test_spelling_runs(spark):
    rows = [(1, "Ångström's ÉTÉ Straße x1y 東京abc"), (2, None), (3, ""), (None, "Word word WORD"), (5, "lettuce " * 3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("run", F.lit("clash"))
    got = Counter((r.doc_id, r.run) for r in spelling.runs(df).collect())
    assert got == {(1, w): 1 for w in ("Ångström", "s", "ÉtÉ", "straße", "x", "y", "abc")} | {(None, "word"): 3, (5, "lettuce"): 3000}
    cut = Counter(r.word for r in spelling.drop_letters(spelling.runs(df), every=3).collect())
    want = Counter()
    for (i, w), k in got.items():
        h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
        want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w] += k
    assert cut == want
    assert spelling.variant_groups(spark.createDataFrame([], "word string")).count() == 0


def test_powers_of_letters_tell_exchanges_apart():
    letters = [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]
    sums = Counter(a**5 + b**5 for a, b in itertools.combinations_with_replacement(letters, 2))
    assert max(sums.values()) == 1


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_embedding_near_dedup"])
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_query_11_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    t = duckdb.sql(f"select vec_id, embedding from '{folder}/embeddings.parquet' order by vec_id").fetchall()
    n, dev, white, explained = brute_whitening([v for _, v in t])
    got = queries.op11_embedding_whitening(spark, folder).orderBy("vec_id", "component").collect()
    assert [r.vec_id for r in got[::4]] == [i for i, _ in t] and [r.deviation for r in got[::4]] == dev.tolist() and got[0].n == n
    w = np.array([r.whitened for r in got]).reshape(-1, 4)
    assert np.allclose(w * np.sign((w * white).sum(axis=0)), white, atol=1e-8) and got[0].identity_error <= 1e-4
