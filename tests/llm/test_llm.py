"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import chat_format, components, decontam, hmm_lm, jaccard_join, langid, license_scan, lsh_forest, mixing, queries, secret_scan, toxicity

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randint(1, 90)) for _ in range(60)]
    for _ in range(40):
        w = rng.choice(texts[:60]).split()
        w[rng.randrange(len(w))] = "zzz"
        texts.append(" ".join(w))
    texts += [texts[3]] * 5 + ["", None, "   ", "one two"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)] + [(None, texts[5], None, None, 0)]
    return spark.createDataFrame(rows, DOC), rows


def shingles(t, n=5):
    w = (t or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_jaccard_join_equals_brute_force(corpus):
    df, rows = corpus
    sets = [shingles(r[1]) for r in rows]
    links = Counter()
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
    for block in (512, 3):
        got = {r.doc_id: r for r in jaccard_join.near_duplicates(df, block=block).collect()}
        assert {r[0]: got[r[0]].n_links for r in rows} == {r[0]: links[i] for i, r in enumerate(rows)}
    kept = jaccard_join.deduplicate(df.withColumn("key", F.lit(1)).withColumn("u", F.lit(2)))
    assert kept.columns == [*df.columns, "key", "u"]
    groups = {got[r[0]].group_key for r in rows if sets[rows.index(r)]}
    assert kept.count() == len(groups) + 3


def test_jaccard_empty(spark):
    empty = spark.createDataFrame([], DOC)
    assert jaccard_join.near_duplicates(empty).count() == 0 and jaccard_join.deduplicate(empty).count() == 0


def test_bands_reach_recall():
    b, r = jaccard_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (60, 60)], "u bigint, v bigint")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}


def test_masks_hit_every_pattern():
    for w in (5, 9, 13, 20):
        masks = decontam.choose_masks([w])
        for bad in itertools.combinations(range(w), w // 5):
            assert any(not {o + s for o in m} & set(bad) for m in masks for s in range(w - m[-1])), (w, bad)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(i, words(rng, n)) for i, n in enumerate([30, 25, 12, 6, 3])] + [(9, None), (10, "")]
    docs = []
    for i in range(60):
        w = words(rng, rng.randint(0, 40)).split()
        _, t = rng.choice(items[:5])
        part = t.split()
        for _ in range(rng.randint(0, len(part) // 3)):
            part[rng.randrange(len(part))] = "qqq"
        docs.append((i, " ".join(w + part + w).upper() if i % 2 else " ".join(w)))
    docs += [(None, items[0][1]), (70, None)]

    def overlap(doc, item):
        d, t = (doc or "").lower().split(), (item or "").lower().split()
        w = min(20, len(t))
        return w > 0 and any(sum(x == y for x, y in zip(d[i : i + w], t[j : j + w])) >= w - w // 5 for i in range(len(d) - w + 1) for j in range(len(t) - w + 1))

    want = {(d, i) for d, t in docs for i, x in items if overlap(t, x)}
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for tokens in (500_000, 20):  # one block and several
        assert {(r.doc_id, r.item_id) for r in decontam.find_overlaps(df, bench, block_tokens=tokens).collect()} == want
    left = {r.doc_id for r in decontam.clean(df.withColumn("item_id", F.lit(1)), bench, block_tokens=20).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.find_overlaps(df, bench.limit(0)).count() == 0


def test_decontamination_of_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, "one two three four five six seven eight"), (None, None), (None, "")], "item_id long, text string")
    df = spark.createDataFrame([(1, "so ONE two three four five six seven eight"), (None, "one two three four five six seven eight"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted((tuple(r)[:2] for r in decontam.find_overlaps(df, bench).collect()), key=repr) == [(1, None), (None, None)]
    assert sorted(r.doc_id for r in decontam.clean(df, bench).collect()) == [3, 4]


def test_decontamination_of_repeated_words(spark):
    rng = random.Random(1)
    some = words(rng, 60).split()
    texts = ["a " * 300, "a b " * 150, "b " * 30 + " ".join(some) + " a" * 30, " ".join(some[:25]) + " a b" * 100 + " " + " ".join(some[20:50]), "c " * 300, None, ""]
    items = ["a " * 100, "b a " * 25, " ".join(some), "a " * 40 + " ".join(some[10:40]), "a a a"]

    def best(doc, item):
        d, t = (doc or "").split(), item.split()
        w, out = min(20, len(t)), None
        for shift in range(-len(t), len(d)):
            at = [j for j in range(len(t)) if 0 <= j + shift < len(d)]
            same = {j for j in at if d[j + shift] == t[j]}
            inside = {j + i for j in at for i in range(w) if j + w - 1 in at and len(same & set(range(j, j + w))) >= w - w // 5} & same
            if inside and (out is None or (-len(inside), min(inside) + shift) < (-out[0], out[1])):
                out = (len(inside), min(inside) + shift, max(inside) - min(inside) + 1)
        return out

    df = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string")
    got = defaultdict(list)
    for r in decontam.find_overlaps(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect():
        got[r.doc_id, r.item_id].append(tuple(r)[2:])
    want = {(i, j): [best(t, x)] * 2 for i, t in enumerate(texts) for j, x in enumerate(items) if best(t, x)}
    assert got == want
    index = decontam.SeedIndex([(0, "a " * 1000)])
    th = np.full(4000, index.th[0])
    began = time.time()
    assert index.overlaps(th, np.array([0, 4000]))[0, 0] == (1000, 0, 1000) and time.time() - began < 5


def secret_brute(text):
    base = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            base.append((m.start(), 0, m.end(), "assign"))
    for k, (kind, pattern, n) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        base += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= n]
    added = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        c = m[0]
        if len(c) < 20 or not re.search("[0-9]", c) or any(re.search(a, c) for a in secret_scan.ALLOW):
            continue
        for k, (kind, (alphabet, least)) in enumerate(secret_scan.CLASSES.items(), 3):
            spans = []
            for i in range(len(c) - 19):
                w = c[i : i + 20]
                h = math.log2(20) - sum(n * math.log2(n) for n in Counter(w).values()) / 20
                if set(w) <= set(alphabet) and h >= least - 1e-12:
                    if spans and spans[-1][1] >= i:
                        spans[-1][1] = i + 20
                    else:
                        spans.append([i, i + 20])
            added += [(m.start() + a, k, m.start() + b, kind) for a, b in spans]
    added = [s for s in added if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]
    return sorted(base), sorted(base + added)


def test_secret_scan_equals_brute_force(spark):
    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    some = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    texts = ["", None, "\U0001f600 token=token : abcdefgh", "Password: 'abcde' api_key=\"" + some(alphabet, 12), "AKIA" + some("ABC123", 16) + " AKIA" + some("AB1", 15), "é" + some("0123456789abcdef", 40) + "g", "key " + some(alphabet, 44) + " end", "x" * 60, "a-word-of-many-parts-2024", "12345678901234567890123", "0" * 24]
    texts += [" ".join(rng.choice([some(alphabet, rng.randint(5, 60)), some("0123456789abcdef", rng.randint(10, 50)), "secret = " + some("abc123", rng.randint(3, 9)), "wörd"]) for _ in range(12)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("spans0", F.lit(0))
    for r in secret_scan.scan(df).collect():
        base, every = secret_brute(texts[r.doc_id] or "")
        assert [tuple(s) for s in r.base_spans] == base and [tuple(s) for s in r.spans] == every, texts[r.doc_id]
    red = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert red[0] == "" and red[1] is None and red[6] == "key [SECRET] end" and len(red) == len(texts)


def test_secret_scan_recall_on_random_keys(spark):
    rng = random.Random(3)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = {"hex": digits + "abcdef", "lower": lower + digits, "base32": lower.upper() + "234567", "upper": lower.upper() + digits, "alnum": lower + lower.upper() + digits, "base64": lower + lower.upper() + digits + "+/"}
    keys = [(k, n, "key " + "".join(rng.choice(a) for _ in range(n)) + " end") for k, a in kinds.items() for n in (20, 24, 32, 40) for _ in range(300)]
    found = secret_scan.scan(spark.createDataFrame(keys, "kind string, n int, text string")).groupBy("kind", "n").agg(F.avg((F.size("spans") > 0).cast("double")).alias("recall"))
    low = {(r.kind, r.n): r.recall for r in found.collect() if r.recall < (0.9 if r.n == 20 else 0.96)}
    assert not low
    plain = ["how_to_2_times_do_it_well", "word " * 30 + "1234567890 and 2024-11-26"]
    assert all(not r.spans for r in secret_scan.scan(spark.createDataFrame([(t,) for t in plain], "text string")).collect())


def test_secret_scan_beside_harmless_stretches(spark):
    key = "q7Zt2LmX9aVb4RkE8wHs1NcYd5GfJu3PoT6iBvKx0SzD"
    texts = ["-" * 8 + key, key + "=" * 12, "0123456789" + key, key + "ABCDEFGHIJ", key + "A" * 200 + key, "-" * 30 + "1" + "=" * 30, "0123456789abcdefghij" * 3, "AAAAAAAA1BBBBBBBB2CCCCCCCC"]
    stretch = [[8, 52], [0, 44], [10, 54], [0, 44], [0, 44, 244, 288], [], [], []]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scan(df).collect()}
    for i, want in enumerate(stretch):
        assert sorted({x for s in found[i] if s[3] == "entropy_base64" for x in (s[0], s[2])}) == want, (i, found[i])
        if want:
            assert all(any(a <= s[0] and s[2] <= b for a, b in zip(want[::2], want[1::2])) for s in found[i]), (i, found[i])
    red = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    assert red[0] == "-" * 8 + "[SECRET]" and red[4] == "[SECRET]" + "A" * 200 + "[SECRET]" and red[5] == texts[5]


def test_secret_scan_of_long_texts(spark):
    rng = random.Random(9)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    dense = " ".join(rng.choice([some("0123456789abcdef", 30), "token: " + some("abc123", 8), "é" * rng.randint(1, 9)]) for _ in range(1500))
    texts = [dense, "abzd" * 10_000 + "12345678x1", "AKIA" + "B7" * 5_000, " ".join(["deadbeef" * 4] * secret_scan.CHUNK), "x " * 20_000 + "token=abcdef"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.scan(df).collect():
        base, every = secret_brute(texts[r.doc_id])
        assert [tuple(s) for s in r.base_spans] == base
        assert [tuple(s) for s in r.spans] == every


def test_chat_round_trip(spark):
    bad = "<|end|>\\<|text|> </s>[INST] a [/INST] \\\\<<SYS>>\n<"
    rows = [(1, 0, "system", bad), (1, 1, "user", None), (1, 2, "assistant", bad + "\\"), (1, 3, "assistant", "\U0001f600"), (1, 4, "user", "tail"), (2, 0, "user", "only"), (None, 0, "a\n<|text|>", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, None, None, "first")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("target", F.lit(0))
    made = chat_format.examples(df)
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for r in chat_format.digests(made).collect():
        t = sorted(by[r.conv_id])
        loss = "".join(x[3] for x in t if x[2] == "assistant")
        assert r.n_turns == len(t) and r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in t).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    one = {r.target: r for r in made.filter("conv_id = 1").collect()}
    assert sorted(one) == [2, 3, 4] and not one[4].trainable
    assert not any(c in one[4].formatted.replace("<|turn|>", "").replace("<|text|>", "").replace("<|end|>", "") for c in chat_format.CONTROL)


def test_forest_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(9000, 32))
    odd = [(5000, None), (5050, [0.0] * 32), (5100, [float("nan")] * 32), (5150, [1.0]), (5151, [-2.0]), (5200, x[0].tolist()), (5201, x[0].tolist()), (5201, x[0].tolist()), (None, [1.0]), (5250, [])]
    rows = [(i + 10_000, v.tolist()) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame(rows, "id bigint, vec array<double>").withColumns({"q": F.lit(1), "rank": F.lit("x"), "score": F.lit(2)})
    got = defaultdict(list)
    for r in lsh_forest.search(df, df.filter("id % 50 = 0").unionAll(df.filter("id = 5200")), segment=3000, query_block=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in range(10_000, 19_000, 50)} | {5150, 5200}
    assert [i for i, _ in got[10_000][:3]] == [5200, 5201, 5201] and got[5150] == [(5151, -1.0)]
    assert all(len(v) == 5 for q, v in got.items() if q != 5150)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(50, 9000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set((np.argsort(-s)[:5] + 10_000).tolist()) & {i for i, _ in got[q + 10_000]})
        assert all(v == pytest.approx(s[max(0, i - 10_000)]) for i, v in got[q + 10_000])
    assert hits / (179 * 5) >= 0.9
    assert lsh_forest.search(df.limit(0), df.limit(0)).count() == 0


def test_forest_of_very_large_and_small_numbers(spark):
    rows = [(0, [1e200, 1e200]), (1, [2e200, 2e200]), (2, [1e-200, 0.0]), (3, [5e-324, 5e-324]), (4, [1e308, -1e308])]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    found = {r.vec_id: r.score for r in lsh_forest.search(df, df.filter("id = 0")).collect()}
    assert found == pytest.approx({1: 1.0, 2: math.sqrt(0.5), 3: 1.0, 4: 0.0})


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0] * 16 if i % 3 == 0 else v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 16)))]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    got = defaultdict(list)
    for r in lsh_forest.search(df, df.filter("id % 50 = 0"), segment=1000).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert all(got[q] == [i for i in range(0, 18, 3) if i != q][:5] for q in range(0, 3000, 150))


def test_synchronous_ascent_equals_brute_force():
    rng = np.random.default_rng(2)
    strings = rng.integers(0, 2**lsh_forest._ALL, (4, 300), dtype=np.uint32)
    strings[1, :40] = strings[1, 0]
    strings[:, 100:160] &= lsh_forest._HIGH[1]
    forest = lsh_forest.Forest(strings)
    asked = np.stack([strings[:, 0], strings[:, 250], strings[:, 120], rng.integers(0, 2**lsh_forest._ALL, 4, dtype=np.uint32)], axis=1)
    for want in (1, 5, 60, 299, 300):
        got = {q: set(rows.tolist()) for q, rows in forest.candidates(asked, want)}
        for q in range(asked.shape[1]):
            letters = lambda s: [int(s) >> int(lsh_forest._ALL - n) for n in lsh_forest._UPTO[1:]]
            share = np.array([max(sum(a == b for a, b in zip(letters(strings[t, i]), letters(asked[t, q]))) for t in range(4)) for i in range(300)])
            level = max(n for n in range(len(lsh_forest.LETTERS) + 1) if (share >= n).sum() >= want)
            assert got[q] == set(np.flatnonzero(share >= level).tolist()), (want, q)


def test_language_model_base_and_likelihood(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.randint(0, 30)) for _ in range(50)] + [None, " \x0b"]
    held = [i % 5 == 1 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, held)), "doc_id bigint, text string, held boolean")
    count, ends = Counter(), 0
    for t, h in zip(texts, held):
        if not h:
            count.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    rows = {r.doc_id: r for r in hmm_lm.score(df, block_bytes=400).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [count[x] for x in w] + [ends])
        assert rows[i].base_score == pytest.approx(base) and (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(w) + 1, sum(x in count for x in w) + 1, n)
    empty = hmm_lm.score(df.withColumn("held", F.lit(True))).first()
    assert empty.score == empty.base_score and empty.train_tokens == 0
    assert hmm_lm.score(df.limit(0)).count() == 0


def test_forward_sums_over_all_paths():
    rng = np.random.default_rng(1)
    k, c = 3, 4
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = hmm_lm.HMM({}, {}, 10, 3, 2, norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, c))), np.zeros(c))
    seqs = [[0, 2, 1], [3], [1, 1, 0, 2]]
    flat, off = np.array(sum(seqs, [])), np.array([0, 3, 4, 8])
    got = m.forward(flat, np.ones(8, bool), off)
    for s, g in zip(seqs, got):
        total = sum(m.start[p[0]] * m.emit[p[0], s[0]] * math.prod(m.move[a, b] * m.emit[b, o] for a, b, o in zip(p, p[1:], s[1:])) for p in itertools.product(range(k), repeat=len(s)))
        assert g == pytest.approx(math.log10(total))
    (part,) = hmm_lm.stretches(flat, off, 8)
    start, moves, emits = hmm_lm.expected_counts(part, m.start, m.move, m.emit)
    assert start.sum() == pytest.approx(3) and moves.sum() == pytest.approx(5) and emits.sum(axis=0) == pytest.approx(np.bincount(flat, minlength=c))


def test_stretches_count_as_whole_texts():
    rng = np.random.default_rng(4)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    k, c = 4, 30
    start, move, emit = norm(rng.random(k)), norm(0.2 * rng.random((k, k)) + np.eye(k)), norm(rng.random((k, c)) ** 3)
    lens = np.array([1, 700, 3, 64, 65, 257, 2000])
    off = np.concatenate([[0], np.cumsum(lens)])
    seq = rng.integers(0, c, off[-1]).astype(np.int32)
    total = lambda parts: [sum(x) for x in zip(*(hmm_lm.expected_counts(p, start, move, emit) for p in parts))]
    whole, dealt = total(hmm_lm.stretches(seq, off, 10**6)), total(hmm_lm.stretches(seq, off, 64, 32, 5))
    for a, b in zip(whole, dealt):
        assert a.sum() == pytest.approx(b.sum()) and np.abs(a - b).max() < 1e-3 * max(1.0, a.max())


def test_score_sums_over_all_paths(spark):
    rng = random.Random(6)
    texts = [words(rng, rng.randint(0, 5)) for _ in range(40)] + ["neverseen abc", None]
    df = spark.createDataFrame([(i, t, i % 5 == 1) for i, t in enumerate(texts)], "doc_id long, text string, held boolean").withColumn("words", F.lit(1))
    blocks = hmm_lm.make_blocks(df.select("doc_id", "text", "held"))
    vocab = hmm_lm.word_counts(blocks)
    m = hmm_lm.train(blocks, vocab, states=2, iterations=2)
    count = {bytes(r[0]): r[1] for r in vocab.collect()}
    for r in hmm_lm.score(df, states=2, iterations=2).collect():
        tokens = (texts[r.doc_id] or "").encode().split()
        chance = []
        for w in tokens:
            cls = m.classes([w])[0]
            inside = (count[w] + 0.5) / m.total / 10 ** m.log_class[cls] if w in count else None
            chance.append(m.emit[:, cls] * inside if inside else np.full(2, 0.5 / m.total))
        chance.append(m.emit[:, -1])
        total = sum(m.start[p[0]] * chance[0][p[0]] * math.prod(m.move[a, b] * x[b] for a, b, x in zip(p, p[1:], chance[1:])) for p in itertools.product(range(2), repeat=len(chance)))
        assert r.score == pytest.approx(math.log10(total))


def filled(sizes, most=3):
    """Targets by a fine bisection of the water level, apart from the operator."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total = sum(sizes.values())
    low, high = 0.0, float(10 * total + 1)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * sizes[s], weight[s] * level) for s in sizes) < total else (low, level)
    return {s: min(most * sizes[s], weight[s] * high) for s in sizes}


def test_targets_equal_bisection():
    rng = random.Random(3)
    for _ in range(50):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 10**6]) * rng.randint(0, 9) for i in range(rng.randint(1, 9))} | {None: 5}
        assert mixing.targets(sizes, mixing.cycled_weights(list(sizes))) == pytest.approx(filled(sizes), rel=1e-9, abs=1e-6)


def test_mixing(spark, corpus):
    df, rows = corpus
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = filled(dict(sizes))
    first = mixing.draw(df, mixing.make_plan(spark, df, shards=5)).collect()
    again = mixing.draw(df.repartition(7), mixing.make_plan(spark, df.repartition(3), shards=5)).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again)) and len(first) == len(rows)
    taken = Counter()
    for r in first:
        assert len(r["shards"]) <= 3 and r["target"] == pytest.approx(want[r.source]) and r["source_size"] == sizes[r.source]
        taken[r.source] += r["size"] * len(r["shards"])
    assert all(abs(taken[s] - want[s]) <= 90 for s in sizes)
    names = ["row", "u", "h", "s", "block", "size", "shards", "taken", "extra", "named"]
    odd = df.withColumns({c: F.lit("x") for c in [*names, "copy"]})
    mixed = mixing.mix(odd, shards=5)
    assert mixed.count() == sum(len(r["shards"]) for r in first) and mixed.columns == [*df.columns, *names, "shard", "copy"]
    assert mixed.filter("taken = 'x' and size = 'x'").count() == mixed.count() and mixed.filter("shard > 4").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_of_repeated_rows_and_odd_sources(spark):
    rows = [(1, "w " * 100, "a")] * 50 + [(i, "w " * 100, "b") for i in range(50)] + [(9, None, "c"), (None, "", None)] + [(7, "x " * 50_000, "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    sizes = {"a": 5000, "b": 5000, "c": 0, None: 0, "d": 50_000}
    want, taken = filled(sizes), Counter()
    got = mixing.draw(df, mixing.make_plan(spark, df)).collect()
    for r in got:
        taken[r.source] += r["size"] * len(r["shards"])
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= (100 if s != "d" else 50_000) for s in sizes)
    mixed = mixing.mix(df, shards=4).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("[^ ]+")))).collect()
    assert {s: n for s, n in mixed} == {s: n for s, n in taken.items() if n}


def test_sums_nearest_to_the_rest():
    rng = random.Random(2)
    for n in (0, 1, 5, 12):
        words = [rng.randrange(1, 500) for _ in range(n)]
        sums = {sum(c) for k in range(n + 1) for c in itertools.combinations(words, k)}
        for rest in (0, 17.4, 800, 1e9):
            got = mixing.nearest(words, rest)
            assert len(set(got)) == len(got) and abs(sum(words[i] for i in got) - rest) == min(abs(x - rest) for x in sums)
    big = [rng.randrange(10**9) for _ in range(64)]
    assert abs(sum(big[i] for i in mixing.nearest(big, 1.2e10)) - 1.2e10) < 0.001 * sum(big)


def test_sources_of_few_documents_meet_their_targets(spark):
    rng = random.Random(12)
    rows = [(20 * d + s, "w " * rng.randrange(10, 600), f"src{s:02}") for s in range(20) for d in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = filled(dict(sizes))
    for r in mixing.draw(df, mixing.make_plan(spark, df)).collect():
        taken[r.source] += r["size"] * len(r["shards"])
    off = [abs(taken[s] - want[s]) / want[s] for s in sizes]
    assert max(off) < 0.06 and sum(off) / len(off) < 0.015


def test_bounds_of_the_last_copy_through_several_steps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BINS", 4)
    monkeypatch.setattr(mixing, "WORDS_A_BLOCK", 10)
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 4)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mixing, "GROUPS", 3)
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(400)], "doc_id bigint, text string, source string")
    plan = mixing.make_plan(spark, df, shards=9)
    got = mixing.draw(df, plan).collect()
    sizes, taken, shard = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * len(r["shards"])
        shard.update(r["shards"])
    assert all(abs(taken[s] - x) <= 14 for s, x in filled(sizes).items()) and set(shard) <= set(range(9)) and len(shard) >= 8


def test_quota_tree_is_exact():
    q = np.array([7, 0, 100, 13])
    got = list(mixing.split(q, np.zeros_like(q), 0, 6, 1, 0))
    assert sum(x[3] for x in got).tolist() == q.tolist() and [x[0] for x in got] == list(range(6))
    assert all((a[2] + a[3] == b[2]).all() for a, b in zip(got, got[1:])) and max(x[3].sum() for x in got) - min(x[3].sum() for x in got) <= 1
    parts = [y for a, b, start, quota in mixing.split(q, np.zeros_like(q), 0, 6, 2, 0) for y in mixing.split(quota, start, a, b, 1, 0)]
    assert [(x[0], x[2].tolist(), x[3].tolist()) for x in got] == [(x[0], x[2].tolist(), x[3].tolist()) for x in parts]
    for n in (1, 2, 3, 64, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_toxicity_kernel_and_learning(spark):
    def brute(s, t):
        def feats(s):
            f = Counter()
            for c in itertools.combinations(range(len(s)), 3):
                f["".join(s[i] for i in c)] += 0.7 ** (c[-1] - c[0] + 1)
            return f

        a, b = feats(s), feats(t)
        k = lambda a, b: sum(v * b[u] for u, v in a.items())
        return k(a, b) / math.sqrt(k(a, a) * k(b, b))

    marks, given = ["idiot", "clown", "lowé"], ["idiot", "i.diot", "clowning", "abc"]
    kernel = toxicity.Kernel(marks)
    values = kernel(given)
    assert values == pytest.approx(np.array([[brute(w, m) for m in marks] for w in given]), abs=1e-5)
    weight = np.array([0.5, -1.0, 2.0])
    assert toxicity.Expansion(kernel, weight)(given) == pytest.approx(values @ weight, abs=1e-4)
    rng = random.Random(1)
    rows = [(words(rng, 20) + (" you kretin " if i % 2 else " ") + words(rng, 20), i % 2) for i in range(120)]
    model = toxicity.fit(rows)
    assert model == model and toxicity.fit(rows[::-1]).bias == model.bias
    docs = spark.createDataFrame([(0, "a k-r-e-t-i-n here"), (1, words(rng, 30)), (2, None), (3, "Kretin!"), (4, "k r e t i n"), (5, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(got[0], got[3], got[4]) >= 0.5 > max(got[1], got[2], got[5])
    assert toxicity.score(docs, toxicity.fit([])).filter("score != 0").count() == 0


def test_language_id(spark):
    rng = random.Random(6)
    make = lambda a: " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(80))
    rows = [(i, make("abcde" if i % 2 else "fghij"), "x" if i % 2 else "y") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("kept out"))
    model = langid.fit(df.filter("doc_id < 60"))
    got = {r.doc_id: r for r in langid.predict(df.select("doc_id", "text"), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 78
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "abcde " * 50_000)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "x"] and got[1].score == 0
    assert langid.fit(df.limit(0)) is None and langid.predict(odd, None).first().lang_pred == "und"


def test_windows_cover_all_bytes():
    for n in (0, 1, 255, 256, 257, 700):
        x, _, length = langid.windows(np.arange(n).astype(np.uint8), np.array([0, n]))
        assert (length.sum() - 3 * max(0, len(length) - 1)) == n


def test_licences(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "plain words here"), ("a/b/y.py", "some text\nLicensed under the Apache License, Version 2.0.\nmore text of other kinds"), ("c/z.py", "nothing"), (None, None), ("a/e.py", "")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "id bigint, path string, text string").withColumn("at", F.lit(0))
    got = {r.id: (r.effective_license, r.how) for r in license_scan.scan(df).collect()}
    assert got == {0: ("MIT", "file"), 1: ("MIT", "inherited"), 2: ("Apache-2.0", "notice"), 3: (None, "none"), 4: (None, "none"), 5: ("MIT", "inherited")}
    assert license_scan.scan(df.limit(0)).count() == 0


def test_licences_that_most_rows_carry(spark):
    rng = random.Random(8)
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    for name, notice in notices.items():
        for every, n in ((3, 60), (1, 60), (1, 1), (1, 2), (1, 4)):
            rows = [(i, f"d{i}/a.txt", " ".join([words(rng, 30), "of the", words(rng, 5), notice if i % every == 0 else "under the license of", words(rng, 30)])) for i in range(n)]
            rows += [(n, "dir/sub/LICENSE", notice), (n + 1, "dir/sub/b/c.txt", words(rng, 9))] if n > 4 else []
            got = {r.id: (r.effective_license, r.how) for r in license_scan.scan(spark.createDataFrame(rows, "id bigint, path string, text string")).collect()}
            want = {i: (name, "notice") if i % every == 0 else (None, "none") for i in range(n)}
            assert got == want | ({n: (name, "file"), n + 1: (name, "inherited")} if n > 4 else {}), (name, every, n)
    short = spark.createDataFrame([(0, "a/b.txt", words(rng, 6) + " " + notices["Apache-2.0"] + " " + words(rng, 3)), (1, "a/c.txt", "plain")], "id bigint, path string, text string")
    assert {r.how for r in license_scan.scan(short).collect()} == {"notice", "none"}


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    bench = words(rng, 30)
    rows = [(i, words(rng, 40), "en", f"s{i % 2}", 0) for i in range(30)]
    rows += [(100, rows[2][1], "en", "s0", 0), (101, words(rng, 10) + " " + bench, "en", "s1", 0), (102, "123", "en", "s0", 0), (103, words(rng, 20) + " token = abcdef123456", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, DOC)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, left = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        left.append({r.doc_id for r in now.collect()})
    ids = {r[0] for r in rows}
    assert left == [ids - {102}, ids - {102, 100}, ids - {102, 100, 101}, ids - {102, 100, 101}]
    assert now.filter("doc_id = 103").first().text.endswith("[SECRET]")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= left[-1] and all(Counter(r.doc_id for r in out)[i] <= 3 for i in ids)


def test_chat_formatting_equals_its_sql(spark, tmp_path):
    import duckdb

    said = ["", None, "a\\b <|turn|> c", "<<s>> <</SYS>> [INST][/INST]", "é <|end|>\n"]
    odd = spark.createDataFrame([(k, i, r, x) for k in (1, 2, None) for i, (r, x) in enumerate(zip(["system", "user", "assistant", None, "assistant"][: 3 + (k or 0)], said))] + [(2, None, "user", "first"), (2, 1, "user", "tie"), (2, 1, "user", "tie")], "conv_id bigint, turn bigint, role string, text string")
    odd.write.parquet(f"{tmp_path}/conversations.parquet")
    for folder, files in (("/root/testdata/sf0.001", "conversations.parquet"), (str(tmp_path), "conversations.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"create view conversations as select * from read_parquet('{folder}/{files}')")
        con.execute(queries.ORACLE["op4_chat_formatting"])
        names = [d[0] for d in con.description]
        want = sorted(con.fetchall(), key=repr)
        df = queries.op4_chat_formatting(spark, folder)
        assert sorted(df.columns) == sorted(names)
        assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == want


def chain(n, words_=40, step=9, seed=5):
    """Texts of which each shares about half of its n-grams with the one before and little with the others."""
    rng = random.Random(seed)
    stream = words(rng, words_ + step * n).split()
    return [" ".join(stream[i * step : i * step + words_]) for i in range(n)]


def links_brute(texts):
    sets = [shingles(t) for t in texts]
    links, group = Counter(), list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    return links, group


def test_joins_of_chained_sets_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    texts = chain(80)
    for _ in range(60):  # near copies hang on the chain
        w = rng.choice(texts[:80]).split()
        w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    links, group = links_brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block, grams in ((8, 2_000_000), (3, 60), (1000, 2_000_000)):
        monkeypatch.setattr(jaccard_join, "GRAMS", grams)
        got = {r.doc_id: r for r in jaccard_join.near_duplicates(df, block=block).collect()}
        assert [got[i].n_links for i in range(len(texts))] == [links[i] for i in range(len(texts))]
        assert [got[i].class_id for i in range(len(texts))] == group


def test_hubs_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(components, "HUBS", 10**9)
    edges = spark.createDataFrame([(1, i) for i in range(2, 2000)] + [(i, i + 5000) for i in range(2, 50)] + [(9000, 9001)], "u bigint, v bigint")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 2000)}, **{i + 5000: 1 for i in range(2, 50)}, 9000: 9000, 9001: 9000}


CLASH = ["row", "key", "k", "id", "stays", "alone", "letter", "lang_pred", "found", "base", "cand", "pairs_hex", "new", "u", "size", "__key", "__base", "a.b", "held", "toxic"]


def test_extra_columns_with_clashing_names(spark):
    rng = random.Random(12)
    rows = [(i, words(rng, 30) + (" kretin" if i % 2 else "") + " token=abcdef123", "en" if i % 2 else "de") for i in range(12)] * 2
    plain = spark.createDataFrame(rows + [(None, None, None), (None, "", None)], "doc_id long, text string, lang string")
    odd = plain.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])
    own = lambda df, *gone: [c for c in odd.columns if c not in gone]

    def kept(df, *gone):
        assert df.columns[: len(own(df, *gone))] == own(df, *gone)
        for r in df.collect():
            assert all(r[c] == f"own {c}" for c in CLASH if c not in gone)
        return df

    assert kept(jaccard_join.deduplicate(odd)).count() == 12 + 2
    assert kept(secret_scan.redact(odd)).filter("text like '%[SECRET]'").count() == 24
    assert kept(secret_scan.scan(odd)).filter("size(spans) > 0").count() == 24
    assert kept(langid.predict(odd, langid.fit(odd)), "lang_pred").count() == 26
    assert kept(toxicity.score(odd, toxicity.fit([(r[1], i % 2) for i, r in enumerate(rows)]))).count() == 26
    assert kept(decontam.clean(odd, spark.createDataFrame([(1, rows[0][1])], "item_id long, text string"))).count() == 24
    assert kept(mixing.mix(odd.withColumn("source", F.lit("s")))).count() > 20
    empty = odd.limit(0)
    for df in (jaccard_join.deduplicate(empty), secret_scan.redact(empty), langid.predict(empty, None), toxicity.score(empty, toxicity.fit([])), decontam.clean(empty, empty.withColumnRenamed("doc_id", "item_id")), mixing.mix(empty.withColumn("source", F.lit("s")))):
        assert df.count() == 0


def test_very_long_texts(spark):
    rng = random.Random(13)
    long = words(rng, 200_000)
    df = spark.createDataFrame([(1, long, "x"), (2, long + " more", "x"), (3, "a " * 300_000, "y"), (4, "z" * 500_000, "y")], "doc_id long, text string, lang string")
    near = {r.doc_id: r for r in jaccard_join.near_duplicates(df).collect()}
    assert near[2].class_id == 1 and near[3].n_links == 0 and near[4].class_id == 4
    bench = spark.createDataFrame([(1, " ".join(long.split()[150_000:150_040])), (2, "a " * 500)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_overlaps(df, bench).collect()} == {(1, 1), (2, 1), (3, 2)}
    assert {r.doc_id: r.lang_pred for r in langid.predict(df, langid.fit(df, epochs=1)).collect()}.keys() == {1, 2, 3, 4}
    held = df.withColumn("held", F.col("doc_id") == 2)
    assert {r.doc_id: r.n_tokens for r in hmm_lm.score(held, iterations=1).collect()} == {1: 200_001, 2: 200_002, 3: 300_001, 4: 2}
    assert toxicity.score(df, toxicity.fit([("bad kretin", 1)] * 5 + [("fine words", 0)] * 5)).count() == 4
    assert license_scan.scan(df.select(F.col("doc_id").alias("id"), F.lit("a/b").alias("path"), F.concat("text", F.lit(" Released under the MIT License.")).alias("text"))).filter("license = 'MIT'").count() == 4


def test_licence_sums_of_blocks_equal_whole_sums(monkeypatch):
    rng = random.Random(5)
    t = license_scan.Templates(license_scan.TEMPLATES)
    t.weigh({i: i % 5 for i in range(len(t.words))}, 50)
    index = np.array([rng.choice((-1, -1, rng.randrange(len(t.words)))) for _ in range(5000)])
    bounds = np.array(sorted(rng.sample(range(5001), 60)))
    begin, end = bounds[::2], bounds[1::2]
    norm, dots = t._running(index)
    off = np.array([0, 1700, 1700, 5000])
    whole = t.passages(index, off, 0.1, 8)
    monkeypatch.setattr(license_scan, "_RANGE", 97)
    monkeypatch.setattr(license_scan, "_BLOCK", 31)
    got = t._sums(index, begin, end)
    assert np.allclose(got[0], norm[end] - norm[begin]) and np.allclose(got[1], [c[end] - c[begin] for c in dots])
    assert len(whole[0]) > 50 and all(np.allclose(a, b) for a, b in zip(whole, t.passages(index, off, 0.1, 8)))


def licence_brute(files):
    """Passages and inheritance in plain Python: best cosine over windows from every template word and over stretches, then a walk up the path."""
    t = license_scan.Templates(license_scan.TEMPLATES)
    bags = [(n, Counter(license_scan._words(x))) for n in sorted(license_scan.TEMPLATES) for x in license_scan.TEMPLATES[n]]
    texts = [license_scan._words(x or "") for _, _, x in files]
    df = Counter(w for x in texts for w in set(x) & set(t.words))
    licences = {n: set().union(*(b for m, b in bags if m == n)) for n, _ in bags}
    idf = {w: math.log((1 + len(files)) / (1 + df[w])) + math.log((1 + len(licences)) / (1 + sum(w in x for x in licences.values()))) + 1e-3 for w in t.words}
    other = float(np.median(list(idf.values())))

    def cosine(part, bag):
        c = Counter(part)
        dot = sum(c[w] * idf[w] * n * idf[w] for w, n in bag.items())
        size = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items() if w in idf) + sum(n for w, n in c.items() if w not in idf) ** 2 * other**2)
        return dot / size / math.sqrt(sum((n * idf[w]) ** 2 for w, n in bag.items()))

    found = []
    for x in texts:
        at = [i for i, w in enumerate(x) if w in idf]
        tries = {(i, min(i + n, len(x)), False) for i in at for n in t.lengths}
        for keep, whole in ((at, False), ([i for i in at if x[i] not in license_scan.FUNCTION_WORDS], True)):
            run = []
            for i in [*keep, 10**9]:
                if run and i - run[-1] > license_scan.GAP + 1:
                    tries.add((run[0], run[-1] + 1, whole))
                    run = []
                run.append(i)
        scored = [(-round(s, 12), a, b, k, n, whole) for a, b, whole in tries for s, k, n in [max((cosine(x[a:b], bag), -k, name) for k, (name, bag) in enumerate(bags))] if s >= license_scan.THRESHOLD]
        if not scored:
            found.append(None)
            continue
        best = min(scored)
        found.append((best[4], -best[0], best[1], best[2] - best[1], max([best[2] - best[1], *(b - a for _, a, b, _, n, whole in scored if whole and n == best[4])]) / max(1, len(x))))
    dirs = {}
    for (_, path, _), f in zip(files, found):
        if f and path is not None and (re.search(license_scan.LICENCE_FILE, path) or f[4] >= 0.8):
            folder = path.rpartition("/")[0]
            dirs[folder] = min(dirs.get(folder, (1, "", "")), (-f[1], path, f[0]))
    out = {}
    for (i, path, _), f in zip(files, found):
        if f:
            out[i] = (f[0], "file" if path is not None and (re.search(license_scan.LICENCE_FILE, path) or f[4] >= 0.8) else "notice", round(f[1], 9), f[2], f[3])
            continue
        folder, up = (path or "").rpartition("/")[0], None
        while path is not None and up is None:
            up = dirs.get(folder)
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        out[i] = (up[2], "inherited", None, None, None) if up else (None, "none", None, None, None)
    return out


def test_licences_equal_brute_force(spark, monkeypatch):
    rng = random.Random(14)
    notices = [x for n in sorted(license_scan.TEMPLATES) for x in license_scan.TEMPLATES[n]]
    files = []
    for i in range(70):
        folder = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
        notice = rng.choice(notices).split()
        if i % 3 == 0:
            notice[rng.randrange(len(notice))] = "changed"
        text = rng.choice([words(rng, 20), " ".join([words(rng, 12), *notice, words(rng, 9)]), " ".join(notice), "of the license " * 3, "", None])
        name = rng.choice(["LICENSE", "COPYING.txt", "x.py", "y.py", "z.md"])
        files.append((i, None if i % 17 == 0 else f"{folder}/{name}" if folder else name, text))
    files += [(100, "a/LICENSE", notices[0]), (101, "a/b/LICENSE", notices[5]), (102, "a/b/c/k.py", "plain"), (103, "a/c/k.py", "plain"), (104, "a/b/c/k.py", "plain")]
    df = spark.createDataFrame(files, "id bigint, path string, text string").withColumns({"license": F.lit("own"), "how": F.lit(1)})
    want = licence_brute(files)
    for most in (license_scan.BROADCAST_DIRS, 0):
        monkeypatch.setattr(license_scan, "BROADCAST_DIRS", most)
        got = {r.id: (r.effective_license, r.how, None if r.score is None else round(r.score, 9), r.first_word, r.n_words) for r in license_scan.scan(df).collect()}
        assert got == want
    assert Counter(x[1] for x in want.values()).keys() == {"file", "notice", "inherited", "none"}


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    rng = random.Random(15)
    rows = [(i, words(rng, 30), None, f"s{i % 2}", 0) for i in range(12)] + [(50, None, None, None, None), (51, "", None, "s0", 0), (None, words(rng, 9), None, None, 3), (52, " 1 2 3", None, "s1", 0)]
    odd = spark.createDataFrame(rows + rows[:2], DOC).withColumns({"lang_": F.lit("own"), "score_": F.lit("own"), "shard": F.lit("own"), "row": F.lit("own"), "a.b": F.lit("own")})
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == odd.columns and all(r["lang_"] == r["score_"] == r["a.b"] == "own" for r in now.collect())
    # Without languages to learn from, all texts with letters stay, one of each group of copies.
    assert sorted((r.doc_id for r in now.collect()), key=repr) == sorted([*range(12), None], key=repr)
    mixed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert mixed.columns == [*[c for c in odd.columns if c != "shard"], "shard", "copy"] and mixed.count() > 0
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
