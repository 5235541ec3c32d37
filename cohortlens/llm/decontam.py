"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick six of up to ten neighbouring tokens and ignore the others, so a
substituted token at an ignored place leaves the seed intact. Seeds of the benchmark
are joined with seeds at every token of every text; each hit fixes a diagonal (text
position minus item position) along which the two are compared token by token.

Rule: with W = min(20, tokens of the item), a text overlaps an item if some W
consecutive tokens of the item, laid on the text without gaps, agree in at least
W - W // 5 places. ``choose_masks`` picks masks that hit every such overlap, so the
search itself loses none.

Cases: tokens are white-space separated, ASCII letters in lower case. Null and empty
texts or items never overlap. Repeated rows are each reported. Only doc_id, text,
item_id are read, further columns of any name pass through ``clean`` untouched. Words
that repeat many times in text and item are compared on all diagonals of the two, not hit by hit.
Empty tables give no overlaps. Benchmarks beyond ``block_tokens`` are matched in blocks, each broadcast in turn: a
scan of the texts for each 500,000 benchmark tokens.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohortlens.llm.common import column, packed, pieces, reduced, text_bytes, token_bounds, token_hashes, unpacked

WINDOW = 20
WEIGHT = 6
SPAN = 10
#: Benchmark tokens broadcast at a time: 12 bytes a token and about 20 a seed, tens of MB at most.
BLOCK_TOKENS = 500_000
#: Hits expanded at a time.
EXPAND = 1 << 19


def choose_masks(lengths: list[int], window: int = WINDOW) -> list[tuple[int, ...]]:
    """Token offsets of masks such that each window with up to a fifth of its tokens substituted keeps a hit, for items of these lengths."""
    chosen: list[tuple[int, ...]] = []

    def reached(mask: tuple[int, ...], bad: np.ndarray, w: int) -> np.ndarray:
        bits = sum(1 << o for o in mask)
        out = np.zeros(len(bad), dtype=bool)
        for shift in range(w - mask[-1]):
            out |= (bad & np.int64(bits << shift)) == 0
        return out

    for w in sorted({min(window, n) for n in lengths if n > 0}, reverse=True):
        bad = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(w), w // 5)], dtype=np.int64)
        left = np.ones(len(bad), dtype=bool)
        for m in chosen:
            if m[-1] < w:
                left &= ~reached(m, bad, w)
        for weight in range(min(WEIGHT, w - w // 5), 0, -1):
            options = [(0, *mid, span - 1) if span > 1 else (0,) for span in range(weight, min(SPAN, w) + 1) for mid in itertools.combinations(range(1, span - 1), max(0, weight - 2))]
            hits = {m: reached(m, bad, w) for m in dict.fromkeys(options)} if left.any() else {}
            while left.any() and hits:
                best = max(hits, key=lambda m: int((hits[m] & left).sum()))
                if not (hits[best] & left).any():
                    break
                chosen.append(best)
                left &= ~hits[best]
    return chosen


def _seeds(th: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(th) - mask[-1]
    h = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            for j, o in enumerate(mask):
                h += th[o : o + n] * np.uint64((0x9FB21C651E98DF25 * (2 * j + 3)) & (2**64 - 1) | 1)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xA24BAED4963EE407)
    return h


class SeedIndex:
    """The seeds of one block of the benchmark, sorted, those of an item side by side."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        data, off = text_bytes(pa.array([t for _, t in items], pa.string()))
        starts, ends, self.tok_off = token_bounds(data, off)
        self.ids = [i for i, _ in items]
        self.window = window
        self.th = token_hashes(data, starts, ends, lower=True)
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), np.diff(self.tok_off))
        self.masks = choose_masks(np.diff(self.tok_off).tolist(), window)
        self.tables = []
        for m in self.masks:
            h = _seeds(self.th, m)
            ok = self.item[: len(h)] == self.item[m[-1] : m[-1] + len(h)] if len(h) else np.zeros(0, bool)
            pos = np.flatnonzero(ok).astype(np.int32)
            order = np.argsort(h[pos], kind="stable")
            pos, h = pos[order], h[pos][order]
            sieve = np.zeros(1 << 20, dtype=bool)
            sieve[(h >> np.uint64(44)).astype(np.int64)] = True
            # Where the places of one seed in one item begin, and where the items of one seed begin.
            item = self.item[pos]
            group = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (item[1:] != item[:-1])]).astype(np.int32) if len(h) else np.zeros(0, np.int32)
            first = np.flatnonzero(np.r_[True, h[group][1:] != h[group][:-1]]).astype(np.int32) if len(h) else np.zeros(0, np.int32)
            self.tables.append((m, h[group[first]], np.r_[first, len(group)], np.r_[group, len(pos)], item[group], pos, sieve))

    def diagonals(self, th: np.ndarray, tok_off: np.ndarray) -> tuple[np.ndarray, set[tuple[int, int]]]:
        """Distinct (document, item, shift) that share a seed, but for (document, item) pairs with more hits than tokens, which are returned apart: there all diagonals are as cheap.

        Hits are counted a seed and item at a time before any is expanded, and are expanded ``EXPAND`` at a time, so that words that repeat in text and benchmark take no memory.
        """
        doc = np.repeat(np.arange(len(tok_off) - 1), np.diff(tok_off))
        n_items, span = len(self.ids), len(th) + len(self.th) + 1
        tokens = lambda pair: np.diff(tok_off)[pair // n_items] + np.diff(self.tok_off)[pair % n_items]
        dense, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for m, seeds, first, group, item, pos, sieve in self.tables:
            h = _seeds(th, m)
            at = np.flatnonzero(sieve[(h >> np.uint64(44)).astype(np.int64)])
            if not len(at) or not len(seeds):
                continue
            at = at[doc[at] == doc[at + m[-1]]]
            seed = np.minimum(np.searchsorted(seeds, h[at]), len(seeds) - 1)
            hit = seeds[seed] == h[at]
            at, seed = at[hit], seed[hit]
            for i, j in _chunks(first[seed + 1] - first[seed]):
                p, g = _expanded(at[i:j], first[seed[i:j]], first[seed[i:j] + 1])
                pair, count = doc[p] * n_items + item[g], group[g + 1] - group[g]
                pairs, inverse = np.unique(pair, return_inverse=True)
                many = pairs[np.bincount(inverse, weights=count, minlength=len(pairs)) > tokens(pairs)]
                dense = np.union1d(dense, many)
                few = ~np.isin(pair, dense)
                p, g, pair, count = p[few], g[few], pair[few], count[few]
                for k, n in _chunks(count):
                    q, place = _expanded(np.arange(k, n), group[g[k:n]], group[g[k:n] + 1])
                    found = np.union1d(found, pair[q] * span + (p[q] - pos[place] + len(self.th)))
        pair = found // span
        keep = ~np.isin(pair, dense)
        return np.stack([pair[keep] // n_items, pair[keep] % n_items, found[keep] % span - len(self.th)], axis=1), {(int(x // n_items), int(x % n_items)) for x in dense}

    def overlaps(self, th: np.ndarray, tok_off: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(document, item) -> (matched tokens, first token of the overlap, its length), the best of all diagonals: most matched, then first."""
        diagonals, dense = self.diagonals(th, tok_off)
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, i, shift in diagonals.tolist():
            self._match(th, tok_off, d, i, shift, out)
        for d, i in dense:
            for shift in range(int(tok_off[d] - self.tok_off[i + 1]) + 1, int(tok_off[d + 1] - self.tok_off[i])):
                if (d, i) in out and out[d, i][0] == self.tok_off[i + 1] - self.tok_off[i]:
                    break  # the whole item, and no later diagonal has it earlier
                self._match(th, tok_off, d, i, shift, out)
        return out

    def _match(self, th: np.ndarray, tok_off: np.ndarray, d: int, i: int, shift: int, out: dict) -> None:
        """Compares document d with item i on one diagonal and notes the overlap in out if it is better."""
        q0, q1 = max(int(self.tok_off[i]), int(tok_off[d]) - shift), min(int(self.tok_off[i + 1]), int(tok_off[d + 1]) - shift)
        w = min(self.window, int(self.tok_off[i + 1] - self.tok_off[i]))
        if q1 - q0 < w:
            return
        same = self.th[q0:q1] == th[q0 + shift : q1 + shift]
        if np.count_nonzero(same) < max(w - w // 5, out[d, i][0] if (d, i) in out else 0):
            return
        sums = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(sums[w:] - sums[:-w] >= w - w // 5)
        if len(good):
            inside = np.zeros(len(same) + 1, dtype=np.int64)
            np.add.at(inside, good, 1)
            np.add.at(inside, good + w, -1)
            inside = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & same)
            got = (len(inside), int(q0 + shift + inside[0] - tok_off[d]), int(inside[-1] - inside[0] + 1))
            if (d, i) not in out or (-got[0], got[1]) < (-out[d, i][0], out[d, i][1]):
                out[d, i] = got


def _chunks(count: np.ndarray):
    """Ranges of entries whose counts add up to about EXPAND; a larger entry comes alone."""
    total, i = np.cumsum(count), 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + EXPAND, side="right")))
        yield i, j
        i = j


def _expanded(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x repeated, beside each place from lo to hi of it."""
    n = (hi - lo).astype(np.int64)
    return np.repeat(x, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def index_blocks(benchmark: DataFrame, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> Iterator[SeedIndex]:
    """Seed indexes of the benchmark, a block of bounded size at a time."""
    items = reduced(benchmark, "item_id", "text").filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // (4 * block_tokens) + 1
    block = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n))
    for b in range(n):
        rows = [tuple(r) for r in (items.filter(block == b) if n > 1 else items).collect()]
        if rows:
            yield SeedIndex(rows, window)


def _scan(index: SeedIndex, piece: pa.RecordBatch, name: str = "text") -> dict[tuple[int, int], tuple[int, int, int]]:
    data, off = text_bytes(column(piece, name))
    starts, ends, tok_off = token_bounds(data, off)
    return index.overlaps(token_hashes(data, starts, ends, lower=True), tok_off)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each document row and item that overlap: doc_id, item_id, matched, first_token, n_tokens (long). An empty benchmark gives none."""
    spark = docs.sparkSession
    docs = reduced(docs, "doc_id", "text")
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), reduced(benchmark, "item_id").schema["item_id"].dataType.simpleString()
    item_arrow = to_arrow_type(reduced(benchmark, "item_id").schema["item_id"].dataType)
    schema = f"doc_id {id_type}, item_id {item_type}, matched bigint, first_token bigint, n_tokens bigint"
    out = None
    for index in index_blocks(benchmark, window, block_tokens):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches, shared=shared, item_arrow=item_arrow):
            ix = shared.value
            for batch in batches:
                for piece in pieces(batch, "text"):
                    ids = piece.column(0)
                    found = _scan(ix, piece)
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([d for d, _ in found])), pa.array([ix.ids[i] for _, i in found], item_arrow)] + [pa.array([v[k] for v in found.values()], pa.int64()) for k in range(3)],
                            names=["doc_id", "item_id", "matched", "first_token", "n_tokens"],
                        )

        part = docs.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs, with all their columns, that overlap no item; decided row by row without a shuffle."""
    work = packed(docs)
    for index in index_blocks(benchmark, window, block_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches, shared=shared):
            for batch in batches:
                for piece in pieces(batch, "row.text"):
                    bad = {d for d, _ in _scan(shared.value, piece, "row.text")}
                    yield piece.filter(pa.array([i not in bad for i in range(piece.num_rows)], pa.bool_())) if bad else piece

        work = work.mapInArrow(keep, work.schema)
    return unpacked(work)
