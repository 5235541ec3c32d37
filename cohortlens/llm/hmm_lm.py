"""Hidden Markov language model over words, scored exactly.

Tokens: white-space separated words, ASCII letters in lower case, then one end token a text.

Model: latent states emit word classes, and a class emits its words in proportion to
their smoothed corpus counts (c + 0.5) / (N + 0.5 (V + 1)). A word with at least
1 / limit of all training tokens is a class of its own; limit is ``frequent``, times the root of the
number of training tokens in units of 2^20 if that is over one, so that classes grow with the corpus. The end token is a
class, and the other words fall into ``forms`` classes by a hash of their first byte, last
two bytes and length. Unseen words share the mass 0.5 / (N + 0.5 (V + 1)), the same in every
state. So each state's distribution over the V + 1 types sums to one, and the
vocabulary itself, of any size, never leaves Spark tables.

Training: Baum-Welch over all training texts. For the forward-backward passes they are dealt
into stretches of ``STRETCH`` tokens, each passed with up to ``WARM`` tokens before and after it, over which alpha and beta
forget how they began; every token and every transition is counted once, in one stretch, and starts
at the starts of texts only. Each task sums its expected counts, which meet in one group-by
of states * classes keys, as integers, so that sums do not depend on order.

Scoring: one scaled forward recursion over each whole text.

Texts go into blocks of some megabytes, each with its own dictionary; only the
distinct words of a block are joined with the counts. Null and empty texts have
just the end token. Repeated rows count each time. Without training texts the score
equals the base score (0). Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, pieces

STATES = 8
ITERATIONS = 6
FREQUENT = 512
FORMS = 512
STRETCH, WARM = 256, 32
#: Stretches of one forward-backward pass; bounds its memory.
STEP = 2048
BLOCK_BYTES = 8 << 20
#: Tokens whose base probabilities are summed at a time.
RUN = 1 << 18
#: Expected counts are summed as multiples of this.
UNIT = 2.0**-16


def _pack(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else a.tobytes())


def _pack_ids(a: np.ndarray) -> bytes:
    """uint32 values as four byte planes, of which the upper ones compress to little."""
    return _pack(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _unpack(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def _unpack_ids(b: bytes) -> np.ndarray:
    planes = _unpack(b, "u1")
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel() if len(planes) else np.zeros(0, np.uint32)


def _words(b: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(b).split()


def _rows(table: pa.RecordBatch | pa.Table):
    """Rows as dicts, one at a time: a row is a whole block."""
    for i in range(table.num_rows):
        yield table.slice(i, 1).to_pylist()[0]
        pa.default_memory_pool().release_unused()


def form_class(w: bytes, forms: int = FORMS) -> int:
    return zlib.crc32(b"%c%b%d" % (w[0], w[-2:], min(len(w), 12) // 3)) % forms


def make_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs: doc_id, text, held (boolean). A row for each block: its documents, its distinct words (most frequent first), their counts in training texts, and the texts as indexes into the words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, "text", block_bytes):
                held = np.asarray(piece.column(2).to_pylist(), dtype=bool)
                split = pc.ascii_split_whitespace(pc.ascii_lower(piece.column(1).fill_null("")))
                flat, owner = split.flatten(), pc.list_parent_indices(split)
                real = pc.greater(pc.binary_length(flat), 0)  # outer white space gives empty pieces
                coded = flat.filter(real).dictionary_encode()
                owner = np.asarray(owner.filter(real))
                lens = np.bincount(owner, minlength=piece.num_rows)
                ids = np.asarray(coded.indices).astype(np.int64)
                order = np.argsort(-np.bincount(ids, minlength=len(coded.dictionary)), kind="stable")
                words = [w.encode() for w in coded.dictionary.take(pa.array(order)).to_pylist()]
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
                ids = rank[ids]
                tf = np.bincount(ids[~held[owner]], minlength=len(words)).astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) | n], pa.int64()), pa.array([piece.column(0).to_pylist()], pa.list_(piece.schema.field(0).type)), pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([lens.tolist()], pa.list_(pa.int64()))]
                    + [pa.array([v], pa.binary()) for v in (_pack(b" ".join(words)), _pack(tf), _pack_ids(ids))],
                    names=["block", "doc_ids", "held", "lens", "words", "tf", "ids"],
                )
                n += 1
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(apply, f"block bigint, doc_ids array<{id_type}>, held array<boolean>, lens array<bigint>, words binary, tf binary, ids binary")


def word_counts(blocks: DataFrame) -> DataFrame:
    """word (binary), c: counts in training texts, end token left out."""

    def emit(batches):
        for batch in batches:
            for row in _rows(batch):
                words, tf = _words(row["words"]), _unpack(row["tf"], "<i8")
                at = np.flatnonzero(tf)
                for i in range(0, len(at), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array([words[j] for j in at[i : i + 100_000]], pa.binary()), pa.array(tf[at[i : i + 100_000]], pa.int64())], names=["word", "c"])

    return blocks.select("words", "tf").mapInArrow(emit, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class HMM:
    frequent: dict[bytes, int]  # word -> class
    counts: dict[bytes, int]  # of the frequent words
    n: int  # training tokens, ends included
    v: int  # types, the end included
    ends: int
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (states, classes); the last class is the end token's
    log_class: np.ndarray  # log10 of each class's smoothed corpus share

    @property
    def total(self) -> float:
        return self.n + 0.5 * (self.v + 1)

    def classes(self, words: list[bytes]) -> np.ndarray:
        f, k = self.frequent, len(self.frequent)
        return np.fromiter((f[w] if w in f else k + form_class(w) for w in words), dtype=np.int32, count=len(words))

    def forward(self, cls: np.ndarray, known: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log10 likelihood of the class sequences off[i]:off[i + 1]; an unknown word has the same probability in each state."""
        unknown = 0.5 / self.total
        table = np.concatenate([self.emit.T, np.full((1, len(self.start)), unknown)])
        obs = np.where(known, cls, len(table) - 1)
        lens = np.diff(off)
        order = np.argsort(-lens, kind="stable")
        base, ordered = off[:-1][order], lens[order]
        out, a = np.zeros(len(lens)), np.repeat(self.start[None], len(lens), axis=0)
        active = np.searchsorted(-ordered, -np.arange(1, (ordered[0] if len(ordered) else 0) + 1), side="right")
        for t, n in enumerate(active.tolist()):
            x = (a[:n] if t == 0 else a[:n] @ self.move) * table[obs[base[:n] + t]]
            s = x.sum(axis=1)
            out[:n] += np.log10(s)
            a = x / s[:, None]
        final = np.empty(len(lens))
        final[order] = out
        return final


@dataclass
class Stretches:
    """Rows of class ids: ``lead`` tokens before the stretch, its ``inner`` ones, and more up to ``total``; longest first."""

    x: np.ndarray
    lead: np.ndarray
    inner: np.ndarray
    total: np.ndarray
    first: np.ndarray  # whether the row begins its text


def stretches(cls: np.ndarray, off: np.ndarray, size: int = STRETCH, warm: int = WARM, step: int = STEP):
    """The sequences off[i]:off[i + 1] dealt into stretches of ``size``, ``step`` of them at a time."""
    lens = np.diff(off)
    per = -(-lens // size)
    doc = np.repeat(np.arange(len(lens)), per)
    start = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * size
    inner = np.minimum(size, off[doc + 1] - start)
    lead = np.minimum(warm, start - off[doc])
    total = lead + inner + np.minimum(warm, off[doc + 1] - start - inner)
    for i in range(0, len(doc), step):
        order = i + np.argsort(-total[i : i + step], kind="stable")
        at = np.minimum((start - lead)[order, None] + np.arange(int(total[order[0]])), len(cls) - 1)
        yield Stretches(cls[at], lead[order], inner[order], total[order], start[order] == off[doc[order]])


def expected_counts(s: Stretches, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over stretches: expected starts, moves and emissions of their inner tokens. Passes run in single precision, sums in double."""
    k, c = emit.shape
    active = np.searchsorted(-s.total, -np.arange(1, s.x.shape[1] + 1), side="right").tolist()
    usual = np.full(k, 1 / k)
    for _ in range(50):
        usual = usual @ move
    table, single, back = np.ascontiguousarray(emit.T, dtype=np.float32), move.astype(np.float32), np.ascontiguousarray(move.T, dtype=np.float32)
    x = np.ascontiguousarray(s.x.T)  # by place, then row
    at = np.arange(len(x))[:, None]
    inner = (at >= s.lead) & (at < s.lead + s.inner)
    counted = inner.sum(axis=1).tolist()
    alphas, scales = [], []
    for t, n in enumerate(active):
        a = np.where(s.first[:n, None], start, usual).astype(np.float32) if t == 0 else alphas[-1][:n] @ single
        a *= table[x[t, :n]]
        scale = a.sum(axis=1, keepdims=True)
        a /= scale
        alphas.append(a)
        scales.append(scale)
    begun, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
    gammas, seen = [], []
    beta = None
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        b = np.ones((n, k), dtype=np.float32)
        if t + 1 < len(active):
            m = active[t + 1]
            beta *= table[x[t + 1, :m]]
            beta /= scales[t + 1]
            np.matmul(beta, back, out=b[:m])
            if counted[t + 1]:
                nxt = beta if counted[t + 1] == m else beta * inner[t + 1, :m, None]
                moves += alphas[t][:m].T @ nxt
        beta = b
        if counted[t] == n:
            gammas.append(alphas[t] * b)
            seen.append(x[t, :n])
        elif counted[t]:
            inside = np.flatnonzero(inner[t, :n])
            gammas.append(alphas[t][inside] * b[inside])
            seen.append(x[t, inside])
        if t == 0:
            begun = (alphas[0] * b)[s.first[:n]].sum(axis=0, dtype=np.float64)
    if gammas:
        g, o = np.concatenate(gammas), np.concatenate(seen)
        for j in range(k):
            emits[j] = np.bincount(o, weights=g[:, j], minlength=c)
    return begun, move * moves, emits


def _runs(off: np.ndarray, size: int):
    """Ranges of texts of about ``size`` tokens each; every text has a token at least."""
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j
        i = j


def _sequences(row: dict, model: HMM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class and word index (-1 at ends) of each token of a block, ends included, with offsets, and the class of each word."""
    cls = model.classes(_words(row["words"]))
    ids, lens = _unpack_ids(row["ids"]).astype(np.int32), np.asarray(row["lens"], dtype=np.int64)
    off = np.concatenate([[0], np.cumsum(lens + 1)])
    word = np.full(off[-1], -1, dtype=np.int32)
    is_end = np.zeros(off[-1], dtype=bool)
    is_end[off[1:] - 1] = True
    word[~is_end] = ids
    seq = np.full(off[-1], model.emit.shape[1] - 1, dtype=np.int32)
    seq[~is_end] = cls[ids]
    return seq, word, off, cls


def train(blocks: DataFrame, vocab: DataFrame, states: int = STATES, iterations: int = ITERATIONS, frequent: int = FREQUENT, seed: int = 5) -> HMM:
    spark = blocks.sparkSession
    n_words, types = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = blocks.select(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()[0]
    n, v = int(n_words + ends), int(types + (ends > 0))
    limit = int(frequent * max(1.0, (n / (1 << 20)) ** 0.5))
    top = sorted((bytes(r[0]), int(r[1])) for r in vocab.filter(F.col("c") * limit >= F.lit(n)).collect()) if n else []
    fr = {w: i for i, (w, _) in enumerate(top)}
    c = len(fr) + FORMS + 1
    model = HMM(fr, dict(top), n, v, int(ends), np.full(states, 1 / states), np.zeros((states, states)), np.zeros((states, c)), np.zeros(c))

    def mass(batches):
        count, kinds = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            f = np.fromiter((form_class(w) if w not in fr else FORMS for w in words), dtype=np.int64, count=len(words))
            rare = f < FORMS
            count += np.bincount(f[rare], weights=np.asarray(batch.column(1))[rare], minlength=FORMS).astype(np.int64)
            kinds += np.bincount(f[rare], minlength=FORMS)
        yield pa.RecordBatch.from_arrays([pa.array(range(FORMS), pa.int32()), pa.array(count), pa.array(kinds)], names=["k", "n", "t"])

    share = np.zeros(c)
    for r in vocab.mapInArrow(mass, "k int, n bigint, t bigint").groupBy("k").agg(F.sum("n"), F.sum("t")).collect():
        share[len(fr) + r[0]] = r[1] + 0.5 * r[2]
    for w, i in fr.items():
        share[i] = model.counts[w] + 0.5
    share[-1] = ends + 0.5 if ends else 0
    share /= model.total
    with np.errstate(divide="ignore"):
        model.log_class = np.where(share > 0, np.log10(np.where(share > 0, share, 1)), 0.0)
    rng = np.random.default_rng(seed)
    model.move = np.full((states, states), 0.2 / max(1, states - 1)) + np.eye(states) * (0.8 - 0.2 / max(1, states - 1))
    unseen = 0.5 / model.total

    def smoothed(counts: np.ndarray) -> np.ndarray:
        e = counts + 20 * share + 1e-9 * (share > 0)
        return (1 - unseen) * e / np.maximum(e.sum(axis=1, keepdims=True), 1e-300)

    if not n:
        return model
    model.emit = smoothed(share * rng.gamma(1.0, size=(states, c)) * 100)
    k = states
    first = spark.sparkContext.broadcast(model)

    def sequences(batches):
        m = first.value
        for batch in batches:
            for row in _rows(batch):
                seq, _, off, _ = _sequences(row, m)
                learned = ~np.asarray(row["held"], dtype=bool)
                lens = np.diff(off)
                seq = seq[np.repeat(learned, lens)]
                yield pa.RecordBatch.from_arrays([pa.array([_pack_ids(seq)], pa.binary()), pa.array([_pack(lens[learned].astype("<i8"))], pa.binary())], names=["seq", "lens"])

    learn = materialize(blocks.select("words", "ids", "lens", "held").mapInArrow(sequences, "seq binary, lens binary"), "sequences")
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)

        def count(batches, shared=shared):
            m = shared.value
            total = np.zeros(k + k * k + k * c)
            for batch in batches:
                for row in _rows(batch):
                    seq, lens = _unpack_ids(row["seq"]).astype(np.int32), _unpack(row["lens"], "<i8")
                    for part in stretches(seq, np.concatenate([[0], np.cumsum(lens)])):
                        total += np.concatenate([y.ravel() for y in expected_counts(part, m.start, m.move, m.emit)])
            units = np.round(total / UNIT).astype(np.int64)
            at = np.flatnonzero(units)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(units[at], pa.int64())], names=["i", "x"])

        got = np.zeros(k + k * k + k * c)
        for i, x in learn.mapInArrow(count, "i int, x bigint").groupBy("i").agg(F.sum("x")).collect():
            got[i] = x * UNIT
        shared.unpersist()
        start, move, emit = got[:k] + 1, got[k : k + k * k].reshape(k, k) + 1, got[k + k * k :].reshape(k, c)
        model = HMM(fr, model.counts, n, v, int(ends), start / start.sum(), move / move.sum(axis=1, keepdims=True), smoothed(emit), model.log_class)
    return model


def score(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs: doc_id, text, held (boolean; true: not learned from). A row for each: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    blocks = materialize(make_blocks(docs.select("doc_id", F.col("text").cast("string").alias("text"), "held"), block_bytes), "blocks")
    vocab = materialize(word_counts(blocks), "vocabulary")
    model = train(blocks, vocab, states, iterations)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def wanted(batches):
        m = shared.value
        for batch in batches:
            for row in _rows(batch):
                words = _words(row["words"])
                at = np.array([i for i, w in enumerate(words) if w not in m.frequent], dtype=np.int32)
                for i in range(0, len(at), 100_000):
                    p = at[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([words[j] for j in p.tolist()], pa.binary()), pa.array(np.full(len(p), row["block"])), pa.array(p)], names=["w", "b", "pos"])

    asked = blocks.select("block", "words").mapInArrow(wanted, "w binary, b bigint, pos int")
    known = asked.join(vocab, F.col("w") == F.col("word")).select("b", "pos", "c")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value
        out = []
        counts = (np.asarray(right.column("pos")), np.asarray(right.column("c")))
        for row in _rows(left):
            words = _words(row["words"])
            c = np.zeros(len(words) + 1)
            c[counts[0]] = counts[1]
            for i, w in enumerate(words):
                if w in m.counts:
                    c[i] = m.counts[w]
            c[-1] = m.ends
            seq, word, off, _ = _sequences(row, m)
            seen = c[word] > 0  # -1, the end, is last
            n_known, base_score, inside = (np.zeros(len(off) - 1) for _ in range(3))
            for i, j in _runs(off, RUN):
                at = slice(off[i], off[j])
                base = np.log10((c[word[at]] + 0.5) / m.total)
                for into, x in ((n_known, seen[at]), (base_score, base), (inside, np.where(seen[at], base - m.log_class[seq[at]], 0.0))):
                    into[i:j] = np.add.reduceat(x.astype(np.float64), off[i:j] - off[i])
            model_score = m.forward(seq, seen, off) + inside if m.n else base_score
            n = np.diff(off)
            out.append(pa.table([pa.array(row["doc_ids"], left.schema.field("doc_ids").type.value_type), pa.array(row["held"], pa.bool_()), pa.array(n), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(n), m.n)), pa.array(base_score), pa.array(model_score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        schema = pa.schema([("doc_id", left.schema.field("doc_ids").type.value_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    rows = blocks.select("block", "doc_ids", "held", "lens", "words", "ids")
    return rows.groupBy("block").cogroup(known.groupBy("b")).applyInArrow(finish, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
