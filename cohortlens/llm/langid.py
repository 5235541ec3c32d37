"""Language identification by a byte-level convolutional network.

Bytes are embedded, convolved by filters of several widths, max-pooled over a window
and put through a softmax. The network is trained in numpy on the driver from a bounded
sample of labelled documents (``docs_per_lang`` per language, ``windows_per_doc``
windows of each). Applying it, each text is cut into fixed-length windows over its whole
length, overlapping by the widest filter less one, and the windows' logits are averaged
by length.

Because a filter is linear in the embedded bytes, embedding and filter fold into one
table of 256 rows per filter offset, so that inference gathers and adds rows.

Cases: null text or text without a letter gives ``und`` with score 0, as does every
text if nothing could be learned. Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import column, packed, pieces, reduced, text_bytes, unpacked

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
DOCS_PER_LANG = 400
WINDOWS_PER_DOC = 4


@dataclass
class ByteCNN:
    langs: list[str]
    tables: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray  # (features, langs)
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Max-pooled activations of windows, a uint8 matrix."""
        feats = []
        for w, table in self.tables.items():
            n = x.shape[1] - w + 1
            conv = table[0][x[:, :n]]
            for j in range(1, w):
                conv += table[j][x[:, j : j + n]]
            feats.append(conv.max(axis=1))
        return np.maximum(np.concatenate(feats, axis=1) + self.bias, 0)

    def logits(self, x: np.ndarray, step: int = 32) -> np.ndarray:
        if not len(x):
            return np.zeros((0, len(self.langs)), np.float32)
        return np.concatenate([self.pooled(x[i : i + step]) for i in range(0, len(x), step)]) @ self.out + self.out_bias


def windows(data: np.ndarray, off: np.ndarray, size: int = WINDOW, overlap: int = max(WIDTHS) - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows over all bytes, with the document and the true length of each."""
    n = np.diff(off)
    per = np.maximum(1, -(-(n - overlap) // (size - overlap)))
    per[n == 0] = 0
    doc = np.repeat(np.arange(len(n)), per)
    start = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * (size - overlap)
    length = np.minimum(size, off[doc + 1] - start) if len(doc) else np.zeros(0, np.int64)
    at = start[:, None] + np.arange(size)
    inside = np.arange(size) < length[:, None]
    x = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(doc) else np.zeros((0, size), np.uint8)
    return x, doc, length


def covered(n: np.ndarray, size: int = WINDOW, overlap: int = max(WIDTHS) - 1) -> np.ndarray:
    """The sum of the lengths of the windows of texts of n bytes."""
    return n + overlap * np.maximum(0, -(-(n - overlap) // (size - overlap)) - 1)


def window_runs(data: np.ndarray, off: np.ndarray, limit: int = 1 << 20, size: int = WINDOW, overlap: int = max(WIDTHS) - 1):
    """The same windows, those of about ``limit`` bytes at a time, also inside a long text."""
    step = (size - overlap) * max(1, limit // (size - overlap))
    if len(data) <= step + overlap:
        yield windows(data, off, size, overlap)
        return
    for d in range(len(off) - 1):
        for i in range(0, max(1, int(off[d + 1] - off[d]) - overlap), step):
            part = data[off[d] + i : min(off[d + 1], off[d] + i + step + overlap)]
            x, doc, length = windows(part, np.array([0, len(part)]), size, overlap)
            yield x, doc + d, length


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, rate: float = 0.01, seed: int = 7) -> ByteCNN:
    """Adam on cross-entropy; x: windows, y: indexes into langs. The same input gives the same network."""
    rng = np.random.default_rng(seed)
    f = FILTERS
    p = {"e": rng.normal(0, 0.3, (256, EMBED)), "b": np.zeros(len(WIDTHS) * f), "o": rng.normal(0, 0.2, (len(WIDTHS) * f, len(langs))), "c": np.zeros(len(langs))}
    p |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, f)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = (len(y) / (len(langs) * np.maximum(1, np.bincount(y, minlength=len(langs))))).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 64):
            xb, yb = x[order[i : i + 64]], y[order[i : i + 64]]
            rows, feats, places = np.arange(len(yb)), [], {}
            p["e"][0] = 0
            for w in WIDTHS:
                n = xb.shape[1] - w + 1
                table = p["e"] @ p[f"w{w}"]
                conv = table[0][xb[:, :n]]
                for j in range(1, w):
                    conv += table[j][xb[:, j : j + n]]
                places[w] = conv.argmax(axis=1)
                feats.append(np.take_along_axis(conv, places[w][:, None], axis=1)[:, 0])
            z = np.concatenate(feats, axis=1) + p["b"]
            a = np.maximum(z, 0)
            q = a @ p["o"] + p["c"]
            q = np.exp(q - q.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[rows, yb] -= 1
            q *= weight[yb][:, None] / len(yb)
            g = {"o": a.T @ q, "c": q.sum(axis=0), "e": np.zeros_like(p["e"])}
            dz = (q @ p["o"].T) * (z > 0)
            g["b"] = dz.sum(axis=0)
            for k, w in enumerate(WIDTHS):
                d = dz[:, k * f : (k + 1) * f]
                g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
                for j in range(w):
                    byte = np.take_along_axis(xb, places[w] + j, axis=1)  # (batch, filters)
                    g[f"w{w}"][j] = np.einsum("bfe,bf->ef", p["e"][byte], d)
                    np.add.at(g["e"], byte, d[:, :, None] * p[f"w{w}"][j].T[None])
            t += 1
            for key in p:
                m[key] = 0.9 * m[key] + 0.1 * g[key]
                s[key] = 0.999 * s[key] + 0.001 * g[key] ** 2
                p[key] -= rate * (m[key] / (1 - 0.9**t)) / (np.sqrt(s[key] / (1 - 0.999**t)) + 1e-7)
    p["e"][0] = 0
    return ByteCNN(langs, {w: (p["e"] @ p[f"w{w}"]).astype(np.float32) for w in WIDTHS}, p["b"], p["o"], p["c"])


def fold(docs: DataFrame, k: int) -> Column:
    """crc32 of doc_id as text, modulo k; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), F.lit(k))


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, windows_per_doc: int = WINDOWS_PER_DOC, epochs: int = 6) -> ByteCNN | None:
    """A network for the languages of docs (columns doc_id, text, lang), from at most about docs_per_lang documents of each, chosen by a hash of doc_id; None if no text has a language."""
    known = reduced(docs, "doc_id", "text", "lang").filter("lang is not null and text is not null and text != ''")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, docs_per_lang / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    # Only spaced pieces of a sampled document are sent to the driver: at most windows_per_doc windows.
    size, k = WINDOW, windows_per_doc
    cut = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substring("text", (i * F.greatest(F.length("text") - size, F.lit(0)) / max(1, k - 1)).cast("int") + 1, F.lit(size)))
    rows = known.filter(draw < share[F.col("lang")]).select("lang", F.array_distinct(cut).alias("cut")).collect()
    rows = sorted((r[0], t) for r in rows for t in r[1])
    langs = sorted(counts)
    data, off = text_bytes(pa.array([t for _, t in rows], pa.string()))
    x, doc, length = windows(data, off)
    index = {v: i for i, v in enumerate(langs)}
    y = np.array([index[v] for v, _ in rows], dtype=np.int64)
    first = np.flatnonzero(np.diff(np.concatenate([[-1], doc])) != 0)  # one window of each piece
    return train(x[first], y[doc[first]], langs, epochs)


def predict(docs: DataFrame, model: ByteCNN | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of docs with the language and its score (0 to 1) in two columns ``names``, added or replaced."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    work = packed(docs, letter=letter)
    if model is None:
        return unpacked(work, **dict(zip(names, (F.lit("und"), F.lit(0.0)))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        net = shared.value
        for batch in batches:
            for piece in pieces(batch, "row.text", 1 << 20):
                data, off = text_bytes(column(piece, "row.text"))
                total = np.zeros((piece.num_rows, len(net.langs)))
                for x, doc, length in window_runs(data, off):
                    np.add.at(total, doc, net.logits(x) * length[:, None])
                total /= np.maximum(1, covered(np.diff(off)))[:, None]
                q = np.exp(total - total.max(axis=1, keepdims=True))
                q /= q.sum(axis=1, keepdims=True)
                best = q.argmax(axis=1)
                has = np.asarray(column(piece, "letter").to_pylist(), dtype=bool)
                pred = [net.langs[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist())]
                score = np.where(has, q[np.arange(len(q)), best], 0.0)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["row", "lang", "score"])

    schema = type(work.schema)([work.schema["row"]]).add("lang", "string").add("score", "double")
    return unpacked(work.mapInArrow(apply, schema), **dict(zip(names, (F.col("lang"), F.col("score")))))
