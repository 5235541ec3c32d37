"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

Kernel: gap-weighted subsequences of ``ORDER`` characters with decay ``DECAY``, normalised.
It gives "idiot" and "i-d.iot" a high value, as inserted characters only weaken the terms.

A text is a bag of strings: its lower-cased words without outer punctuation, those with marks inside
also without them, words over ``LONGEST``
characters cut into overlapping pieces of that length, and runs of single characters ("i d i o t")
joined. The SVM scores strings; a text's score is the logistic of its highest string.

Training (numpy, on the driver) sees at most about ``docs_per_class`` labelled texts of each
class. In each toxic text the strings far commoner in toxic texts are taken as
positive, with copies that have characters inserted; texts without any are left to label noise. Negative strings
come from other texts, the hardest added after a first fit. Landmarks are the strongest
positive strings, skipping those too alike, and some negatives. The squared hinge is
minimised by gradient descent in the Nystroem space, and the logistic is fitted on the texts' highest scores.

Cases: null text counts as empty; a text without strings scores as the lowest string would.
Without toxic or without clean labelled texts each score is 0 or 1 as the labels
say (0 if there are none); if no string tells the classes apart, they are 0, or the share of toxic texts if those are most. Several labels of a document: the highest counts. Repeated rows score each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import column, packed, pieces, reduced, unpacked

ORDER, DECAY = 3, 0.7
LONGEST = 24
LANDMARKS = 48
#: Labelled texts of each class that train the model, about; all other bounds of the fit are these.
DOCS_PER_CLASS = 1500
#: A string is toxic from so many toxic texts and such log odds on; if none is, the best that there are count.
LEAST_TEXTS, LEAST_ODDS = 3, 2.5
#: Toxic strings, those tried as landmarks, random clean strings, and the hardest clean ones that the SVM sees.
POSITIVES, LANDMARK_TRIALS, NEGATIVES, HARD = 4000, 600, 12_000, 1000
_SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
_OUTER = re.compile(r"^\W+|\W+$")
_MARKS = re.compile(r"[\W_]+")


def strings_of(raw: str) -> list[str]:
    """The strings that one white-space separated word stands for."""
    w = _OUTER.sub("", raw)
    out = [w]
    if not w.isalnum():  # also without the marks inside
        out.append(_MARKS.sub("", w))
    step = LONGEST // 2
    return [x if len(x) <= LONGEST else x[i : i + LONGEST] for x in out if len(x) >= ORDER for i in (range(0, len(x) - step, step) if len(x) > LONGEST else (0,))]


def words_of(text: str) -> set[str]:
    """Distinct raw words of a text, runs of single characters joined among them."""
    text = text.lower()
    out = set(text.split())
    for m in _SPACED.finditer(text):
        out.add(m.group().replace(" ", ""))
    return out


def _codes(words: list[str]) -> np.ndarray:
    """(words, longest) code points, zero-padded."""
    n = max(map(len, words))
    return np.frombuffer("".join(w.ljust(n, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), n)


class Kernel:
    """The normalised kernel of strings with a fixed list of landmarks."""

    def __init__(self, landmarks: list[str], order: int = ORDER, decay: float = DECAY):
        self.landmarks, self.order, self.decay = landmarks, order, decay
        codes = _codes(landmarks)
        self.q = codes.shape[1]
        self.chars = np.unique(codes[codes > 0])
        table = np.zeros((len(self.chars) + 1, len(landmarks), self.q), dtype=np.float32)
        for i, c in enumerate(self.chars):
            table[i + 1] = (codes == c) * decay * decay
        self.table = table
        # spread[i, j]: what a match at i adds at a later or the same place j.
        d = np.arange(self.q)[None] - np.arange(self.q)[:, None]
        self.spread = np.where(d >= 0, decay ** np.maximum(d, 0), 0).astype(np.float32)
        self.norm = np.sqrt(self._self(codes))

    def _self(self, codes: np.ndarray) -> np.ndarray:
        n = codes.shape[1]
        match = ((codes[:, :, None] == codes[:, None, :]) & (codes[:, :, None] > 0)).astype(np.float32) * np.float32(self.decay**2)
        d = np.arange(n)[None] - np.arange(n)[:, None]
        return self._run(lambda i: match[:, i], n, len(codes), np.where(d >= 0, self.decay ** np.maximum(d, 0), 0).astype(np.float32))

    def _run(self, row, n: int, size: int, spread: np.ndarray, between: tuple = ()) -> np.ndarray:
        """Sum over common subsequences of ``order``; row(i): matches of the i-th character with all places of the other string."""
        shape = (size, *between, len(spread))
        total = np.zeros(shape[:-1], dtype=np.float32)
        before = [np.zeros(shape, dtype=np.float32) for _ in range(self.order - 1)]  # K'_1 .. K'_{p-1}
        decay = np.float32(self.decay)
        for i in range(n):
            m = row(i)
            top = m[..., 1:] * before[-1][..., :-1] if self.order > 1 else m
            total += top.sum(axis=-1)
            for p in range(self.order - 2, -1, -1):
                x = m if p == 0 else m * np.concatenate([np.zeros((*shape[:-1], 1), np.float32), before[p - 1][..., :-1]], axis=-1)
                before[p] *= decay
                before[p] += (x.reshape(-1, shape[-1]) @ spread).reshape(shape)
        return total

    def __call__(self, words: list[str]) -> np.ndarray:
        """(words, landmarks), values from 0 to 1."""
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_len.setdefault(len(w), []).append(i)
        for n, at in by_len.items():
            for j in range(0, len(at), 512):
                rows = at[j : j + 512]
                codes = _codes([words[i] for i in rows])
                index = np.searchsorted(self.chars, codes)
                known = self.chars[np.minimum(index, len(self.chars) - 1)] == codes
                index = np.where(known, index + 1, 0)
                k = self._run(lambda i, index=index: self.table[index[:, i]], n, len(rows), self.spread, (len(self.landmarks),))
                out[rows] = k / (np.sqrt(self._self(codes))[:, None] * self.norm + 1e-12)
        return out


class Expansion:
    """The sum of ``weight`` times kernel over all landmarks, for one string at a time as cheap as its own subsequences.

    The kernel is an inner product over subsequences of three characters, so the weighted
    landmarks add up to one table of three character indexes.
    """

    def __init__(self, kernel: Kernel, weight: np.ndarray):
        assert kernel.order == 3
        self.kernel, self.chars, self.width = kernel, kernel.chars, len(kernel.chars) + 1
        beta = np.zeros(self.width**3)
        for s, w, norm in zip(kernel.landmarks, weight, kernel.norm):
            index = np.searchsorted(self.chars, _codes([s])[0]) + 1
            t = self._triples(len(s))
            at = (index[t[0]] * self.width + index[t[1]]) * self.width + index[t[2]]
            np.add.at(beta, at, float(w) / float(norm) * kernel.decay ** (t[2] - t[0] + 1.0))
        self.beta = beta.astype(np.float32)

    @staticmethod
    def _triples(n: int) -> np.ndarray:
        i, j, k = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
        ok = (i < j) & (j < k)
        return np.stack([i[ok], j[ok], k[ok]])

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_len.setdefault(len(w), []).append(i)
        for n, at in by_len.items():
            t = self._triples(n)
            decay = (self.kernel.decay ** (t[2] - t[0] + 1.0)).astype(np.float32)
            step = max(64, 200_000 // max(1, t.shape[1]))
            for j in range(0, len(at), step):
                rows = at[j : j + step]
                codes = _codes([words[i] for i in rows])
                index = np.searchsorted(self.chars, codes)
                known = self.chars[np.minimum(index, len(self.chars) - 1)] == codes
                index = np.where(known, index + 1, 0).astype(np.int32)
                cell = (index[:, t[0]] * self.width + index[:, t[1]]) * self.width + index[:, t[2]]
                out[rows] = (self.beta[cell] @ decay) / np.sqrt(self.kernel._self(codes) + 1e-12)
        return out


@dataclass
class Model:
    constant: float | None
    expansion: Expansion | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def values(self, words: list[str]) -> np.ndarray:
        """Decision value of each raw word, the highest of its strings; the bias for one without."""
        parts = [strings_of(w) for w in words]
        flat = list(dict.fromkeys(s for p in parts for s in p))
        value = dict(zip(flat, (self.expansion(flat) + self.bias).tolist())) if flat else {}
        return np.array([max((value[s] for s in p), default=self.bias) for p in parts])

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Squared hinge, accelerated gradient descent."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = v = np.zeros(x1.shape[1])
    reg = np.append(np.full(x.shape[1], 1 / c), 0)
    step = 1 / (2 * np.linalg.norm((x1 * weight[:, None]).T @ x1, 2) + 1 / c)
    for i in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        g = reg * v - 2 * x1.T @ (weight * y * slack)
        new = v - step * g
        v = new + i / (i + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[str | None, int]], landmarks: int = LANDMARKS, seed: int = 13) -> Model:
    """rows: (text, 0 or 1). The same rows, in any order, give the same model."""
    labels = {int(y) for _, y in rows}
    if len(labels) < 2:
        return Model(float(max(labels, default=0)))
    rng = np.random.default_rng(seed)
    rows = sorted((t or "", int(y)) for t, y in rows)
    bags = [{s for w in words_of(t) for s in strings_of(w)} for t, _ in rows]
    df = [Counter(), Counter()]
    n = [0, 0]
    for bag, (_, y) in zip(bags, rows):
        df[y].update(bag)
        n[y] += 1
    odds = {s: np.log((c + 0.1) / (n[1] + 1)) - np.log((df[0][s] + 0.1) / (n[0] + 1)) for s, c in df[1].items()}
    by_weight = lambda found: sorted(found, key=lambda s: (-df[1][s] * odds[s], s))
    strong = by_weight(s for s, o in odds.items() if o > LEAST_ODDS and df[1][s] >= LEAST_TEXTS) or by_weight(s for s, o in odds.items() if o > 0)
    if not strong:
        return Model(n[1] / (n[0] + n[1]) if n[1] > n[0] else 0.0)
    positive = strong[:POSITIVES]
    strongset = set(positive)
    chosen: list[str] = []
    for s in positive[:LANDMARK_TRIALS]:
        if len(chosen) >= landmarks - 8:
            break
        if not chosen or float(Kernel(chosen)([s]).max()) < 0.5:
            chosen.append(s)
    clean = sorted(df[0])
    negative = [clean[i] for i in np.sort(rng.permutation(len(clean))[:NEGATIVES])]
    near = Kernel(chosen)(negative).max(axis=1)
    chosen += [negative[i] for i in np.argsort(-near, kind="stable")[:8] if negative[i] not in strongset]
    kernel = Kernel(chosen)
    values, vectors = np.linalg.eigh(kernel(chosen).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T

    def noisy(s: str) -> str:
        marks = ".-*_ #"
        m = marks[int(rng.integers(len(marks)))].strip()
        out = list(s)
        for at in sorted(rng.choice(np.arange(1, len(s)), size=min(len(s) - 1, int(rng.integers(1, 3))), replace=False).tolist(), reverse=True):
            out.insert(at, m or "x")
        return "".join(out)

    pos = positive + [noisy(s) for s in positive[:300] for _ in range(2) if len(s) > 4]
    weight_of = [float(df[1].get(s, 3)) for s in pos]
    kp = kernel(pos).astype(np.float64) @ root
    wp = np.array(weight_of) / sum(weight_of)
    neg = negative
    for _ in range(2):
        kn = kernel(neg).astype(np.float64) @ root
        w, b = _svm(np.concatenate([kp, kn]), np.concatenate([np.ones(len(pos)), -np.ones(len(neg))]), np.concatenate([wp, np.full(len(neg), 2.0 / len(neg))]) * 200)
        alpha = (root @ w).astype(np.float32)
        rest = [s for s in clean if s not in strongset]
        hard = Expansion(kernel, alpha)(rest)
        neg = negative + [rest[i] for i in np.argsort(-hard, kind="stable")[:HARD]] * 4
    model = Model(None, Expansion(kernel, alpha), b)
    # The logistic of the texts' highest values, by Newton steps.
    everything = sorted(set().union(*bags))
    value = dict(zip(everything, (model.expansion(everything) + b).tolist())) if everything else {}
    top = np.array([max((value[s] for s in bag), default=b) for bag in bags])
    y = np.array([y for _, y in rows], dtype=float)
    x1, theta, each = np.stack([np.clip(top, -3, 3), np.ones(len(top))], axis=1), np.array([1.0, 0.0]), np.where(y > 0, 0.5 / n[1], 0.5 / n[0]) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ theta, -30, 30)))
        h = (x1 * (each * p * (1 - p))[:, None]).T @ x1 + np.eye(2) * 1e-2
        step = np.linalg.solve(h, x1.T @ (each * (p - y)) + 1e-2 * theta)
        theta = theta - np.clip(step, -2, 2)
    model.slope, model.shift = float(max(theta[0], 1e-3)), float(theta[1])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS) -> list[tuple[str | None, int]]:
    """At most about docs_per_class labelled texts of each class, chosen by a hash of doc_id. Rows that share a doc_id count
    as texts of their own, equal ones once; where that makes more than docs_per_class, they are chosen by a hash of the row."""
    marked = reduced(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select("doc_id").distinct()
    marked = marked.join(ids, "doc_id", "left_semi")
    toxic = (F.col("toxic") > 0).cast("int")
    by_class = lambda df: {0: 0, 1: 0} | dict(df.groupBy(toxic).count().collect())
    draw = lambda *key: F.pmod(F.xxhash64(*key), F.lit(1_000_000)) / 1_000_000
    share = lambda n: F.when(F.col("toxic") > 0, docs_per_class / max(1, n[1])).otherwise(docs_per_class / max(1, n[0]))
    sample = marked.filter(draw(F.col("doc_id").cast("string"), F.lit("toxicity")) < share(by_class(marked)))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # about two times docs_per_class ids
    n = by_class(rows)
    if max(n.values()) > 2 * docs_per_class:
        rows = rows.dropDuplicates(["doc_id", "text"])
        rows = rows.filter(draw(F.col("doc_id").cast("string"), "text", F.lit("toxicity rows")) < share(by_class(rows)))
    return [tuple(r) for r in rows.select("text", toxic).collect()]


def score(docs: DataFrame, model: Model, keep: int = 400_000) -> DataFrame:
    """docs, all columns and rows, with score (0 to 1) added or replaced. ``keep``: distinct words whose values a task holds at a time."""
    work = packed(docs)
    if model.constant is not None:
        return unpacked(work, score=F.lit(float(model.constant)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        m = shared.value
        cache: dict[str, float] = {}
        for batch in batches:
            for piece in pieces(batch, "row.text", 2 << 20):
                texts = [words_of(t or "") for t in column(piece, "row.text").to_pylist()]
                fresh = sorted(set().union(*texts).difference(cache)) if texts else []
                if len(cache) + len(fresh) > keep:
                    cache = {}
                    fresh = sorted(set().union(*texts))
                cache.update(zip(fresh, m.values(fresh).tolist()))
                top = np.array([max(map(cache.__getitem__, t), default=m.bias) for t in texts])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(m.probability(top))], names=["row", "score"])

    schema = type(work.schema)([work.schema["row"]]).add("score", "double")
    return unpacked(work.mapInArrow(apply, schema), score=F.col("score"))
