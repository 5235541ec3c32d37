"""Shared helpers: Arrow text access, vectorised token hashes, shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_PIECE = 1 << 20
_pows: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only a local session without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reduced(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns only, so that extra columns cannot clash; a missing one is null text."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in cols])


def packed(df: DataFrame, **columns) -> DataFrame:
    """``row``, a struct of all columns of df, beside ``columns`` (expressions over df): names inside the struct cannot clash with others."""
    return df.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def unpacked(df: DataFrame, **columns) -> DataFrame:
    """The columns in ``row``, then ``columns``, which replace those of the same name in any case."""
    new = {c.lower() for c in columns}
    old = [f for f in df.schema["row"].dataType.names if f.lower() not in new]
    return df.select(*[F.col("row").getField(f).alias(f) for f in old], *[c.alias(name) for name, c in columns.items()])


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """SplitMix64 finaliser over uint64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pows.get("p", ())) < n:
        n = max(n, _PIECE + 4096)
        for key, base in (("p", _P), ("q", _PINV)):
            a = np.full(n, base, dtype=np.uint64)
            a[0] = 1
            with np.errstate(over="ignore"):
                _pows[key] = np.cumprod(a, dtype=np.uint64)
    return _pows["p"], _pows["q"]


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets into them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None and off[-1] > 0 else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def token_bounds(data: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all tokens, separated by the bytes marked in between, and n + 1 token offsets by document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~between[data]
    first = np.empty(len(word), dtype=bool)
    first[0] = True
    first[1:] = ~word[:-1]
    first[off[:-1][off[:-1] < len(word)]] = True
    starts = np.flatnonzero(word & first)
    last = np.empty(len(word), dtype=bool)
    last[:-1] = first[1:] | ~word[1:]
    last[-1] = True
    ends = np.flatnonzero(word & last) + 1
    return starts, ends, np.searchsorted(starts, off)


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each token, vectorised over pieces of about a megabyte."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + _PIECE)))
        piece = data[base : int(ends[j - 1])]
        p, q = _powers(len(piece) + 1)
        c = np.zeros(len(piece) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((LOWER[piece] if lower else piece).astype(np.uint64) * p[: len(piece)] + p[: len(piece)], out=c[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (c[e] - c[s]) * q[s]
        i = j
    return mix64(out)


def shingle_sets(th: np.ndarray, tok_off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each document; fewer than n tokens make one shingle of all of them, none make an empty set."""
    k = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        if len(th) >= n:
            h = th[: len(th) - n + 1].copy()
            for i in range(1, n):
                h = h * k + th[i : len(th) - n + 1 + i]
            h = mix64(h, 1)
        else:
            h = np.zeros(0, np.uint64)
        out = []
        for a, b in zip(tok_off[:-1].tolist(), tok_off[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(h[a : b - n + 1]))
            elif b > a:
                v = np.uint64(b - a)
                for x in th[a:b]:
                    v = v * k + x
                out.append(mix64(np.array([v], np.uint64), 2))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or with "row.name" a field of the struct column row."""
    outer, _, field = name.partition(".")
    col = batch.column(batch.schema.get_field_index(outer))
    return col.field(field) if field else col


def pieces(batch: pa.RecordBatch, name: str, limit: int = 4 << 20):
    """Slices of a record batch of about limit bytes of text each (a longer row comes alone)."""
    _, off = text_bytes(column(batch, name))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield batch.slice(i, min(j, batch.num_rows) - i)
        i = j
