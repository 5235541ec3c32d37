"""Identities that add up over batches: who an address or a login belongs to, by weighted evidence.

Evidence (identity, candidate, weight, at) is added to a state by identity. Weights are whole billionths, so sums don't
depend on the order, and first and last times are extremes: any batching, late rows included, ends in what one pass over
all evidence gives. The state holds a number for each candidate seen and the best one so far; as evidence only grows, a
batch looks at the candidates it names, at that one and at a few, not at all. Identities are rows to the processor, not
frames, and one with few candidates costs one read and one write of the state a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

UNIT = 1_000_000_000
#: Candidates of an identity held beside its best one; further ones are entries of a map, read and written one by one.
FEW = 16
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "identity string, candidate string, weight double, confidence double, accepted boolean, first_at timestamp_ntz, last_at timestamp_ntz"


def evidence(df: DataFrame) -> DataFrame:
    """identity, candidate, units, at of usable rows: identities in lower case and trimmed. df: identity, candidate, weight, at."""
    x = df.select(F.lower(F.trim("identity")).alias("identity"), "candidate", F.round(F.col("weight") * UNIT).cast("bigint").alias("units"), F.col("at").cast("timestamp_ntz").alias("at"))
    return x.filter("identity != '' and candidate is not null and units > 0")


def partial_sums(found: DataFrame) -> DataFrame:
    """Rows of the same identity and candidate added up within a task's batch, before they are shuffled: a frequent identity costs a row a batch."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield x.groupby(["identity", "candidate"], as_index=False, sort=False).agg(units=("units", "sum"), first_at=("at", "min"), last_at=("at", "max"))

    return found.mapInPandas(add, "identity string, candidate string, units bigint, first_at timestamp_ntz, last_at timestamp_ntz")


class Resolver(StatefulProcessor):
    def __init__(self, least: float):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.units = handle.getMapState("units", "candidate string", "units bigint")
        self.best = handle.getValueState("best", "candidate string, units bigint, total bigint, first_at timestamp_ntz, last_at timestamp_ntz, few array<string>, few_units array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        added: dict[str, int] = {}
        firsts, lasts = [], []
        for x in rows:
            added[x.candidate] = added.get(x.candidate, 0) + x.units
            if x.first_at is not None:
                firsts.append(x.first_at)
                lasts.append(x.last_at)
        total = sum(added.values())
        top: tuple[int, str] | None = None
        few: dict[str, int] = {}
        before = self.best.get()
        if before is not None:
            candidate, units, sum_before, first0, last0, names, counts = before
            top, total = (-units, candidate), total + sum_before
            few = dict(zip(names, counts))
            if first0 is not None:
                firsts.append(first0)
                lasts.append(last0)
        for candidate, more in added.items():
            # Room is never given back, so a candidate that finds room can't be in the map.
            if candidate in few or len(few) < FEW:
                now = few[candidate] = few.get(candidate, 0) + more
            else:
                known = self.units.getValue((candidate,))
                now = more + (known[0] if known else 0)
                self.units.updateValue((candidate,), (now,))
            top = min(top, (-now, candidate)) if top and top[1] != candidate else (-now, candidate)
        first, last = min(firsts, default=None), max(lasts, default=None)
        self.best.update((top[1], -top[0], total, first, last, list(few), list(few.values())))
        share = -top[0] / total
        yield Row(identity=key[0], candidate=top[1], weight=-top[0] / UNIT, confidence=share, accepted=share >= self.least, first_at=first, last_at=last)

    def close(self) -> None:
        pass


def resolved_stream(stream: DataFrame, least: float = 0.7) -> DataFrame:
    """Each identity that a batch names, as it stands after the batch (update mode). The session's state store must be RocksDB (``PROVIDER``)."""
    keyed = partial_sums(evidence(stream)).groupBy("identity")
    return keyed.transformWithState(Resolver(least), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def resolve(df: DataFrame, least: float = 0.7) -> DataFrame:
    """The same from all evidence at once."""
    n = evidence(df).groupBy("identity", "candidate").agg(F.sum("units").alias("u"), F.min("at").alias("f"), F.max("at").alias("l"))
    x = n.groupBy("identity").agg(F.min(F.struct((-F.col("u")).alias("minus"), "candidate")).alias("top"), F.sum("u").alias("total"), F.min("f").alias("first_at"), F.max("l").alias("last_at"))
    share = -F.col("top.minus") / F.col("total")
    return x.select("identity", "top.candidate", (-F.col("top.minus") / UNIT).alias("weight"), share.alias("confidence"), (share >= least).alias("accepted"), "first_at", "last_at")


def run_to_table(stream: DataFrame, table: str, checkpoint: str, least: float = 0.7) -> None:
    """Reads what is there, writes each batch's identities to a folder of its own (a repeated batch replaces it) and stops."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, PROVIDER)
    try:
        resolved_stream(stream, least).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(name, before) if before else conf.unset(name)


def latest(table: DataFrame) -> DataFrame:
    """Each identity as of the last batch that named it. table: the batches that ``run_to_table`` wrote."""
    columns = [c for c in table.columns if c not in ("identity", "batch")]
    return table.groupBy("identity").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("identity", "s.*")
