"""The paged source and the stateful identities: batches, streams, restarts."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cohortlens.sources import paged
from cohortlens.streaming import identities


def land(spark, folder, number, rows):
    spark.createDataFrame(rows, paged.SCHEMA).coalesce(1).write.parquet(f"{folder}/landing={number:06d}")


def page(resource, n, last, body, status=200):
    link = None if last else f'<https://x/{resource}?page={n + 1}>; rel="next", <https://x/{resource}?page=9>; rel="last"'
    return resource, f"https://x/{resource}?page={n}", link, status, body


@pytest.fixture
def folder(spark, tmp_path):
    land(spark, tmp_path / "pages", 1, [page("a", 1, False, '[{"id":1},{"id":2}]'), page("a", 2, False, '[{"id":3}]'), page("b", 1, True, '{"one":[1]}'), page("c", 1, False, "[1]", 500), page("c", 2, True, "[2]")])
    land(spark, tmp_path / "pages", 2, [page("a", 3, True, "[4,null]"), page("a", 2, False, '[{"id":3}]'), page("d", 1, False, "[1]"), page("d", 3, True, "[3]"), page("e", 1, True, None)])
    return str(tmp_path / "pages")


def test_pages_are_followed_up_to_a_gap(spark, folder):
    starts = spark.createDataFrame([(x, f"https://x/{x}?page=1") for x in "abcde"], "resource string, url string")
    got = sorted((r.resource, r.page, r.position, r.item) for r in paged.items(paged.followed(paged.read_pages(spark, folder), starts)).collect() if r.item is not None)
    assert got == [("a", 1, 0, '{"id":1}'), ("a", 1, 1, '{"id":2}'), ("a", 2, 0, '{"id":3}'), ("a", 3, 0, "4"), ("b", 1, 0, '{"one":[1]}'), ("d", 1, 0, "1")]


def test_batch_and_stream_read_the_same_and_a_restart_repeats_nothing(spark, folder, tmp_path):
    stream = lambda: paged.read_pages(spark, folder, stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted(map(str, df.collect()))
    stream()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(paged.read_pages(spark, folder))
    stream()
    land(spark, folder, 3, [page("f", 1, True, "[7]")])
    stream()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(paged.read_pages(spark, folder)) and len(rows(paged.read_pages(spark, folder))) == 11


def test_filters_skip_row_groups(folder):
    reader = paged.Reader(folder)
    assert len(reader.partitions()) == 2
    assert list(reader.pushFilters([paged.EqualTo(("resource",), "e")])) == [paged.EqualTo(("resource",), "e")]
    assert [p.path.split("/")[-2] for p in reader.partitions()] == ["landing=000002"]


def test_limit_of_files_a_batch(folder):
    reader = paged.StreamReader(folder, 1)
    reader.partitions(reader.initialOffset(), reader.initialOffset())
    seen, at = [], reader.initialOffset()
    for _ in range(3):
        end = reader.latestOffset()
        seen.append(len(reader.partitions(at, end)))
        at = end
    assert seen == [1, 1, 0]


def test_any_batching_gives_the_same_identities(spark, tmp_path):
    rng, start = random.Random(6), datetime(2026, 1, 1)
    rows = [(rng.choice(("Ann@x ", "ann@x", "bob", "eve", "")), rng.choice(("s1", "s2", "s3", None)), rng.choice((0.5, 1.0, 1 / 3)), start + timedelta(hours=rng.randrange(999))) for _ in range(300)] + [("tie", "s2", 1.0, start), ("tie", "s1", 1.0, start)]
    schema = "identity string, candidate string, weight double, at timestamp_ntz"
    want = sorted(map(str, identities.resolve(spark.createDataFrame(rows, schema)).collect()))
    assert len(want) == 4
    for k, parts in enumerate(([300], [1, 40, 100])):
        rng.shuffle(rows)  # late rows come with any batch
        folder, cuts = tmp_path / f"in{k}", [0, *parts, len(rows)]
        for i, (a, b) in enumerate(itertools.pairwise(cuts)):
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{folder}/part={i}")
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
            identities.run_to_table(stream, str(tmp_path / f"out{k}"), str(tmp_path / f"state{k}"))
        got = identities.latest(spark.read.parquet(str(tmp_path / f"out{k}")))
        assert sorted(map(str, got.select("identity", "candidate", "weight", "confidence", "accepted", "first_at", "last_at").collect())) == want
        assert got.filter(F.col("identity") == "tie").first().candidate == "s1"


class _Counted:
    """A state handle in memory that counts reads and writes."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def getMapState(self, name, *schema):
        return self

    getValueState = getMapState

    def _done(self, x=None):
        self.calls += 1
        return x

    def exists(self):
        return self._done(self.value is not None)

    def get(self):
        return self._done(self.value)

    def update(self, value):
        self.value = self._done(value)

    def containsKey(self, key):
        return self._done(key in self.map)

    def getValue(self, key):
        return self._done(self.map.get(key))

    def updateValue(self, key, value):
        self.map[key] = self._done(value)


def test_an_identity_costs_one_read_and_one_write_a_batch():
    # 20 candidates, more than lie beside the best one; the last gains most, times may be missing.
    one, handle, at = identities.Resolver(0.2), _Counted(), datetime(2026, 1, 1)
    one.init(handle)
    evidence = Row("identity", "candidate", "units", "first_at", "last_at")
    few = [evidence("u", f"c{i:02d}", identities.UNIT, None, None) for i in range(3)]
    (x,) = one.handleInputRows(("u",), iter(few), None)
    assert handle.calls == 2 and (x.candidate, x.weight, x.first_at, x.accepted) == ("c00", 1.0, None, True)
    many = [evidence("u", f"c{i:02d}", identities.UNIT, at, at + timedelta(days=i)) for i in range(20)]
    list(one.handleInputRows(("u",), iter(many), None))
    (x,) = one.handleInputRows(("u",), iter([evidence("u", "c19", 2 * identities.UNIT, at, at)]), None)
    assert (x.candidate, x.weight, x.first_at, x.last_at) == ("c19", 3.0, at, at + timedelta(days=19)) and x.confidence == 3 / 25
    assert len(handle.map) == 20 - identities.FEW
