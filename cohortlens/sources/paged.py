"""Answers of a paged service, landed as Parquet, as a data source for batches and streams.

A collector lands each page as a row: resource, url, link (the Link header), status, body (a JSON array, or one
value). Landed files are never changed and their paths grow (a folder for each landing, say), so a file's path is the stream's
cursor: a batch holds the files after the last committed one. Each row group is a partition. Filters on
``resource`` skip row groups by their statistics.

    spark.dataSource.register(LandedPages)  # with spark.sql.python.filterPushdown.enabled
    spark.read.format("landed_pages").load(folder)
    spark.readStream.format("landed_pages").option("maxFiles", 100).load(folder)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition

from cohortlens.sources.parsers import next_link
from cohortlens.sources.scratch import written

SCHEMA = "resource string, url string, link string, status int, body string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class Part(InputPartition):
    path: str
    group: int


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def _landed(folder: str) -> list[str]:
    """The landed files in order of their paths; names with a leading _ or . don't count."""
    system, root = _open(folder)
    found = system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x[:1] in "_." for x in p.removeprefix(root).split("/") if x)
    return sorted(x.path for x in found if x.is_file and x.path.endswith(".parquet") and not hidden(x.path))


def _groups(folder: str, paths: list[str], resource: str | None = None) -> list[Part]:
    system, _ = _open(folder)
    out = []
    for path in paths:
        with system.open_input_file(path) as f:
            meta = pyarrow.parquet.ParquetFile(f).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index("resource")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            if resource is None or s is None or not s.has_min_max or s.min <= resource <= s.max:
                out.append(Part(path, g))
    return out


def _rows(folder: str, part: Part) -> Iterator[pyarrow.RecordBatch]:
    system, _ = _open(folder)
    with system.open_input_file(part.path) as f:
        yield from pyarrow.parquet.ParquetFile(f).iter_batches(batch_size=256, row_groups=[part.group], columns=COLUMNS)


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.resource = folder, None

    def pushFilters(self, filters):
        for x in filters:
            if isinstance(x, EqualTo) and x.attribute == ("resource",):
                self.resource = x.value
            yield x  # Spark still filters the rows

    def partitions(self):
        return _groups(self.folder, _landed(self.folder), self.resource)

    def read(self, partition):
        return _rows(self.folder, partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are {"after": path}: everything up to this file has been read. With ``most``, no batch holds more files (within one run of the stream)."""

    def __init__(self, folder: str, most: int | None):
        self.folder, self.most, self.reached = folder, most, None

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        paths = _landed(self.folder)
        if self.most and self.reached is not None:
            paths = [p for p in paths if p > self.reached][: self.most]
        return {"after": max([*paths[-1:], self.reached or ""])}

    def partitions(self, start, end):
        self.reached = end["after"]
        return _groups(self.folder, [p for p in _landed(self.folder) if start["after"] < p <= end["after"]])

    def read(self, partition):
        return _rows(self.folder, partition)

    def commit(self, end):
        self.reached = end["after"]


class LandedPages(DataSource):
    @classmethod
    def name(cls):
        return "landed_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"])

    def streamReader(self, schema):
        return StreamReader(self.options["path"], int(self.options.get("maxFiles", "0")) or None)


def read_pages(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    spark.dataSource.register(LandedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (spark.readStream if stream else spark.read).format("landed_pages").load(folder)


def followed(pages: DataFrame, starts: DataFrame, rounds: int = 40) -> DataFrame:
    """The pages that a client reaches: from the first pages in ``starts`` (resource, url) along the links, up to a page that is missing or has no status of 200. Adds page, its number from 1. A page landed more than once counts once (the greatest row).

    Pointers to the page before are doubled, so chains of n pages take log2(n) joins.
    """
    pages = pages.groupBy("resource", "url").agg(F.max(F.struct(F.col("status") == 200, "status", "link", "body")).alias("p"))
    pages = written(pages.select("resource", "url", "p.link", "p.status", "p.body"))
    first = starts.select(F.col("resource").alias("r0"), F.col("url").alias("u0")).distinct()
    good = pages.filter("status = 200").select("resource", "url").join(first, (F.col("resource") == F.col("r0")) & (F.col("url") == F.col("u0")), "left")
    # Every page that is linked to has a pointer back, also if the page before failed: then it leads nowhere.
    links = pages.select("resource", next_link(F.col("link")).alias("to"), F.when(F.col("status") == 200, F.col("url")).otherwise("").alias("back")).filter("to is not null")
    back = links.groupBy("resource", "to").agg(F.min("back").alias("back"))
    chain = good.join(back.select(F.col("resource").alias("r"), "to", "back"), (F.col("resource") == F.col("r")) & (F.col("url") == F.col("to")), "left")
    pointer = F.when(F.col("u0").isNull(), F.coalesce("back", F.lit("")))  # null: a first page, empty: leads nowhere
    now = written(chain.select("resource", "url", pointer.alias("back"), F.lit(1).cast("bigint").alias("steps")))
    for _ in range(rounds):
        to = now.select(F.col("resource").alias("r"), F.col("url").alias("u"), F.col("back").alias("b"), F.col("steps").alias("s"))
        x = now.join(to, (F.col("resource") == F.col("r")) & (F.col("back") == F.col("u")), "left")
        lost = F.col("back").isNotNull() & F.col("u").isNull()  # the page before was never landed or failed
        x = x.select("resource", "url", F.when(lost, "").otherwise(F.col("b")).alias("back"), F.when(F.col("u").isNull(), F.col("steps")).otherwise(F.col("steps") + F.col("s")).alias("steps"))
        now = written(x)
        if not now.filter("back is not null and back != ''").limit(1).count():
            break
    reached = now.filter("back is null").select(F.col("resource").alias("r"), F.col("url").alias("u"), F.col("steps").alias("page"))
    return pages.join(reached, (F.col("resource") == F.col("r")) & (F.col("url") == F.col("u"))).select("resource", "url", "page", "link", "status", "body")


def items(pages: DataFrame) -> DataFrame:
    """resource, page, position (from 0), item (JSON): the values in the bodies; a body that is one value is one item, an unreadable body is none."""
    body = F.when(F.ltrim("body").startswith("["), F.col("body")).otherwise(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    return pages.select("resource", "page", F.posexplode(F.from_json(body, "array<string>")).alias("position", "item"))
