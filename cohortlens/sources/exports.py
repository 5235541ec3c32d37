"""Entries of a project export: what tasks declare about help, and the values that may be declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUES = "array<struct<value:string,description:string>>"
ENTRY = f"struct<attributeValues:array<struct<attributeName:string,attributeType:string,value:string,valueB:string,enumValues:{VALUES},enumValues2:{VALUES}>>>"
#: The type of an attribute of two values.
PAIR = "ENUM_PAIR"


def _attribute(entry: Column, name: str) -> Column:
    """The first attribute of an entry with that name and two values; null without one, or if the entry is no such JSON."""
    every = F.from_json(entry, ENTRY)["attributeValues"]
    return F.get(F.filter(every, lambda a: (a["attributeName"] == name) & (a["attributeType"] == PAIR)), F.lit(0))


def _said(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def declared_usage(entries: DataFrame, name: str) -> DataFrame:
    """task, model, level, declared (both are there; blank ones are null): a row for each entry with the attribute. entries: task, entry (JSON text)."""
    x = entries.select("task", _attribute(F.col("entry"), name).alias("a")).filter("a is not null")
    x = x.select("task", _said(F.col("a.value")).alias("model"), _said(F.col("a.valueB")).alias("level"))
    return x.withColumn("declared", F.col("model").isNotNull() & F.col("level").isNotNull())


def declared_domains(entries: DataFrame, name: str, order: str = "task") -> DataFrame:
    """slot (1: model, 2: level), value, description, place: the values that may be declared, each once, as the entry last in ``order`` tells them. Entries of one export repeat the same lists, which meet on the map side."""
    a = _attribute(F.col("entry"), name)
    tell = lambda slot, key: F.transform(F.coalesce(a[key], F.array().cast(VALUES)), lambda v, i: F.struct(F.lit(slot).alias("slot"), v["value"].alias("value"), v["description"].alias("description"), i.alias("place")))
    x = entries.select(order, F.explode(F.concat(tell(1, "enumValues"), tell(2, "enumValues2"))).alias("v")).select(order, "v.*").filter("value is not null")
    last = F.max_by(F.struct("description", "place"), F.struct(order, "place"))
    return x.groupBy("slot", "value").agg(last.alias("l")).select("slot", "value", "l.description", "l.place")
