"""Table access: Parquet folders by name, with an additive schema registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, folder: str, name: str, schema: str | StructType | None = None) -> DataFrame:
    """The table ``name``. With a schema, missing columns come as null and known ones are cast, so old files keep working."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if schema is None:
        return df
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Exported JSON arrays or objects; the schema is given, never inferred by a pass over the data."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
