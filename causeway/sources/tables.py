"""Training tables: scans with stable row ids, CSV rules and sinks."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import durable

# A value no data file contains: keeps Spark from reading "", "NA" or "None" as NULL.
NO_NULL = "\u0001no-null\u0001"


def read_keyed_csv(spark: SparkSession, path: str, schema: str | None = None, key: str = "row_id") -> DataFrame:
    """CSV with a row id; the table is written once, since positions in text files are not kept by the scan."""
    return with_row_id(read_csv(spark, path, schema), key)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; every cell is text and stays what it is, empty cells are ''."""
    reader = (
        spark.read.option("header", True).option("nullValue", NO_NULL).option("emptyValue", "")
        .option("inferSchema", False)
    )
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def read_keyed(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               key: str = "row_id") -> DataFrame:
    """Parquet scan with a row id made of the file's path and the position in the file.

    The id comes from the scan itself: no shuffle, and a retried task reads the same ids.
    """
    df = spark.read.parquet(path)
    wanted = list(columns) if columns is not None else df.columns
    return df.select(
        F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(key),
        *wanted,
    )


def with_row_id(df: DataFrame, key: str = "row_id") -> DataFrame:
    """A row id for any frame; it is written once so that later reads agree on it."""
    return durable(df.withColumn(key, F.monotonically_increasing_id()))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and columns in name order; an existing path is an error."""
    df.select(*sorted(df.columns)).write.option("header", True).csv(path, mode="error")
