"""Prediction questions and metrics as JSON and tables."""

from __future__ import annotations

from typing import Any, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = ("target_node string, context map<string, string>, ground_truth_prediction string, "
            "synthetic_data_value string")


def write_questions(questions: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line; parts can be appended."""
    questions.select("target_node", "context", "ground_truth_prediction", "synthetic_data_value").write.mode(mode).json(path)


def read_questions(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Questions from JSON lines, or from files that hold one JSON array each."""
    return spark.read.schema(QUESTION).option("multiLine", array).json(path)


def numeric_leaves(document: Any, path: str = "") -> Iterator[tuple[str, float]]:
    """(path, value) of the numbers in one nested report; list items by index, no booleans."""
    if isinstance(document, bool) or document is None:
        return
    if isinstance(document, (int, float)):
        yield path, float(document)
    elif isinstance(document, dict):
        for k, v in document.items():
            yield from numeric_leaves(v, f"{path}.{k}" if path else str(k))
    elif isinstance(document, list):
        for i, v in enumerate(document):
            yield from numeric_leaves(v, f"{path}[{i}]")


def wide_to_metrics(report: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """(keys.., path, value): the numeric columns of report rows as leaves."""
    numeric = [f.name for f in report.schema.fields
               if f.name not in keys and f.dataType.typeName() in ("integer", "long", "float", "double", "decimal")]
    wide = report.select(*keys, *[F.col(c).cast("double").alias(c) for c in numeric])
    return wide.unpivot(keys, numeric, "path", "value").withColumn("path", F.concat(F.lit(f"{prefix}."), "path"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """(run, trial, model, path, value), partitioned so that trials add folders."""
    metrics.write.mode("append").partitionBy("run", "model", "trial").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def metrics_json(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., document): one JSON object of path -> value per report."""
    entries = F.array_sort(F.collect_list(F.struct("path", "value")))
    return metrics.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("document"))
