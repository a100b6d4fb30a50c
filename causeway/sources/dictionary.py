"""Variable dictionaries: JSON documents with names, descriptions and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<name: string, description: string, states_description: map<string, string>>"


def parse_dictionary(document: Column) -> Column:
    return F.from_json(document, f"map<string, {ENTRY}>")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(var, name, description, states) of one file or a folder of files; files parse in parallel."""
    return variables(spark.read.text(path, wholetext=True).select(F.col("value").alias("document")))


def variables(documents: DataFrame) -> DataFrame:
    """(var, name, description, states) from (document); a missing description falls back to the name."""
    listed = documents.select(F.explode(parse_dictionary(F.col("document"))).alias("var", "e"))
    return listed.select(
        "var", F.coalesce("e.name", "var").alias("name"),
        F.coalesce("e.description", "e.name", "var").alias("description"),
        F.col("e.states_description").alias("states"),
    )


def described_states(dictionary: DataFrame) -> DataFrame:
    """(var, state, text)."""
    return dictionary.select("var", F.explode("states").alias("state", "text"))
