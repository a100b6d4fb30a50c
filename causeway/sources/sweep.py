"""Sweeps: defaults, datasets, runs, trials and models expanded into one row each."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SWEEP = ("name string, defaults map<string, string>, datasets array<map<string, string>>, "
         "runs array<map<string, string>>")


def read_sweeps(spark: SparkSession, path: str) -> DataFrame:
    """Sweep documents, one JSON object per file; values are read as text."""
    return spark.read.schema(SWEEP).option("multiLine", True).json(path)


def overlay(*maps: Column) -> Column:
    """Merge maps; later ones win."""
    def over(below: Column, above: Column) -> Column:
        return F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)

    return reduce(over, maps)


def expand(sweeps: DataFrame, known_models: Iterable[str]) -> DataFrame:
    """(name, dataset, run_ord, trial, model, settings): defaults < dataset < run.

    A sweep without runs has one empty run. Models come from the merged settings as a
    JSON list; an unknown model is an error.
    """
    known = F.array(*[F.lit(m) for m in known_models])
    none = F.array(F.create_map().cast("map<string,string>"))
    runs = F.when(F.size("runs") > 0, F.col("runs")).otherwise(none)
    rows = sweeps.select("name", "defaults", F.explode("datasets").alias("d"), runs.alias("runs"))
    rows = rows.select("name", "defaults", "d", F.posexplode("runs").alias("run_ord", "r"))
    merged = rows.withColumn("settings", overlay(F.col("defaults"), F.col("d"), F.col("r")))
    models = F.from_json(F.col("settings")["models"], "array<string>")
    trials = F.coalesce(F.col("settings")["num_trials"].cast("int"), F.lit(1))
    wide = merged.select("name", F.col("d")["name"].alias("dataset"), "run_ord", "settings",
                         F.explode(F.sequence(F.lit(0), trials - 1)).alias("trial"), models.alias("models"))
    out = wide.select("name", "dataset", "run_ord", "trial", F.explode("models").alias("model"), "settings")
    checked = F.when(F.array_contains(known, F.col("model")), F.col("model")).otherwise(
        F.raise_error(F.concat(F.lit("unknown model "), F.col("model")))
    )
    return out.withColumn("model", checked)
