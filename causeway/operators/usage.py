"""Ledger and cost of advisor calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.session import local_frame

# Price per million tokens as (most prompt tokens, input, cached input, output).
PRICES = {
    "gpt-5.4": [(272_000, 2.50, 0.25, 15.00), (None, 5.00, 0.50, 22.50)],
    "gemini-3.1-pro-preview": [(200_000, 2.00, 0.20, 12.00), (None, 4.00, 0.40, 18.00)],
    "accounts/fireworks/models/qwen3p6-plus": [(None, 0.50, 0.10, 3.00)],
    "accounts/fireworks/models/deepseek-v4-pro": [(None, 1.74, 0.15, 3.48)],
}
DATE_SUFFIX = r"-\d{4}-\d{2}-\d{2}$"


def price_tiers(spark: SparkSession) -> DataFrame:
    """(model, lo, hi, input, cached_input, output): disjoint tiers, lo < tokens <= hi."""
    rows = [(m, float("inf") if cap is None else float(cap), i, c, o)
            for m, tiers in PRICES.items() for cap, i, c, o in tiers]
    tiers = local_frame(spark, rows, "model string, hi double, input double, cached_input double, output double")
    below = F.lag("hi").over(Window.partitionBy("model").orderBy("hi"))
    return tiers.withColumn("lo", F.coalesce(below, F.lit(-1.0)))


def price_key(model: Column, known: list[str]) -> Column:
    """The model itself if priced, else its name without a date."""
    return F.when(model.isin(known), model).otherwise(F.regexp_replace(model, DATE_SUFFIX, ""))


def price_calls(calls: DataFrame) -> DataFrame:
    """Add ``cost`` to calls (model, prompt_tokens, cached_prompt_tokens, completion_tokens).

    The tier of the prompt size prices the whole call. Unpriced models give NULL.
    """
    tiers = F.broadcast(price_tiers(calls.sparkSession).withColumnRenamed("model", "priced"))
    keyed = calls.withColumn("priced_as", price_key(F.col("model"), list(PRICES)))
    joined = keyed.join(
        tiers,
        (F.col("priced_as") == F.col("priced")) & (F.col("prompt_tokens") > F.col("lo"))
        & (F.col("prompt_tokens") <= F.col("hi")),
        "left",
    )
    fresh = F.greatest(F.col("prompt_tokens") - F.col("cached_prompt_tokens"), F.lit(0))
    cost = (
        fresh * F.col("input") + F.col("cached_prompt_tokens") * F.col("cached_input")
        + F.col("completion_tokens") * F.col("output")
    ) / 1_000_000
    return joined.withColumn("cost", cost).select(*calls.columns, "cost")


def ledger(calls: DataFrame) -> DataFrame:
    """Per operation (answers from the store under ``<op>_cached``): calls, tokens, truncations."""
    bucket = F.when(F.col("cached"), F.concat("op", F.lit("_cached"))).otherwise(F.col("op"))
    return calls.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("cached_prompt_tokens").alias("cached_prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.count_if(F.col("truncated")).alias("truncated"),
    )


def usage_summary(calls: DataFrame) -> DataFrame:
    """One row per operation and one total (bucket NULL): calls, tokens, cost with and without the store.

    A cost is NULL as soon as one of its calls has no price.
    """
    priced = price_calls(calls).withColumn(
        "bucket", F.when(F.col("cached"), F.concat("op", F.lit("_cached"))).otherwise(F.col("op"))
    )
    complete = F.count_if(F.col("cost").isNull()) == 0
    billed = F.sum(F.when(~F.col("cached"), F.col("cost")).otherwise(0.0))
    billed_calls = F.count_if(~F.col("cached"))
    rolled = priced.rollup("bucket").agg(
        F.count("*").alias("calls"), billed_calls.alias("billed_calls"),
        F.count_if(F.col("cached")).alias("cached_calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("cached_prompt_tokens").alias("cached_prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.count_if(F.col("truncated")).alias("truncated"),
        F.try_divide(F.lit(100.0) * F.count_if(F.col("truncated")), billed_calls).alias("truncation_pct"),
        F.when(complete, F.sum("cost")).alias("cost_without_store"),
        F.when(complete, billed).alias("cost_with_store"),
    )
    return rolled.withColumn("saved", F.col("cost_without_store") - F.col("cost_with_store"))
