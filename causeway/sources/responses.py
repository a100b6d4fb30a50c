"""Stored responses and the advisor that uses them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from causeway.config import RequestSettings
from causeway.operators import advice
from causeway.session import durable, local_frame, shared_dir
from causeway.sources.response_log import ResponseLog

STORE = f"key string, content string, usage {advice.USAGE}, seq bigint"


def empty_store(spark: SparkSession) -> DataFrame:
    return local_frame(spark, [], STORE)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Latest response per key of all appended parts; an absent store is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return empty_store(spark)
    every = spark.read.schema(STORE).parquet(path)
    return advice.upsert(every, empty_store(spark))


def append_store(answers: DataFrame, path: str, seq: int) -> None:
    """Append storable answers; a later ``seq`` wins over earlier ones."""
    advice.storable(answers).withColumn("seq", F.lit(seq).cast("bigint")).write.mode("append").parquet(path)


class Advisor:
    """Answers request tables from stored responses and, for misses, a responder.

    Keeps the calls made within the budget and records them for the usage ledger. Responses go to a
    bucketed log, calls to one growing folder, so plans do not grow with the number of batches.
    """

    def __init__(self, spark: SparkSession, settings: RequestSettings, store: DataFrame | None = None,
                 responder: advice.Responder | None = None, max_calls: int = 20_000, buckets: int = 16) -> None:
        self.spark, self.settings = spark, settings
        folder = os.path.join(shared_dir(spark), f"advice-{uuid.uuid4().hex}")
        self._log, self._calls = ResponseLog(spark, f"{folder}/responses", buckets), f"{folder}/calls"
        self._batches = 0
        if store is not None:
            self._append(store.select("key", "content", "usage", F.lit(False).alias("truncated")))
        self._recorded: StructType | None = None
        self.responder, self.max_calls = responder, max_calls
        self.made = 0

    def _append(self, answers: DataFrame) -> None:
        self._batches += 1
        self._log.append(answers, self._batches)

    @property
    def store(self) -> DataFrame | None:
        """All stored responses."""
        return self._log.latest().drop("seq") if self._batches else None

    @property
    def calls(self) -> DataFrame | None:
        """All recorded calls."""
        return self.spark.read.schema(self._recorded).parquet(self._calls) if self._recorded else None

    def answer(self, rendered: DataFrame, op: str) -> DataFrame:
        """The rendered rows with ``content`` (NULL without an answer)."""
        asked = durable(advice.as_requests(rendered, op, self.settings))
        known = self._log.lookup(asked).drop("seq")
        hits, misses = advice.split_requests(asked, known)
        fresh = None
        if self.responder is not None:
            self.made = advice.check_budget(misses, self.made, self.max_calls)
            fresh = durable(advice.ask(misses, self.responder))
            self._append(fresh)
        self._record(hits, fresh, op)
        got = known.select("key", "content")
        if fresh is not None:
            got = got.unionByName(fresh.select("key", "content"))
        return asked.join(got, "key", "left").drop("key", "op", "system", "user")

    def _record(self, hits: DataFrame, fresh: DataFrame | None, op: str) -> None:
        def rows(df: DataFrame, cached: bool, truncated) -> DataFrame:
            tokens = [
                F.coalesce(F.col(f"usage.{c}"), F.lit(0)).cast("bigint").alias(c)
                for c in ("prompt_tokens", "cached_prompt_tokens", "completion_tokens", "total_tokens")
            ]
            return df.select(F.lit(op).alias("op"), F.lit(self.settings.model).alias("model"),
                             F.lit(cached).alias("cached"), *tokens, truncated.alias("truncated"))

        new = rows(hits, True, F.lit(False))
        if fresh is not None:
            new = new.unionByName(rows(fresh.where("usage IS NOT NULL"), False,
                                       F.coalesce("truncated", F.lit(False))))
        new.write.mode("append").parquet(self._calls)
        self._recorded = new.schema
