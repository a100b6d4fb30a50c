"""A log of responses that grows by appends and is looked up by key.

Every row lies in the bucket of its key's hash, a partition folder. A look-up learns which buckets the
asked keys fall into and scans only those; its plan is one scan and one join, however many appends
there were. Compaction writes the latest response of each key beside the old files of a bucket and
then deletes those. Stopped at any point it leaves rows twice at most, which a look-up cannot see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import advice

ROW = f"key string, content string, usage {advice.USAGE}, seq bigint"


class ResponseLog:
    """Responses under ``path``; of several with one key the highest ``seq`` counts, then the greatest content.

    The number of buckets is a property of the folder and must be the same for all who write to it. NULL
    keys answer no request and are not stored; neither are truncated answers. Rows of a frame that was
    read before a compaction must have been used by then.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        if buckets < 1:
            raise ValueError("a log needs at least one bucket")
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame) -> None:
        """Append rows (key, content, usage, seq); one file for each bucket they hold, more for a large one."""
        placed = rows.select("key", "content", "usage", F.col("seq").cast("bigint").alias("seq"), self._bucket())
        placed.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def append(self, answers: DataFrame, seq: int) -> None:
        """Add answers (key, content, truncated, usage) under a sequence number."""
        self._write(advice.storable(answers).where("key IS NOT NULL").withColumn("seq", F.lit(seq)))

    def _folders(self) -> list[int]:
        """Buckets that hold rows."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        names = [s.getPath().getName() for s in system.listStatus(root)]
        return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))

    def rows(self, wanted: list[int] | None = None) -> DataFrame:
        """All rows ever appended and not yet compacted away, of all buckets or those ``wanted``."""
        found = [b for b in self._folders() if wanted is None or b in set(wanted)]
        if not found:
            return self.spark.createDataFrame([], f"{ROW}, bucket int")
        reader = self.spark.read.schema(f"{ROW}, bucket int").option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/bucket={b}" for b in found])

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        best = rows.groupBy("key").agg(F.max(F.struct("seq", "content", "usage")).alias("r"))
        return best.select("key", "r.content", "r.usage", "r.seq")

    def latest(self) -> DataFrame:
        """(key, content, usage, seq): the response of every key."""
        return self._latest(self.rows())

    def lookup(self, asked: DataFrame) -> DataFrame:
        """(key, content, usage, seq) of those ``asked`` keys that have a response, each once."""
        keys = asked.select("key").where("key IS NOT NULL").distinct()
        hit = [r.bucket for r in keys.select(self._bucket()).distinct().collect()]  # at most ``buckets`` numbers
        return self._latest(self.rows(hit).join(keys, "key", "left_semi"))

    def parts(self) -> dict[int, int]:
        """Files in each bucket."""
        found: dict[int, int] = {}
        for name in self.rows().inputFiles():
            bucket = int(name.rsplit("/bucket=", 1)[1].split("/", 1)[0])
            found[bucket] = found.get(bucket, 0) + 1
        return found

    def compact(self, max_parts: int = 8) -> list[int]:
        """Reduce buckets of more than ``max_parts`` files to the latest response of each key; returns them.

        Only files listed before the rows are read are deleted, so appends made meanwhile stay.
        """
        full = sorted(b for b, n in self.parts().items() if n > max_parts)
        if full:
            old = self.rows(full)
            files = old.inputFiles()
            self._write(self._latest(old))
            conf = self.spark._jsc.hadoopConfiguration()
            for name in files:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(name))
                where.getFileSystem(conf).delete(where, False)
        return full
