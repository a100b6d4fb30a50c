"""Which frames count as scans of files, and which are dealt anew."""

import os
import time

from pyspark.sql import functions as F

from causeway.operators.encode import encode_table
from causeway.plans import workloads as w
from causeway.session import CLEANUP_CONF, drop, durable, is_scan, spread


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange RoundRobinPartitioning")


def test_joins_and_unions_are_no_scans(spark, sf):
    lines, orders = w.table(spark, sf, "lineitem"), w.table(spark, sf, "orders")
    assert is_scan(lines) and is_scan(lines.select("l_tax").where("l_tax > 0"))
    assert not is_scan(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_tax"))
    assert not is_scan(lines.union(lines)) and not is_scan(w.star(spark, sf))


def test_a_source_with_joins_is_written_before_it_is_encoded(spark, sf):
    coded = encode_table(w.star(spark, sf), ["returnflag", "late"], pin=False).codes
    assert is_scan(coded)


def test_only_scans_in_few_pieces_are_spread(spark, sf, tmp_path):
    lines = w.table(spark, sf, "lineitem")
    assert shuffles(spread(lines)) == 1 and shuffles(spread(w.star(spark, sf))) == 1  # the lines' own
    lines.coalesce(1).write.option("parquet.block.size", 1 << 14).parquet(str(tmp_path / "one"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:  # one file, read in many pieces
        assert shuffles(spread(spark.read.parquet(str(tmp_path / "one")))) == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_shuffles_of_a_written_table_are_removed(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle")}

    before = shuffles()
    counts = durable(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before and counts.count() == 100
    assert spark.conf.get(CLEANUP_CONF, None) is None
    drop(counts)
    assert not os.path.exists(counts._written.removeprefix("file://"))
