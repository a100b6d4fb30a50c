"""Tables the registered queries run on, derived from the driver's parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import spread
from causeway.sources.tables import read_keyed

STAR_COLUMNS = [
    "returnflag", "linestatus", "discount", "tax", "orderstatus", "priority", "segment",
    "ptype", "brand", "quantity", "price", "unitprice", "orderyear", "shipyear", "late",
]
NUMERIC_COLUMNS = [
    "quantity", "extendedprice", "discount", "tax", "totalprice", "retailprice", "acctbal",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    part = table(spark, sf_dir, "part")
    # customers meet the orders, which are fewer than the lines
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with fifteen discrete columns as text, and a row id.

    Three columns depend on others: price and quantity fix the unit price band, the two
    years decide most of ``late``.
    """
    lines = read_keyed(spark, f"{sf_dir}/lineitem.parquet", [
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ])

    def pct(c: str) -> F.Column:
        return F.round(F.col(c) * 100).cast("int").cast("string")

    unit = F.col("l_extendedprice") / F.col("l_quantity")
    band = F.lit("4")
    for name, top in (("3", 10000), ("2", 5000), ("1", 2500), ("0", 1000)):
        band = F.when(unit < top, F.lit(name)).otherwise(band)
    return _joined(spark, sf_dir, spread(lines)).select(
        "row_id",
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        pct("l_discount").alias("discount"),
        pct("l_tax").alias("tax"),
        F.col("o_orderstatus").alias("orderstatus"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("p_type").alias("ptype"),
        F.col("p_brand").alias("brand"),
        F.floor((F.col("l_quantity") - 1) / 10).cast("string").alias("quantity"),
        F.floor(F.col("l_extendedprice") / 21000).cast("string").alias("price"),
        band.alias("unitprice"),
        F.year("o_orderdate").cast("string").alias("orderyear"),
        F.year("l_shipdate").cast("string").alias("shipyear"),
        F.when(F.col("l_shipdate") > F.col("o_orderdate"), "y").otherwise("n").alias("late"),
    )


STAR_SQL = """
SELECT l_returnflag AS returnflag, l_linestatus AS linestatus,
       CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) AS discount,
       CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) AS tax,
       o_orderstatus AS orderstatus, o_orderpriority AS priority, c_mktsegment AS segment,
       p_type AS ptype, p_brand AS brand,
       CAST(CAST(floor((l_quantity - 1) / 10) AS BIGINT) AS VARCHAR) AS quantity,
       CAST(CAST(floor(l_extendedprice / 21000) AS BIGINT) AS VARCHAR) AS price,
       CASE WHEN l_extendedprice / l_quantity < 1000 THEN '0'
            WHEN l_extendedprice / l_quantity < 2500 THEN '1'
            WHEN l_extendedprice / l_quantity < 5000 THEN '2'
            WHEN l_extendedprice / l_quantity < 10000 THEN '3' ELSE '4' END AS unitprice,
       CAST(year(o_orderdate) AS VARCHAR) AS orderyear,
       CAST(year(l_shipdate) AS VARCHAR) AS shipyear,
       CASE WHEN l_shipdate > o_orderdate THEN 'y' ELSE 'n' END AS late
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
"""


def star_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with seven numeric columns."""
    lines = spread(table(spark, sf_dir, "lineitem"))
    return _joined(spark, sf_dir, lines).select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("o_totalprice").alias("totalprice"), F.col("p_retailprice").alias("retailprice"),
        F.col("c_acctbal").alias("acctbal"),
    )


NUMERIC_SQL = """
SELECT l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount,
       l_tax AS tax, o_totalprice AS totalprice, p_retailprice AS retailprice,
       c_acctbal AS acctbal
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
"""
