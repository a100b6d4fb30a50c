"""Mixing sources to target weights by systematic sampling.

A source's documents are laid in a row, each as long as its expected number of copies; a comb of
teeth one apart, shifted by one random offset per source, then emits a document once for every tooth
that falls on it. All documents of a source expect ``target / source size`` copies, so the prefix sum
of ``i`` documents is ``i`` times that rate, and a document gets the rate rounded down or up. The row
is in order of size, so documents of one size are taken in proportion and the words taken stray from
the target by about one document at most.

Targets: sources in code point order weigh 1, 2, 3, repeating, and share all words by weight. A target
stops at ``max_repeats`` times its source's words; the excess goes to the others by weight. The sources
that stop are those with the fewest words per weight, so running sums in that order give the level at
which sharing ends, without rounds.

The place in the row is a rank by range partitions (``global_rank``), so a source may hold any share of
all rows. Only DataFrame expressions are used.

NULL texts have size 0, NULL sources are one source of their own (the last), repeated rows are rows of
their own. Offsets and ties come from MD5 of seed, source and doc_id, so reruns agree; rows that agree
in source, size and doc_id are told apart by their place in the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import join_groups, on_files, query, read, row_key, whole_rows
from causeway.operators.ranks import global_rank, running_sums
from causeway.session import durable

BLANK_WORD = r"[^\x20\x09-\x0D]+"


def _digits(text: Column, n: int) -> Column:
    """The first ``n`` hexadecimal digits of MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")


def source_targets(sources: DataFrame, max_repeats: int = 3) -> DataFrame:
    """``sources`` (source, size: words) with ``weight`` and ``target`` (DOUBLE, words)."""
    ranked = durable(global_rank(sources, [F.col("source").asc_nulls_last()], "_rank").withColumn("weight", F.col("_rank") % 3 + 1))
    whole = ranked.agg(F.sum("size").alias("t"), F.sum("weight").alias("w")).first()
    cap = F.col("size") * max_repeats
    order = [(cap / F.col("weight")).asc(), F.col("_rank").asc()]
    summed = running_sums(ranked, order, {"_s": "size", "_w": "weight"})
    # what is left for this source and all later ones, by weight
    level = (F.lit(whole.t) - max_repeats * (F.col("_s") - F.col("size"))) / (F.lit(whole.w) - (F.col("_w") - F.col("weight")))
    level = durable(summed.withColumn("_level", level).withColumn("_stops", cap <= F.col("_level") * F.col("weight")))
    first = F.min(F.struct(cap / F.col("weight"), "_rank", "_level").alias("f"))
    share = level.filter("not _stops").agg(first.alias("f")).select("f._level").first()[0]  # one number
    target = F.when(F.col("_stops"), cap.cast("double")).otherwise(F.lit(share) * F.col("weight"))
    return level.select(*sources.columns, "weight", target.alias("target"))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           max_repeats: int = 3, seed: int = 12) -> DataFrame:
    """One row per document: ``_row`` (key), doc_id, size, source_size, target, copies, taken (words)."""
    slim = row_key(
        on_files(docs), "_row", F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(BLANK_WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("_tie", _digits(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 15))
    slim = durable(slim)
    order = [F.col("source").asc_nulls_last(), F.asc("size"), F.asc("_tie"), F.col("doc_id").asc_nulls_last(), F.asc("_row")]
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = global_rank(slim, order, "_place").withColumn("_key", key)
    groups = rows.groupBy("_key", "source").agg(
        F.sum("size").alias("size"), F.count("*").alias("_n"), F.min("_place").alias("_lowest"))
    targets = source_targets(groups, max_repeats)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    start = _digits(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit(""))), 13).cast("double") / F.lit(float(2**52))
    targets = targets.select(
        "_key", "_n", "_lowest", F.col("size").alias("source_size"), "target", start.alias("_start")
    ).withColumn("_rate", rate)
    found = join_groups(rows, targets, "_key", "_n", slim.count())
    place = F.col("_place") - F.col("_lowest")
    teeth = F.floor((place + 1) * F.col("_rate") + F.col("_start")) - F.floor(place * F.col("_rate") + F.col("_start"))
    found = found.withColumn("copies", teeth.cast("long"))
    return found.select(
        "_row", "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns unchanged."""
    docs = on_files(docs)
    packed, unpacked = whole_rows(docs)
    taken = copies(docs, doc_id, text, source, **options).filter("copies > 0").select(F.col("_row").alias("_taken"), "copies")
    rows = row_key(docs, "_row", packed).join(taken, F.col("_row") == F.col("_taken"))
    return rows.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*unpacked)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('12:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS tie
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS r,
         ('0x' || substr(md5('12/' || coalesce(source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS start
  FROM d GROUP BY source),
lv AS (
  SELECT *, (sum(source_size) OVER () - 3 * (sum(source_size) OVER o - source_size))::DOUBLE
            / (sum(weight) OVER () - (sum(weight) OVER o - weight))::DOUBLE AS lvl
  FROM s WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, r ROWS UNBOUNDED PRECEDING)),
share AS (
  SELECT arg_min(lvl, ROW((3 * source_size)::DOUBLE / weight, r)) AS share FROM lv WHERE NOT 3 * source_size <= lvl * weight),
t AS (
  SELECT *, CASE WHEN 3 * source_size <= lvl * weight THEN (3 * source_size)::DOUBLE ELSE (SELECT share FROM share) * weight END AS target
  FROM lv),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.start,
         CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.tie, d.doc_id) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(i * rate + start) - floor((i - 1) * rate + start))::BIGINT * size AS taken FROM p
"""


@query("op12_mixing", SQL)
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source."""
    return copies(read(spark, sf_dir, "documents")).drop("_row", "copies")
