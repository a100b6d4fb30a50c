"""Queries on encodings, counts, scores and samples."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.hashing import BITS
from causeway.operators import counts, encode, sampling, scores
from causeway.operators.counts import Family
from causeway.plans import workloads as w
from causeway.plans.registry import query
from causeway.session import local_frame, shared_dir
from causeway.sources import tables

CUBE = ["returnflag", "linestatus", "orderstatus", "late", "shipyear"]
UNPIVOT = "SELECT var, state FROM star UNPIVOT (state FOR var IN ({}))"
STAR = f"WITH star AS ({w.STAR_SQL})"
ALL = ", ".join(w.STAR_COLUMNS)
NUM = f"WITH num AS ({w.NUMERIC_SQL})"


@query("csv_scan", """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type,
       CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'view' THEN 'None'
            ELSE 'NA' END AS note
FROM events""")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Write events as CSV with awkward cells and read them back unchanged."""
    src = w.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"), "event_type",
        F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "view", "None")
        .otherwise("NA").alias("note"),
    )
    path = os.path.join(shared_dir(spark), f"csv-{uuid.uuid4().hex}")
    tables.write_csv(src, path)
    return tables.read_csv(spark, path)


@query("drop_ignored", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def drop_ignored(spark, sf):
    return encode.drop_columns(
        w.table(spark, sf, "orders"), ["o_custkey", "o_orderdate", "o_orderpriority", "absent"]
    )


@query("stringify", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type,
       CAST(p_size AS VARCHAR) AS p_size FROM part""")
def stringify(spark, sf):
    return encode.as_text(w.table(spark, sf, "part").drop("p_retailprice"))


@query("prefix_columns", "SELECT l_discount, l_tax, l_returnflag FROM lineitem")
def prefix_columns(spark, sf):
    lines = w.table(spark, sf, "lineitem")
    names = [c for p in ("l_disc", "l_tax", "l_ret") for c in encode.columns_with_prefix(lines, p)]
    return lines.select(*names)


@query("codebook", f"""{STAR}, long AS ({UNPIVOT.format(ALL)})
SELECT var, state, count(*) AS n,
       CAST(row_number() OVER (PARTITION BY var ORDER BY state) - 1 AS INTEGER) AS code
FROM long GROUP BY var, state""")
def codebook(spark, sf):
    return encode.codebook(w.star(spark, sf), w.STAR_COLUMNS)


@query("codebook_wide", """
SELECT 'o_orderkey' AS var, CAST(o_orderkey AS VARCHAR) AS state, count(*) AS n,
       dense_rank() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS code
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey
UNION ALL SELECT 'p_name', p_name, count(*), dense_rank() OVER (ORDER BY p_name) - 1
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name""")
def codebook_wide(spark, sf):
    """States that grow with the rows: order keys and part names of all line items."""
    lines = w.table(spark, sf, "lineitem").select("l_partkey", F.col("l_orderkey").alias("o_orderkey"))
    parts = w.table(spark, sf, "part").select("p_partkey", "p_name")
    return encode.dictionary(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), ["o_orderkey", "p_name"])


@query("encoded_wide", """
SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY CAST(l_orderkey AS VARCHAR)) - 1 AS order_code,
       dense_rank() OVER (ORDER BY p_name) - 1 AS name_code
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def encoded_wide(spark, sf):
    """Codes of both columns beside every line item."""
    parts = w.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name_code"))
    lines = w.table(spark, sf, "lineitem").withColumn("order_code", F.col("l_orderkey"))
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return encode.encode_wide(rows, ["order_code", "name_code"], ["l_orderkey", "l_linenumber"])


@query("encoded_rows", f"""{STAR}, coded AS (SELECT
  {', '.join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}" for c in CUBE)} FROM star)
SELECT {', '.join(CUBE)}, count(*) AS n FROM coded GROUP BY ALL""")
def encoded_rows(spark, sf):
    coded = encode.encode_table(w.star(spark, sf), CUBE)
    return coded.codes.groupBy(*CUBE).agg(F.count("*").alias("n"))


@query("cardinalities", f"""{STAR}, long AS ({UNPIVOT.format(ALL)})
SELECT var, CAST(count(DISTINCT state) AS INTEGER) AS r FROM long GROUP BY var""")
def cardinalities(spark, sf):
    return encode.cardinalities(encode.codebook(w.star(spark, sf), w.STAR_COLUMNS))


@query("state_catalogue", f"""{STAR}, long AS ({UNPIVOT.format(ALL)})
SELECT var, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM long GROUP BY var""")
def state_catalogue(spark, sf):
    out = encode.state_catalogue(w.star(spark, sf), w.STAR_COLUMNS)
    return out.select("var", F.array_join("states", ",").alias("states"))


@query("numeric_or_code", f"""{STAR}, coded AS (SELECT
  CAST(discount AS DOUBLE) AS discount, CAST(shipyear AS DOUBLE) AS shipyear,
  CAST(dense_rank() OVER (ORDER BY segment) - 1 AS DOUBLE) AS segment FROM star)
SELECT discount, shipyear, segment, count(*) AS n FROM coded GROUP BY ALL""")
def numeric_or_code(spark, sf):
    cols = ["discount", "shipyear", "segment"]
    out = encode.numeric_or_code(w.star(spark, sf), cols)
    return out.groupBy(*cols).agg(F.count("*").alias("n"))


@query("numeric_columns", f"""{STAR}, long AS ({UNPIVOT.format(ALL)})
SELECT var, count(try_cast(state AS DOUBLE)) = count(*) AS "numeric" FROM long GROUP BY var""")
def numeric_columns(spark, sf):
    return encode.numeric_columns(w.star(spark, sf), w.STAR_COLUMNS)


@query("first_seen", """
WITH long AS (SELECT o_orderkey, var, state FROM
  (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders)
  UNPIVOT (state FOR var IN (o_orderstatus, o_orderpriority))),
f AS (SELECT var, state, min(o_orderkey) AS first_row FROM long GROUP BY ALL)
SELECT var, state, first_row,
       CAST(row_number() OVER (PARTITION BY var ORDER BY first_row) - 1 AS INTEGER) AS code FROM f""")
def first_seen(spark, sf):
    return encode.first_seen_codes(
        w.table(spark, sf, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"]
    )


@query("evidence_filter", """
SELECT event_id, event_type AS target,
  concat_ws(',', CASE WHEN event_type <> 'click' THEN 'click=' || CAST(user_id AS VARCHAR) END,
    CASE WHEN event_type <> 'view' AND user_id % 3 <> 0 THEN 'view=' || props END) AS ev
FROM events""")
def evidence_filter(spark, sf):
    events = w.table(spark, sf, "events")
    context = F.create_map(
        F.lit("click"), F.col("user_id").cast("string"), F.lit("unknown"), F.lit("x"),
        F.lit("view"), F.when(F.col("user_id") % 3 != 0, F.col("props")),
    )
    ev = encode.evidence(context, ["click", "view", "error"], F.col("event_type"))
    pairs = F.transform(F.map_entries(ev), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return events.select("event_id", F.col("event_type").alias("target"), F.array_join(pairs, ",").alias("ev"))


@query("edge_hygiene", """
WITH raw AS (SELECT l_orderkey * 10 + l_linenumber AS ord, sn.n_name AS parent, cn.n_name AS child
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey),
known AS (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2)
SELECT parent, child, min(ord) AS ord FROM raw
WHERE parent <> child AND parent IN (SELECT * FROM known) AND child IN (SELECT * FROM known)
GROUP BY parent, child""")
def edge_hygiene(spark, sf):
    lines, orders = w.table(spark, sf, "lineitem"), w.table(spark, sf, "orders")
    nation = w.table(spark, sf, "nation")
    sn = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("parent"))
    cn = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("child"))
    raw = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(w.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(w.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(sn, "s_nationkey").join(cn, "c_nationkey")
        .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "parent", "child")
    )
    known = nation.where(F.col("n_regionkey") != 2).select(F.col("n_name").alias("node"))
    return encode.clean_edges(raw, known, "ord")


@query("long_form", """
SELECT event_id, var AS node, state FROM
 (SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events)
 UNPIVOT (state FOR var IN (event_type, user_id))""")
def long_form(spark, sf):
    events = encode.as_text(w.table(spark, sf, "events").select("event_id", "event_type", "user_id"),
                            ["event_type", "user_id"])
    return encode.long_form(events, ["event_id"], ["event_type", "user_id"], name="node")


@query("family_counts", f"""{STAR}
SELECT orderyear, shipyear, late, count(*) AS n FROM star GROUP BY ALL""")
def family_counts(spark, sf):
    return counts.group_counts(w.star(spark, sf), "late", ["orderyear", "shipyear"])


FAMILIES = [
    Family(0, "late", ("orderyear", "shipyear")), Family(1, "unitprice", ("price", "quantity")),
    Family(2, "returnflag", ("linestatus",)), Family(3, "brand", ()),
]


def _family_sql(f: Family) -> str:
    cfg = " || '|' || ".join(f.parents) if f.parents else "''"
    return f"SELECT '{f.child}' AS node, {cfg} AS cfg, {f.child} AS state, count(*) AS n FROM star GROUP BY ALL"


@query("family_batch", f"{STAR} " + " UNION ALL ".join(_family_sql(f) for f in FAMILIES))
def family_batch(spark, sf):
    """Four families counted together in one scan of the codes."""
    cols = sorted({c for f in FAMILIES for c in (f.child, *f.parents)})
    coded = encode.encode_table(w.star(spark, sf), cols)
    meta = counts.family_frame(spark, FAMILIES, coded.states)
    cells = counts.decode_counts(counts.family_counts(coded.codes, FAMILIES, coded.cards), meta)
    return cells.select("node", F.array_join("cfg", "|").alias("cfg"), "state", "n")


def _cpt_sql(f: Family) -> str:
    """Every state of every occurring configuration, with zero counts."""
    pa = ", ".join(f.parents)
    cfg = " || '|' || ".join(f"t.{p}" for p in f.parents)
    same = " AND ".join(f"s.{p} = t.{p}" for p in f.parents)
    return f"""SELECT '{f.child}' AS node, {cfg} AS cfg, k.state,
      count(s.{f.child}) AS n, round(count(s.{f.child}) / min(t.total), 9) AS p
    FROM (SELECT {pa}, count(*) AS total FROM star GROUP BY {pa}) t
    CROSS JOIN (SELECT DISTINCT {f.child} AS state FROM star) k
    LEFT JOIN star s ON {same} AND s.{f.child} = k.state
    GROUP BY cfg, k.state"""


@query("cpt", f"{STAR} " + " UNION ALL ".join(_cpt_sql(f) for f in FAMILIES[:3]))
def cpt(spark, sf):
    cols = sorted({c for f in FAMILIES[:3] for c in (f.child, *f.parents)})
    coded = encode.encode_table(w.star(spark, sf), cols)
    rows = counts.cpt_rows(counts.fit_cpts(coded, FAMILIES[:3]))
    return rows.select("node", F.array_join("cfg", "|").alias("cfg"), "state", "n", F.round("p", 9).alias("p"))


def _upper(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i:]]


@query("covariance", f"{NUM} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) AS cov, count(*) AS n FROM num"
    for a, b in _upper(w.NUMERIC_COLUMNS)))
def covariance(spark, sf):
    out = counts.covariance(w.star_numeric(spark, sf), w.NUMERIC_COLUMNS)
    return out.select("a", "b", F.round("cov", 4).alias("cov"), "n")


SPARSE = [f"{c}{k}" for k in range(5) for c in w.NUMERIC_COLUMNS]
SPARSE_SQL = ", ".join(
    f"CASE WHEN quantity % 5 = {k} THEN NULL ELSE {c} * {k + 1} + quantity END AS {c}{k}"
    for k in range(5) for c in w.NUMERIC_COLUMNS)


def _sparse(spark, sf):
    return w.star_numeric(spark, sf).select(*[
        F.when(F.col("quantity") % 5 != k, F.col(c) * (k + 1) + F.col("quantity")).alias(f"{c}{k}")
        for k in range(5) for c in w.NUMERIC_COLUMNS
    ])


@query("covariance_wide", f"""{NUM}, s AS (SELECT {SPARSE_SQL} FROM num)
SELECT e.a AS a, e.b AS b, round(e.cov, 2) AS cov, e.n AS n FROM (SELECT unnest([{', '.join(
    f"{{'a': '{a}', 'b': '{b}', 'cov': covar_samp({a}, {b}), 'n': count(*)}}" for i, a in enumerate(SPARSE) for b in SPARSE[i:])}]) AS e FROM s)""")
def covariance_wide(spark, sf):
    """35 columns, each without a value in a fifth of the rows."""
    return counts.covariance(_sparse(spark, sf), SPARSE).select("a", "b", F.round("cov", 2).alias("cov"), "n")


@query("correlation", f"{NUM} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM num"
    for a in w.NUMERIC_COLUMNS for b in w.NUMERIC_COLUMNS))
def correlation(spark, sf):
    out = counts.correlation(w.star_numeric(spark, sf), w.NUMERIC_COLUMNS)
    return out.select("a", "b", F.round("corr", 6).alias("corr"))


@query("correlation_wide", f"""{NUM}, s AS (SELECT {SPARSE_SQL} FROM num)
SELECT e.a AS a, e.b AS b, round(e.corr, 6) AS corr FROM (SELECT unnest([{', '.join(
    f"{{'a': '{a}', 'b': '{b}', 'corr': corr({a}, {b})}}" for a in SPARSE for b in SPARSE)}]) AS e FROM s)""")
def correlation_wide(spark, sf):
    """The same columns; each pair over the rows that have both values."""
    out = counts.correlation(_sparse(spark, sf), SPARSE)
    return out.select("a", "b", F.round("corr", 6).alias("corr"))


SCORED = FAMILIES[:3] + [Family(3, "segment", ()), Family(4, "brand", ("ptype",))]


def _bdeu_sql(f: Family, ess: float = 1.0) -> str:
    """BDeu of one family; r and q count states, occurring or not."""
    q = " * ".join([f"(SELECT count(DISTINCT {p}) FROM star)" for p in f.parents] or ["1"])
    pa = ", ".join(f.parents)
    group = f"GROUP BY {pa}, {f.child}" if f.parents else f"GROUP BY {f.child}"
    keep = f"{pa}, " if pa else ""
    outer = f"GROUP BY {pa}" if pa else ""
    return f"""SELECT '{f.child}' AS node, '{','.join(f.parents)}' AS parents, round(sum(gain), 4) AS score FROM (
      SELECT sum(lgamma(n + b) - lgamma(b)) + lgamma(min(a)) - lgamma(min(a) + sum(n)) AS gain FROM (
        SELECT {keep}count(*) AS n, {ess} / ({q}) AS a,
               {ess} / (({q}) * (SELECT count(DISTINCT {f.child}) FROM star)) AS b
        FROM star {group}) {outer})"""


@query("bdeu_local", f"{STAR} " + " UNION ALL ".join(_bdeu_sql(f) for f in SCORED))
def bdeu_local(spark, sf):
    cols = sorted({c for f in SCORED for c in (f.child, *f.parents)})
    coded = encode.encode_table(w.star(spark, sf), cols)
    out = scores.bdeu_scores(coded, SCORED)
    return out.select("node", F.array_join("parents", ",").alias("parents"), F.round("score", 4).alias("score"))


NET_EDGES = [("orderyear", "late"), ("shipyear", "late"), ("price", "unitprice"),
             ("quantity", "unitprice"), ("linestatus", "returnflag"), ("absent", "late")]


@query("bdeu_network", f"{STAR} SELECT round(sum(score), 3) AS score FROM (" + " UNION ALL ".join(
    _bdeu_sql(f) for f in [*FAMILIES[:3], *[Family(9, c, ()) for c in
                                          ("orderyear", "shipyear", "price", "quantity", "linestatus")]]
) + ")")
def bdeu_network(spark, sf):
    """Whole-network score; the parent without a column is left out."""
    nodes = sorted({n for e in NET_EDGES for n in e})
    coded = encode.encode_table(w.star(spark, sf), [n for n in nodes if n != "absent"])
    out = scores.network_bdeu(coded, nodes, NET_EDGES)
    return out.select(F.round("score", 3).alias("score"))


@query("bic_one_parent", f"""{NUM}, m AS (SELECT count(*) AS n, var_samp(extendedprice) AS vy,
  var_samp(quantity) AS vx, covar_samp(extendedprice, quantity) AS c FROM num)
SELECT 'extendedprice' AS node, '' AS parents,
  round(-0.5 * n * (1 + ln(vy)) - 0.5 * ln(n), 3) AS score FROM m
UNION ALL SELECT 'extendedprice', 'quantity',
  round(-0.5 * n * (1 + ln(vy - c * c / vx)) - 0.5 * 2 * ln(n), 3) FROM m""")
def bic_one_parent(spark, sf):
    cov, n = counts.covariance_matrix(w.star_numeric(spark, sf), w.NUMERIC_COLUMNS)
    families = spark.createDataFrame(
        [(0, "extendedprice", []), (1, "extendedprice", ["quantity"])],
        "family_id int, node string, parents array<string>",
    )
    out = scores.bic_scores(families, cov, n, w.NUMERIC_COLUMNS)
    return out.select("node", F.array_join("parents", ",").alias("parents"), F.round("score", 3).alias("score"))


@query("bic_deterministic", f"""{NUM}, m AS (SELECT count(*) AS n, var_samp(discount) AS v FROM num)
SELECT 'discount' AS node, '' AS parents,
  round(-0.5 * n * (1 + ln(v + 0.01)) - 0.5 * ln(n), 3) AS score FROM m""")
def bic_deterministic(spark, sf):
    cov, n = counts.covariance_matrix(w.star_numeric(spark, sf), w.NUMERIC_COLUMNS)
    families = spark.createDataFrame(
        [(0, "discount", [])], "family_id int, node string, parents array<string>"
    )
    out = scores.bic_scores(families, cov, n, w.NUMERIC_COLUMNS, det_epsilon=0.01)
    return out.select("node", F.array_join("parents", ",").alias("parents"), F.round("score", 3).alias("score"))


FD = ["nation", "region", "segment"]


@query("functional_deps", f"""
WITH t AS (SELECT n_name AS nation, CAST(n_regionkey AS VARCHAR) AS region, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey) """ + " UNION ALL ".join(
    f"SELECT '{a}' AS determinant, '{b}' AS dependent FROM t "
    f"HAVING count(DISTINCT ({a}, {b})) = count(DISTINCT {a})" for a in FD for b in FD if a != b))
def functional_deps(spark, sf):
    t = w.table(spark, sf, "customer").join(
        w.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("n_name").alias("nation"), F.col("n_regionkey").cast("string").alias("region"),
             F.col("c_mktsegment").alias("segment"))
    return scores.functional_dependencies(encode.encode_table(t, FD))


LATTICE = [*w.STAR_COLUMNS, "terms", "mix"]  # terms stands for two columns, mix follows from three


def _lattice_sql() -> str:
    """Combinations of up to four columns, then sets that no smaller set makes needless."""
    names = sorted(LATTICE)
    codes = ", ".join(f"dense_rank() OVER (ORDER BY {c})" for c in names)
    sizes = ["SELECT []::BIGINT[] AS s, 1 AS k"]
    for n in (1, 2, 3, 4):
        v = "abcd"[:n]
        sets = ", ".join(f"unnest(range(1, {len(names) + 1})) AS t{c}({c})" for c in v)
        order = " AND ".join(f"{p} < {q}" for p, q in zip(v, v[1:])) or "TRUE"
        sizes.append(f"SELECT [{', '.join(v)}] AS s, count(*) AS k FROM (SELECT DISTINCT {', '.join(f'{c}, v[{c}]' for c in v)}"
                     f" FROM coded, (SELECT * FROM {sets} WHERE {order}) q) GROUP BY {', '.join(v)}")
    return f"""{STAR}, wide AS (SELECT *, discount || '/' || tax AS terms,
  CAST((CAST(discount AS INT) + CAST(tax AS INT) + CAST(quantity AS INT)) % 3 AS VARCHAR) AS mix FROM star),
coded AS (SELECT [{codes}]::SMALLINT[] AS v FROM wide), sizes AS ({' UNION ALL '.join(sizes)}),
more AS (SELECT s, k, y, list_sort(list_append(s, y)) AS t FROM sizes, unnest(range(1, {len(names) + 1})) AS u(y)
  WHERE len(s) <= 3 AND NOT list_contains(s, y)),
det AS (SELECT more.s, more.y FROM more JOIN sizes q ON q.s = more.t WHERE q.k = more.k),
least_ AS (SELECT * FROM det WHERE NOT EXISTS (
  SELECT 1 FROM det d WHERE d.y = det.y AND len(d.s) < len(det.s) AND list_has_all(det.s, d.s)))
SELECT array_to_string(list_transform(s, lambda i: names[i]), ',') AS determinant, names[y] AS dependent
FROM least_, (SELECT [{', '.join(f"'{c}'" for c in names)}] AS names)"""


@query("minimal_dependencies", _lattice_sql())
def minimal_dependencies(spark, sf):
    """Smallest sets of up to three columns that fix another one, over all columns and two derived ones."""
    digits = F.col("discount").cast("int") + F.col("tax").cast("int") + F.col("quantity").cast("int")
    wide = w.star(spark, sf).withColumns({"terms": F.concat_ws("/", "discount", "tax"), "mix": (digits % 3).cast("string")})
    coded = encode.encode_table(wide, LATTICE)
    found = [(",".join(s), y) for s, y in scores.minimal_dependencies(coded)]
    return local_frame(spark, found, "determinant string, dependent string")


MIXED = {"levy": "discount + tax", "rest": "totalprice - extendedprice", "net": "extendedprice - 2 * retailprice + 100 * quantity"}
SUMS = sorted([*w.NUMERIC_COLUMNS, *MIXED])


def _sweep_sql(threshold: float = 1e-5) -> str:
    """One sweep after another over the correlations, as rows (i, j, v)."""
    one = ", ".join([f"corr({a}, {b}) AS {a}_{b}" for a in SUMS for b in SUMS if a < b] + [f"stddev_samp({c}) AS s_{c}" for c in SUMS])
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS i, '{b}' AS j, {'1.0::DOUBLE' if a == b else min(a, b) + '_' + max(a, b)} AS v FROM one" for a in SUMS for b in SUMS)
    out = [f"r0 AS MATERIALIZED ({pairs})"]
    for k in range(1, len(SUMS) + 1):
        r = f"r{k - 1}"
        out.append(f"p{k} AS MATERIALIZED (SELECT i, v AS d FROM {r} WHERE i = j AND round(v, 9) > {threshold} ORDER BY round(v, 9) DESC, i LIMIT 1)")
        out.append(f"""r{k} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = p.i AND a.j = p.i THEN -1 / d WHEN a.i = p.i OR a.j = p.i THEN a.v / d
  ELSE a.v - x.v * y.v / d END AS v FROM {r} a, p{k} p JOIN {r} x ON x.j = p.i JOIN {r} y ON y.i = p.i WHERE x.i = a.i AND y.j = a.j
  UNION ALL SELECT * FROM {r} WHERE NOT EXISTS (SELECT 1 FROM p{k}))""")
    basis = " UNION ALL ".join(f"SELECT i FROM p{k}" for k in range(1, len(SUMS) + 1))
    scale = " UNION ALL ".join(f"SELECT '{c}' AS c, s_{c} AS s FROM one" for c in SUMS)
    return f"""{NUM}, wide AS (SELECT *, {', '.join(f'{e} AS "{c}"' for c, e in MIXED.items())} FROM num),
one AS MATERIALIZED (SELECT {one} FROM wide), {', '.join(out)},
basis AS ({basis}), scale AS ({scale})
SELECT f.j AS dependent, f.i AS basis, round(f.v * a.s / b.s, 6) AS weight FROM r{len(SUMS)} f JOIN scale a ON a.c = f.j JOIN scale b ON b.c = f.i
WHERE f.i IN (SELECT i FROM basis) AND f.j NOT IN (SELECT i FROM basis) AND abs(f.v) > {threshold}"""


@query("linear_dependencies", _sweep_sql())
def linear_dependencies(spark, sf):
    """Seven numeric columns and three sums of them: which follow from the others, and with what weights."""
    wide = w.star_numeric(spark, sf).withColumns({c: F.expr(e) for c, e in MIXED.items()})
    cov, _ = counts.covariance_matrix(wide, SUMS)
    found = [(d, b, round(x, 6)) for d, b, x in scores.linear_relations(cov, SUMS)[1]]
    return local_frame(spark, found, "dependent string, basis string, weight double")


SAMPLES, PICKED, SEED = 6, 40, 7
_H = "CAST(('0x' || substr(md5({}), 1, 13)) AS UBIGINT)"
_U = f"((CAST({_H} AS DOUBLE) + 0.5) / {float(2**BITS)!r})"


@query("sample_rows", f"""
WITH RECURSIVE base AS (SELECT event_id AS k, (SELECT count(*) FROM events) AS total FROM events),
r AS (SELECT k, CASE WHEN {PICKED} >= total THEN 1.0 ELSE
    least(1.0, ({PICKED} + {sampling.SIGMAS} * sqrt({PICKED}) + 32) / total) END AS rate FROM base),
walk AS (
  SELECT k, rate, 0 AS i,
    least(floor(ln({_U.format(f"k || '|{SEED}|gap|0'")}) / ln(1 - rate)), {SAMPLES}) AS pos FROM r WHERE rate < 1
  UNION ALL
  SELECT k, rate, i + 1, pos + 1 + least(floor(ln({_U.format(
      f"k || '|{SEED}|gap|' || CAST(i + 1 AS VARCHAR)")}) / ln(1 - rate)), {SAMPLES})
  FROM walk WHERE pos < {SAMPLES}),
hit AS (SELECT k, CAST(pos AS INTEGER) AS sample_id FROM walk WHERE pos < {SAMPLES}
  UNION ALL SELECT k, CAST(s AS INTEGER) FROM r, range({SAMPLES}) g(s) WHERE rate >= 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY
    {_H.format(f"k || '|' || CAST(sample_id + {SEED} AS VARCHAR) || '|rank'")}, k) AS pick FROM hit)
SELECT k AS event_id, sample_id, CAST(pick AS INTEGER) AS pick FROM ranked WHERE pick <= {PICKED}""")
def sample_rows(spark, sf):
    out = sampling.sample_rows(
        w.table(spark, sf, "events").select("event_id"), ["event_id"], SAMPLES, PICKED, SEED, portable=True
    )
    return out.select("event_id", "sample_id", "pick")


@query("sample_cols", f"""
WITH pool AS (SELECT DISTINCT p_brand AS c FROM part),
ranked AS (SELECT c_custkey, c, row_number() OVER (PARTITION BY c_custkey ORDER BY
    {_H.format(f"CAST(c_custkey + {SEED} AS VARCHAR) || '|' || c")}, c) AS rk FROM customer CROSS JOIN pool)
SELECT c_custkey AS sample_id, string_agg(c, ',' ORDER BY rk) AS cols FROM ranked WHERE rk <= 5
GROUP BY c_custkey""")
def sample_cols(spark, sf):
    """Five brands per customer."""
    brands = [r["p_brand"] for r in w.table(spark, sf, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    samples = w.table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"))
    out = sampling.sample_columns(samples, brands, 5, SEED, portable=True)
    return out.select("sample_id", F.array_join("cols", ",").alias("cols"))


@query("forced_cols", f"""
WITH pool AS (SELECT DISTINCT p_brand AS c FROM part),
forced AS (SELECT s_suppkey, p_brand AS c, min(p_partkey) AS ord FROM supplier
  JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  GROUP BY ALL),
ranked AS (SELECT s_suppkey, pool.c, row_number() OVER (PARTITION BY s_suppkey ORDER BY
    CASE WHEN ord IS NULL THEN 1 ELSE 0 END, ord,
    {_H.format(f"CAST(s_suppkey + {SEED} AS VARCHAR) || '|' || pool.c")}, pool.c) AS rk
  FROM supplier CROSS JOIN pool LEFT JOIN forced USING (s_suppkey, c))
SELECT s_suppkey AS sample_id, string_agg(c, ',' ORDER BY rk) AS cols FROM ranked WHERE rk <= 5
GROUP BY s_suppkey""")
def forced_cols(spark, sf):
    """Brands a supplier sold first, by part (up to five), the rest in hash order."""
    brands = [r["p_brand"] for r in w.table(spark, sf, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    sold = (
        w.table(spark, sf, "lineitem")
        .join(w.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "p_brand").agg(F.min("p_partkey").alias("ord"))
        .groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("ord", "p_brand"))).alias("o"))
        .select("l_suppkey", F.transform("o", lambda s: s["p_brand"]).alias("forced"))
    )
    samples = w.table(spark, sf, "supplier").join(sold, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        F.col("s_suppkey").alias("sample_id"),
        F.coalesce("forced", F.array().cast("array<string>")).alias("forced"),
    )
    out = sampling.sample_columns(samples, brands, 5, SEED, portable=True, forced="forced")
    return out.select("sample_id", F.array_join("cols", ",").alias("cols"))


@query("weighted_cols")
def weighted_cols(spark, sf):
    """Column samples that favour brands of the same manufacturer group, one per supplier."""
    brands = [r["p_brand"] for r in w.table(spark, sf, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    related = {b: {c for c in brands if c != b and c[:7] == b[:7]} for b in brands}
    samples = w.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"))
    out = sampling.sample_columns_weighted(samples, brands, 5, SEED, related, 5.0)
    return out.select("sample_id", F.array_join("cols", ",").alias("cols"))


@query("split_exact", f"""
WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY
    {_H.format(f"CAST(o_orderkey AS VARCHAR) || '|{SEED}|cut'")}, CAST(o_orderkey AS VARCHAR)) AS rk,
    count(*) OVER () AS total FROM orders)
SELECT o_orderkey, rk <= floor(total * 0.8) AS is_train FROM h""")
def split_exact(spark, sf):
    out = sampling.split_exact(w.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.8, SEED, portable=True)
    return out


@query("keyed_partitions", "SELECT count(*) AS n, count(DISTINCT (o_orderkey)) AS keys, true AS one_id_per_row FROM orders")
def keyed_partitions(spark, sf):
    """A table of partition folders, whose files have the same names, read with a row id."""
    path = os.path.join(shared_dir(spark), f"keyed-{uuid.uuid4().hex}")
    orders = w.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    states = [r[0] for r in orders.select("o_orderstatus").distinct().collect()]
    for state in states:  # one writer per folder gives every folder a file of the same index
        orders.where(F.col("o_orderstatus") == state).select("o_orderkey").write.parquet(f"{path}/state={state}")
    keyed = tables.read_keyed(spark, path)
    return keyed.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"),
                     (F.count_distinct("row_id") == F.count("*")).alias("one_id_per_row"))


@query("distinct_states", f"""{STAR}, long AS ({UNPIVOT.format(ALL)}) SELECT DISTINCT var, state FROM long""")
def distinct_states(spark, sf):
    return encode.state_counts(w.star(spark, sf), w.STAR_COLUMNS).select("var", "state").distinct()
