"""Queries on edge votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.mathx import bernoulli_entropy
from causeway.operators import counts, sampling, votes
from causeway.plans import trade
from causeway.plans import workloads as w
from causeway.plans.registry import query
from causeway.session import durable

BASE = f"WITH {trade.LINES_SQL}, {trade.votes_sql()}, {trade.COOC_SQL}"
RATE = """rated AS (SELECT v.*, coalesce(c.n, 0) AS cooc, v.n / c.n AS freq FROM voted v
  LEFT JOIN cooc c ON c.a = v.child AND c.b = v.parent)"""
CUT = f"""kept AS (SELECT child, parent, n, fc FROM rated WHERE freq >= {trade.CUTOFF}),
final AS (SELECT a.* FROM kept a LEFT JOIN kept b ON a.parent = b.child AND a.child = b.parent
  WHERE a.n > coalesce(b.n, 0) OR (a.n = b.n AND a.fc > b.fc))"""
H = "CASE WHEN freq > 0 AND freq < 1 THEN -freq * log2(freq) - (1 - freq) * log2(1 - freq) ELSE 0 END"
TAU, MIN_COOC = 0.2, 5
UNSURE = f"""h AS (SELECT child, parent, n, cooc, freq, {H} AS entropy FROM rated WHERE cooc >= {MIN_COOC}),
hot AS (SELECT *, max(entropy) OVER (PARTITION BY child) AS top FROM h WHERE entropy > {TAU})"""


def _inputs(spark, sf):
    lines = durable(trade.daily_lines(spark, sf))
    voted = votes.vote_counts(trade.vote_log(lines))
    cooc = votes.cooccurrence(trade.day_plan(lines), trade.nations(spark, sf))
    return lines, voted, cooc


@query("edge_votes", f"{BASE} SELECT child, parent, n FROM voted")
def edge_votes(spark, sf):
    _, voted, _ = _inputs(spark, sf)
    return voted.select("child", "parent", "n")


@query("cooccurrence", f"{BASE} SELECT a, b, n FROM cooc")
def cooccurrence(spark, sf):
    return _inputs(spark, sf)[2]


@query("accumulated_votes", f"""{BASE} SELECT 'votes' AS kind, child AS x, parent AS y, n FROM voted
UNION ALL SELECT 'cooc', a, b, n FROM cooc""")
def accumulated_votes(spark, sf):
    """Counts of the early and the late days, added up."""
    lines = durable(trade.daily_lines(spark, sf))
    parts = [lines.where(F.col("sample_id") < trade.SPLIT), lines.where(F.col("sample_id") >= trade.SPLIT)]
    names = trade.nations(spark, sf)
    voted = votes.accumulate(
        [votes.vote_counts(trade.vote_log(p)).drop("first_child") for p in parts], ["child", "parent"]
    )
    cooc = votes.accumulate([votes.cooccurrence(trade.day_plan(p), names) for p in parts], ["a", "b"])
    return voted.select(F.lit("votes").alias("kind"), F.col("child").alias("x"), F.col("parent").alias("y"), "n").union(
        cooc.select(F.lit("cooc"), "a", "b", "n")
    )


@query("edge_frequency", f"""{BASE}, {RATE} SELECT child, parent, n, cooc, round(freq, 9) AS freq,
  CASE WHEN cooc > 0 THEN format('{{:.2f}} ({{}}/{{}} co-sampled searches)', round(n / cooc, 2), n, cooc)
       ELSE 'never co-sampled' END AS support FROM rated""")
def edge_frequency(spark, sf):
    _, voted, cooc = _inputs(spark, sf)
    rated = votes.with_support(voted, cooc)
    return rated.select("child", "parent", "n", "cooc", F.round("freq", 9).alias("freq"),
                        votes.support_text(F.col("n"), F.col("cooc")).alias("support"))


@query("direction_resolution", f"{BASE} SELECT child, parent, n FROM resolved")
def direction_resolution(spark, sf):
    return votes.resolve_direction(_inputs(spark, sf)[1]).select("child", "parent", "n")


@query("frequency_cutoff", f"{BASE}, {RATE}, {CUT} SELECT child, parent, n FROM kept")
def frequency_cutoff(spark, sf):
    _, voted, cooc = _inputs(spark, sf)
    return votes.frequency_cutoff(voted, cooc, trade.CUTOFF).select("child", "parent", "n")


RANKED = "ranked AS (SELECT child, parent, n, CAST(row_number() OVER (PARTITION BY child ORDER BY n DESC, parent) AS INTEGER) AS rank FROM final)"


@query("parent_ranking", f"{BASE}, {RATE}, {CUT}, {RANKED} SELECT * FROM ranked")
def parent_ranking(spark, sf):
    """Cutoff, then direction, then rank by votes."""
    _, voted, cooc = _inputs(spark, sf)
    kept = votes.resolve_direction(votes.frequency_cutoff(voted, cooc, trade.CUTOFF))
    return votes.rank_parents(kept).select("child", "parent", "n", "rank")


@query("correlation_ranking", f"""WITH num AS ({w.NUMERIC_SQL}),
corr AS ({' UNION ALL '.join(f"SELECT '{a}' AS child, '{b}' AS parent, corr({a}, {b}) AS corr FROM num" for a in w.NUMERIC_COLUMNS for b in w.NUMERIC_COLUMNS if a != b)})
SELECT child, parent, CAST(row_number() OVER (PARTITION BY child ORDER BY corr DESC, parent) AS INTEGER) AS rank FROM corr""")
def correlation_ranking(spark, sf):
    """Parents by signed correlation, strongest positive first."""
    corr = durable(counts.correlation(w.star_numeric(spark, sf), w.NUMERIC_COLUMNS))
    pairs = corr.where(F.col("a") != F.col("b")).select(
        F.col("a").alias("child"), F.col("b").alias("parent"), F.lit(1).cast("bigint").alias("n")
    )
    return votes.rank_parents(pairs, corr).select("child", "parent", "rank")


@query("node_order", f"""{BASE}, {RATE}, {CUT}, t AS (SELECT n_name AS node, coalesce(sum(n), 0) AS total
  FROM nation LEFT JOIN final ON parent = n_name GROUP BY n_name)
SELECT node, CAST(total AS BIGINT) AS total, CAST(row_number() OVER (ORDER BY total DESC, node) AS INTEGER) AS position FROM t""")
def node_order(spark, sf):
    _, voted, cooc = _inputs(spark, sf)
    kept = votes.resolve_direction(votes.frequency_cutoff(voted, cooc, trade.CUTOFF))
    return votes.node_order(votes.parent_appearance(kept, trade.node_frame(spark, sf)))


@query("uncertain_edges", f"""{BASE}, {RATE}, {UNSURE}
SELECT child, parent, n, cooc, round(freq, 9) AS freq, round(entropy, 9) AS entropy,
  CAST(row_number() OVER (PARTITION BY child ORDER BY entropy DESC, parent) AS INTEGER) AS edge_rank,
  CAST(dense_rank() OVER (ORDER BY top DESC, child) AS INTEGER) AS node_rank FROM hot""")
def uncertain_edges(spark, sf):
    _, voted, cooc = _inputs(spark, sf)
    hot = votes.uncertain_edges(voted, cooc, TAU, MIN_COOC)
    return hot.select("child", "parent", "n", "cooc", F.round("freq", 9).alias("freq"),
                      F.round("entropy", 9).alias("entropy"), "edge_rank", "node_rank")


@query("uncertain_top", f"""{BASE}, {RATE}, {UNSURE}, r AS (SELECT child, parent,
  row_number() OVER (PARTITION BY child ORDER BY entropy DESC, parent) AS edge_rank,
  dense_rank() OVER (ORDER BY top DESC, child) AS node_rank FROM hot)
SELECT child, parent FROM r WHERE edge_rank <= 20 AND node_rank <= 10""")
def uncertain_top(spark, sf):
    """What is shown: 20 edges each of the 10 least certain nodes."""
    _, voted, cooc = _inputs(spark, sf)
    hot = votes.uncertain_edges(voted, cooc, TAU, MIN_COOC)
    return hot.where((F.col("edge_rank") <= 20) & (F.col("node_rank") <= 10)).select("child", "parent")


@query("trigger_entropy", f"""{BASE}, {RATE}, {UNSURE} SELECT least(parent, child) AS a,
  greatest(parent, child) AS b, round(max(entropy), 9) AS entropy FROM hot GROUP BY ALL""")
def trigger_entropy(spark, sf):
    _, voted, cooc = _inputs(spark, sf)
    out = votes.trigger_entropy(votes.uncertain_edges(voted, cooc, TAU, MIN_COOC))
    return out.withColumn("entropy", F.round("entropy", 9))


@query("targeted_plan", f"""{BASE}, {RATE}, {UNSURE}, u AS (SELECT child AS node,
  list(parent ORDER BY entropy DESC, parent) AS cand FROM hot GROUP BY child),
g AS (SELECT n_name AS node, (SELECT list(m.n_name ORDER BY m.n_name) FROM nation m
   WHERE m.n_regionkey = o.n_regionkey AND m.n_name <> o.n_name) AS cols FROM nation o),
wanted AS (SELECT u.node, list_concat([u.node], cand, list_filter(cols, lambda x: x <> u.node AND NOT list_contains(cand, x))) AS f
  FROM u JOIN g USING (node))
SELECT node, array_to_string(f[1:9], ',') AS forced, CAST(r AS INTEGER) AS repeat FROM wanted, range(3) t(r)""")
def targeted_plan(spark, sf):
    """Uncertain nodes with their candidates, topped up with nations of their region."""
    _, voted, cooc = _inputs(spark, sf)
    hot = votes.uncertain_edges(voted, cooc, TAU, MIN_COOC)
    uncertain = hot.groupBy(F.col("child").alias("node")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("edge_rank", "parent"))), lambda s: s["parent"]).alias("candidates")
    )
    nation = w.table(spark, sf, "nation")
    same = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("peers"))
    tips = nation.join(same, "n_regionkey").select(
        F.col("n_name").alias("node"), F.array_remove("peers", F.col("n_name")).alias("cols")
    )
    out = sampling.targeted_plan(uncertain, tips, 10, 3)
    return out.select("node", F.array_join("forced", ",").alias("forced"), "repeat")


EARLY = trade.votes_sql("_pre", f"sample_id < {trade.SPLIT}")
PRE_COOC = f"""seen_pre AS (SELECT * FROM seen WHERE sample_id < {trade.SPLIT}),
cooc_pre AS (SELECT p.x AS a, q.x AS b, count(*) AS n FROM seen_pre p JOIN seen_pre q
  ON p.sample_id = q.sample_id AND p.x <> q.x GROUP BY ALL)"""


@query("trajectory", f"""{BASE}, {RATE}, {UNSURE}, {EARLY}, {PRE_COOC},
tr AS (SELECT least(parent, child) AS a, greatest(parent, child) AS b, max(entropy) AS entropy FROM hot GROUP BY ALL)
SELECT r.child, r.parent, r.n, r.cooc, round(r.freq, 9) AS freq, round(tr.entropy, 9) AS entropy,
  coalesce(p.n, 0) AS pre_n, coalesce(q.n, 0) AS pre_cooc,
  greatest(0, r.n - coalesce(p.n, 0)) AS post_n, greatest(0, r.cooc - coalesce(q.n, 0)) AS post_cooc
FROM rated r LEFT JOIN voted_pre p USING (child, parent)
LEFT JOIN cooc_pre q ON q.a = r.child AND q.b = r.parent
LEFT JOIN tr ON tr.a = least(r.parent, r.child) AND tr.b = greatest(r.parent, r.child)""")
def trajectory(spark, sf):
    """Evidence before and after the split day, with the entropy that flagged the pair."""
    lines, voted, cooc = _inputs(spark, sf)
    early = lines.where(F.col("sample_id") < trade.SPLIT)
    pre = votes.vote_counts(trade.vote_log(early))
    pre_cooc = votes.cooccurrence(trade.day_plan(early), trade.nations(spark, sf))
    trigger = votes.trigger_entropy(votes.uncertain_edges(voted, cooc, TAU, MIN_COOC))
    out = votes.trajectory(voted, cooc, pre, pre_cooc, trigger)
    return out.withColumn("freq", F.round("freq", 9)).withColumn("entropy", F.round("entropy", 9))


@query("bernoulli_entropy", f"""{BASE}, {RATE} SELECT child, parent, round({H}, 9) AS entropy,
  format('{{:.1f}}%', n * 100.0 / cooc) AS pct FROM rated WHERE cooc > 0""")
def entropy_values(spark, sf):
    _, voted, cooc = _inputs(spark, sf)
    rated = votes.with_support(voted, cooc).where(F.col("cooc") > 0)
    return rated.select("child", "parent", F.round(bernoulli_entropy(F.col("freq")), 9).alias("entropy"),
                        votes.percent_text(F.col("n"), F.col("cooc")).alias("pct"))


@query("near_miss", f"""{BASE}, {RATE}, {CUT}, {RANKED}, {trade.graph_sql('dag')},
miss AS (SELECT r.child, r.parent, r.n, coalesce(c.n, 0) AS cooc, coalesce(r.n / c.n, 0) AS support
  FROM ranked r LEFT JOIN cooc c ON c.a = r.child AND c.b = r.parent
  WHERE NOT EXISTS (SELECT 1 FROM dag d WHERE d.parent = r.parent AND d.child = r.child))
SELECT child, parent, n, cooc, round(support, 9) AS support,
  CAST(row_number() OVER (ORDER BY support DESC, parent, child) AS INTEGER) AS position FROM miss""")
def near_miss(spark, sf):
    """Ranked edges that the two-parent graph left out."""
    _, voted, cooc = _inputs(spark, sf)
    kept = votes.resolve_direction(votes.frequency_cutoff(voted, cooc, trade.CUTOFF))
    dag = trade.best_parents(votes.resolve_direction(voted), 2, True)
    out = votes.near_miss(votes.rank_parents(kept), dag, cooc)
    return out.select("child", "parent", "n", "cooc", F.round("support", 9).alias("support"), "position")


ADVICE = """tips AS (SELECT n_name AS child, (SELECT list(m.n_name ORDER BY m.n_name DESC) FROM nation m
  WHERE m.n_regionkey = o.n_regionkey AND m.n_name <> o.n_name) AS names FROM nation o WHERE n_regionkey <> 0),
named AS (SELECT child, parent, min(pos) AS advised FROM (SELECT child, unnest(names) AS parent,
  generate_subscripts(names, 1) AS pos FROM tips) GROUP BY ALL)"""


def _tips(spark, sf):
    """Advice: the other nations of the region, in descending name order; none for region 0."""
    nation = w.table(spark, sf, "nation")
    same = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name"), asc=False).alias("peers"))
    return nation.where(F.col("n_regionkey") != 0).join(same, "n_regionkey").select(
        F.col("n_name").alias("child"), F.array_remove("peers", F.col("n_name")).alias("names")
    )


@query("advice_order", f"""{BASE}, {ADVICE}, {RATE}, {CUT}, {RANKED},
pool AS (SELECT r.child, r.parent, r.n, c.n AS cooc FROM resolved r LEFT JOIN cooc c ON c.a = r.child AND c.b = r.parent),
adv AS (SELECT p.child, p.parent, p.n, advised FROM pool p LEFT JOIN named USING (child, parent)
  WHERE p.child IN (SELECT child FROM tips) AND (advised IS NOT NULL OR p.n / p.cooc >= {trade.CUTOFF}))
SELECT child, parent, n, advised IS NOT NULL AS endorsed, CAST(row_number() OVER (PARTITION BY child
  ORDER BY advised NULLS LAST, n DESC, parent) AS INTEGER) AS rank FROM adv
UNION ALL SELECT child, parent, n, TRUE, rank FROM ranked WHERE child NOT IN (SELECT child FROM tips)""")
def advice_order(spark, sf):
    """Advised parents first, past the cutoff; children without advice fall back."""
    _, voted, cooc = _inputs(spark, sf)
    cooc = durable(cooc)
    resolved = votes.resolve_direction(voted)
    fallback = votes.rank_parents(votes.resolve_direction(votes.frequency_cutoff(voted, cooc, trade.CUTOFF)))
    return votes.advice_order(resolved, _tips(spark, sf), cooc, trade.CUTOFF, fallback)


@query("ordering_summary", f"""{BASE}, {ADVICE},
pool AS (SELECT r.child, r.parent, r.n, c.n AS cooc FROM resolved r LEFT JOIN cooc c ON c.a = r.child AND c.b = r.parent),
adv AS (SELECT p.child, advised FROM pool p LEFT JOIN named USING (child, parent)
  WHERE p.child IN (SELECT child FROM tips) AND (advised IS NOT NULL OR p.n / p.cooc >= {trade.CUTOFF})),
pc AS (SELECT child, count(*) FILTER (advised IS NULL) AS tail FROM adv GROUP BY child)
SELECT count(*) AS children, count(*) FILTER (tail > 0) AS children_with_tail,
  CAST(sum(tail) AS BIGINT) AS tail_total, round(sum(tail) / count(*), 9) AS tail_per_child FROM pc""")
def ordering_summary(spark, sf):
    _, voted, cooc = _inputs(spark, sf)
    cooc = durable(cooc)
    resolved = votes.resolve_direction(voted)
    none = votes.rank_parents(resolved).limit(0)
    ranked = votes.advice_order(resolved, _tips(spark, sf), cooc, trade.CUTOFF, none)
    return votes.ordering_summary(ranked).withColumn("tail_per_child", F.round("tail_per_child", 9))


@query("edge_digest", f"""{BASE}, {RATE}, {CUT}, stages AS (
  SELECT 'votes' AS stage, parent, child FROM voted UNION SELECT 'cutoff', parent, child FROM kept
  UNION SELECT 'direction', parent, child FROM final)
SELECT stage, count(*) AS edges, substr(sha256('[' || string_agg('["' || parent || '","' || child || '"]', ','
  ORDER BY parent, child) || ']'), 1, 10) AS digest FROM stages GROUP BY stage""")
def edge_digest(spark, sf):
    """Fingerprints of the edge sets after each stage."""
    _, voted, cooc = _inputs(spark, sf)
    kept = votes.frequency_cutoff(voted, cooc, trade.CUTOFF)
    stages = [("votes", voted), ("cutoff", kept), ("direction", votes.resolve_direction(kept))]
    parts = [df.select(F.lit(name).alias("stage"), "parent", "child") for name, df in stages]
    return votes.edge_digest(parts[0].union(parts[1]).union(parts[2]), "stage")


@query("symmetric_pairs", f"""{trade.DAG_SQL.replace('RECURSIVE ', '')}
SELECT parent AS a, child AS b FROM dag UNION SELECT child, parent FROM dag""")
def symmetric_pairs(spark, sf):
    dag = trade.graph(spark, sf)
    return votes.symmetric_pairs(dag.select(F.col("parent").alias("a"), F.col("child").alias("b")))
