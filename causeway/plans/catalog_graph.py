"""Queries on graphs over nations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from causeway.functions.mathx import chi2_tail
from causeway.operators import assemble, citest, cube, encode, graph, votes
from causeway.operators.encode import adjacency as adjacency_of
from causeway.plans import trade
from causeway.plans import workloads as w
from causeway.plans.registry import query
from causeway.session import broadcast_if_small, durable, local_frame

DAG, CYCLIC = trade.DAG_SQL, trade.CYCLIC_SQL
CLOSURE = """reach AS (SELECT parent AS node, child AS descendant FROM dag
  UNION SELECT r.node, d.child FROM reach r JOIN dag d ON r.descendant = d.parent)"""


@query("adjacency", f"{DAG} SELECT p.n_name AS parent, " + ", ".join(
    f"coalesce(max(CASE WHEN d.child = 'NATION_{i}' THEN 1 END), 0) AS \"NATION_{i}\"" for i in range(25)
) + " FROM nation p LEFT JOIN dag d ON d.parent = p.n_name GROUP BY p.n_name")
def adjacency(spark, sf):
    return adjacency_of(trade.graph(spark, sf), trade.nations(spark, sf))


@query("descendants", f"{DAG}, {CLOSURE} SELECT node, descendant FROM reach")
def descendants(spark, sf):
    return graph.descendants(trade.graph(spark, sf))


@query("reachability", f"""{DAG}, {CLOSURE}, pairs AS (SELECT a.n_name AS "start", b.n_name AS "end"
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)
SELECT "start", "end", "start" = "end" OR EXISTS (SELECT 1 FROM reach WHERE node = "start" AND descendant = "end") AS reaches FROM pairs""")
def reachability(spark, sf):
    """Within each region: who reaches whom."""
    nation = w.table(spark, sf, "nation")
    pairs = nation.select("n_regionkey", F.col("n_name").alias("start")).join(
        nation.select("n_regionkey", F.col("n_name").alias("end")), "n_regionkey"
    ).drop("n_regionkey")
    return graph.reachable(pairs, trade.graph(spark, sf))


PATHS = """walk AS (SELECT n_name AS s, [n_name] AS path, n_regionkey AS r FROM nation
  UNION ALL SELECT s, list_append(path, d.child), r FROM walk JOIN dag d ON path[-1] = d.parent
  WHERE NOT list_contains(path, d.child))"""


@query("simple_paths", f"""{DAG}, {PATHS}, hits AS (SELECT s AS "start", path[-1] AS "end",
  array_to_string(path, '>') AS path, row_number() OVER (PARTITION BY s, path[-1]
  ORDER BY len(path), array_to_string(path, chr(1))) AS path_ord
  FROM walk JOIN nation n ON n.n_name = path[-1] WHERE s <> path[-1])
SELECT "start", "end", path, CAST(path_ord AS INTEGER) AS path_ord FROM hits""")
def simple_paths(spark, sf):
    """All paths between all nations, along the two most voted edges into each."""
    nation = w.table(spark, sf, "nation")
    names = nation.agg(F.collect_set("n_name").alias("names"))
    pairs = nation.select(F.col("n_name").alias("start")).join(names).select("start", F.explode("names").alias("end"))
    pairs = pairs.where(F.col("start") != F.col("end"))
    out = graph.simple_paths(pairs, trade.graph(spark, sf))
    return out.select("start", "end", F.array_join("path", ">").alias("path"), "path_ord")


QUARTER = 91  # days


@query("strong_components", f"""WITH RECURSIVE {trade.LINES_SQL},
q AS (SELECT sample_id // {QUARTER} AS run, s, c, sum(n) AS n FROM lines GROUP BY ALL),
e AS (SELECT a.run, a.run || '/' || a.s AS parent, a.run || '/' || a.c AS child FROM q a
  LEFT JOIN q b ON a.run = b.run AND a.s = b.c AND a.c = b.s WHERE a.s <> a.c AND a.n > coalesce(b.n, 0)),
nodes AS (SELECT parent AS node FROM e UNION SELECT child FROM e),
reach AS (SELECT parent AS node, child AS far FROM e UNION SELECT r.node, e.child FROM reach r JOIN e ON r.far = e.parent)
SELECT node, least(node, coalesce((SELECT min(a.far) FROM reach a JOIN reach b ON a.far = b.node AND b.far = a.node
  WHERE a.node = nodes.node), node)) AS component FROM nodes""")
def strong_components(spark, sf):
    """Components of the net flows between nations in every quarter; each quarter is a graph of its own."""
    lines = trade.daily_lines(spark, sf).withColumn("sample_id", F.floor(F.col("sample_id") / QUARTER).cast("string"))
    quarters = durable(lines.groupBy("sample_id", "s", "c").agg(F.sum("n").alias("n")))
    named = trade.vote_log(quarters).select(*[F.concat_ws("/", "sample_id", c).alias(c) for c in ("parent", "child")])
    return graph.strong_components(named)


@query("simple_cycles", f"""{CYCLIC}, walk AS (SELECT [parent, child] AS path FROM dag WHERE parent < child
  UNION ALL SELECT list_append(path, d.child) FROM walk JOIN dag d ON path[-1] = d.parent
  WHERE d.child > path[1] AND NOT list_contains(path, d.child)),
closed AS (SELECT path FROM walk JOIN dag d ON path[-1] = d.parent AND d.child = path[1])
SELECT array_to_string(path, '>') AS cycle FROM closed""")
def simple_cycles(spark, sf):
    """All directed cycles."""
    out = graph.simple_cycles(trade.graph(spark, sf, acyclic=False))
    return out.select(F.array_join("cycle", ">").alias("cycle"))


@query("markov_blankets", f"""{DAG} SELECT n_name AS center, n_name AS node FROM nation
UNION SELECT child, parent FROM dag UNION SELECT parent, child FROM dag
UNION SELECT a.parent, b.parent FROM dag a JOIN dag b ON a.child = b.child AND a.parent <> b.parent""")
def markov_blankets(spark, sf):
    return graph.markov_blankets(trade.graph(spark, sf), trade.node_frame(spark, sf))


@query("blanket_edges", f"""{DAG}, mb AS (SELECT n_name AS center, n_name AS node FROM nation
UNION SELECT child, parent FROM dag UNION SELECT parent, child FROM dag
UNION SELECT a.parent, b.parent FROM dag a JOIN dag b ON a.child = b.child AND a.parent <> b.parent)
SELECT p.center, d.parent, d.child FROM dag d JOIN mb p ON p.node = d.parent JOIN mb c ON c.node = d.child AND c.center = p.center""")
def blanket_edges(spark, sf):
    dag = durable(trade.graph(spark, sf))
    return graph.induced_edges(graph.markov_blankets(dag, trade.node_frame(spark, sf)), dag)


@query("isolated_and_orphans", f"""{DAG} SELECT 'isolated' AS kind, n_name AS node FROM nation
  WHERE n_name NOT IN (SELECT parent FROM dag UNION SELECT child FROM dag)
UNION ALL SELECT 'orphan', n_name FROM nation WHERE n_name NOT IN (SELECT child FROM dag)""")
def isolated_and_orphans(spark, sf):
    dag, nodes = durable(trade.graph(spark, sf)), trade.node_frame(spark, sf)
    return graph.isolated(nodes, dag).select(F.lit("isolated").alias("kind"), "node").union(
        graph.orphans(nodes, dag).select(F.lit("orphan"), "node")
    )


@query("v_structures", f"""{DAG} SELECT a.parent AS a, a.child AS mid, b.parent AS b FROM dag a
JOIN dag b ON a.child = b.child AND a.parent < b.parent
WHERE NOT EXISTS (SELECT 1 FROM dag d WHERE (d.parent = a.parent AND d.child = b.parent)
  OR (d.parent = b.parent AND d.child = a.parent))""")
def v_structures(spark, sf):
    return graph.v_structures(durable(trade.graph(spark, sf)))


SEPARATED = """pairs AS (SELECT least(parent, child) AS a, greatest(parent, child) AS b FROM dag),
sep AS (SELECT x.n_name AS a, y.n_name AS b, (SELECT list(z.n_name) FROM nation z
  WHERE z.n_regionkey = x.n_regionkey) AS s FROM nation x JOIN nation y ON x.n_name < y.n_name
  WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.a = x.n_name AND p.b = y.n_name))"""


@query("sepset_colliders", f"""{DAG}, {SEPARATED}, ends AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs)
SELECT l.a, l.b AS mid, r.a AS b FROM ends l JOIN ends r ON l.b = r.b AND l.a < r.a
JOIN sep ON sep.a = l.a AND sep.b = r.a WHERE NOT list_contains(s, l.b)""")
def sepset_colliders(spark, sf):
    """Colliders when pairs are separated by the first nation's region."""
    dag, nation = trade.graph(spark, sf), w.table(spark, sf, "nation")
    skeleton = durable(dag.select(F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b")).distinct())
    region = nation.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("s"))
    sets = nation.join(region, "n_regionkey").select(F.col("n_name").alias("a"), "s")
    ends = skeleton.select("a", "b").union(skeleton.select("b", "a")).toDF("a", "mid")
    apart = ends.join(ends.toDF("b", "mid"), "mid").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    sep = apart.join(skeleton, ["a", "b"], "left_anti").join(sets, "a")
    return graph.sepset_colliders(skeleton, sep)


TRIPLES = """hop AS (SELECT parent AS x, child AS y FROM dag UNION SELECT child, parent FROM dag),
tri AS (SELECT r_name AS query_id, p.x AS prev, p.y AS mid, q.y AS next FROM region CROSS JOIN hop p
  JOIN hop q ON p.y = q.x AND p.x <> q.y),
obs AS (SELECT r_name AS query_id, n_name AS node FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query("d_connected", f"""{DAG}, {CLOSURE}, {TRIPLES}
SELECT query_id, prev, mid, next,
  CASE WHEN EXISTS (SELECT 1 FROM dag WHERE parent = prev AND child = mid)
        AND EXISTS (SELECT 1 FROM dag WHERE parent = next AND child = mid)
  THEN EXISTS (SELECT 1 FROM obs o WHERE o.query_id = tri.query_id AND (o.node = mid OR EXISTS (
    SELECT 1 FROM reach WHERE reach.node = mid AND descendant = o.node)))
  ELSE NOT EXISTS (SELECT 1 FROM obs o WHERE o.query_id = tri.query_id AND o.node = mid) END AS connected FROM tri""")
def d_connected(spark, sf):
    """Per region, with its nations observed: which triples let information pass."""
    dag = durable(trade.graph(spark, sf))
    hops = dag.select(F.col("parent").alias("x"), F.col("child").alias("y"))
    hops = durable(hops.union(hops.select("y", "x")).distinct())
    tri = hops.select(F.col("x").alias("prev"), F.col("y").alias("mid")).join(
        hops.select(F.col("x").alias("mid"), F.col("y").alias("next")), "mid"
    ).where(F.col("prev") != F.col("next"))
    region = w.table(spark, sf, "region")
    named = F.array(*[F.lit(r["r_name"]) for r in region.select("r_name").collect()])
    tri = tri.select(F.explode(named).alias("query_id"), "prev", "mid", "next")
    observed = w.table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("query_id"), F.col("n_name").alias("node")
    )
    return graph.d_connected(tri, dag, observed)


@query("separation_aware_paths")
def separation_aware_paths(spark, sf):
    """From each observed nation the shortest open path into the blanket of another region's first nation."""
    dag = durable(trade.graph(spark, sf))
    nation = w.table(spark, sf, "nation")
    target = nation.groupBy("n_regionkey").agg(F.min("n_name").alias("target"))
    mb = graph.markov_blankets(dag, trade.node_frame(spark, sf))
    goal = target.join(mb, F.col("target") == F.col("center")).where(F.col("node") != F.col("target")).select(
        F.col("n_regionkey").alias("query_id"), "node"
    )
    seen = nation.where(F.col("n_nationkey") % 2 == 0).select(F.col("n_name").alias("node"))
    regions = sorted(r["r_regionkey"] for r in w.table(spark, sf, "region").collect())
    observed = seen.select(F.explode(F.array(*[F.lit(r) for r in regions])).alias("query_id"), "node")
    sources = observed.withColumnRenamed("node", "source").join(
        goal.withColumnRenamed("node", "source"), ["query_id", "source"], "left_anti"
    )
    out = graph.separation_aware_paths(sources, goal, observed, dag, 3)
    return out.select("query_id", "source", F.array_join("path", ">").alias("path"))


@query("greedy_assembly")
def greedy_assembly(spark, sf):
    """Three graphs at once, from early, late and all days, at most three parents each."""
    return assemble.assemble(_ranked_runs(spark, sf), 3)


def _ranked_runs(spark, sf):
    lines = durable(trade.daily_lines(spark, sf))
    nodes = trade.node_frame(spark, sf)
    early = F.col("sample_id") < trade.SPLIT
    runs = []
    for run, part in enumerate((lines, lines.where(early), lines.where(~early))):
        kept = durable(votes.resolve_direction(votes.vote_counts(trade.vote_log(part))))
        order = votes.node_order(votes.parent_appearance(kept, nodes)).select(F.col("node").alias("child"), "position")
        runs.append(votes.rank_parents(kept).join(order, "child").select(
            F.lit(run).alias("run_id"), "position", "child", "rank", "parent"))
    return durable(runs[0].unionByName(runs[1]).unionByName(runs[2]))


@query("arbitrated_assembly")
def arbitrated_assembly(spark, sf):
    """As above, but conflicts give up the first edge of every blocking path."""
    ranked = _ranked_runs(spark, sf)
    advice = spark.createDataFrame(
        [], "run_id int, new_parent string, new_child string, drops array<struct<parent: string, child: string>>"
    )

    def first_edge(parent, child, blocking):
        return [e for e in blocking if e[0] == child]

    return assemble.assemble_advised(ranked, advice, 3, responder=first_edge)


@query("assembly_conflicts")
def assembly_conflicts(spark, sf):
    """Edges that would close a cycle, with the number of edges that block them."""
    advice = spark.createDataFrame(
        [], "run_id int, new_parent string, new_child string, drops array<struct<parent: string, child: string>>"
    )
    out = assemble.assemble_advised(_ranked_runs(spark, sf), advice, 3, conflicts=True)
    return out.select("run_id", "conflict_ord", "parent", "child", F.size("edges").alias("edges"))


@query("acyclic_filter")
def acyclic_filter(spark, sf):
    """All voted nation edges in vote order, without those that close a cycle."""
    voted = votes.vote_counts(trade.vote_log(trade.daily_lines(spark, sf)))
    edges = voted.select(F.lit(0).alias("run_id"), (-F.col("n")).alias("edge_ord"), "parent", "child")
    return assemble.acyclic_filter(edges)


CI = ["returnflag", "linestatus", "late", "orderyear"]
CI_TESTS = [citest.Test("late", "orderyear", ()), citest.Test("linestatus", "returnflag", ()),
            citest.Test("late", "orderyear", ("linestatus",)),
            citest.Test("linestatus", "returnflag", ("late", "orderyear"))]


def _ci_sql(i: int, t: citest.Test) -> str:
    s = " || '|' || ".join(t.s) if t.s else "''"
    return f"""SELECT {i} AS test_id, round(sum(part), 5) AS stat, CAST(sum(dof) AS BIGINT) AS dof FROM (
  SELECT s, sum((coalesce(o.n, 0) - e) * (coalesce(o.n, 0) - e) / e) AS part, min((rx - 1) * (ry - 1)) AS dof FROM (
    SELECT r.s, r.x, c.y, r.n * c.n / t.n AS e, rx, ry FROM
      (SELECT {s} AS s, {t.x} AS x, count(*) AS n FROM star GROUP BY ALL) r
      JOIN (SELECT {s} AS s, {t.y} AS y, count(*) AS n FROM star GROUP BY ALL) c USING (s)
      JOIN (SELECT {s} AS s, count(*) AS n, count(DISTINCT {t.x}) AS rx, count(DISTINCT {t.y}) AS ry FROM star GROUP BY ALL) t USING (s)) g
  LEFT JOIN (SELECT {s} AS s, {t.x} AS x, {t.y} AS y, count(*) AS n FROM star GROUP BY ALL) o USING (s, x, y)
  GROUP BY s)"""


@query("chi2_tests", f"WITH star AS ({w.STAR_SQL}) " + " UNION ALL ".join(_ci_sql(i, t) for i, t in enumerate(CI_TESTS)))
def chi2_tests(spark, sf):
    coded = encode.encode_table(w.star(spark, sf), CI)
    return citest.ci_tests(coded, CI_TESTS).select("test_id", F.round("stat", 5).alias("stat"), "dof")


def _cube_sql() -> str:
    """All tests given up to two of the other columns, from counts of one to four columns."""
    k = len(w.STAR_COLUMNS)
    codes = ", ".join(f"dense_rank() OVER (ORDER BY {c})" for c in sorted(w.STAR_COLUMNS))
    name = "[" + ", ".join(f"'{c}'" for c in sorted(w.STAR_COLUMNS)) + "]"
    used = "abcd"

    def counted(n: int) -> str:
        v = used[:n]
        sets = ", ".join(f"unnest(range(1, {k + 1})) AS t{c}({c})" for c in v)
        order = " AND ".join(f"{p} < {q}" for p, q in zip(v, v[1:])) or "TRUE"
        keys = ", ".join(f"{c}, v[{c}] AS c{c}" for c in v)
        return f"n{n} AS (SELECT {keys}, count(*) AS n FROM coded, (SELECT * FROM {sets} WHERE {order}) q GROUP BY ALL)"

    def part(x: str, y: str, s: str) -> str:
        given = "".join(f", {v} AS {t}, c{v} AS c{t}" for v, t in zip(s, "st"))
        return f"SELECT {x} AS x, {y} AS y, c{x} AS cx, c{y} AS cy{given}, n FROM n{2 + len(s)}"

    def margin(x: str, s: str) -> str:
        given = "".join(f", {v} AS {t}, c{v} AS c{t}" for v, t in zip(s, "st"))
        return f"SELECT {x} AS x, c{x} AS cx{given}, n FROM n{1 + len(s)}"

    out = [counted(n) for n in (1, 2, 3, 4)]
    for d in (0, 1, 2):
        size, given = d + 2, "st"[:d]
        pairs = [(x, y) for i, x in enumerate(used[:size]) for y in used[i + 1:size]]
        out.append(f"x{d} AS (" + " UNION ALL ".join(
            part(x, y, "".join(v for v in used[:size] if v not in (x, y))) for x, y in pairs) + ")")
        out.append(f"m{d} AS (" + " UNION ALL ".join(
            margin(x, "".join(v for v in used[:size - 1] if v != x)) for x in used[:size - 1]) + ")")
        keys = [v for t in given for v in (t, f"c{t}")]
        group = ", ".join(["x", *keys])
        out.append(f"r{d} AS (SELECT {group}, count(*) AS r, sum(n) AS nt FROM m{d} GROUP BY {group})")
        same = lambda a, b: "".join(f" AND {a}.{v} = {b}.{v}" for v in keys)
        names = "".join(f", {t}" for t in given)
        out.append(f"""s{d} AS (SELECT e.x, e.y{''.join(f", e.{t}" for t in given)}, sum(e.n * e.n / (p.n * q.n / rx.nt)) AS ratio FROM x{d} e
  JOIN m{d} p ON p.x = e.x AND p.cx = e.cx{same('p', 'e')} JOIN m{d} q ON q.x = e.y AND q.cx = e.cy{same('q', 'e')}
  JOIN r{d} rx ON rx.x = e.x{same('rx', 'e')} GROUP BY ALL)""")
        out.append(f"""f{d} AS (SELECT a.x, b.x AS y{''.join(f", a.{t}" for t in given)}, sum((a.r - 1) * (b.r - 1)) AS dof FROM r{d} a
  JOIN r{d} b ON a.x < b.x{same('a', 'b')} GROUP BY ALL)""")
        label = f"concat_ws(',', {', '.join(f'names[{t}]' for t in given)})" if d else "''"
        using = f"x, y{names}"
        out.append(f"""d{d} AS (SELECT names[x] AS x, names[y] AS y, {label} AS given,
  round(ratio - (SELECT count(*) FROM coded), 2) AS stat, CAST(dof AS BIGINT) AS dof
  FROM s{d} JOIN f{d} USING ({using}), (SELECT {name} AS names))""")
    return f"WITH star AS ({w.STAR_SQL}), coded AS (SELECT [{codes}]::SMALLINT[] AS v FROM star), " + ", ".join(out) + \
        " SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2"


@query("chi2_cube", _cube_sql())
def chi2_cube(spark, sf):
    """Every pair of the fifteen columns given none, one or two others: one scan, all else from cells."""
    coded = encode.encode_table(w.star(spark, sf), w.STAR_COLUMNS)
    tests = cube.all_tests(w.STAR_COLUMNS, 2)
    names = local_frame(spark, [(i, t.x, t.y, ",".join(t.s)) for i, t in enumerate(tests)],
                        "test_id int, x string, y string, given string")
    stats = citest.cube_tests(coded, tests).drop("p")
    return stats.join(broadcast_if_small(names), "test_id").select("x", "y", "given", F.round("stat", 2).alias("stat"), "dof")


@query("skeleton_tests", f"""WITH every AS ({_cube_sql()}), near AS (SELECT x, y FROM every WHERE given = '' AND stat > dof),
ends AS (SELECT x AS v, y AS u FROM near UNION ALL SELECT y, x FROM near), around AS (SELECT v, list(u) AS us FROM ends GROUP BY v)
SELECT every.* FROM every JOIN near USING (x, y) JOIN around a ON a.v = x JOIN around b ON b.v = y
WHERE list_has_all(a.us, str_split_regex(given, ',')) OR list_has_all(b.us, str_split_regex(given, ',')) OR given = ''""")
def skeleton_tests(spark, sf):
    """Tests of depth 0 to 2 over the pairs whose own statistic is above its freedom."""
    coded = encode.encode_table(w.star(spark, sf), w.STAR_COLUMNS)
    every = local_frame(spark, [*combinations(sorted(w.STAR_COLUMNS), 2)], "a string, b string")
    found = durable(citest.level_statistics(coded, durable(citest.level_tests(every, 0)), 0))
    near = durable(found.where(F.round("stat", 2) > F.col("dof")).select(F.col("x").alias("a"), F.col("y").alias("b")))
    levels = [citest.level_statistics(coded, durable(citest.level_tests(near, d)), d) for d in range(3)]
    return levels[0].union(levels[1]).union(levels[2]).select(
        "x", "y", F.array_join("s", ",").alias("given"), F.round("stat", 2).alias("stat"), "dof")


def _critical(dof: int, alpha: float = 0.001) -> float:
    """Statistic whose tail probability is alpha."""
    lo, hi = 0.0, 1000.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, dof) > alpha else (lo, mid)
    return hi


@query("ci_decisions", f"""WITH star AS ({w.STAR_SQL}), st AS ({' UNION ALL '.join(_ci_sql(i, t) for i, t in enumerate(CI_TESTS))})
SELECT test_id, CASE WHEN stat >= critical THEN 'dependent' ELSE 'independent' END AS verdict
FROM st JOIN (VALUES {', '.join(f"({k}, {_critical(k)!r})" for k in range(1, 61))}) c(k, critical) ON k = dof""")
def ci_decisions(spark, sf):
    """late depends on the year; flag and status do not depend on each other."""
    coded = encode.encode_table(w.star(spark, sf), CI)
    tests = citest.ci_tests(coded, CI_TESTS)
    return tests.select("test_id", citest.decide(F.col("p"), 0.001, 0.0, F.lit(None).cast("double")).alias("verdict"))
