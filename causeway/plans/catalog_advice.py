"""Queries on advice: requests, stored responses, parsing and structures from answers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.config import AnswerConfig, RequestSettings
from causeway.functions import text
from causeway.operators import advice, assemble, graph, votes
from causeway.plans import trade
from causeway.plans import workloads as w
from causeway.plans.full_table import structure_from_document
from causeway.plans.prompts import system_text
from causeway.plans.registry import query
from causeway.session import durable, shared_dir
from causeway.sources import bif, dictionary, documents, sweep
from causeway.sources.response_log import ResponseLog

SETTINGS = RequestSettings(model="advisor", max_tokens=256)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _requests(spark, sf):
    turns = w.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("user"))
    return advice.as_requests(turns, "edge_check", SETTINGS)


KEYED = f"""keyed AS (SELECT conv_id, turn, role, sha256(CAST(to_json({{'effort': NULL, 'max_tokens': 256, 'messages': [
  {{'content': {_sql_text(system_text('edge_check'))}, 'role': 'system'}}, {{'content': text, 'role': 'user'}}],
  'model': 'advisor', 'temperature': NULL}}) AS VARCHAR)) AS key FROM conversations)"""


@query("request_keys", f"WITH {KEYED} SELECT conv_id, turn, key FROM keyed")
def request_keys(spark, sf):
    """Every conversation turn as a request; whole texts go into the key."""
    return _requests(spark, sf).select("conv_id", "turn", "key")


@query("cache_split", f"""WITH {KEYED}, store AS (SELECT DISTINCT key FROM keyed WHERE turn < 2)
SELECT role, count(*) FILTER (key IN (SELECT key FROM store)) AS hits,
  count(*) FILTER (key NOT IN (SELECT key FROM store)) AS misses,
  count(DISTINCT CASE WHEN key NOT IN (SELECT key FROM store) THEN key END) AS calls FROM keyed GROUP BY role""")
def cache_split(spark, sf):
    """Turns answered from a store of the first two turns, and calls still needed."""
    asked = durable(_requests(spark, sf))
    store = asked.where(F.col("turn") < 2).select("key").distinct().select(
        "key", F.lit("seen").alias("content"), F.lit(None).cast(advice.USAGE).alias("usage")
    )
    hits, misses = advice.split_requests(asked, store)
    both = hits.select("role", "key", F.lit(True).alias("hit")).union(misses.select("role", "key", F.lit(False)))
    return both.groupBy("role").agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        F.count_distinct(F.when(~F.col("hit"), F.col("key"))).alias("calls"),
    )


@query("response_upsert", """SELECT CAST(conv_id AS VARCHAR) AS key, last(text ORDER BY turn) AS content, max(turn) AS seq
FROM conversations GROUP BY conv_id""")
def response_upsert(spark, sf):
    """Later writes win."""
    turns = w.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("key"), F.col("text").alias("content"), F.col("turn").alias("seq")
    )
    old, new = turns.where(F.col("seq") % 2 == 0), turns.where(F.col("seq") % 2 == 1)
    return advice.upsert(old, new)


@query("stored_answers", """SELECT CAST(conv_id AS VARCHAR) || '/' || turn AS key, text AS content FROM conversations WHERE length(text) <= 600""")
def stored_answers(spark, sf):
    """Answers cut off by a length limit are not stored."""
    answers = w.table(spark, sf, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        F.col("text").alias("content"), (F.length("text") > 600).alias("truncated"),
        F.lit(None).cast(advice.USAGE).alias("usage"),
    )
    return advice.storable(answers).select("key", "content")


@query("response_log", """WITH stored AS (SELECT 'c' || o_custkey AS key, year(o_orderdate) AS seq,
  o_orderpriority || ':' || o_orderkey AS content FROM orders WHERE o_orderstatus <> 'P'),
latest AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, content DESC) AS place FROM stored)
SELECT 'c' || c_custkey AS key, content, CAST(seq AS BIGINT) AS seq
FROM customer LEFT JOIN (SELECT * FROM latest WHERE place = 1) AS l ON l.key = 'c' || c_custkey""")
def response_log(spark, sf):
    """A response per order, appended half year by half year under its year; each customer looks up the latest one."""
    orders = w.table(spark, sf, "orders")
    half = F.floor((F.month("o_orderdate") - 1) / 6).cast("int")
    answers = orders.select(
        F.concat(F.lit("c"), "o_custkey").alias("key"), F.concat_ws(":", "o_orderpriority", "o_orderkey").alias("content"),
        (F.col("o_orderstatus") == "P").alias("truncated"), F.lit(None).cast(advice.USAGE).alias("usage"),
        F.year("o_orderdate").alias("year"), half.alias("half"))
    answers = durable(answers, ["year", "half"])
    log = ResponseLog(spark, os.path.join(shared_dir(spark), f"log-{uuid.uuid4().hex}"), buckets=8)
    times = sorted(tuple(r) for r in answers.select("year", "half").where("year IS NOT NULL").distinct().collect())
    for year, part in times:
        log.append(answers.where((F.col("year") == year) & (F.col("half") == part)), year)
    log.compact()
    asked = w.table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"))
    return asked.join(log.lookup(asked).drop("usage"), "key", "left")



LISTS = """answers AS (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'none of them' WHEN user_id % 5 = 1
  THEN 'I see ["' || event_type || '", ''user' || user_id || ''', "' || event_type || '"] and ["x"]'
  ELSE 'drop [' || user_id || ', 2] then [7]' END AS content FROM events)"""


def _lists(spark, sf):
    user = F.col("user_id").cast("string")
    content = F.when(F.col("user_id") % 5 == 0, "none of them").when(
        F.col("user_id") % 5 == 1,
        F.concat(F.lit('I see ["'), "event_type", F.lit("\", 'user"), user, F.lit("', \""), "event_type", F.lit('"] and ["x"]')),
    ).otherwise(F.concat(F.lit("drop ["), user, F.lit(", 2] then [7]")))
    return w.table(spark, sf, "events").select("event_id", "event_type", content.alias("content"))


@query("parse_lists", f"""WITH {LISTS} SELECT event_id,
  CASE WHEN regexp_matches(content, '\\[') THEN array_to_string(regexp_extract_all(regexp_extract(content, '\\[([^\\[\\]]*)\\]', 1), '[''"]([^''"]*)[''"]', 1), ',') END AS names,
  CASE WHEN regexp_matches(content, '\\[') THEN array_to_string(regexp_extract_all(regexp_extract(content, '\\[([^\\[\\]]*)\\]', 1), '-?\\d+'), ',') END AS ints
FROM answers""")
def parse_lists(spark, sf):
    ints = F.transform(text.parse_ints(F.col("content")), lambda i: i.cast("string"))
    return _lists(spark, sf).select("event_id", F.array_join(text.parse_names(F.col("content")), ",").alias("names"),
                                    F.array_join(ints, ",").alias("ints"))


@query("known_names", """SELECT event_id, CASE WHEN user_id % 5 = 1 AND event_type <> 'click' THEN event_type
  WHEN user_id % 5 <> 0 THEN '' END AS names FROM events""")
def known_names(spark, sf):
    """Only known event types other than the target, each once."""
    known = F.array(*[F.lit(x) for x in ("click", "view", "error", "signup", "purchase")])
    names = text.known_names(text.parse_names(F.col("content")), known, F.lit("click"))
    return _lists(spark, sf).select("event_id", F.array_join(names, ",").alias("names"))


@query("parse_pages", """SELECT page_id,
  array_to_string(list_filter(list_transform(string_split(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS names,
  regexp_extract(html, '\\[([^\\[\\]]*)\\]', 1) AS bracket, TRY_CAST(nullif(regexp_extract(html, '-?\\d+\\.?\\d*'), '') AS DOUBLE) AS num
FROM pages WHERE html LIKE '%<title>%</title>%'""")
def parse_pages(spark, sf):
    """The answer parsers on whole web pages."""
    pages = w.table(spark, sf, "pages")
    names = text.parse_tagged(F.col("html"), "title")
    return pages.select(
        "page_id", F.array_join(names, "|").alias("names"),
        F.regexp_extract("html", text.FIRST_LIST, 1).alias("bracket"), text.parse_number(F.col("html")).alias("num"),
    ).where(F.col("names").isNotNull())


@query("first_numbers", """SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '-?\\d+\\.?\\d*'), '') AS DOUBLE) AS num FROM documents""")
def first_numbers(spark, sf):
    return w.table(spark, sf, "documents").select("doc_id", text.parse_number(F.col("text")).alias("num"))


@query("parse_tuples", """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN event_type || '<' || 'u' || user_id || ';a b<c' ELSE '' END AS pairs FROM events""")
def parse_tuples(spark, sf):
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    content = F.when(F.col("user_id") % 2 == 0, F.concat(
        F.lit('Flags: [("'), "event_type", F.lit('", "'), user, F.lit("\"),\n ('a b', 'c')] done"))).otherwise(F.lit("[]"))
    pairs = F.transform(text.parse_tuples(content), lambda t: F.concat(t["parent"], F.lit("<"), t["confounder"]))
    return w.table(spark, sf, "events").select("event_id", F.array_join(pairs, ";").alias("pairs"))


@query("parse_edits", """SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'delete' WHEN 2 THEN 'terminate' END AS action,
  CASE user_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN '' END AS parent,
  CASE user_id % 4 WHEN 0 THEN 'u' || user_id WHEN 1 THEN 'u' || user_id WHEN 2 THEN '' END AS child FROM events""")
def parse_edits(spark, sf):
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    kind = F.col("user_id") % 4
    content = (
        F.when(kind == 0, F.concat(F.lit(" add_edge('"), "event_type", F.lit("', \""), user, F.lit('")')))
        .when(kind == 1, F.concat(F.lit("delete_edge("), "event_type", F.lit(","), user, F.lit(")")))
        .when(kind == 2, "terminate()").otherwise(F.concat(F.lit("maybe add_edge(a, "), user, F.lit(")")))
    )
    return w.table(spark, sf, "events").select("event_id", text.parse_edit(content).alias("e")).select("event_id", "e.*")


VERDICTS = """v AS (SELECT event_id, user_id % 50 AS k, CAST(json_extract(props, '$.k') AS INTEGER) AS f, 30 AS r, user_id FROM events)"""


@query("parse_verdicts", f"""WITH {VERDICTS} SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL
  WHEN k >= f AND k >= r THEN 'KEEP' WHEN f >= r THEN 'FLIP' ELSE 'REMOVE' END AS verdict FROM v""")
def parse_verdicts(spark, sf):
    """Fenced JSON verdicts; one in seven lacks a key."""
    k, f = (F.col("user_id") % 50).cast("string"), F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"KEEP": '), k, F.lit(', "FLIP": '), f, F.lit("}"))
    full = F.concat(F.lit('```json\n{"KEEP": '), k, F.lit(', "FLIP": '), f, F.lit(', "REMOVE": 30}\n```'))
    content = F.when(F.col("user_id") % 7 == 0, body).otherwise(full)
    return w.table(spark, sf, "events").select("event_id", text.parse_verdict(content).alias("verdict"))


@query("parse_bits", """SELECT event_id, CASE WHEN user_id % 3 = 2 THEN NULL ELSE CAST(user_id % 3 AS INTEGER) END AS bit FROM events""")
def parse_bits(spark, sf):
    content = F.concat(F.lit("\n answer "), (F.col("user_id") % 3).cast("string"), F.lit("\n 1 or 0"))
    return w.table(spark, sf, "events").select("event_id", text.parse_bit(content).alias("bit"))


@query("parse_cycle_edits", """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'Remove' ELSE 'Reverse' END AS action,
  event_type AS a, 'user ' || user_id AS b FROM events""")
def parse_cycle_edits(spark, sf):
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    verb = F.when(F.col("user_id") % 2 == 0, "remove").otherwise("REVERSE")
    content = F.concat(F.lit("Remove: x and y\n "), verb, F.lit(" : "), "event_type", F.lit(" and "), user, F.lit(" "))
    cycle = F.array(F.col("event_type"), user)
    return w.table(spark, sf, "events").select("event_id", text.parse_cycle_edit(content, cycle).alias("e")).select("event_id", "e.*")


DOC = f"{trade.DAG_SQL} SELECT 0 AS run_id, parent, child FROM dag WHERE parent <> 'NATION_3' AND child <> 'NATION_3'"


@query("document_structure", DOC)
def document_structure(spark, sf):
    """A structure from one fenced JSON answer that describes the nation graph."""
    dag = trade.graph(spark, sf)
    entries = dag.groupBy(F.col("child").alias("node_name")).agg(
        F.concat(F.collect_list("parent"), F.array(F.lit("unknown"), F.first("child"))).alias("parents")
    )
    answer = entries.agg(F.collect_list(F.struct("node_name", "parents")).alias("nodes"))
    content = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.struct("nodes").alias("bn"))), F.lit("\n```"))
    known = trade.node_frame(spark, sf).where(F.col("node") != "NATION_3")
    out = structure_from_document(answer.select(F.lit(0).alias("run_id"), content.alias("content")), known, AnswerConfig())
    return out.select("run_id", "parent", "child")


@query("visit_structure", f"""{trade.DAG_SQL} SELECT 0 AS run_id, parent, child FROM dag""")
def visit_structure(spark, sf):
    """Edges from tagged answers, one per visited nation, with noise to be cleaned away."""
    dag = durable(trade.graph(spark, sf))
    listed = dag.groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("kids"))
    content = F.concat(F.lit("So: <Answer>"), F.array_join("kids", ", "), F.lit(", nowhere, ,"), "parent", F.lit("</Answer>"))
    visits = listed.select(F.lit(0).alias("run_id"), F.col("parent").alias("ord"), F.col("parent").alias("visited"), content.alias("content"))
    roots = [r["node"] for r in graph.orphans(dag.select(F.col("parent").alias("node")), dag).collect()]
    edges = advice.answer_children(visits, roots, trade.node_frame(spark, sf), text.parse_tagged(F.col("content")))
    return assemble.acyclic_filter(edges).select("run_id", "parent", "child")


def _blocks(spark, sf):
    known = w.table(spark, sf, "nation").where(F.col("n_regionkey") != 4).select(
        F.col("n_name").alias("var"), F.concat(F.lit("Nation number "), F.col("n_nationkey").cast("string")).alias("description")
    )
    nation = w.table(spark, sf, "nation")
    same = nation.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    items = nation.join(same, "n_regionkey").select(F.col("n_name").alias("node"), "names")
    return advice.description_block(items, "node", "names", known)


BLOCKS = """blocks AS (SELECT o.n_name AS node, CASE WHEN o.n_regionkey = 4 THEN '' ELSE 'Variables:' || chr(10) ||
  (SELECT string_agg('- ' || m.n_name || ': Nation number ' || m.n_nationkey, chr(10) ORDER BY m.n_name)
   FROM nation m WHERE m.n_regionkey = o.n_regionkey) || chr(10) END AS block FROM nation o)"""


@query("grouping_requests", f"WITH {BLOCKS} SELECT node, block || 'Target: ' || node AS \"user\" FROM blocks")
def grouping_requests(spark, sf):
    return advice.render_grouping(_blocks(spark, sf))


BASE = f"WITH {trade.LINES_SQL}, {trade.votes_sql()}, {trade.COOC_SQL}, {BLOCKS}"
RATED = "rated AS (SELECT v.*, c.n AS cooc, v.n / c.n AS freq FROM voted v JOIN cooc c ON c.a = v.child AND c.b = v.parent)"


def _votes(spark, sf):
    lines = durable(trade.daily_lines(spark, sf))
    return votes.vote_counts(trade.vote_log(lines)), durable(
        votes.cooccurrence(trade.day_plan(lines), trade.nations(spark, sf)))


@query("ordering_requests", f"""{BASE}, {RATED}, lines_ AS (SELECT child, string_agg(parent || ': ' || format('{{:.1f}}%', round(n * 100.0 / cooc, 1))
  || ' (' || n || '/' || cooc || ')', chr(10) ORDER BY n DESC, parent) AS lines FROM rated GROUP BY child)
SELECT child, block || 'Target: ' || child || chr(10) || 'Candidates:' || chr(10) || lines AS "user" FROM lines_ JOIN blocks ON node = child""")
def ordering_requests(spark, sf):
    """Candidates of each nation with their support, most voted first."""
    voted, cooc = _votes(spark, sf)
    trigger = spark.createDataFrame([], "a string, b string, entropy double")
    rows = votes.trajectory(voted, cooc, voted.limit(0), cooc.limit(0), trigger)
    return advice.render_ordering(rows, _blocks(spark, sf))


@query("sampling_requests", f"""{BASE}, {RATED}, h AS (SELECT *, -freq * log2(freq) - (1 - freq) * log2(1 - freq) AS e FROM rated WHERE freq < 1),
r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY e DESC, parent) AS rk FROM h WHERE e > 0.2 AND cooc >= 5),
l AS (SELECT child, string_agg('- ' || parent || ': rate ' || format('{{:.2f}}', round(freq, 2)) || ', entropy ' || format('{{:.2f}}', round(e, 2)) || ' bits', chr(10) ORDER BY rk) AS lines
  FROM r WHERE rk <= 20 GROUP BY child)
SELECT node, block || 'Target: ' || child || chr(10) || 'Uncertain causes:' || chr(10) || lines AS "user" FROM l JOIN blocks ON node = child""")
def sampling_requests(spark, sf):
    voted, cooc = _votes(spark, sf)
    return advice.render_sampling(votes.uncertain_edges(voted, cooc, 0.2, 5), _blocks(spark, sf))


@query("refinement_requests")
def refinement_requests(spark, sf):
    """Placed edges and the best edges left out, with support."""
    voted, cooc = _votes(spark, sf)
    resolved = durable(votes.resolve_direction(voted))
    dag = durable(trade.best_parents(resolved, 2, True))
    placed = votes.with_support(dag.join(resolved.select("child", "parent", "n"), ["child", "parent"]), cooc)
    missed = votes.near_miss(votes.rank_parents(resolved), dag, cooc)
    return advice.render_refinement(placed.withColumn("run_id", F.lit(0)), missed.withColumn("run_id", F.lit(0)), "")


@query("confounder_requests", f"""{BASE}, {RATED}, {trade.graph_sql('dag')}, e AS (SELECT d.child, d.parent, r.n, r.cooc FROM dag d JOIN rated r USING (child, parent))
SELECT child, 'Target: ' || child || chr(10) || 'Its causes:' || chr(10) || string_agg('- ' || parent || ' (' ||
  format('{{:.2f}}', round(n / cooc, 2)) || ' (' || n || '/' || cooc || ' co-sampled searches))', chr(10) ORDER BY parent) AS "user" FROM e GROUP BY child""")
def confounder_requests(spark, sf):
    voted, cooc = _votes(spark, sf)
    resolved = durable(votes.resolve_direction(voted))
    dag = trade.best_parents(resolved, 2, True)
    placed = votes.with_support(dag.join(resolved.select("child", "parent", "n"), ["child", "parent"]), cooc)
    return advice.render_confounders(placed, "")


@query("pairwise_requests", f"""{trade.DAG_SQL}, orphan AS (SELECT n_name AS node FROM nation WHERE n_name NOT IN (SELECT child FROM dag))
SELECT 'check' AS kind, 'Does ' || parent || ' cause ' || child || '? KEEP it, FLIP it, or REMOVE it.' AS "user" FROM dag
UNION ALL SELECT 'orient', 'Which way: ' || parent || ' causes ' || child || ' (1) or ' || child || ' causes ' || parent || ' (0)?' FROM dag
UNION ALL SELECT 'test', 'Are ' || parent || ' and ' || child || ' independent given nothing?' FROM dag
UNION ALL SELECT 'cycle', 'Cycle: ' || parent || ' -> ' || child || ' -> ' || parent FROM dag
UNION ALL SELECT 'orphan', 'Target: ' || node || chr(10) || 'At most 3 names.' FROM orphan""")
def pairwise_requests(spark, sf):
    """The short requests: edge checks, directions, tests, cycles and orphans."""
    dag = durable(trade.graph(spark, sf))
    pairs = dag.select(F.col("parent").alias("a"), F.col("child").alias("b"))
    tests = dag.select(F.lit(0).alias("test_id"), F.col("parent").alias("x"), F.col("child").alias("y"),
                       F.array().cast("array<string>").alias("s"))
    cycles = dag.select(F.array("parent", "child").alias("cycle"))
    orphan = graph.orphans(trade.node_frame(spark, sf), dag)
    parts = [("check", advice.render_edge_check(dag)), ("orient", advice.render_orientation(pairs)),
             ("test", advice.render_independence(tests)), ("cycle", advice.render_cycle_edit(cycles)),
             ("orphan", advice.render_orphans(orphan, "", 3))]
    out = None
    for kind, df in parts:
        part = df.select(F.lit(kind).alias("kind"), "user")
        out = part if out is None else out.union(part)
    return out


@query("cycle_requests")
def cycle_requests(spark, sf):
    """Conflicts of the greedy assembly, with numbered edges."""
    from causeway.plans.catalog_graph import _ranked_runs

    none = spark.createDataFrame([], "run_id int, new_parent string, new_child string, drops array<struct<parent: string, child: string>>")
    return advice.render_cycle(assemble.assemble_advised(_ranked_runs(spark, sf), none, 3, conflicts=True)).select(
        "run_id", "parent", "child", "user")


@query("variable_request", """WITH s AS (SELECT var, string_agg(DISTINCT state, ', ' ORDER BY state) AS states FROM
  (SELECT o_orderstatus, o_orderpriority FROM orders) UNPIVOT (state FOR var IN (o_orderstatus, o_orderpriority)) GROUP BY var)
SELECT 0 AS run_id, string_agg('| ' || var || ' | ' || CASE WHEN var = 'o_orderstatus' THEN 'Status of an order' ELSE '' END || ' | ' || states || ' |', chr(10) ORDER BY var) AS "user" FROM s""")
def variable_request(spark, sf):
    from causeway.operators.encode import state_catalogue

    known = spark.createDataFrame([("o_orderstatus", "Status of an order")], "var string, description string")
    found = state_catalogue(w.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
    return advice.render_variables(found, known)


@query("followup_requests")
def followup_requests(spark, sf):
    """Ask for effects of each numeric column, with its correlations."""
    from causeway.operators.counts import correlation

    corr = durable(correlation(w.star_numeric(spark, sf), w.NUMERIC_COLUMNS))
    return advice.render_followup(corr.select(F.col("a").alias("node")).distinct(), corr)


@query("edge_revision", f"""{trade.DAG_SQL}, v AS (SELECT d.*, (SELECT n_nationkey % 4 FROM nation WHERE n_name = d.child) AS m FROM dag d)
SELECT CASE WHEN m = 1 THEN child ELSE parent END AS parent, CASE WHEN m = 1 THEN parent ELSE child END AS child FROM v WHERE m <> 2""")
def edge_revision(spark, sf):
    """Verdicts by the child's key: keep, flip, remove or none."""
    dag = durable(trade.graph(spark, sf))
    m = w.table(spark, sf, "nation").select(F.col("n_name").alias("child"), (F.col("n_nationkey") % 4).alias("m"))
    verdict = F.when(F.col("m") == 0, "KEEP").when(F.col("m") == 1, "FLIP").when(F.col("m") == 2, "REMOVE")
    return advice.revise_edges(dag, dag.join(m, "child").select("parent", "child", verdict.alias("verdict")))


@query("pair_orientation", f"""{trade.DAG_SQL}, v AS (SELECT least(parent, child) AS a, greatest(parent, child) AS b,
  (SELECT n_nationkey % 3 FROM nation WHERE n_name = d.child) AS m FROM dag d)
SELECT CASE WHEN m = 1 THEN a ELSE b END AS parent, CASE WHEN m = 1 THEN b ELSE a END AS child FROM v WHERE m < 2""")
def pair_orientation(spark, sf):
    dag = durable(trade.graph(spark, sf))
    m = w.table(spark, sf, "nation").select(F.col("n_name").alias("child"), (F.col("n_nationkey") % 3).alias("m"))
    pairs = dag.join(m, "child").select(F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b"), "m")
    return advice.orient_pairs(pairs.select("a", "b"), pairs.select("a", "b", F.when(F.col("m") < 2, F.col("m")).alias("bit")))


def _edited(spark, sf):
    dag = durable(trade.graph(spark, sf))
    return dag.select(F.lit(0).alias("run_id"), F.concat("child", "parent").alias("edge_ord"), "parent", "child")


@query("refined_graph")
def refined_graph(spark, sf):
    """Turn every edge of region 1 around: one deletion and one addition each, in order."""
    edges = durable(_edited(spark, sf))
    mine = w.table(spark, sf, "nation").where(F.col("n_regionkey") == 1).select(F.col("n_name").alias("child"))
    turned = edges.join(mine, "child", "left_semi")
    actions = turned.select("run_id", F.concat("edge_ord", F.lit("0")).alias("ord"), F.lit("delete").alias("action"), "parent", "child").union(
        turned.select("run_id", F.concat("edge_ord", F.lit("1")), F.lit("add"), "child", "parent"))
    return assemble.refine(edges, actions, trade.nations(spark, sf))


@query("confounder_review")
def confounder_review(spark, sf):
    """Every second parent is blamed on the first nation of its region."""
    edges, nation = durable(_edited(spark, sf)), w.table(spark, sf, "nation")
    first = nation.withColumn("n", F.min("n_name").over(Window.partitionBy("n_regionkey")))
    flags = edges.join(first.where(F.col("n_nationkey") % 2 == 0).select(F.col("n_name").alias("parent"), F.col("n").alias("confounder")), "parent")
    flags = flags.select("run_id", F.col("edge_ord").alias("ord"), "parent", "child", "confounder")
    return assemble.drop_confounded(edges, assemble.valid_confounders(flags, edges, trade.node_frame(spark, sf)))


@query("orphan_repair")
def orphan_repair(spark, sf):
    """Nations without parents are offered the others of their region."""
    edges, nation = durable(_edited(spark, sf)), w.table(spark, sf, "nation")
    bare = graph.orphans(trade.node_frame(spark, sf), edges)
    peers = nation.join(bare.withColumnRenamed("node", "n_name"), "n_name", "left_semi").select("n_regionkey", F.col("n_name").alias("child"))
    offers = peers.join(nation.select("n_regionkey", F.col("n_name").alias("parent")), "n_regionkey").select(
        F.lit(0).alias("run_id"), F.col("parent").alias("ord"), "parent", "child")
    return assemble.adopt_orphans(edges, offers, 2, trade.nations(spark, sf))


@query("cycle_edits")
def cycle_edits(spark, sf):
    """Each cycle of the unconstrained nation graph loses or turns its closing edge."""
    dag = durable(trade.graph(spark, sf, acyclic=False))
    edges = dag.select(F.lit(0).alias("run_id"), F.concat("child", "parent").alias("edge_ord"), "parent", "child")
    cycles = graph.simple_cycles(dag)
    action = F.when(F.size("cycle") % 2 == 0, "Remove").otherwise("Reverse")
    todo = cycles.select(F.lit(0).alias("run_id"), F.array_join("cycle", ">").alias("ord"), action.alias("action"),
                         F.element_at("cycle", -1).alias("parent"), F.col("cycle")[0].alias("child"))
    return assemble.cycle_edits(edges, todo)


@query("variable_dictionary", """SELECT o_orderpriority AS var, 'Priority ' || o_orderpriority AS name, 'Orders with ' || o_orderpriority AS description,
  o_orderstatus AS state, count(*) || ' orders' AS text FROM orders GROUP BY ALL""")
def variable_dictionary(spark, sf):
    """A dictionary written as JSON and read back into tables."""
    counts = w.table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").cast("string").alias("n"))
    states = F.map_from_entries(F.collect_list(F.struct("o_orderstatus", F.concat("n", F.lit(" orders")))))
    entries = counts.groupBy("o_orderpriority").agg(states.alias("states_description")).select(
        "o_orderpriority", F.struct(F.concat(F.lit("Priority "), "o_orderpriority").alias("name"),
                                    F.concat(F.lit("Orders with "), "o_orderpriority").alias("description"), "states_description").alias("e"))
    doc = entries.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "e")))).alias("value"))
    path = os.path.join(shared_dir(spark), f"dictionary-{uuid.uuid4().hex}")
    doc.write.text(path)
    read = dictionary.read_dictionary(spark, path)
    return read.select("var", "name", "description", F.explode("states").alias("state", "text"))


@query("network_files", """WITH t AS (SELECT l_returnflag AS network, l_linestatus AS s, CASE WHEN l_quantity > 25 THEN 'hi' ELSE 'lo' END AS q FROM lineitem),
ns AS (SELECT network, s, count(*) AS n FROM t GROUP BY ALL), ts AS (SELECT network, count(*) AS n FROM t GROUP BY ALL), nq AS (SELECT network, s, q, count(*) AS n FROM t GROUP BY ALL)
SELECT network, 'status' AS node, '' AS cfg, s AS state, round(ns.n / ts.n, 9) AS p FROM ns JOIN ts USING (network)
UNION ALL SELECT network, 'volume', s, q, round(nq.n / ns.n, 9) FROM nq JOIN ns USING (network, s)""")
def network_files(spark, sf):
    """One network per return flag, fitted, written as files and parsed back."""
    t = w.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("network"), F.col("l_linestatus").alias("s"),
        F.when(F.col("l_quantity") > 25, "hi").otherwise("lo").alias("q"))
    counted = durable(t.groupBy("network", "s", "q").agg(F.count("*").alias("n")))
    none = F.array().cast("array<string>")

    def table(node, key, state, parents):
        grouped = counted.groupBy("network", key.alias("cfg"), state.alias("state")).agg(F.sum("n").alias("n"))
        rows = grouped.groupBy("network", "cfg").agg(F.array_sort(F.collect_list(F.struct("state", "n"))).alias("z"), F.sum("n").alias("t"))
        return rows.select("network", F.lit(node).alias("node"), parents.alias("parents"), "cfg",
                           F.transform("z", lambda e: e["state"]).alias("states"),
                           F.transform("z", lambda e: e["n"] / F.col("t")).alias("probs"))

    cpt = durable(table("status", none, F.col("s"), none).union(table("volume", F.array("s"), F.col("q"), F.array(F.lit("status")))))
    nodes = bif.rank_rows(cpt.groupBy("network", "node").agg(F.first("states").alias("states")))
    path = os.path.join(shared_dir(spark), f"networks-{uuid.uuid4().hex}")
    texts = bif.network_text(nodes, cpt)
    texts.select("network", "text").write.partitionBy("network").option("lineSep", "\n").text(path)
    read = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    parsed = bif.network_cpt(read.select("network", "text"))
    return parsed.select("network", "node", F.array_join("cfg", "|").alias("cfg"), "state", F.round("p", 9).alias("p"))


@query("question_files", """SELECT event_type AS target_node, CAST(user_id AS VARCHAR) AS u, CAST(event_id AS VARCHAR) AS ground_truth_prediction, props AS synthetic_data_value FROM events""")
def question_files(spark, sf):
    """Questions written in two batches and read back with their context maps."""
    asked = w.table(spark, sf, "events").select(
        F.col("event_type").alias("target_node"), F.create_map(F.lit("u"), F.col("user_id").cast("string")).alias("context"),
        F.col("event_id").cast("string").alias("ground_truth_prediction"), F.col("props").alias("synthetic_data_value"))
    path = os.path.join(shared_dir(spark), f"questions-{uuid.uuid4().hex}")
    documents.write_questions(asked.where(F.col("target_node") < "e"), path)
    documents.write_questions(asked.where(F.col("target_node") >= "e"), path, mode="append")
    read = documents.read_questions(spark, path)
    return read.select("target_node", F.col("context")["u"].alias("u"), "ground_truth_prediction", "synthetic_data_value")


@query("metric_files", """SELECT 'r' AS run, c_mktsegment AS model, CAST(year(o_orderdate) AS INTEGER) AS trial, 'orders.n' AS path, CAST(count(*) AS DOUBLE) AS value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def metric_files(spark, sf):
    """Reports as partitioned metric tables, read back."""
    orders = w.table(spark, sf, "orders").join(w.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    reports = orders.groupBy(F.col("c_mktsegment").alias("model"), F.year("o_orderdate").alias("trial")).agg(F.count("*").alias("n"))
    long = documents.wide_to_metrics(reports.withColumn("run", F.lit("r")), "orders", ["run", "model", "trial"])
    path = os.path.join(shared_dir(spark), f"metrics-{uuid.uuid4().hex}")
    documents.write_metrics(long, path)
    return documents.read_metrics(spark, path).select("run", "model", "trial", "path", "value")


@query("sweep_expansion", """WITH d AS (SELECT c_mktsegment AS dataset, count(*) AS n FROM customer GROUP BY ALL)
SELECT 'sweep' AS name, dataset, CAST(run_ord AS INTEGER) AS run_ord, CAST(trial AS INTEGER) AS trial, model,
  CASE WHEN run_ord = 1 THEN 'late' ELSE CAST(n AS VARCHAR) END AS rows, '5' AS samples
FROM d, range(2) r(run_ord), range(2) t(trial), (SELECT unnest(['subsample', 'ges']) AS model)""")
def sweep_expansion(spark, sf):
    """One dataset per market segment, two runs, two trials, two models."""
    from causeway.plans.model import LEARNERS

    sets = w.table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").cast("string").alias("n"))
    made = sets.agg(F.collect_list(F.create_map(F.lit("name"), F.col("c_mktsegment"), F.lit("rows"), F.col("n"))).alias("datasets"))
    sweeps = made.select(
        F.lit("sweep").alias("name"),
        F.create_map(F.lit("models"), F.lit('["subsample", "ges"]'), F.lit("num_trials"), F.lit("2"),
                     F.lit("samples"), F.lit("5"), F.lit("rows"), F.lit("0")).alias("defaults"),
        "datasets", F.array(F.create_map().cast("map<string,string>"), F.create_map(F.lit("rows"), F.lit("late"))).alias("runs"))
    out = sweep.expand(sweeps, LEARNERS)
    return out.select("name", "dataset", "run_ord", "trial", "model", F.col("settings")["rows"].alias("rows"),
                      F.col("settings")["samples"].alias("samples"))
