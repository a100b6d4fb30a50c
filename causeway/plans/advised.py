"""The subsample learner with advice at its four decision points, and guarded refinements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.config import AdvisedConfig
from causeway.functions import text
from causeway.operators import advice, assemble, graph, sampling, votes
from causeway.plans import subsample
from causeway.session import collect_bounded, durable, local_frame
from causeway.sources.responses import Advisor

ADVICE = "run_id int, new_parent string, new_child string, drops array<struct<parent: string, child: string>>"


class AdvisedLearner:
    """One training run; every step leaves tables that later steps join."""

    def __init__(self, df: DataFrame, key: str, config: AdvisedConfig, advisor: Advisor,
                 dictionary: DataFrame | None = None) -> None:
        self.spark = df.sparkSession
        self.df, self.key, self.config, self.advisor = df, key, config, advisor
        self.columns = [c for c in df.columns if c != key and c not in config.ignore_columns]
        self.nodes = local_frame(self.spark, [(c,) for c in self.columns], "node string")
        self.known = F.array(*[F.lit(c) for c in self.columns])
        empty = local_frame(self.spark, [], "var string, description string")
        self.dictionary = durable(dictionary.select("var", "description")) if dictionary is not None else empty
        everything = self.nodes.select("node", self.known.alias("names"))
        blocks = advice.description_block(everything, "node", "names", self.dictionary)
        self.blocks = durable(blocks.withColumnRenamed("key", "node"))
        self.block = collect_bounded(self.blocks.limit(1), "block")[0]["block"]
        self.stages: list[DataFrame] = []

    def _stage(self, name: str, edges: DataFrame) -> None:
        self.stages.append(edges.select(F.lit(name).alias("stage"), "parent", "child").distinct())

    def groupings(self) -> dict[str, set[str]]:
        answers = self.advisor.answer(advice.render_grouping(self.blocks), "column_grouping")
        names = advice_names(answers, F.col("node"), self.known)
        pairs = names.select(F.col("node").alias("a"), F.explode("names").alias("b"))
        out: dict[str, set[str]] = {}
        for row in collect_bounded(votes.symmetric_pairs(pairs), "related columns"):
            out.setdefault(row["a"], set()).add(row["b"])
        return out

    def candidates(self) -> None:
        """Edges and co-occurrence of all passes, with the state before targeted sampling."""
        c = self.config
        self.pre_votes = self.pre_cooc = self.trigger = None
        if c.candidates_path and not (c.column_grouping or c.adaptive_sampling):
            self.edges, self.cooc = subsample.load_candidates(self.spark, c.candidates_path)
            return
        related = self.groupings() if c.column_grouping else {}
        self.prepared = subsample.prepare(self.df, self.key, c)
        self.edges, self.cooc = self._pass(c.num_samples, None, related)
        self._stage("baseline", self.edges)
        if not c.adaptive_sampling:
            return
        self.pre_votes, self.pre_cooc = votes.vote_counts(self.edges), self.cooc
        done = c.num_samples
        for i in range(c.adaptive_passes):
            hot = durable(votes.uncertain_edges(votes.vote_counts(self.edges), self.cooc,
                                                c.entropy_threshold, c.min_cooccurrence))
            if hot.isEmpty():
                break
            seen = votes.trigger_entropy(hot)
            self.trigger = durable(seen if self.trigger is None else self.trigger.union(seen)
                                   .groupBy("a", "b").agg(F.max("entropy").alias("entropy")))
            forced = self._targets(hot)
            edges, cooc = self._pass(len(forced), forced, related)
            shifted = edges.withColumn("sample_id", (F.col("sample_id") + done).cast("int"))
            self.edges = durable(self.edges.unionByName(shifted))
            self.cooc = durable(votes.accumulate([self.cooc, cooc], ["a", "b"]))
            done += len(forced)
            self._stage(f"targeted_{i + 1}", self.edges)

    def _pass(self, samples: int, forced, related) -> tuple[DataFrame, DataFrame]:
        plan = subsample.column_plan(self.prepared, sampling.sample_plan(self.spark, samples, forced),
                                     self.config, related, self.config.column_weight)
        edges = subsample.search_samples(self.prepared, self.key, plan, samples, self.config)
        return edges, durable(votes.cooccurrence(plan, self.columns))

    def _targets(self, hot: DataFrame) -> list[list[str]]:
        answers = self.advisor.answer(advice.render_sampling(hot, self.blocks), "adaptive_sampling")
        tips = advice_names(answers, F.col("node"), self.known).withColumnRenamed("names", "cols")
        ordered = F.array_sort(F.collect_list(F.struct("edge_rank", "parent")))
        uncertain = hot.groupBy(F.col("child").alias("node"), "node_rank").agg(
            F.transform(ordered, lambda s: s["parent"]).alias("candidates")
        )
        k = min(self.config.num_columns_per_sample, len(self.columns))
        plan = sampling.targeted_plan(uncertain.drop("node_rank"), tips, k,
                                      self.config.targeted_samples_per_node)
        rank = uncertain.select("node", "node_rank")
        rows = collect_bounded(plan.join(rank, "node").orderBy("node_rank", "repeat"), "targeted samples")
        return [list(r["forced"]) for r in rows]

    def ranked(self) -> DataFrame:
        """Ranked parents (child, parent, n, rank); also sets the votes that remain."""
        c = self.config
        counted = durable(votes.vote_counts(self.edges))
        corr = subsample.parent_correlation(self.df, self.columns, c.rank_by)
        cut = votes.frequency_cutoff(counted, self.cooc, c.frequency_cutoff)
        if not c.parent_ordering:
            self._stage("cutoff", cut)
            self.kept = durable(votes.resolve_direction(cut))
            self._stage("direction", self.kept)
            return durable(votes.rank_parents(self.kept, corr))
        self.kept = durable(votes.resolve_direction(counted))
        self._stage("direction", self.kept)
        fallback = votes.rank_parents(
            votes.frequency_cutoff(self.kept, self.cooc, c.frequency_cutoff), corr
        )
        rows = self._evidence()
        answers = self.advisor.answer(advice.render_ordering(rows, self.blocks, c.show_counts), "parent_ordering")
        listed = answers.select("child", text.parse_names(F.col("content")).alias("names")).where(
            F.col("names").isNotNull()
        )
        ranked = durable(votes.advice_order(self.kept, listed, self.cooc, c.frequency_cutoff, fallback))
        self._stage("cutoff", ranked)
        return ranked

    def _evidence(self) -> DataFrame:
        pre_votes = self.pre_votes if self.pre_votes is not None else self.kept.limit(0)
        pre_cooc = self.pre_cooc if self.pre_cooc is not None else self.cooc.limit(0)
        trigger = self.trigger
        if trigger is None:
            trigger = local_frame(self.spark, [], "a string, b string, entropy double")
        return votes.trajectory(self.kept, self.cooc, pre_votes, pre_cooc, trigger)

    def merged(self, ranked: DataFrame) -> DataFrame:
        c = self.config
        ordered = durable(subsample.ranked_candidates(ranked, self.kept, self.nodes))
        if not c.cycle_arbitration:
            return durable(assemble.assemble(ordered, c.max_parents))
        told: list[tuple] = []
        while True:
            tips = local_frame(self.spark, told, ADVICE)
            stuck = assemble.assemble_advised(ordered, tips, c.max_parents, conflicts=True)
            first = durable(stuck.where(F.col("conflict_ord") == 0))
            if first.isEmpty():
                return durable(assemble.assemble_advised(ordered, tips, c.max_parents))
            answers = self.advisor.answer(advice.render_cycle(first), "cycle_arbitration")
            drops = advice.chosen_edges(text.parse_ints(F.col("content")), F.col("edges"))
            for r in collect_bounded(answers.select("run_id", "parent", "child", drops.alias("drops")), "advice"):
                told.append((r["run_id"], r["parent"], r["child"], [tuple(d) for d in r["drops"]]))

    def _supported(self, dag: DataFrame) -> DataFrame:
        have = self.kept.select("child", "parent", "n")
        joined = dag.join(have, ["child", "parent"], "left").withColumn(
            "n", F.coalesce("n", F.lit(0).cast("bigint"))
        )
        return votes.with_support(joined, self.cooc)

    def refined(self, dag: DataFrame, ranked: DataFrame) -> DataFrame:
        """One advised action per step, until it says stop or the steps are used up."""
        c = self.config
        missed = None
        if c.refinement_support:
            missed = durable(votes.near_miss(ranked, dag, self.cooc).withColumn("run_id", F.lit(0)))
        for step in range(c.refinement_steps or len(self.columns)):
            rendered = advice.render_refinement(self._supported(dag), missed, self.block)
            answers = self.advisor.answer(rendered, "refinement")
            parsed = text.parse_edit(F.col("content"))
            actions = durable(answers.select("run_id", F.lit(step).alias("ord"), parsed.alias("e")).where(
                F.col("e").isNotNull()).select("run_id", "ord", "e.*"))
            if not actions.where(F.col("action") == "terminate").isEmpty():
                break
            dag = durable(assemble.refine(dag, actions, self.columns))
        return dag

    def reviewed(self, dag: DataFrame) -> DataFrame:
        answers = self.advisor.answer(advice.render_confounders(self._supported(dag), self.block), "confounder_review")
        flags = answers.select(
            F.lit(0).alias("run_id"), "child", F.posexplode(text.parse_tuples(F.col("content"))).alias("ord", "t")
        ).select("run_id", "ord", "child", "t.*")
        return durable(assemble.drop_confounded(dag, assemble.valid_confounders(flags, dag, self.nodes)))

    def repaired(self, dag: DataFrame) -> DataFrame:
        c = self.config
        bare = graph.orphans(self.nodes, dag)
        answers = self.advisor.answer(advice.render_orphans(bare, self.block, c.max_parents), "orphan_repair")
        named = advice_names(answers, F.col("node"), self.known)
        offers = named.select(F.lit(0).alias("run_id"), F.col("node").alias("child"),
                              F.posexplode("names").alias("ord", "parent"))
        return durable(assemble.adopt_orphans(dag, offers, c.max_parents, self.columns))

    def fit(self) -> DataFrame:
        """(parent, child, n, cooc, freq, edge_ord)."""
        c = self.config
        self.candidates()
        if c.save_candidates_path:
            subsample.save_candidates(c.save_candidates_path, self.edges, self.cooc)
        ranked = self.ranked()
        dag = self.merged(ranked)
        self._stage("greedy", dag)
        for wanted, name, step in (
            (c.refinement, "refinement", lambda d: self.refined(d, ranked)),
            (c.confounder_review, "confounders", self.reviewed),
            (c.orphan_repair, "orphans", self.repaired),
        ):
            if wanted:
                dag = step(dag)
                self._stage(name, dag)
        return self._supported(dag).select("parent", "child", "n", "cooc", "freq", "edge_ord")

    def digests(self) -> DataFrame:
        """Fingerprint of the edge set after each stage."""
        out = self.stages[0]
        for stage in self.stages[1:]:
            out = out.union(stage)
        return votes.edge_digest(out, "stage")


def advice_names(answers: DataFrame, target, known) -> DataFrame:
    """(node, names) of answers with a list: known names other than the target."""
    parsed = text.known_names(text.parse_names(F.col("content")), known, target)
    return answers.select("node", parsed.alias("names")).where(F.col("names").isNotNull())
