"""Evaluation: graph comparison, classification, blankets and variance over trials."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.mathx import t_quantile
from causeway.session import by_shuffle, local_frame

UNKNOWN = "__unknown__"
RELATIONS = ("A->B", "B->A", "none")


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two arrays; NULL when both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def mean_blanket_jaccard(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean overlap of (center, node) blankets over centers present in both."""
    def lists(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("center").agg(F.collect_set("node").alias(name))

    joined = lists(left, "l").join(lists(right, "r"), "center")
    return joined.agg(F.avg(jaccard(F.col("l"), F.col("r"))).alias("mb_jaccard"))


def union_nodes(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("node").union(right.select("node")).distinct()


def pair_relations(truth: DataFrame, learned: DataFrame) -> DataFrame:
    """(a, b, gt_rel, learned_rel), a < b, for pairs with an edge in either graph.

    All other pairs are none/none; they are counted arithmetically, never listed.
    """
    def rel(df: DataFrame, name: str) -> DataFrame:
        keyed = df.select(
            F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b"),
            F.when(F.col("parent") < F.col("child"), "A->B").otherwise("B->A").alias("r"),
        )
        return keyed.groupBy("a", "b").agg(F.min("r").alias(name))

    return rel(truth, "gt_rel").join(rel(learned, "learned_rel"), ["a", "b"], "full").select(
        "a", "b", F.coalesce("gt_rel", F.lit("none")).alias("gt_rel"),
        F.coalesce("learned_rel", F.lit("none")).alias("learned_rel"),
    )


def relation_counts(truth: DataFrame, learned: DataFrame, nodes: DataFrame) -> DataFrame:
    """(truth, pred, n) over all unordered node pairs, including none/none."""
    spark = nodes.sparkSession
    seen = pair_relations(truth, learned).groupBy(
        F.col("gt_rel").alias("truth"), F.col("learned_rel").alias("pred")
    ).agg(F.count("*").alias("n"))
    known = seen.select(F.col("n").alias("s"), F.lit(0).cast("bigint").alias("k"))
    every = nodes.select("node").distinct().select(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))
    rest = known.union(every).agg(F.sum("s").alias("s"), F.sum("k").alias("k")).select(
        F.lit("none").alias("truth"), F.lit("none").alias("pred"),
        (F.expr("k * (k - 1) div 2") - F.col("s")).alias("n"),
    )
    grid = local_frame(spark, [(t, p) for t in RELATIONS for p in RELATIONS], "truth string, pred string")
    total = seen.unionByName(rest).groupBy("truth", "pred").agg(F.sum("n").alias("n"))
    return grid.join(total, ["truth", "pred"], "left").select(
        "truth", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def per_label(confusion: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys.., label, tp, fp, fn, precision, recall, f1); empty denominators give zero."""
    cells = confusion.select(*keys, "truth", "pred", "n")
    sides = cells.select(
        *keys, "n", (F.col("truth") == F.col("pred")).alias("hit"),
        F.explode(F.array(
            F.struct(F.col("truth").alias("label"), F.lit("t").alias("side")),
            F.struct(F.col("pred").alias("label"), F.lit("p").alias("side")),
        )).alias("e"),
    )
    counts = sides.groupBy(*keys, F.col("e.label").alias("label")).agg(
        F.sum(F.when(F.col("hit") & (F.col("e.side") == "t"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("hit") & (F.col("e.side") == "p"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("hit") & (F.col("e.side") == "t"), F.col("n")).otherwise(0)).alias("fn"),
    )
    zero = F.lit(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *keys, "label", "tp", "fp", "fn",
        F.coalesce(F.try_divide(tp, tp + fp), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
    )


def macro_scores(confusion: DataFrame) -> DataFrame:
    """Macro precision, recall and F1 over the labels of the confusion table."""
    return per_label(confusion).agg(
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def classification_metrics(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics of (keys.., truth, pred) rows, labels compared as text.

    Two classes: the second label in text order is the positive one. More: macro means.
    A single class in the truth gives accuracy and a note only.
    """
    confusion = pairs.select(
        *keys, F.col("truth").cast("string").alias("truth"), F.col("pred").cast("string").alias("pred")
    ).groupBy(*keys, "truth", "pred").agg(F.count("*").alias("n"))
    # every row is a hit or a miss of its own true label, so the labels hold all totals
    actual = F.col("tp") + F.col("fn")
    joined = per_label(confusion, keys).groupBy(*keys).agg(
        F.sum(actual).alias("n_samples"), F.count_if(actual > 0).alias("true_classes"),
        (F.sum("tp") / F.sum(actual)).alias("accuracy"), F.count("*").alias("n_classes"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[F.max_by(m, "label").alias(f"second_{m}") for m in ("precision", "recall", "f1")],
    )
    single = F.col("true_classes") < 2

    def pick(m: str) -> Column:
        value = F.when(F.col("n_classes") == 2, F.col(f"second_{m}")).otherwise(F.col(f"macro_{m}"))
        return F.when(~single, value).alias(m)

    note = F.when(single, "Only one class present in true labels").alias("note")
    return joined.select(*keys, "n_samples", "n_classes", "accuracy", pick("precision"),
                         pick("recall"), pick("f1"), note)


def align_predictions(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, truth, observed, pred); a question without an answer predicts a label of its own."""
    joined = questions.join(by_shuffle(answers.select("query_id", "pred")), "query_id", "left")
    return joined.select(
        "query_id", F.col("ground_truth_prediction").alias("truth"),
        F.col("synthetic_data_value").alias("observed"),
        F.coalesce("pred", F.lit(UNKNOWN)).alias("pred"),
    )


def question_report(aligned: DataFrame) -> DataFrame:
    """Three comparisons in one pass: model/truth, model/data, truth/data."""
    kinds = F.explode(F.array(
        F.struct(F.lit("model_vs_ground_truth").alias("comparison"), F.col("truth").alias("t"), F.col("pred").alias("p")),
        F.struct(F.lit("model_vs_synthetic_data").alias("comparison"), F.col("observed").alias("t"), F.col("pred").alias("p")),
        F.struct(F.lit("ground_truth_vs_synthetic_data").alias("comparison"), F.col("observed").alias("t"), F.col("truth").alias("p")),
    )).alias("k")
    long = aligned.select(kinds).select("k.comparison", F.col("k.t").alias("truth"), F.col("k.p").alias("pred"))
    return classification_metrics(long, ["comparison"])


def correct_edges(learned: DataFrame, truth: DataFrame) -> DataFrame:
    return learned.select("parent", "child").intersect(truth.select("parent", "child"))


def reversed_edges(learned: DataFrame, truth: DataFrame) -> DataFrame:
    keys = ["parent", "child"]
    turned = truth.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    return learned.select(*keys).distinct().join(truth, keys, "left_anti").join(turned, keys, "left_semi")


def unmatched_edges(edges: DataFrame, other: DataFrame) -> DataFrame:
    """Edges whose node pair has no edge in ``other`` in either direction."""
    pair = [F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b")]
    keyed = edges.select("parent", "child", *pair).distinct()
    return keyed.join(other.select(*pair), ["a", "b"], "left_anti").select("parent", "child")


def structure_report(learned: DataFrame, learned_nodes: DataFrame, truth: DataFrame,
                     truth_nodes: DataFrame) -> DataFrame:
    """One row with fourteen fields comparing a learned graph with the true one."""
    nodes = union_nodes(learned_nodes, truth_nodes)
    confusion = relation_counts(truth, learned, nodes)
    keys = ["parent", "child"]

    def tall(df: DataFrame, names: Sequence[str]) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
        return df.select(F.explode(entries).alias("e")).select("e.name", "e.value")

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("name"), "value")

    differing = F.sum(F.when(F.col("truth") != F.col("pred"), F.col("n")).otherwise(0))
    counts = {
        "num_correct_edges": correct_edges(learned, truth),
        "num_reversed_edges": reversed_edges(learned, truth),
        "num_incorrect_edges": unmatched_edges(learned, truth),
        "num_missing_edges": unmatched_edges(truth, learned),
        "num_gt_edges": truth.select(*keys).distinct(),
        "num_learned_edges": learned.select(*keys).distinct(),
        "num_nodes": nodes,
    }
    rows = tall(macro_scores(confusion), ["precision_macro", "recall_macro", "f1_macro"]).union(
        tall(confusion.agg(F.sum("n").alias("num_pairs"), differing.alias("differ")), ["num_pairs", "differ"])
    )
    for name, df in counts.items():
        rows = rows.union(size(df, name))

    def value(name: str) -> Column:
        number = F.max(F.when(F.col("name") == name, F.col("value")))
        return (number.cast("bigint") if name.startswith("num_") else number).alias(name)

    fields = ["precision_macro", "recall_macro", "f1_macro", "num_pairs", "differ", *counts]
    row = rows.agg(*[value(n) for n in fields])
    zero = F.lit(0.0)
    hits = F.col("num_correct_edges")
    row = row.withColumn(
        "directed_edge_precision", F.coalesce(F.try_divide(hits, F.col("num_learned_edges")), zero)
    ).withColumn("directed_edge_recall", F.coalesce(F.try_divide(hits, F.col("num_gt_edges")), zero))
    p, r = F.col("directed_edge_precision"), F.col("directed_edge_recall")
    return row.select(
        F.coalesce(F.try_divide(F.col("differ"), F.col("num_pairs")), zero).alias("normalized_hamming_distance"),
        F.col("f1_macro").alias("causality_f1_macro"),
        F.col("precision_macro").alias("causality_precision_macro"),
        F.col("recall_macro").alias("causality_recall_macro"),
        p, r, F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("directed_edge_f1"),
        "num_incorrect_edges", "num_missing_edges", "num_reversed_edges", "num_gt_edges",
        "num_learned_edges", "num_nodes", "num_pairs",
    )


def t_table(counts: DataFrame) -> DataFrame:
    """(n_trials, t95) per distinct count: two-sided 95 % quantiles with n - 1 degrees of freedom."""
    def quantiles(batches):
        for pdf in batches:
            yield pdf.assign(t95=[t_quantile(int(n) - 1) for n in pdf["n_trials"]])

    distinct = counts.select("n_trials").where(F.col("n_trials") > 1).distinct()
    return distinct.mapInPandas(quantiles, "n_trials bigint, t95 double")


def across_trials(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys.., path, mean, std, ci_95_low, ci_95_high, n_trials, values) per numeric leaf.

    ``metrics`` is (keys.., path, trial, value). A single trial has no spread.
    """
    stats = metrics.where(F.col("value").isNotNull()).groupBy(*keys, "path").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.count("value").alias("n_trials"),
        F.array_sort(F.collect_list(F.struct("trial", "value"))).alias("by_trial"),
    )
    joined = stats.join(t_table(stats), "n_trials", "left")
    std = F.when(F.col("n_trials") > 1, F.col("sd")).otherwise(0.0)
    margin = F.when(
        F.col("n_trials") > 1, F.col("t95") * F.col("sd") / F.sqrt("n_trials")
    ).otherwise(0.0)
    return joined.select(
        *keys, "path", "mean", std.alias("std"), (F.col("mean") - margin).alias("ci_95_low"),
        (F.col("mean") + margin).alias("ci_95_high"), "n_trials",
        F.transform("by_trial", lambda s: s["value"]).alias("values"),
    )
