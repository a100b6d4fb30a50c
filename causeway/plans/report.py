"""Evaluation of a fitted model against questions, test rows and a known graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import inference, metrics, scores
from causeway.operators.encode import encode_table
from causeway.plans.model import Model


def truth_bdeu(test: DataFrame, nodes: list[str], edges: list[tuple[str, str]], ess: float = 1.0) -> DataFrame:
    """BDeu of the true graph on the test table; a node without a column gives no score at all."""
    spark = test.sparkSession
    if set(nodes) - set(test.columns):
        return spark.createDataFrame([], "score double")
    return scores.network_bdeu(encode_table(test, nodes), nodes, edges, ess)


def model_bdeu(model: Model, test: DataFrame, ess: float = 1.0) -> DataFrame:
    have = [n for n in model.nodes if n in test.columns]
    return scores.network_bdeu(encode_table(test, have), model.nodes, list(model.network.edges), ess)


def answers_of(model: Model, questions: DataFrame, propagated: bool = False, max_hops: int | None = 3,
               draws: int = 50) -> DataFrame:
    """(query_id, pred) of the questions (query_id, target_node, context, ..)."""
    asked = questions.select("query_id", F.col("target_node").alias("target"), "context")
    got = model.predict_propagated(asked, max_hops, draws) if propagated else model.predict(asked)
    return got.select("query_id", inference.map_state(F.col("dist")).alias("pred"))


def question_metrics(model: Model, questions: DataFrame, propagated: bool = False,
                     max_hops: int | None = 3, draws: int = 50) -> DataFrame:
    """One row per comparison (model/truth, model/data, truth/data)."""
    answers = answers_of(model, questions, propagated, max_hops, draws)
    return metrics.question_report(metrics.align_predictions(questions, answers))


def evaluate(model: Model, test: DataFrame, questions: DataFrame | None = None,
             truth: tuple[list[str], list[tuple[str, str]]] | None = None,
             propagated: bool = False) -> DataFrame:
    """(path, value) of everything that can be evaluated; skips what needs missing inputs."""
    from causeway.sources.documents import wide_to_metrics

    spark = test.sparkSession
    parts = [model_bdeu(model, test).select(F.lit("model_bdeu_score").alias("path"), F.col("score").alias("value"))]

    def classified(name: str, report: DataFrame) -> DataFrame:
        long = wide_to_metrics(report.drop("note"), name, ["comparison"])
        path = F.concat_ws(".", F.lit(name), "comparison", F.substring_index("path", ".", -1))
        return long.where(F.col("value").isNotNull()).select(path.alias("path"), "value")

    if questions is not None:
        count = questions.agg(F.count("*").cast("double").alias("value"))
        parts.append(count.select(F.lit("num_questions").alias("path"), "value"))
        if model.parameters_fitted:
            parts.append(count.select(F.lit("num_evaluated").alias("path"), "value"))
            parts.append(classified("classification_metrics", question_metrics(model, questions)))
            if propagated and model.supports_propagation:
                parts.append(classified("propagation_evaluations[0]", question_metrics(model, questions, True)))
    if truth is not None:
        nodes, edges = truth
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        report = metrics.structure_report(
            model.edges(spark), frame([(n,) for n in model.nodes], "node string"),
            frame(edges, "parent string, child string"), frame([(n,) for n in nodes], "node string"),
        )
        parts.append(wide_to_metrics(report.withColumn("k", F.lit(0)), "structural_metrics", ["k"]).select("path", "value"))
        gt = truth_bdeu(test, nodes, edges)
        parts.append(gt.select(F.lit("structural_metrics.gt_bdeu_score").alias("path"), F.col("score").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
