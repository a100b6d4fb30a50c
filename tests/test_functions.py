import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway import config
from causeway.functions import mathx, text


def test_lgamma_matches_the_library(spark):
    xs = [1e-6, 0.01, 0.5, 1.0, 2.5, 10.0, 1234.5, 1e9]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", mathx.lgamma(F.col("x")).alias("y"))
    for row in df.collect():
        want = math.lgamma(row["x"])
        assert abs(row["y"] - want) <= 1e-11 * max(1, abs(want))
    assert np.allclose(mathx.lgamma_np(np.array(xs)), [math.lgamma(x) for x in xs], rtol=1e-12, atol=1e-11)


@pytest.mark.parametrize("stat,dof,p", [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.0, 3, 1.0), (5.0, 0, 1.0)])
def test_chi2_tail(stat, dof, p):
    assert mathx.chi2_tail(stat, dof) == pytest.approx(p, abs=1e-12)


@pytest.mark.parametrize("dof,t", [(1, 12.706204736), (4, 2.776445105), (30, 2.042272456), (1000, 1.962339081)])
def test_t_quantile(dof, t):
    assert mathx.t_quantile(dof) == pytest.approx(t, abs=1e-6)


def one(spark, content, expr):
    return spark.createDataFrame([(content,)], "c string").select(expr(F.col("c")).alias("v")).first()["v"]


@pytest.mark.parametrize("content,want", [
    ('Sure: ["a", \'b c\'] and ["d"]', ["a", "b c"]), ("[]", []), ("no list", None), ("[a", None),
])
def test_names(spark, content, want):
    assert one(spark, content, text.parse_names) == want


def test_other_parsers(spark):
    assert one(spark, "take [1, 20]", text.parse_ints) == [1, 20]
    assert [tuple(t) for t in one(spark, "[('a', \"b\"),\n('c','d')]", text.parse_tuples)] == [("a", "b"), ("c", "d")]
    assert one(spark, "[]", text.parse_tuples) == []
    assert tuple(one(spark, "\nadd_edge('a', b)", text.parse_edit)) == ("add", "a", "b")
    assert one(spark, "terminate() now", text.parse_edit)["action"] == "terminate"
    assert one(spark, "I would add_edge(a, b)", text.parse_edit) is None
    assert one(spark, "about -0.7 or 3", text.parse_number) == -0.7
    assert one(spark, "none", text.parse_number) is None
    assert one(spark, '```json\n{"KEEP": 40, "FLIP": 40, "REMOVE": 20}\n```', text.parse_verdict) == "KEEP"
    assert one(spark, '{"KEEP": 40, "FLIP": 60}', text.parse_verdict) is None
    assert one(spark, "not json", text.parse_verdict) is None
    assert one(spark, " \n the answer is 0.\n1", text.parse_bit) == 0
    assert one(spark, "10", text.parse_bit) is None
    assert one(spark, "x <Answer> a, b c ,, </Answer>", text.parse_tagged) == ["a", "b c"]
    assert one(spark, "<Answer> a", text.parse_tagged) is None
    cycle = F.array(F.lit("a"), F.lit("b"))
    edit = one(spark, "Remove: x and y\nreverse : a and b", lambda c: text.parse_cycle_edit(c, cycle))
    assert tuple(edit) == ("Reverse", "a", "b")
    nested = one(spark, '```json\n{"bn": {"nodes": [{"node_name": "b", "parents": ["a"]}]}}\n```', text.parse_network)
    assert [(n["node_name"], n["parents"]) for n in nested] == [("b", ["a"])]
    plain = one(spark, '{"nodes": [{"node_name": "b", "parents": null}]}', text.parse_network)
    assert [(n["node_name"], n["parents"]) for n in plain] == [("b", None)]


def test_configuration_ranges():
    ok = {"num_samples": 1, "num_rows_per_sample": 1, "num_columns_per_sample": 1, "max_parents": 1}
    config.SubsampleConfig(**ok)
    for bad in ({"num_samples": 0}, {"frequency_cutoff": 1.5}, {"rank_by": "x"}, {"backend": "x"}):
        with pytest.raises(ValueError):
            config.SubsampleConfig(**{**ok, **bad})
    for bad in ({"alpha": 0.0}, {"borderline": -1}, {"max_iterations": 0}):
        with pytest.raises(ValueError):
            config.ConstraintConfig(**bad)
    with pytest.raises(ValueError):
        config.AdvisedConfig(**ok, entropy_threshold=2)


def test_scores_registry():
    with pytest.raises(ValueError):
        config.SearchSettings(score="cv_general")
    with pytest.raises(ValueError):
        config.SearchSettings(score="bdeu", algorithm="dges")
    with pytest.raises(ValueError):
        config.score_spec("nonsense")
    assert config.score_spec(None)[0] == "bdeu"
    assert config.score_parameters("bic", {"x": 1}, 2.0) == {"lambda_value": 2.0, "x": 1}
    assert config.score_parameters("bdeu", None, 2.0) == {}


def test_scratch_removes_its_tables(spark):
    import os

    from causeway.session import durable, scratch, shared_dir

    kept = durable(spark.range(3))
    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    with scratch(spark):
        assert durable(durable(spark.range(5)).filter("id > 1")).count() == 3
    assert set(os.listdir(shared_dir(spark).removeprefix("file://"))) == before
    assert kept.count() == 3


def test_row_ids_over_folders(spark, tmp_path):
    from causeway.sources.tables import read_keyed, read_keyed_csv

    for day in (1, 2):
        spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/t/day={day}")
        source = next((tmp_path / "t" / f"day={day}").glob("part-*.parquet"))
        source.rename(source.with_name("part-0.parquet"))
    rows = read_keyed(spark, f"{tmp_path}/t", ["id"]).collect()
    assert len(rows) == 20 and len({r.row_id for r in rows}) == 20
    spark.range(7).write.option("header", True).csv(f"{tmp_path}/c")
    assert len({r.row_id for r in read_keyed_csv(spark, f"{tmp_path}/c").collect()}) == 7


def test_moments_ignore_missing_values_pairwise(spark):
    import numpy as np
    import pandas as pd

    from causeway.operators import counts

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 40)) + rng.normal(size=(300, 1)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(40)]
    pdf = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in names)).repartition(4)
    for got, want, col in ((counts.covariance(df, names), pdf.cov(), "cov"), (counts.correlation(df, names), pdf.corr(), "corr")):
        for r in got.collect():
            assert abs(r[col] - want.loc[r.a, r.b]) < 1e-6
