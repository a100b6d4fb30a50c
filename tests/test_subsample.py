"""Preparation of the table that samples are drawn from."""

from causeway import session
from causeway.config import SubsampleConfig
from causeway.plans import subsample


def test_text_is_written_once_before_sampling(spark):
    df = spark.createDataFrame([(i, f"a{i % 3}", None if i % 7 == 2 else "b", f"c{i % 2}") for i in range(900)], "row_id long, a string, b string, c string")
    joined = df.join(spark.createDataFrame([("c0", "d"), ("c1", "e")], "c string, more string"), "c")
    before = len(session._WRITTEN)
    prepared = subsample.prepare(joined, "row_id", SubsampleConfig(num_samples=2, num_rows_per_sample=10, num_columns_per_sample=2, max_parents=2))
    assert len(session._WRITTEN) == before + 1 and prepared.total == 900
    codes = {r.row_id: r.cells for r in prepared.rows.collect()}
    states = {c: sorted({"" if r[c] is None else r[c] for r in joined.select(c).distinct().collect()}) for c in prepared.columns}
    for r in joined.collect():
        assert codes[r.row_id] == [states[c].index(r[c] or "") for c in prepared.columns]
