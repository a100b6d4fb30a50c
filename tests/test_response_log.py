"""The bucketed response log: latest rows, constant plans, pruned look-ups, compaction."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from causeway.operators import advice
from causeway.sources.response_log import ResponseLog


def answers(spark, rows):
    return spark.createDataFrame([(k, c, t, None) for k, c, t in rows], advice.ANSWER)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_appends_lookups_and_compaction(spark, tmp_path):
    log = ResponseLog(spark, str(tmp_path / "log"), buckets=4)
    asked = spark.createDataFrame([("a",), ("a",), ("zz",), (None,)], "key string")
    assert log.lookup(asked).collect() == [] and log.latest().collect() == [] and log.compact() == []
    log.append(answers(spark, []), 0)
    sizes = set()
    for seq in range(1, 8):
        log.append(answers(spark, [("a", f"a{seq}", False), (f"k{seq}", "x", None), ("b", "cut", True), (None, "n", False)]), seq)
        sizes.add(scans(log.lookup(asked)))
    assert sizes == {1}
    assert [tuple(r) for r in log.lookup(asked).collect()] == [("a", "a7", None, 7)]
    before = sorted(map(tuple, log.latest().collect()))
    assert {k for k, *_ in before} == {"a", *(f"k{i}" for i in range(1, 8))}
    parts = log.parts()
    full = log.compact(max_parts=2)
    assert full == sorted(b for b, n in parts.items() if n > 2) and full
    assert all(log.parts()[b] == (1 if b in full else n) for b, n in parts.items())
    assert sorted(map(tuple, log.latest().collect())) == before
    log.append(answers(spark, [("a", "a0", False)]), 3)  # an earlier number loses
    assert [r.content for r in log.lookup(asked).collect()] == ["a7"]


def test_lookup_reads_only_its_buckets(spark, tmp_path):
    log = ResponseLog(spark, str(tmp_path / "log"), buckets=16)
    log.append(answers(spark, [(f"k{i}", "x", False) for i in range(200)]), 1)
    asked = spark.createDataFrame([("k5",), ("k77",)], "key string")
    files = log.lookup(asked).inputFiles()
    assert len(log.parts()) == 16 and 1 <= len({f.rsplit("/", 2)[1] for f in files}) <= 2
    assert log.lookup(asked).count() == 2


def test_compaction_stopped_before_it_deletes(spark, tmp_path):
    log = ResponseLog(spark, str(tmp_path / "log"), buckets=2)
    for seq in (1, 2):
        log.append(answers(spark, [("a", f"a{seq}", False), ("b", f"b{seq}", False)]), seq)
    log._write(log.latest())  # what compact writes before it deletes
    assert sorted((r.key, r.content) for r in log.latest().collect()) == [("a", "a2"), ("b", "b2")]


def test_a_log_needs_a_bucket(spark, tmp_path):
    with pytest.raises(ValueError):
        ResponseLog(spark, str(tmp_path), buckets=0)


ROWS = st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["x", "y", "é"]), st.booleans()), max_size=4)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches=st.lists(st.tuples(st.integers(0, 5), ROWS), min_size=1, max_size=3), when=st.integers(0, 2))
def test_equals_a_dictionary(spark, tmp_path_factory, batches, when):
    log = ResponseLog(spark, str(tmp_path_factory.mktemp("log") / "log"), buckets=3)
    want = {}
    for k, (seq, rows) in enumerate(batches):
        log.append(answers(spark, rows), seq)
        for key, content, cut in rows:
            if not cut:
                want[key] = max(want.get(key, (-1, "")), (seq, content))
        if k == when:
            log.compact(max_parts=1)
    assert {r.key: (r.seq, r.content) for r in log.latest().collect()} == want
