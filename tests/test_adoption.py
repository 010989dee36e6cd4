import pytest
from pyspark.errors import AnalysisException

from veinwork.plans.adoption import AdoptionState, NewViolations, UnknownRules


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    rules = lambda *names: spark.createDataFrame([(n, "AUTO") for n in names], "rule string, status string")
    names = lambda *names: spark.createDataFrame([(n,) for n in names], "rule string")
    broken = lambda *pairs: spark.createDataFrame(list(pairs), "rule string, exception string")
    state = AdoptionState(spark, f"file://{tmp_path}")
    assert state.read() is None and state.versions() == []
    with pytest.raises(UnknownRules):
        state.update(rules("a"), broken(), removed=names("b"))
    assert state.update(rules("a", "b"), broken(("a", "f1"), ("a", "f2"), ("a", "f2"), ("b", "f1"), ("z", "f"))) == 1
    first = state.read()
    assert rows(first[1]) == [("a", "f1"), ("a", "f2"), ("b", "f1")]
    # a rule outside the scan is carried, what is mended goes, a new rule is recorded
    assert state.update(rules("c"), broken(("a", "f2"), ("b", "f1"), ("c", "f9"))) == 2
    assert [rows(t) for t in state.read()] == [[("a", "AUTO"), ("b", "AUTO"), ("c", "AUTO")], [("a", "f2"), ("b", "f1"), ("c", "f9")]]
    # what was mended may not come back; nothing is written, but for a rule that is recorded anew
    with pytest.raises(NewViolations, match="1 new violations, such as f1 of a"):
        state.update(rules("a"), broken(("a", "f1"), ("a", "f2"), ("b", "f1")))
    assert state.versions() == [1, 2]
    assert state.update(rules("a"), broken(("a", "f1"), ("b", "f1")), removed=names("c"), baseline=names("a")) == 3
    assert [rows(t) for t in state.read()] == [[("a", "AUTO"), ("b", "AUTO")], [("a", "f1"), ("b", "f1")]]
    with pytest.raises(UnknownRules):
        state.update(rules("a"), broken(), removed=names("a"))
    # readers of an older version are undisturbed
    assert rows(first[1]) == [("a", "f1"), ("a", "f2"), ("b", "f1")] and rows(state.read(1)[0]) == [("a", "AUTO"), ("b", "AUTO")]
    assert state.update(rules("d"), broken(("d", "f")), reset=True) == 4
    assert [rows(t) for t in state.read()] == [[("d", "AUTO")], [("d", "f")]]


def test_a_run_that_dies_leaves_the_old_state(spark, tmp_path):
    state = AdoptionState(spark, f"file://{tmp_path}")
    rules = spark.createDataFrame([("a",)], "rule string")
    state.update(rules, spark.createDataFrame([("a", "f")], "rule string, exception string"))
    rules.write.parquet(f"file://{tmp_path}/v00000002/dead/rules")
    assert state.versions() == [1] and rows(state.read()[1]) == [("a", "f")]
    assert state.update(rules, spark.createDataFrame([], "rule string, exception string")) == 2
    assert rows(state.read()[0]) == [("a",)] and rows(state.read()[1]) == []


def test_one_of_two_runs_for_a_version_wins(spark, tmp_path, monkeypatch):
    state = AdoptionState(spark, f"file://{tmp_path}")
    rules = spark.createDataFrame([("a",)], "rule string")
    state.update(rules, spark.createDataFrame([("a", "f")], "rule string, exception string"))
    monkeypatch.setattr(AdoptionState, "versions", lambda self: [])
    with pytest.raises(AnalysisException):
        state.update(rules.limit(0), spark.createDataFrame([], "rule string, exception string"))
    monkeypatch.undo()
    assert state.versions() == [1] and rows(state.read()[1]) == [("a", "f")]
