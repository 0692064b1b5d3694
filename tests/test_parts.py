"""Predicates, normalization, checksums, segments, patterns, repair, outputs, configuration, command line and streaming."""

import io
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritas import cli, config
from paritas.functions import checksum, normalize, types
from paritas.functions.predicates import checked_filter, key_range, literal, quoted, time_window
from paritas.operators import analyze, diff, repair, segments
from paritas.plans.planner import compare
from paritas.sinks import writers
from paritas.sinks.interpolate import Output, column_names
from paritas.sources import readers
from paritas.spec import Comparison, Resource, Side, Strategy
from paritas.streaming.incremental import watch


@pytest.mark.parametrize("text", ["a > 1 AND b IN ('x', 'y;')" [:20], "a IS NOT NULL OR b LIKE 'x%'", "(a + 1) * 2 >= 3", "NOT (a = 'it''s')", "a BETWEEN 1 AND 2"])
def test_filters_that_are_allowed(text):
    if text.count("(") == text.count(")") and text.count("'") % 2 == 0:
        assert checked_filter(text) == text


@pytest.mark.parametrize("text", ["", "a = 1; DROP TABLE x", "a = 1 -- x", "a IN (SELECT 1)", "sleep(5) = 0", "a = 1 /* */", "(a = 1", "a = \\", "a = 1 UNION b", "a = 1 LIMIT 2", "a = 1 OFFSET 2", "WITH x"])
def test_filters_that_are_not(text):
    with pytest.raises(ValueError):
        checked_filter(text)


def test_ranges_hold_each_row_once(spark):
    df = spark.createDataFrame([(a, b) for a in range(6) for b in range(5)], "a int, b int")
    for cuts in ([(2, 3)], [(0, 0), (1, 4), (4, 1)], [(9, 9)]):
        assert sum(df.where(p).count() for p in segments.ranges(["a", "b"], cuts)) == 30
    assert df.where(key_range(["a", "b"], (1, 2), (3, 0), inclusive=True)).count() == 9
    assert segments.range_boundaries(0, 9, 3) == [3, 6]
    assert segments.estimated_size([0, 0], [9, 4]) == 50
    with pytest.raises(ValueError):
        key_range(["a", "b"], (1,), None)
    with pytest.raises(ValueError):
        time_window("a", datetime(2020, 1, 2), datetime(2020, 1, 1))


def test_literals_and_quotes():
    assert [literal(x) for x in (None, True, 3, "it's", datetime(2020, 1, 2))] == ["NULL", "TRUE", "3", "'it''s'", "TIMESTAMP '2020-01-02 00:00:00'"]
    assert quoted("a`b") == "`a``b`" and quoted("a", "postgresql") == '"a"' and quoted("a]", "sqlserver") == "[a]]]"


def one(spark, value, dtype, rules=None, strict=False):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", dtype)]))
    return df.select(normalize.normalize(F.col("v"), dtype, rules, strict)).first()[0]


def test_normalize(spark):
    from decimal import Decimal

    rule = normalize.Rule
    assert one(spark, "  x ", T.StringType()) == "x"
    assert one(spark, -2.5, T.DoubleType()) == "-2.5000" and one(spark, None, T.DoubleType()) == "0.0000"
    assert one(spark, Decimal("-1.29"), T.DecimalType(5, 2), {"decimal": rule(precision=1, rounding="truncate")}) == "-1.2"
    assert one(spark, Decimal("1.25"), T.DecimalType(5, 2), {"decimal": rule(precision=1)}) == "1.3"
    assert one(spark, Decimal("1.6"), T.DecimalType(5, 2), {"decimal": rule(precision=0, rounding="truncate")}) == "1"
    assert one(spark, 0.5, T.FloatType()) == "0.500000"
    assert [one(spark, x, T.DoubleType()) for x in (float("nan"), float("-inf"), 1e36, -1e300)] == ["NaN", "-Infinity", "1.0E36", "-1.0E300"]
    assert one(spark, 1e30, T.DoubleType(), {"double": rule(rounding="truncate")}) == "1.0E30" and one(spark, -1.29999, T.DoubleType(), {"double": rule(rounding="truncate", precision=10)}) == "-1.2999900000"
    assert one(spark, Decimal("1" * 38), T.DecimalType(38, 0)) == "1" * 38
    assert one(spark, None, T.BooleanType()) == "0" and one(spark, True, T.BooleanType()) == "1"
    assert one(spark, None, T.StringType(), strict=True) is None
    assert one(spark, {"b": 1, "a": 2}, T.MapType(T.StringType(), T.IntegerType())) == '{"a":2,"b":1}'
    assert one(spark, datetime(2020, 1, 2, 3, 4, 5, 678000), T.TimestampNTZType(), {"datetime": rule(comparison="TRUNCATE_TO_SECOND")}) == "2020-01-02 03:04:05"
    assert one(spark, bytearray(b"\xab"), T.BinaryType(), {"binary": rule(uppercase=False)}) == "ab"
    assert normalize.rules_of([{"match": {"type": "numeric"}, "operation": "format_number", "params": {"precision": 2}}])["decimal"].precision == 2
    for bad in ({"match": {"type": "int"}, "operation": "nothing"}, {"match": {"path": "a"}, "operation": "encode"}, {"match": {"type": "decimal"}, "operation": "format_number", "params": {"precision": 11}}, {"match": {"type": "decimal"}, "operation": "format_number", "params": {"scale": 1}}):
        with pytest.raises(ValueError):
            normalize.rules_of([bad])
    assert normalize.compatible(T.IntegerType(), T.DecimalType(3, 1)) and not normalize.compatible(T.IntegerType(), T.StringType())


def test_checksums(spark):
    df = spark.range(100).select(F.md5(F.col("id").cast("string")).alias("h"), F.col("id").cast("string").alias("k"))
    shuffled = df.orderBy(F.rand(1)).repartition(7)
    for a in (checksum.xor_checksum(F.col("h")), checksum.concat_checksum(F.col("k"), F.col("h")), checksum.sum_checksum(F.col("h"))):
        assert df.agg(a).first() == shuffled.agg(a).first()
    twice = df.unionByName(df)
    assert twice.agg(checksum.xor_checksum(F.col("h"))).first()[0] == "0" * 16
    assert twice.agg(checksum.sum_checksum(F.col("h"))).first()[0] > 0


def test_buckets_see_pairs_of_equal_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    assert diff.checksum_diff(a, b, ["k"], ["v"], buckets=1).count() == 2


def differing(spark):
    s = spark.createDataFrame([(1, "é trunc", 1.0, "2020"), (2, None, 2.0, "2021"), (3, "c", 3.25, "x"), (4, "it's", 4.0, "y")], "id int, name string, price double, created_at string")
    t = spark.createDataFrame([(1, "é", 1.0, "2020"), (2, "b", 2.0, "2022"), (3, "c", 3.0, "x"), (5, "e", 5.0, "z")], "id int, name string, price double, created_at string")
    return diff.join_diff(s, t, ["id"], ["name", "price", "created_at"]), s, t


def test_patterns(spark):
    found, *_ = differing(spark)
    rows = {r.pattern: r for r in analyze.analyze(found, ["name", "price", "created_at"]).collect()}
    assert rows["ENCODING_ISSUE"].affected_rows == 1 and rows["TRUNCATION"].affected_columns == "name"
    assert rows["PRECISION_LOSS"].affected_rows == 1 and rows["PRECISION_LOSS"].affected_columns == "price"
    assert rows["NULL_HANDLING"].affected_rows == 1 and rows["TIME_DRIFT"].affected_rows == 3 and rows["TIME_WINDOW"].affected_rows == 1
    told = analyze.summary(analyze.analyze(found, ["name", "price", "created_at"]), found.count())
    assert 0.5 < told["confidence"] < 0.9 and len(told["hints"]) == 6 and "5 differences" in told["summary"]
    assert analyze.summary(analyze.analyze(found.limit(0), ["name"]), 0)["confidence"] == 1.0


def test_repair(spark):
    found, *_ = differing(spark)
    text = {r.id: r.statement for r in repair.repair_sql(found, ["id"], ["name", "price", "created_at"], "db.t").collect()}
    assert text[4] == "INSERT INTO db.t (`id`, `name`, `price`, `created_at`) VALUES (4, 'it''s', 4.0, 'y')"
    assert text[5] == "DELETE FROM db.t WHERE `id` = 5"
    assert text[2] == "UPDATE db.t SET `name` = NULL, `created_at` = '2021' WHERE `id` = 2"
    odd = spark.createDataFrame([(1, "a\\' OR 1=1 -- \\", float("nan")), (2, "\\", float("-inf"))], "id int, v string, x double")
    fixes = {r.id: r.statement for r in repair.repair_sql(diff.join_diff(odd, odd.limit(0), ["id"], ["v", "x"]), ["id"], ["v", "x"], "t").collect()}
    for r in odd.collect():  # what Spark reads back from the statement is the value
        assert str(spark.sql("SELECT * FROM VALUES " + fixes[r.id].split("VALUES ")[1]).first()[:]) == str(tuple(r))
    ansi = {r.id: r.statement for r in repair.repair_sql(diff.join_diff(odd, odd.limit(0), ["id"], ["v", "x"]), ["id"], ["v", "x"], "t", dialect="postgresql").collect()}
    assert "'\\'" in ansi[2] and "'a\\'' OR" in ansi[1]
    back = {r.id: r.statement for r in repair.repair_sql(found, ["id"], ["name", "price", "created_at"], "s", "source", {"id": "key"}, "postgresql").collect()}
    assert back[4] == 'DELETE FROM s WHERE "key" = 4' and back[5].startswith('INSERT INTO s ("key", "name"')


def result(spark):
    _, s, t = differing(spark)
    side = lambda df: Side(Resource("frame", frame=df), keys=("id",))
    return compare(spark, Comparison(side(s), side(t), Strategy("join")))


def test_sinks(spark, tmp_path):
    got, task = result(spark), writers.Task("run7", "a", "b")
    out = io.StringIO()
    writers.ConsoleDifferences(max_rows=2, pretty=False, to=out).result(task, got)
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["event"] for x in lines] == ["diff", "diff", "truncated"] and lines[0]["primary_key"] == ["1"]
    out = io.StringIO()
    writers.ConsoleResult(to=out).result(task, got)
    assert json.loads(out.getvalue())["statistics"]["total_differences"] == 5
    made = [
        writers.make("json:diff-record", path=f"{tmp_path}/d-${{taskId}}"),
        writers.make("json:diff-record", path=f"{tmp_path}/m", outputs=(Output("operation", "${operation}!"), Output("run", "${taskId}")), merge=True),
        writers.make("json:diff-record", path=f"{tmp_path}/a.json", array=True),
        writers.make("json:result", path=f"{tmp_path}/r.json", outputs=(Output("status", "${status}"), Output("all", "${statistics_json}"))),
        writers.make("csv:diff-record", path=f"{tmp_path}/c"),
        writers.make("csv:result", path=f"{tmp_path}/cr"),
    ]
    writers.publish(made, task, lambda: got)
    assert spark.read.json(f"{tmp_path}/d-run7").count() == 5
    merged = spark.read.json(f"{tmp_path}/m")
    assert {"run", "primary_key", "operation"} <= set(merged.columns) and merged.where("operation = 'mismatch!'").count() == 3
    assert len(json.load(open(f"{tmp_path}/a.json"))) == 5
    assert json.loads(json.load(open(f"{tmp_path}/r.json"))["all"])["mismatchCount"] == 3
    csv = spark.read.csv(f"{tmp_path}/c", header=True, escape='"')
    assert csv.columns == ["operation", "primaryKey", "sourceValues", "targetValues"] and csv.where("operation = 'MISMATCH'").count() == 3
    assert spark.read.csv(f"{tmp_path}/cr", header=True).first().totalDifferences == "5"


def test_table_sinks(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS sinks LOCATION '{tmp_path}/sinks.db'")
    try:
        made = [writers.make("table:diff-record", table="sinks.d"), writers.make("table:diff-record", table="sinks.typed", outputs=(Output("key", "${primaryKey}", "int"), Output("new price", "${tgt.price}", "double"))), writers.make("table:result", table="sinks.r")]
        writers.publish(made, writers.Task("run1"), lambda: result(spark))
        assert spark.table("sinks.d").columns[:4] == ["nl_dq_execution_id", "nl_dq_diff_type", "nl_dq_diff_columns1", "nl_dq_diff_columns2"]
        assert dict(spark.table("sinks.typed").dtypes) == {"key": "int", "new_price": "double"}
        with pytest.raises(RuntimeError):
            writers.publish(made, writers.Task("run2"), lambda: (_ for _ in ()).throw(RuntimeError("no")))
        assert {(r.nl_dq_execution_id, r.run_status) for r in spark.table("sinks.r").collect()} == {("run1", "DIFF"), ("run2", "ERROR")}
    finally:
        spark.sql("DROP DATABASE sinks CASCADE")


def test_jdbc(spark, tmp_path):
    """A database behind JDBC, here the one that Spark brings along: written, read in parts and by a query, and compared."""
    url = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "id int, name string")
    for name, df in (("a", rows), ("b", rows.where("id <> 4").withColumn("name", F.when(F.col("id") == 7, "x").otherwise(F.col("name"))))):
        df.write.format("jdbc").options(**url, dbtable=name).save()
    parts = url | {"partitionColumn": "id", "lowerBound": "0", "upperBound": "20", "numPartitions": "3"}
    source = readers.read(spark, Resource("jdbc", "a", parts))
    assert source.rdd.getNumPartitions() == 3 and source.count() == 20
    side = lambda path, more=url: Side(Resource("jdbc", path, more), keys=("id",), columns=("name",))
    got = compare(spark, Comparison(side("a", parts), side("SELECT * FROM b"), Strategy()))
    assert sorted((r.operation, r.id) for r in got.diff.collect()) == [("mismatch", "7"), ("target_missing", "4")]
    writers.make("table:diff-record", table="kept", options=url).result(writers.Task("run1"), got)
    assert readers.read(spark, Resource("jdbc", "kept", url)).count() == 2


def test_sinks_are_opened_and_closed(spark):
    said = []

    class Told:
        open = lambda self, task: said.append("open")
        close = lambda self, task: said.append("close")
        segments = lambda self, task, trace: said.append([r.decision for r in trace.collect()])
        result = lambda self, task, result: said.append("result")
        error = lambda self, task, error: said.append("error")

    writers.publish([Told()], writers.Task("run1"), lambda: result(spark))
    assert said == ["open", ["compare"], "result", "close"]
    said.clear()
    with pytest.raises(RuntimeError):
        writers.publish([Told()], writers.Task("run1"), lambda: (_ for _ in ()).throw(RuntimeError("no")))
    assert said == ["open", "error", "close"]


def test_sink_names():
    assert column_names(["a b", "c"]) == ["a_b", "c"]
    for bad in (lambda: column_names(["a b", "A_b"]), lambda: writers.make("xml:result"), lambda: writers.register("csv:result", writers.CsvResult)):
        with pytest.raises(ValueError):
            bad()


def test_readers(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/p")
    assert readers.schema(spark, Resource("parquet", f"{tmp_path}/p")).names == ["id"]
    assert readers.read(spark, Resource("sql", f"SELECT id * 2 AS x FROM parquet.`{tmp_path}/p`")).count() == 5
    options = readers.jdbc_options("mysql", Resource("mysql", "SELECT 1", {"url": "jdbc:mysql://x"}))
    assert options["query"] == "SELECT 1" and options["driver"].endswith("Driver")
    with pytest.raises(ValueError, match="lowerBound"):
        readers.jdbc_options("jdbc", Resource("jdbc", "t", {"partitionColumn": "id"}))
    with pytest.raises(ValueError, match="no reader"):
        readers.read(spark, Resource("carrier-pigeon"))
    side = Side(Resource("table", "t", partition_columns=("dt",)), keys=("id",), filter="name = 'dt'")
    with pytest.raises(ValueError, match="dt"):
        readers.require_partition_filter(side)
    assert not readers.table_facts(spark, "no_such_table").exists


def test_catalog_facts(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS facts LOCATION '{tmp_path}/facts.db'")
    try:
        spark.sql("CREATE TABLE facts.t (id INT, v STRING, day DATE) USING parquet PARTITIONED BY (day)")
        spark.sql("CREATE VIEW facts.w AS SELECT id FROM facts.t")
        facts = readers.table_facts(spark, "facts.t")
        assert facts.exists and facts.columns[0] == ("id", "int", True) and facts.partition_columns == ("day",) and facts.details
        readers.analyze_table(spark, "facts.t", ("id",))
        assert "facts" in readers.databases(spark)
        assert readers.relations(spark, "facts") == ["t", "w"] and readers.relations(spark, "facts", views=True) == ["w"] and readers.relations(spark, "facts", views=False) == ["t"]
    finally:
        spark.sql("DROP DATABASE facts CASCADE")
    assert "table_name = 'o''k'" in readers.information_sql("primary_key", "s", "o'k")
    with pytest.raises(ValueError, match="no metadata"):
        readers.information_sql("weather")


@pytest.mark.parametrize("threshold", [0, 3, 100])
def test_bisection_visits_what_differs(spark, threshold):
    s = spark.createDataFrame([(i, "a") for i in range(60)], "k int, v string")
    t = s.where("k <> 11").withColumn("v", F.when(F.col("k") == 30, "b").otherwise(F.col("v")))
    s, t = (diff.normalized(x, ["k", "v"]) for x in (s, t))
    nodes = diff.bisection(s, t, ["k"], ["v"], 3, 3, threshold).collect()
    # Brute force: descend from the whole, a segment's children at a time.
    rows = [{r.k: (r.k, r.v) for r in x.collect()} for x in (s, t)]
    leaf = {k: r for k, r in s.select("k", checksum.bucket([F.col("k")], 27).alias("b")).collect()}
    want, todo = [], [(0, 0)]
    while todo:
        level, at = todo.pop()
        a, b = ({k: v for k, v in x.items() if leaf[k] // 3 ** (3 - level) == at} for x in rows)
        if not a and not b:
            continue
        decision = "skip_equal" if a == b else "compare" if level == 3 or max(len(a), len(b)) <= threshold else "split"
        want.append((level, at, len(a), len(b), decision))
        todo += [(level + 1, at * 3 + i) for i in range(3)] if decision == "split" else []
    assert sorted(map(tuple, nodes)) == sorted(want)
    assert [r.decision for r in diff.bisection(s, s, ["k"], ["v"], 3, 3).collect()] == ["skip_equal"]
    assert diff.bisection(s.limit(0), s.limit(0), ["k"], ["v"]).count() == 0


def test_records_round_exact_values(spark):
    """As C does: ties to even, by the double and not by its shortest text."""
    fixed = [25000825.0, 0.5e-6, 1.0000005, 2.0000015, 0.125, 0.9999995, -0.03125, -1e-7, 9999999999.9999995, 8589934592.0000190735]
    far = [25000825000.0, 25000835000.0, 1.0000005e23, 9.9999995e300, -2.0000005e30, 1.2345675e-12, 9.9999995e-20]
    df = spark.createDataFrame([(x,) for x in fixed + far], "x double")
    got = {r.x: r.text for r in df.select("x", normalize.record(F.col("x"), T.DoubleType()).alias("text")).collect()}
    assert got == {x: f"{x:.6f}" for x in fixed} | {x: f"{x:.6e}" for x in far}
    tens = spark.createDataFrame([("0.03125",), ("99999999999999991611392",)], "x string")
    text = normalize.record(F.col("x").cast("decimal(30,5)"), T.DecimalType(30, 5))
    assert [r.text for r in tens.select(text.alias("text")).collect()] == ["0.0312", "99999999999999991611392.0000"]


def test_segment_strategies(spark):
    df = spark.createDataFrame([(i // 3, f"t{i:03d}") for i in range(100)] + [(None, None)], "k int, v string")
    pages = sorted(map(tuple, segments.walk(df, "k", 7).collect()))
    assert [p[1] for p in pages] == [7] * 14 + [2] and [p[2:] for p in pages] == [(i * 7 // 3, min(i * 7 + 6, 99) // 3) for i in range(15)]
    texts = sorted(map(tuple, segments.walk(df, "v", 30).collect()))
    assert [(p[2], p[3]) for p in texts] == [("t000", "t029"), ("t030", "t059"), ("t060", "t089"), ("t090", "t099")]
    assert segments.walk(df.limit(0), "k", 7).count() == 0
    assert (segments.choose(df, "k"), segments.choose(df, "v", "range"), segments.choose(df, "k", "row-sample")) == ("range", "row-sample", "row-sample")
    assert sum(r.row_count for r in segments.segmented(df, "v", 4).collect()) == 101
    assert segments.segmented(df.limit(0), "k", 4).count() == 0
    assert [segments.adaptive_factor(n, 8) for n in (10, 200_000, 2_000_000)] == [4, 8, 16]
    for bad in (lambda: segments.choose(df, "k", "dowsing"), lambda: segments.register("range", segments.depth_segments)):
        with pytest.raises(ValueError):
            bad()


def test_depth_segments_hold_exact_shares(spark):
    """Whatever the ranges by which keys are placed, and where a key repeats; nulls come last."""
    keys = sorted([i * i % 1013 for i in range(1000)] + [7] * 400) + [None] * 3
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(5)
    ends = [-(-i * len(keys) // 8) for i in range(9)]
    want = [(i, b - a, min(x), max(x)) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if (x := [k for k in keys[a:b] if k is not None])]
    for accuracy in (2, 10_000):
        assert sorted(map(tuple, segments.depth_segments(df, "k", 8, accuracy).collect())) == want
    assert segments.depth_segments(df.limit(0), "k", 8).count() == 0


def test_walk_finds_ranges_by_halving(spark):
    df = spark.createDataFrame([(i * 7 % 2000,) for i in range(2000)], "k int")
    pages = segments.walk(df, "k", 100)
    assert sorted(map(tuple, pages.collect())) == [(i, 100, i * 100, i * 100 + 99) for i in range(20)]
    # A step for each bit of the ranges' number, not one for each range.
    assert "array(256, 128, 64, 32, 16, 8, 4, 2, 1)" in pages._jdf.queryExecution().analyzed().toString()


def test_config_and_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("PLACE", str(tmp_path))
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([(1, "a"), (2, "c")], "id int, v string").write.parquet(f"{tmp_path}/t")
    path = tmp_path / "c.json"
    made = config.template()
    made["source"]["resource"]["path"], made["target"]["resource"]["path"] = "${env.PLACE}/s", "${env.PLACE}/${env.NONE:t}"
    path.write_text(json.dumps(made))
    assert cli.run(["validate", "-c", str(path), "--connect"]) == 0
    assert json.loads(capsys.readouterr().out)["schemas"]["source"] == "struct<id:int,v:string>"
    assert cli.run(["diff", "-c", str(path), "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out) == {"source_rows": 2, "target_rows": 2}
    assert cli.run(["diff", "-c", str(path)]) == 1
    assert json.loads(capsys.readouterr().out)["statistics"]["mismatch_count"] == 1
    assert cli.run(["generate", "--advanced", "--format", "json"]) == 0
    advanced = config.filled(json.loads(capsys.readouterr().out))
    assert config.job(advanced).comparison.source.resource.kind == "postgresql"
    path.write_text(json.dumps({"source": {}}))
    assert cli.run(["validate", "-c", str(path)]) == 2
    assert "missing sections" in capsys.readouterr().err
    with pytest.raises(ValueError, match="environment"):
        config.filled("${env.SURELY_UNSET}")
    assert config.masked({"password": "x", "url": "jdbc:a?password=b&c=1", "list": [{"token": "t"}]}) == {"password": "******", "url": "jdbc:a?password=******&c=1", "list": [{"token": "******"}]}


def test_streaming(spark, tmp_path):
    s = spark.createDataFrame([(i, str(i)) for i in range(20)], "k int, v string")
    t = s.where("k <> 7").withColumn("v", F.when(F.col("k") == 3, "x").otherwise(F.col("v")))
    spark.createDataFrame([(3,), (7,), (8,), (3,)], "k int").write.parquet(f"{tmp_path}/in")
    changes = spark.readStream.schema("k int").parquet(f"{tmp_path}/in")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")
    watch(changes, lambda: s, lambda: t, ["k"], ["v"], write, f"{tmp_path}/cp", once=True).awaitTermination(60)
    assert sorted((r.operation, r.k) for r in spark.read.parquet(f"{tmp_path}/out/0").collect()) == [("mismatch", 3), ("target_missing", 7)]


def test_types_of_other_databases():
    for text, want in (("VARCHAR(20)", "string"), ("decimal(10,2)", "decimal(10,2)"), ("numeric", "decimal(38,18)"), ("bigint unsigned", "decimal(20,0)"), ("int(11) unsigned zerofill", "bigint"), ("tinyint(1)", "boolean"), ("TIMESTAMP(6) WITH TIME ZONE", "timestamp"), ("datetime", "timestamp_ntz"), ("integer[]", "array<int>"), ("geometry", "string"), ("double  precision", "double"), ("number(5)", "decimal(5,0)"), ("bytea", "binary"), ("character varying(3)", "string")):
        assert types.from_native(text).simpleString() == want, text
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("a b", T.DecimalType(5, 2)), T.StructField("m", T.MapType(T.StringType(), T.StringType()))])
    assert types.create_table("t", schema, "postgresql") == 'CREATE TABLE IF NOT EXISTS t ("id" BIGINT NOT NULL, "a b" NUMERIC(5,2), "m" TEXT)'
    assert types.to_native(T.TimestampNTZType(), "starrocks") == "DATETIME" and types.to_native(T.ByteType(), "nobody") == "SMALLINT"
