"""Every query of the consistency engine by name, with DuckDB SQL for the same rows.

The source is a table as it is; the target is a fixed rewrite of it with moved keys, changed values, nulls and lost rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paritas.functions import checksum, comparators
from paritas.functions import normalize as norm
from paritas.functions.predicates import after_key, all_null, differs, key_in, key_range, literal, time_window
from paritas.operators import analyze, diff, repair, segments, sets, stats
from paritas.plans.planner import compare
from paritas.sinks import writers
from paritas.sinks.interpolate import Output, diff_places, project, result_places
from paritas.sources.readers import prepare, restricted, schema
from paritas.spec import Comparison, Mapping, Resource, Side, Strategy, Value

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as a query under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- sides ----------------------------------------------------------------------------------------------------------

S_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"
T_SQL = """SELECT CASE WHEN o_orderkey % 101 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 89 = 0 THEN 'X' WHEN o_orderkey % 211 = 0 THEN NULL WHEN o_orderkey % 223 = 0 THEN o_orderstatus || ' ' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 83 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 227 = 0 THEN o_totalprice + 0.25 ELSE o_totalprice END AS o_totalprice, o_orderdate
  FROM orders WHERE o_orderkey % 97 <> 0"""
KEYS, COLUMNS = ["o_orderkey"], ["o_orderstatus", "o_totalprice"]
#: A full outer join of both sides in SQL, for the oracles.
J_SQL = f"""s AS ({S_SQL}), t AS ({T_SQL}), j AS (
  SELECT s.o_orderkey AS k1, t.o_orderkey AS k2, s.o_orderstatus AS a1, t.o_orderstatus AS a2, s.o_totalprice AS b1, t.o_totalprice AS b2
  FROM s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey)"""
OPERATION = "CASE WHEN k2 IS NULL THEN 'target_missing' WHEN k1 IS NULL THEN 'source_missing' ELSE 'mismatch' END"
CHANGED = "CASE WHEN k1 IS NOT NULL AND k2 IS NOT NULL THEN concat_ws(',', CASE WHEN a1 IS DISTINCT FROM a2 THEN 'o_orderstatus' END, CASE WHEN b1 IS DISTINCT FROM b2 THEN 'o_totalprice' END) ELSE '' END"
DIFFERS = "(k1 IS NULL OR k2 IS NULL OR a1 IS DISTINCT FROM a2 OR b1 IS DISTINCT FROM b2)"
D_SQL = f"""{J_SQL}, d AS (SELECT {OPERATION} AS operation, coalesce(k1, k2) AS o_orderkey, a1 AS o_orderstatus_1, a2 AS o_orderstatus_2,
  b1 AS o_totalprice_1, b2 AS o_totalprice_2, {CHANGED} AS changed FROM j WHERE {DIFFERS})"""


def source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def target(spark: SparkSession, d: str) -> DataFrame:
    k, st, price = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice")
    return (
        table(spark, d, "orders")
        .where(k % 97 != 0)
        .select(
            F.when(k % 101 == 0, k + 100000000).otherwise(k).alias("o_orderkey"),
            "o_custkey",
            F.when(k % 89 == 0, F.lit("X")).when(k % 211 == 0, F.lit(None)).when(k % 223 == 0, F.concat(st, F.lit(" "))).otherwise(st).alias("o_orderstatus"),
            F.when(k % 83 == 0, price + 1).when(k % 227 == 0, price + 0.25).otherwise(price).alias("o_totalprice"),
            "o_orderdate",
        )
    )


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return source(spark, d), target(spark, d)


def frame(df: DataFrame, **more) -> Side:
    return Side(Resource("frame", frame=df), **more)


def _plain(df: DataFrame) -> DataFrame:
    """The changed columns as text, as arrays compare poorly across engines."""
    return df.withColumn("changed", F.array_join("changed", ","))


def _join(spark: SparkSession, d: str) -> DataFrame:
    return diff.join_diff(*both(spark, d), KEYS, COLUMNS)


# -- join comparison --------------------------------------------------------------------------------------------------


@query(f"WITH {D_SQL} SELECT * FROM d")
def join_diff_detail(spark, d):
    return _plain(_join(spark, d))


@query(f"""WITH s AS ({S_SQL}), t AS ({T_SQL}),
  m AS (SELECT s.o_orderkey AS k1, t.o_orderkey AS k2, s.o_orderstatus AS a1, t.o_orderstatus AS a2, s.o_totalprice AS b1, t.o_totalprice AS b2 FROM s JOIN t USING (o_orderkey)
    WHERE s.o_orderstatus IS DISTINCT FROM t.o_orderstatus OR s.o_totalprice IS DISTINCT FROM t.o_totalprice),
  j AS (SELECT * FROM m UNION ALL SELECT o_orderkey, NULL, o_orderstatus, NULL, o_totalprice, NULL FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)
    UNION ALL SELECT NULL, o_orderkey, NULL, o_orderstatus, NULL, o_totalprice FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s))
  SELECT {OPERATION} AS operation, coalesce(k1, k2) AS o_orderkey, a1 AS o_orderstatus_1, a2 AS o_orderstatus_2, b1 AS o_totalprice_1, b2 AS o_totalprice_2, {CHANGED} AS changed FROM j""")
def join_diff_union_form(spark, d):
    return _plain(diff.join_diff_by_parts(*both(spark, d), KEYS, COLUMNS))


@query(f"""WITH {J_SQL} SELECT count(k1) AS source_count, count(k2) AS target_count, count(*) FILTER (k1 IS NULL) AS source_missing,
  count(*) FILTER (k2 IS NULL) AS target_missing, count(*) FILTER (k1 IS NOT NULL AND k2 IS NOT NULL AND (a1 IS DISTINCT FROM a2 OR b1 IS DISTINCT FROM b2)) AS mismatch FROM j""")
def join_diff_stats(spark, d):
    return diff.join_stats(*both(spark, d), KEYS, COLUMNS)


CT_SQL = "SELECT CASE WHEN (conv_id * 31 + turn) % 47 = 0 THEN conv_id + 1000000 ELSE conv_id END AS conv_id, turn, CASE WHEN conv_id % 13 = 0 AND turn % 2 = 0 THEN upper(role) ELSE role END AS role FROM conversations WHERE (conv_id + turn * 7) % 29 <> 0"


def _conversations(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    rows = table(spark, d, "conversations")
    changed = rows.where((c + t * 7) % 29 != 0).select(F.when((c * 31 + t) % 47 == 0, c + 1000000).otherwise(c).alias("conv_id"), "turn", F.when((c % 13 == 0) & (t % 2 == 0), F.upper("role")).otherwise(F.col("role")).alias("role"))
    return rows.select("conv_id", "turn", "role"), changed


@query(f"""WITH s AS (SELECT conv_id, turn, role FROM conversations), t AS ({CT_SQL})
  SELECT CASE WHEN t.conv_id IS NULL THEN 'target_missing' WHEN s.conv_id IS NULL THEN 'source_missing' ELSE 'mismatch' END AS operation,
  coalesce(s.conv_id, t.conv_id) AS conv_id, coalesce(s.turn, t.turn) AS turn, s.role AS role_1, t.role AS role_2,
  CASE WHEN s.conv_id IS NOT NULL AND t.conv_id IS NOT NULL THEN 'role' ELSE '' END AS changed
  FROM s FULL OUTER JOIN t ON s.conv_id = t.conv_id AND s.turn = t.turn WHERE s.conv_id IS NULL OR t.conv_id IS NULL OR s.role <> t.role""")
def join_diff_composite_key(spark, d):
    return _plain(diff.join_diff(*_conversations(spark, d), ["conv_id", "turn"], ["role"]))


@query(f"""WITH {D_SQL} SELECT o_orderkey, '[' || list_aggregate(list_transform(string_split(changed, ','), lambda x: '"' || x || '"'), 'string_agg', ',') || ']' AS changed_columns FROM d WHERE operation = 'mismatch'""")
def changed_columns(spark, d):
    return _join(spark, d).where("operation = 'mismatch'").select("o_orderkey", diff.changed_text().alias("changed_columns"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    return diff.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


LT_SQL = "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 53 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_suppkey % 17 <> 0"


def _lineitems(spark, d):
    rows = table(spark, d, "lineitem")
    changed = rows.where("l_suppkey % 17 <> 0").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 53 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("l_quantity"))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity"), changed


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), t AS ({LT_SQL})
  SELECT CASE WHEN t.l_orderkey IS NULL THEN 'target_missing' WHEN s.l_orderkey IS NULL THEN 'source_missing' ELSE 'mismatch' END AS operation, count(*) AS differences
  FROM s FULL OUTER JOIN t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber WHERE s.l_quantity IS DISTINCT FROM t.l_quantity GROUP BY 1""")
def join_diff_repeated_keys(spark, d):
    """Rows of a repeated key meet each with each in a join comparison."""
    return stats.by_operation(diff.join_diff(*_lineitems(spark, d), ["l_orderkey", "l_linenumber"], ["l_quantity"]))


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem),
  t AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM ({LT_SQL})),
  j AS (SELECT s.l_orderkey AS k1, t.l_orderkey AS k2, s.l_linenumber AS n1, t.l_linenumber AS n2, s.l_quantity AS q1, t.l_quantity AS q2
    FROM (SELECT * FROM s WHERE n = 1) s FULL OUTER JOIN (SELECT * FROM t WHERE n = 1) t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber
    UNION ALL SELECT l_orderkey, NULL, l_linenumber, NULL, l_quantity, NULL FROM s WHERE n > 1 UNION ALL SELECT NULL, l_orderkey, NULL, l_linenumber, NULL, l_quantity FROM t WHERE n > 1)
  SELECT {OPERATION} AS operation, coalesce(k1, k2)::varchar AS l_orderkey, coalesce(n1, n2)::varchar AS l_linenumber, q1::decimal(38,4)::varchar AS l_quantity_1, q2::decimal(38,4)::varchar AS l_quantity_2
  FROM j WHERE k1 IS NULL OR k2 IS NULL OR q1 <> q2""")
def checksum_diff_repeated_keys(spark, d):
    """All rows of a repeated key are missing on the other side in a checksum comparison."""
    return diff.checksum_diff(*_lineitems(spark, d), ["l_orderkey", "l_linenumber"], ["l_quantity"]).drop("changed")


# -- outer joins and set operations -----------------------------------------------------------------------------------

_OUTER = "s.o_orderkey AS o_orderkey_1, s.o_orderstatus AS o_orderstatus_1, t.o_orderkey AS o_orderkey_2, t.o_orderstatus AS o_orderstatus_2"


def _outer(how: str) -> None:
    def run(spark, d):
        s, t = both(spark, d)
        return sets.outer(s.select("o_orderkey", "o_orderstatus"), t.select("o_orderkey", "o_orderstatus"), KEYS, how)

    run.__name__ = f"outer_join_{how}"
    query(f"WITH s AS ({S_SQL}), t AS ({T_SQL}) SELECT {_OUTER} FROM s {how.upper()} JOIN t ON s.o_orderkey = t.o_orderkey")(run)


for _how in ("full", "left", "right"):
    _outer(_how)


@query(f"WITH s AS ({S_SQL}), t AS ({T_SQL}) SELECT o_orderkey FROM s EXCEPT SELECT o_orderkey FROM t")
def key_only_left(spark, d):
    return sets.only_in(*both(spark, d), KEYS)


@query(f"WITH s AS ({S_SQL}), t AS ({T_SQL}) SELECT o_orderkey FROM t EXCEPT SELECT o_orderkey FROM s")
def key_only_right(spark, d):
    return sets.only_in(*both(spark, d)[::-1], KEYS)


@query(f"WITH s AS ({S_SQL}), t AS ({T_SQL}) SELECT o_orderkey FROM s INTERSECT SELECT o_orderkey FROM t")
def key_in_both(spark, d):
    return sets.in_both(*both(spark, d), KEYS)


@query(f"WITH s AS ({S_SQL}), t AS ({T_SQL}) SELECT o_orderkey, o_orderstatus FROM s UNION SELECT o_orderkey, o_orderstatus FROM t")
def union_distinct(spark, d):
    s, t = both(spark, d)
    return sets.union(s.select("o_orderkey", "o_orderstatus"), t.select("o_orderkey", "o_orderstatus"))


@query(f"WITH s AS ({S_SQL}), t AS ({T_SQL}) SELECT o_orderkey, o_orderstatus FROM s UNION ALL SELECT o_orderkey, o_orderstatus FROM t")
def union_all(spark, d):
    s, t = both(spark, d)
    return sets.union_all(s.select("o_orderkey", "o_orderstatus"), t.select("o_orderkey", "o_orderstatus"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 0)")
def key_lookup(spark, d):
    wanted = table(spark, d, "orders").where("o_custkey % 50 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return sets.lookup(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), wanted, ["l_orderkey"])


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id = 1 AND turn = 0) OR (conv_id = 3 AND turn = 1) OR (conv_id = 7 AND turn = 2)")
def key_in_list(spark, d):
    return table(spark, d, "conversations").where(key_in(["conv_id", "turn"], [(1, 0), (3, 1), (7, 2)])).select("conv_id", "turn", "role")


# -- predicates -------------------------------------------------------------------------------------------------------


@query(f"WITH s AS ({S_SQL}), t AS ({T_SQL}) SELECT s.o_orderkey, s.o_orderstatus AS a, t.o_orderstatus AS b FROM s JOIN t USING (o_orderkey) WHERE s.o_orderstatus IS DISTINCT FROM t.o_orderstatus")
def null_safe_inequality(spark, d):
    s, t = both(spark, d)
    j = s.select("o_orderkey", F.col("o_orderstatus").alias("a")).join(t.select("o_orderkey", F.col("o_orderstatus").alias("b")), "o_orderkey")
    return j.where(differs(F.col("a"), F.col("b")))


@query(f"WITH {J_SQL} SELECT count(*) FILTER (k1 IS NULL AND a1 IS NULL) AS source_all_null, count(*) FILTER (k2 IS NULL AND a2 IS NULL) AS target_all_null FROM j")
def all_keys_null(spark, d):
    s, t = both(spark, d)
    j = sets.outer(s, t, KEYS, "full")
    return j.agg(F.count_if(all_null([F.col("o_orderkey_1"), F.col("o_orderstatus_1")])).alias("source_all_null"), F.count_if(all_null([F.col("o_orderkey_2"), F.col("o_orderstatus_2")])).alias("target_all_null"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 200 AND o_orderkey < 700")
def key_range_single(spark, d):
    return table(spark, d, "orders").where(key_range(["o_orderkey"], [200], [700])).select("o_orderkey", "o_custkey")


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id > 3 OR (conv_id = 3 AND turn >= 1)) AND (conv_id < 20 OR (conv_id = 20 AND turn <= 2))")
def key_range_composite(spark, d):
    return table(spark, d, "conversations").where(key_range(["conv_id", "turn"], [3, 1], [20, 2], inclusive=True)).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id > 5 OR (conv_id = 5 AND turn > 1) ORDER BY conv_id, turn LIMIT 25")
def keyset_page(spark, d):
    return segments.page(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], 25, [5, 1])


@query("SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 20 OFFSET 30")
def offset_page(spark, d):
    return segments.page_at(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], 20, 30)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 500")
def key_at_offset(spark, d):
    return segments.key_at(table(spark, d, "orders"), ["o_orderkey"], 500)


@query("SELECT count(*) AS row_count FROM conversations WHERE conv_id > 5 OR (conv_id = 5 AND turn > 1)")
def keyset_count(spark, d):
    return segments.row_count(table(spark, d, "conversations"), after_key(["conv_id", "turn"], [5, 1]))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-07-01'")
def update_window(spark, d):
    from datetime import date, datetime

    return table(spark, d, "orders").where(time_window("o_orderdate", datetime(1995, 1, 1), datetime(1995, 7, 1))).select("o_orderkey", "o_orderdate")


# -- aggregates -------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS row_count FROM orders WHERE o_orderstatus = 'F'")
def row_count(spark, d):
    return segments.row_count(table(spark, d, "orders"), F.col("o_orderstatus") == "F")


@query("SELECT count(*) AS row_count, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey FROM orders")
def key_bounds(spark, d):
    return segments.key_bounds(table(spark, d, "orders"), ["o_orderkey"])


@query("WITH b AS (SELECT count(*) AS row_count, min(row(conv_id, turn)) AS lo, max(row(conv_id, turn)) AS hi FROM conversations) SELECT row_count, lo[1] AS min_conv_id, lo[2] AS min_turn, hi[1] AS max_conv_id, hi[2] AS max_turn FROM b")
def key_bounds_composite(spark, d):
    return segments.key_bounds(table(spark, d, "conversations"), ["conv_id", "turn"])


@query("SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_count FROM lineitem")
def distinct_count(spark, d):
    return segments.distinct_count(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


ROW_TEXT = "concat_ws('|', coalesce(o_orderkey::varchar, '0'), coalesce(trim(o_orderstatus), ''), coalesce(o_totalprice::decimal(38,4)::varchar, '0.0000'))"
H_SQL = f"h AS (SELECT o_orderkey::varchar AS k, md5({ROW_TEXT}) AS h FROM orders)"
N_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice"]


def _texts(spark, d):
    return diff.normalized(table(spark, d, "orders"), N_COLUMNS)


@query(f"WITH {H_SQL} SELECT k AS o_orderkey, h AS row_hash FROM h")
def row_hash(spark, d):
    return _texts(spark, d).select("o_orderkey", checksum.row_hash([F.col(c) for c in N_COLUMNS]).alias("row_hash"))


BUCKET = "(('0x' || substr(md5(k), 1, 8))::bigint % 16)::int"


@query(f"WITH {H_SQL} SELECT {BUCKET} AS bucket, count(*) AS row_count, md5(string_agg(h, '|' ORDER BY k)) AS checksum FROM h GROUP BY 1")
def checksum_concat(spark, d):
    return diff.bucket_digests(_texts(spark, d), KEYS, COLUMNS, 16, "concat").drop("total")


@query(f"WITH {H_SQL} SELECT count(*) AS row_count, printf('%016X', bit_xor(('0x' || substr(h, 1, 16))::ubigint)) AS checksum FROM h")
def checksum_xor(spark, d):
    rows = _texts(spark, d).select(checksum.row_hash([F.col(c) for c in N_COLUMNS]).alias("h"))
    return rows.agg(F.count(F.lit(1)).alias("row_count"), checksum.xor_checksum(F.col("h")).alias("checksum"))


@query("SELECT 0::bigint AS row_count, '0' AS xor_checksum, '' AS concat_checksum")
def checksum_of_nothing(spark, d):
    rows = _texts(spark, d).where(F.lit(False)).select("o_orderkey", checksum.row_hash([F.col(c) for c in N_COLUMNS]).alias("h"))
    return rows.agg(F.count(F.lit(1)).alias("row_count"), checksum.xor_checksum(F.col("h")).alias("xor_checksum"), checksum.concat_checksum(F.col("o_orderkey"), F.col("h")).alias("concat_checksum"))


@query(f"WITH {H_SQL} SELECT {BUCKET} AS bucket, count(*) AS row_count, printf('%016X', bit_xor(('0x' || substr(h, 1, 16))::ubigint)) AS checksum, sum(('0x' || substr(h, 17, 8))::bigint)::bigint AS total FROM h GROUP BY 1")
def bucket_digest(spark, d):
    return diff.bucket_digests(_texts(spark, d), KEYS, COLUMNS, 16)


def _digest_sql(side: str) -> str:
    return f"""SELECT bucket, count(*) AS n, printf('%016X', bit_xor(('0x' || substr(h, 1, 16))::ubigint)) AS c FROM (
      SELECT (('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 4096)::int AS bucket, md5({ROW_TEXT}) AS h FROM ({side})) GROUP BY 1"""


@query(f"""WITH s AS ({_digest_sql(S_SQL)}), t AS ({_digest_sql(T_SQL)}) SELECT coalesce(s.bucket, t.bucket) AS bucket, s.n AS source_rows, s.c AS source_checksum, t.n AS target_rows, t.c AS target_checksum
  FROM s FULL OUTER JOIN t ON s.bucket = t.bucket WHERE s.n IS DISTINCT FROM t.n OR s.c IS DISTINCT FROM t.c""")
def bucket_diff_ranges(spark, d):
    s, t = (diff.normalized(x, N_COLUMNS) for x in both(spark, d))
    return diff.differing_buckets(s, t, KEYS, COLUMNS, 4096)


# -- segments ---------------------------------------------------------------------------------------------------------


@query("SELECT (o_orderkey >= 250)::int + (o_orderkey >= 500)::int + (o_orderkey >= 750)::int AS segment, count(*) AS row_count, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders GROUP BY 1")
def range_segments(spark, d):
    return segments.range_segments(table(spark, d, "orders"), "o_orderkey", 0, 999, 4)


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS at, count(*) OVER () AS n FROM orders)
  SELECT (SELECT count(*) FROM range(1, 8) i(i) WHERE r.at > ceil(i * n / 8))::int AS segment, count(*) AS row_count, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM r GROUP BY 1""")
def equi_depth_segments(spark, d):
    return segments.depth_segments(table(spark, d, "orders"), "o_orderkey", 8, 1_000_000)


@query("""WITH b AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS z FROM orders)
  SELECT (SELECT count(*) FROM range(1, 8) i(i) WHERE o_orderkey >= a + (z - a + 1) * i // 8)::int AS segment, count(*) AS row_count, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders, b GROUP BY 1""")
def segments_auto(spark, d):
    """Whole-number keys are cut into ranges of equal width between their bounds."""
    return segments.segmented(table(spark, d, "orders"), "o_orderkey", 8)


@query("SELECT count(*) AS rows, min(c_name) AS low, max(c_name) AS high, 0::bigint AS overlaps FROM customer")
def segments_fallback(spark, d):
    """Texts have no ranges of equal width: sampled boundaries take their place, whose segments hold each row once."""
    made = segments.segmented(table(spark, d, "customer"), "c_name", 6, "range")
    made = made.withColumn("before", F.lag("max_key").over(Window.orderBy("segment")))
    return made.agg(F.sum("row_count").alias("rows"), F.min("min_key").alias("low"), F.max("max_key").alias("high"), F.count_if(F.col("before") >= F.col("min_key")).alias("overlaps"))


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS place FROM lineitem)
  SELECT place // 100 AS segment, count(*) AS row_count, min(l_orderkey) AS min_key, max(l_orderkey) AS max_key FROM r GROUP BY 1""")
def keyset_walk(spark, d):
    """Pages of 100 rows in key order, keys that repeat among them."""
    return segments.walk(table(spark, d, "lineitem"), "l_orderkey", 100)


@query("SELECT max(o_orderkey) - min(o_orderkey) + 1 AS keys FROM orders")
def key_space(spark, d):
    low, high = segments.key_bounds(table(spark, d, "orders"), KEYS).first()[1:]
    return spark.range(1).select(F.lit(segments.estimated_size([low], [high])).cast("long").alias("keys"))


_NODES = f"""s AS ({_digest_sql(S_SQL)}), t AS ({_digest_sql(T_SQL)}), l AS (SELECT coalesce(s.bucket, t.bucket) AS b, coalesce(s.n, 0) AS sn, coalesce(t.n, 0) AS tn,
    s.n IS DISTINCT FROM t.n OR s.c IS DISTINCT FROM t.c AS differs FROM s FULL OUTER JOIN t ON s.bucket = t.bucket),
  n AS (SELECT i::int AS level, (b // (8 ** (4 - i))::bigint)::int AS segment, sum(sn)::bigint AS source_rows, sum(tn)::bigint AS target_rows, bool_or(differs) AS differs FROM l, range(0, 5) r(i) GROUP BY 1, 2)"""


@query(f"""WITH {_NODES} SELECT n.level, n.segment, n.source_rows, n.target_rows,
  CASE WHEN NOT n.differs THEN 'skip_equal' WHEN n.level = 4 OR greatest(n.source_rows, n.target_rows) <= 30 THEN 'compare' ELSE 'split' END AS decision
  FROM n LEFT JOIN n AS p ON p.level = n.level - 1 AND p.segment = n.segment // 8 WHERE n.level = 0 OR (p.differs AND greatest(p.source_rows, p.target_rows) > 30)""")
def bisection_trace(spark, d):
    """Eight children a segment, four levels, and comparison of segments of 30 rows or fewer."""
    texts = [diff.normalized(x, N_COLUMNS) for x in both(spark, d)]
    return diff.bisection(*texts, KEYS, COLUMNS, 8, 4, 30)


_SEG = "((o_orderkey % 100000000) // 97)::int"


def _segment_sql(side: str) -> str:
    return f"SELECT {_SEG} AS segment, count(*) AS n, printf('%016X', bit_xor(('0x' || substr(md5({ROW_TEXT}), 1, 16))::ubigint)) AS c FROM ({side}) GROUP BY 1"


@query(f"""WITH s AS ({_segment_sql(S_SQL)}), t AS ({_segment_sql(T_SQL)})
  SELECT coalesce(s.segment, t.segment) AS segment, coalesce(s.n, 0) AS source_rows, coalesce(t.n, 0) AS target_rows, s.c AS source_checksum, t.c AS target_checksum,
  CASE WHEN s.n IS NOT DISTINCT FROM t.n AND s.c IS NOT DISTINCT FROM t.c THEN 'skip_equal' ELSE 'compare' END AS decision FROM s FULL OUTER JOIN t ON s.segment = t.segment""")
def segment_trace(spark, d):
    s, t = both(spark, d)
    seg = F.floor((F.col("o_orderkey").cast("bigint") % 100_000_000) / 97).cast("int")
    texts = [diff.normalized(x, N_COLUMNS) for x in (s, t)]
    return segments.segment_trace(*[segments.segment_digests(x, KEYS, COLUMNS, seg) for x in texts])


@query("""WITH b AS (SELECT o_custkey % 32 AS segment, count(*) AS row_count FROM orders GROUP BY 1) SELECT count(*) AS segments, sum(row_count)::bigint AS rows, min(row_count) AS min_rows,
  max(row_count) AS max_rows, round(avg(row_count), 6) AS avg_rows, round(stddev_pop(row_count) / avg(row_count), 6) AS cv, round(greatest(0.0, least(1.0, 1 - stddev_pop(row_count) / avg(row_count))), 6) AS quality FROM b""")
def segment_statistics(spark, d):
    made = segments.segment_statistics(table(spark, d, "orders").groupBy((F.col("o_custkey") % 32).alias("segment")).agg(F.count(F.lit(1)).alias("row_count")))
    return made.select("segments", "rows", "min_rows", "max_rows", *[F.round(c, 6).alias(c) for c in ("avg_rows", "cv", "quality")])


@query("""SELECT least(20, floor((o_totalprice - 0) / 25000)::bigint + 1) AS bin, count(*) AS row_count, round(count(*) / 25000.0, 9) AS density FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1""")
def key_distribution(spark, d):
    return segments.distribution(table(spark, d, "orders"), "o_totalprice", 20, 0, 500000).withColumn("density", F.round("density", 9))


@query("SELECT conv_id, max(turn) AS last_turn, count(*) AS rows FROM conversations GROUP BY conv_id")
def window_last_per_key(spark, d):
    """The last row of each key by a window, as a SQL resource may use it."""
    w = Window.partitionBy("conv_id")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.max("turn").over(w).alias("last_turn"), F.count(F.lit(1)).over(w).alias("rows"))
    return rows.where("turn = last_turn").select("conv_id", "last_turn", "rows")


# -- normalization ------------------------------------------------------------------------------------------------------


def _nulled(spark, d, name: str, key: str, column: str, by: int = 7) -> DataFrame:
    """key and v, a column with every by-th value null."""
    return table(spark, d, name).select(key, F.when(F.col(key) % by != 0, F.col(column)).alias("v"))


def _normalized(df: DataFrame, key: str, rules=None) -> DataFrame:
    return df.select(key, norm.normalize(F.col("v"), df.schema["v"].dataType, rules).alias("text"))


def _n_sql(name: str, key: str, column: str, text: str, by: int = 7) -> str:
    return f"SELECT {key}, {text} AS text FROM (SELECT {key}, CASE WHEN {key} % {by} <> 0 THEN {column} END AS v FROM {name})"


@query("SELECT c_custkey, coalesce(trim(v), '') AS text FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN '  ' || c_name || ' ' END AS v FROM customer)")
def normalize_string(spark, d):
    df = _nulled(spark, d, "customer", "c_custkey", "c_name")
    return _normalized(df.withColumn("v", F.concat(F.lit("  "), "v", F.lit(" "))), "c_custkey")


@query(_n_sql("part", "p_partkey", "p_size", "coalesce(v::varchar, '0')"))
def normalize_integer(spark, d):
    return _normalized(_nulled(spark, d, "part", "p_partkey", "p_size"), "p_partkey")


@query(_n_sql("customer", "c_custkey", "c_acctbal::decimal(18,2)", "coalesce(v::decimal(38,4)::varchar, '0.0000')"))
def normalize_decimal(spark, d):
    df = _nulled(spark, d, "customer", "c_custkey", "c_acctbal")
    return _normalized(df.withColumn("v", F.col("v").cast(T.DecimalType(18, 2))), "c_custkey")


@query(_n_sql("customer", "c_custkey", "c_acctbal", "coalesce(v::decimal(38,4)::varchar, '0.0000')"))
def normalize_double(spark, d):
    return _normalized(_nulled(spark, d, "customer", "c_custkey", "c_acctbal"), "c_custkey")


@query(_n_sql("customer", "c_custkey", "c_acctbal::float", "coalesce(v::double::decimal(38,6)::varchar, '0.000000')"))
def normalize_float(spark, d):
    df = _nulled(spark, d, "customer", "c_custkey", "c_acctbal")
    return _normalized(df.withColumn("v", F.col("v").cast("float")), "c_custkey")


@query(_n_sql("customer", "c_custkey", "c_acctbal > 0", "CASE WHEN v THEN '1' ELSE '0' END"))
def normalize_boolean(spark, d):
    df = _nulled(spark, d, "customer", "c_custkey", "c_acctbal")
    return _normalized(df.withColumn("v", F.col("v") > 0), "c_custkey")


@query(_n_sql("orders", "o_orderkey", "o_orderdate::date", "coalesce(strftime(v, '%Y-%m-%d'), '')"))
def normalize_date(spark, d):
    df = _nulled(spark, d, "orders", "o_orderkey", "o_orderdate")
    return _normalized(df.withColumn("v", F.col("v").cast("date")), "o_orderkey")


@query(_n_sql("events", "event_id", "ts", "coalesce(strftime(v, '%Y-%m-%d %H:%M:%S'), '')"))
def normalize_datetime(spark, d):
    return _normalized(_nulled(spark, d, "events", "event_id", "ts"), "event_id")


@query(_n_sql("events", "event_id", "ts", "coalesce(strftime(v + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S'), '')"))
def normalize_datetime_zone(spark, d):
    return _normalized(_nulled(spark, d, "events", "event_id", "ts"), "event_id", {"datetime": norm.Rule(timezone="Asia/Shanghai")})


@query(_n_sql("events", "event_id", "ts", "coalesce(strftime(v, '%Y-%m-%d %H:%M:%S'), '')"))
def normalize_timestamp(spark, d):
    df = _nulled(spark, d, "events", "event_id", "ts")
    return _normalized(df.withColumn("v", F.convert_timezone(F.lit("UTC"), F.current_timezone(), "v").cast("timestamp")), "event_id")


@query(_n_sql("events", "event_id", "ts", "coalesce(strftime(v, '%H:%M:%S'), '')"))
def normalize_time(spark, d):
    df = _nulled(spark, d, "events", "event_id", "ts")
    return df.select("event_id", norm.time(F.date_format("v", "HH:mm:ss.SSS")).alias("text"))


@query(_n_sql("customer", "c_custkey", "c_name", "coalesce(upper(hex(v)), '')"))
def normalize_binary(spark, d):
    df = _nulled(spark, d, "customer", "c_custkey", "c_name")
    return _normalized(df.withColumn("v", F.col("v").cast("binary")), "c_custkey")


@query(_n_sql("events", "event_id", "props", "coalesce(v, '')"))
def normalize_json(spark, d):
    df = _nulled(spark, d, "events", "event_id", "props")
    return df.select("event_id", norm.json(F.col("v")).alias("text"))


@query(_n_sql("events", "event_id", "event_type", "CASE WHEN v IS NULL THEN '' ELSE '[\"' || v || '\",\"x\"]' END"))
def normalize_default(spark, d):
    df = _nulled(spark, d, "events", "event_id", "event_type")
    return _normalized(df.withColumn("v", F.when(F.col("v").isNotNull(), F.array("v", F.lit("x")))), "event_id")


@query(_n_sql("orders", "o_orderkey", "o_totalprice", "coalesce(v::decimal(38,1)::varchar, '0.0')"))
def norm_decimal_precision(spark, d):
    return _normalized(_nulled(spark, d, "orders", "o_orderkey", "o_totalprice"), "o_orderkey", {"double": norm.Rule(precision=1)})


@query(_n_sql("orders", "o_orderkey", "o_totalprice::decimal(18,4)", "coalesce((trunc(v * 10) / 10)::decimal(38,1)::varchar, '0.0')"))
def norm_decimal_truncate(spark, d):
    df = _nulled(spark, d, "orders", "o_orderkey", "o_totalprice").withColumn("v", F.col("v").cast(T.DecimalType(18, 4)))
    return _normalized(df, "o_orderkey", {"decimal": norm.Rule(precision=1, rounding="truncate")})


@query(_n_sql("events", "event_id", "ts", "coalesce(strftime(v, '%Y-%m-%d'), '')"))
def norm_date_only(spark, d):
    return _normalized(_nulled(spark, d, "events", "event_id", "ts"), "event_id", {"datetime": norm.Rule(comparison="DATE_ONLY")})


@query(_n_sql("customer", "c_custkey", "c_name", "coalesce(base64(v::blob), 'none')"))
def norm_encode_base64(spark, d):
    df = _nulled(spark, d, "customer", "c_custkey", "c_name")
    return _normalized(df.withColumn("v", F.col("v").cast("binary")), "c_custkey", {"binary": norm.rule_of("encode", {"format": "base64"}, norm.Rule(null_value="none"))})


@query(_n_sql("customer", "c_custkey", "c_acctbal > 0", "CASE WHEN v IS NULL THEN '?' WHEN v THEN 'Y' ELSE 'N' END"))
def norm_map_boolean(spark, d):
    df = _nulled(spark, d, "customer", "c_custkey", "c_acctbal")
    rule = norm.rule_of("map_boolean", {"trueValue": "Y", "falseValue": "N", "nullValue": "?"})
    return _normalized(df.withColumn("v", F.col("v") > 0), "c_custkey", {"boolean": rule})


@query("SELECT c_custkey, coalesce('  ' || v || ' ', 'none') AS text FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS v FROM customer)")
def norm_string_option(spark, d):
    df = _nulled(spark, d, "customer", "c_custkey", "c_name")
    rule = norm.rule_of("normalize_string", {"trim": False, "nullValue": "none"})
    return _normalized(df.withColumn("v", F.concat(F.lit("  "), "v", F.lit(" "))), "c_custkey", {"string": rule})


@query("SELECT o_orderkey, '' AS s, '' AS i, '' AS c, '' AS p, '' AS x, '' AS b, '' AS dt, '' AS ts, '' AS bin, '' AS text FROM orders")
def record_null(spark, d):
    """A null of every type is an empty text, also where a bad value has a default."""
    types = {"s": "string", "i": "int", "c": "decimal(18,2)", "p": "double", "x": "float", "b": "boolean", "dt": "date", "ts": "timestamp", "bin": "binary"}
    rows = table(spark, d, "orders").select("o_orderkey", *[F.lit(None).cast(t).alias(c) for c, t in types.items()])
    return rows.select("o_orderkey", *[norm.record(F.col(c), rows.schema[c].dataType).alias(c) for c in types], norm.record_text(F.col("s"), "time").alias("text"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '00:00:00' WHEN 1 THEN '' ELSE strftime(o_orderdate + INTERVAL (o_orderkey % 86400) SECOND, '%H:%M:%S') END AS time FROM orders")
def record_time(spark, d):
    """Times to the second; a text that holds none is midnight, a null empty."""
    k = F.col("o_orderkey")
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp("o_orderdate") + k % 86400), "HH:mm:ss")
    text = F.when(k % 4 == 0, F.lit("noon")).when(k % 4 == 1, F.lit(None)).when(k % 4 == 2, F.concat(at, F.lit(".250"))).otherwise(F.concat(F.lit(" "), at))
    return table(spark, d, "orders").select("o_orderkey", norm.record_text(text, "time").alias("time"))


@query("""SELECT o_orderkey, o_orderstatus AS s, printf('%.6f', o_totalprice) AS p, CASE WHEN abs(x) > 1e10 THEN printf('%.6e', x) ELSE printf('%.6f', x) END AS x,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t, printf('%.4f', o_totalprice::decimal(18,2)::double) AS c, lower(hex(o_orderstatus)) AS b FROM (SELECT *, floor(o_totalprice) * 1000033 AS x FROM orders)""")
def record_profile(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("\t "), "o_orderstatus", F.lit("\n")).alias("s"), F.col("o_totalprice").alias("p"), (F.floor("o_totalprice").cast("double") * 1000033).alias("x"), F.col("o_orderdate").alias("t"), F.col("o_totalprice").cast(T.DecimalType(18, 2)).alias("c"), F.col("o_orderstatus").cast("binary").alias("b"))
    return rows.select("o_orderkey", *[norm.record(F.col(c), rows.schema[c].dataType).alias(c) for c in "spxtcb"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE o_custkey::varchar END AS i, CASE WHEN o_orderkey % 3 = 0 THEN '0.0000' ELSE printf('%.4f', o_custkey::double) END AS n,
  CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS b, CASE WHEN o_orderkey % 3 = 0 THEN '1970-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dt,
  CASE WHEN o_orderkey % 3 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS ts FROM orders""")
def record_profile_text(spark, d):
    bad = F.col("o_orderkey") % 3 == 0
    rows = table(spark, d, "orders").select("o_orderkey", F.when(bad, F.lit("bad")).otherwise(F.col("o_custkey").cast("string")).alias("i"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" Yes")).otherwise(F.lit("no")).alias("b"), F.when(bad, F.lit("bad")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("dt"))
    return rows.select("o_orderkey", norm.record_text(F.col("i"), "integer").alias("i"), norm.record_text(F.col("i"), "decimal").alias("n"), norm.record_text(F.col("b"), "boolean").alias("b"), norm.record_text(F.col("dt"), "date").alias("dt"), norm.record_text(F.col("dt"), "timestamp").alias("ts"))


# -- comparisons of text --------------------------------------------------------------------------------------------------


def _text_diff_sql(trim: bool, write: str) -> str:
    """Differences of canonical text; trim as full comparison does after normalization."""
    side = f"SELECT o_orderkey::varchar AS k, {write}"
    status = "trim(a1) IS DISTINCT FROM trim(a2)" if trim else "a1 IS DISTINCT FROM a2"
    return f"""WITH s AS ({side} FROM ({S_SQL})), t AS ({side} FROM ({T_SQL})),
      j AS (SELECT s.k AS k1, t.k AS k2, s.a AS a1, t.a AS a2, s.b AS b1, t.b AS b2 FROM s FULL OUTER JOIN t ON s.k = t.k)
      SELECT {OPERATION} AS operation, coalesce(k1, k2) AS o_orderkey, a1 AS o_orderstatus_1, a2 AS o_orderstatus_2, b1 AS o_totalprice_1, b2 AS o_totalprice_2,
      CASE WHEN k1 IS NOT NULL AND k2 IS NOT NULL THEN concat_ws(',', CASE WHEN {status} THEN 'o_orderstatus' END, CASE WHEN b1 <> b2 THEN 'o_totalprice' END) ELSE '' END AS changed
      FROM j WHERE k1 IS NULL OR k2 IS NULL OR {status} OR b1 <> b2"""


TABLE_TEXT = "coalesce(trim(o_orderstatus), '') AS a, coalesce(o_totalprice::decimal(38,4)::varchar, '0.0000') AS b"
RECORD_TEXT = "coalesce(trim(o_orderstatus), '') AS a, printf('%.6f', o_totalprice) AS b"


@query(_text_diff_sql(True, TABLE_TEXT))
def checksum_diff_full(spark, d):
    """Without buckets: one join of canonical text."""
    return _plain(diff.checksum_diff(*both(spark, d), KEYS, COLUMNS))


@query(_text_diff_sql(True, TABLE_TEXT))
def checksum_diff_pruned(spark, d):
    """With buckets: only rows of differing buckets are joined."""
    return _plain(diff.checksum_diff(*both(spark, d), KEYS, COLUMNS, buckets=4096))


@query(_text_diff_sql(True, TABLE_TEXT))
def checksum_diff_concat(spark, d):
    return _plain(diff.checksum_diff(*both(spark, d), KEYS, COLUMNS, buckets=256, algorithm="concat"))


@query(_text_diff_sql(False, TABLE_TEXT))
def checksum_diff_row_hash(spark, d):
    return _plain(diff.checksum_diff(*both(spark, d), KEYS, COLUMNS, local="row-hash", buckets=256))


def _compared(spark, d, **how) -> DataFrame:
    """Differences as a planned comparison gives them, all of them: checked() would run it twice, and fail beyond a million."""
    sides = [frame(x, keys=("o_orderkey",), columns=("o_orderstatus", "o_totalprice")) for x in both(spark, d)]
    return _plain(compare(spark, Comparison(*sides, Strategy(**how))).diff)


@query(_text_diff_sql(True, TABLE_TEXT))
def checksum_diff_auto(spark, d):
    """As many buckets as suit the rows."""
    return _compared(spark, d, buckets=None)


@query(_text_diff_sql(False, TABLE_TEXT))
def key_hash_diff(spark, d):
    """The key-hash plan: keys and row hashes are compared first."""
    return _compared(spark, d, prefer=("key-hash",))


# Values that hold separators, nulls that change places, and numbers without decimals; strict nulls.
def _hostile_sql(a: str, b: str, x: str) -> str:
    return f"SELECT c_custkey AS k, {a} AS a, {b} AS b, {x} AS x FROM customer"


HS_SQL = _hostile_sql(
    "CASE c_custkey % 5 WHEN 0 THEN c_name || '|b' WHEN 1 THEN NULL ELSE c_name END", "CASE c_custkey % 5 WHEN 0 THEN 'c' WHEN 1 THEN 'z' ELSE c_mktsegment END",
    "CASE c_custkey % 7 WHEN 0 THEN 'NaN'::double WHEN 1 THEN 'Infinity'::double WHEN 2 THEN 1e36 ELSE c_acctbal END",
)
HT_SQL = _hostile_sql(
    "CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN 'z' ELSE c_name END", "CASE c_custkey % 5 WHEN 0 THEN 'b|c' WHEN 1 THEN NULL ELSE c_mktsegment END",
    "CASE c_custkey % 7 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'NaN'::double ELSE 0.0 END WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Infinity'::double ELSE '-Infinity'::double END WHEN 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 1e36 ELSE 2e36 END ELSE c_acctbal END",
)
HOSTILE_SQL = f"""WITH s AS ({HS_SQL}), t AS ({HT_SQL}), j AS (SELECT k, s.a IS DISTINCT FROM t.a AS na, s.b IS DISTINCT FROM t.b AS nb, s.x IS DISTINCT FROM t.x AS nx FROM s JOIN t USING (k))
  SELECT 'mismatch' AS operation, k::varchar AS k, concat_ws(',', CASE WHEN na THEN 'a' END, CASE WHEN nb THEN 'b' END, CASE WHEN nx THEN 'x' END) AS changed FROM j WHERE na OR nb OR nx"""


def _hostile(spark, d, **how):
    five, seven, even = F.col("c_custkey") % 5, F.col("c_custkey") % 7, F.col("c_custkey") % 2 == 0
    number = lambda nan, inf, big: F.when(seven == 0, nan).when(seven == 1, inf).when(seven == 2, big).otherwise(F.col("c_acctbal"))
    text = lambda zero, one, rest: F.when(five == 0, zero).when(five == 1, one).otherwise(F.col(rest))
    nan, inf, none = F.lit(float("nan")), F.lit(float("inf")), F.lit(None).cast("string")
    rows = table(spark, d, "customer")
    s = rows.select(F.col("c_custkey").alias("k"), text(F.concat("c_name", F.lit("|b")), none, "c_name").alias("a"), text(F.lit("c"), F.lit("z"), "c_mktsegment").alias("b"), number(nan, inf, F.lit(1e36)).alias("x"))
    t = rows.select(F.col("c_custkey").alias("k"), text(F.col("c_name"), F.lit("z"), "c_name").alias("a"), text(F.lit("b|c"), none, "c_mktsegment").alias("b"), number(F.when(even, nan).otherwise(0.0), F.when(even, inf).otherwise(-inf), F.when(even, 1e36).otherwise(2e36)).alias("x"))
    made = diff.checksum_diff(s, t, ["k"], ["a", "b", "x"], strict_nulls=True, **how)
    return made.select("operation", "k", F.array_join("changed", ",").alias("changed"))


@query(HOSTILE_SQL)
def hostile_full(spark, d):
    return _hostile(spark, d)


@query(HOSTILE_SQL)
def hostile_pruned(spark, d):
    return _hostile(spark, d, buckets=64)


@query(HOSTILE_SQL)
def hostile_row_hash(spark, d):
    return _hostile(spark, d, local="row-hash")


@query(HOSTILE_SQL)
def hostile_row_hash_pruned(spark, d):
    return _hostile(spark, d, local="row-hash", buckets=64)


@query(_text_diff_sql(False, RECORD_TEXT))
def merge_diff(spark, d):
    return _plain(diff.merge_diff(*both(spark, d), KEYS, COLUMNS, validate_unique_keys=True))


@query(f"""WITH {J_SQL} SELECT count(*) AS differences FROM j WHERE k1 IS NOT NULL AND k2 IS NOT NULL AND (a1 IS NULL) <> (a2 IS NULL)""")
def strict_null_diff(spark, d):
    """With strict nulls, a null differs from the empty text that it would be written as."""
    found = diff.checksum_diff(*both(spark, d), KEYS, ["o_orderstatus"], strict_nulls=True)
    return found.where("operation = 'mismatch' and (o_orderstatus_1 is null) <> (o_orderstatus_2 is null)").agg(F.count(F.lit(1)).alias("differences"))


# -- resources and mappings --------------------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT o_orderkey AS id, upper(o_orderstatus) AS status, 'a' AS origin, o_totalprice AS price FROM ({S_SQL})), t AS (SELECT o_orderkey AS id, upper(trim(o_orderstatus)) AS status, 'a' AS origin, o_totalprice AS price FROM ({T_SQL}))
  SELECT CASE WHEN t.id IS NULL THEN 'target_missing' WHEN s.id IS NULL THEN 'source_missing' ELSE 'mismatch' END AS operation, coalesce(s.id, t.id) AS id, s.status AS status_1, t.status AS status_2, s.origin AS origin_1, t.origin AS origin_2
  FROM s FULL OUTER JOIN t ON s.id = t.id WHERE s.id IS NULL OR t.id IS NULL OR s.status IS DISTINCT FROM t.status""")
def mapped_diff(spark, d):
    s, t = both(spark, d)
    column, text, fixed = (lambda c: Value(column=c)), (lambda e: Value(expression=e)), (lambda v: Value(literal=v, is_literal=True))
    mappings = (
        Mapping("id", column("o_orderkey"), column("o_orderkey"), key=True),
        Mapping("status", text("upper(o_orderstatus)"), text("upper(trim(o_orderstatus))")),
        Mapping("origin", fixed("a"), fixed("a")),
        Mapping("price", column("o_totalprice"), column("o_totalprice"), compare=False),
    )
    return compare(spark, Comparison(frame(s), frame(t), Strategy("join"), mappings)).diff.drop("changed")


@query("SELECT o_orderkey AS id, upper(o_orderstatus) AS status, 7 AS fixed FROM orders")
def mapped_projection(spark, d):
    mappings = (Mapping("id", Value(column="o_orderkey"), Value(column="o_orderkey"), key=True), Mapping("status", Value(expression="upper(o_orderstatus)"), Value(column="o_orderstatus")), Mapping("fixed", Value(literal=7, is_literal=True), Value(literal=7, is_literal=True)))
    rows = frame(table(spark, d, "orders"))
    return prepare(spark, Comparison(rows, rows, mappings=mappings)).source


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1), t AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY 1)
  SELECT CASE WHEN t.o_custkey IS NULL THEN 'target_missing' ELSE 'mismatch' END AS operation, s.o_custkey, s.n AS n_1, t.n AS n_2, s.top AS top_1, t.top AS top_2
  FROM s LEFT JOIN t ON s.o_custkey = t.o_custkey WHERE t.o_custkey IS NULL OR s.n <> t.n OR s.top <> t.top""")
def sql_resource_aggregate_diff(spark, d):
    """A detail table against an aggregate of it, each as an SQL resource."""
    path = f"parquet.`{d}/orders.parquet`"
    text = "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM {} {} GROUP BY o_custkey"
    sides = [Side(Resource("sql", text.format(path, w)), keys=("o_custkey",)) for w in ("", "WHERE o_orderkey % 97 <> 0")]
    return compare(spark, Comparison(*sides, Strategy("join"))).diff.drop("changed")


@query(f"""WITH {D_SQL} SELECT operation, o_orderkey, o_orderstatus_1, o_orderstatus_2 FROM (WITH s AS (SELECT * FROM ({S_SQL}) WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')),
  t AS (SELECT * FROM ({T_SQL}) WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')) SELECT CASE WHEN t.o_orderkey IS NULL THEN 'target_missing' WHEN s.o_orderkey IS NULL THEN 'source_missing' ELSE 'mismatch' END AS operation,
  coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, s.o_orderstatus AS o_orderstatus_1, t.o_orderstatus AS o_orderstatus_2 FROM s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey WHERE s.o_orderstatus IS DISTINCT FROM t.o_orderstatus)""")
def filtered_diff(spark, d):
    s, t = both(spark, d)
    text = "o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')"
    sides = [frame(x, keys=("o_orderkey",), columns=("o_orderstatus",), filter=text) for x in (s, t)]
    return compare(spark, Comparison(*sides, Strategy("join"))).diff.drop("changed")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'it''s', 'O') AND o_orderdate >= TIMESTAMP '1995-03-01' AND NOT (o_totalprice BETWEEN 1000.5 AND 90000 OR o_custkey IS NULL)")
def literal_filter(spark, d):
    """A filter of written literals, checked before it reaches the scan."""
    a, b, c, day, low, high = (literal(x) for x in ("F", "it's", "O", date(1995, 3, 1), 1000.5, 90000))
    text = f"o_orderstatus IN ({a}, {b}, {c}) AND o_orderdate >= {day.removeprefix('DATE ')} AND NOT (o_totalprice BETWEEN {low} AND {high} OR o_custkey IS NULL)"
    return restricted(table(spark, d, "orders"), frame(None, keys=("o_orderkey",), filter=text)).select("o_orderkey", "o_totalprice")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS source_rows, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 97 <> 0) AS target_rows")
def probe_partitions(spark, d):
    """A dry run over sides whose filter must name the partition column."""
    rows = table(spark, d, "orders")
    sides = [Side(Resource("frame", frame=x, partition_columns=("o_orderstatus",)), keys=("o_orderkey",), columns=("o_totalprice",), filter="o_orderstatus = 'F'") for x in (rows, rows.where("o_orderkey % 97 <> 0"))]
    made = prepare(spark, Comparison(*sides))
    return made.source.agg(F.count(F.lit(1)).alias("source_rows")).crossJoin(made.target.agg(F.count(F.lit(1)).alias("target_rows")))


@query("SELECT column_name FROM (DESCRIBE orders)")
def schema_discovery(spark, d):
    names = schema(spark, Resource("parquet", f"{d}/orders.parquet")).names
    return spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("column_name"))


@query(f"""WITH {J_SQL} SELECT {OPERATION} AS operation, count(*) AS differences FROM j WHERE k1 IS NULL OR k2 IS NULL OR a1 IS DISTINCT FROM a2 GROUP BY 1""")
def excluded_columns_diff(spark, d):
    """All columns but excluded and derived ones are compared."""
    s, t = (x.withColumn("row_hash", F.lit(str(i))) for i, x in enumerate(both(spark, d)))
    sides = [frame(x, keys=("o_orderkey",), exclude=("o_totalprice", "o_orderdate")) for x in (s, t)]
    return stats.by_operation(compare(spark, Comparison(*sides, Strategy("join"))).diff)


@query(f"""WITH {J_SQL} SELECT coalesce(k1, k2) AS o_orderkey, b1 AS o_totalprice_1, b2 AS o_totalprice_2 FROM j WHERE k1 IS NOT NULL AND k2 IS NOT NULL AND abs(b1 - b2) / greatest(abs(b1), abs(b2), 1.0) > 0.00001""")
def tolerance_diff(spark, d):
    found = diff.join_diff(*both(spark, d), KEYS, ["o_totalprice"], {"o_totalprice": comparators.within(1e-5)})
    return found.where("operation = 'mismatch'").select("o_orderkey", "o_totalprice_1", "o_totalprice_2")


@query("""SELECT count(*) AS differences FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0""")
def shifted_time_diff(spark, d):
    """Moments eight hours apart count as equal where that is asked for; other shifts do not."""
    s = source(spark, d).select("o_orderkey", "o_orderdate")
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    t = s.select("o_orderkey", F.when(k % 11 == 0, at + F.expr("INTERVAL 8 HOURS")).when(k % 13 == 0, at + F.expr("INTERVAL 1 HOUR")).otherwise(at).alias("o_orderdate"))
    return diff.join_diff(s, t, KEYS, ["o_orderdate"], {"o_orderdate": comparators.hours_apart(8)}).agg(F.count(F.lit(1)).alias("differences"))


# -- statistics and selections ----------------------------------------------------------------------------------------------

STATS_SQL = f"""{D_SQL}, n AS (SELECT (SELECT count(*) FROM s) AS source_row_count, (SELECT count(*) FROM t) AS target_row_count, count(*) FILTER (operation = 'source_missing') AS source_missing_count,
  count(*) FILTER (operation = 'target_missing') AS target_missing_count, count(*) FILTER (operation = 'mismatch') AS mismatch_count, count(*) AS total_differences FROM d)"""
STATS_ROW = """source_row_count, target_row_count, source_missing_count, target_missing_count, mismatch_count, total_differences, least(source_row_count, target_row_count) - mismatch_count AS unchanged_count,
  round(total_differences / greatest(source_row_count, target_row_count), 9) AS difference_percentage, round((source_row_count - total_differences) * 100.0 / source_row_count, 2)::double AS accuracy_rate, 'DIFF' AS status"""


@query(f"WITH {STATS_SQL} SELECT {STATS_ROW} FROM n")
def accuracy_stats(spark, d):
    s, t = both(spark, d)
    return stats.statistics(diff.join_diff(s, t, KEYS, COLUMNS), s, t).withColumn("difference_percentage", F.round("difference_percentage", 9))


@query(f"WITH {STATS_SQL}, m AS (SELECT source_row_count, target_row_count, 2 * source_missing_count AS source_missing_count, 2 * target_missing_count AS target_missing_count, 2 * mismatch_count AS mismatch_count, 2 * total_differences AS total_differences FROM n) SELECT {STATS_ROW} FROM m")
def merged_stats(spark, d):
    s, t = both(spark, d)
    one = stats.statistics(diff.join_diff(s, t, KEYS, COLUMNS), s, t)
    return stats.merged(one.unionByName(one)).withColumn("difference_percentage", F.round("difference_percentage", 9))


@query(f"WITH {D_SQL} SELECT * FROM d ORDER BY o_orderkey, operation LIMIT 20")
def top_n_diffs(spark, d):
    return _plain(stats.top(_join(spark, d), KEYS, 20))


@query(f"WITH {D_SQL} SELECT operation, count(*) AS differences FROM d GROUP BY 1")
def diffs_by_operation(spark, d):
    return stats.by_operation(_join(spark, d))


@query(f'WITH {D_SQL} SELECT unnest(string_split(changed, \',\')) AS "column", count(*) AS differences FROM d WHERE operation = \'mismatch\' GROUP BY 1')
def diffs_by_column(spark, d):
    return stats.by_column(_join(spark, d))


# -- patterns -----------------------------------------------------------------------------------------------------------------

PC_SQL = """SELECT event_id, CASE WHEN event_id % 31 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS ts, CASE WHEN event_id % 37 = 0 THEN value + 0.125 ELSE value END AS value,
  CASE WHEN event_id % 41 = 0 THEN substr(name, 1, 3) WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 47 = 0 THEN name || '?' ELSE name END AS name FROM p WHERE event_id % 17 <> 0"""
PP_SQL = "p AS (SELECT event_id, ts, value, CASE WHEN event_id % 2 = 0 THEN 'é' || event_type ELSE event_type END AS name FROM events)"


def _events(spark, d):
    e = F.col("event_id")
    p = table(spark, d, "events").select("event_id", "ts", "value", F.when(e % 2 == 0, F.concat(F.lit("é"), "event_type")).otherwise(F.col("event_type")).alias("name"))
    name = F.when(e % 41 == 0, F.substring("name", 1, 3)).when(e % 43 == 0, F.lit(None)).when(e % 47 == 0, F.concat("name", F.lit("?"))).otherwise(F.col("name"))
    t = p.where(e % 17 != 0).select("event_id", F.when(e % 31 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")).alias("ts"), F.when(e % 37 == 0, F.col("value") + 0.125).otherwise(F.col("value")).alias("value"), name.alias("name"))
    return p, t


_PATTERN_ROWS = f"""WITH {PP_SQL}, q AS ({PC_SQL}), j AS (SELECT p.ts AS ts1, q.ts AS ts2, p.value AS v1, q.value AS v2, p.name AS n1, q.name AS n2, q.event_id IS NULL AS gone FROM p LEFT JOIN q USING (event_id)),
  m AS (SELECT * FROM j WHERE NOT gone AND (ts1 <> ts2 OR v1 <> v2 OR n1 IS DISTINCT FROM n2))"""


def _pattern(name: str, where: str, columns: str, least: float, step: float, most: float, hint: str) -> None:
    def run(spark, d):
        found = analyze.analyze(diff.join_diff(*_events(spark, d), ["event_id"], ["ts", "value", "name"]), ["ts", "value", "name"])
        return found.where(F.col("pattern") == name).withColumn("confidence", F.round("confidence", 6))

    run.__name__ = f"pattern_{name.lower()}"
    query(f"""{_PATTERN_ROWS} SELECT '{name}' AS pattern, count(*) AS affected_rows, round(least({most}, {least} + {step} * count(*)), 6)::double AS confidence, '{columns}' AS affected_columns, '{hint.replace("'", "''")}' AS repair_hint FROM m WHERE {where} HAVING count(*) > 0""")(run)


_LONGER = "(length(x1) > length(x2) AND x2 <> '' AND starts_with(x1, x2))"
for _name, _where, _columns in (
    ("TIME_DRIFT", "true", "ts"),
    ("PRECISION_LOSS", "abs(v1 - v2) > 0 AND abs(v1 - v2) < 1", "value"),
    ("ENCODING_ISSUE", "n1 <> n2 AND length(n1) <> length(n2) AND regexp_matches(n1, '[^\\x00-\\x7F]')", "name"),
    ("NULL_HANDLING", "(coalesce(n1, '') = '') <> (coalesce(n2, '') = '')", "name"),
    ("TRUNCATION", _LONGER.replace("x", "n") + " OR " + _LONGER.replace("x1", "v1::varchar").replace("x2", "v2::varchar"), "name"),
):
    _pattern(_name, _where, _columns, *analyze.CONFIDENCE[_name], analyze.HINTS[_name])


@query(f"""{_PATTERN_ROWS}, a AS (SELECT (SELECT count(*) FROM m) + count(*) FILTER (gone) AS total, count(*) FILTER (gone) AS missing FROM j)
  SELECT 'TIME_WINDOW' AS pattern, missing AS affected_rows, round(least(0.8, 0.4 + missing / total), 6)::double AS confidence, '' AS affected_columns, '{analyze.HINTS["TIME_WINDOW"]}' AS repair_hint FROM a WHERE missing >= 0.05 * total""")
def pattern_time_window(spark, d):
    found = analyze.analyze(diff.join_diff(*_events(spark, d), ["event_id"], ["ts", "value", "name"]), ["ts", "value", "name"])
    return found.where("pattern = 'TIME_WINDOW'").withColumn("confidence", F.round("confidence", 6))


_EVERY = " UNION ALL ".join(f"SELECT * FROM ({ORACLE_SQL[f'pattern_{n.lower()}']})" for n in (*analyze.PATTERNS, "TIME_WINDOW"))


@query(f"SELECT round(avg(confidence), 4) AS confidence, count(*) AS patterns, count(DISTINCT repair_hint) AS hints FROM ({_EVERY})")
def analyzer_summary(spark, d):
    found = diff.join_diff(*_events(spark, d), ["event_id"], ["ts", "value", "name"])
    told = analyze.summary(analyze.analyze(found, ["ts", "value", "name"]), found.count())
    return spark.range(1).select(F.lit(round(told["confidence"], 4)).alias("confidence"), F.lit(len(told["patterns"])).cast("long").alias("patterns"), F.lit(len(told["hints"])).cast("long").alias("hints"))


# -- repair and output ------------------------------------------------------------------------------------------------------------

_CENTS = "(o_totalprice * 100)::bigint"


def _cents(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))


def _repair_sql(fix: str) -> str:
    side, lacking = ("1", "target_missing") if fix == "target" else ("2", "source_missing")
    text = f"coalesce('''' || a{side} || '''', 'NULL')"
    return f"""WITH s AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice * 100)::bigint AS cents FROM ({S_SQL})), t AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice * 100)::bigint AS cents FROM ({T_SQL})),
    j AS (SELECT s.o_orderkey AS k1, t.o_orderkey AS k2, s.o_orderstatus AS a1, t.o_orderstatus AS a2, s.cents AS b1, t.cents AS b2 FROM s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey),
    d AS (SELECT *, {OPERATION} AS operation, coalesce(k1, k2) AS k FROM j WHERE {DIFFERS})
    SELECT operation, k AS o_orderkey, CASE operation WHEN 'mismatch' THEN 'UPDATE orders SET ' || concat_ws(', ', CASE WHEN a1 IS DISTINCT FROM a2 THEN '`o_orderstatus` = ' || {text} END, CASE WHEN b1 IS DISTINCT FROM b2 THEN '`cents` = ' || b{side} END) || ' WHERE `o_orderkey` = ' || k
    WHEN '{lacking}' THEN 'INSERT INTO orders (`o_orderkey`, `o_orderstatus`, `cents`) VALUES (' || k || ', ' || {text} || ', ' || b{side} || ')' ELSE 'DELETE FROM orders WHERE `o_orderkey` = ' || k END AS statement FROM d"""


def _repair(fix: str) -> None:
    def run(spark, d):
        s, t = (_cents(x) for x in both(spark, d))
        return repair.repair_sql(diff.join_diff(s, t, KEYS, ["o_orderstatus", "cents"]), KEYS, ["o_orderstatus", "cents"], "orders", fix)

    run.__name__ = "repair_sql" if fix == "target" else "repair_sql_source"
    query(_repair_sql(fix))(run)


_repair("target")
_repair("source")


@query("SELECT 0::bigint AS differences_left")
def repaired_target(spark, d):
    """The target with all differences applied equals the source."""
    s, t = both(spark, d)
    mended = repair.repaired(t, diff.join_diff(s, t, KEYS, COLUMNS), KEYS, COLUMNS)
    return diff.join_diff(s, mended, KEYS, COLUMNS).agg(F.count(F.lit(1)).alias("differences_left"))


_FLAT = """CASE WHEN operation = 'mismatch' THEN '[' || list_aggregate(list_transform(string_split(changed, ','), lambda x: '"' || x || '"'), 'string_agg', ',') || ']' END"""


@query(f"WITH {D_SQL} SELECT 'run1' AS nl_dq_execution_id, operation AS nl_dq_diff_type, {_FLAT} AS nl_dq_diff_columns1, {_FLAT} AS nl_dq_diff_columns2, o_orderkey, o_orderstatus_1, o_orderstatus_2, o_totalprice_1, o_totalprice_2 FROM d")
def sink_flat_layout(spark, d):
    return diff.flat(_join(spark, d), KEYS, COLUMNS, "run1")


@query(f"WITH {D_SQL} SELECT operation || ':' || o_orderkey AS tag, CASE WHEN operation <> 'source_missing' THEN o_orderkey END AS source_key, o_orderstatus_1 AS before, coalesce(o_orderstatus_2, 'none') AS after, 'run1/' || changed AS run_changed, '' AS \"unknown\" FROM d")
def interpolated_columns(spark, d):
    outputs = [Output("tag", "${operation}:${primaryKey}"), Output("source key", "${src.o_orderkey}"), Output("before", "${src.o_orderstatus}"), Output("after", "${tgt.o_orderstatus}", default="none"), Output("run-changed", "${taskId}/${changedColumns}"), Output("unknown", "${nothing}")]
    return project(_join(spark, d), outputs, diff_places(KEYS, COLUMNS, {"taskId": "run1"}))


@query(f"WITH {STATS_SQL} SELECT 'DIFF: ' || total_differences AS line, mismatch_count AS mismatches, source_row_count || '/' || target_row_count AS rows FROM n")
def interpolated_result(spark, d):
    s, t = both(spark, d)
    outputs = [Output("line", "${status}: ${totalDifferences}"), Output("mismatches", "${mismatchCount}"), Output("rows", "${sourceRowCount}/${targetRowCount}")]
    return project(stats.statistics(diff.join_diff(s, t, KEYS, COLUMNS), s, t), outputs, result_places())


@query(f"""WITH {D_SQL} SELECT operation, o_orderkey::varchar AS primary_key, changed AS changed_columns1, replace(changed, 'o_', 't_') AS changed_columns2, CASE WHEN operation <> 'source_missing' THEN o_orderstatus_1 END AS source_status, CASE WHEN operation <> 'target_missing' THEN o_orderstatus_2 END AS target_status FROM d""")
def diff_records(spark, d):
    """The nested layout, of a target whose columns have other names."""
    s, t = both(spark, d)
    renamed = t.select("o_orderkey", F.col("o_orderstatus").alias("t_orderstatus"), F.col("o_totalprice").alias("t_totalprice"))
    sides = (frame(s, keys=("o_orderkey",), columns=("o_orderstatus", "o_totalprice")), frame(renamed, keys=("o_orderkey",), columns=("t_orderstatus", "t_totalprice")))
    rows = compare(spark, Comparison(*sides, Strategy("join"))).records
    return rows.select("operation", F.array_join("primary_key", ",").alias("primary_key"), F.array_join("changed_columns1", ",").alias("changed_columns1"), F.array_join("changed_columns2", ",").alias("changed_columns2"), rows.source_values["o_orderstatus"].alias("source_status"), rows.target_values["t_orderstatus"].alias("target_status"))


@query(f"WITH {D_SQL} SELECT operation, o_orderkey, changed FROM d WHERE o_orderkey IN (SELECT o_orderkey FROM ({S_SQL}) WHERE o_orderdate >= TIMESTAMP '1996-01-01' UNION SELECT o_orderkey FROM ({T_SQL}) WHERE o_orderdate >= TIMESTAMP '1996-01-01')")
def incremental_diff(spark, d):
    """Differences of the keys that were updated since a moment, as the streaming check finds them."""
    from paritas.streaming.incremental import changed_diff

    s, t = both(spark, d)
    keys = s.unionByName(t).where(time_window("o_orderdate", datetime(1996, 1, 1), None)).select("o_orderkey")
    return _plain(changed_diff(keys, s, t, KEYS, COLUMNS)).select("operation", "o_orderkey", "changed")


@query(f"""WITH {STATS_SQL} SELECT 'run1' AS nl_dq_execution_id, 'orders' AS src_table, 'copy' AS tgt_table, total_differences AS diff_count, source_missing_count AS src_missing, target_missing_count AS tgt_missing,
  mismatch_count, 'DIFF' AS run_status, '2024-05-06 07:08:09' AS completed_at FROM n""")
def table_result(spark, d):
    """The row that a table of results gets."""
    s, t = both(spark, d)
    task = writers.Task("run1", "orders", "copy", started=datetime(2024, 5, 6, 7, 8, 9))
    return writers.result_row(stats.statistics(diff.join_diff(s, t, KEYS, COLUMNS), s, t), task)


@query(f"""WITH {D_SQL} SELECT upper(operation) AS operation, o_orderkey::varchar AS primary_key, changed AS changed_columns1, changed AS changed_columns2, CASE WHEN operation <> 'source_missing' THEN o_orderstatus_1 END AS source_status,
  CASE WHEN operation <> 'target_missing' THEN o_orderstatus_2 END AS target_status, 'run1:' || o_orderkey AS tag FROM d""")
def merged_defaults(spark, d):
    """Outputs beside the default columns: one takes a default's place, one is added."""
    places = diff_places(KEYS, COLUMNS, {"taskId": "run1"}) | {"loud": F.upper("operation")}
    rows = project(_join(spark, d), [Output("operation", "${loud}"), Output("tag", "${taskId}:${primaryKey}")], places, diff.record_columns(KEYS, COLUMNS))
    texts = [F.array_join(c, ",").alias(c) for c in ("primary_key", "changed_columns1", "changed_columns2")]
    return rows.select("operation", *texts, rows.source_values["o_orderstatus"].alias("source_status"), rows.target_values["o_orderstatus"].alias("target_status"), "tag")
