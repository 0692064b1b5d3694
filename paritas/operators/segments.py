"""Bounds, ranges and samples of keys: the pieces in which large relations are examined."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paritas.functions import checksum
from paritas.functions.predicates import after_key, key_range

#: Ranges of keys that a walk numbers apart.
RANGES = 512


def row_count(df: DataFrame, condition: Column | None = None) -> DataFrame:
    return (df if condition is None else df.where(condition)).agg(F.count(F.lit(1)).alias("row_count"))


def key_bounds(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """row_count, and each key of the least and greatest row in lexicographic order, in one aggregate."""
    if len(keys) == 1:
        return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(keys[0]).alias(f"min_{keys[0]}"), F.max(keys[0]).alias(f"max_{keys[0]}"))
    whole = F.struct(*keys)
    known = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    made = known.agg(F.count(F.lit(1)).alias("row_count"), F.min(whole).alias("low"), F.max(whole).alias("high"))
    return made.select("row_count", *[F.col(f"low.{k}").alias(f"min_{k}") for k in keys], *[F.col(f"high.{k}").alias(f"max_{k}") for k in keys])


def distinct_count(df: DataFrame, columns: Sequence[str], approximate: bool = False, error: float = 0.02) -> DataFrame:
    made = F.approx_count_distinct(F.struct(*columns), error) if approximate else F.count_distinct(*columns)
    return df.agg(made.alias("distinct_count"))


def page(df: DataFrame, keys: Sequence[str], size: int, last: Sequence[object] | None = None) -> DataFrame:
    """The next size rows after the key last, in key order."""
    return (df if last is None else df.where(after_key(keys, last))).orderBy(*keys).limit(size)


def page_at(df: DataFrame, keys: Sequence[str], size: int, offset: int) -> DataFrame:
    """size rows from an offset in key order. A seek with page() reads less."""
    return df.orderBy(*keys).offset(offset).limit(size)


def key_at(df: DataFrame, keys: Sequence[str], offset: int) -> DataFrame:
    """The key of the row at an offset in key order."""
    return page_at(df.select(*keys), keys, 1, offset)


def range_boundaries(low: int, high: int, n: int) -> list[int]:
    """Inner boundaries of n ranges of equal width that cover low to high, each once."""
    width = high - low + 1
    return sorted({low + width * i // n for i in range(1, n)} - {low})


def range_segments(df: DataFrame, key: str, low: int, high: int, n: int) -> DataFrame:
    """(segment, row_count, min_key, max_key) of n ranges of equal width of a whole-number key; half open, so that none overlap.

    Rows below low are in segment 0, and above high in the last.
    """
    cuts = range_boundaries(low, high, n)
    at = F.lit(0)
    for c in cuts:
        at = at + (F.col(key) >= F.lit(c)).cast("int")
    return _by_segment(df, key, at)


def _by_segment(df: DataFrame, key: str, segment: Column) -> DataFrame:
    return df.groupBy(segment.alias("segment")).agg(F.count(F.lit(1)).alias("row_count"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def depth_boundaries(df: DataFrame, key: str, n: int, accuracy: int = 10_000) -> list:
    """Inner boundaries of n ranges with about equally many rows; of keys that have no quantiles, such as texts, those of the
    sample by which Spark itself cuts ranges.
    """
    if not isinstance(df.schema[key].dataType, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType):
        cuts = df.select(F.col(key).alias("k")).where("k is not null").repartitionByRange(n, "k").groupBy(F.spark_partition_id()).agg(F.max("k").alias("k")).collect()
        return sorted(r["k"] for r in cuts)[:-1]
    found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], accuracy).alias("cuts")).first()["cuts"] or []
    return sorted(set(found))


def sampled_segments(df: DataFrame, key: str, n: int, accuracy: int = 10_000) -> DataFrame:
    """(segment, row_count, min_key, max_key) of n ranges with about equally many rows each; all rows of a key are in one."""
    at = F.lit(0)
    for c in depth_boundaries(df, key, n, accuracy):
        at = at + (F.col(key) > F.lit(c)).cast("int")
    return _by_segment(df, key, at)


def depth_segments(df: DataFrame, key: str, n: int, accuracy: int = 10_000) -> DataFrame:
    """(segment, row_count, min_key, max_key) of n ranges in key order, nulls last, of which the first i end with row
    ceil(i * rows / n). A repeated key may be in several. accuracy is that of the ranges in which keys are placed, which
    changes no result.
    """
    placed = _placed(df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("rows")), depth_boundaries(df, key, RANGES, accuracy))
    total = df.count()
    ends = [-(-i * total // n) for i in range(n + 1)]
    ranges = F.array(*[F.struct(F.lit(i).alias("segment"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))])
    inside = F.least(F.col("start") + F.col("rows"), F.col("range.b")) - F.greatest(F.col("start"), F.col("range.a"))
    met = placed.select("*", F.explode(ranges).alias("range")).select(F.col("range.segment").alias("segment"), "k", inside.alias("inside")).where("inside > 0")
    return met.groupBy("segment").agg(F.sum("inside").alias("row_count"), F.min("k").alias("min_key"), F.max("k").alias("max_key"))


def _placed(counts: DataFrame, cuts: Sequence[object]) -> DataFrame:
    """(k, rows, start): the rows before each key of counts (k, rows) in key order, a null key last.

    A key's first place is the rows of all ranges of keys before its own, plus those before it in its range: only the ranges'
    totals, one more than cuts at most, meet in one task. cuts are sorted, and a key's range is found by halving.
    """
    at = F.lit(0)
    if cuts:
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
        known = F.array(*[F.lit(c) for c in cuts])
        at = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(known, n + step - 1) < F.col("k"), step).otherwise(0))
    known = counts.withColumn("part", F.when(F.col("k").isNull(), len(cuts) + 1).otherwise(at))
    totals = known.groupBy("part").agg(F.sum("rows").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    own = F.sum("rows").over(Window.partitionBy("part").orderBy("k")) - F.col("rows")
    return known.join(F.broadcast(before), "part").select("k", "rows", (F.col("before") + own).alias("start"))


def _by_range(df: DataFrame, key: str, n: int) -> DataFrame:
    low, high = df.agg(F.min(key), F.max(key)).first()
    return range_segments(df, key, low or 0, high or 0, n)


#: Ways to cut a key into segments; register() adds more.
STRATEGIES: dict[str, Callable[[DataFrame, str, int], DataFrame]] = {"range": _by_range, "row-sample": sampled_segments}


def register(name: str, strategy: Callable[[DataFrame, str, int], DataFrame]) -> None:
    if name in STRATEGIES:
        raise ValueError(f"there is a segment strategy {name} already")
    STRATEGIES[name] = strategy


def choose(df: DataFrame, key: str, strategy: str = "auto") -> str:
    """The strategy that cuts this key: range needs whole numbers, and gives way to row-sample where they are none."""
    if strategy != "auto" and strategy not in STRATEGIES:
        raise ValueError(f"no segment strategy {strategy!r}; there are auto, {', '.join(STRATEGIES)}")
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    if strategy in ("auto", "range"):
        return "range" if whole else "row-sample"
    return strategy


def segmented(df: DataFrame, key: str, n: int, strategy: str = "auto") -> DataFrame:
    """(segment, row_count, min_key, max_key) of n segments by the chosen strategy."""
    return STRATEGIES[choose(df, key, strategy)](df, key, n)


def walk(df: DataFrame, key: str, size: int) -> DataFrame:
    """(segment, row_count, min_key, max_key) of pages of size rows in key order, as a walk from last key to last key finds
    them. Null keys are in no page.

    Keys are counted first, and placed by ranges. A repeated key may be in several pages.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("rows"))
    placed = _placed(counts, depth_boundaries(df, key, RANGES))
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("rows") - 1) / size)
    pages = placed.select("*", F.explode(F.sequence(first, last)).alias("segment"))
    inside = F.least(F.col("start") + F.col("rows"), (F.col("segment") + 1) * size) - F.greatest(F.col("start"), F.col("segment") * size)
    return pages.select("segment", "k", inside.alias("inside")).groupBy("segment").agg(F.sum("inside").alias("row_count"), F.min("k").alias("min_key"), F.max("k").alias("max_key"))


def adaptive_factor(rows: int, factor: int) -> int:
    """Children of a segment for so many rows: twice factor, 64 at most, beyond a million, and half of it, 4 at least, up to a
    hundred thousand.
    """
    if rows > 1_000_000:
        return min(2 * factor, 64)
    return factor if rows > 100_000 else max(factor // 2, 4)


def ranges(keys: Sequence[str], cuts: Sequence[Sequence[object]]) -> list[Column]:
    """Predicates of the half-open ranges between cuts, open at both ends, which hold every row with keys exactly once."""
    edges = [None, *cuts, None]
    return [key_range(keys, a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def segment_digests(texts: DataFrame, keys: Sequence[str], columns: Sequence[str], segment: Column, algorithm: str = "xor") -> DataFrame:
    """(segment, row_count, checksum) of text by segment."""
    h = checksum.row_hash([F.col(c) for c in (*keys, *columns)])
    rows = texts.select(segment.alias("segment"), checksum.key_text([F.col(k) for k in keys]).alias("k"), h.alias("h"))
    made = checksum.xor_checksum(F.col("h")) if algorithm == "xor" else checksum.concat_checksum(F.col("k"), F.col("h"))
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("row_count"), made.alias("checksum"))


def segment_trace(source: DataFrame, target: DataFrame) -> DataFrame:
    """What was decided for each segment, from both sides' digests: skip_empty, skip_equal or compare."""
    s = source.select("segment", F.col("row_count").alias("source_rows"), F.col("checksum").alias("source_checksum"))
    t = target.select("segment", F.col("row_count").alias("target_rows"), F.col("checksum").alias("target_checksum"))
    both = s.join(t, "segment", "full_outer")
    rows = [F.coalesce(c, F.lit(0)) for c in ("source_rows", "target_rows")]
    same = (rows[0] == rows[1]) & F.col("source_checksum").eqNullSafe(F.col("target_checksum"))
    decision = F.when((rows[0] == 0) & (rows[1] == 0), F.lit("skip_empty")).when(same, F.lit("skip_equal")).otherwise(F.lit("compare"))
    return both.select("segment", rows[0].alias("source_rows"), rows[1].alias("target_rows"), "source_checksum", "target_checksum", decision.alias("decision"))


def segment_statistics(counts: DataFrame) -> DataFrame:
    """Of segments' row_count: how many segments, least, greatest, mean, coefficient of variation, and quality = 1 - cv in 0..1."""
    made = counts.agg(
        F.count(F.lit(1)).alias("segments"), F.sum("row_count").alias("rows"), F.min("row_count").alias("min_rows"), F.max("row_count").alias("max_rows"),
        F.avg("row_count").alias("avg_rows"), (F.stddev_pop("row_count") / F.avg("row_count")).alias("cv"),
    )
    return made.withColumn("quality", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("cv"))))


def distribution(df: DataFrame, key: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, row_count, density) of a numeric key between low and high: a histogram of equal widths."""
    at = F.least(F.lit(bins), F.width_bucket(F.col(key).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins).cast("bigint")))
    width = (high - low) / bins
    return df.where(F.col(key).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("row_count"), (F.count(F.lit(1)) / F.lit(width)).alias("density"))


def estimated_size(low: Sequence[int], high: Sequence[int]) -> int:
    """Keys that a range of whole numbers can hold, by the product of its sides."""
    return reduce(lambda a, b: a * b, [max(0, h - b + 1) for b, h in zip(low, high, strict=True)], 1)


def bucket_number(rows: int, per_bucket: int = 50_000, most: int = 100_000) -> int:
    """Buckets for digests of so many rows; bounded, as digests are broadcast."""
    return max(1, min(most, -(-rows // per_bucket)))
