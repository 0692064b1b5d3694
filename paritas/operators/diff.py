"""Row differences of two prepared relations.

Every strategy gives one lazy frame: operation (mismatch, source_missing, target_missing), the keys under their names,
`<column>_1` and `<column>_2` for both sides' compared columns, and changed (names of the columns that differ). The
strategies differ in what counts as equal and in what repeated keys mean:

- join: raw values, null-safe; a null key matches nothing; rows of a repeated key are compared each with each.
- checksum, full: canonical text, trimmed; rows of a key that is repeated on either side are all missing on the other
  side, unless each side has one.
- checksum, row-hash: canonical text without trimming; of rows with one key the one of largest hash counts.
- merge: record text; repeated keys on both sides are an error where validation is asked for, else as in checksum, full.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritas.functions import checksum
from paritas.functions.comparators import Equal, exact
from paritas.functions.normalize import Rules, normalize, record
from paritas.functions.predicates import any_differs

MISMATCH, SOURCE_MISSING, TARGET_MISSING = "mismatch", "source_missing", "target_missing"


def _sided(df: DataFrame, keys: Sequence[str], columns: Sequence[str], side: str) -> DataFrame:
    """df with names of one side only, and a marker that tells a row from the nulls of an outer join."""
    return df.select(*[F.col(k).alias(f"{side}k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"{side}c{i}") for i, c in enumerate(columns)], F.lit(True).alias(f"{side}here"))


def _classified(joined: DataFrame, keys: Sequence[str], columns: Sequence[str], equal: Mapping[str, Equal]) -> DataFrame:
    """The differing rows of a full outer join of two sided frames."""
    same = [equal.get(c, exact)(F.col(f"sc{i}"), F.col(f"tc{i}")) for i, c in enumerate(columns)]
    changed = F.array_compact(F.array(*[F.when(~x, F.lit(c)) for c, x in zip(columns, same, strict=True)])) if columns else F.array().cast("array<string>")
    operation = F.when(F.col("there").isNull(), F.lit(TARGET_MISSING)).when(F.col("shere").isNull(), F.lit(SOURCE_MISSING)).otherwise(F.lit(MISMATCH))
    differs = reduce(lambda a, b: a | b, [~x for x in same], F.lit(False))
    found = joined.where(F.col("shere").isNull() | F.col("there").isNull() | differs)
    both = F.col("shere").isNotNull() & F.col("there").isNotNull()
    return found.select(
        operation.alias("operation"),
        *[F.coalesce(f"sk{i}", f"tk{i}").alias(k) for i, k in enumerate(keys)],
        *[x for i, c in enumerate(columns) for x in (F.col(f"sc{i}").alias(f"{c}_1"), F.col(f"tc{i}").alias(f"{c}_2"))],
        F.when(both, changed).otherwise(F.array().cast("array<string>")).alias("changed"),
    )


def _on(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"sk{i}") == F.col(f"tk{i}") for i in range(len(keys))]


def join_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str], equal: Mapping[str, Equal] | None = None) -> DataFrame:
    """One full outer join on the raw keys."""
    joined = _sided(source, keys, columns, "s").join(_sided(target, keys, columns, "t"), _on(keys), "full_outer")
    return _classified(joined, keys, columns, equal or {})


def join_diff_by_parts(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """join_diff as an inner join and two anti joins, for stores without a full outer join."""
    s, t = _sided(source, keys, columns, "s"), _sided(target, keys, columns, "t")
    inner = s.join(t, _on(keys), "inner").where(any_differs([(F.col(f"sc{i}"), F.col(f"tc{i}")) for i in range(len(columns))]))
    only_s, only_t = s.join(t, _on(keys), "left_anti"), t.join(s, _on(keys), "left_anti")
    parts = inner.unionByName(only_s, allowMissingColumns=True).unionByName(only_t, allowMissingColumns=True)
    return _classified(parts, keys, columns, {})


def join_stats(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row of counts over the full outer join."""
    joined = _sided(source, keys, columns, "s").join(_sided(target, keys, columns, "t"), _on(keys), "full_outer")
    s, t = F.col("shere").isNotNull(), F.col("there").isNotNull()
    differs = any_differs([(F.col(f"sc{i}"), F.col(f"tc{i}")) for i in range(len(columns))])
    return joined.agg(
        F.count_if(s).alias("source_count"),
        F.count_if(t).alias("target_count"),
        F.count_if(~s).alias("source_missing"),
        F.count_if(~t).alias("target_missing"),
        F.count_if(s & t & differs).alias("mismatch"),
    )


# -- canonical text ---------------------------------------------------------------------------------------------------


def normalized(df: DataFrame, columns: Sequence[str], rules: Rules | None = None, strict_nulls: bool = False, write: Callable | None = None) -> DataFrame:
    """The columns of df as canonical text, under their names."""
    types = {f.name: f.dataType for f in df.schema}
    one = write or (lambda c, t: normalize(c, t, rules, strict_nulls))
    return df.select([one(F.col(c), types[c]).alias(c) for c in columns])


def _one_to_one(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str], equal: Mapping[str, Equal], validate: bool = False) -> DataFrame:
    """Differences where rows pair one to one, and all rows of other keys as missing.

    Both sides' rows move once, to a window over the keys in which a source row finds its partner next to it: no join, and
    repeated keys are counted on the way. A hot repeated key is one task's work, as for every window; its rows spill and
    leave one by one, so that memory is bounded, but not that task's time.
    """
    names = [f"k{i}" for i in range(len(keys))]

    def sided(df: DataFrame, side: int) -> DataFrame:
        return df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.struct(F.lit(side).alias("side"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"), F.lit(side).alias("side"))

    together = sided(source, 0).unionByName(sided(target, 1))
    ordered = Window.partitionBy(*names).orderBy("side")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = together.select("*", F.count_if(F.col("side") == 0).over(whole).alias("n0"), F.count_if(F.col("side") == 1).over(whole).alias("n1"), F.lead("row").over(ordered).alias("next"))
    known = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    if validate:
        bad = counted.where(known & (F.col("n0") > 0) & (F.col("n1") > 0) & (F.col("n0") + F.col("n1") > 2)).select(*names).limit(1).collect()
        if bad:
            raise ValueError(f"a key is repeated: {', '.join(map(str, bad[0]))}")
    paired = known & (F.col("n0") == 1) & (F.col("n1") == 1)
    rows = counted.where(~(paired & (F.col("side") == 1)))
    mine = F.when(F.col("side") == 0, F.col("row"))
    theirs = F.when(paired, F.col("next")).when(F.col("side") == 1, F.col("row"))
    joined = rows.select(*[F.col(n).alias(f"s{n}") for n in names], *[F.col(n).alias(f"t{n}") for n in names], mine.alias("mine"), theirs.alias("theirs"))
    flat_ = [F.col(f"{x}.c{i}").alias(f"{y}c{i}") for x, y in (("mine", "s"), ("theirs", "t")) for i in range(len(columns))]
    here = [F.when(F.col(x).isNotNull(), F.lit(True)).alias(y) for x, y in (("mine", "shere"), ("theirs", "there"))]
    return _classified(joined.select(*[f"s{n}" for n in names], *[f"t{n}" for n in names], *flat_, *here), keys, columns, equal)


def differing_buckets(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str], n: int, algorithm: str = "xor") -> DataFrame:
    """(bucket, source_rows, target_rows, source_checksum, target_checksum) of the buckets of text keys that differ."""
    return _differing(bucket_digests(source, keys, columns, n, algorithm), bucket_digests(target, keys, columns, n, algorithm))


def _differing(s: DataFrame, t: DataFrame) -> DataFrame:
    both = s.select("bucket", F.col("row_count").alias("source_rows"), F.col("checksum").alias("source_checksum"), F.col("total").alias("source_total")).join(
        t.select("bucket", F.col("row_count").alias("target_rows"), F.col("checksum").alias("target_checksum"), F.col("total").alias("target_total")), "bucket", "full_outer"
    )
    same = F.col("source_rows").eqNullSafe(F.col("target_rows")) & F.col("source_checksum").eqNullSafe(F.col("target_checksum")) & F.col("source_total").eqNullSafe(F.col("target_total"))
    return both.where(~same).drop("source_total", "target_total")


def bucket_digests(texts: DataFrame, keys: Sequence[str], columns: Sequence[str], n: int, algorithm: str = "xor", hashed: Callable[[Sequence[Column]], Column] = checksum.row_hash) -> DataFrame:
    """(bucket, row_count, checksum, total) by bucket of the keys' text, over row hashes that hashed makes."""
    h = hashed([F.col(c) for c in (*keys, *columns)])
    rows = texts.select(checksum.bucket([F.col(k) for k in keys], n).alias("bucket"), checksum.key_text([F.col(k) for k in keys]).alias("k"), h.alias("h"))
    made = checksum.xor_checksum(F.col("h")) if algorithm == "xor" else checksum.concat_checksum(F.col("k"), F.col("h"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("row_count"), made.alias("checksum"), checksum.sum_checksum(F.col("h")).alias("total"))


def bisection(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str], factor: int = 8, levels: int = 3, threshold: int = 0) -> DataFrame:
    """(level, segment, source_rows, target_rows, decision) of the segments that a bisection of text visits, the whole first.

    skip_equal: nothing differs below; compare: the rows are compared, as they are at most threshold a side or at the last
    level; split: its factor children are visited. Each side is digested once, at the last level, and levels are rolled up
    from there: factor ** levels digests at most, whatever the number of rows.
    """
    if factor < 2 or levels < 0:
        raise ValueError("a bisection needs a factor of 2 or more, and no negative level")
    s, t = (bucket_digests(x, keys, columns, factor**levels, hashed=checksum.exact_hash).select("bucket", "row_count", F.struct("checksum", "total").alias("digest")) for x in (source, target))
    leaves = s.toDF("bucket", "n1", "d1").join(t.toDF("bucket", "n2", "d2"), "bucket", "full_outer")
    leaves = leaves.select("bucket", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n1", "n2")], (~F.col("d1").eqNullSafe(F.col("d2")) | ~F.col("n1").eqNullSafe(F.col("n2"))).alias("differs"))
    width = F.element_at(F.array(*[F.lit(factor ** (levels - i)) for i in range(levels + 1)]), F.col("level") + 1)
    nodes = leaves.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).groupBy("level", F.floor(F.col("bucket") / width).cast("int").alias("segment"))
    nodes = nodes.agg(F.sum("n1").alias("source_rows"), F.sum("n2").alias("target_rows"), F.max("differs").alias("differs"))
    # Siblings tell of their parent: it differs if one of them does, and holds the rows of all.
    siblings = Window.partitionBy("level", F.floor(F.col("segment") / factor))
    larger = F.greatest(F.sum("source_rows").over(siblings), F.sum("target_rows").over(siblings))
    nodes = nodes.withColumn("visited", (F.col("level") == 0) | (F.max("differs").over(siblings) & (larger > threshold)))
    small = (F.greatest("source_rows", "target_rows") <= threshold) | (F.col("level") == levels)
    decision = F.when(~F.col("differs"), F.lit("skip_equal")).when(small, F.lit("compare")).otherwise(F.lit("split"))
    return nodes.where("visited").select("level", "segment", "source_rows", "target_rows", decision.alias("decision"))


def checksum_diff(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str], *, source_rules: Rules | None = None, target_rules: Rules | None = None,
    strict_nulls: bool = False, buckets: int = 0, algorithm: str = "xor", local: str = "full", equal: Mapping[str, Equal] | None = None,
) -> DataFrame:
    """Differences of canonical text.

    With buckets, both sides are first reduced to a digest for each, and only rows of differing buckets are compared: the
    digests are at most that many rows, which bounds the broadcast. It reads both sides twice, and pays where rows are wide
    and most buckets equal. Digests are of exact hashes, so that only buckets of equal rows are skipped (rows of a repeated
    key among them, where both sides have the same ones).
    """
    texts = [normalized(df, (*keys, *columns), rules, strict_nulls) for df, rules in ((source, source_rules), (target, target_rules))]
    if buckets:
        differing = F.broadcast(_differing(*[bucket_digests(t, keys, columns, buckets, algorithm, checksum.exact_hash) for t in texts]).select("bucket"))
        own = checksum.bucket([F.col(k) for k in keys], buckets)
        texts = [t.withColumn("bucket", own).join(differing, "bucket", "left_semi").drop("bucket") for t in texts]
    if local == "row-hash":
        return _row_hash_diff(*texts, keys, columns)
    trim = {c: (lambda a, b: F.trim(a).eqNullSafe(F.trim(b))) for c in columns} | dict(equal or {})
    return _one_to_one(*texts, keys, columns, trim)


def _row_hash_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A full outer join of keys and row hashes; only the rows that differ there are joined with their values.

    Of a repeated key the row of largest row_hash counts; rows are told apart by exact_hash. A null key matches nothing. Hashes
    move as bytes, and only with keys: values move without theirs, which are made again where they meet the hashes.
    """
    every = [*keys, *columns]
    hashes = lambda names: F.unhex(F.concat(*[f([F.col(c) for c in names]) for f in (checksum.row_hash, checksum.exact_hash)]))
    names = [f"k{i}" for i in range(len(keys))]

    def hashed(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.max(hashes(every)).alias(f"{side}h")).select(*[F.col(n).alias(f"{side}{n}") for n in names], f"{side}h")

    joined = hashed(source, "s").join(hashed(target, "t"), _on(keys), "full_outer").where(~F.col("sh").eqNullSafe(F.col("th")))

    def fetched(df: DataFrame, side: str) -> DataFrame:
        wanted = joined.where(F.col(f"{side}h").isNotNull()).select(*[F.col(f"{side}{n}").alias(n) for n in names], F.col(f"{side}h").alias("wanted_h"))
        own = [f"v{i}" for i in range(len(every))]
        rows = df.select(*[F.col(c).alias(v) for c, v in zip(every, own, strict=True)])
        met = rows.join(wanted, [F.col(v).eqNullSafe(F.col(n)) for v, n in zip(own, names, strict=False)]).where(hashes(own) == F.col("wanted_h"))
        return met.dropDuplicates(names).select(*[F.col(v).alias(c) for c, v in zip(every, own, strict=True)])

    return join_diff(fetched(source, "s"), fetched(target, "t"), keys, columns)


def merge_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str], validate_unique_keys: bool = False) -> DataFrame:
    """Differences of record text, by a window in which the two rows of a key are neighbours."""
    texts = [normalized(df, (*keys, *columns), write=record) for df in (source, target)]
    return _one_to_one(*texts, keys, columns, {}, validate_unique_keys)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows have, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def checked(diff: DataFrame, most: int) -> DataFrame:
    """diff, or an error if it has more than most rows; counting stops one row beyond."""
    if diff.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} differences")
    return diff


# -- layouts ----------------------------------------------------------------------------------------------------------


def _map(columns: Sequence[str], names: Mapping[str, str], suffix: str) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(names.get(c, c)) for c in columns]), F.array(*[F.col(f"{c}{suffix}").cast("string") for c in columns]))


def record_columns(keys: Sequence[str], columns: Sequence[str], target_names: Mapping[str, str] | None = None) -> dict[str, Column]:
    """The columns of records, over differences."""
    names = target_names or {}
    own = F.create_map(*[x for k in columns for x in (F.lit(k), F.lit(names.get(k, k)))]) if columns else None
    renamed = F.transform("changed", lambda c: F.element_at(own, c)) if columns else F.col("changed")
    empty = F.create_map().cast("map<string,string>")
    return {
        "operation": F.col("operation"),
        "primary_key": F.array(*[F.col(k).cast("string") for k in keys]),
        "source_values": F.when(F.col("operation") != SOURCE_MISSING, _map(columns, {}, "_1") if columns else empty),
        "target_values": F.when(F.col("operation") != TARGET_MISSING, _map(columns, names, "_2") if columns else empty),
        "changed_columns1": F.col("changed"),
        "changed_columns2": renamed,
    }


def records(diff: DataFrame, keys: Sequence[str], columns: Sequence[str], target_names: Mapping[str, str] | None = None) -> DataFrame:
    """operation, primary_key, source_values, target_values, changed_columns1 and changed_columns2 (with the target's names)."""
    return diff.select([c.alias(n) for n, c in record_columns(keys, columns, target_names).items()])


def changed_text(changed: Column | str = "changed") -> Column:
    """Names of changed columns as a JSON list."""
    quoted = F.transform(changed, lambda c: F.concat(F.lit('"'), c, F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]"))


def flat(diff: DataFrame, keys: Sequence[str], columns: Sequence[str], execution_id: str | None = None) -> DataFrame:
    """The layout of tables: nl_dq_diff_type, both lists of changed columns as text, keys, and both sides' values."""
    text = F.when(F.col("operation") == MISMATCH, changed_text())
    head = [F.lit(execution_id).alias("nl_dq_execution_id")] if execution_id is not None else []
    return diff.select(*head, F.col("operation").alias("nl_dq_diff_type"), text.alias("nl_dq_diff_columns1"), text.alias("nl_dq_diff_columns2"), *keys, *[f"{c}_{i}" for c in columns for i in (1, 2)])
