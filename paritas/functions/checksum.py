"""Row hashes and segment checksums over canonical text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"


def row_hash(texts: Sequence[Column]) -> Column:
    """MD5 of a row's canonical texts as other systems write it: a separator within a value, or a null, can make two rows
    alike. Where rows are skipped for equal hashes, use exact_hash.
    """
    return F.md5(F.concat_ws(SEPARATOR, *texts))


def exact_hash(texts: Sequence[Column]) -> Column:
    """MD5 of a row's canonical texts, each behind its length, nulls marked: equal only for equal texts, but for collisions."""
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def key_text(texts: Sequence[Column]) -> Column:
    return F.concat_ws(SEPARATOR, *texts)


def concat_checksum(key: Column, hashed: Column) -> Column:
    """Aggregate: MD5 of the row hashes in order of the key texts; empty text without rows.

    All row hashes of a group reach one task, so that groups must be bounded: use it by bucket, or xor_checksum.
    """
    pairs = F.array_sort(F.collect_list(F.struct(key.alias("k"), hashed.alias("h"))))
    joined = F.array_join(F.transform(pairs, lambda p: p["h"]), SEPARATOR)
    return F.when(F.count(F.lit(1)) == 0, F.lit("")).otherwise(F.md5(joined))


def _half(hashed: Column, start: int) -> Column:
    value = F.conv(F.substring(hashed, start, 8), 16, 10).cast("bigint")
    return F.lpad(F.hex(F.coalesce(F.bit_xor(value), F.lit(0).cast("bigint"))), 8, "0")


def xor_checksum(hashed: Column) -> Column:
    """Aggregate: exclusive-or of the first 64 bits of the row hashes, as 16 upper-case hex digits; '0' without rows.

    Mergeable, so that each task sends one value a group. Pairs of equal rows cancel: compare counts too.
    """
    return F.when(F.count(F.lit(1)) == 0, F.lit("0")).otherwise(F.concat(_half(hashed, 1), _half(hashed, 9)))


def sum_checksum(hashed: Column) -> Column:
    """Aggregate: a sum that equal rows do not cancel from, beside xor_checksum."""
    return F.coalesce(F.sum(F.conv(F.substring(hashed, 17, 8), 16, 10).cast("bigint")), F.lit(0).cast("bigint"))


def bucket(keys: Sequence[Column], n: int) -> Column:
    """The bucket of a row by its key texts, the same on both sides; n bounds what a join of digests broadcasts."""
    return F.pmod(F.conv(F.substring(F.md5(key_text(keys)), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")
