"""Mixing sources to target weights.

The words of each source, in a pseudorandom order of its documents, are packed into blocks of fixed length. The output is
shards; how many slots of each shard a source has is a multinomial draw of the source's quota over the shards, so that the
counts of all shards add up to the quota, and no source's draw needs another's. The k-th slot of a source, over all shards,
takes block permutation(k mod n) of epoch k // n, where each epoch permutes the source's n blocks anew by a keyed Feistel
network; slots and blocks are joined by index.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paritas.llm.common import CHUNK_CHARS, cut, fresh, partitions, release, sized

WEIGHTS = (1.0, 2.0, 3.0)
MOST_TIMES = 3.0
#: Words of a block; slots of a shard, on average; shards of a group, by which slots are dealt; rows of a range of the stream.
BLOCK_WORDS, SHARD_SLOTS, GROUP, RANGE_ROWS = 64, 4096, 4096, 100_000
#: Sources whose numbers may be broadcast.
FEW_SOURCES = 100_000
SEED = 20_240
WORD = r"[^\x20\x09-\x0D]+"


def words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """(source, size, s): s counts the sources by code point from 0, null last. Only a count a partition reaches the driver."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = sizes.repartitionByRange(partitions(sizes.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    if not counts:
        return placed.select("source", "size", F.col("at").alias("s"))
    before = dict(zip(sorted(counts), itertools.accumulate([counts[k] for k in sorted(counts)], initial=0), strict=False))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part"))
    return placed.select("source", "size", (offset + F.col("at")).alias("s"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """(source, size, s, target): shares of the sum of sizes (source, size) by weight, none above most_times its size; what is
    cut off is shared again by weight. Weights go to the sources by code point, null last, and repeat.

    A target is the lesser of most_times the size and a level times the weight; the level rises until the targets' sum is that
    of the sizes. Each rise is one aggregate over the sources.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights)).cast("int"))
    known = cut(ranked(sizes).withColumn("weight", weight).withColumn("most", F.col("size") * F.lit(float(most_times))))
    level, closed = 0.0, -1
    while True:
        over = (F.col("most") < F.lit(level) * F.col("weight")) | (F.col("size") == 0)
        r = known.agg(F.sum("size").alias("total"), F.sum(F.when(over, F.col("most"))).alias("cut"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count_if(over).alias("closed")).first()
        if not r["open"] or r["closed"] == closed:
            break
        level, closed = (r["total"] - (r["cut"] or 0.0)) / r["open"], r["closed"]
    share = F.when(F.col("size") > 0, F.least("most", F.lit(level) * F.col("weight")) if closed >= 0 else F.col("most")).otherwise(0.0)
    return known.select("source", "size", "s", share.alias("target"))


def _permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) chosen by key, applied to index: a Feistel network that walks until below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            f = (right + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ k
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass
class Plan:
    """What a mix takes: (source, size, s, target, blocks, quota) of each source, in blocks; all blocks taken; and shards."""

    sources: DataFrame
    total: int
    shards: int


def plan(sizes: DataFrame, block: int = BLOCK_WORDS, shard: int = SHARD_SLOTS) -> Plan:
    """A source's quota is the share of its blocks' passes that its target needs, as its last block is short."""
    blocks = F.ceil(F.col("size") / block).cast("long")
    quota = F.when(F.col("size") > 0, F.least(F.rint(F.col("target") * F.col("blocks") / F.col("size")).cast("long"), (F.lit(MOST_TIMES) * F.col("blocks")).cast("long"))).otherwise(0)
    sources = cut(targets(sizes).withColumn("blocks", blocks).withColumn("quota", quota.cast("long")))
    total = int(sources.agg(F.sum("quota")).first()[0] or 0)
    return Plan(sources, total, max(1, -(-total // shard)))


def _split(n: int, parts: int, *seed: int) -> np.ndarray:
    """n slots dealt to equal parts by one multinomial draw."""
    return np.random.default_rng([x % 2**63 for x in seed]).multinomial(n, np.full(parts, 1 / parts))


def shard_counts(made: Plan, seed: int = SEED) -> DataFrame:
    """(s, blocks, shard, count, before): how many slots of each shard a source has, and its slots in the shards before.

    Every source deals its quota to the shards by a multinomial draw of its own, so that sources need not be known together:
    first to groups of GROUP shards, then within each, so that neither draw is longer than that, or than the groups.
    """
    shards = made.shards
    groups = -(-shards // GROUP)

    def deal(batches: Iterator[pd.DataFrame], inner: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, blocks, n, before, g in zip(*(pdf[c].tolist() for c in ("s", "blocks", "n", "before", "part")), strict=True):
                # The last group has fewer shards; groups get slots by their number of shards.
                if inner:
                    size = min(GROUP, shards - g * GROUP)
                    drawn, first = _split(n, size, seed, s, 1 + g), g * GROUP
                else:
                    size = np.minimum(GROUP, shards - GROUP * np.arange(groups))
                    drawn, first = np.random.default_rng([seed, s % 2**63]).multinomial(n, size / shards), 0
                some = np.flatnonzero(drawn)
                yield pd.DataFrame({"s": s, "blocks": blocks, "n": drawn[some], "before": before + (np.cumsum(drawn) - drawn)[some], "part": first + some})

    schema = "s long, blocks long, n long, before long, part long"
    whole = made.sources.where("quota > 0").select("s", "blocks", F.col("quota").alias("n"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("part"))
    outer = whole.mapInPandas(lambda b: deal(b, False), schema)
    if groups > 1:
        outer = outer.repartition(partitions(outer.sparkSession), "s", "part")
    dealt = outer.mapInPandas(lambda b: deal(b, True), schema)
    return dealt.select("s", "blocks", F.col("part").alias("shard"), F.col("n").alias("count"), "before")


def taken_blocks(made: Plan, seed: int = SEED) -> DataFrame:
    """(s, block, shard, epoch): the mix: each slot of each shard with the block of the source (by number) it takes."""
    spark = made.sources.sparkSession
    dealt = shard_counts(made, seed).select("s", "blocks", "shard", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("count") - 1)).alias("k"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s, n, k = (pdf[c].to_numpy() for c in ("s", "blocks", "k"))
            epoch = k // n
            key = (np.uint64(seed) + s.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + epoch.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
            yield pd.DataFrame({"s": s, "block": _permuted(k % n, n, key), "shard": pdf["shard"].to_numpy(), "epoch": epoch.astype(np.int32)})

    many = max(partitions(spark), made.total // 2_000_000)
    return dealt.repartition(many, "s", "k").mapInPandas(run, "s long, block long, shard long, epoch int")


def packed(docs: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, first): where each row's words start in its source's stream; and (source, size) of each source.

    The stream's order is by a hash of doc_id, then doc_id. Starts are sums within a source's hash range plus the sums of
    the ranges before it, so that a source that has a third of all rows spreads over as many tasks as there are ranges: one for
    RANGE_ROWS rows of the table.
    """
    sized = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), words(column).alias("size"))
    ranges = max(64, -(-docs.count() // RANGE_ROWS))
    sized = sized.withColumn("place", F.xxhash64(F.lit(SEED), "doc_id")).withColumn("range", F.pmod(F.shiftright("place", 32), F.lit(ranges)))
    per = cut(sized.groupBy("source", "range").agg(F.sum("size").alias("words")))
    before = per.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("source", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = within.alias("w").join(before.alias("b"), F.col("w.source").eqNullSafe(F.col("b.source")) & (F.col("w.range") == F.col("b.range")))
    first = (F.col("w.inside") + F.coalesce("b.before", F.lit(0))).alias("first")
    return same.select("w.doc_id", "w.source", "w.size", first), per.groupBy("source").agg(F.sum("words").alias("size"))


def pieces(docs: DataFrame, column: str = "text", block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, Plan]:
    """The mix as rows (doc_id, s, first, size, epoch, a, b): words a to b of a document's source stream, once for each time
    that a slot takes them; the packed documents (doc_id, source, size, first) with their source's number s, size and target;
    and the plan.
    """
    rows, sizes = packed(docs, column)
    made = plan(sizes, block)
    few = made.sources.select(F.col("source").alias("name"), "s", F.col("size").alias("source_size"), "target")
    if made.sources.count() <= FEW_SOURCES:  # of a hundred bytes or so
        few = F.broadcast(few)
    rows = rows.join(few, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    last = F.expr(f"(first + size - 1) div {block}")
    spread = rows.where("size > 0").select("doc_id", "s", "first", "size", F.explode(F.sequence(F.expr(f"first div {block}"), last)).alias("block"))
    got = spread.join(taken_blocks(made).select("s", "block", "epoch"), ["s", "block"])
    a = F.greatest(F.col("first"), F.col("block") * block)
    b = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block)
    return got.select("doc_id", "s", "first", "size", "epoch", a.alias("a"), b.alias("b")), rows, made


def mixed(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row of docs.

    Documents without words, null texts among them, take nothing. Null sources form a source of their own. Repeated
    rows are documents of their own, told apart by their place in the stream; an empty table gives no rows.
    """
    got, rows, _ = pieces(docs, column)
    sums = got.groupBy("s", "first").agg(F.sum(F.col("b") - F.col("a")).alias("taken"))
    # Rows without words share their start with the next row that has some, and take nothing.
    some = rows.join(sums, ["s", "first"], "left")
    taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return some.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), "source")


def texts(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs as the mix takes them: a row for each document and epoch whose slots take words of it, with these words.

    A document that an epoch takes whole keeps its text; of others the runs of taken words stay, as they stand between
    their first and last word, joined by a space. Documents without words do not come. A row's columns stay, whatever their
    names. Rows that repeat in all columns are documents of their own.
    """
    names = docs.columns
    row, known, epochs = (fresh(x, names) for x in ("row", "known", "epochs"))
    docs = docs.withColumn(row, F.xxhash64(F.lit(SEED), *[f"`{c}`" for c in names]))
    got, _, _ = pieces(docs.select(F.col(row).alias("doc_id"), F.col("source"), F.col(column).alias("text")))
    at = got.select(F.col("doc_id").alias("row"), "first", "epoch", "size", (F.col("a") - F.col("first")).alias("a"), (F.col("b") - F.col("first")).alias("b"))
    # Of rows that repeat, each has its own place in the stream; one of them stands for all that their places take.
    runs = at.groupBy("row", "first", "size", "epoch").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"), F.sum(F.col("b") - F.col("a")).alias("taken"))
    each = runs.groupBy("row").agg(F.collect_list(F.struct("first", "epoch", "spans", (F.col("taken") >= F.col("size")).alias("whole"))).alias("epochs")).toDF(known, epochs)
    again = sized(docs.groupBy(row).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(row).alias("again")))
    once = docs.join(again, F.col(row) == F.col("again"), "left_anti").unionByName(docs.join(again, F.col(row) == F.col("again"), "left_semi").dropDuplicates([row]))
    both = once.join(each, F.col(row) == F.col(known)).drop(row, known)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop(row).schema)
    word = re.compile("[^\\x20\\x09-\\x0D]+")

    def cut_out(text: str, spans: list) -> str:
        runs: list[list[int]] = []
        for s in spans:
            a, b = int(s["a"]), int(s["b"])
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        # Of a long text's words only the first and last of each run are remembered.
        wanted, last, ends = {i for a, b in runs for i in (a, b - 1)}, runs[-1][1] - 1, {}
        for i, m in enumerate(word.finditer(text)):
            if i in wanted:
                ends[i] = m.span()
            if i == last:
                break
        return " ".join(text[ends[a][0] : ends[b - 1][1]] for a, b in runs)

    def run(batches):
        for pdf in batches:
            names, rows, chars = [c for c in pdf.columns if c != epochs], [], 0
            for one, takes in zip(pdf.drop(columns=epochs).to_dict("records"), pdf[epochs], strict=True):
                for e in sorted(takes, key=lambda e: (e["first"], e["epoch"])):
                    rows.append(one if e["whole"] else one | {column: cut_out(one[column], list(e["spans"]))})
                    chars += len(rows[-1][column])
                    if chars > CHUNK_CHARS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, chars = [], 0
                        release()
            yield pd.DataFrame(rows, columns=names)
            del rows, pdf
            release()

    return both.mapInPandas(run, schema)
