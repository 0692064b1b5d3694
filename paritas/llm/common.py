"""What the operators of this subpackage share: reading tables, cutting lineage, and grouped work in bounded memory."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in the contracts: space and the controls from tab to carriage return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Characters of text that a Python worker holds as words at a time.
CHUNK_CHARS = 1_000_000
#: Bytes that a table may have in memory to be broadcast; larger ones are shuffled in the same join.
BROADCAST = 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between stages that the cluster names; a temporary one only where all runs on this machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, width: Column | int = 64) -> DataFrame:
    """df, materialised, to be broadcast only if its rows, of width bytes in memory, are within BROADCAST."""
    df = cut(df)
    return F.broadcast(df) if (df.agg(F.sum(width if isinstance(width, Column) else F.lit(width))).first()[0] or 0) <= BROADCAST else df


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores in front until no column has it, in whatever case."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet under a name of its own in the shared folder, and read again; and where, for removed()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles, broadcasts and checkpoints that no table refers to any more. It does so only once the
    driver's collector has found them, which else may come after all passes of a query. Each listener holds the last query
    that ended, until it hears of another, so that this takes a few rounds.
    """
    for _ in range(5):
        spark.range(1).collect()
        gc.collect()
        spark._jvm.java.lang.System.gc()
        time.sleep(0.5)


def shrunk(spark: SparkSession) -> None:
    """Lets each executor's heap shrink to what it holds: one that has grown else stays so, and its Python workers have the rest.

    As many tasks as executors, which Spark deals out one each where none is busy, ask for the collector.
    """
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is counted too
    spark.range(0, executors, 1, executors).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(lengths: list[int], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items whose lengths add up to most, or single longer items."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def release() -> None:
    """Gives memory that is free in this process back to the system, as idle Python workers would else keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has this
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def by_text(fn: Callable[[list[str], pd.DataFrame], pd.DataFrame], most: int = CHUNK_CHARS, column: str = "text"):
    """A function for mapInPandas that gives fn the texts (null: empty) of a bounded run of rows and the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[column]]
            for a, b in chunks([len(t) for t in texts], most):
                yield fn(texts[a:b], pdf.iloc[a:b])
            del pdf, texts
            release()

    return run


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | None], schema: str, most_rows: int = 200_000) -> DataFrame:
    """fn over runs of whole groups: rows sorted by keys, and where each group starts (and the end).

    One Python call serves many small groups, where applyInPandas would make one call for each. The caller bounds the
    size of a group, as each is held in memory.
    """
    names = df.columns

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), dtype=bool)
        new[0] = True
        for k in keys:
            v = pdf[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            rows += len(pdf)
            if rows < most_rows:
                continue
            whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            at = starts(whole)
            if len(at) > 1:
                done = whole.iloc[: at[-1]]
                if (out := fn(done, at)) is not None and len(out):
                    yield out
                whole = whole.iloc[at[-1] :].reset_index(drop=True)
            held, rows = [whole], len(whole)
        if held and rows:
            whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            if (out := fn(whole, np.append(starts(whole), len(whole)))) is not None and len(out):
                yield out
        del held
        release()

    return df.select(*names).repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b) reaches.

    Alternating large-star and small-star rounds, each a grouped aggregate without collecting a neighbourhood; lineage
    is cut every round. Ends when a round changes nothing, after some log(n) ** 2 rounds at most.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = cut(edges), None
    while True:
        # Large star: every larger neighbour of a node moves to the smallest of the node and its neighbours.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: every smaller neighbour of a node, and the node, move to the smallest neighbour.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
