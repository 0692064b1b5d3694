"""Document fingerprints: a homomorphic hash of the multiset of a document's paragraphs.

A paragraph is a line. Its wide vector has EXACT lanes of 64 bits, its BLAKE2b digest, and LIKE lanes of 32 bits, to which
each pair of neighbouring words (a lone word by itself) adds or takes 1 at a lane that its hash names. A document's
fingerprint is the sum of its paragraphs' vectors, each lane modulo its power of two: paragraphs can be put in or taken
out without the rest, their order has no effect, and fingerprints of disjoint parts add up.

The likeness of two fingerprints is 1 - |a - b|^2 / (|a|^2 + |b|^2) over the LIKE lanes, which estimates the share of
word pairs that both have, with a standard error of about 0.09 of the share that they do not; equal fingerprints give 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import chunks, partitions
from paritas.llm.hashing import mix, span_hashes, spans

EXACT, LIKE = 8, 256
#: Characters that are hashed at a time, at some 60 bytes of arrays each.
CHUNK = 400_000
#: Keys of the order that are sampled for each range.
SAMPLED = 200
Vectors = tuple[np.ndarray, np.ndarray]


def of_paragraphs(parts: list[list[str]]) -> Vectors:
    """The summed vectors of each list of paragraphs: uint64 (n, EXACT) and uint32 (n, LIKE)."""
    n = len(parts)
    exact, like = np.zeros((n, EXACT), dtype=np.uint64), np.zeros((n, LIKE), dtype=np.uint32)
    counts = np.fromiter(map(len, parts), dtype=np.int64, count=n)
    raw = [p.encode() for some in parts for p in some]
    if not raw:
        return exact, like
    owner = np.repeat(np.arange(n), counts)
    digests = np.frombuffer(b"".join([hashlib.blake2b(p).digest() for p in raw]), dtype="<u8").reshape(-1, EXACT)
    some = np.flatnonzero(counts)
    exact[some] = np.add.reduceat(digests, np.cumsum(counts)[some] - counts[some], axis=0)
    data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    start, end = spans(data)
    if len(start):
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
        paragraph = np.searchsorted(np.cumsum(lengths), start, side="right")
        h = span_hashes(data, start, end)
        near = paragraph[1:] == paragraph[:-1]
        pairs = mix(h[:-1] * np.uint64(3) + h[1:])[near]
        joined = np.zeros(len(h), dtype=bool)
        joined[1:] |= near
        joined[:-1] |= near
        feature = np.concatenate([pairs, h[~joined]])
        of = owner[np.concatenate([paragraph[:-1][near], paragraph[~joined]])]
        lane = of * LIKE + (feature >> np.uint64(56)).astype(np.int64)
        sign = 1.0 - 2.0 * (feature & np.uint64(1)).astype(np.float64)
        like = np.bincount(lane, weights=sign, minlength=n * LIKE).astype(np.int64).astype(np.uint32).reshape(n, LIKE)
    return exact, like


def paragraphs(text: str) -> list[str]:
    return text.split("\n") if text else []


def plus(a: Vectors, b: Vectors) -> Vectors:
    return a[0] + b[0], a[1] + b[1]


def minus(a: Vectors, b: Vectors) -> Vectors:
    return a[0] - b[0], a[1] - b[1]


def written(v: Vectors) -> list[str]:
    """Fingerprints as hex digits, lane by lane."""
    rows = np.concatenate([v[0].astype("<u8").view(np.uint8), v[1].astype("<u4").view(np.uint8)], axis=1)
    return [r.tobytes().hex() for r in rows]


def read_back(texts: list[str]) -> Vectors:
    """Fingerprints from hex digits."""
    rows = np.frombuffer(bytes.fromhex("".join(texts)), dtype=np.uint8).reshape(len(texts), EXACT * 8 + LIKE * 4)
    return rows[:, : EXACT * 8].copy().view("<u8"), rows[:, EXACT * 8 :].copy().view("<u4")


def likeness(a: Vectors, b: Vectors) -> np.ndarray:
    x, y = (v[1].astype(np.uint32).view(np.int32).astype(np.float64) for v in (a, b))
    both = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    apart = ((x - y) ** 2).sum(axis=1)
    same = (a[0] == b[0]).all(axis=1)
    return np.where(same, 1.0, np.clip(1.0 - apart / np.where(both > 0, both, 1.0), 0.0, 1.0) * (both > 0))


def edit(texts: list[str], after: list[str], base: Vectors) -> tuple[list[str], Vectors]:
    """Each text with its last third replaced by the start of the one after, and its fingerprint from the text's own.

    Only the paragraphs from the cut on are taken out and put in.
    """
    edited, out, into = [], [], []
    for t, other in zip(texts, after, strict=True):
        cut = len(t) - len(t) // 3
        e = t[:cut] + other[: len(t) // 3]
        edited.append(e)
        line = t.rfind("\n", 0, cut) + 1
        kept = line > 0
        out.append(t[line:].split("\n") if kept else paragraphs(t))
        into.append(e[line:].split("\n") if kept else paragraphs(e))
    return edited, plus(minus(base, of_paragraphs(out)), of_paragraphs(into))


def fingerprints(docs: DataFrame, column: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of a column. Null counts as empty, whose fingerprint is all zeros."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[column]]
            for a, b in chunks([len(t) for t in texts], CHUNK):
                yield pdf.iloc[a:b].assign(**{name: written(of_paragraphs([paragraphs(t) for t in texts[a:b]]))})

    return docs.drop(name).mapInPandas(run, f"{schema}, `{name}` string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (at, guest, id, text) in which each document's next by descending doc_id (after the last: the first) follows it.

    Documents without a doc_id come last; those of one doc_id, or of none, come by a hash of their texts, then by these, so
    that many of them spread too. Documents are dealt into ranges of that order, twice as many as there are shuffle
    partitions, between quantiles of a sample, and the first of each range also goes, as guest, to the end of the range
    before: texts move once, and none meets all others in a task. The sample only decides where ranges part. It, of SAMPLED
    keys a range in expectation, and each range's first key reach the driver.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The complement orders like the negative, and fits; without an id the largest number.
    order = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(int(np.iinfo(np.int64).max)))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), order.alias("k"), F.xxhash64(text).alias("tie"))
    n = 2 * partitions(spark)
    share = min(1.0, n * SAMPLED / max(1, rows.count()))
    some = rows.select("k", "tie").where(F.pmod(F.xxhash64(F.lit(10), "k", "tie"), F.lit(1_000_000)) < share * 1_000_000).collect()
    sample = sorted({(r["k"], r["tie"]) for r in some})
    bounds = [sample[i * len(sample) // n] for i in range(1, n)] if len(sample) >= n else sample[1:]
    first, second = (np.array([b[i] for b in bounds], dtype=np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def bucket(ks: pd.Series, ties: pd.Series) -> pd.Series:
        k, tie = ks.to_numpy(), ties.to_numpy()
        at, stop = np.searchsorted(first, k, side="left"), np.searchsorted(first, k, side="right")
        for i in np.flatnonzero(at < stop):  # of keys that are a bound's, the ties decide
            at[i] += np.searchsorted(second[at[i] : stop[i]], tie[i], side="right")
        return pd.Series(at.astype(np.int32))

    placed = rows.withColumn("at", bucket("k", "tie"))
    heads = {r["at"]: (r["head"]["k"], r["head"]["tie"]) for r in placed.groupBy("at").agg(F.min(F.struct("k", "tie")).alias("head")).collect()}
    used = sorted(heads)
    before = {a: used[i - 1] for i, a in enumerate(used)}

    @F.pandas_udf("int")
    def guest_of(at: pd.Series, ks: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([before[a] if heads[a] == (k, t) else None for a, k, t in zip(at.tolist(), ks.tolist(), ties.tolist(), strict=True)], dtype="Int32")

    places = F.array_compact(F.array(F.struct(F.col("at"), F.lit(False).alias("guest")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("at"), F.lit(True).alias("guest")))))
    dealt = placed.withColumn("to", guest_of("at", "k", "tie")).select("id", "text", "k", "tie", F.explode(places).alias("place"))
    dealt = dealt.select("place.at", "place.guest", "id", "text", "k", "tie").repartition(partitions(spark), "at")
    return dealt.sortWithinPartitions("at", "guest", "k", "tie", "text").select("at", "guest", "id", "text")


def edits(docs: DataFrame) -> DataFrame:
    """A row for each document: the fingerprints of its text and its edited text, and their likeness, as op10 asks.

    Empty and null texts have an all-zero fingerprint, likeness 1 to another empty one and 0 to others. Repeated rows give
    a row each. No documents give no rows.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def some(held: pd.DataFrame) -> pd.DataFrame:
        """All rows but the last, whose next may be in a later batch."""
        texts = held["text"].tolist()
        at, guest = held["at"].to_numpy(), held["guest"].to_numpy()
        own = np.flatnonzero(~guest[:-1] & (at[:-1] == at[1:]))
        base = of_paragraphs([paragraphs(t) for t in texts])
        mine, after = (base[0][own], base[1][own]), (base[0][own + 1], base[1][own + 1])
        edited, changed = edit([texts[i] for i in own], [texts[i + 1] for i in own], mine)
        return pd.DataFrame(
            {
                "doc_id": held["id"].iloc[own].to_numpy(),
                "n_chars": [len(texts[i]) for i in own],
                "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                "fingerprint": written(mine),
                "edited_fingerprint": written(changed),
                "near_edited": likeness(mine, changed),
                "near_next": likeness(mine, after),
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            for a, b in chunks(pdf["text"].str.len().tolist(), CHUNK):
                held = pdf.iloc[a:b] if last is None else pd.concat([last, pdf.iloc[a:b]], ignore_index=True)
                if len(held) > 1:
                    yield some(held.reset_index(drop=True))
                last = held.iloc[-1:]

    return with_next(docs).mapInPandas(run, schema)
