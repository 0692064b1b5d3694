"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly in tiles.

Distinct fingerprints are dealt into tiles by their population count, and by a hash where a count has more of them than a
tile holds. Fingerprints within a radius have population counts within it, so only such pairs of tiles meet; a pair of
tiles is compared with exclusive-or and bit counts, in blocks whose halves' and quarters' counts can be within the radius.
A pair of tiles gives a spanning forest of its links, never all pairs. For texts that are similar by their shingles, such
links under loose bounds only make groups of candidates, in which the shingles themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import SPACES, by_group, by_text, components, cut, partitions, release, sized
from paritas.llm.hashing import mix

WORDS, RADIUS = 4, 4
#: Distinct fingerprints that a tile is meant to hold, and fingerprints compared at once.
TILE, BLOCK = 32_768, 256
SEED = 42
#: Bits by which texts may differ in the first of two fingerprints, and in both together, to be compared by their shingles:
#: at a similarity of 0.8 about 10 and 19, so that about one pair in a thousand is missed; of random texts six pairs in a
#: thousand million are compared.
FIRST, BOTH = 20, 32
#: Texts of a group of candidates that are compared with as many others at once, and rows held for that.
PART, HELD = 512, 512


def fingerprint(text: str, words: int = WORDS) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's shingles; 0 for a text without words."""
    return fingerprint_pair(text, words, False)[0]


def fingerprint_pair(text: str, words: int = WORDS, second: bool = True) -> tuple[int, int]:
    """The fingerprint, and one of the same shingles under a hash of their hashes, which is independent of it."""
    h = shingles(text, words)
    return (_most(h), _most(mix(h)) if second else 0) if len(h) else (0, 0)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the text's shingles in their order; a shorter text is one shingle, and one without words has none."""
    import xxhash

    tokens = [t for t in text.encode().lower().translate(_TO_SPACE).split(b" ") if t]
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    data = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    end = np.cumsum(lengths + 1) - 1
    start = end - lengths
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    last = end[words - 1 :].tolist() if len(tokens) >= words else [len(data)]
    return np.array([digest(data[a:b], SEED) for a, b in zip(start[:n].tolist(), last, strict=True)], dtype=np.uint64)


def _most(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


_TO_SPACE = bytes(0x20 if i in SPACES else i for i in range(256))


def fingerprints(docs: DataFrame, words: int = WORDS, second: bool = False, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, fp, fp2): the fingerprints of every row's whole text as signed 64-bit numbers; fp2 is 0 unless it is asked for.
    Null texts count as empty.
    """
    id_type = docs.schema[id_column].dataType.simpleString()

    def some(texts: list[str], pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.array([fingerprint_pair(t, words, second) for t in texts], dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "fp": both[:, 0], "fp2": both[:, 1]})

    rows = docs.select(F.col(id_column).alias("id"), F.col(column).alias("text"))
    return rows.mapInPandas(by_text(some), f"id {id_type}, fp long, fp2 long")


def _parts(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters of each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def near_pairs(first: np.ndarray, second: np.ndarray, radius: int, same: bool, both: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of a spanning forest of the pairs of rows of first and second (the same array: each pair once) that are within
    radius bits in either column; with both, within radius in the first column and within both in sum.

    Both are sorted here by quarter counts, so that a block has a narrow range of these; blocks whose ranges lie further
    apart than radius in sum are skipped.
    """
    a, b = first[:, 0], second[:, 0]
    order_a = np.lexsort(_parts(a).T)
    order_b = order_a if same else np.lexsort(_parts(b).T)
    sa, sb = a[order_a], b[order_b]
    cut_a, cut_b = np.arange(0, len(a), BLOCK), np.arange(0, len(b), BLOCK)
    pa, pb = _parts(sa), _parts(sb)
    low_a, high_a = np.minimum.reduceat(pa, cut_a), np.maximum.reduceat(pa, cut_a)
    low_b, high_b = np.minimum.reduceat(pb, cut_b), np.maximum.reduceat(pb, cut_b)
    shift = 0 if same else len(a)
    label = np.arange(len(a) + (0 if same else len(b)))
    left, right = [], []
    for i, at in enumerate(cut_a):
        gap = np.maximum(0, np.maximum(low_b - high_a[i], low_a[i] - high_b)).sum(axis=1)
        block = sa[at : at + BLOCK]
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            other = sb[cut_b[j] : cut_b[j] + BLOCK]
            apart = np.bitwise_count(block[:, None] ^ other[None, :])
            x, y = np.nonzero(apart <= radius)
            if not len(x):
                continue
            u, v = order_a[x + at], order_b[y + cut_b[j]]
            also = np.bitwise_count(first[u, 1] ^ second[v, 1]) <= (radius if both is None else both - apart[x, y].astype(np.int16))
            u, v = u[also], v[also]
            while True:  # of the links between two classes one is kept, and the classes become one
                lu, lv = label[u], label[v + shift]
                new = lu != lv
                if not new.any():
                    break
                u, v, lu, lv = u[new], v[new], lu[new], lv[new]
                high, low = np.maximum(lu, lv), np.minimum(lu, lv)
                pick = np.lexsort((low, high))
                pick = pick[np.concatenate([[True], high[pick][1:] != high[pick][:-1]])]
                left.append(u[pick])
                right.append(v[pick])
                step = np.arange(len(label))
                step[high[pick]] = low[pick]
                while (step[step] != step).any():
                    step = step[step]
                label = step[label]
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, both: int | None = None) -> DataFrame:
    """(a, b): pairs of nodes of the distinct (node, fp, fp2) whose fingerprints, both of them, are within radius bits (with
    both: the first within radius, and their sum within both), that join the same components as all such pairs.

    Beside the tiles, only a histogram of the 65 population counts reaches the driver.
    """
    spark = distinct.sparkSession
    counted = distinct.select("node", "fp", "fp2", F.bit_count("fp").alias("ones"))
    tall = {r["ones"]: max(1, -(-r["n"] // tile)) for r in counted.groupBy("ones").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not tall:
        return spark.createDataFrame([], "a long, b long")
    parts = F.element_at(F.create_map(*[F.lit(x) for kv in tall.items() for x in kv]), F.col("ones"))
    tiles = counted.withColumn("part", F.pmod(F.xxhash64("fp"), parts).cast("int")).groupBy("ones", "part").agg(F.flatten(F.collect_list(F.array("node", "fp", "fp2"))).alias("fps"))
    width = F.create_map(*[F.lit(x) for kv in tall.items() for x in kv])
    # Each tile goes to the pairs that it is part of: with every tile of a count from its own to radius more, and less.
    ones = F.explode(F.filter(F.sequence(F.col("ones") - radius, F.col("ones") + radius), lambda k: F.map_contains_key(width, k))).alias("other")
    sent = tiles.select("ones", "part", "fps", ones).select("*", F.explode(F.sequence(F.lit(0), F.element_at(width, F.col("other")) - 1)).alias("other_part"))
    me, it = F.struct("ones", "part"), F.struct(F.col("other").alias("ones"), F.col("other_part").alias("part"))
    sent = sent.select(F.least(me, it).alias("p"), F.greatest(me, it).alias("q"), F.when(me <= it, F.lit(0)).otherwise(F.lit(1)).alias("side"), "fps")
    paired = sent.select(F.xxhash64("p", "q").alias("pair"), F.to_json("p").alias("p"), F.to_json("q").alias("q"), "side", "fps")
    total = sum(tall.values())
    dealt = paired.repartition(max(partitions(spark), min(4 * total, 100_000)), "pair").sortWithinPartitions("p", "q", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        for pdf in batches:
            rows = fps = None
            for p, q, side, fps in zip(pdf["p"], pdf["q"], pdf["side"], pdf["fps"], strict=True):
                rows = np.asarray(fps, dtype=np.int64).reshape(-1, 3)
                nodes, fps = rows[:, 0], np.ascontiguousarray(rows[:, 1:]).view(np.uint64)
                if p == q:
                    x, y = near_pairs(fps, fps, radius, True, both)
                    yield pd.DataFrame({"a": nodes[x], "b": nodes[y]})
                elif side == 0:
                    held = (p, q, nodes, fps)
                elif held and held[:2] == (p, q):
                    x, y = near_pairs(held[3], fps, radius, False, both)
                    yield pd.DataFrame({"a": held[2][x], "b": nodes[y]})
            del pdf, fps, rows
            release()

    spark_batch = dealt.select("p", "q", "side", "fps")
    return spark_batch.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, second: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Fingerprints link at radius or fewer differing bits, equal ones included; a component is named by its smallest doc_id.
    With second, texts have another fingerprint too, and link only if both do: of two random texts both are near far more
    rarely, which allows a radius at which looser copies are found. Null and empty texts and texts of spaces have
    fingerprint zero and link like any other. Rows whose doc_id is null get the component of their fingerprint's other rows,
    or null. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, words, second))
    distinct = rows.groupBy("fp", "fp2").agg(F.min("id").alias("least")).withColumn("node", F.xxhash64("fp", "fp2") if second else F.col("fp"))
    found = components(links(distinct.select("node", "fp", "fp2"), radius))
    # A component's smallest doc_id, over its distinct fingerprints; a lone fingerprint is its own component.
    named = distinct.join(found, "node", "left").select("fp", "fp2", "least", "component")
    least = named.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    by_fp = named.join(least, "component", "left").select("fp", "fp2", F.coalesce("first", "least").alias("component_id"))
    return rows.join(by_fp, ["fp", "fp2"]).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- similarity of shingles --------------------------------------------------------------------------------------------


def sketches(docs: DataFrame, words: int, sets: bool = False, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, row, node, fp, fp2, shingles): a hash of every row's text, and of its set of shingles, two fingerprints of that set,
    and with sets its sorted hashes (else null).
    """
    id_type = docs.schema[id_column].dataType.simpleString()

    def some(texts: list[str], pdf: pd.DataFrame) -> pd.DataFrame:
        import xxhash

        held = [np.unique(shingles(t, words)) for t in texts]
        fps = np.array([(xxhash.xxh64_intdigest(h.tobytes(), SEED), _most(h), _most(mix(h))) if len(h) else (0, 0, 0) for h in held], dtype=np.uint64).reshape(-1, 3).view(np.int64)
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "row": pdf["row"].to_numpy(), "node": fps[:, 0], "fp": fps[:, 1], "fp2": fps[:, 2], "shingles": [h.tobytes() if sets else None for h in held]})

    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(column).alias("row"), F.col(column).alias("text"))
    return rows.mapInPandas(by_text(some), f"id {id_type}, row long, node long, fp long, fp2 long, shingles binary")


def similar_pairs(fps: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int = FIRST, both: int = BOTH) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that are near by their fingerprints and whose sets' Jaccard similarity, counted exactly,
    is similarity or more. A pair that others have joined is not counted again.
    """
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for u in range(len(sets) - 1):
        apart = np.bitwise_count(fps[u + 1 :] ^ fps[u])
        for v in (np.flatnonzero((apart[:, 0] <= radius) & (apart.sum(axis=1, dtype=np.int64) <= both)) + u + 1).tolist():
            a, b = find(u), find(v)
            few, many = sorted((len(sets[u]), len(sets[v])))
            if a == b or few < similarity * many:
                continue
            shared = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
            if shared >= similarity * (few + many - shared):
                root[max(a, b)] = min(a, b)
                out.append((u, v))
    return out


def similar(docs: DataFrame, words: int, similarity: float, part: int = PART) -> DataFrame:
    """(doc_id, row, component_id, kept) for each row of docs: texts link whose sets of shingles have that Jaccard similarity.
    row is a hash of the text; of a component the row of smallest doc_id, then row, is kept, and all that equal it in both.

    Groups of texts that are near by loose bounds on two fingerprints are candidates; within a group the near pairs' shingles
    are compared before they link, a large group by pairs of parts. Equal sets link without; texts without words are equal.
    Rows whose doc_id is null get the component of their set's other rows, or null, and come last in the order. An empty table
    gives no rows.
    """
    rows = cut(sketches(docs, words).select("id", "row", "node", "fp", "fp2"))
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")
    distinct = rows.groupBy("node").agg(F.min(place).alias("least"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2"))
    groups = components(links(distinct.select("node", "fp", "fp2"), FIRST, both=BOTH))
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    near = groups.join(sizes, "component").select("node", "component", "parts")
    wanted = sized(distinct.join(near, "node", "left_semi").select(F.col("least.id").alias("wanted"), F.col("least.row").alias("row")))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")) & (F.xxhash64("text") == F.col("row")), "left_semi")
    sets = sketches(texts, words, True).drop("id", "row").dropDuplicates(["node"]).join(near, "node")
    # Two parts meet once, and each then also has its own pairs.
    dealt = sets.withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.where((F.col("parts") == 1) | (F.col("p") != F.col("q")))
    dealt = dealt.select("component", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "node", "fp", "fp2", "shingles")

    def run(pdf: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        nodes, fps = pdf["node"].to_numpy(), np.ascontiguousarray(pdf[["fp", "fp2"]].to_numpy(dtype=np.int64)).view(np.uint64)
        found = []
        for i, start in enumerate(at):
            stop = at[i + 1] if i + 1 < len(at) else len(pdf)
            held = [np.frombuffer(x, dtype=np.uint64) for x in pdf["shingles"].iloc[start:stop]]
            found += [(nodes[start + u], nodes[start + v]) for u, v in similar_pairs(fps[start:stop], held, similarity)]
        return pd.DataFrame(found, columns=["a", "b"])

    joined = components(by_group(dealt, ["component", "p", "q"], run, "a long, b long", HELD))
    named = distinct.join(joined, "node", "left").select("node", "least", "component")
    first = named.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    by_node = named.join(first, "component", "left").select("node", F.coalesce("first", "least").alias("first"))
    return rows.join(by_node, "node").select(F.col("id").alias("doc_id"), "row", F.col("first.id").alias("component_id"), place.eqNullSafe(F.col("first")).alias("kept"))
