"""Near-duplicate vectors by lattice hashing.

In each of several tables a vector is projected at random to sixteen dimensions, and each eight of these are decoded to the
nearest point of the E8 lattice; the two points are its cell. A vector is indexed in its own cell, and asks this and those
neighbouring cells to which it is nearest. Pairs that meet are verified by their cosine in double precision. A pair that
several tables find counts in the first of these only, so that no pairs are gathered: each task answers with a count of
links for each vector, and a spanning forest of its links. Crowded cells are compared in blocks, each with each other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import by_group, components, cut
from paritas.llm.hashing import mix

COSINE = 0.9
#: Tables, lattice points of a cell, neighbouring cells that are asked, and lattice steps to eight units of a projection of
#: unit vectors. With these a pair at the least cosine is found with a probability of about 0.9, and a closer one surely.
TABLES, POINTS, NEIGHBOURS, SCALE = 8, 2, 2, 3.5
#: Members of a cell that are compared in one block.
BLOCK = 1024
SEED = 7


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points, doubled to whole numbers: the nearer of the nearest in D8 and in D8 moved by a half."""

    def even(y: np.ndarray) -> np.ndarray:
        z = np.rint(y)
        odd = np.flatnonzero(z.sum(axis=1).astype(np.int64) & 1)
        off = (y - z)[odd]
        worst = np.abs(off).argmax(axis=1)
        z[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
        return z

    a, b = even(x), even(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(near[:, None], a, b)).astype(np.int64)


def _roots() -> np.ndarray:
    """The 240 shortest lattice vectors, doubled."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = s, t
            whole.append(v)
    halves = [v for v in itertools.product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(whole + [list(v) for v in halves], dtype=np.int64)


ROOTS = _roots()


def _name(table: int, points: np.ndarray) -> np.ndarray:
    """A 64-bit name of the cell of each row of lattice coordinates."""
    h = np.full(len(points), (table + 1) * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
    for c in points.T:
        h = mix(h ^ (c + 4096).astype(np.uint64))
    return h.view(np.int64)


class Cells:
    """The cells of unit vectors of some dimension."""

    def __init__(self, dimension: int, tables: int = TABLES, points: int = POINTS, neighbours: int = NEIGHBOURS, scale: float = SCALE, seed: int = SEED):
        rng = np.random.default_rng([seed, dimension])
        self.neighbours = neighbours
        self.maps = [rng.normal(size=(dimension, 8 * points)) * scale / 8 for _ in range(tables)]

    def of(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + neighbours): each row's own cell and then those that it asks beside."""
        out = np.empty((len(unit), len(self.maps), 1 + self.neighbours), dtype=np.int64)
        for t, m in enumerate(self.maps):
            at = unit @ m
            blocks = [at[:, i : i + 8] for i in range(0, at.shape[1], 8)]
            homes = [nearest(b) for b in blocks]
            home = np.concatenate(homes, axis=1)
            out[:, t, 0] = _name(t, home)
            if self.neighbours:
                towards = np.concatenate([(b - h / 2) @ ROOTS.T for b, h in zip(blocks, homes, strict=True)], axis=1)
                best = np.argsort(-towards, axis=1, kind="stable")[:, : self.neighbours]
                for k in range(self.neighbours):
                    moved = home.copy().reshape(len(unit), len(blocks), 8)
                    block, root = best[:, k] // len(ROOTS), best[:, k] % len(ROOTS)
                    moved[np.arange(len(unit)), block] += ROOTS[root]
                    out[:, t, 1 + k] = _name(t, moved.reshape(len(unit), -1))
        return out


def _found_before(a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether rows of cells a and b meet in a table before the given one: one's own cell is among those of the other."""
    meet = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
    return meet.argmax(axis=1) < table


def links_within(left: tuple, right: tuple, same: bool, table: int, cosine: float, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of a block and another (or itself) that meet in this cell first, and have the cosine."""
    (unit_a, cells_a), (unit_b, cells_b) = left, right
    i, j = np.nonzero(unit_a @ unit_b.T >= cosine)
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j
    # In one table two rows can meet in each other's own cells: the pair counts in the smaller of these two.
    ca, cb = cells_a[i], cells_b[j]
    home_a, home_b = ca[:, table, 0], cb[:, table, 0]
    in_a, in_b = (cb[:, table] == home_a[:, None]).any(axis=1), (ca[:, table] == home_b[:, None]).any(axis=1)
    first = np.where(in_a & in_b, np.minimum(home_a, home_b), np.where(in_a, home_a, home_b))
    keep = (in_a | in_b) & (first == cell) & ~_found_before(ca, cb, np.full(len(i), table))
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component among n nodes joined by links."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        new = a != b
        if not new.any():
            return label
        high, low = np.maximum(a, b)[new], np.minimum(a, b)[new]
        step = np.arange(n)
        np.minimum.at(step, high, low)
        while (step[step] != step).any():
            step = step[step]
        label = step[label]


def valid(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v) of the rows that can link: no null, no component that is null or not finite, not all zeros."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_column).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def _unit(raw: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", cosine: float = COSINE, **cells: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Equal vectors are folded into one before all else. Vectors that are null, zero, or hold null or non-finite components have
    no links and are their own component; so have vectors of another dimension with each other. Rows are told apart by their
    id: rows that repeat an id are one vector (of these the least) and get the same answer. Rows without an id get a null
    component, and are not kept.
    """
    asked = 1 + int(cells.get("neighbours", NEIGHBOURS))
    id_type = vectors.schema[id_column].dataType.simpleString()
    kind = np.float32 if vectors.schema[column].dataType.simpleString() == "array<float>" else np.float64
    usable = valid(vectors, id_column, column).groupBy("id").agg(F.min("v").alias("v"))
    named = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]
    folded = usable.select("id", "v", *named).groupBy("h", "g").agg(F.min(F.struct("id", "v")).alias("first"), F.count(F.lit(1)).alias("many"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, Cells] = {}
        for pdf in batches:
            sizes = pdf["v"].map(len).to_numpy()
            for d in np.unique(sizes):
                rows = pdf[sizes == d]
                for a in range(0, len(rows), 1024):
                    some = rows.iloc[a : a + 1024]
                    raw = np.stack(some["v"].to_numpy()).astype(kind)
                    found = made.setdefault(int(d), Cells(int(d), **cells)).of(_unit(raw)).reshape(len(some), -1)
                    yield some[["h", "g", "id", "many"]].assign(dim=np.int32(d), raw=[r.tobytes() for r in raw], cells=list(found))

    nodes = cut(folded.select("h", "g", "first.id", "first.v", "many").mapInPandas(place, f"h long, g long, id {id_type}, many long, dim int, raw binary, cells array<long>"))
    # Cells with a single visitor, or none at home, are left out; a crowded one is split into blocks, by pairs of these. Only
    # ids are placed; vectors come to the places that are left.
    placed = nodes.select("id", "dim", F.posexplode("cells").alias("at", "cell"))
    crowd = placed.groupBy("cell", "dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("at") % asked == 0).alias("home")).where("n > 1 and home")
    crowd = cut(crowd.select("cell", "dim", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    sent = placed.join(crowd, ["cell", "dim"]).withColumn("part", part).select("*", other)
    low, high = F.least("part", "other"), F.greatest("part", "other")
    sent = sent.select("cell", "dim", low.alias("p"), high.alias("q"), "part", "at", "id").join(nodes.select("id", "many", "raw", "cells"), "id")

    def verify(pdf: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame | None:
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            g = pdf.iloc[a:b]
            at = g["at"].to_numpy()
            if b - a < 2 or not (at % asked == 0).any():
                continue
            table, cell = int(at[0]) // asked, int(g["cell"].iloc[0])
            unit = _unit(np.frombuffer(b"".join(g["raw"]), kind).reshape(len(g), -1))
            home = np.stack(g["cells"].to_numpy()).reshape(len(g), -1, asked)
            ids, side, many = g["id"].to_numpy(), g["part"].to_numpy(), g["many"].to_numpy()
            p, q = int(g["p"].iloc[0]), int(g["q"].iloc[0])
            x, y = np.flatnonzero(side == p), np.flatnonzero(side == q)
            i, j = links_within((unit[x], home[x]), (unit[y], home[y]), p == q, table, cosine, cell)
            if not len(i):
                continue
            i, j = x[i], y[j]
            least = forest(len(g), i, j)
            count = np.bincount(np.concatenate([i, j]), weights=many[np.concatenate([j, i])], minlength=len(g)).astype(np.int64)
            some = np.flatnonzero(count)
            out.append(pd.DataFrame({"a": ids[some], "b": ids[least[some]], "n": count[some]}))
        return pd.concat(out, ignore_index=True) if out else None

    found = cut(by_group(sent, ["cell", "dim", "p", "q"], verify, f"a {id_type}, b {id_type}, n long", 20_000))
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    classes = nodes.select("h", "g", "id", "many").join(counts, "id", "left").join(components(found.select("a", "b")).withColumnRenamed("node", "id"), "id", "left")
    links = F.col("many") - 1 + F.coalesce("others", F.lit(0))
    classes = classes.select("h", "g", links.alias("n_links"), F.coalesce("component", "id").alias("component"))
    members = usable.select("id", *named).join(classes, ["h", "g"]).drop("h", "g")
    rows = vectors.select(F.col(id_column).alias("id")).join(members, "id", "left")
    component = F.coalesce("component", "id")
    return rows.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
