import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from paritas.llm import mixing


def shared(sizes, weights, most=3.0):
    """Targets by bisection of the level at which min(most * size, level * weight) add up to all sizes."""
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(most * s, level * w) for s, w in zip(sizes, weights, strict=True)) < sum(sizes):
            low = level
        else:
            high = level
    return [min(most * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def frame(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "source string, size long")


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500}, {"a": 0, "b": 5}, {None: 7}, {"b": 1, "ä": 100_000, "A": 3, "": 50, None: 20_000, "z": 1}, {f"s{i:03d}": 10 + 7919 * i % 5000 for i in range(300)}])
def test_targets_reshare_what_is_cut(spark, sizes):
    names = sorted((n for n in sizes if n is not None), key=str.encode) + ([None] if None in sizes else [])
    want = shared([sizes[n] for n in names], [1.0 + i % 3 for i in range(len(names))])
    got = {r.source: r for r in mixing.targets(frame(spark, sizes)).collect()}
    assert [got[n].s for n in names] == list(range(len(names)))
    assert np.allclose([got[n].target for n in names], want)


def test_plan_meets_its_quotas(spark, monkeypatch):
    made = mixing.plan(frame(spark, {"b": 100_000, "a": 300_000, None: 20_000, "c": 0}), block=10, shard=500)
    sources = {r.source: r for r in made.sources.collect()}
    for group in (4096, 7):  # in one draw, and in two
        monkeypatch.setattr(mixing, "GROUP", group)
        rows = mixing.shard_counts(made).collect()
        per = {}
        for r in sorted(rows, key=lambda r: (r.s, r.shard)):
            assert r.before == per.get(r.s, 0)
            per[r.s] = r.before + r["count"]
        assert per == {r.s: r.quota for r in sources.values() if r.quota}
        shards = np.bincount([r.shard for r in rows], weights=[r["count"] for r in rows])
        assert len(shards) == made.shards == -(-made.total // 500) and abs(shards - 500).max() < 150
    assert all(abs(r.quota * 10 - r.target) <= 10 for r in sources.values())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutation(n):
    for key in (1, 99):
        got = mixing._permuted(np.arange(n), np.full(n, n), np.full(n, key, dtype=np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_mix(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 40 == 1 else " ".join(["w"] * int(rng.integers(0, 400))), ["src0", "src1", "Ä", None][min(int(rng.integers(0, 9)), 3)], i) for i in range(600)]
    rows += [rows[0], rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(docs.repartition(3)).collect()), key=str)
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    texts = {r[0]: (r[1], r[2]) for r in rows}
    by_source = {}
    for r in got:
        assert r.size == size(texts[r.doc_id][0]) and r.source == texts[r.doc_id][1]
        assert 0 <= r.taken <= 3 * r.size
        by_source.setdefault(r.source, []).append(r)
    names = sorted(s for s in by_source if s is not None) + [None]
    total = sum(r.size for r in got)
    want = shared([sum(r.size for r in by_source[s]) for s in names], [1.0, 2.0, 3.0, 1.0])
    for s, w in zip(names, want, strict=True):
        assert {r.source_size for r in by_source[s]} == {sum(r.size for r in by_source[s])}
        assert np.allclose([r.target for r in by_source[s]], w)
        assert abs(sum(r.taken for r in by_source[s]) - w) < 0.02 * total
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mixed(docs.where("text is null")).collect()] == [0] * sum(r[1] is None for r in rows)


def test_every_word_of_the_slots_is_counted(spark):
    rows = [(i, " ".join(["w"] * (i % 97)), f"s{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, packed, made = mixing.pieces(docs)
    stream = {}
    for r in packed.collect():
        for w in range(r["first"], r["first"] + r["size"]):
            assert stream.setdefault((r["s"], w), r["doc_id"]) == r["doc_id"]
    want = {}
    sizes = {r.s: r.size for r in made.sources.collect()}
    for slot in mixing.taken_blocks(made).collect():
        for w in range(slot.block * mixing.BLOCK_WORDS, min((slot.block + 1) * mixing.BLOCK_WORDS, sizes[slot.s])):
            want[stream[slot.s, w]] = want.get(stream[slot.s, w], 0) + 1
    assert {r.doc_id: r.taken for r in mixing.mixed(docs).collect() if r.taken} == want


def test_texts_of_repeated_rows_and_clashing_columns(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 97)), f"s{i % 3}", i, "e") for i in range(60)] + [(i, " ".join(f"w{i}x{k}" for k in range(i % 97)), f"s{i % 3}", i, "e") for i in range(30)] + [(None, "no id here", "s0", 0, "e")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, epochs string")
    out = mixing.texts(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        words = r.text.split()
        assert r.row == (r.doc_id or 0) and r.epochs == "e"
        for w in words:
            got[w] = got.get(w, 0) + 1
    taken = {}
    for r in mixing.mixed(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert sum(got.values()) == sum(taken.values())
    copies = {i: 2 if i < 30 else 1 for i in range(60)}
    assert all(n <= 3 * copies[int(w[1:].split("x")[0])] for w, n in got.items() if w.startswith("w"))


def test_long_texts_leave_in_bounded_pieces(spark):
    """Several texts of over a million characters in one batch give the words that the mix takes, whole or in part."""
    docs = spark.createDataFrame([(i, f"w{i} " * 300_000, "s" if i < 2 else "t") for i in range(4)], "doc_id long, text string, source string").coalesce(1)
    want = {r.doc_id: r.taken for r in mixing.mixed(docs).collect()}
    rows = mixing.texts(docs).select("doc_id", F.length(F.translate("text", "0123456789 ", "")).alias("n"), F.regexp_count("text", F.lit("[^ 0-9w]")).alias("odd")).collect()
    assert {i: sum(r.n for r in rows if r.doc_id == i) for i in want} == want and not any(r.odd for r in rows)
