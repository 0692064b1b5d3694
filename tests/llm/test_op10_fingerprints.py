import hashlib
import re

import numpy as np
import pytest
import xxhash

from paritas.llm import fingerprints as fp


def key(row):
    return (row[0] is None, *((row[0],) if row[0] is not None else ()), *row[1:])


def vectors(text):
    return fp.of_paragraphs([fp.paragraphs(text)])


def test_order_independent_and_incremental():
    a, b = vectors("one two\nthree four five\nsix"), vectors("six\none two\nthree four five")
    assert fp.written(a) == fp.written(b)
    less = fp.minus(a, fp.of_paragraphs([["six"]]))
    assert fp.written(less) == fp.written(vectors("one two\nthree four five"))
    assert fp.written(fp.plus(less, fp.of_paragraphs([["six"]]))) == fp.written(a)
    assert fp.written(vectors("x\nx")) != fp.written(vectors("x"))
    again = fp.read_back(fp.written(a))
    assert (again[0] == a[0]).all() and (again[1] == a[1]).all()


def test_likeness_follows_shared_words():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(900)]
    text = " ".join(words[:600])
    for kept in (600, 450, 300, 0):
        other = " ".join(words[:kept] + words[600 : 600 + 600 - kept] if kept else words[600:] + words[600:])
        got = fp.likeness(vectors(text), vectors(other))[0]
        assert abs(got - kept / 600) < 0.2
    assert fp.likeness(vectors(text), vectors(text))[0] == 1


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def independent_likeness(a, b):
    """Word pairs of paragraphs in lanes, by loops: shares only the hash of a word with what is tested."""
    lanes = []
    for text in (a, b):
        lane = [0] * fp.LIKE
        for paragraph in text.split("\n"):
            words = [w for w in re.split("[ \t\n\v\f\r]+", paragraph) if w]
            hashes = [int(fp.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) for w in words]
            features = [fp.mix(np.array([(x * 3 + y) % 2**64], dtype=np.uint64)).item() for x, y in zip(hashes, hashes[1:], strict=False)] if len(words) > 1 else hashes
            for f in features:
                lane[f >> 56] += -1 if f & 1 else 1
        lanes.append(lane)
    size = sum(x * x for lane in lanes for x in lane)
    apart = sum((x - y) ** 2 for x, y in zip(*lanes, strict=True))
    if sorted(a.split("\n") if a else []) == sorted(b.split("\n") if b else []):
        return 1.0
    return min(1.0, max(0.0, 1 - apart / size)) if size else 0.0


def brute(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), signed(d[1] or ""), d[1] or ""))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.written(vectors(text))[0], fp.written(vectors(edited))[0], independent_likeness(text, edited), independent_likeness(text, after)))
    return sorted(out, key=key)


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_edits_like_brute_force(spark, n):
    rng = np.random.default_rng(n)
    docs = [(int(i) * 7 % 1009, None if i % 50 == 3 else "\n".join(" ".join(rng.choice(["añ", "b", "日本", "dog", "e😀"], rng.integers(0, 9))) for _ in range(rng.integers(0, 5)))) for i in range(n)]
    if n > 2:
        docs += [docs[5], docs[5], (docs[5][0], "other text of the same id"), (5000, "long words " * 3_000)]
        docs += [(None, f"row {i} without an id") for i in range(60)] + [(None, None), (None, "row 3 without an id")] + [(77, f"one of many\nrows {i}") for i in range(60)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, at string").repartition(5)
    got = sorted((tuple(r) for r in fp.edits(df).collect()), key=key)
    assert got == pytest.approx(brute(docs)) if n == 0 else [g[:5] for g in got] == [b[:5] for b in brute(docs)]
    assert np.allclose([g[5:] for g in got], [b[5:] for b in brute(docs)]) if n else True


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "c"), (1, None)], "doc_id long, text string")
    assert fp.edits(df).count() == 3
    assert fp.fingerprints(df).columns == ["doc_id", "text", "fingerprint"]
    assert len(fp.fingerprints(df).first().fingerprint) == 2 * (fp.EXACT * 8 + fp.LIKE * 4)


def test_many_repeats_of_a_pair_do_not_wrap():
    text = "one two " * 40_000
    edited = text[: len(text) * 2 // 3]
    assert fp.likeness(vectors(text), vectors(edited))[0] > 0.9
    back = fp.read_back([fp.written(vectors(t))[0] for t in (text, edited)])
    assert fp.likeness((back[0][:1], back[1][:1]), (back[0][1:], back[1][1:]))[0] > 0.9
