import hashlib
import re
import time

import numpy as np
import pytest

from paritas.llm import substrings


def brute(docs, length):
    first = {}
    for doc, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            first[w] = min(first.get(w, 1 << 62), (1 << 61) if doc is None else doc)
    out = []
    for doc, text in docs:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < ((1 << 61) if doc is None else doc):
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_classes_like_equal_windows():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 26):
        strings = [bytes(rng.integers(97, 97 + alphabet, rng.integers(0, 200)).astype(np.uint8)) for _ in range(30)]
        strings += [strings[3] + b"xyz" + strings[4], strings[5][10:]]
        string, cls = substrings.window_classes(strings, 50)
        windows = [s[i : i + 50] for s in strings for i in range(len(s) - 49)]
        assert len(windows) == len(cls)
        assert len(set(zip(windows, cls.tolist(), strict=True))) == len(set(windows)) == len(set(cls.tolist()))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 99, 300).astype(np.uint8)), b"a" * 200, b"", b"short"]
    texts.append(b"zzz" + texts[0][20:200] + b"q")
    named = {}
    text, start, windows, h = substrings.anchors(texts)
    for t, s, w, x in zip(text, start, windows, h, strict=True):
        for i in range(s, s + w):
            named.setdefault(texts[t][i : i + 50], set()).add(int(x))
    assert {w for t in texts for w in (t[i : i + 50] for i in range(len(t) - 49))} == set(named)
    assert all(len(x) == 1 for x in named.values())
    cut = substrings._anchors_of_long(texts, 50, 16)
    assert [c.tolist() for c in cut] == [c.tolist() for c in (text, start, windows, h)]


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_documents(spark, crowd):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé "), rng.integers(1, 9)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(6)]
    docs = []
    for i in range(120):
        text = " ".join(word() for _ in range(int(rng.integers(0, 60))))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(0, 6))]
            a = int(rng.integers(0, 60))
            text = text[: len(text) // 2] + p[a : a + int(rng.integers(30, 140))] + text[len(text) // 2 :]
        docs.append((1000 - 3 * i, text))
    docs += [(5, docs[7][1]), (2000, docs[7][1]), (2001, None), (2002, ""), (2003, "x" * 400), (2004, "y" + "x" * 60), (2005, "long line " * 3000), (None, docs[9][1] + "tail"), docs[11], (docs[11][0], docs[11][1] + docs[12][1])]
    df = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, key string").repartition(5)
    got = sorted((tuple(r) for r in substrings.deduplicated(df, crowd=crowd, buckets=7).collect()), key=str)
    assert got == brute(docs, 50)
    assert sum(r[2] for r in got) > 3000
    assert substrings.deduplicated(df.limit(0)).count() == 0


def test_first_passes_leave_no_files(spark):
    """What was shuffled to find shared anchors is off the disk before regions are sent."""

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {int(x) for x in re.findall(r"shuffle_(\d+)_", blocks)}

    last = max(shuffles(), default=-1)
    df = spark.createDataFrame([(i, f"{i % 7} " * 80) for i in range(200)], "doc_id long, text string").repartition(3)
    out = substrings.repeats(df.withColumnRenamed("doc_id", "doc"), buckets=3)
    end = time.time() + 20
    while any(x > last for x in shuffles()) and time.time() < end:
        time.sleep(0.2)
    assert not any(x > last for x in shuffles())
    assert out.count() == 7
