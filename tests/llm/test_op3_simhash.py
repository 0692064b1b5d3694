import numpy as np
import pytest
import xxhash

from paritas.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    component = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius and component[j] < component[i]:
                    component[i], changed = component[j], True
    return component


@pytest.mark.parametrize("text", ["", " \t", "One", "one TWO three", "a b c d e f g a b c d", "É é A\tb\x0bc " * 40, "日本 x\xa0y z w q"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("tile", [7, 100_000])
def test_components_like_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(tile)
    fps = [int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)]
    for _ in range(240):
        flips = rng.integers(0, 64, rng.integers(0, 4))
        x = fps[int(rng.integers(0, len(fps)))]
        for f in flips:
            x ^= 1 << int(f)
        fps.append(x)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(x, x, 0) for x in set(signed)], "node long, fp long, fp2 long"), 4, tile).collect()
    assert len(links) < 40 * len(fps)
    joined = {x: x for x in signed}

    def root(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4
        joined[root(a)] = root(b)
    want = brute_components(fps, 4)
    groups = {}
    for x, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(root(x))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [base, base.replace("word7 ", "WORD7\t"), base + " more", "", None, " \n", "quite another text", base]
    rows = [(10 + i, t, "fp", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [rows[6]], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(fps, 4)
    assert len(got) == len(rows) + 1
    for r in got:
        i = r.doc_id - 10
        assert (r.fingerprint, r.component_id) == (f"{fps[i]:016x}", want[i] + 10)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_both_fingerprints_must_be_near(spark):
    rows = [(1, 0, 0), (2, 1, 0), (3, 3, 2**62 - 1), (4, 2**40 - 1, 1)]
    links = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame(rows, "node long, fp long, fp2 long"), 14).collect()}
    assert links == {(1, 2)}
    words = [f"w{i}" for i in range(600)]
    loose = words[:]
    loose[100], loose[300], loose[500] = "a", "b", "c"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(loose)), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 5, 14, True).collect()} == {1: 1, 2: 1, 3: 3}


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("part", [3, 512])
def test_similar_links_by_shingles(spark, part):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(400):
        words = [f"w{rng.integers(10**9)}" for _ in range(int(rng.integers(60, 300)))]
        loose = words[:]
        for at in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0.01, 0.06))), replace=False):
            loose[at] = f"x{i}"
        a, b = " ".join(words), " ".join(loose)
        rows += [(2 * i, a), (2 * i + 1, b)]
        want[i] = jaccard(a, b)
    # A chain whose ends are less similar than its links; the same shingle many times beside other words.
    chain = [" ".join(f"c{j}" for j in range(k * 10, k * 10 + 200)) for k in range(8)]
    rows += [(1000 + k, t) for k, t in enumerate(chain)]
    rows += [(2000 + k, "a " * 900 + " ".join(f"{c}{j}" for j in range(30))) for k, c in enumerate("pq")]
    rows += [(3000, ""), (3001, None), (None, rows[0][1]), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = simhash.similar(docs, 5, 0.8, part).collect()
    got = {r.doc_id: r.component_id for r in found}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None) and sorted(r.kept for r in found if r.doc_id is None) == [False, True]
    wrong = [(i, j) for i, j in want.items() if (got[2 * i + 1] == 2 * i) != (j >= 0.8)]
    assert not wrong and 50 < sum(j >= 0.8 for j in want.values()) < 350
    assert {got[1000 + k] for k in range(8)} == {1000} and jaccard(chain[0], chain[-1]) < 0.8
    assert (got[2000], got[2001], got[3000], got[3001]) == (2000, 2001, 3000, 3000)
    assert simhash.similar(docs.limit(0), 5, 0.8).count() == 0
