import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from paritas.llm import mixing  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"] if i % 2 else ["uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho"]
        rows.append((i, "\n".join(" ".join(rng.choice(words, 12)) for _ in range(8)), "en" if i % 2 else "es", f"s{i % 3}", 1))
    rows += [(200, rows[0][1], "es", "s0", 1), (201, rows[1][1].replace("alpha", "alpho", 1), "en", "s1", 1), (202, None, None, None, None), (203, "", "en", "s2", 0), (204, "жжщ ыыъ " * 50, None, "s1", 400), rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    columns = list(corpus_pipeline.COLUMNS)
    now, sizes = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        sizes[name] = {r.doc_id for r in now.collect()}
    everything = {r.doc_id for r in docs.collect()}
    assert everything - sizes["language_id"] == {204}
    assert sizes["line_dedup"] == sizes["language_id"]
    assert sizes["simhash_dedup"] <= sizes["line_dedup"] and len({200, 201, 202, 203} & sizes["simhash_dedup"]) <= 1
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert sorted(r.decoded for r in last) == sorted(r.text for r in now.collect())


def test_near_copies_go(spark, docs):
    long = " ".join(f"w{i}" for i in range(500))
    more = spark.createDataFrame([(1, long, "en", "a", 1), (2, long + " x", "en", "a", 1), (3, "other text here", "en", "a", 1)], docs.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, more, SF).collect()) == [1, 3]


def test_mixed_texts_are_the_words_that_slots_take(spark, docs):
    taken = {}
    for r in mixing.texts(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    want = {}
    for r in mixing.mixed(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    # Streams are ordered alike, so that only the sums by source need be the same.
    assert sum(taken.values()) == sum(want.values())
    whole = {r.doc_id: r.text for r in docs.collect() if r.text}
    assert all(w in whole[r.doc_id].split() for r in mixing.texts(docs).collect() for w in r.text.split())


def test_empty(spark, docs):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0


# -- the whole run, each stage against brute force over what the one before kept ------------------------------------------


def jaccard(a, b):
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4) if w else 0)}
    x, y = shingles(a or ""), shingles(b or "")
    return len(x & y) / len(x | y) if x or y else 1.0


def one_of_each(rows):
    """Of each component of texts with a similarity of 0.8 the rows that are first by doc_id, once."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [r for i, r in enumerate(rows) if label[i] == i]


def test_run_like_brute_force(spark, tmp_path):
    lines_test, langs_test, mixing_test = (pytest.importorskip(f"tests.llm.test_{n}") for n in ("op2_lines", "op8_langid", "op6_mixing"))
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    from paritas.llm import langid

    rng = np.random.default_rng(4)
    words = {k: ["".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(80)] for k, letters in (("en", "abcdefgh"), ("es", "lmnopqrñ"))}
    text = lambda k, n: "\n".join(" ".join(rng.choice(words[k], 12)) for _ in range(n))
    rows = [(i, text("en" if i % 3 else "es", int(rng.integers(1, 9))), "en" if i % 3 else "es", f"s{i % 4}") for i in range(90)]
    rows += [(200 + i, rows[i][1] + "\n" + " ".join(rng.choice(words["en"], 60)), "en", "s1") for i in range(5)]  # lines that repeat
    one_line = [" ".join(rng.choice(words["en"], 200)) for _ in range(4)]
    rows += [(300 + i, t, "en", "s2") for i, t in enumerate(one_line)]
    rows += [(310 + i, t.replace(" ", " zebra ", 1) + " lion", "en", "s0") for i, t in enumerate(one_line)]  # near copies
    rows += [(5, text("en", 4), "en", "s1"), (5, text("es", 3), "es", "s3"), (None, text("en", 3), None, None), (400, None, None, "s1"), (401, "", "en", None), (402, "жжщ ыыъ " * 50, None, "s1"), rows[7]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = stage(spark, docs, str(tmp_path)).collect()
        if name != "sentencepiece":
            docs = spark.createDataFrame(kept[name], docs.schema)
    model = langid.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    evidence = [(i, r[1], None, None, None, r[3] and f"source:{r[3]}") for i, r in enumerate(rows)]
    posterior = langs_test.brute(evidence, model)

    def odd(t):
        bins = langid.trigrams(t or "")
        surprise = [-model.table[k][bins].mean() for k in range(len(model.languages))] if len(bins) else [0.0]
        k = int(np.argmin(surprise))
        return len(bins) >= 50 and (surprise[k] - model.usual[k]) / model.spread[k] > langid.ODD

    settled = [r for i, r in enumerate(rows) if posterior[i][1] >= langid.CERTAIN and not odd(r[1])]
    short = lambda found: sorted(((r.doc_id, r.text) for r in found), key=str)
    assert short(kept["language_id"]) == sorted((r[:2] for r in settled), key=str) and 0 < len(rows) - len(settled) < 5
    lined = [(d, t) for d, t, *_ in lines_test.brute([r[:2] for r in settled], 2)]
    assert short(kept["line_dedup"]) == sorted(lined, key=str) and sum(len(t or "") for _, t in lined) < sum(len(r[1] or "") for r in settled) - 500
    first = one_of_each(lined)
    assert short(kept["simhash_dedup"]) == sorted(first, key=str) and {310, 311, 312, 313}.isdisjoint({d for d, _ in first})
    assert {d for d, _ in first} >= {5, None} and sum(d == 5 for d, _ in first) == 3  # rows of one doc_id are judged apart
    sizes, taken = {}, {}
    for r in kept["simhash_dedup"]:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    before = short(kept["simhash_dedup"])
    for r in kept["mix_sources"]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        assert any(d == r.doc_id and set(r.text.split()) <= set((t or "").split()) for d, t in before)
    names = sorted(n for n in sizes if n is not None) + ([None] if None in sizes else [])
    for n, want in zip(names, mixing_test.shared([sizes[n] for n in names], [1.0 + i % 3 for i in range(len(names))]), strict=True):
        assert abs(taken.get(n, 0) - want) <= 2 * mixing.BLOCK_WORDS
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    mixed = sorted(r.text for r in kept["mix_sources"])
    assert sorted((r.ids, r.decoded, r.n_tokens) for r in kept["sentencepiece"]) == sorted((i := library.encode(t), library.decode(i), len(i)) for t in mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, kept["sentencepiece"]))


@pytest.mark.parametrize("size", [20, 100, 400])
def test_near_copies_by_similarity(spark, size):
    """Of planted pairs at 0.8 and above nine in ten and more go; of pairs below none does."""
    rng = np.random.default_rng(size)
    rows, want = [], {}
    for i in range(300):
        base = [f"a{i}x{k}" for k in range(size + 4)]
        cut = int(rng.integers(1, max(2, size // 3)))
        other = base[cut:] + [f"b{i}x{k}" for k in range(cut)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        want[i] = jaccard(rows[-2][1], rows[-1][1])
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()}
    above = [i for i, j in want.items() if j >= 0.8]
    assert sum(2 * i + 1 not in left for i in above) >= 0.98 * len(above) > 20
    assert all(2 * i + 1 in left for i, j in want.items() if j < 0.8) and all(2 * i in left for i in want)


def test_stages_give_back_what_earlier_ones_held(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} and a line\nthat stands in all of them here", "en", "web", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")

    def held():
        env = spark._jvm.org.apache.spark.SparkEnv.get()
        return {int(x) for x in env.mapOutputTracker().shuffleStatuses().keySet().mkString(" ").split()}

    last = max(held(), default=-1)
    lined, path = corpus_pipeline.written(corpus_pipeline.line_dedup(spark, docs, ""), "test")
    lined = spark.read.parquet(path)
    old = {x for x in held() if x > last}
    out = corpus_pipeline.sentencepiece(spark, lined, "")
    assert old and not old & held()
    assert out.count() == 60


def test_stages_let_heaps_shrink(spark, docs, monkeypatch):
    """Here the driver's heap is the executor's; freed, which has that collected too, is left out."""
    runtime, shrunk, sizes = spark._jvm.java.lang.Runtime.getRuntime(), corpus_pipeline.shrunk, []

    class Stopped(Exception):
        pass

    def begun(session):
        before = runtime.totalMemory()
        shrunk(session)
        sizes.append((before, runtime.totalMemory()))
        raise Stopped

    monkeypatch.setattr(corpus_pipeline, "freed", lambda _: None)
    monkeypatch.setattr(corpus_pipeline, "shrunk", begun)
    for _, stage in corpus_pipeline.STAGES:
        spark.range(0, 4, 1, 4).selectExpr("size(transform(sequence(1, 2000000 + id), x -> cast(x as string))) AS n").agg({"n": "sum"}).collect()
        with pytest.raises(Stopped):
            stage(spark, docs, SF)
    assert len(sizes) == len(corpus_pipeline.STAGES) and all(after < before for before, after in sizes), sizes
