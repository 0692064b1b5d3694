import numpy as np

from paritas.llm import toxicity


def test_fold():
    assert toxicity.fold("1D10T, $cum!") == " idiot  scum  "
    assert toxicity.fold("іdіоt Ｉｄｉｏｔ") == " idiot idiot "
    assert toxicity.fold("in 2013 at 10") == " in 2013 at 10 "
    for text in ("", "Straße İ ß ﬁ", "a\x00b😀", "é" * 5):
        assert len(toxicity.fold(text)) == len(text) + 2


def test_exceptions_spare_terms():
    model = toxicity.Model({" idiot": 3.0, " scum ": 2.0}, {" village idiot "})
    automaton = model.automaton()
    assert [w for *_, w in toxicity.matches(automaton, toxicity.fold("an idiotic scum scumbag"))] == [3.0, 2.0]
    assert toxicity.matches(automaton, toxicity.fold("the village idiot")) == []
    assert toxicity.matches(toxicity.Model().automaton(), " x ") == []


def test_matches_like_loops():
    """Against all starts, terms and exceptions, in loops."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        word = lambda: "".join(rng.choice(list("ab"), rng.integers(1, 4)))
        weights = {f" {word()}" + (" " if rng.random() < 0.5 else ""): float(rng.integers(1, 9)) for _ in range(4)}
        spare = {f" {word()} {word()} " for _ in range(4)}
        folded = " " + " ".join(word() for _ in range(12)) + " "
        want = []
        for s in range(len(folded)):
            found = [t for t in weights if folded.startswith(t, s)]
            if found:
                end = s + max(map(len, found)) - 1
                if not any(folded.startswith(p, a) and a <= s and end <= a + len(p) for p in spare for a in range(len(folded))):
                    want.append((s, end, weights[max(found, key=len)]))
        assert sorted(toxicity.matches(toxicity.Model(weights, spare).automaton(), folded)) == want


def corpus(n=1500):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [str(rng.choice(words)) for _ in range(int(rng.integers(5, 120)))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(3):
                text[int(rng.integers(0, len(text)))] = "zork" + str(rng.choice(words)) if rng.random() < 0.5 else "Qu1xk"
        elif rng.random() < 0.05:
            text += ["mister", "quixk", "said"]
        docs.append((i, " ".join(text), "x"))
        if rng.random() < 0.8:
            labels.append((i, toxic))
    return docs, labels


def test_learns_words_beginnings_and_exceptions(spark):
    docs, labels = corpus()
    table = spark.createDataFrame([*docs, (5000, None, "x"), (5001, "", "x"), (5002, "word " * 30_000, "x"), docs[0]], "doc_id long, text string, score string")
    marked = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(table, marked)
    assert any(t.startswith(" zork") for t in model.weights) and " quixk " in model.weights or " quixk" in model.weights
    assert any("mister" in p or "said" in p for p in model.exceptions)
    rows = toxicity.score(table, model).collect()
    assert len(rows) == len(docs) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    got, want = {r.doc_id: r for r in rows}, dict(labels)
    held = [i for i in want if got[i].held_out]
    assert 200 < len(held) < 400
    assert np.mean([got[i].predicted == want[i] for i in held]) > 0.97
    toxic = [i for i in held if want[i]]
    assert np.mean([got[i].predicted for i in toxic]) > 0.9 and len(toxic) > 20
    assert got[5000].score == got[5001].score < 0.3
    assert toxicity.score(table.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0]
