import math
import re

import numpy as np
import pytest

from paritas.llm import langid

WORDS = {"xx": ["oro", "pala", "mitu", "sanko", "ela"], "yy": ["grzt", "blok", "tchk", "wurm", "zank"]}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(WORDS["xx" if i % 3 else "yy"], 60)), "xx" if i % 3 else "yy", f"s{i % 2}") for i in range(240)]
    return spark.createDataFrame([*rows, (900, None, "xx", "s0"), (901, "", None, None), (902, "для жжщ " * 60, None, "s1"), rows[0]], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def model(docs):
    return langid.learn(docs)


def test_learns_and_rejects(spark, docs, model):
    assert model.languages == ["xx", "yy"]
    rows = {r.doc_id: r for r in langid.fused(langid.documents_evidence(docs), model, "doc_id").collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(rows[i].lang == truth[i] and rows[i].accepted for i in range(240))
    # Also those that were not learned from: a model of a half of the rows, asked about the other half.
    half = langid.learn(docs.where("doc_id % 2 = 0"))
    other = langid.fused(langid.documents_evidence(docs.where("doc_id % 2 = 1 and doc_id < 900")), half, "doc_id").collect()
    assert len(other) == 120 and all(r.lang == truth[r.doc_id] and r.accepted for r in other)
    assert rows[900].n_grams == 0 and rows[900].text_lang is None
    assert not rows[902].accepted and rows[902].lang is None
    assert langid.fused(langid.documents_evidence(docs.limit(0)), model, "doc_id").count() == 0
    assert langid.fused(langid.documents_evidence(docs), langid.learn(docs.limit(0)), "doc_id").where("accepted").count() == 0


def test_rejects_languages_that_were_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned, other = docs.where("pmod(xxhash64(doc_id), 2) = 0"), docs.where("pmod(xxhash64(doc_id), 2) = 1")
    for out in ("en", "fr"):
        model = langid.learn(learned.where(f"lang <> '{out}'"))
        got = langid.fused(langid.documents_evidence(other), model, "doc_id").join(other.select("doc_id", langid.F.col("lang").alias("truth")), "doc_id").where("n_grams >= 50").collect()
        assert np.mean([not r.accepted for r in got if r.truth == out]) > 0.98 and np.mean([r.lang == r.truth for r in got if r.truth != out]) > 0.98


def test_evidence(spark):
    rows = [(1, "https://u@Blog.Site.DE:80/fr-FR/x?y", "<!doctype html><HTML class=a LANG='en-GB'><script>var a='<p>b'</script><p>Hi&amp;you<!-- no --></p>"), (2, "nothing", "<meta http-equiv=content-language content=es>x"), (3, None, None)]
    got = langid.pages_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.declared, r.suffix, r.path, r.host) for r in got] == [("en", "de", "fr", "blog.site.de"), ("es", None, None, None), (None, None, None, None)]
    assert got[0].text.split() == ["Hi", "you"]


def brute(rows, model):
    """Posterior of each row, in plain loops."""
    n = len(model.languages)
    soft = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    own, seen, hosts, domains = [], [], {}, {}
    for _, text, dec, suf, path, host in rows:
        bins = langid.trigrams(text or "")
        scale = langid.TEMPER * min(1.0, langid.FULL / len(bins)) if len(bins) else 0
        v = [float(model.table[k].astype(np.float32)[bins].sum(dtype=np.float64)) * scale for k in range(n)]
        v = [x + langid.DECLARED * (dec == k) + langid.SUFFIXED * (suf == k) + langid.PATHED * (path == k) for x, k in zip(v, model.languages, strict=True)]
        own.append(v)
        seen.append(soft(v))
    for r, s in zip(rows, seen, strict=True):
        for table, name in ((hosts, r[5]), (domains, r[5] and ".".join(r[5].split(".")[-2:]))):
            table[name] = [a + b for a, b in zip(table.get(name, [0] * n), s, strict=True)]
    base = [1 + sum(s[k] for s in seen) for k in range(n)]
    base = [b / sum(base) for b in base]
    out = {}
    for r, v, s in zip(rows, own, seen, strict=True):
        prior = base
        if r[5]:
            d = domains[".".join(r[5].split(".")[-2:])]
            towards = [(c + langid.DOMAIN_ROWS * b) / (sum(d) + langid.DOMAIN_ROWS) for c, b in zip(d, base, strict=True)]
            others = [max(0, a - b) for a, b in zip(hosts[r[5]], s, strict=True)]
            prior = [(c + langid.HOST_ROWS * b) / (sum(others) + langid.HOST_ROWS) for c, b in zip(others, towards, strict=True)]
        p = soft([a + math.log(b + 1e-9) for a, b in zip(v, prior, strict=True)])
        out[r[0]] = (model.languages[int(np.argmax(p))], max(p))
    return out


def test_fusion_like_brute_force(spark, model):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        host = [None, "a.one.org", "b.one.org", "two.de"][int(rng.integers(0, 4))]
        lang = "yy" if host == "two.de" or rng.random() < 0.2 else "xx"
        text = " ".join(rng.choice(WORDS[lang], int(rng.integers(0, 4)))) if i % 4 else None
        pick = lambda: [None, "xx", "yy", "qq"][int(rng.integers(0, 4))]
        rows.append((i, text, pick(), pick(), pick(), host))
    evidence = spark.createDataFrame(rows, "page_id long, text string, declared string, suffix string, path string, host string")
    want = brute(rows, model)
    got = langid.fused(evidence, model, "page_id").collect()
    assert len(got) == 150 and re.match("xx|yy", got[0].lang)
    for r in got:
        assert abs(r.probability - want[r.page_id][1]) < 1e-4 and (r.lang == want[r.page_id][0] or r.probability < 0.5 + 1e-4)
