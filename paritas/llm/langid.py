"""Language of texts and pages, by Bayes' rule over all evidence at hand.

Text gives likelihoods under a naive Bayes model of hashed character trigrams, learned from labelled documents and tempered,
as neighbouring trigrams are no independent evidence. A page's markup may declare a language and its address may end in a
country's suffix or start its path with a language; each declaration multiplies the odds of its language by its trust. The
prior is the host's: counts of the languages that its other pages' own evidence shows, smoothed towards its registered
domain's, and these towards all hosts', from grouped sums over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import by_text, cut
from paritas.llm.hashing import mix

#: Labelled documents of each language that the model is learned from, in expectation.
TRAIN_ROWS = 1_500
BINS = 1 << 15
#: Trigrams whose evidence counts in full, beyond which it is tempered to as much; and the part of it that counts.
FULL, TEMPER = 400, 0.25
#: Log odds that declarations add for their language, rows by which a host's counts are smoothed, and the same for domains.
DECLARED, SUFFIXED, PATHED = 2.0, 1.5, 1.0
HOST_ROWS, DOMAIN_ROWS = 5.0, 20.0
#: A text is rejected if no language has this probability, or if the surprise of its trigrams is so many deviations above
#: usual. On held-out rows of sf0.1, of a language that was not learned 0.997 and more are rejected whichever of the four it
#: is (20 deviations: 0.15 of the English ones), of learned languages 13 of 15,138, all with more signs than words.
CERTAIN, ODD = 0.5, 12.0
#: Languages of country suffixes. Fixed values.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}


@dataclass
class Model:
    """Log likelihoods of trigram bins by language, and the mean and spread of a language's own texts' trigram surprise."""

    languages: list[str]
    table: np.ndarray  # (languages, BINS)
    usual: np.ndarray
    spread: np.ndarray


def trigrams(text: str) -> np.ndarray:
    """Bins of the trigrams of lower-cased letters, other characters being one space."""
    points = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text.lower()} ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, dtype=np.int64)
    return (mix(points[:-2] << np.uint64(42) ^ points[1:-1] << np.uint64(21) ^ points[2:]) >> np.uint64(64 - 15)).astype(np.int64)


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of the values of lang, from about so many texts of each; a language's texts are told by their doc_id's hash."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((0, BINS)), np.zeros(0), np.zeros(0))
    languages = sorted(counts)
    share = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(rows / counts[k]))]), F.col("lang"))
    some = known.where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1_000_000)) / 1_000_000.0 < share)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                # As in the evidence of a text, trigrams beyond FULL count as no more than these together.
                bins = trigrams(text)
                sums.setdefault(lang, np.zeros(BINS))
                sums[lang] += np.bincount(bins, minlength=BINS) * min(1.0, FULL / max(1, len(bins)))
        for lang, v in sums.items():
            bins = np.flatnonzero(v)
            yield pd.DataFrame({"lang": lang, "bin": bins.astype(np.int32), "n": v[bins]})

    table = np.full((len(languages), BINS), 0.05)
    summed = some.mapInPandas(count, "lang string, bin int, n double").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    table[[languages.index(x) for x in summed["lang"]], summed["bin"].to_numpy()] += summed["n"].to_numpy()
    table = np.log(table / table.sum(axis=1, keepdims=True))
    model = Model(languages, table, np.zeros(len(languages)), np.ones(len(languages)))

    def surprise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                bins = trigrams(text)
                if len(bins) >= 50:
                    out.append((lang, float(-table[languages.index(lang)][bins].mean())))
            yield pd.DataFrame(out, columns=["lang", "s"])

    seen = some.mapInPandas(surprise, "lang string, s double").groupBy("lang").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("sd"))
    for r in seen.collect():
        model.usual[languages.index(r["lang"])] = r["mean"]
        model.spread[languages.index(r["lang"])] = max(r["sd"], 0.05)
    return model


def likelihoods(rows: DataFrame, model: Model, keep: Sequence[str]) -> DataFrame:
    """keep, with text_ll (tempered log likelihood by language), n_grams, and odd: how far the best language's surprise is
    above its usual one, in standard deviations. rows have the text as `text`; null counts as empty.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    table = model.table.T.astype(np.float32).copy()

    def some(texts: list[str], pdf: pd.DataFrame) -> pd.DataFrame:
        ll, size, odd = [], [], []
        for t in texts:
            bins = trigrams(t)
            n = len(bins)
            total = table[bins].sum(axis=0, dtype=np.float64)
            best = int(total.argmax()) if n and len(total) else 0
            odd.append(float((-total[best] / n - model.usual[best]) / model.spread[best]) if n and len(total) else 0.0)
            ll.append((total * (TEMPER * min(1.0, FULL / n)) if n else total).tolist())
            size.append(n)
        return pdf[list(keep)].assign(text_ll=ll, n_grams=size, odd=odd)

    return rows.select(*keep, "text").mapInPandas(by_text(some, 1_000_000), f"{schema}, text_ll array<double>, n_grams int, odd double")


# -- evidence of pages ------------------------------------------------------------------------------------------------


def declared(html: Column) -> Column:
    """The language that the markup declares, by the attribute of html or a meta element, without its region."""
    attribute = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.lower(F.when(attribute != "", attribute).when(meta != "", meta))


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def domain(name: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(name, ".", -2)


def visible(html: Column) -> Column:
    """The text of a page, without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")


def pages_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, suffix, path, host) of pages (page_id, url, html)."""
    at = host(F.col("url"))
    suffix = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.substring_index(at, ".", -1))
    path = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[-_][a-z]{2})?(?:[/?#]|$)", 1))
    return pages.select("page_id", visible(F.col("html")).alias("text"), declared(F.col("html")).alias("declared"), suffix.alias("suffix"), F.when(path != "", path).alias("path"), at.alias("host"))


def documents_evidence(docs: DataFrame) -> DataFrame:
    """The same of documents, and a row's hash: their source stands for a host, and nothing is declared. Their lang is not
    looked at.
    """
    none = F.lit(None).cast("string")
    return docs.select("doc_id", F.xxhash64("text", "source").alias("row"), F.col("text"), none.alias("declared"), none.alias("suffix"), none.alias("path"), F.concat(F.lit("source:"), F.col("source")).alias("host"))


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def fused(evidence: DataFrame, model: Model, *key: str) -> DataFrame:
    """(key, lang, probability, text_lang, host, n_grams, accepted) of rows (key, text, declared, suffix, path, host).

    lang is null, and the row not accepted, where no language reaches CERTAIN, or a text of fifty trigrams or more is ODD.
    Without text and declarations the prior decides. Rows without a host share the prior of all hosts. A key's repeated
    rows get a row each.
    """
    n = len(model.languages)
    if not n:
        return evidence.select(*key, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"), "host", F.lit(0).alias("n_grams"), F.lit(False).alias("accepted"))
    names = F.array(*[F.lit(x) for x in model.languages])
    scored = cut(likelihoods(evidence, model, [*key, "declared", "suffix", "path", "host"]))
    told = F.array(*[sum((F.when(F.col(c) == x, F.lit(w)).otherwise(F.lit(0.0)) for c, w in (("declared", DECLARED), ("suffix", SUFFIXED), ("path", PATHED))), F.lit(0.0)) for x in model.languages])
    own = scored.withColumn("own", F.zip_with("text_ll", told, lambda a, b: a + b)).withColumn("seen", _softmax(F.col("own"))).withColumn("domain", domain(F.col("host")))
    # Soft counts of languages by host; those of domains and of all hosts are sums of these.
    each = [F.sum(F.col("seen")[i]) for i in range(n)]
    hosts = own.groupBy("host", "domain").agg(F.array(*each).alias("counts"))
    again = [F.sum(F.col("counts")[i]) for i in range(n)]
    domains = hosts.groupBy("domain").agg(F.array(*again).alias("domain_counts"))
    whole = hosts.agg(F.array(*again).alias("c")).first()["c"] or [0.0] * n
    base = np.array(whole, dtype=float) + 1.0
    base = F.array(*[F.lit(float(v)) for v in base / base.sum()])

    def smoothed(counts: Column, towards: Column, rows: float) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, v: a + v)
        return F.zip_with(counts, towards, lambda c, p: (c + rows * p) / (total + rows))

    priors = hosts.where("host is not null").join(domains, "domain").select("host", F.col("counts"), smoothed(F.col("domain_counts"), base, DOMAIN_ROWS).alias("towards"))
    joined = own.join(priors, "host", "left")
    # A row's own part is taken out of its host's counts, so that it does not vouch for itself.
    others = F.zip_with("counts", "seen", lambda c, s: F.greatest(c - s, F.lit(0.0)))
    prior = F.when(F.col("counts").isNull(), base).otherwise(smoothed(others, F.col("towards"), HOST_ROWS))
    posterior = joined.withColumn("p", _softmax(F.zip_with("own", prior, lambda a, b: a + F.log(b + F.lit(1e-9)))))
    best, text_best = F.array_max("p"), F.array_max("text_ll")
    accepted = (best >= CERTAIN) & ~((F.col("n_grams") >= 50) & (F.col("odd") > ODD))
    lang = F.get(names, (F.array_position(F.col("p"), best) - 1).cast("int"))
    text_lang = F.when(F.col("n_grams") > 0, F.get(names, (F.array_position(F.col("text_ll"), text_best) - 1).cast("int")))
    return posterior.select(*key, F.when(accepted, lang).alias("lang"), F.round(best, 6).alias("probability"), text_lang.alias("text_lang"), "host", "n_grams", accepted.alias("accepted"))
