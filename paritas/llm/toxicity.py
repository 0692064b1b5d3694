"""Toxicity of texts by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, maps look-alike letters of other scripts and full-width forms to the Latin ones, reads digits and
signs inside words as the letters that they stand for, and makes all else a space, so that terms are found at word bounds.

The lexicon is learned from labelled rows: words and word beginnings that toxic texts have far more often than others,
weighted by their log odds. Phrases of a term and a neighbouring word that clean texts have become exceptions: a term
inside one does not count. A text's matches, in sum and per thousand words, give its probability through a logistic curve.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import by_text, cut

#: Letters of other scripts that look like Latin ones, and what digits and signs in words stand for. Fixed values.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "s",
}
STAND_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Labelled rows of each class that the lexicon is learned from, in expectation; and lengths of word beginnings.
TOXIC_ROWS, CLEAN_ROWS = 4_000, 8_000
BEGINNINGS = range(3, 8)
#: Log odds that an entry has at least, and the log likelihood by which its rows' classes must differ from chance, of which
#: many rare words would otherwise show some. Nothing else bounds the entries: the sample of rows does.
LEAST_ODDS, LEAST_EVIDENCE = 2.5, 11.0
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2
_SIGN = re.compile(r"(?<![^\W_])[0134578@$!](?=[^\W\d_])|(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])")


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        ch = unicodedata.normalize("NFKC", chr(code)).lower()[:1]
        ch = LOOKALIKES.get(ch, ch)
        out = ch if ch.isalnum() or ch in STAND_FOR else " "
        self[code] = out
        return out


_FOLD = _Fold()
_STRIP = str.maketrans("@$!", "   ")


def fold(text: str) -> str:
    """Folded text between spaces; one character for each of the text's."""
    out = text.translate(_FOLD)
    if _SIGN.search(out):
        out = _SIGN.sub(lambda m: "".join(STAND_FOR[c] for c in m.group()), out)
    return " " + out.translate(_STRIP) + " "


@dataclass
class Model:
    """Entries of the lexicon: a beginning as " abc", a word as " abc ", with weights; exceptions; and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for term, w in self.weights.items():
            made.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), 0.0))
        if len(made):
            made.make_automaton()
        return made


def matches(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the terms found outside exceptions, the longest at a word's start."""
    if not len(automaton):
        return []
    found, spared = {}, []
    for end, (size, w) in automaton.iter(folded):
        start = end - size + 1
        if w == 0.0:
            spared.append((start, end))
        elif start not in found or end > found[start][0]:
            found[start] = (end, w)
    out = [(s, e, w) for s, (e, w) in found.items()]
    if spared:
        # A term is inside an exception if, of those that start before it, one ends behind it.
        spared.sort()
        starts, last = [a for a, _ in spared], list(itertools.accumulate((b for _, b in spared), max))
        inside = lambda s, e: (k := bisect.bisect_right(starts, s)) > 0 and e <= last[k - 1] + 1
        out = [x for x in out if not inside(x[0], x[1])]
    return out


def signals(found: list[tuple[int, int, float]], folded: str) -> tuple[float, float]:
    """log1p of the weights found, and of these per thousand words."""
    total = sum(w for _, _, w in found)
    return float(np.log1p(total)), float(np.log1p(1000.0 * total / max(1, len(folded.split())))) if total else 0.0


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    a, b, c = model.curve
    return 1.0 / (1.0 + np.exp(-(a + x @ np.array([b, c]))))


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
    """(text, toxic) of a bounded sample of the labelled rows outside the held-out fold; and for each class how many rows
    there are, and the share sampled. A doc_id's hash decides, so that runs agree.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {t: (counts.get(t, 0), min(1.0, most / max(1, counts.get(t, 0)))) for t, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))}
    place = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) / 1_000_000.0
    wanted = known.where(place < F.when(F.col("toxic") == 1, share[1][1]).otherwise(share[0][1]))
    # At most some twelve thousand rows of two numbers.
    return cut(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(wanted), "doc_id").select("text", "toxic")), share


def features(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in BEGINNINGS if len(w) >= k)
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of labelled rows; without toxic or clean ones it gives a constant low score."""
    rows, share = sample(docs, labels)
    if not share[0][0] or not share[1][0]:
        return Model()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = (Counter(), Counter())
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                by[toxic].update(features(fold(text)))
        names = list(by[0].keys() | by[1].keys())
        for i in range(0, len(names), 100_000):
            some = names[i : i + 100_000]
            yield pd.DataFrame({"term": some, "t": [by[1][n] for n in some], "c": [by[0][n] for n in some]})

    toxic_n, clean_n = share[1][0] * share[1][1], share[0][0] * share[0][1]
    counted = rows.mapInPandas(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic_n + 1)) - F.log((F.col("c") + 0.5) / (clean_n + 1))
    t, c, p = F.col("t"), F.col("c"), toxic_n / (toxic_n + clean_n)
    evidence = t * F.log(t / (t + c) / p) + F.when(c > 0, c * F.log(c / (t + c) / (1 - p))).otherwise(0.0)
    good = counted.where(t > 0).withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (evidence >= LEAST_EVIDENCE))
    # At most the words of the sampled toxic rows, and far fewer, as each needs its evidence.
    best = good.orderBy((F.col("t") * F.col("odds")).desc(), F.length("term").desc(), "term").collect()
    model, begun = Model(), set()
    for r in best:  # of entries that begin alike the best stays
        term = r["term"]
        if term.rstrip() not in begun and not any(term[:k] in model.weights for k in range(1, len(term) + 1)):
            model.weights[term] = float(r["odds"])
            begun.update(term[:k] for k in range(1, len(term) + 1))

    terms = model.automaton()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each row its label and signals, and the phrases around its terms."""
        for pdf in batches:
            out = []
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                folded, phrases = fold(text), set()
                found = matches(terms, folded)
                for s, _, _ in found:
                    word_end = folded.find(" ", s + 1)
                    before = folded[:s].rstrip().rfind(" ")
                    after = folded.find(" ", word_end + 1)
                    if before >= 0 and folded[before:s].strip():
                        phrases.add(folded[before : word_end + 1])
                    if after > word_end + 1:
                        phrases.add(folded[s : after + 1])
                out.append((toxic, *signals(found, folded), [" ".join(["", *p.split(), ""]) for p in sorted(phrases)]))
            yield pd.DataFrame(out, columns=["toxic", "total", "rate", "phrases"])

    seen = rows.mapInPandas(look, "toxic int, total double, rate double, phrases array<string>")
    phrase = seen.select("toxic", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    spare = phrase.where((F.col("c") >= 5) & (F.col("c") >= 9 * F.col("t"))).collect()
    model.exceptions = {r["phrase"] for r in spare}
    final = model.automaton()
    points = seen.select("toxic", "total", "rate").toPandas() if not model.exceptions else _points(rows, final)
    model.curve = _curve(points[["total", "rate"]].to_numpy(), points["toxic"].to_numpy(), share)
    return model


def _points(rows: DataFrame, automaton) -> pd.DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            folded = [fold(x) for x in pdf["text"]]
            yield pd.DataFrame([(t, *signals(matches(automaton, f), f)) for f, t in zip(folded, pdf["toxic"], strict=True)], columns=["toxic", "total", "rate"])

    return rows.mapInPandas(run, "toxic int, total double, rate double").toPandas()


def _curve(x: np.ndarray, y: np.ndarray, share: dict[int, tuple[int, float]]) -> tuple[float, float, float]:
    """A ridge logistic fit by Newton's steps, rows weighted back to the classes' true shares."""
    design = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 1 / share[1][1], 1 / share[0][1])
    weight /= weight.mean()
    b, ridge = np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ b))
        gradient = design.T @ (weight * (y - p)) - ridge @ b
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in b)  # type: ignore[return-value]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_terms) for each row of docs.

    Null texts count as empty, and get the score of a text without any term. Repeated rows get equal scores; an empty
    table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()

        def some(texts: list[str], pdf: pd.DataFrame) -> pd.DataFrame:
            folded = [fold(t) for t in texts]
            found = [matches(automaton, f) for f in folded]
            p = probability(model, np.array([signals(m, f) for m, f in zip(found, folded, strict=True)]))
            return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "score": p, "n_terms": [len(m) for m in found]})

        yield from by_text(some)(batches)

    scored = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, score double, n_terms int")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_terms")
