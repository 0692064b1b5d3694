"""Scores of texts under a causal self-attention model over subword ids, interpolated with the corpus's word counts.

Subwords are the ids of a public SentencePiece model. They fall into classes: the most frequent ones alone, the rest in
clusters of pieces that are followed alike, word-initial pieces apart from others. The model predicts the next class from a
table of class pairs plus one head of masked attention over the window, and the piece from its class: a word's first piece by
its share of all words, a later one by its share after pieces of the class before it. Windows overlap; each scores the tokens
after its first OVERLAP, so that each token is scored once, windows of many texts in one batch.

All counts are of the whole training part of the corpus, and no table of all words is gathered anywhere: buckets of texts
tell the words that they have, and these meet by hash. There every distinct word is counted and encoded once; the bucket
learns its words' counts and ids, and which pieces follow which is summed over all words.

The table of class pairs starts as the counts of all training text. Attention and pairs then begin with steps on windows drawn
evenly from it, only to have a common start; from there each bucket goes over all of its training text once, every piece and
end a target once, weighted by the rows that have it, and the model is the mean of what the buckets arrive at, weighted by
their text.

A word's probability is the product of its pieces' times that of a word's end after them; it is interpolated with the word's
share of the words of its text before it, and with the base: its smoothed share of all training words, where all words that
training has not stand as one. As such words' own spellings are less likely than all of them together, the score is a lower
bound of the probability over training words and that one.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import chunks, cut, partitions, release, removed, written
from paritas.llm.hashing import span_hashes, spans
from paritas.llm.sentencepiece_bpe import MARK, Encoder, Pieces
from paritas.llm.substrings import _by_bucket, _ranges, _squeeze, _unsqueeze

FOLDS, HELD_OUT = 5, 1
#: Steps for each doubling of the training characters, windows of a step, and words of a run of text that is drawn.
STEPS, TRAINED, DRAWN = 30, 96, 64
#: Windows of a step of the pass over all training text, and the rate of its first step.
LESSON, RATE = 192, 0.003
#: Inputs of a window, those of them that the window before has scored, width, frequent pieces, clusters of either kind.
WINDOW, OVERLAP, WIDTH, FREQUENT, CLUSTERS = 16, 4, 16, 48, 48
#: Columns by which pieces are clustered: what follows them, by its number modulo this, or the end of their word.
FOLLOWERS = 64
#: Occurrences by which a piece's share of its class after another class is smoothed.
SMOOTH = 5.0
#: Weights of the attention model, and of the words that a text has had so far, at its end; it grows by their number over
#: as many more. The base has the rest. Chosen on fold 2 of the training rows.
SHARE, SO_FAR, HALF = 0.5, 0.1, 100.0
CHUNK = 400_000
#: Windows that go through the model at a time, and inputs whose logits are; few, so that their arrays stay in the cache. Rows of
#: a part of a product, and windows whose inputs are sorted by class to be scored.
BATCH, BLOCK, PART, MANY = 128, 768, 192, 4096
SEED = 11
#: What stands for the start or end of a word in pairs of pieces.
EDGE = 0xFFFF
#: What is added to a query's agreement with inputs, to leave out those ahead of it.
AHEAD = np.triu(np.full((WINDOW, WINDOW), np.float32(-1e9)), 1)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def tidy(text: str) -> bytes:
    """The words of a text with A-Z lower-cased, one space between them, as UTF-8."""
    return _tidied(text.encode())


def _tidied(raw: bytes) -> bytes:
    return b" ".join(raw.lower().split())  # which splits bytes at those of SPACES, and lower-cases A-Z alone


# -- the attention model ----------------------------------------------------------------------------------------------


@dataclass
class Model:
    classes: np.ndarray  # class of each piece
    within: np.ndarray  # log probability of each piece in its class after a piece of each class; of a first one, after the last
    initial: np.ndarray  # whether a class begins a word; the last class is the end of a text, and the start of one
    weights: dict[str, np.ndarray]

    @property
    def end(self) -> int:
        return len(self.initial) - 1


def _parts(x: np.ndarray, rows: int) -> np.ndarray:
    """x, of two dimensions, as parts of so many rows where it has whole ones: small products need no copies of what they read."""
    return x.reshape(-1, rows, x.shape[1]) if len(x) % rows == 0 else x[None]


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b."""
    return np.matmul(_parts(a, PART).transpose(0, 2, 1), _parts(b, PART)).sum(axis=0)


def _turned(x: np.ndarray) -> np.ndarray:
    """x with its last two dimensions exchanged, in that order in memory, which its products with others are faster for."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def _joined(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What inputs are multiplied by to agree with inputs, and to be an answer: with one head, q and k, and v and o, are met
    as their products only.
    """
    return w["q"] @ w["k"].T * np.float32(1 / np.sqrt(w["q"].shape[1])), w["v"] @ w["o"]


def _attended(q: np.ndarray, k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the inputs in each query's answer, and the answers, of the last queries of windows."""
    s = np.matmul(q, _turned(k))
    s += AHEAD[k.shape[1] - q.shape[1] : k.shape[1], : k.shape[1]]
    np.exp(s, out=s)
    s *= 1 / (s.reshape(-1, s.shape[2]) @ np.ones(s.shape[2], dtype=s.dtype)).reshape(*s.shape[:2], 1)
    return s, np.matmul(s, v)


def _forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """What the logits of the class after each input of windows x (n, t) come from."""
    n, t = x.shape
    h = np.take(w["embed"], x, axis=0)
    h += w["place"][:t]
    d = h.shape[2]
    flat = h.reshape(-1, d)
    every = np.matmul(_parts(flat, PART), np.concatenate(_joined(w), axis=1)).reshape(n, t, 2 * d)
    q, v = every[:, :, :d], every[:, :, d:]
    s, a = _attended(q, h, v)
    return (a + h).reshape(-1, d), (h, q, v, s, a)


def _logits(w: dict[str, np.ndarray], out: np.ndarray, last: np.ndarray) -> np.ndarray:
    z = np.matmul(_parts(out, PART), w["u"]).reshape(len(out), -1)
    z += np.take(w["pairs"], last, axis=0, mode="clip")
    return z


def _step(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Cross-entropy of the classes y after inputs x, summed with weights (None: the mean), and its gradients.

    Inputs are sorted by class, so that the gradients of its pairs and its embedding are sums of neighbours.
    """
    n, t = x.shape
    d, total = w["embed"].shape[1], n * t
    out, (h, q, v, s, a) = _forward(w, x)
    last = x.reshape(-1)
    order = np.argsort(last.astype(np.int16), kind="stable")
    to, ahead, own = np.take(y.reshape(-1), order), np.take(last, order), np.take(out, order, axis=0)
    part = np.full(total, 1 / total, dtype=out.dtype) if weight is None else np.take(weight.reshape(-1), order).astype(out.dtype)
    edges = np.flatnonzero(np.concatenate([[True], ahead[1:] != ahead[:-1]]))
    bounds, classes, pairs = edges.tolist(), ahead.tolist(), np.zeros_like(w["pairs"])
    back, loss, du, ones = np.empty_like(out), 0.0, np.zeros((w["u"].shape[1], d), dtype=out.dtype), np.ones(w["pairs"].shape[1], dtype=out.dtype)
    for i in range(0, total, BLOCK):
        j = min(total, i + BLOCK)
        z = _logits(w, own[i:j], ahead[i:j])
        np.exp(z, out=z)  # logits are small, as in class_scores
        norm = z @ ones
        flat_z, at = z.reshape(-1), np.arange(0, z.size, z.shape[1]) + to[i:j]
        want = np.take(flat_z, at)
        loss -= float(part[i:j] @ np.log(want / norm))
        flat_z[at] = want - norm
        scale = part[i:j] / norm
        np.multiply(np.matmul(_parts(z, PART), w["u"].T).reshape(j - i, d), scale[:, None], out=back[i:j])
        du += _crossed(z, own[i:j] * scale[:, None])
        inside = np.searchsorted(edges, [i, j], side="right").tolist()
        for e, f in itertools.pairwise([i, *bounds[inside[0] : inside[1]], j]):
            if f > e:
                pairs[classes[e]] += scale[e - i : f - i].dot(z[e - i : f - i])
    g = {"pairs": pairs, "u": du.T}
    place = np.empty(total, dtype=np.int64)
    place[order] = np.arange(total)
    dout = np.take(back, place, axis=0)
    (agree, answer), scaled = _joined(w), np.float32(1 / np.sqrt(d))
    dh, flat, da = dout.copy(), h.reshape(-1, d), dout.reshape(n, t, d)
    ds = np.matmul(da, _turned(v))
    ds -= np.einsum("ij,ij->i", dout, a.reshape(-1, d)).reshape(n, t, 1)
    ds *= s
    dh += np.matmul(ds.transpose(0, 2, 1), q).reshape(-1, d)
    dall = np.empty((n, t, 2 * d), dtype=out.dtype)
    np.matmul(ds, h, out=dall[:, :, :d])
    np.matmul(s.transpose(0, 2, 1), da, out=dall[:, :, d:])
    dall = dall.reshape(-1, 2 * d)
    product = _crossed(flat, dall)
    g["q"], g["k"] = product[:, :d] @ w["k"] * scaled, product[:, :d].T @ w["q"] * scaled
    g["v"], g["o"] = product[:, d:] @ w["o"].T, w["v"].T @ product[:, d:]
    dh += np.matmul(_parts(dall, PART), np.concatenate([agree, answer], axis=1).T).reshape(-1, d)
    g["place"] = np.zeros_like(w["place"])
    g["place"][:t] = (np.ones(n, dtype=dh.dtype) @ dh.reshape(n, t * d)).reshape(t, d)
    g["embed"] = np.zeros_like(w["embed"])
    g["embed"][ahead[edges]] = np.add.reduceat(np.take(dh, order, axis=0), edges, axis=0)
    return loss, g


def _clusters(vectors: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Each row's cluster of k, by k-means."""
    if len(vectors) <= k:
        return np.arange(len(vectors))
    centres = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(12):
        label = (vectors @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
        for c in range(k):
            if (label == c).any():
                centres[c] = vectors[label == c].mean(axis=0)
    return label


@contextlib.contextmanager
def one_thread() -> Iterator[None]:
    """Matrix products on one thread while the model is fitted: they are small, and threads would wait for each other."""
    calls = []
    with contextlib.suppress(OSError):  # only Linux has these maps
        with open("/proc/self/maps") as f:
            for path in {line.split()[-1] for line in f if "openblas" in line}:
                library = ctypes.CDLL(path)
                for name in ("scipy_openblas_{}_num_threads64_", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
                    if hasattr(library, name.format("set")):
                        calls.append((getattr(library, name.format("set")), getattr(library, name.format("get"))()))
                        break
    try:
        for put, _ in calls:
            put(1)
        yield
    finally:
        for put, before in calls:
            put(before)


def keep_memory() -> None:
    """Arrays of up to 32 MB that are freed stay with this process until release(): each would else have new pages, which
    take small steps as long as their sums. The GNU library comes to this by itself once a process has freed large ones.
    """
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has this
        put = ctypes.CDLL("libc.so.6").mallopt
        put(-3, 1 << 25)  # M_MMAP_THRESHOLD
        put(-1, 1 << 26)  # M_TRIM_THRESHOLD


def classes_of(initial: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's class, and whether a class begins a word; the last class, which no piece has, is the end of a text.

    initial: whether a piece begins a word; follows: how often each piece is followed by what.
    """
    rng = np.random.default_rng(SEED)
    counts = follows.sum(axis=1)
    order = np.argsort(-counts, kind="stable")
    frequent = order[:FREQUENT][counts[order[:FREQUENT]] > 0]
    classes = np.full(len(counts), -1)
    classes[frequent] = np.arange(len(frequent))
    after = np.sqrt(follows / np.maximum(1, counts[:, None])).astype(np.float32)
    begins, at = [bool(initial[i]) for i in frequent], len(frequent)
    for kind in (True, False):
        rest = np.flatnonzero((classes < 0) & (initial == kind))
        seen = rest[counts[rest] > 0]
        classes[seen] = at + _clusters(after[seen], CLUSTERS, rng)
        classes[rest[counts[rest] == 0]] = at + CLUSTERS  # pieces that training has not
        at += CLUSTERS + 1
        begins += [kind] * (CLUSTERS + 1)
    return classes, np.array([*begins, True])


def shares(classes: np.ndarray, size: int, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Log share of each piece among those of its class, after a piece of each class, smoothed towards its share of all.

    pairs: how often each piece follows a class in a word; in its last row, how often it begins one.
    """
    lone = (counts + 0.1) / np.bincount(classes, weights=counts + 0.1, minlength=size)[classes]
    within = np.empty((size, len(classes)), dtype=np.float32)
    for c in range(size):
        seen = np.bincount(classes, weights=pairs[c], minlength=size)
        within[c] = np.log((pairs[c] + SMOOTH * lone) / (seen + SMOOTH)[classes])
    return within


def _moving(w: dict[str, np.ndarray], attend: bool) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """A copy of the weights; and those that move, as one vector that the copy's are views of, with sums of their gradients and
    of these squared.
    """
    names = list(w) if attend else ["pairs"]
    flat, at, out = np.concatenate([w[k].reshape(-1) for k in names]), 0, dict(w)
    for k in names:
        out[k] = flat[at : at + w[k].size].reshape(w[k].shape)
        at += w[k].size
    return out, [flat, np.zeros_like(flat), np.zeros_like(flat)]


def _moved(w: dict[str, np.ndarray], moving: list[np.ndarray], g: dict[str, np.ndarray], i: int, rate: float) -> None:
    """Moves weights along their gradients, as Adam does in its i-th step."""
    flat, one, two = moving
    found = np.concatenate([g[k].reshape(-1) for k in w if w[k].base is flat])
    one *= np.float32(0.9)
    one += found
    two *= np.float32(0.99)
    found *= found
    two += found
    size = np.multiply(two, np.float32(0.01 / (1 - 0.99**i)), out=found)
    np.sqrt(size, out=size)
    size += np.float32(1e-6)
    np.divide(one, size, out=size)
    size *= np.float32(0.1 * rate / (1 - 0.9**i))
    flat -= size


def fit(classes: np.ndarray, initial: np.ndarray, within: np.ndarray, streams: list[np.ndarray], steps: int, attend: bool = True, counts: np.ndarray | None = None) -> Model:
    """A model trained on streams of classes; without any, a uniform one. Without attend, class pairs are trained alone.

    counts: how often each class follows each; None: as in the streams.
    """
    rng = np.random.default_rng(SEED)
    size = len(initial)
    pairs = np.full((size, size), 0.5)
    if counts is not None:
        pairs += counts
    for s in streams if counts is None else ():
        np.add.at(pairs, (s[:-1], s[1:]), 1)
    pairs = np.log(pairs / pairs.sum(axis=1, keepdims=True))
    w = {"embed": rng.normal(size=(size, WIDTH)) * 0.3, "place": rng.normal(size=(WINDOW, WIDTH)) * 0.1, "u": rng.normal(size=(WIDTH, size)) * 0.02, "pairs": pairs}
    w |= {m: rng.normal(size=(WIDTH, WIDTH)) / np.sqrt(WIDTH) for m in "qkvo"}
    if not attend:
        w["u"] *= 0
    w = {k: v.astype(np.float32) for k, v in w.items()}
    long = np.concatenate(streams) if streams else np.zeros(0, dtype=np.int64)
    if len(long) <= WINDOW + 1:
        return Model(classes, within, initial, w)
    w, moving = _moving(w, attend)
    for i in range(1, steps + 1):
        start = rng.integers(0, len(long) - WINDOW, TRAINED)
        both = long[start[:, None] + np.arange(WINDOW + 1)]
        _, g = _step(w, both[:, :-1], both[:, 1:])
        _moved(w, moving, g, i, 0.01 * min(1.0, i / 30) * (1 - 0.9 * i / steps))
    return Model(classes, within, initial, w)


def targets(classes: np.ndarray, end: int, ids: np.ndarray, of: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input, target, weight) for each piece and end of the texts, of so many ids, that so many training rows have."""
    y = np.full(len(ids) + len(of), end, dtype=np.int64)
    y[np.arange(len(ids)) + np.repeat(np.arange(len(of)), of)] = classes[ids]
    x = np.concatenate([[end], y[:-1]]) if len(y) else y
    weight = np.repeat(trains, of + 1)
    take = weight > 0
    return x[take], y[take], weight[take]


def lessons(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows (input, target, weight), LESSON at a time, that have each target of parts once; the last is filled up with such
    of weight zero.
    """
    held = [np.zeros(0, dtype=np.int64)] * 3
    for part in parts:
        held = [np.concatenate(x) for x in zip(held, part, strict=True)]
        whole = len(held[0]) // (LESSON * WINDOW) * LESSON * WINDOW
        for i in range(0, whole, LESSON * WINDOW):
            yield tuple(x[i : i + LESSON * WINDOW].reshape(LESSON, WINDOW) for x in held)
        held = [x[whole:] for x in held]
    if len(held[0]):
        yield tuple(np.append(x, np.full(-len(x) % WINDOW, fill)).reshape(-1, WINDOW) for x, fill in zip(held, (end, end, 0), strict=True))


def taught(weights: dict[str, np.ndarray], found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], tokens: int, weight: int, attend: bool = True) -> dict[str, np.ndarray]:
    """The weights after one pass over lessons of so many targets that weigh so much together."""
    (w, moving), steps = _moving(weights, attend), -(-tokens // (LESSON * WINDOW))
    unit = np.float32(tokens / (weight * LESSON * WINDOW))
    for i, (x, y, part) in enumerate(found, 1):
        _, g = _step(w, x, y, part * unit)
        _moved(w, moving, g, i, RATE * (1 - 0.9 * i / steps))
    return w


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, skip) of the windows over sequences of so many inputs; all but the first skip what is scored already."""
    stride = WINDOW - OVERLAP
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
    text = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, k * stride, np.where(k > 0, OVERLAP, 0)


def class_scores(model: Model, streams: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the classes of streams of so many, one after the other, each after the start of a text; and of a
    word beginning, or the text ending, at each of these places.
    """
    w, end = model.weights, model.end
    text, start, skip = windows(lengths)
    flat = np.concatenate([streams, np.zeros(WINDOW, dtype=np.int64)])
    begin = (np.cumsum(lengths) - lengths)[text] + start
    score, begins = np.zeros(int(lengths.sum()), dtype=np.float32), np.zeros(int(lengths.sum()), dtype=np.float32)
    d, size = w["embed"].shape[1], end + 1
    # Inputs with what attention makes of them, of each class at each place.
    every = (w["place"][:, None] + w["embed"]).reshape(-1, d)
    every = np.concatenate([every, every @ np.concatenate(_joined(w), axis=1)], axis=1)
    # Exponentials of the logits' two parts, of class pairs and of attention, are multiplied as they are summed.
    sums = np.exp(w["pairs"])[:, :, None] * np.stack([np.ones(size), model.initial], axis=1).astype(np.float32)
    u, z = np.ascontiguousarray(w["u"].T), np.empty((BLOCK, size), dtype=np.float32)
    for lead in (0, OVERLAP):  # the first windows of texts, and later ones, whose first inputs are scored already
        mine = np.flatnonzero(skip == lead)
        for a in range(0, len(mine), MANY):
            of = mine[a : a + MANY]
            at = begin[of][:, None] + np.arange(WINDOW)
            inside = start[of][:, None] + np.arange(WINDOW) < lengths[text[of]][:, None]
            inputs = np.where(inside, flat[np.maximum(at - 1, 0)], end)
            if not lead:
                inputs[:, 0] = end
            index, out = inputs + size * np.arange(WINDOW), np.empty((len(of), WINDOW - lead, d), dtype=np.float32)
            for i in range(0, len(of), BATCH):
                h = np.take(every, index[i : i + BATCH], axis=0)
                np.add(_attended(h[:, lead:, d : 2 * d], h[:, :, :d], h[:, :, 2 * d :])[1], h[:, lead:, :d], out=out[i : i + BATCH])
            # Inputs of one class, one class after the other.
            chosen = np.flatnonzero(inside[:, lead:])
            ahead = inputs[:, lead:].reshape(-1)[chosen]
            order = np.argsort(ahead.astype(np.int16), kind="stable")
            chosen, ahead = chosen[order], ahead[order]
            own, place = np.take(out.reshape(-1, d), chosen, axis=0), at[:, lead:].reshape(-1)[chosen]
            to, both = flat[place], np.empty((len(own), 2), dtype=np.float32)
            edges = np.searchsorted(ahead, np.arange(size + 1)).tolist()
            for c in range(size):
                for i in range(edges[c], edges[c + 1], BLOCK):
                    j = min(i + BLOCK, edges[c + 1])
                    part = np.matmul(own[i:j], w["u"], out=z[: j - i])
                    # Logits are small, so that their exponentials stay finite without each row's maximum; checked below.
                    np.exp(part, out=part)
                    np.matmul(part, sums[c], out=both[i:j])
            both += np.float32(1e-30)
            np.log(both, out=both)
            want = np.einsum("ij,ij->i", own, np.take(u, to, axis=0)) + w["pairs"].reshape(-1)[ahead * size + to]
            score[place], begins[place] = want - both[:, 0], both[:, 1] - both[:, 0]
    if not (np.isfinite(score).all() and np.isfinite(begins).all()):
        raise FloatingPointError("the model's logits are out of range")
    return score, begins


# -- words and pieces -------------------------------------------------------------------------------------------------


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of tidied texts, one after the other, and how many each text has."""
    h, sizes, *_ = _hashed(raws)
    return h, sizes


def _hashed(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, and the texts' bytes, each behind a space, with where words start and end in these."""
    data = np.frombuffer(b" ".join([*raws, b""]), dtype=np.uint8)
    start, end = spans(data)
    stops = np.cumsum([len(r) + 1 for r in raws])
    return span_hashes(data, start, end), np.bincount(np.searchsorted(stops, start, side="right"), minlength=len(raws)), data, start, end


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, where one of each kind is, and of which kind each is. Unlike np.unique it does not ask for the
    first of a kind, as all are one word, and hence for no stable sort.
    """
    order = np.argsort(h)
    ranked, kind = h[order], np.empty(len(h), dtype=np.int64)
    new = np.ones(len(h), dtype=bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    kind[order] = np.cumsum(new) - 1
    return ranked[new], order[new], kind


def distinct_words(raws: list[bytes], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, bytes, sizes) of the distinct words of tidied texts that count so much each; the bytes have a space
    behind every word, which sizes count too.
    """
    return numbered_words(raws, weight)[:4]


def numbered_words(raws: list[bytes], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """As distinct_words; and for each run of texts, from one to the next, how many words they have and which of the distinct
    ones these are.
    """
    none = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    parts, runs = [], []
    for a, b in chunks([len(r) for r in raws], CHUNK):
        h, sizes, data, start, end = _hashed(raws[a:b])
        u, at, back = _distinct(h)
        size = end[at] - start[at] + 1
        parts.append((u, np.bincount(back, weights=np.repeat(weight[a:b], sizes), minlength=len(u)), data[_ranges(start[at], size)], size))
        runs.append((a, b, sizes, back.astype(np.uint32)))
    if not parts:
        return *none, []
    ahead = np.cumsum([0, *(len(p[0]) for p in parts)])
    h, count, data, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    u, at, back = _distinct(h)
    start, back32 = np.cumsum(size) - size, back.astype(np.uint32)
    runs = [(a, b, sizes, back32[i:j][own]) for (a, b, sizes, own), i, j in zip(runs, ahead, ahead[1:], strict=False)]
    return u, np.bincount(back, weights=count, minlength=len(u)), data[_ranges(start[at], size[at])], size[at], runs


def spelled(pieces: Pieces, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of words, as they stand behind a space, and how many each has."""
    flat, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i in range(0, len(words), 100_000):
        ids, size = pieces.encode_words([MARK + w.decode().replace(MARK, "_") for w in words[i : i + 100_000]])
        flat.append(ids)
        sizes.append(size)
    return np.concatenate(flat), np.concatenate(sizes)


def piece_pairs(flat: np.ndarray, sizes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, count) of what follows what in words that occur so often: a piece or the word's start, then a piece or its end,
    of 16 bits each.
    """
    ends = np.cumsum(sizes)
    before = np.concatenate([[EDGE], flat[:-1]]).astype(np.uint32) if len(flat) else np.zeros(0, np.uint32)
    before[ends - sizes] = EDGE
    pair = np.concatenate([before << np.uint32(16) | flat.astype(np.uint32), flat[ends - 1].astype(np.uint32) << np.uint32(16) | np.uint32(EDGE)])
    u, back = np.unique(pair, return_inverse=True)
    return u, np.bincount(back, weights=np.concatenate([np.repeat(count, sizes), count]), minlength=len(u)).astype(np.int64)


# -- scores of texts --------------------------------------------------------------------------------------------------


def _order(x: np.ndarray) -> np.ndarray:
    """The stable order of unsigned numbers, by 16 bits at a time, as so few are sorted by counting."""
    order = np.argsort(x.astype(np.uint16), kind="stable")
    for shift in range(16, int(x.max(initial=0)).bit_length(), 16):
        order = order[np.argsort((x >> x.dtype.type(shift)).astype(np.uint16)[order], kind="stable")]
    return order


def repeated(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of texts with so many words the share of its text's words before it that are the same; and their number."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = _order(words)
    same = np.concatenate([[False], (words[order][1:] == words[order][:-1]) & (text[order][1:] == text[order][:-1])])[: len(words)]
    place = np.arange(len(words))
    times = np.empty(len(words))
    times[order] = place - np.maximum.accumulate(np.where(same, 0, place)) if len(words) else 0.0
    return times / np.maximum(at, 1), at


def text_scores(model: Model, ids: np.ndarray, spelling: np.ndarray, words: np.ndarray, known: np.ndarray, sizes: np.ndarray, n: float, v: int, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, score, known tokens) of texts with so many words, which have spelling[i] of the ids each, and the training counts
    known.

    n: training tokens; v: distinct ones; ends: training texts, each of which has one end.
    """
    texts = np.arange(len(sizes))
    of = np.bincount(np.repeat(texts, sizes), weights=spelling, minlength=len(sizes)).astype(np.int64)
    lengths = of + 1
    at = np.arange(len(ids)) + np.repeat(texts, of)  # places of pieces, the end of each text behind its own
    classes = model.classes[ids]
    flat = np.full(len(ids) + len(sizes), model.end, dtype=np.int64)
    flat[at] = classes
    log_class, begins = class_scores(model, flat, lengths)
    piece = log_class.astype(np.float64)
    before = np.concatenate([[model.end], flat[:-1]])[at] if len(at) else at
    piece[at] += model.within[np.where(model.initial[classes], model.end, before), ids]
    # Words, ends among them: pieces from one beginning to the next, given that a word begins; its own end is the next one's beginning.
    is_end = np.zeros(len(words) + len(sizes), dtype=bool)
    is_end[np.cumsum(sizes + 1) - 1] = True
    head = np.empty(len(is_end), dtype=np.int64)
    head[~is_end], head[is_end] = at[np.cumsum(spelling) - spelling] if len(words) else 0, np.cumsum(lengths) - 1
    word = np.add.reduceat(piece, head) - begins[head]
    word += np.where(is_end, 0.0, np.append(begins[head][1:], 0.0))
    counts = np.zeros(len(is_end))
    counts[~is_end], counts[is_end] = known, ends
    same, place = repeated(words, sizes)
    so_far, weight = np.zeros(len(is_end)), np.zeros(len(is_end))
    so_far[~is_end], weight[~is_end] = same, SO_FAR * place / (place + HALF)
    share = (counts + 0.5) / (n + 0.5 * (v + 1))
    mixed = SHARE * np.exp(word) + weight * so_far + (1 - SHARE - weight) * share
    edge = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    return np.add.reduceat(np.log10(share), edge), np.add.reduceat(np.log10(mixed), edge), np.add.reduceat((counts > 0).astype(np.int64), edge)


# -- the passes -------------------------------------------------------------------------------------------------------


def _packed(rows: DataFrame, buckets: int, share: float) -> DataFrame:
    """(d, data): distinct texts, tidied, with their digest and how many training rows have them, by bucket; and, as bucket -1,
    runs of words of training texts, each with this chance.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t.encode() for t in pdf["text"]]
            for a, b in chunks([len(t) for t in texts], 4_000_000):
                found: dict[bytes, list] = {}
                for raw, trains in zip(texts[a:b], pdf["trains"].iloc[a:b].tolist(), strict=True):
                    entry = found.setdefault(hashlib.sha256(raw).digest(), [raw, 0])
                    entry[1] += trains
                out = []
                for key, entry in found.items():
                    entry[0] = _tidied(entry[0])
                    out += [(-1, x) for x in _drawn(key, *entry, share)]
                keys = list(found)
                at = np.array([int.from_bytes(k[:6], "little") % buckets for k in keys])
                for d in np.unique(at).tolist():
                    mine = [keys[i] for i in np.flatnonzero(at == d)]
                    raws = [found[k][0] for k in mine]
                    out.append((d, _squeeze(b"".join(mine), np.array([found[k][1] for k in mine], dtype=np.int64), np.array([len(r) for r in raws], dtype=np.int64), b"".join(raws))))
                yield pd.DataFrame(out, columns=["d", "data"])

    return rows.mapInPandas(run, "d int, data binary")


def _drawn(key: bytes, raw: bytes, times: int, share: float) -> list[bytes]:
    """Runs of DRAWN words of a tidied text that so many training rows have, each run of each row with this chance, the text's
    digest deciding; a run has a newline where the text begins and ends.
    """
    runs = 1 + raw.count(b" ") // DRAWN
    picks = np.random.default_rng(list(key[:8]))
    chosen = picks.integers(0, runs, picks.binomial(runs * times, min(1.0, share))) if times else ()
    if not len(chosen):
        return []
    words = raw.split(b" ")
    return [(b"\n" if j == 0 else b"") + b" ".join(words[j * DRAWN : (j + 1) * DRAWN]) + (b"\n" if j == runs - 1 else b"") for j in sorted(chosen.tolist())]


def _unpacked(blobs: list[bytes]) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """Digests, training rows and texts of a bucket, each text once, in order of the digests."""
    found: dict[bytes, list] = {}
    for blob in blobs:
        keys, trains, sizes, raw = _unsqueeze(blob)
        sizes = np.frombuffer(sizes, np.int64)
        ends = np.cumsum(sizes).tolist()
        for i, (t, e, s) in enumerate(zip(np.frombuffer(trains, np.int64).tolist(), ends, sizes.tolist(), strict=True)):
            entry = found.setdefault(keys[32 * i : 32 * i + 32], [0, raw[e - s : e]])
            entry[0] += t
    order = sorted(found)
    return order, np.array([found[k][0] for k in order], dtype=np.int64), [found[k][1] for k in order]


@functools.lru_cache(maxsize=1)
def _pieces(tokenizer: bytes) -> Pieces:
    return Pieces(tokenizer)


def _summed(blobs: DataFrame, row_of: np.ndarray, column_of: np.ndarray) -> pd.DataFrame:
    """(row, col, n): the counts of all pairs (data), summed by what their first and second halves stand for; -1: left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["data"]:
                pair, count = (np.frombuffer(x, t) for x, t in zip(_unsqueeze(blob), (np.uint32, np.int64), strict=True))
                row, col = row_of[pair >> np.uint32(16)], column_of[pair & np.uint32(EDGE)]
                take = (row >= 0) & (col >= 0)
                u, back = np.unique(row[take] << 32 | col[take], return_inverse=True)
                yield pd.DataFrame({"row": (u >> 32).astype(np.int32), "col": (u & 0xFFFFFFFF).astype(np.int32), "n": np.bincount(back, weights=count[take], minlength=len(u)).astype(np.int64)})

    return blobs.select("data").mapInPandas(run, "row int, col int, n long").groupBy("row", "col").agg(F.sum("n").alias("n")).toPandas()


def kinds(pieces: Pieces, pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, which of them begin words, and shares of pieces, from what follows what in all training words (data, as
    piece_pairs).
    """
    n = len(pieces.piece_len)
    if n >= EDGE:
        raise ValueError("pieces are told apart by 16 bits")
    number, none = np.full(EDGE + 1, -1), np.full(EDGE + 1, -1)
    number[:n] = np.arange(n)
    follower = np.where(np.arange(EDGE + 1) == EDGE, FOLLOWERS, np.arange(EDGE + 1) % FOLLOWERS)
    found = _summed(pairs, number, follower)
    follows = np.zeros((n, FOLLOWERS + 1))
    follows[found["row"], found["col"]] = found["n"]
    classes, initial = classes_of(pieces.mark_first, follows)
    none[:n], none[EDGE] = classes, len(initial) - 1
    found = _summed(pairs, none, number)
    after = np.zeros((len(initial), n))
    after[found["row"], found["col"]] = found["n"]
    return classes, initial, shares(classes, len(initial), follows.sum(axis=1), after)


def begun(pieces: Pieces, classes: np.ndarray, initial: np.ndarray, within: np.ndarray, drawn: list[bytes], steps: int, attend: bool = True, counts: np.ndarray | None = None) -> Model:
    """A model that has taken so many steps on drawn runs of text; counts as fit has them."""
    encoder, end, streams = Encoder(pieces, False), [len(initial) - 1], []
    for x, y in chunks([len(run) for run in drawn], CHUNK):
        ids = encoder.ids([run.strip(b"\n").decode().replace(MARK, "_") for run in drawn[x:y]])
        streams += [np.concatenate([end if run.startswith(b"\n") else [], classes[i], end if run.endswith(b"\n") else []]).astype(np.int64) for run, (i, _) in zip(drawn[x:y], ids, strict=True)]
    with one_thread():
        return fit(classes, initial, within, streams, steps, attend, counts)


def learn(pieces: Pieces, pairs: DataFrame, drawn: list[bytes], steps: int, attend: bool = True) -> Model:
    """A model from what follows what in all training words, and drawn runs of text alone."""
    return begun(pieces, *kinds(pieces, pairs), drawn, steps, attend)


def _answered(replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of a bucket's words, how many ids each has and where these begin, and the ids, from what all buckets reply."""
    parts = [[np.frombuffer(x, t) for x, t in zip(_unsqueeze(data), (np.int64, np.uint32, np.uint16), strict=True)] for _, data in sorted(zip(replies["b"].tolist(), replies["data"].tolist(), strict=True))]
    if not parts:
        parts = [[np.zeros(0, t) for t in (np.int64, np.uint32, np.uint16)]]
    count, size, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    size = size.astype(np.int64)
    return count, size, np.cumsum(size) - size, ids


#: What a run of coded texts has: digests, training rows, words and pieces of each text; which word, how often in training
#: and how many pieces for each word, as numbers of as many bytes as it takes; and the pieces.
_CODED = (None, np.int64, np.int64, np.int64, np.uint32, "u", "u", np.uint16)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _decoded(data: bytes) -> list:
    parts = _unsqueeze(data)
    words = max(1, len(parts[4]) // 4)
    return [x if t is None else np.frombuffer(x, f"u{max(1, len(x) // words)}" if t == "u" else t) for x, t in zip(parts, _CODED, strict=True)]


def passed(coded: DataFrame, model: Model, attend: bool = True) -> Model:
    """The model after each bucket has gone over all of its training text, as the mean of what they arrive at."""
    classes, end, begin = model.classes, model.end, model.weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((d, t, w, x) for pdf in batches for d, t, w, x in zip(*(pdf[c].tolist() for c in ("d", "tokens", "weight", "data")), strict=True))
        keep_memory()
        with one_thread():
            for (d, tokens, weight), group in itertools.groupby(rows, lambda r: r[:3]):
                if tokens:
                    parts = (targets(classes, end, ids, of, trains) for _, trains, _, of, *_, ids in (_decoded(r[3]) for r in group))
                    w = taught(begin, lessons(parts, end), tokens, weight, attend)
                    yield pd.DataFrame([(d, weight, b"".join(w[k].tobytes() for k in begin))], columns=["d", "weight", "data"])
        release()

    sums, total = np.zeros(sum(v.size for v in begin.values())), 0
    for r in cut(coded.mapInPandas(run, "d int, weight long, data binary")).toLocalIterator():
        sums += r["weight"] * np.frombuffer(bytes(r["data"]), np.float32).astype(np.float64)
        total += r["weight"]
    if not total:
        return model
    ends = np.cumsum([v.size for v in begin.values()])
    weights = {k: (sums[e - v.size : e] / total).reshape(v.shape).astype(np.float32) for (k, v), e in zip(begin.items(), ends, strict=True)}
    return Model(model.classes, model.within, model.initial, weights)


def scores(docs: DataFrame, tokenizer: bytes, steps: int = STEPS, buckets: int | None = None, attend: bool = True) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs, as op4 asks.

    Null texts count as empty, of one token, the end. Rows without a doc_id are training rows. Repeated rows count again in
    training, and get equal scores. Without training rows all counts are zero, and the model is uniform. An empty table
    gives no rows. Without attend the attention is left out, and the rest trained alone, to see what it does.
    """
    n = buckets or partitions(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), held_out().alias("held_out"))
    seen = rows.where(~F.col("held_out")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    ends, chars = seen["rows"], seen["chars"] or 0
    steps = math.ceil(steps * math.log2(2 + chars))
    # Twice the pieces that the steps look at, of some three characters each, in runs of DRAWN words of some seven.
    share = 2 * steps * TRAINED * (WINDOW + 1) * 3 / max(1, chars)
    store, packed_at = written(_packed(rows.select("text", (~F.col("held_out")).cast("int").alias("trains")), n, share), "packed")
    drawn = sorted(bytes(r["data"]) for r in cut(store.where("d < 0").select("data")).toLocalIterator())

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        """The words that the bucket's texts have, and how many training words they are here; and, as buckets below 0, runs of
        the texts as numbers of these words, in order of the buckets that they go to.
        """
        keep_memory()
        keys, weight, raws = _unpacked(pdf["data"].tolist())
        h, count, data, size, runs = numbered_words(raws, weight)
        del raws
        start, count, d = np.cumsum(size) - size, count.astype(np.int64), int(pdf["d"].iloc[0])
        sent = list(_by_bucket(h, n))
        number = np.empty(len(h), dtype=np.uint32)
        number[np.concatenate([i for _, i in sent]) if sent else []] = np.arange(len(h), dtype=np.uint32)
        out = [(b, d, _squeeze(count[i], data[_ranges(start[i], size[i])])) for b, i in sent]
        out += [(-1 - j, d, _squeeze(b"".join(keys[a:b]), weight[a:b], sizes, number[own])) for j, (a, b, sizes, own) in enumerate(runs)]
        release()
        return pd.DataFrame(out, columns=["b", "d", "data"])

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        """The words' counts in all training rows and their ids, for each bucket that has them; of these words n and v in one
        row; and as bucket -1 what follows what in them.
        """
        keep_memory()
        parts = [_unsqueeze(x) for x in pdf["data"]]
        h, sizes, data, start, end = _hashed([p[1] for p in parts])
        h, at, back = _distinct(h)
        count = np.bincount(back, weights=np.concatenate([np.frombuffer(p[0], np.int64) for p in parts]), minlength=len(h)).astype(np.int64)
        raw = data.tobytes()
        flat, size = spelled(_pieces(tokenizer), [raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        flat, first, b = flat.astype(np.uint16), np.cumsum(size) - size, int(pdf["b"].iloc[0])
        out, stops = [], np.cumsum(sizes).tolist()
        for d, m, e in zip(pdf["d"].tolist(), sizes.tolist(), stops, strict=True):
            i = back[e - m : e]
            out.append((d, b, _squeeze(count[i], size[i].astype(np.uint32), flat[_ranges(first[i], size[i])]), 0, 0))
        out[0] = (*out[0][:3], int(count.sum()), int((count > 0).sum()))
        some = count > 0
        if some.any():
            out.append((-1, b, _squeeze(*piece_pairs(flat[_ranges(first[some], size[some])].astype(np.int64), size[some], count[some])), 0, 0))
        release()
        return pd.DataFrame(out, columns=["d", "b", "data", "n", "v"])

    told, told_at = written(store.where("d >= 0").groupBy("d").applyInPandas(tell, "b int, d int, data binary"), "told")
    removed(docs.sparkSession, packed_at)
    answers = cut(told.where("b >= 0").groupBy("b").applyInPandas(weigh, "d int, b int, data binary, n long, v long"))
    sums = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, distinct = int(sums["n"] or 0) + ends, int(sums["v"] or 0) + (ends > 0)
    pieces = Pieces(tokenizer)
    classes, initial, within = kinds(pieces, answers.where("d < 0"))

    def code(mine: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """The bucket's texts as pieces, in runs, with what training has of them; and as bucket -1 how often a class follows a
        class in these.
        """
        keep_memory()
        count, size, start, spelling = _answered(replies)
        out, tokens, weight, pairs, end = [], 0, 0, np.zeros(len(initial) ** 2), len(initial) - 1
        few, short = _narrow(count), _narrow(size)
        for _, data in sorted(zip(mine["b"].tolist(), mine["data"].tolist(), strict=True), reverse=True):
            keys, trains, sizes, own = (x if t is None else np.frombuffer(x, t) for x, t in zip(_unsqueeze(data), (None, np.int64, np.int64, np.uint32), strict=True))
            long = size[own]
            of = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=long, minlength=len(sizes)).astype(np.int64)
            ids = spelling[_ranges(start[own], long)]
            x, y, w = targets(classes, end, ids, of, trains)
            pairs += np.bincount(x * len(initial) + y, weights=w, minlength=len(pairs))
            tokens, weight = tokens + len(x), weight + int(w.sum())
            out.append(_squeeze(keys, trains, sizes, of, own, few[own], short[own], ids))
        d = int(mine["d"].iloc[0])
        out = [(d, tokens, weight, x) for x in out] + [(-1, 0, 0, _squeeze(pairs.astype(np.int64)))]
        release()
        return pd.DataFrame(out, columns=["d", "tokens", "weight", "data"])

    met = told.where("b < 0").groupBy("d").cogroup(answers.where("d >= 0").select("d", "b", "data").groupBy("d"))
    every = cut(met.applyInPandas(code, "d int, tokens long, weight long, data binary"))
    coded = every.where("d >= 0")
    removed(docs.sparkSession, told_at)
    follow = sum((np.frombuffer(_unsqueeze(bytes(r["data"]))[0], np.int64) for r in every.where("d < 0").select("data").toLocalIterator()), np.zeros(len(initial) ** 2, dtype=np.int64))
    model = passed(coded, begun(pieces, classes, initial, within, drawn, steps, attend, follow.reshape(len(initial), -1)), attend)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_memory()
        with one_thread():
            for pdf in batches:
                for data in pdf["data"]:
                    keys, _, sizes, _, own, known, long, ids = _decoded(data)
                    base, score, seen = text_scores(model, ids.astype(np.int64), long.astype(np.int64), own, known, sizes, total, distinct, ends)
                    yield pd.DataFrame({"key": [keys[i : i + 32] for i in range(0, len(keys), 32)], "n_tokens": sizes + 1, "n_known": seen, "base_score": base, "score": score})
        release()

    scored = coded.mapInPandas(judge, "key binary, n_tokens long, n_known long, base_score double, score double")
    own = rows.select("doc_id", "held_out", F.unhex(F.sha2("text", 256)).alias("key"))
    return own.join(scored, "key").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
