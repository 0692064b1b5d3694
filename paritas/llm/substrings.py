"""Removal of byte strings that repeat across documents.

Every window of LENGTH bytes is named by its anchor, the k-gram of least hash in it, so that equal windows have equal
anchors. Distinct texts are stored in buckets by digest; each bucket tells which anchors it has, and learns which of them
other texts have too. Only windows of such shared anchors are compared: neighbouring windows of one anchor form a region,
and distinct regions meet by anchor. There the windows' classes come from a suffix order of the regions' bytes: breadth-
first backward extension on its Burrows-Wheeler transform derives common prefixes by increasing length, and stops at
LENGTH. Each class answers with the smallest document that has it.

Regions are compared byte by byte, so that colliding hashes cost work but change nothing. A text, anchor or region that
many documents share is sent once by each bucket. An anchor with very many texts, whose regions would crowd one task, is
replaced by its windows, each its own region under its own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.common import chunks, cut, freed, partitions, release
from paritas.llm.hashing import mix

LENGTH, GRAM = 50, 16
#: Texts that share an anchor from which its windows are spread by their own hashes.
CROWD = 20_000
#: Bytes whose windows are named at a time, and of regions whose suffixes are ordered at a time.
FLAT, ORDERED = 1 << 20, 1 << 17
LAST = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()


def _squeeze(*arrays: np.ndarray | bytes) -> bytes:
    import zstandard

    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    sizes = np.array([len(parts), *map(len, parts)], dtype="<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(parts))


def _unsqueeze(blob: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw[:8], "<u8")[0])
    sizes = np.frombuffer(raw[8 : 8 + 8 * n], "<u8").astype(np.int64)
    ends = 8 + 8 * n + np.cumsum(sizes)
    return [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _six(values: np.ndarray) -> bytes:
    """48-bit numbers, six bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number."""
    x = data.astype(np.uint64)
    for bits in (8, 16, 32):
        step = bits // 8
        x = x[:-step] | x[step:] << np.uint64(bits)
    return x


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, windows, hash): the runs of neighbouring windows with one anchor, at start in the text, and the anchor's
    48-bit hash. Texts of fewer than length bytes have none.
    """
    none = (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < length:
        return none
    if len(data) >= 1 << 24:
        return _anchors_of_long(texts, length, gram)
    eight = _words(data)
    h = mix(eight[: len(data) - gram + 1] * np.uint64(0x9E3779B97F4A7C15) + eight[gram - 8 :][: len(data) - gram + 1]) >> np.uint64(16)
    least = (h >> np.uint64(8)) << np.uint64(24) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    offset = np.cumsum(sizes) - sizes
    fits = sizes >= length
    change = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(change, offset[fits], 1)
    np.add.at(change, (offset + sizes - length + 1)[fits], -1)
    start = np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8))
    if not len(start):
        return none
    at = (least[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.searchsorted(np.cumsum(sizes), start, side="right")
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    return text[head], start[head] - offset[text[head]], np.diff(np.append(head, len(start))), h[at[head]]


def _anchors_of_long(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """As anchors, text by text and in overlapping parts, for more bytes than positions are packed for."""
    found = []
    for t, raw in enumerate(texts):
        part = 1 << 22
        for at in range(0, max(1, len(raw) - length + 1), part):
            _, start, windows, h = anchors([raw[at : at + part + length - 1]], length, gram)
            found.append((np.full(len(start), t), start + at, windows, h))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# -- classes of windows ---------------------------------------------------------------------------------------------


def window_classes(strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, class) of each window of length bytes of the strings, in order; equal windows, and only these, share a class.

    The suffixes are ordered by more symbols than length, and the Burrows-Wheeler transform taken of that order. Level by
    level, a boundary between neighbours in the order goes in where the suffixes one symbol on, to which the transform
    leads, were parted the level before: these are the common prefixes of that length. At length the rest is repeats.
    """
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    total = int(sizes.sum()) + len(strings)
    symbols = np.zeros(total + 64, dtype=np.uint64)
    offset = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(total, dtype=bool)
    inside[offset + sizes] = False
    symbols[:total][inside] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    rank = np.zeros(total + 64, dtype=np.uint64)
    for i in range(7):
        rank[:total] = rank[:total] << np.uint64(9) | symbols[i : total + i]
    span = 7
    while True:
        order = np.argsort(rank[:total])
        key = rank[order]
        dense = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])).astype(np.uint64)
        rank[order] = dense
        rank[total:] = 0
        if span > length:
            break
        rank[:total] = rank[:total] << np.uint64(32) | rank[span : total + span]
        span *= 2
    # The symbol before each suffix in order; a stable order of these leads from a suffix to the one a symbol on.
    before = symbols[:total][order - 1].astype(np.uint16)
    onward = np.argsort(before, kind="stable")
    first = before[onward]
    parted = np.concatenate([[True], first[1:] != first[:-1]])
    open_ = np.flatnonzero(~parted)
    ahead, behind = onward[open_], onward[open_ - 1]
    for _ in range(1, length):
        group = np.cumsum(parted, dtype=np.int32)
        split = group[ahead] != group[behind]
        if not split.any():
            break
        parted[open_[split]] = True
        open_, ahead, behind = open_[~split], ahead[~split], behind[~split]
    classes = np.empty(total, dtype=np.int64)
    classes[order] = np.cumsum(parted)
    windows = np.maximum(0, sizes - length + 1)
    string = np.repeat(np.arange(len(strings)), windows)
    at = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + offset[string]
    return string, classes[at]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of range(start, start + size) for each pair, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)


def first_documents(hashes: np.ndarray, docs: np.ndarray, strings: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For each window of each string, in order, the smallest of docs that has it, among strings of the same hash.

    Strings of a hash that are all equal are settled as such; where several differ, their windows' classes come from the
    transform.
    """
    seen: dict[tuple[int, bytes], int] = {}
    which = np.array([seen.setdefault(k, len(seen)) for k in zip(hashes.tolist(), strings, strict=True)], dtype=np.int64)
    distinct = [raw for _, raw in seen]
    least = np.full(len(distinct), LAST)
    np.minimum.at(least, which, docs)
    size = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct)) - length + 1
    start = np.cumsum(size) - size
    flat = np.repeat(least, size)
    # Of an anchor with one region all windows are this region's; several regions can share windows.
    _, group, count = np.unique(np.fromiter((h for h, _ in seen), dtype=np.uint64, count=len(seen)), return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[group] > 1)
    several = several[np.argsort(group[several], kind="stable")]
    edges = np.flatnonzero(np.concatenate([[True], group[several][1:] != group[several][:-1], [True]])) if len(several) else np.zeros(1, np.int64)
    total = np.concatenate([[0], np.cumsum(size[several] + length - 1)])
    for x, y in chunks(np.diff(total[edges]).tolist(), ORDERED):
        members = several[edges[x] : edges[y]]
        string, cls = window_classes([distinct[i] for i in members.tolist()], length)
        small = np.full(int(cls.max()) + 1, LAST)
        np.minimum.at(small, cls, least[members][string])
        flat[_ranges(start[members], size[members])] = small[cls]
    return flat[_ranges(start[which], size[which])]


# -- the passes -----------------------------------------------------------------------------------------------------


def _store(docs: DataFrame, buckets: int) -> DataFrame:
    """(d, data): distinct texts with their digest and smallest document, packed, by bucket of the digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t.encode() for t in pdf["text"]]
            for a, b in chunks([len(t) for t in texts], 4 * FLAT):
                least: dict[bytes, tuple[int, bytes]] = {}
                for doc, raw in zip(pdf["doc"].iloc[a:b].tolist(), texts[a:b], strict=True):
                    key = hashlib.sha256(raw).digest()
                    if key not in least or doc < least[key][0]:
                        least[key] = (doc, raw)
                keys = list(least)
                at = np.array([int.from_bytes(k[:6], "little") % buckets for k in keys])
                rows = []
                for d in np.unique(at).tolist():
                    mine = [keys[i] for i in np.flatnonzero(at == d)]
                    raws = [least[k][1] for k in mine]
                    ids = np.array([least[k][0] for k in mine], dtype=np.int64)
                    rows.append((d, _squeeze(b"".join(mine), ids, np.array([len(r) for r in raws], dtype=np.int64), b"".join(raws))))
                yield pd.DataFrame(rows, columns=["d", "data"])
                del least, keys, rows
            del pdf, texts
            release()

    return docs.mapInPandas(run, "d int, data binary")


def _texts(blobs: list[bytes]) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """Digests, smallest documents and texts of a bucket, each text once, in order of the digests."""
    found: dict[bytes, tuple[int, bytes]] = {}
    for blob in blobs:
        keys, ids, sizes, raw = _unsqueeze(blob)
        ends = np.cumsum(np.frombuffer(sizes, np.int64))
        for i, (doc, e, s) in enumerate(zip(np.frombuffer(ids, np.int64).tolist(), ends.tolist(), np.frombuffer(sizes, np.int64).tolist(), strict=True)):
            key = keys[32 * i : 32 * i + 32]
            if key not in found or doc < found[key][0]:
                found[key] = (doc, raw[e - s : e])
    order = sorted(found)
    return order, np.array([found[k][0] for k in order], dtype=np.int64), [found[k][1] for k in order]


def _by_bucket(values: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of the values of each bucket, the remainder of a value."""
    at = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]])) if len(at) else []
    for a, b in zip(edges, np.append(edges[1:], len(order)) if len(at) else [], strict=True):
        yield int(at[order[a]]), order[a:b]


def _runs(texts: list[bytes], length: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Anchors of bounded runs of texts, and the number of the first of these."""
    for a, b in chunks([len(t) for t in texts], FLAT):
        yield a, anchors(texts[a:b], length)


def _regions(texts: list[bytes], docs: np.ndarray, shared: np.ndarray, crowded: np.ndarray, length: int):
    """The distinct regions of a bucket's texts under shared anchors, and each one's places.

    (hash, doc, bytes) by region, ordered; and (region, text, start, windows) by place, by text.
    """
    seen: dict[tuple[int, bytes], int] = {}
    places = []
    for base, (text, start, windows, h) in _runs(texts, length):
        if not len(shared):
            break
        at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        use = shared[at] == h
        crowd = use & crowded[at]
        use &= ~crowd
        text = text + base
        named = [(x, texts[t][s:e]) for x, t, s, e in zip(h[use].tolist(), text[use].tolist(), start[use].tolist(), (start + windows + length - 1)[use].tolist(), strict=True)]
        t, s, w = text[use], start[use], windows[use]
        if crowd.any():  # each window by itself, under its own hash
            many = np.repeat(text[crowd], windows[crowd])
            each = _ranges(start[crowd], windows[crowd])
            raws = [texts[i][j : j + length] for i, j in zip(many.tolist(), each.tolist(), strict=True)]
            named += [(int.from_bytes(hashlib.blake2b(r, digest_size=6).digest(), "little"), r) for r in raws]
            t, s, w = np.concatenate([t, many]), np.concatenate([s, each]), np.concatenate([w, np.ones(len(each), dtype=np.int64)])
        region = np.array([seen.setdefault(k, len(seen)) for k in named], dtype=np.int64)
        order = np.argsort(t, kind="stable")
        places.append((region[order], t[order], s[order], w[order]))
    region, text, start, windows = (np.concatenate(x) for x in zip(*places, strict=True)) if places else (np.zeros(0, dtype=np.int64),) * 4
    least = np.full(len(seen), LAST)
    np.minimum.at(least, region, docs[text])
    hashes = np.fromiter((h for h, _ in seen), dtype=np.uint64, count=len(seen))
    return hashes, least, [raw for _, raw in seen], region, text, start, windows


def _shared_of(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shared anchors that a bucket was told, ordered, and which are crowded."""
    parts = [_unsqueeze(b) for b in blobs]
    h = np.concatenate([_from_six(p[0]) for p in parts]) if parts else np.zeros(0, dtype=np.uint64)
    c = np.concatenate([np.frombuffer(p[1], bool) for p in parts]) if parts else np.zeros(0, dtype=bool)
    order = np.argsort(h)
    return h[order], c[order]


def _freed(work: Callable[..., pd.DataFrame]) -> Callable[..., pd.DataFrame]:
    """work on a group, after which what it held goes back to the system."""

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        out = work(pdf)
        release()
        return out

    def together(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = work(mine, answers)
        release()
        return out

    return together if work.__code__.co_argcount == 2 else alone


def repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, buckets: int | None = None) -> DataFrame:
    """(key, doc, n_bytes, n_removed, n_spans, kept_sha256): of each distinct text, in its document of smallest id, what is
    left without the bytes that length-byte strings cover which a document of smaller id has too.
    """
    n = buckets or partitions(docs.sparkSession)
    store = _store(docs, n)

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        """What anchors the bucket has, and how many of its texts have each."""
        _, _, texts = _texts(pdf["data"].tolist())
        found = []
        for _, (text, _, _, h) in _runs(texts, length):
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            found.append(h[np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])] if len(h) else h)
        h, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        d = int(pdf["d"].iloc[0])
        return pd.DataFrame([(b, d, _squeeze(_six(h[i]), count[i].astype(np.uint32))) for b, i in _by_bucket(h, n)], columns=["b", "d", "data"])

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        """Which anchors of the bucket several texts have, for each of the buckets that have them."""
        parts = [_unsqueeze(x) for x in pdf["data"]]
        each = [_from_six(p[0]) for p in parts]
        h, back = np.unique(np.concatenate(each), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([np.frombuffer(p[1], np.uint32) for p in parts]))
        ends = np.cumsum([len(x) for x in each])
        rows = []
        for d, x, e in zip(pdf["d"].tolist(), each, ends.tolist(), strict=True):
            c = count[back[e - len(x) : e]]
            rows.append((d, int(pdf["b"].iloc[0]), 0, _squeeze(_six(x[c > 1]), c[c > 1] > crowd)))
        return pd.DataFrame(rows, columns=["d", "b", "kind", "data"])

    told = store.groupBy("d").applyInPandas(_freed(tell), "b int, d int, data binary")
    shared = cut(told.groupBy("b").applyInPandas(_freed(weigh), "d int, b int, kind int, data binary"))
    # What the first passes shuffled, over the input's size, is not read again.
    freed(docs.sparkSession)

    def send(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """The bucket's distinct regions under shared anchors."""
        _, ids, texts = _texts(mine["data"].tolist())
        hashes, least, strings, *_ = _regions(texts, ids, *_shared_of(answers["data"].tolist()), length)
        d = int(mine["d"].iloc[0]) if len(mine) else -1
        rows = []
        for b, i in _by_bucket(hashes, n):
            some = [strings[j] for j in i]
            rows.append((b, d, _squeeze(_six(hashes[i]), least[i], np.array([len(s) for s in some], dtype=np.int64), b"".join(some))))
        return pd.DataFrame(rows, columns=["b", "d", "data"])

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        """The smallest document of each window of the regions that meet here, as runs, for each bucket that sent some."""
        hashes, least, strings, counts = [], [], [], []
        for blob in pdf["data"]:
            six, ids, sizes, raw = _unsqueeze(blob)
            sizes = np.frombuffer(sizes, np.int64)
            ends = np.cumsum(sizes)
            hashes.append(_from_six(six))
            least.append(np.frombuffer(ids, np.int64))
            strings += [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            counts.append(int((sizes - length + 1).sum()))
        answer = first_documents(np.concatenate(hashes), np.concatenate(least), strings, length)
        rows, at = [], 0
        for d, c in zip(pdf["d"].tolist(), counts, strict=True):
            flat = answer[at : at + c]
            head = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            rows.append((d, int(pdf["b"].iloc[0]), 1, _squeeze(flat[head], np.diff(np.append(head, len(flat))).astype(np.uint32))))
            at += c
        return pd.DataFrame(rows, columns=["d", "b", "kind", "data"])

    sent = store.groupBy("d").cogroup(shared.groupBy("d")).applyInPandas(_freed(send), "b int, d int, data binary")
    judged = sent.groupBy("b").applyInPandas(_freed(judge), "d int, b int, kind int, data binary")

    def remove(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """What is left of the bucket's texts; its regions are found again in the order in which they were sent."""
        keys, ids, texts = _texts(mine["data"].tolist())
        told = answers[answers["kind"] == 0]["data"].tolist()
        hashes, _, strings, region, text, start, windows = _regions(texts, ids, *_shared_of(told), length)
        found = {b: _unsqueeze(x) for b, k, x in zip(answers["b"], answers["kind"], answers["data"], strict=True) if k == 1}
        size = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)) - length + 1
        at = np.cumsum(size) - size
        first = np.zeros(int(size.sum()), dtype=np.int64)
        for b, i in _by_bucket(hashes, n):
            values, counts = found[b]
            first[_ranges(at[i], size[i])] = np.repeat(np.frombuffer(values, np.int64), np.frombuffer(counts, np.uint32))
        rows = []
        edges = np.searchsorted(text, np.arange(len(texts) + 1))
        for x, y in chunks([len(t) for t in texts], FLAT):
            lengths = np.fromiter(map(len, texts[x:y]), dtype=np.int64, count=y - x)
            offset = np.cumsum(lengths) - lengths
            data = np.frombuffer(b"".join(texts[x:y]), dtype=np.uint8)
            here = slice(edges[x], edges[y])
            hit = first[_ranges(at[region[here]], windows[here])] < np.repeat(ids[text[here]], windows[here])
            starts = _ranges(offset[text[here] - x] + start[here], windows[here])[hit]
            # A byte goes if one of the length windows that hold it was hit; windows stay within their text.
            many = np.zeros(len(data) + 1, dtype=np.int64)
            many[starts + 1] = 1
            many = np.cumsum(many)
            gone = many[1:] > many[np.maximum(np.arange(len(data)) - length + 1, 0)]
            for t, o, m in zip(range(x, y), offset.tolist(), lengths.tolist(), strict=True):
                out = gone[o : o + m]
                spans = int(np.count_nonzero(out[1:] & ~out[:-1]) + (m > 0 and bool(out[0])))
                removed = int(np.count_nonzero(out))
                kept = data[o : o + m][~out].tobytes() if removed else texts[t]
                rows.append((keys[t], int(ids[t]), m, removed, spans, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["key", "doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "key binary, doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return store.groupBy("d").cogroup(shared.unionByName(judged).groupBy("d")).applyInPandas(_freed(remove), schema)


def deduplicated(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs.

    Null texts count as empty, and texts of fewer than length bytes lose nothing. Rows of one doc_id do not take from each
    other; rows without a doc_id come after all others. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc"), text.alias("text"))
    found = repeats(rows, length, crowd, buckets)
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("at"), F.unhex(F.sha2(text, 256)).alias("key"))
    both = own.join(found, "key")
    # Of a copy with a larger id than another, every byte is covered, if it is long enough.
    copy = (F.col("at") > F.col("doc")) & (F.col("n_bytes") >= length)
    return both.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
