"""Encoding to and decoding from subword ids as a SentencePiece BPE model with byte fallback does.

A text becomes words: each run of word-start marks with what follows it, so that no merge crosses words. All distinct
words of a run of documents are encoded at once in flat numpy arrays: each round looks up the merge rank of every
adjacent pair, takes the smallest rank of each word by a segmented minimum, merges the leftmost pairs of that rank, and
compacts the arrays; words without a pair leave. Decoding gathers piece bytes by id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from paritas.llm.common import by_text

MARK = "▁"
#: Distinct words whose ids a worker keeps; beyond it the words are forgotten.
MOST_WORDS = 300_000
NONE = np.iinfo(np.int32).max


class Pieces:
    """The tables of a model: pieces, their bytes, and what each adjacent pair of pieces merges into."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        pieces = {i: sp.id_to_piece(i) for i in plain}
        scores = {i: sp.get_score(i) for i in plain}
        self.byte_ids = np.zeros(256, dtype=np.int32)
        out = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value] = i
                out[i] = bytes([value])
            elif sp.is_unknown(i):
                out[i] = " ⁇ ".encode()
            elif i in pieces:
                out[i] = pieces[i].replace(MARK, " ").encode()
        self.mark_first = np.array([i in pieces and pieces[i].startswith(MARK) for i in range(n)])
        self.piece_len = np.array([len(b) for b in out], dtype=np.int64)
        self.piece_off = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        order = sorted(set(scores.values()), reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        self.rank = np.full(n + 1, NONE, dtype=np.int32)
        # A piece is lone if a better or equal piece holds it with more to its right: what its leftmost merge makes may
        # then take part of a later pair of its kind, so that these are merged one at a time.
        self.lone = np.zeros(n + 1, dtype=bool)
        keys, merged = [], []
        for i, p in pieces.items():
            self.rank[i] = rank_of[scores[i]]
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
            for a in range(len(p)):
                for b in range(a + 2, len(p)):
                    inner = self.ids.get(p[a:b])
                    if inner is not None and scores[i] >= scores[inner]:
                        self.lone[inner] = True
        self._hash(np.array(keys, dtype=np.uint64), np.array(merged, dtype=np.int32))
        if any(MARK in p.lstrip(MARK) for p in pieces.values()):
            raise ValueError("a piece of this model crosses words")

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of the pairs."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.table_keys = np.full(size, np.uint64(2**64 - 1))
        self.table_values = np.full(size, -1, dtype=np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.table_keys[slot] == np.uint64(2**64 - 1)
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.table_keys[slot[put]] = keys[left[put]]
            self.table_values[slot[put]] = values[left[put]]
            slot, left = (slot[~put] + 1) & (size - 1), left[~put]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, or -1."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.full(len(keys), -1, dtype=np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.table_keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.table_values[slot[hit]]
            more = ~hit & (found != np.uint64(2**64 - 1))
            if not more.any():
                break
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    # -- words to ids -------------------------------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and how many each has."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        distinct, at = np.unique(points, return_inverse=True)
        # Characters outside the vocabulary get numbers below zero, and never merge.
        known = np.array([self.ids.get(chr(c), -1 - int(c)) for c in distinct], dtype=np.int64)
        symbols = known[at]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        merged = np.full(len(symbols), -1, dtype=np.int32)  # what each symbol and the next one merge into
        self._look(symbols, word, merged, np.arange(len(symbols)))
        while len(symbols):
            pair = np.flatnonzero(merged >= 0)
            if not len(pair):
                done_symbols.append(symbols)
                done_words.append(word)
                break
            into, of = merged[pair], word[pair]
            rank = self.rank[into]
            head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(pair))))
            open_words = np.zeros(len(words), dtype=bool)
            open_words[of] = True
            best = rank == least
            pair, into, of = pair[best], into[best], of[best]
            # Leftmost first: of overlapping pairs every second one, from the first of its run; of lone pieces the first.
            apart = np.concatenate([[True], pair[1:] - pair[:-1] > 1])
            run = np.maximum.accumulate(np.where(apart, np.arange(len(pair)), 0))
            take = (np.arange(len(pair)) - run) % 2 == 0
            first = np.concatenate([[True], of[1:] != of[:-1]])
            head = np.maximum.accumulate(np.where(first, np.arange(len(pair)), 0))
            mixed = np.logical_or.reduceat(self.lone[into] | (into != into[head]), np.flatnonzero(first))
            take &= first | ~np.repeat(mixed, np.diff(np.append(np.flatnonzero(first), len(pair))))
            pair, into = pair[take], into[take]
            symbols[pair] = into
            keep = np.ones(len(symbols), dtype=bool)
            keep[pair + 1] = False
            # Words without any pair are finished and leave the arrays.
            stays = open_words[word]
            if not stays.all():
                out = keep & ~stays
                done_symbols.append(symbols[out])
                done_words.append(word[out])
                keep &= stays
            place = np.cumsum(keep) - 1
            symbols, word, merged = symbols[keep], word[keep], merged[keep]
            at = place[pair]
            self._look(symbols, word, merged, np.concatenate([at, at[at > 0] - 1]))
        if not done_symbols:
            return np.zeros(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        symbols, word = symbols[order], word[order]
        return self._fall_back(symbols, word, len(words))

    def _look(self, symbols: np.ndarray, word: np.ndarray, merged: np.ndarray, at: np.ndarray) -> None:
        """Looks up what the symbols at some places merge into with their next ones."""
        merged[at] = -1
        at = at[at + 1 < len(symbols)]
        at = at[(word[at] == word[at + 1]) & (symbols[at] >= 0) & (symbols[at + 1] >= 0)]
        merged[at] = self.merge_of(symbols[at], symbols[at + 1])

    def _fall_back(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as ids of their UTF-8 bytes."""
        unknown = symbols < 0
        if unknown.any():
            points = -1 - symbols
            width = np.ones(len(symbols), dtype=np.int64)
            width[unknown] = 1 + (points[unknown] >= 0x80) + (points[unknown] >= 0x800) + (points[unknown] >= 0x10000)
            start = np.concatenate([[0], np.cumsum(width)[:-1]])
            out = np.repeat(symbols, width)
            for i in np.flatnonzero(unknown):
                out[start[i] : start[i] + width[i]] = self.byte_ids[list(chr(points[i]).encode())]
            symbols, word = out, np.repeat(word, width)
        return symbols.astype(np.int32), np.bincount(word, minlength=n)

    # -- ids to text --------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, one each."""
        if not len(ids):
            return ""
        lengths = self.piece_len[ids]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(starts[-1]) + np.repeat(self.piece_off[ids] - starts[:-1], lengths)
        data = self.piece_bytes[at]
        shown = np.flatnonzero(lengths)
        if len(shown) and self.mark_first[ids[shown[0]]]:
            data = data[1:]
        raw = data.tobytes()
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _replace(raw)


def _replace(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        try:
            out.append(raw[i:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[i : i + e.start].decode())
            out.append("�")
            i += e.start + 1
    return "".join(out)


class Encoder:
    """Encodes texts, keeping the ids of words that it has met in flat arrays."""

    def __init__(self, pieces: Pieces, decimal: bool = True):
        self.pieces, self.decimal = pieces, decimal
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.text_of: list[str] = []
        self.flat = np.zeros(0, dtype=np.int32)
        self.size = np.zeros(0, dtype=np.int64)
        self.start = np.zeros(0, dtype=np.int64)

    @staticmethod
    def words(text: str) -> list[str]:
        """Words without their first mark; joined by marks, with one in front, they are the text that is encoded."""
        if not text:
            return []
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, marks = [], 0
        for i, part in enumerate(parts):
            if part or i == len(parts) - 1:
                out.append(MARK * marks + part)
                marks = 0
            else:
                marks += 1
        return out

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.code) > MOST_WORDS:
            self._forget()
        new = list(set().union(*texts).difference(self.code)) if texts else []
        if not new:
            return
        flat, size = self.pieces.encode_words([MARK + w for w in new])
        ends = np.cumsum(size)
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        if self.decimal:
            names = list(map(str, flat.tolist()))
            self.text_of += [",".join(names[a:b]) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
        self.start = np.concatenate([self.start, len(self.flat) + ends - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """The ids of each text, and these in decimal, joined by commas (empty text unless decimals are kept)."""
        split = [self.words(t) for t in texts]
        self.learn(split)
        out = []
        for words in split:
            codes = list(map(self.code.__getitem__, words))
            at = np.array(codes, dtype=np.int64)
            size = self.size[at]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.flat[np.arange(total) + np.repeat(self.start[at] - ends + size, size)]
            out.append((ids, ",".join(map(self.text_of.__getitem__, codes)) if self.decimal else ""))
        return out


def encode(docs: DataFrame, model: bytes, column: str = "text") -> DataFrame:
    """docs with `ids` (array<int>) and `decoded`, the text that the ids give back.

    Null texts count as empty: no ids, an empty decoded text. Columns of docs stay, but for `ids` and `decoded`.
    """
    keep = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        encoder = Encoder(Pieces(model))

        def some(texts: list[str], pdf: pd.DataFrame) -> pd.DataFrame:
            ids = [i for i, _ in encoder.ids(texts)]
            return pdf.assign(ids=ids, decoded=[encoder.pieces.decode(i) for i in ids])

        yield from by_text(some, column=column)(batches)

    return docs.select(*keep).mapInPandas(run, f"{schema}, ids array<int>, decoded string")


def digests(docs: DataFrame, model: bytes, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """A row for each of docs: its id, n_tokens, and SHA-256 of its decimal ids and of the text decoded from the ids.

    Null texts count as empty; repeated rows give repeated results; an empty table gives none.
    """
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        encoder = Encoder(Pieces(model))

        def some(texts: list[str], pdf: pd.DataFrame) -> pd.DataFrame:
            found = encoder.ids(texts)
            return pd.DataFrame(
                {
                    "id": pdf["id"].to_numpy(),
                    "n_tokens": [len(i) for i, _ in found],
                    "ids_sha256": [hashlib.sha256(s.encode()).hexdigest() for _, s in found],
                    "decoded_sha256": [hashlib.sha256(encoder.pieces.decode(i).encode()).hexdigest() for i, _ in found],
                }
            )

        yield from by_text(some)(batches)

    rows = docs.select(docs[id_column].alias("id"), docs[column].alias("text"))
    out = rows.mapInPandas(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_column)


def model_bytes(path: str) -> bytes:
    """The file of a model, a fixed half megabyte, which travels to the executors with the code."""
    with open(path, "rb") as f:
        return f.read()
