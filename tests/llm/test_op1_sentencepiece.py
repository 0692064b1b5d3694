import hashlib

import numpy as np
import pytest

from paritas.llm import sentencepiece_bpe as bpe

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")

MODEL = bpe.model_bytes(tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["", " ", "  a  b ", "a▁b", "\n\n x\t", "the quick brown fox", "x" * 1000, " " * 900 + "y", "ab" * 700, "日本\x00x😀퟿", "thethethe nginging", None]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def test_same_ids_as_the_library(library):
    rng = np.random.default_rng(3)
    letters = list("theanding  ▁éñ日😀\n\x00AB.-=_")
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(letters, rng.integers(0, 300))) for _ in range(500)]
    encoder = bpe.Encoder(bpe.Pieces(MODEL))
    for text, (ids, joined) in zip(texts, encoder.ids(texts), strict=True):
        assert ids.tolist() == library.encode(text)
        assert joined == ",".join(map(str, ids.tolist()))
        assert encoder.pieces.decode(ids) == library.decode(ids.tolist())


def test_long_words_go_through_the_rounds_too(library):
    rng = np.random.default_rng(5)
    parts = ["the", "ing", "tion", "qu", "x", "日本", "é", "aa"]
    words = ["".join(rng.choice(parts, n)) for n in (200, 1000, 6000)] + ["ab" * 3000, "a" * 10_001]
    assert [i.tolist() for i, _ in bpe.Encoder(bpe.Pieces(MODEL)).ids(words)] == library.encode(words)


def test_decodes_any_ids_like_the_library(library):
    rng = np.random.default_rng(4)
    pieces = bpe.Pieces(MODEL)
    for _ in range(300):
        ids = rng.integers(0, 700, rng.integers(0, 15))
        assert pieces.decode(ids) == library.decode(ids.tolist())


def test_digests_and_extra_columns(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in bpe.digests(docs, MODEL).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    whole = bpe.encode(docs.withColumnRenamed("n_tokens", "ids"), MODEL)
    assert whole.columns == ["doc_id", "text", "ids", "decoded"]
    assert bpe.digests(docs.limit(0), MODEL).count() == 0
