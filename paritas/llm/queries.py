"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.llm import fingerprints, langid, language_model, lattice, lines, mixing, sentencepiece_bpe, simhash, substrings, toxicity
from paritas.llm.common import read

PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text decoded from them, as digests."""
    return sentencepiece_bpe.digests(read(spark, sf_dir, "documents"), sentencepiece_bpe.model_bytes(tokenizer_path(PIECE_MODEL)))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without lines that repeat, or come within two edits of, a line of an earlier place."""
    out = lines.deduplicated(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every whole text, and the component of fingerprints within 4 bits."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text under a model of the training rows, and under their word counts alone."""
    return language_model.scores(read(spark, sf_dir, "documents"), sentencepiece_bpe.model_bytes(tokenizer_path(PIECE_MODEL)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text, learned from the labels outside a held-out fold."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix with weights 1, 2, 3 takes."""
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.9 or more."""
    return lattice.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, by all its evidence, and of every document, by its text and source; one id is null."""
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    model = langid.learn(docs)
    none = F.lit(None).cast("long")
    of_docs = langid.fused(langid.documents_evidence(docs), model, "doc_id").withColumn("page_id", none)
    return of_docs.unionByName(langid.fused(langid.pages_evidence(pages), model, "page_id").withColumn("doc_id", none))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the 50-byte strings that documents of smaller id have."""
    return substrings.deduplicated(read(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and its edited text, and their likeness."""
    return fingerprints.edits(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash": op3_simhash,
    "op4_language_model": op4_language_model,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_language_id": op8_language_id,
    "op9_substrings": op9_substrings,
    "op10_fingerprints": op10_fingerprints,
}
ORACLE_SQL: dict[str, str] = {}
