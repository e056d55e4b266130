"""The registered queries of the training-data operators, one opN_<name> for each."""

from __future__ import annotations

import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import ann, bpe, edit_counts, minhash, mixing, pii, quality, ring, token_file, weighted
from lodegraph.llm.common import table, workspace


def op1_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text before and after three edits, by segment trees."""
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    return edit_counts.edited_counts(table(spark, sf_dir, "documents"), data, public_tokenizers.PATTERN, edits=3)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingle sets are alike by 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Params(words=2, alike=80))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, by inverted file and product quantisation."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), ann.Params(k=20, every=20))


def op7_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards on a ring with bounded loads."""
    return ring.assign(table(spark, sf_dir, "documents"), ring.Params(shards=8))


def op8_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted samples of every text, of its edited text, and their likeness."""
    return weighted.fingerprints(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text by a sparse rule ensemble."""
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when the sources are mixed by 5, 2, 1."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of the terms that give it away, in every whole text."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, written to a file of coded blocks and read back."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        data = f.read()
    path = f"{workspace(spark)}/token-file-{uuid.uuid4().hex}"
    token_file.write(table(spark, sf_dir, "documents"), path, data, public_tokenizers.PATTERN, end=0)
    return token_file.read(spark, path)


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text by merge replay, and the digest of what they decode to."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        data = f.read()
    return bpe.encode_documents(table(spark, sf_dir, "documents"), data, public_tokenizers.PATTERN, with_ids=False)


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_edit_counts": op1_edit_counts,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_sanitise": op3_sanitise,
        "op4_token_file": op4_token_file,
        "op6_nearest_vectors": op6_nearest_vectors,
        "op7_ring_shards": op7_ring_shards,
        "op8_weighted_fingerprints": op8_weighted_fingerprints,
        "op9_quality": op9_quality,
        "op10_mix_sources": op10_mix_sources,
        "op5_bpe_roundtrip": op5_bpe_roundtrip,
    }


def oracle_sql():
    return {}
