"""A training corpus from ``documents``: clean, deduplicated, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next one.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, near_copies, pareto_mix, simhash, suffix_dedup, toxicity
from tessera.llm.common import Staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of compression distances rejects go."""
    model = toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return simhash.keep_one(docs, found_by=near_copies.near_components)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that also start elsewhere go, and passages of over 50 words; documents stay, if need be empty."""
    return suffix_dedup.remove_repeats(docs, words=suffix_dedup.PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix of sources takes."""
    return pareto_mix.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document and copy."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained models, fingerprints and byte-pair merges are beyond SQL; tests/llm/test_pipeline.py compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, staged = table(spark, sf_dir, "documents"), Staged(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), name)
        if k > 0:
            staged.done(STAGES[k - 1][0])
    return docs
