"""The corpus pipeline: toxicity, exact dedup, near-duplicate join, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the
next one's docs. All but the last return the columns of documents; the last returns a row for each document
of the mix (as often as the mix takes it): doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, ids.
Nulls, empty texts, ties, repeated rows, empty tables and other columns: as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from capforge.llm.common import stored, table
from capforge.llm.exact_dedup import keep_first_copies
from capforge.llm.mixing import take_mix
from capforge.llm.ngram_join import keep_one_of_each
from capforge.llm.piece_codec import piece_digests
from capforge.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5, learnt from the labels of the documents that came in."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest id."""
    return keep_first_copies(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component over five-word shingles at 0.8 or more the smallest id."""
    return keep_one_of_each(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return take_mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and digests of ids, decoded text and spans."""
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_jaccard", ngram_jaccard), ("mix", mix),
          ("sentencepiece", sentencepiece)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
