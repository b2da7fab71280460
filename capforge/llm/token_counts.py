"""Token counts with a digest cache.

The cache is a Parquet table (tokenizer, digest, n_tokens): SHA-256 of the tokenizer's file and library
version, SHA-256 of the content, its count. Content is normalised only as far as no count can change:
null becomes empty. Rows are joined with the cache by digest; of the digests that it lacks one text each
is encoded (equal texts meet in a partial aggregate before the shuffle) and the counts are appended.

Counts are the library's. For a byte-level BPE without normaliser, texts whose characters all lie in
ranges where the library's split pattern is plain (Latin letters, ASCII, tabs and line ends) are split by
that pattern and each different piece is encoded once a task; all other texts, and those that hold the
string of an added token, go to the library whole.

Defined results: null counts as empty (0 bytes, 0 tokens); rows that repeat are encoded once and all
returned; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from capforge.llm.common import BROADCAST_ROWS, shared_path, stored, task_memory, text_or_empty

LIMIT = 512
#: Pieces that a task remembers at once, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64

# Letters and numbers among the characters below, and the library's split pattern over them.
LETTER, NUMBER, GAP = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \t\n\r"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{GAP}{LETTER}{NUMBER}]+|[{GAP}]+(?![^{GAP}])|[{GAP}]+")
OTHER = re.compile("[^\t\n\r -~¡-¬®-ɏ]")


def tokenizer_digest(path: str) -> str:
    """Changes with the file and with the library's version."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.__version__.encode()).hexdigest()


def plain_pieces(spec: dict) -> bool:
    """Whether a text's encoding is that of its pieces by the byte-level pattern, one after another."""
    pre = spec["pre_tokenizer"] or {}
    return (spec["normalizer"] is None and spec["post_processor"] is None and spec["model"]["type"] == "BPE"
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("truncation") and not spec.get("padding") and not spec["model"].get("dropout"))


def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their token counts as the library gives them."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(model.encode(t)) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not plain_pieces(spec):
        return whole
    added = [t["content"] for t in spec.get("added_tokens", [])]
    remembered: dict[str, int] = {}

    def count(text: str) -> int:
        if OTHER.search(text) or any(a in text for a in added):
            return whole([text])[0]
        pieces = PIECE.findall(text)
        try:
            return sum(map(remembered.__getitem__, pieces))
        except KeyError:
            pass
        if len(remembered) > REMEMBERED:
            remembered.clear()
        new = [p for p in set(pieces) if p not in remembered]
        own = dict(zip(new, whole(new)))
        remembered.update((p, n) for p, n in own.items() if len(p) <= LONGEST)
        return sum(own[p] if p in own else remembered[p] for p in pieces)

    return lambda texts: [count(t) for t in texts]


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(encode, "digest binary, n_tokens long")


def cached_counts(spark, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer; empty where there is no cache yet."""
    schema = "tokenizer string, digest binary, n_tokens long"
    try:
        found = spark.read.schema(schema).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], schema)
    return found.filter(F.col("tokenizer") == tokenizer).select("digest", "n_tokens")


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, doc_id: str = "doc_id",
                 text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit. New counts are appended to the
    table ``cache`` (a new one in the shared folder where none is named)."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    task_memory(spark)
    cache = cache or shared_path(spark, "token-cache")
    body = text_or_empty(F.col(text))
    digest = F.unhex(F.sha2(body, 256)).alias("digest")
    keys = stored(docs.select(F.col(doc_id).alias("doc_id"), digest, F.octet_length(body).cast("long").alias("n_bytes")), "keys")
    missing = stored(keys.select("digest").distinct().join(cached_counts(spark, cache, version), "digest", "left_anti"), "missing")
    texts, n = docs.select(digest, body.alias("text")), missing.count()
    if n <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
    else:
        texts = texts.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")
    if n:
        encode_counts(texts, tokenizer).select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # two runs at once may both have appended a digest
    counts = stored(cached_counts(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keys.join(counts, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
