"""Operator 1: token counts by heap-and-linked-list byte-pair merging, without emitting identifiers."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe
from emberlog.llm.common import map_arrow, table, text_rows, vocabulary_path


@lru_cache(maxsize=2)
def counter(path: str) -> bpe.WordCounter:
    return bpe.WordCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text.

    Null and empty texts count 0 bytes and 0 tokens; a null id stays null; repeated rows give repeated results; an
    empty table gives an empty result. Texts of any length are counted whole. Other columns are not read.
    One narrow stage: no shuffle, the vocabulary is read once per Python worker.
    """

    def count(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text")
        n = counter(vocabulary).count
        return {"doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(texts).cast("int64"), "n_tokens": pa.array(map(n, texts.to_pylist()), pa.int64(), size=len(texts))}

    return map_arrow(text_rows(docs, id_col, text_col), count, "doc_id long, n_bytes long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents; nulls, empty texts, repeats and empty tables as token_counts has them."""
    out = token_counts(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
