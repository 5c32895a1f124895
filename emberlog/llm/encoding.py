"""Operator 5: byte-pair encoding and decoding by per-prefix dynamic programming."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe
from emberlog.llm.common import map_arrow, table, text_rows, vocabulary_path


@lru_cache(maxsize=2)
def encoder(path: str) -> bpe.PrefixEncoder:
    return bpe.PrefixEncoder(path)


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text, without added special tokens.

    Null and empty texts give no ids (empty binary); null ids, repeated rows and empty tables pass through; other
    columns are not read. Special strings inside a text become their ids, as the library does by default.
    """

    def encode(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "ids": pa.array(map(encoder(vocabulary).encode, batch.column("text").to_pylist()), pa.binary(), size=batch.num_rows)}

    return map_arrow(text_rows(docs, id_col, text_col), encode, "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and the text they stand for; null ids decode to the empty text, broken UTF-8 to replacement signs."""

    def decode(batch: pa.RecordBatch) -> dict:
        texts = map(encoder(vocabulary).decode, batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "ids": batch.column("text"), "decoded": pa.array(texts, pa.string(), size=batch.num_rows)}

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("text"))
    return map_arrow(rows, decode, "doc_id long, ids binary, decoded string")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents; nulls, empty texts, repeats and empty tables as bpe_encode has them."""
    vocabulary = vocabulary_path("byte_bpe_50k.json")
    out = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op5_bpe_round_trip": op5_bpe_round_trip}
ORACLES: dict[str, str] = {}
