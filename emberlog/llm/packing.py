"""Operator 10: best-fit packing by hierarchical residual rounds."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe
from emberlog.llm.common import map_arrow, materialize, table, text_rows, vocabulary_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "fill int, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<long>, crcs array<long>"


@lru_cache(maxsize=2)
def encoder(path: str) -> bpe.WordEncoder:
    return bpe.WordEncoder(path)


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids plus end_id, cut into pieces of capacity; one row per piece.

    Null and empty texts are a single end_id; documents of any length are encoded whole.
    """

    def cut(batch: pa.RecordBatch) -> dict:
        end = end_id.to_bytes(4, "little")
        owner, piece, start, length, crc = [], [], [], [], []
        for doc, raw in zip(batch.column("doc_id").to_pylist(), map(encoder(vocabulary).encode, batch.column("text").to_pylist()), strict=True):
            raw += end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                own = raw[at : at + 4 * capacity]
                owner.append(doc)
                piece.append(k)
                start.append(at // 4)
                length.append(len(own) // 4)
                crc.append(zlib.crc32(own))
        return {"doc_id": pa.array(owner, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}

    return map_arrow(text_rows(docs, id_col, text_col), cut, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item places, best fit in descending order of size: each item goes where it leaves the least room."""
    bins: list[list[int]] = []
    free: list[int] = []  # sorted room * 2^32 + bin
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(free, sizes[i] << 32)
        if at < len(free):
            entry = free.pop(at)
            k, room = entry & 0xFFFFFFFF, (entry >> 32) - sizes[i]
            bins[k].append(i)
        else:
            k, room = len(bins), capacity - sizes[i]
            bins.append([i])
        if room:
            insort(free, room << 32 | k)
    return bins


def best_fit_packing(pieces: DataFrame, capacity: int, nearly_full: float = 0.995, group_items: int = 20_000) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset added.

    Round 1 deals the pieces into groups of about group_items and packs each group by best fit. Bins filled to
    nearly_full leave at once, and so do those that could not take even the least filled one of any group. The others
    become the items of the next round, in fewer groups, until one group is left. Best fit leaves one bin at most in a
    group that is half empty or more; where the items do not get fewer by half, only those few go on, so the tree ends
    at one group for any input. An item carries its members (at most capacity of them), so a group stays bounded and
    nothing has to be looked up later. Groups are numbered by hash; repeated rows and null ids are items like any
    other, an empty table packs to nothing. sequence_id is unique per sequence: round, group and bin.
    """
    spark = pieces.sparkSession
    full = int(capacity * nearly_full)

    def pack(level: int):
        def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
            items = items.assign(first=items["doc_ids"].map(lambda x: x[0]), second=items["pieces"].map(lambda x: x[0])).sort_values(["fill", "first", "second"], ascending=[False, True, True], kind="stable")
            columns = {c: items[c].tolist() for c in ("doc_ids", "pieces", "starts", "lengths", "crcs")}
            sizes = items["fill"].tolist()
            bins = best_fit(sizes, capacity)
            out = {c: [np.concatenate([v[i] for i in b]) for b in bins] for c, v in columns.items()}
            out["offsets"] = [np.cumsum(x) - x for x in out["lengths"]]
            return pd.DataFrame({"fill": [sum(sizes[i] for i in b) for b in bins], **out, "sequence_id": [(level << 56) + (int(key[0]) << 24) + k for k in range(len(bins))]})

        return run

    items = pieces.select(F.col("length").cast("int").alias("fill"), F.array("doc_id").alias("doc_ids"), F.array("piece").alias("pieces"), F.array("start").alias("starts"), F.array("length").alias("lengths"), F.array("ids_crc32").alias("crcs"))
    items = materialize(items)
    left = items.count()
    done: list[DataFrame] = []
    level = 0
    while left:
        groups = -(-left // group_items)
        deal = F.pmod(F.xxhash64(F.lit(level), F.element_at("doc_ids", 1), F.element_at("pieces", 1)), F.lit(groups))
        packed = materialize(items.withColumn("g", deal).groupBy("g").applyInPandas(pack(level), f"{BINS}, offsets array<long>, sequence_id long"))
        if groups == 1:
            done.append(packed)
            break
        least = packed.agg(F.min("fill")).first()[0]
        most = min(full - 1, capacity - least)
        left = packed.where(F.col("fill") <= most).count()
        if 2 * -(-left // group_items) > groups:
            most = min(most, capacity // 2)
            left = packed.where(F.col("fill") <= most).count()
        done.append(packed.where(F.col("fill") > most))
        items = packed.where(F.col("fill") <= most).drop("offsets", "sequence_id")
        level += 1
    if not done:
        return spark.createDataFrame([], PIECES + ", sequence_id long, offset long")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    members = F.explode(F.arrays_zip("doc_ids", "pieces", "starts", "lengths", "crcs", "offsets"))
    return out.select("sequence_id", members.alias("m")).select(F.col("m.doc_ids").alias("doc_id"), F.col("m.pieces").alias("piece"), F.col("m.starts").alias("start"), F.col("m.lengths").alias("length"), F.col("m.crcs").alias("ids_crc32"), "sequence_id", F.col("m.offsets").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096) -> DataFrame:
    """Every whole document's tokens and end id in sequences of at most capacity; see tokenized_pieces, best_fit_packing.

    Columns are those of best_fit_packing; null texts are a single end id, other columns than id and text are not read.
    """
    return best_fit_packing(tokenized_pieces(docs, vocabulary, capacity), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: all documents, sequences of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLES: dict[str, str] = {}
