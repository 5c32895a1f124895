"""Corpus-wide repeats by blocks: which keys (64-bit hashes) occur more than once, without a row for each occurrence.

Documents are dealt into blocks of a few MB by a hash of id and text. A block sends each of its distinct keys once
(packed, by part of the key space, with a bit that tells whether it occurs more than once in the block), so a key that
a third of all documents share costs one entry a block, and no task gets more than its part of the key space. What
comes back is one bit for each key sent, in the block's own sorted order. The texts' exchange is one and the same in
every step of a plan, so Spark shuffles texts once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import total_bytes

BLOCK_BYTES = 1 << 20
LEAST_BLOCKS = 64
#: Most blocks (1 MB of text each) whose keys one part of the key space holds on average: what a task gathers at once.
PART_BLOCKS = 256
SENT = "part int, block long, level int, keys binary, twice binary"
MASKS = "block long, level int, part int, mask binary"


def block_count(docs: DataFrame, text_col: str, least: int = LEAST_BLOCKS) -> int:
    """How many blocks the texts make."""
    return max(least, -(-total_bytes(docs, text_col) // BLOCK_BYTES))


def with_blocks(docs: DataFrame, text_col: str, carry: dict[str, str] | None, count: int) -> DataFrame:
    """block (below count), text (null: empty) and the carried columns ({new name: old name}), and no others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [F.col(old).alias(new) for new, old in (carry or {}).items()]
    salt = [F.col(old) for old in (carry or {}).values()]
    return docs.select(F.pmod(F.xxhash64(*salt, text), F.lit(count)).alias("block"), text.alias("text"), *carried)


def parts(df: DataFrame, count: int) -> int:
    """How many parts the key space has: a few for each shuffle partition, and enough that no part's keys outgrow a task
    however many blocks there are."""
    return max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_BLOCKS))


def distinct_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and whether each occurs more than once among values (one entry for each place)."""
    keys, counts = np.unique(values, return_counts=True)
    return keys, counts > 1


def cuts(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted keys fall in, and where each begins and ends: part = floor(key * n / 2^64)."""
    part = ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(part, np.arange(n + 1))
    some = np.flatnonzero(np.diff(edges))
    return some, edges


def pack(block: int, level: int, keys: np.ndarray, twice: np.ndarray, n: int) -> pa.Table:
    some, edges = cuts(keys, n)
    blobs = [keys[edges[p] : edges[p + 1]].tobytes() for p in some]
    flags = [np.packbits(twice[edges[p] : edges[p + 1]]).tobytes() for p in some]
    return pa.table({"part": pa.array(some, pa.int32()), "block": pa.array([block] * len(some), pa.int64()), "level": pa.array([level] * len(some), pa.int32()), "keys": pa.array(blobs, pa.binary()), "twice": pa.array(flags, pa.binary())})


def find_repeats(sent: DataFrame) -> DataFrame:
    """One mask for each packed row: a bit a key, set if the key occurs more than once over all blocks."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(rows.column("twice").to_pylist(), blobs, strict=True)]
        every = np.concatenate(blobs)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        same = ranked[1:] == ranked[:-1]
        repeated = np.zeros(len(every), bool)
        repeated[order[1:]] |= same
        repeated[order[:-1]] |= same
        # A key that is repeated inside one block only is repeated there; elsewhere it has just been found.
        repeated |= np.concatenate(flags)
        ends = np.cumsum([len(b) for b in blobs])[:-1]
        masks = [np.packbits(m).tobytes() for m in np.split(repeated, ends)]
        return pa.table({"block": rows.column("block"), "level": rows.column("level"), "part": rows.column("part"), "mask": pa.array(masks, pa.binary())})

    return sent.groupBy("part").applyInArrow(run, MASKS)


def unmask(keys: np.ndarray, masks: pa.Table, level: int, n: int) -> np.ndarray:
    """The bits that came back for a level's sorted keys."""
    _, edges = cuts(keys, n)
    out = np.zeros(len(keys), bool)
    for lv, p, mask in zip(masks.column("level").to_pylist(), masks.column("part").to_pylist(), masks.column("mask").to_pylist(), strict=True):
        if lv == level:
            a, b = edges[p], edges[p + 1]
            out[a:b] = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)
    return out


def send(blocks: DataFrame, keys_of: Callable[[pa.Table, pa.Table | None, int], tuple[np.ndarray, np.ndarray]], level: int, n: int, masks: DataFrame | None = None) -> DataFrame:
    """The packed keys of one level; keys_of(texts, masks of earlier levels, n) gives sorted distinct keys and twice."""
    if masks is None:
        return blocks.groupBy("block").applyInArrow(lambda key, rows: pack(key[0].as_py(), level, *keys_of(rows, None, n), n), SENT)

    def run(key: tuple, rows: pa.Table, back: pa.Table) -> pa.Table:
        return pack(key[0].as_py(), level, *keys_of(rows, back, n), n)

    return blocks.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(run, SENT)
