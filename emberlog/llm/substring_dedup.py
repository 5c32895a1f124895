"""Operator 8: repeated word windows removed, found level by level at doubled lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import blocks
from emberlog.llm.common import table
from emberlog.llm.words import Words, sliding, windows


class Levels:
    """The levels of one block: a quarter of the window, half of it, the window.

    Level 0: windows of a quarter (rounded up) of the size. Of those inside a full window only the one of least hash
    counts, so equal full windows agree on it. Level 1: twice as long, from that one to the right and to the left,
    where its level-0 window is repeated. Level 2: full windows that hold repeated level-1 windows only. What is not
    repeated at one level is never looked at again; what is repeated at the last level is the result.
    """

    def __init__(self, rows: pa.Table, size: int, n: int):
        self.words = Words(rows.column("text"))
        self.size, self.n = size, n
        self.short = -(-size // 4)
        self.span = size - self.short + 1  # level-0 windows in a full one
        self.hashes = self.words.hashes()
        doc = self.words.docs()
        full = max(0, len(doc) - size + 1)
        self.valid = doc[:full] == doc[size - 1 :] if full else np.zeros(0, bool)
        h = windows(self.hashes, self.short)
        self.h = h
        self.least = sliding(np.minimum, h, self.span)
        # A level-0 window counts if it is the least of any full window around it.
        held = np.where(self.valid, self.least, np.uint64(0))
        around = np.concatenate([np.zeros(self.span - 1, np.uint64), held, np.zeros(self.span - 1, np.uint64)])
        chosen = (sliding(np.maximum, around, self.span) == h) if len(held) else np.zeros(len(h), bool)
        self.keys = [blocks.distinct_keys(h[chosen])]
        self.starts = np.flatnonzero(self.valid)

    def narrow(self, masks: pa.Table, level: int) -> None:
        """Take in what came back for a level and make the keys of the next."""
        keys, _ = self.keys[level]
        repeated = keys[blocks.unmask(keys, masks, level, self.n)]
        if level == 0:
            at = self.starts[np.isin(self.least[self.starts], repeated, kind="sort")]
            place = np.concatenate([[0], *(i + np.argmin(self.h[i[:, None] + np.arange(self.span)], axis=1) for i in np.array_split(at, len(at) // 50_000 + 1))]).astype(np.int64)[1:]
            self.double = windows(self.hashes, 2 * self.short)
            right, left = place, place - self.short
            self.starts = at
            # The doubled windows that lie inside the full one; at least one does.
            self.right = np.where(right + 2 * self.short <= at + self.size, right, -1)
            self.left = np.where(left >= at, left, -1)
            places = np.unique(np.concatenate([self.right, self.left]))
            self.keys.append(blocks.distinct_keys(self.double[places[places >= 0]]))
        elif level == 1:
            ok = np.ones(len(self.starts), bool)
            for side in (self.right, self.left):
                inside = side >= 0
                ok[inside] &= np.isin(self.double[side[inside]], repeated, kind="sort")
            self.starts = self.starts[ok]
            self.long = windows(self.hashes, self.size)
            self.keys.append(blocks.distinct_keys(self.long[self.starts]))
        else:
            self.starts = self.starts[np.isin(self.long[self.starts], repeated, kind="sort")]

    def removed(self) -> np.ndarray:
        """Words covered by a repeated full window."""
        edge = np.zeros(len(self.words) + 1, np.int32)
        edge[self.starts] += 1
        np.subtract.at(edge, self.starts + self.size, 1)
        return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, size: int = 50, text_col: str = "text", carry: dict[str, str] | None = None, keep_layout: bool = False) -> DataFrame:
    """The carried columns, n_words, n_removed and kept: the words left of every whole text, joined by one space.

    With keep_layout a text that loses nothing is given back as it was.

    Removed is each word covered by a window of size words whose word sequence also starts anywhere else, in another
    document or the same; windows are judged on the input. Null and empty texts, and those without words, keep an
    empty text; shorter texts than a window keep all words. Repeated rows are repeats of each other. An empty table
    gives an empty result. Columns that are not carried are not read. size is 8 at least.

    Level 0 sends about one key for every size / 3 words; the others only what survived. No pairs are formed.
    """
    if size < 8:
        raise ValueError("size must be at least 8")
    carry = carry if carry is not None else {"doc_id": "doc_id"}
    count = blocks.block_count(docs, text_col)
    rows = blocks.with_blocks(docs, text_col, carry, count)
    n = blocks.parts(docs, count)

    def keys_of(level: int):
        def run(texts: pa.Table, masks: pa.Table | None, n: int) -> tuple[np.ndarray, np.ndarray]:
            state = Levels(texts, size, n)
            for k in range(level):
                state.narrow(masks, k)
            return state.keys[level]

        return run

    masks = None
    for level in range(3):
        found = blocks.find_repeats(blocks.send(rows, keys_of(level), level, n, masks))
        masks = found if masks is None else masks.unionByName(found)

    def finish(key: tuple, texts: pa.Table, masks: pa.Table) -> pa.Table:
        state = Levels(texts, size, n)
        for k in range(3):
            state.narrow(masks, k)
        gone = state.removed()
        upto = np.concatenate([[0], np.cumsum(gone)])
        n_removed = np.diff(upto[state.words.of_doc])
        kept = state.words.joined(~gone)
        if keep_layout:
            text = texts.column("text").combine_chunks()
            kept = pc.if_else(pa.array(n_removed == 0), text.cast(pa.string()), kept)
        return texts.drop_columns(["block", "text"]).append_column("n_words", pa.array(state.words.counts, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64())).append_column("kept", kept)

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c not in ("block", "text")), "n_words long, n_removed long, kept string"])
    return rows.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(finish, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents; nulls, empty texts, repeats and empty tables as substring_dedup has them."""
    out = substring_dedup(table(spark, sf_dir, "documents"), size=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES: dict[str, str] = {}
