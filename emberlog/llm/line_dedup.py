"""Operator 6: repeated runs of lines removed, found by winnowing over line hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import blocks
from emberlog.llm.common import table
from emberlog.llm.words import IS_SPACE, byte_hashes, join_runs, sliding, text_buffers, windows

LAST = np.iinfo(np.int64).max
FIRSTS = "part int, block long, level int, keys binary, ids binary"


class Lines:
    """The lines of one block and what each step makes of them.

    Lines without a word are no part of the sequences. Of every window of run lines the least line hash is selected: a
    fingerprint that equal windows share. Where a fingerprint occurs more than once, matches are extended both ways to
    all windows of run lines around it; those that occur earlier in the corpus are repeats. Lines of single words or
    more (0: none) are all fingerprints and windows of their own.
    """

    def __init__(self, rows: pa.Table, run: int, n: int, single: int = 0):
        self.rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])  # nulls last
        self.run, self.n = run, n
        self.data, self.offsets = data, offsets = text_buffers(self.rows.column("text"))
        breaks = np.flatnonzero(data == 10)
        self.starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        self.of_doc = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
        ends = np.empty_like(self.starts)
        ends[:-1] = self.starts[1:] - 1
        if len(ends):
            ends[self.of_doc[1:] - 1] = offsets[1:]
        self.ends = ends
        inside = ~IS_SPACE[data]
        words = np.concatenate([[0], np.cumsum(inside)])
        self.lines = np.flatnonzero(words[self.ends] > words[self.starts])
        self.doc = np.searchsorted(self.of_doc, self.lines, "right") - 1
        self.hashes = hashes = byte_hashes(data, self.starts[self.lines], self.ends[self.lines])
        full = max(0, len(hashes) - run + 1)
        self.valid = np.flatnonzero(self.doc[:full] == self.doc[run - 1 :]) if full else np.zeros(0, np.int64)
        self.least = sliding(np.minimum, hashes, run)
        held = np.zeros(full, np.uint64)
        held[self.valid] = self.least[self.valid]
        pad = np.zeros(run - 1, np.uint64)
        chosen = sliding(np.maximum, np.concatenate([pad, held, pad]), run) == hashes if full else np.zeros(len(hashes), bool)
        self.alone = np.zeros(0, np.int64)
        if single:
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            edges = offsets[:-1][offsets[:-1] < len(data)]
            begins[edges] = inside[edges]
            words = np.concatenate([[0], np.cumsum(begins)])
            self.alone = np.flatnonzero(words[self.ends[self.lines]] - words[self.starts[self.lines]] >= single)
            chosen[self.alone] = True
        self.fingerprints = blocks.distinct_keys(hashes[chosen])
        self.long = windows(hashes, run)
        ids = self.rows.column("doc_id").to_numpy(zero_copy_only=False) if self.rows.column("doc_id").null_count == 0 else self.rows.column("doc_id").fill_null(LAST).to_numpy()
        self.ids = ids.astype(np.int64)

    def extend(self, masks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows around repeated fingerprints and the least document id of each in this block."""
        keys, _ = self.fingerprints
        repeated = keys[blocks.unmask(keys, masks, 0, self.n)]
        at = self.valid[np.isin(self.least[self.valid], repeated, kind="sort")]
        alone = self.alone[np.isin(self.hashes[self.alone], repeated, kind="sort")]
        self.at = np.concatenate([at, alone])
        self.stop = np.concatenate([at + self.run, alone + 1])
        # Rows are sorted by id, so the first place of a key has its least id.
        self.keys, self.first, self.which = np.unique(np.concatenate([self.long[at], windows(self.hashes, 1)[alone]]), return_index=True, return_inverse=True)
        return self.keys, self.ids[self.doc[self.at[self.first]]] if len(self.at) else np.zeros(0, np.int64)

    def removed(self, masks: pa.Table) -> np.ndarray:
        """Lines in a window that occurs earlier: in an earlier document, or in this one further up."""
        own = blocks.unmask(self.keys, masks, 1, self.n)  # the corpus's first occurrence is here
        later = np.ones(len(self.at), bool)
        later[self.first[own]] = False
        edge = np.zeros(len(self.lines) + 1, np.int32)
        np.add.at(edge, self.at[later], 1)
        np.subtract.at(edge, self.stop[later], 1)
        gone = np.zeros(len(self.starts), bool)
        gone[self.lines] = np.cumsum(edge[:-1]) > 0
        return gone


def find_firsts(sent: DataFrame) -> DataFrame:
    """One mask for each packed row of (key, id): set where the block has the key's least id (then the least block)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("ids").to_pylist()])
        block = np.repeat(rows.column("block").to_numpy(), [len(k) for k in keys])
        every = np.concatenate(keys)
        order = np.lexsort((block, ids, every))
        ranked = every[order]
        first = np.zeros(len(every), bool)
        first[order] = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        masks = [np.packbits(m).tobytes() for m in np.split(first, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table({"block": rows.column("block"), "level": rows.column("level"), "part": rows.column("part"), "mask": pa.array(masks, pa.binary())})

    return sent.groupBy("part").applyInArrow(run, blocks.MASKS)


def line_dedup(docs: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, str] | None = None, single: int = 0) -> DataFrame:
    """doc_id, the carried columns, n_lines, n_removed and kept: every whole text without its repeated runs of lines.

    Lines are what newlines separate; those without a word are ignored and stay. A line goes if it lies in run
    consecutive lines (ignoring wordless ones) that occur earlier as well, in a document of a smaller id or further up
    in the same one; the first occurrence stays. Ids that are null come last; of repeated rows with one id the first
    in text order keeps the run. With single, a line of that many words or more goes by itself if it occurs earlier;
    run must be over one then. Null and empty texts have no lines and stay empty; shorter texts than run lines stay
    whole without single; an empty table gives an empty result. Columns that are not carried are not read.

    Fingerprints are sent once a block; only windows around repeated ones are sent in full; no pairs are formed.
    """
    if single and run < 2:
        raise ValueError("single lines go anyway where run is one")
    count = blocks.block_count(docs, text_col)
    rows = blocks.with_blocks(docs, text_col, {"doc_id": id_col, **(carry or {})}, count).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = blocks.parts(docs, count)
    masks = blocks.find_repeats(blocks.send(rows, lambda texts, _, n: Lines(texts, run, n, single).fingerprints, 0, n))

    def send_firsts(key: tuple, texts: pa.Table, back: pa.Table) -> pa.Table:
        keys, ids = Lines(texts, run, n, single).extend(back)
        some, edges = blocks.cuts(keys, n)
        packed = blocks.pack(key[0].as_py(), 1, keys, np.zeros(len(keys), bool), n)
        return packed.drop_columns(["twice"]).append_column("ids", pa.array([ids[edges[p] : edges[p + 1]].tobytes() for p in some], pa.binary()))

    firsts = find_firsts(rows.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(send_firsts, FIRSTS))

    def finish(key: tuple, texts: pa.Table, back: pa.Table) -> pa.Table:
        state = Lines(texts, run, n, single)
        state.extend(back)
        gone = state.removed(back)
        sums = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[state.of_doc]), pa.int64())
        real = np.zeros(len(gone), bool)
        real[state.lines] = True
        kept = join_runs(state.data, state.offsets, state.starts, state.ends, state.of_doc, ~gone, 10)
        return state.rows.drop_columns(["block", "text"]).append_column("n_lines", sums(real)).append_column("n_removed", sums(gone)).append_column("kept", kept)

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c not in ("block", "text")), "n_lines long, n_removed long, kept string"])
    return rows.groupBy("block").cogroup(masks.unionByName(firsts).groupBy("block")).applyInArrow(finish, schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents; nulls, empty texts, repeats and empty tables as line_dedup has them."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM split),
real AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
win AS (SELECT doc_id, k, l || chr(10) || lead(l, 1) OVER w || chr(10) || lead(l, 2) OVER w AS g FROM real WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
later AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS nth FROM win WHERE g IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT r.doc_id, r.pos FROM real r JOIN later x ON r.doc_id = x.doc_id AND r.k BETWEEN x.k AND x.k + 2),
n AS (SELECT doc_id, count(*) AS n_lines FROM real GROUP BY doc_id),
kept AS (SELECT line.doc_id, string_agg(l, chr(10) ORDER BY line.pos) FILTER (WHERE gone.pos IS NULL) AS t, count(gone.pos) AS n_removed
    FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.pos = gone.pos GROUP BY line.doc_id)
SELECT kept.doc_id AS doc_id, coalesce(n_lines, 0) AS n_lines, n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept LEFT JOIN n ON kept.doc_id = n.doc_id"""
QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {"op6_line_dedup": ORACLE}
