"""Operator 13: target-distribution importance resampling.

Features are hashed with CRC-32 into buckets, which are counted over all documents and over the target texts; a bucket's
gain is the log ratio of its shares, a text's weight its features' mean gain, and its score the weight plus Gumbel noise
from its id, so the highest scores are a sample without replacement.

The draw: each task writes its eligible rows as sorted runs of (score, id). A sample of the runs' keys cuts the order into
ranges; each range's pieces of runs are merged by a tournament tree, and as the pieces' sizes tell where a range begins,
ranks are given out range by range until the draw is complete. Nothing is sorted or merged as a whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import map_arrow, materialize, slices, table, text_rows
from emberlog.llm.words import LOWER, text_buffers

BUCKETS = 10_000
#: Bytes up to which words are hashed all at once.
SHORT = 32
#: Rows of a sorted run, rows that a range holds on average, keys that are sampled, and ranges at most.
RUN, RANGE, SAMPLED, MOST_RANGES = 1 << 16, 1 << 17, 1 << 20, 1 << 14
FAN = 64
PIECE_BYTES = 1 << 20
NONE = np.iinfo(np.int64).max
COLUMNS = ("score", "doc_id", "n_features", "weight", "null_id")
RUNS = "run long, eligible long, rows long, score binary, doc_id binary, n_features binary, weight binary, null_id binary"
PIECES = "range int, run long, n long, score binary, doc_id binary, n_features binary, weight binary, null_id binary"
DRAWN = "doc_id long, n_features long, weight long, score long, rank long"

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The table for one byte, and for n bytes up to SHORT four tables that carry a CRC over n bytes further on: the CRC of
    a and then b is the CRC of a carried over b's bytes, xor the CRC of b."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(0xEDB88320), one >> np.uint32(1))
    far = np.empty((SHORT + 1, 4, 256), np.uint32)
    far[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(1, SHORT + 1):
        far[n] = one[far[n - 1] & np.uint32(255)] ^ (far[n - 1] >> np.uint32(8))
    return one, far


BYTE_TABLE, FAR_TABLES = crc_tables()


class Features:
    """bucket and text of every feature of texts: their words and pairs of neighbours; n_words of each text."""

    def __init__(self, texts: pa.Array):
        data, offsets = text_buffers(texts)
        data = LOWER[data]
        inside = IS_WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # words end where texts do
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        size = ends - starts
        crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
        some = np.flatnonzero(size <= SHORT)
        for j in range(SHORT):
            some = some[size[some] > j]
            crc[some] = BYTE_TABLE[(crc[some] ^ data[starts[some] + j]) & np.uint32(255)] ^ (crc[some] >> np.uint32(8))
        crc = ~crc
        for w in np.flatnonzero(size > SHORT):
            crc[w] = zlib.crc32(data[starts[w] : ends[w]])
        text = np.searchsorted(offsets, starts, "right") - 1
        pair = np.flatnonzero(text[1:] == text[:-1])
        spaced = ~crc[pair]  # the state after the first word; then the space
        spaced = ~(BYTE_TABLE[(spaced ^ np.uint32(32)) & np.uint32(255)] ^ (spaced >> np.uint32(8)))
        second = pair + 1
        n = np.minimum(size[second], SHORT)
        both = crc[second].copy()
        for k in range(4):
            both ^= FAR_TABLES[n, k, (spaced >> np.uint32(8 * k)) & np.uint32(255)]
        for p in np.flatnonzero(size[second] > SHORT):
            both[p] = zlib.crc32(data[starts[second[p]] : ends[second[p]]], int(spaced[p]))
        self.bucket = np.concatenate([crc, both]).astype(np.int64) % BUCKETS
        self.text = np.concatenate([text, text[pair]])
        self.n_words = np.bincount(text, minlength=len(offsets) - 1)


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket: a task sends one row of sums, added up a tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, place = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in slices(batch, PIECE_BYTES):
                place = part.column("place")[0].as_py()
                total += np.bincount(Features(part.column("text")).bucket, minlength=BUCKETS)
        if total.any():
            yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

    def add(key: tuple, x: pa.Table) -> pa.Table:
        return pa.table({"place": pa.array([key[0].as_py()], pa.int64()), "total": pa.array([sum(np.frombuffer(b, np.int64) for b in x.column("total").to_pylist()).tobytes()], pa.binary())})

    leaves = rows.rdd.getNumPartitions()
    sums = rows.select("text", F.spark_partition_id().cast("long").alias("place")).mapInArrow(count, "place long, total binary")
    while True:
        leaves = -(-leaves // FAN)
        sums = sums.withColumn("place", F.floor(F.col("place") / FAN)).groupBy("place").applyInArrow(add, "place long, total binary")
        if leaves <= 1:
            got = sums.collect()
            return np.frombuffer(bytes(got[0]["total"]), np.int64) if got else np.zeros(BUCKETS, np.int64)


def gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of each bucket."""
    own, aim = float(counts.sum()), float(target.sum())
    return np.array([int(np.floor(1000 * log((t + 1.0) * (own + BUCKETS) / ((s + 1.0) * (aim + BUCKETS))))) for s, t in zip(counts.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return int(np.floor(-1000 * log(-log((h + 0.5) / 4294967296))))


def key_order(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Highest score first, ties by id, null ids last."""
    return np.lexsort((rows["doc_id"], rows["null_id"], -rows["score"]))


def blobs(rows: dict[str, np.ndarray]) -> dict[str, list[bytes]]:
    return {c: [np.ascontiguousarray(rows[c], np.int8 if c == "null_id" else np.int64).tobytes()] for c in COLUMNS}


def opened(row: dict) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(row[c], np.int8 if c == "null_id" else np.int64) for c in COLUMNS}


def sorted_runs(rows: DataFrame, gain: np.ndarray, seed: int, least_words: int) -> DataFrame:
    """Runs of up to RUN rows: first the eligible ones in order, then the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        number = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            every = {c: np.concatenate([h[c] for h in held]) for c in (*COLUMNS, "eligible", "place")}
            own = np.flatnonzero(every["eligible"])
            own = own[key_order({c: every[c][own] for c in COLUMNS})]
            order = np.concatenate([own, np.flatnonzero(~every["eligible"])])
            number += 1
            name = (int(every["place"][0]) << 24) + number
            return pa.RecordBatch.from_pydict({"run": pa.array([name], pa.int64()), "eligible": pa.array([len(own)], pa.int64()), "rows": pa.array([len(order)], pa.int64()), **blobs({c: every[c][order] for c in COLUMNS})})

        for batch in batches:
            for part in slices(batch, PIECE_BYTES):
                f = Features(part.column("text"))
                n = np.bincount(f.text, minlength=part.num_rows)
                total = np.zeros(part.num_rows, np.int64)
                np.add.at(total, f.text, gain[f.bucket])
                weight = total // np.maximum(n, 1)
                ids = part.column("doc_id").to_pylist()
                held.append({"score": weight + np.array([noise(i, seed) for i in ids], np.int64), "doc_id": np.array([NONE if i is None else i for i in ids], np.int64), "n_features": n.astype(np.int64), "weight": weight, "null_id": np.array([i is None for i in ids]), "eligible": f.n_words >= least_words, "place": np.full(len(ids), part.column("place")[0].as_py())})
                if sum(len(h["score"]) for h in held) >= RUN:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return rows.select("doc_id", "text", F.spark_partition_id().cast("long").alias("place")).mapInArrow(run, RUNS)


def place_in(rows: dict[str, np.ndarray], run: int, n: int, edge: tuple[int, int, int, int]) -> int:
    """How many of a run's n first rows come before an edge (-score, null_id, id, run)."""
    a, b = np.searchsorted(-rows["score"][:n], edge[0], "left"), np.searchsorted(-rows["score"][:n], edge[0], "right")
    for c, value in (("null_id", edge[1]), ("doc_id", edge[2])):
        own = rows[c][a:b]
        a, b = a + np.searchsorted(own, value, "left"), a + np.searchsorted(own, value, "right")
    return int(b if run < edge[3] else a)


class Tournament:
    """Merges sorted runs: a tree of matches between the runs' next keys, the least of which wins. The winner gives out all
    its keys that are below the best of those that lost to it, and its matches are played again."""

    def __init__(self, runs: list[dict[str, np.ndarray]]):
        self.keys = [list(zip((-r["score"]).tolist(), r["null_id"].tolist(), r["doc_id"].tolist(), [k] * len(r["score"]), strict=True)) for k, r in enumerate(runs)]
        self.at = [0] * len(runs)
        self.leaves = 1 << max(0, (len(runs) - 1)).bit_length()
        self.tree: list[int] = [-1] * (2 * self.leaves)
        for k in range(len(runs)):
            self.tree[self.leaves + k] = k
        for node in range(self.leaves - 1, 0, -1):
            self.tree[node] = self.winner(self.tree[2 * node], self.tree[2 * node + 1])

    def head(self, k: int) -> tuple | None:
        return self.keys[k][self.at[k]] if k >= 0 and self.at[k] < len(self.keys[k]) else None

    def winner(self, a: int, b: int) -> int:
        x, y = self.head(a), self.head(b)
        return b if x is None else a if y is None else a if x < y else b

    def merge(self) -> Iterator[tuple[int, int, int]]:
        """(run, from, to): rows of one run that follow one another in the merged order."""
        while self.head(k := self.tree[1]) is not None:
            node, rival = self.leaves + k, None
            while node > 1:
                other = self.head(self.tree[node ^ 1])
                rival = other if rival is None or (other is not None and other < rival) else rival
                node //= 2
            begin = self.at[k]
            self.at[k] += 1
            while (head := self.head(k)) is not None and (rival is None or head < rival):
                self.at[k] += 1
            yield k, begin, self.at[k]
            node = (self.leaves + k) // 2
            while node:
                self.tree[node] = self.winner(self.tree[2 * node], self.tree[2 * node + 1])
                node //= 2


def edges_of(runs: DataFrame, eligible: int, draw: int) -> list[tuple[int, int, int, int]]:
    """Where ranges begin, but for the first: every so many keys of a sample of the runs' keys; about SAMPLED of them."""
    shuffled = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, max(-(-draw // RANGE), min(2 * shuffled, draw // 256)))
    step = max(1, eligible // SAMPLED, eligible // (64 * max(1, ranges)) // 4)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = opened(row)
                first = int.from_bytes(hashlib.sha256(str(row["run"]).encode()).digest()[:6], "big") % step
                at = np.arange(first, row["eligible"], step)
                yield pa.RecordBatch.from_pydict({"s": -rows["score"][at], "z": rows["null_id"][at].astype(np.int64), "d": rows["doc_id"][at], "r": pa.array([row["run"]] * len(at), pa.int64())})

    if ranges < 2:
        return []
    keys = sorted(map(tuple, runs.mapInArrow(sample, "s long, z long, d long, r long").collect()))
    own = max(1, round(len(keys) * draw / max(1, eligible) / ranges))  # keys a range of what is drawn
    return sorted({keys[at] for at in range(own, len(keys), own)})[: ranges + 1]


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank (1, 2, 3 ... in order of the draw; null if not drawn) of every document.

    Null texts are empty: no features, weight 0, never drawn under least_words. Null ids are hashed as the empty string
    and come last among equal scores; rows that repeat an id are drawn one by one, in any order among equals, each with a
    rank of its own. Empty documents give an empty result; without target texts all target counts are 0. Texts of any
    length are taken whole. Other columns are not read.

    Texts are read twice, narrowly: once for the counts and once for the weights. A range is about RANGE rows, or a part
    in MOST_RANGES of the draw; equal keys are told apart by their run, so no key makes a large one.
    """
    rows = text_rows(docs, id_col, text_col)
    aim = target.select(F.coalesce(F.col(target_col), F.lit("")).alias("text"))
    gain = gains(bucket_counts(rows), bucket_counts(aim))
    runs = materialize(sorted_runs(rows, gain, seed, least_words))
    eligible = runs.agg(F.sum("eligible")).first()[0] or 0
    draw = percent * eligible // 100
    edges = edges_of(runs, eligible, draw)

    def cuts(row: dict, rows: dict) -> list[int]:
        return [0, *(place_in(rows, row["run"], row["eligible"], e) for e in edges), row["eligible"]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                total += np.diff(cuts(row, opened(row)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"range": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    sizes = np.zeros(len(edges) + 1, np.int64)
    for r in runs.mapInArrow(count, "range int, n long").groupBy("range").agg(F.sum("n").alias("n")).collect():
        sizes[r["range"]] = r["n"]
    before = np.concatenate([[0], np.cumsum(sizes)])
    used = int(np.searchsorted(before, draw, "left"))  # ranges from here on are past the draw

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = opened(row)
                at = cuts(row, rows)
                for k in range(used):
                    if at[k] < at[k + 1]:
                        yield pa.RecordBatch.from_pydict({"range": pa.array([k], pa.int32()), "run": pa.array([row["run"]], pa.int64()), "n": pa.array([at[k + 1] - at[k]], pa.int64()), **blobs({c: rows[c][at[k] : at[k + 1]] for c in COLUMNS})})

    def out(rows: dict[str, np.ndarray], ranks: pa.Array) -> dict:
        return {"doc_id": pa.array(rows["doc_id"], mask=rows["null_id"].astype(bool)), **{c: pa.array(rows[c]) for c in ("n_features", "weight", "score")}, "rank": ranks}

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        k = key[0].as_py()
        own = [opened(r) for r in rows.sort_by("run").to_pylist()]
        base = np.cumsum([0, *(len(x["score"]) for x in own)])
        left, parts = draw - int(before[k]), []
        for run, a, b in Tournament(own).merge():
            if left <= 0:
                break
            parts.append(np.arange(base[run] + a, base[run] + min(b, a + left)))
            left -= b - a
        drawn = np.concatenate(parts)
        rest = np.setdiff1d(np.arange(base[-1]), drawn, assume_unique=True)
        order = np.concatenate([drawn, rest])
        every = {c: np.concatenate([x[c] for x in own])[order] for c in COLUMNS}
        ranks = pa.concat_arrays([pa.array(before[k] + 1 + np.arange(len(drawn)), pa.int64()), pa.nulls(len(rest), pa.int64())])
        return pa.table(out(every, ranks))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = opened(row)
                rows = {c: v[cuts(row, rows)[used] :] for c, v in rows.items()}
                yield pa.RecordBatch.from_pydict(out(rows, pa.nulls(len(rows["score"]), pa.int64())))

    drawn = runs.mapInArrow(piece, PIECES).groupBy("range").applyInArrow(merge, DRAWN)
    return drawn.unionByName(runs.mapInArrow(rest, DRAWN))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents; nulls, ties and repeats as importance_resample has them."""
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TABLE = ", ".join(map(str, BYTE_TABLE.tolist()))
SQL = f"""WITH crc AS MATERIALIZED (SELECT [{_TABLE}]::BIGINT[] AS t),
w AS MATERIALIZED (SELECT 'd' AS k, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
    UNION ALL SELECT 'b', row_number() OVER (), item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
f AS MATERIALIZED (SELECT k, r, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM w),
h AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM f)),
z AS MATERIALIZED (SELECT feature, (xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS})::BIGINT AS bucket FROM h, crc),
g AS MATERIALIZED (SELECT k, r, bucket FROM f JOIN z ON f.feature = z.feature),
n AS (SELECT bucket, count(*) FILTER (WHERE k = 'd')::DOUBLE AS s, count(*) FILTER (WHERE k = 'b')::DOUBLE AS t FROM g GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM n) + {BUCKETS}))))::BIGINT AS gain FROM n),
m AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS total FROM g JOIN gain ON g.bucket = gain.bucket WHERE k = 'd' GROUP BY r),
d AS (SELECT doc_id, w.r, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(floor(total / n_features::DOUBLE), 0)::BIGINT AS weight, ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h FROM w LEFT JOIN m ON w.r = m.r WHERE k = 'd'),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM d),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM e WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (25 * (SELECT count(*) FROM o)) // 100 THEN rank END AS rank FROM e LEFT JOIN o ON e.r = o.r"""

QUERIES = {"op13_importance_resampling": op13_importance_resampling}
ORACLES = {"op13_importance_resampling": SQL}
