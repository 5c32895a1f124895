"""Operator 11: centroid clustering by annulus search.

Vectors are turned into integers once and written down. In each round centroids are sorted by norm; a vector's distance to
the centroid nearest in norm bounds its distance to the nearest one, so only centroids whose norm lies within that bound
of its own can be as near: a binary search finds them, and those are compared exactly, ties at the edge included. A task
adds its vectors up by centroid; what it sends on is one row a centroid, and these are added up a tree.

All arithmetic is on integers: 64 bits wide where a squared distance fits, Python's own beyond.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import materialize, table

#: Largest magnitude of a component for which 64-bit arithmetic holds squared distances of up to 2^12 components.
NARROW = 1 << 24
#: Vectors that a task compares at once.
STEP = 4096
#: Rows of partial sums that one group adds up.
FAN = 64
MOST = 2**63 - 1
SUMS = "cluster int, place long, totals string"


def as_integers(embedding: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists have width components, none null or not finite; and floor(scale * x) of theirs, as 64-bit integers
    where they all fit, else as Python's."""
    sizes = np.diff(embedding.offsets.to_numpy())
    whole = embedding.is_valid().to_numpy(zero_copy_only=False) & (sizes == width)
    flat = embedding.filter(pa.array(whole)).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # a null is not finite here
    good = np.isfinite(values).all(1)
    whole[np.flatnonzero(whole)[~good]] = False
    values = values[good]
    if len(values) and np.abs(values).max() * scale >= 2**53:
        return whole, np.array([[int(x) * scale if abs(x) >= 2**53 else floor(x * scale) for x in v] for v in values.tolist()], object)
    return whole, np.floor(values * scale).astype(np.int64)


def packed(values: np.ndarray) -> list[bytes]:
    """A vector as decimal text where it has a component beyond 32 bits, else as a zero byte and 32-bit integers."""
    if values.dtype == object or (len(values) and np.abs(values).max() >= 2**31):
        return [",".join(map(str, v)).encode() for v in values.tolist()]
    return [b"\0" + v.tobytes() for v in values.astype("<i4")]


def unpacked(blobs: list[bytes], width: int) -> np.ndarray:
    if all(b[:1] == b"\0" for b in blobs):
        return np.frombuffer(b"".join(b[1:] for b in blobs), "<i4").reshape(-1, width).astype(np.int64)
    return np.array([np.frombuffer(b, "<i4", offset=1).tolist() if b[:1] == b"\0" else [int(x) for x in b.split(b",")] for b in blobs], object).reshape(-1, width)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """vec_id and v (packed integers) of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                whole, values = as_integers(part.column("v"), width, scale)
                yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id").filter(pa.array(whole)), "v": pa.array(packed(values), pa.binary())})

    some = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return some.mapInArrow(run, "vec_id long, v binary")


def squared(values: np.ndarray) -> np.ndarray:
    return (values * values).sum(-1)


def roots(squares: np.ndarray) -> np.ndarray:
    """Square roots as doubles; of Python's integers rounded down to integers."""
    return np.array([isqrt(x) for x in squares], object) if squares.dtype == object else np.sqrt(squares.astype(np.float64))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid (the smallest of equally near ones) and the squared distance, by annuli."""
    narrow = vectors.dtype != object and centroids.dtype != object and all(len(x) == 0 or np.abs(x).max() < NARROW for x in (vectors, centroids))
    if not narrow:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    norms = roots(squared(centroids))
    order = np.lexsort((np.arange(len(norms)), norms))
    norms, ranked = norms[order], centroids[order]
    own = roots(squared(vectors))
    # A first centroid: of the two next in norm the nearer in norm.
    first = np.zeros(len(own), np.int64)
    if len(norms) > 1:
        right = np.searchsorted(norms, own).clip(1, len(norms) - 1)
        first = np.where(own - norms[right - 1] <= norms[right] - own, right - 1, right)
    best = squared(vectors - ranked[first])
    number = order[first].copy()
    # Roots are rounded: the edges are put outward, and what lies there is compared exactly like all others.
    reach = roots(best) * (1 + 1e-12) + own * 1e-12 + 1e-9 if narrow else roots(best) + 3
    low, high = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
    for place in range(int(low.min()), int(high.max())) if len(own) else ():
        some = np.flatnonzero((low <= place) & (place < high) & (first != place))
        if not len(some):
            continue
        d = squared(vectors[some] - ranked[place])
        better = (d < best[some]) | ((d == best[some]) & (order[place] < number[some]))
        best[some[better]], number[some[better]] = d[better], order[place]
    return number, best


def assigned(vectors: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """vec_id, cluster, distance; a distance beyond 64 bits is 2^63 - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                number, best = nearest(unpacked(part.column("v").to_pylist(), width), centroids)
                yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id"), "cluster": pa.array(number.astype(np.int32)), "distance": pa.array([min(MOST, int(d)) for d in best], pa.int64())})

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_sums(vectors: DataFrame, centroids: np.ndarray, width: int) -> dict[int, list[int]]:
    """For each centroid that has vectors: their count and the exact sum of each component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        place = 0
        for batch in batches:
            place = batch.column("place")[0].as_py() if batch.num_rows else place
            for at in range(0, batch.num_rows, STEP):
                values = unpacked(batch.column("v").slice(at, STEP).to_pylist(), width)
                number, _ = nearest(values, centroids)
                for k in np.unique(number):
                    own = values[number == k]
                    # STEP components below 2^31 add up within 64 bits; from there on Python's integers.
                    totals[int(k)] = totals.get(int(k), 0) + np.concatenate([[len(own)], own.sum(0)]).astype(object)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(list(totals), pa.int32()), "place": pa.array([place] * len(totals), pa.int64()), "totals": pa.array([",".join(map(str, v)) for v in totals.values()], pa.string())})

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        every = [np.array([int(x) for x in t.split(",")], object) for t in rows.column("totals").to_pylist()]
        return pa.table({"cluster": pa.array([key[0].as_py()], pa.int32()), "place": pa.array([key[1].as_py()], pa.int64()), "totals": [",".join(map(str, sum(every)))]})

    leaves = vectors.rdd.getNumPartitions()
    rows = vectors.select("v", F.spark_partition_id().cast("long").alias("place")).mapInArrow(add, SUMS)
    while True:
        leaves = -(-leaves // FAN)
        rows = rows.withColumn("place", F.floor(F.col("place") / FAN)).groupBy("cluster", "place").applyInArrow(join, SUMS)
        if leaves <= 1:
            return {r["cluster"]: [int(x) for x in r["totals"].split(",")] for r in rows.collect()}


def centroid_clusters(rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    Kept are vectors with exactly width components, none null or not finite; each component x becomes floor(scale * x).
    Centroids start as the k vectors with the least sha256 of "seed:id" (a null id as the empty string; repeated ids by
    their components), in that order; fewer vectors give fewer centroids. Rounds and ties as the contract has them.
    Repeated rows count as often as they are there; an empty table, or one without any such vector, gives an empty result.
    A squared distance or inertia beyond 64 bits is 2^63 - 1. Other columns are not read.

    The driver and each task hold k centroids. A vector is read once a round, narrowly; nothing is shuffled but partial
    sums, one row a task and centroid.
    """
    vectors = materialize(integer_vectors(rows, id_col, vector_col, width, scale))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    centroids = unpacked([bytes(r["v"]) for r in first], width)
    for _ in range(rounds if len(first) else 0):
        sums = cluster_sums(vectors, centroids, width)
        moved = centroids.astype(object)
        for c, (n, *total) in sums.items():
            moved[c] = [x // n for x in total]
        centroids = moved if np.abs(moved).max() >= 2**62 else moved.astype(np.int64)
    if not len(first):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    out = materialize(assigned(vectors, centroids, width))
    # A row a centroid: as many as the driver holds anyway.
    inertia = {r["cluster"]: min(MOST, int(r["total"])) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = min(MOST, sum(inertia.values()))
    about = [(c, inertia.get(c, 0), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in range(len(centroids))]
    known = out.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all vectors; nulls and repeats as centroid_clusters has them."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def sql(rounds: int = 10) -> str:
    """The rounds written out one after the other."""
    near = "SELECT vec_id, row_id, x, k AS cluster, d AS distance FROM (SELECT v.vec_id, v.row_id, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN {c} c) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, k) = 1"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, ''))) - 1 AS k, x FROM v ORDER BY k LIMIT 8)",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(c=f'c{i}')})")
        parts.append(f"m{i} AS (SELECT cluster AS k, j, sum(x[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, x, unnest(range(1, 65)) AS j FROM a{i}) GROUP BY 1, 2)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM m{i} GROUP BY k) n ON c.k = n.k)")
    parts.append(f"f AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    return f"WITH {', '.join(parts)} SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM f JOIN c{rounds} c ON c.k = cluster"


QUERIES = {"op11_centroid_clustering": op11_centroid_clustering}
ORACLES = {"op11_centroid_clustering": sql()}
