"""Exact nearest vectors over kept clusters: clusters that cannot hold a near one are not read, and of the others only
one-byte codes, until few enough candidates are left to be compared in full."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.vectors import cosine_distance
from emberlog.operators.search import FILTERED, filter_of, substantive
from emberlog.store import keep, kept

#: Vectors that centres are fitted to, vectors a centre, centres at most, and rounds of fitting.
SAMPLED, CLUSTER, MOST_CENTRES, ROUNDS = 1 << 14, 2000, 1 << 10, 8
#: Up to so many vectors are compared at once: a job less is worth more than the clusters it would spare.
AT_ONCE = 10_000
#: What rounding may add to a bound, and the width within which distances count as equal and ids decide.
SLACK, SAME = 1e-6, 2e-9
CODES = "id long, cluster int, code binary, scale float, error float, far float"


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def centres_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit centres of unit vectors, by rounds of the nearest centre from evenly spread ones."""
    at = sample[np.linspace(0, len(sample) - 1, count).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (sample @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), at)
    return at


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def keep_vectors(segments: DataFrame, name: str, id_col: str = "segment_id", vector_col: str = "embedding", centres: int | None = None) -> None:
    """Write what nearest() needs, once for each state of the archive, as tables or, if name is a path, under it:
    name_vectors (codes and vectors), in folders by cluster, and name_clusters (cluster, centre, radius, n).

    Left out are segments that are not substantive and those without a vector or with a zero one; all vectors have one
    width. Centres are fitted to a sample of about SAMPLED vectors on the driver; every vector then goes to its nearest
    centre where it is read. A code is a vector at unit length in signed bytes, with its scale and the length of what
    rounding took; a large cluster is written by several tasks.
    """
    spark = segments.sparkSession
    size = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    own = [c for c in FILTERED if c in segments.columns]
    rows = substantive(segments).where(F.col(vector_col).isNotNull() & (size > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), *own)
    n = rows.count()
    if n == 0:
        keep(spark.sql("select 0 as cluster, '' as centre, 0f as radius, 0l as n where false").write, f"{name}_clusters")
        return
    share = min(1.0, SAMPLED / max(1, n))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 24)) < F.lit(int(share * (1 << 24)))).select("vector").limit(2 * SAMPLED).toArrow()
    # A sample that came out empty is any one vector: then all are one cluster, whatever its centre.
    some = some if some.num_rows else rows.select("vector").limit(1).toArrow()
    sample = unit_rows(matrix(some.column("vector")))
    at = centres_of(sample, max(1, min(len(sample), centres or min(MOST_CENTRES, n // CLUSTER))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(matrix(batch.column("vector")))
            cluster = (unit @ at.T).argmax(1)
            scale = np.abs(unit).max(1) / 127
            code = np.rint(unit / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(unit - code * scale[:, None].astype(np.float32), axis=1)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "cluster": pa.array(cluster, pa.int32()), "code": pa.array([c.tobytes() for c in code], pa.binary()), "scale": pa.array(scale.astype(np.float32)), "error": pa.array((error + SLACK).astype(np.float32)),
                "far": pa.array((np.linalg.norm(unit - at[cluster], axis=1) + SLACK).astype(np.float32)), "vector": batch.column("vector"), **{c: batch.column(c) for c in own},
            })

    kinds = "".join(f", {c} {k}" for c, k in rows.dtypes if c in ("vector", *own))
    coded = rows.mapInArrow(encode, CODES + kinds).hint("rebalance", "cluster").sortWithinPartitions("cluster", "id")
    keep(coded.write.partitionBy("cluster").option("compression", "zstd"), f"{name}_vectors")
    radii = kept(spark, f"{name}_vectors").groupBy("cluster").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    known = spark.createDataFrame([(k, json.dumps(c.tolist())) for k, c in enumerate(at)], "cluster int, centre string")  # MOST_CENTRES at most
    keep(known.join(F.broadcast(radii), "cluster").write, f"{name}_clusters")


class Vectors:
    """Kept vectors, by the name that keep_vectors() was given. The centres are read once."""

    def __init__(self, spark: SparkSession, name: str):
        known = kept(spark, f"{name}_clusters").orderBy("cluster").collect()
        self.spark, self.rows = spark, kept(spark, f"{name}_vectors") if known else None
        self.cluster = np.array([r["cluster"] for r in known], np.int64)
        self.centre = np.array([json.loads(r["centre"]) for r in known], np.float64)
        self.radius = np.array([r["radius"] for r in known], np.float64)
        self.n = np.array([r["n"] for r in known], np.int64)
        self.read: list[int] = []

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """The greatest cosine that a vector of each cluster can have with unit: none is nearer to it than the centre less the radius."""
        least = np.maximum(0.0, np.linalg.norm(self.centre - unit, axis=1) - self.radius - SLACK)
        return 1 - least**2 / 2

    def scored(self, clusters: np.ndarray, unit: np.ndarray, above: float, k: int, passing: Column) -> DataFrame:
        """id, cluster and low, high (bounds of the cosine) of kept vectors of the clusters that can be among the k best, as
        far as their own task can tell, and can be above."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full(0, -2.0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, -1)
                about = (code.astype(np.float32) @ unit.astype(np.float32)).astype(np.float64) * batch.column("scale").to_numpy()
                error = batch.column("error").to_numpy().astype(np.float64) + SLACK
                best = np.sort(np.concatenate([best, about - error]))[-k:]
                at = max(above, best[0] if len(best) == k else -2.0)
                own = np.flatnonzero(about + error >= at - SAME)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(own)), "cluster": batch.column("cluster").take(pa.array(own)), "low": pa.array((about - error)[own]), "high": pa.array((about + error)[own])})

        some = self.rows.where(F.col("cluster").isin([int(c) for c in self.cluster[clusters]])).where(passing)
        return some.select("id", "cluster", "code", "scale", "error").mapInArrow(run, "id long, cluster int, low double, high double")

    def nearest(self, vector: list[float], k: int = 100, **filters) -> DataFrame:
        """id, distance of the k nearest by exact cosine distance (ties within a billionth by id), in order: the rows of a
        full scan. filters: as of search.filter_of. A zero vector is near to nothing."""
        size = float(np.linalg.norm(np.array(vector, np.float64)))
        nothing = self.spark.createDataFrame([], "id long, distance double")
        if not size or not len(self.cluster):
            return nothing
        unit = np.array(vector, np.float64) / size
        passing, most = filter_of(self.rows, **filters), self.bounds(unit)
        q = F.lit(np.array(vector, np.float64))
        if self.n.sum() <= AT_ONCE:
            self.read = [int(self.n.sum())] * 2
            rows = self.rows.where(passing).select("id", cosine_distance(F.col("vector"), q).alias("distance"))
            return rows.withColumn("o", F.round("distance", 9)).orderBy("o", "id").limit(k).select("id", "distance")
        order = np.argsort(-most, kind="stable")
        upto = int(np.searchsorted(np.cumsum(self.n[order]), 4 * k)) + 1
        # The k-th best lower bound among the nearest clusters: what cannot reach it is out, cluster by cluster, then code by code.
        first = self.scored(order[:upto], unit, -2.0, k, passing).select("low").orderBy(F.desc("low")).limit(k).agg(F.min("low").alias("low"), F.count("*").alias("n")).first()
        above = first["low"] if first["n"] == k else -2.0
        able = np.flatnonzero(most >= above - SAME)
        self.read = [int(self.n[able].sum()), int(self.n.sum())]
        found = self.scored(able, unit, above, k, passing).where(F.col("high") >= above - SAME).select("id", "cluster")
        full = self.rows.where(F.col("cluster").isin([int(c) for c in self.cluster[able]])).select("id", "cluster", "vector").join(found, ["id", "cluster"], "left_semi")
        scored = full.select("id", cosine_distance(F.col("vector"), q).alias("distance")).withColumn("o", F.round("distance", 9))
        return scored.orderBy("o", "id").limit(k).select("id", "distance")
