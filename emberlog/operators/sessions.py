"""Sessions, islands and stays: runs of rows that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.times import seconds_between
from emberlog.operators.density import density_clusters


def gap_sessions(rows: DataFrame, keys: list[str], ts: str, gap_seconds: float, order: list[str] | None = None) -> DataFrame:
    """rows with session (from 0 within the keys): a gap of more than gap_seconds begins a new one."""
    w = Window.partitionBy(*keys).orderBy(ts, *(order or []))
    new = F.coalesce(seconds_between(F.col(ts), F.lag(ts).over(w)) > gap_seconds, F.lit(False))
    return rows.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def timeline_sessions(rows: DataFrame, ts: str, gap_seconds: float, order: list[str] | None = None) -> DataFrame:
    """rows with session_start: the sessions of one timeline without keys, worked on by day.

    Only one row a day goes through the order of all days: the day's first and last instant, and its last start.
    """
    w = Window.partitionBy("_day").orderBy(ts, *(order or []))
    days = Window.orderBy("_day")  # a row a day
    dated = rows.withColumn("_day", F.to_date(ts))
    ends = dated.groupBy("_day").agg(F.max(ts).alias("_last")).select("_day", F.lag("_last").over(days).alias("_before"))
    held = dated.join(ends, "_day")
    new = F.coalesce(seconds_between(F.col(ts), F.coalesce(F.lag(ts).over(w), F.col("_before"))) > gap_seconds, F.lit(True))
    held = held.withColumn("_start", F.when(new, F.col(ts)))
    starts = held.groupBy("_day").agg(F.max("_start").alias("_s")).select("_day", F.last("_s", ignorenulls=True).over(days.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    own = F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return held.join(starts, "_day").withColumn("session_start", F.coalesce(own, F.col("_carried"))).drop("_day", "_before", "_start", "_carried")


def summarise_sessions(sessions: DataFrame, keys: list[str], ts: str, *more: Column) -> DataFrame:
    span = seconds_between(F.max(ts), F.min(ts))
    return sessions.groupBy(*keys, "session").agg(F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("n"), F.greatest(F.lit(1), F.floor(span / 60)).cast("long").alias("minutes"), *more)


def islands(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Runs of equal value in order within the keys: the difference of two row numbers is constant in a run."""
    both = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order))
    return rows.withColumn("island", both)


def stays(points: DataFrame, keys: list[str], ts: str, lat: str = "lat", lon: str = "lon", most: float = 0.0015, dwell_seconds: float = 1200, order: list[str] | None = None) -> DataFrame:
    """Runs in which each point is within most degrees of the one before; two points and the dwell time at least."""
    w = Window.partitionBy(*keys).orderBy(ts, *(order or []))
    moved = (F.abs(F.col(lat) - F.lag(lat).over(w)) > most) | (F.abs(F.col(lon) - F.lag(lon).over(w)) > most)
    runs = points.withColumn("_m", F.coalesce(moved, F.lit(False)).cast("int")).withColumn("stay", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "stay").agg(F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("n"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"))
    return out.where((F.col("n") >= 2) & (seconds_between(F.col("ended_at"), F.col("started_at")) >= dwell_seconds))


dbscan = density_clusters


def cluster_stays(points: DataFrame, key: str, ts: str, dwell_seconds: float = 1200) -> DataFrame:
    """Stays of clustered points: runs of one cluster; noise in between breaks a run."""
    marked = points.join(density_clusters(points, key), [key, "id"])
    # Noise takes part in the outer numbering, so it breaks the runs around it, and is then left out.
    runs = islands(marked.withColumn("cluster", F.coalesce("cluster", F.lit(-1))), [key], "cluster", [ts, "id"]).where("cluster >= 0")
    out = runs.groupBy(key, "cluster", "island").agg(F.min("id").alias("stay_id"), F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return out.where(seconds_between(F.col("ended_at"), F.col("started_at")) >= dwell_seconds)
