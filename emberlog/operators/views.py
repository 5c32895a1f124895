"""Rollups that are views: by day, by month and topic, by source; anniversaries; what was promised and forgotten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_rollup(events: DataFrame, keys: list[str], ts: str, chars: str) -> DataFrame:
    return events.groupBy(F.to_date(F.date_trunc("day", ts)).alias("day"), *keys).agg(F.count("*").alias("n"), F.sum(F.length(chars)).alias("chars"))


def monthly_topics(segments: DataFrame, ts: str, topics: str, value: str) -> DataFrame:
    return segments.select(F.to_date(F.date_trunc("month", ts)).alias("month"), F.explode(topics).alias("topic"), value).groupBy("month", "topic").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def on_this_day(rows: DataFrame, ts: str, now: Column, sensitive: DataFrame | None = None) -> DataFrame:
    """Rows of this month and day in earlier years, outside sensitive intervals (starts_at, ends_at or 30 days)."""
    same = (F.month(ts) == F.month(now)) & (F.dayofmonth(ts) == F.dayofmonth(now)) & (F.col(ts) < F.date_trunc("year", now))
    found = rows.where(same)
    if sensitive is None:
        return found
    # One person's sensitive periods: adaptive execution broadcasts them only if they are as small as they should be.
    return found.join(sensitive, (found[ts] >= sensitive["starts_at"]) & (found[ts] <= F.coalesce(sensitive["ends_at"], sensitive["starts_at"] + F.expr("interval 30 days"))), "left_anti")


def forgotten_commitments(commitments: DataFrame, created: str, now: Column, days: int = 90, resolved: str = "resolved_by") -> DataFrame:
    """Open commitments older than days (90 at least), with their age."""
    age = F.datediff(F.to_date(now), F.to_date(created))
    return commitments.where(F.col(resolved).isNull()).withColumn("age_days", age).where(F.col("age_days") > max(days, 90))
