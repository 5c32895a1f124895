"""Checks of sources and of answers: freshness, pre-ingest checks, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.times import seconds_between


def freshness(events: DataFrame, key: str, ts: str, now: Column) -> DataFrame:
    """key, last_event, active_days, usual_gap_days, days_silent, status.

    usual_gap_days: the longest gap between active days, null under ten of them. dormant beyond 365 days of silence;
    else unknown without a usual gap; silent beyond three days and twice the usual gap; else ok.
    """
    days = events.where(F.col(ts).isNotNull()).groupBy(key, F.to_date(ts).alias("day")).agg(F.max(ts).alias("at"))
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy(key).orderBy("day")))
    out = days.withColumn("gap", gap).groupBy(key).agg(F.max("at").alias("last_event"), F.count("*").alias("active_days"), F.max("gap").alias("gap"))
    out = out.withColumns({"silent": seconds_between(now, F.col("last_event")) / 86400, "usual_gap_days": F.when(F.col("active_days") >= 10, F.col("gap")).cast("long")})
    status = F.when(F.col("silent") > 365, "dormant").when(F.col("usual_gap_days").isNull(), "unknown").when(F.col("silent") > F.greatest(F.lit(3), 2 * F.col("usual_gap_days")), "silent").otherwise("ok")
    return out.select(key, "last_event", "active_days", "usual_gap_days", F.round("silent", 1).alias("days_silent"), status.alias("status"))


# The sources whose samples often carry the time of their import, and the longest span of one rolled-up event.
STAMPED_ON_IMPORT = ["immich", "paperless", "karakeep"]
LONGEST_ROLLUP = 3 * 86400


def doctor_sample(rows: DataFrame, key: str, order: list[str], since: Column, most: int = 25) -> DataFrame:
    """The first most rows of each source from since on, with dormant false; of a source that has none, of all its rows,
    with dormant true: a source that went quiet must still be checked."""
    w = Window.partitionBy(key)
    recent = F.coalesce(F.col("ts") >= since, F.lit(False))
    marked = rows.withColumn("_recent", recent).withColumn("dormant", ~F.max("_recent").over(w)).where("_recent or dormant")
    return marked.withColumn("_n", F.row_number().over(w.orderBy(*order))).where(F.col("_n") <= most).drop("_n", "_recent")


def doctor_checks(rows: DataFrame, key: str, order: list[str], source: Column | None = None) -> DataFrame:
    """key, problem, n (how many rows, where the check counts them) of what is odd about each source's rows.

    rows (source_id, ts, watermark_ts, text, thread_key, density) in the order in which they come in; source: whose
    sample it is, if key does not name it. Eight checks: a
    missing time; neither times nor watermarks ascending (one of them may be unordered); ten times and more within an
    hour, for sources that tend to give the time of import; an id twice; telemetry whose gaps are mostly (the upper
    middle, of ten times and more) under a minute; narrative texts mostly blank; no narrative row with a thread of its
    own; telemetry that ends more than three days after it began. Rows without a time count for the first, fourth,
    sixth and seventh check only. One pass of counts and sums: gaps are judged by how many are short, so none is kept.
    """
    some = Window.partitionBy(key, F.col("ts").isNull()).orderBy(*order)
    marks = Window.partitionBy(key, F.col("watermark_ts").isNull()).orderBy(*order)
    marked = rows.withColumns({"_gap": seconds_between(F.col("ts"), F.lag("ts").over(some)), "_mark": F.col("watermark_ts") < F.lag("watermark_ts").over(marks), "_span": seconds_between(F.col("watermark_ts"), F.col("ts")), "_blank": F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)^\s*$")})
    got = marked.groupBy(key).agg(
        F.count("*").alias("n"), F.count("ts").alias("n_ts"), F.count_if(F.col("_gap") < 0).alias("back"), F.count_if("_mark").alias("mark_back"), seconds_between(F.max("ts"), F.min("ts")).alias("span"),
        (F.count("source_id") - F.countDistinct("source_id")).alias("dup"), F.count_if(F.col("_gap") < 60).alias("short"), F.count("_gap").alias("gaps"), F.count_if("_blank").alias("empty"),
        F.count_if(F.col("thread_key") == "default").alias("default_thread"), F.count_if(F.col("_span") > LONGEST_ROLLUP).alias("long_span"), F.max("density").alias("density"), F.max(source if source is not None else F.col(key)).alias("_source"),
    )
    checks = [
        ("missing timestamps", "n_ts < n", "n - n_ts"), ("out of order", "back > 0 and mark_back > 0", "0"),
        ("timestamps look like import time", f"n_ts >= 10 and span < 3600 and _source in ({', '.join(repr(x) for x in STAMPED_ON_IMPORT)})", "n_ts"), ("duplicate ids", "dup > 0", "dup"),
        ("telemetry not rolled up", "density = 'telemetry' and n_ts >= 10 and short > gaps div 2", "short"), ("mostly empty text", "density = 'narrative' and 2 * empty > n", "empty"),
        ("default thread", "density = 'narrative' and default_thread = n", "n"), ("rollup span over three days", "density = 'telemetry' and long_span > 0", "long_span"),
    ]
    found = F.filter(F.array(*[F.when(F.expr(e), F.struct(F.lit(name).alias("problem"), F.expr(n).cast("long").alias("n"))) for name, e, n in checks]), lambda x: x.isNotNull())
    return got.select(key, F.explode(found).alias("p")).select(key, "p.problem", "p.n")


def evaluate(ranked: DataFrame, gold: DataFrame, kinds: DataFrame) -> DataFrame:
    """kind (and overall), questions, recall, p_at_1. ranked: question, id, rank; gold: question, id; kinds: question, kind."""
    hits = gold.join(ranked, ["question", "id"], "left").groupBy("question").agg(F.count_if(F.col("rank").isNotNull()).alias("found"), F.count("*").alias("wanted"), F.max(F.coalesce(F.col("rank") == 1, F.lit(False)).cast("int")).alias("first"))
    per = hits.join(kinds, "question")
    measure = [F.count("*").alias("questions"), F.avg(F.col("found") / F.col("wanted")).alias("recall"), F.avg("first").alias("p_at_1")]
    return per.groupBy("kind").agg(*measure).unionByName(per.agg(*measure).withColumn("kind", F.lit("overall")))


def result_slots(ranked: DataFrame, segments: DataFrame, limit: int = 20) -> DataFrame:
    """source, slots: of which source the first event of each result is, over the first limit results of all questions
    (question, id, rank). A source that outnumbers the others can take their places without ever being wrong."""
    held = segments.select(F.col("segment_id").alias("id"), F.substring_index(F.get("source_event_ids", F.lit(0)), ":", 1).alias("source"))
    return ranked.where(F.col("rank") <= limit).join(held, "id").where("source is not null").groupBy("source").agg(F.count("*").alias("slots"))


def within_budget(groups: DataFrame, budget: int) -> DataFrame:
    """question, bin, rank_in_bin, size: taken round-robin over bins until the ids of a question reach the budget; the
    group at the edge is cut to what is left (take)."""
    w = Window.partitionBy("question").orderBy("rank_in_bin", "bin").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("size").over(w)
    return groups.withColumn("take", F.least(F.col("size"), budget - (upto - F.col("size")))).where("take > 0")


def grep_baseline(lines: DataFrame, keywords: list[str], most: int = 200, text_col: str = "text") -> DataFrame:
    """The first lines that hold any keyword, ignoring case."""
    import re

    return lines.where(F.col(text_col).rlike("(?iu)" + "|".join(re.escape(k) for k in keywords))).orderBy("ts", "source_id").limit(most)
