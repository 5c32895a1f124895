"""Erasure of threads with all that was drawn from them, and the proof that nothing is left.

What goes follows the dependencies from events and segments outward: a segment takes its facts, commitments and mentions
with it; a projection takes its dependencies; what merely cites erased events among others keeps the others, and goes
only if this erasure emptied it. Each step is an equi join on what is erased; nothing is gathered. What is erased is
written down once, and of the events only those that a table cites, so that where it is little the large tables stay
where they are; so are the tables that an erasure leaves, which its audit and its proof read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.store import written

KINDS = ("fact", "commitment")


class Doomed:
    """What an erasure takes: thread (thread_key), key (source:source_id of the events), segment_id."""

    def __init__(self, threads: DataFrame, events: DataFrame, segments: DataFrame):
        self.threads = written(threads.select("thread_key").where("thread_key is not null").distinct(), "threads")
        self.events = events.join(self.threads, "thread_key", "left_semi").select("source", "source_id", event_key().alias("key"))
        self.segments = written(segments.join(self.threads, "thread_key", "left_semi").select("segment_id"), "segments")

    def cited(self, rows: DataFrame) -> DataFrame:
        """Those of the erased events that rows (of columns of the events) name, each once."""
        return written(rows.distinct().join(self.events, rows.columns, "left_semi"), "cited")

    def of_segments(self, rows: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
        return rows.join(self.segments.withColumnRenamed("segment_id", column), column, how).select(rows.columns)

    def without_events(self, rows: DataFrame, id_col: str, keys_col: str) -> DataFrame:
        """rows whose keys_col lost the erased events, less those that this emptied; null and empty lists stay as they are."""
        cited = rows.select(id_col, F.explode(keys_col).alias("key"))
        cited = cited.join(self.cited(cited.select("key")), "key", "left_semi")
        lost = cited.groupBy(id_col).agg(F.collect_set("key").alias("_lost"))  # no longer than the row's own list
        marked = rows.join(lost, id_col, "left")
        rest = F.filter(keys_col, lambda k: ~F.array_contains("_lost", k))
        kept = marked.withColumn(keys_col, F.when(F.col("_lost").isNull(), F.col(keys_col)).otherwise(rest))
        return kept.where(F.col("_lost").isNull() | (F.size(keys_col) > 0)).select(rows.columns)


def event_key(source: str = "source", source_id: str = "source_id") -> Column:
    return F.concat_ws(":", source, source_id)


def reopened(commitments: DataFrame, doomed: Doomed) -> DataFrame:
    """Commitments that an erased segment resolved are open again."""
    gone = doomed.segments.select(F.col("segment_id").alias("resolution_segment_id"), F.lit(True).alias("_gone"))
    marked = commitments.join(gone, "resolution_segment_id", "left")
    return marked.withColumns({"status": F.when(F.col("_gone"), "open").otherwise(F.col("status")), "resolution_segment_id": F.when(F.col("_gone").isNull(), F.col("resolution_segment_id"))}).select(commitments.columns)


def purge(threads: DataFrame, events: DataFrame, segments: DataFrame, facts: DataFrame, commitments: DataFrame, mentions: DataFrame, life_events: DataFrame, deps: DataFrame) -> dict[str, DataFrame]:
    """The tables without the threads (thread_key), and audit: one row with what was taken.

    Columns used, as enrichment writes them: facts and commitments by source_segment_id and source_event_ids, a
    commitment's resolution_segment_id and status, mentions by segment_id, life_events by source_event_ids, deps by
    projection_kind, projection_id, source and source_id. Segments of a thread go with facts, commitments and mentions
    drawn from them; facts, commitments and life events that cite erased events besides others keep the others, and go
    where none is left; those that cite none, be their lists empty or null, are not touched. Dependencies go with their
    event and with their projection. A null thread is never erased; repeated threads count once.
    """
    doomed = Doomed(threads, events, segments)
    left = {kind: written(doomed.without_events(doomed.of_segments(before, "source_segment_id", "left_anti"), f"{kind}_id", "source_event_ids"), kind) for kind, before in (("fact", facts), ("commitment", commitments))}
    lost = None
    for kind, before in (("fact", facts), ("commitment", commitments)):
        ids = before.select(f"{kind}_id").join(left[kind].select(f"{kind}_id"), f"{kind}_id", "left_anti")
        own = ids.select(F.lit(kind).alias("projection_kind"), F.col(f"{kind}_id").alias("projection_id")).distinct()
        lost = own if lost is None else lost.unionByName(own)
    deps = written(deps, "deps")
    out = {
        "events": events.join(doomed.threads, "thread_key", "left_anti").select(events.columns),
        "segments": segments.join(doomed.threads, "thread_key", "left_anti").select(segments.columns),
        "facts": left["fact"],
        "commitments": reopened(left["commitment"], doomed),
        "mentions": doomed.of_segments(mentions, "segment_id", "left_anti").select(mentions.columns),
        "life_events": doomed.without_events(life_events, "life_event_id", "source_event_ids"),
        "deps": written(deps.join(doomed.cited(deps.select("source", "source_id")), ["source", "source_id"], "left_anti").join(lost, ["projection_kind", "projection_id"], "left_anti").select(deps.columns), "deps_left"),
    }
    taken = [(f"{name}_deleted", before, out[name]) for name, before in (("events", events), ("segments", segments), ("facts", facts), ("commitments", commitments), ("mentions", mentions), ("life_events", life_events), ("deps", deps))]
    counts = None
    for name, before, after in taken:
        one = before.agg(F.count("*").alias("a")).crossJoin(after.agg(F.count("*").alias("b"))).select(F.lit(name).alias("kind"), (F.col("a") - F.col("b")).alias("n"))  # one row each
        counts = one if counts is None else counts.unionByName(one)
    opened = doomed.of_segments(left["commitment"], "resolution_segment_id").agg(F.count("*").alias("n")).select(F.lit("commitments_reopened").alias("kind"), "n")
    out["audit"] = counts.unionByName(opened)
    return out


def proof(threads: DataFrame, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """table and leftovers, one row for every table after an erasure: rows that are of an erased thread, or point to one of
    its events or segments or to a projection that is gone. All must be 0.

    before: events and segments as they were; after: the tables of purge.
    """
    doomed = Doomed(threads, before["events"], before["segments"])

    def cites(rows: DataFrame, i: str) -> DataFrame:
        keys = rows.select(i, F.explode("source_event_ids").alias("key"))
        return keys.join(doomed.cited(keys.select("key")), "key", "left_semi").select(i)

    by_segment = lambda rows, c, i: doomed.of_segments(rows, c).select(i)
    facts, commitments, mentions = after["facts"], after["commitments"], after["mentions"]
    projections = [after[f"{kind}s"].select(F.lit(kind).alias("projection_kind"), F.col(f"{kind}_id").alias("projection_id")) for kind in KINDS]
    deps = after["deps"].select("projection_kind", "projection_id", "source", "source_id")
    orphans = deps.where(F.col("projection_kind").isin(*KINDS)).join(projections[0].unionByName(projections[1]), ["projection_kind", "projection_id"], "left_anti")
    found = {
        "events": after["events"].join(doomed.threads, "thread_key", "left_semi").select(F.lit(1).alias("x")),
        "segments": after["segments"].join(doomed.threads, "thread_key", "left_semi").select("segment_id").unionByName(cites(after["segments"], "segment_id")),
        "facts": by_segment(facts, "source_segment_id", "fact_id").unionByName(cites(facts, "fact_id")),
        "commitments": by_segment(commitments, "source_segment_id", "commitment_id").unionByName(by_segment(commitments, "resolution_segment_id", "commitment_id")).unionByName(cites(commitments, "commitment_id")),
        "mentions": mentions.select("segment_id").join(written(after["segments"].select("segment_id"), "segments_left"), "segment_id", "left_anti"),
        "life_events": cites(after["life_events"], "life_event_id"),
        "deps": deps.join(doomed.cited(deps.select("source", "source_id")), ["source", "source_id"], "left_semi").select("projection_id").unionByName(orphans.select("projection_id")),
    }
    out = None
    for name, rows in found.items():
        one = rows.agg(F.count("*").alias("leftovers")).select(F.lit(name).alias("table"), "leftovers")
        out = one if out is None else out.unionByName(one)
    return out
