"""Erasure of threads: what goes, what stays, and that the proof sees whatever is left."""

import pytest
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.operators import enrichment, erasure, lifecycle, segments

LIFE = "life_event_id long, source_event_ids array<string>, title string"


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "events": make([("s", str(k), "bad" if k % 2 else "good") for k in range(6)] + [("s", "9", None)], "source string, source_id string, thread_key string"),
        "segments": make([(1, "bad", ["s:1", "s:3", "s:5"], [1.0]), (2, "good", ["s:0", "s:2"], None), (3, None, ["s:9"], None)], "segment_id long, thread_key string, source_event_ids array<string>, embedding array<double>"),
        "facts": make([(1, 1, ["s:1"]), (2, 2, ["s:0"]), (3, 2, ["s:0", "s:3"]), (4, 2, ["s:3"]), (5, None, None)], "fact_id long, source_segment_id long, source_event_ids array<string>"),
        "commitments": make([(1, 1, None, "open", ["s:1"]), (2, 2, 1, "done", ["s:0"]), (3, 2, 2, "done", []), (4, None, None, "open", None)], "commitment_id long, source_segment_id long, resolution_segment_id long, status string, source_event_ids array<string>"),
        "mentions": make([(5, 1), (5, 2), (6, 1)], "entity_id long, segment_id long"),
        "life_events": make([(1, ["s:0", "s:1"], "a"), (2, ["s:3", "s:5"], "b"), (3, [], "c"), (4, None, "d"), (5, ["s:0", "s:0"], "e")], LIFE),
        "deps": make([("fact", 1, "s", "1"), ("fact", 2, "s", "0"), ("fact", 3, "s", "0"), ("fact", 3, "s", "3"), ("commitment", 1, "s", "0"), ("other", 7, "s", "5"), ("other", 7, "s", "0")], schema.DEPENDENCY),
    }


@pytest.fixture(scope="module")
def doomed(spark):
    return spark.createDataFrame([("bad",), ("bad",), (None,)], "thread_key string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_what_goes_and_what_stays(doomed, tables):
    out = erasure.purge(doomed, **tables)
    assert rows(out["events"].select("source_id")) == [("0",), ("2",), ("4",), ("9",)]
    assert rows(out["segments"].select("segment_id")) == [(2,), (3,)]
    assert rows(out["facts"]) == [(2, 2, ["s:0"]), (3, 2, ["s:0"]), (5, None, None)]
    assert rows(out["commitments"]) == [(2, 2, None, "open", ["s:0"]), (3, 2, 2, "done", []), (4, None, None, "open", None)]
    assert rows(out["mentions"]) == [(5, 2)]
    assert rows(out["life_events"]) == [(1, ["s:0"], "a"), (3, [], "c"), (4, None, "d"), (5, ["s:0", "s:0"], "e")]
    assert rows(out["deps"]) == [("fact", 2, "s", "0"), ("fact", 3, "s", "0"), ("other", 7, "s", "0")]
    assert dict(rows(out["audit"])) == {"events_deleted": 3, "segments_deleted": 1, "facts_deleted": 2, "commitments_deleted": 1, "mentions_deleted": 2, "life_events_deleted": 1, "deps_deleted": 4, "commitments_reopened": 1}
    assert all(list(out[k].columns) == tables[k].columns for k in tables)
    assert {r["leftovers"] for r in erasure.proof(doomed, tables, out).collect()} == {0}


@pytest.mark.parametrize("table", ["events", "segments", "facts", "commitments", "mentions", "life_events", "deps"])
def test_the_proof_sees_what_is_left(doomed, tables, table):
    out = erasure.purge(doomed, **tables) | {table: tables[table]}
    left = {r["table"]: r["leftovers"] for r in erasure.proof(doomed, tables, out).collect()}
    assert left[table] > 0


def test_counts_before_are_what_is_taken(doomed, tables):
    """Of rows that depend on segments alone; events and embedded segments too."""
    by_segment = tables | {k: tables[k].withColumn("source_event_ids", F.lit(None).cast("array<string>")) for k in ("facts", "commitments")}
    want = dict(rows(lifecycle.purge_counts(doomed.where("thread_key is not null"), *(by_segment[k] for k in ("events", "segments", "mentions", "facts", "commitments")))))
    out = erasure.purge(doomed, **by_segment)
    audit = dict(rows(out["audit"]))
    taken = {"events": audit["events_deleted"], "segments": audit["segments_deleted"], "embedded": by_segment["segments"].where("embedding is not null").count() - out["segments"].where("embedding is not null").count(), "entity_mentions": audit["mentions_deleted"], "facts": audit["facts_deleted"], "commitments": audit["commitments_deleted"], "commitments_resolved_by": audit["commitments_reopened"]}
    assert want == taken


def test_nothing_to_erase(spark, tables):
    none = spark.createDataFrame([], "thread_key string")
    out = erasure.purge(none, **tables)
    assert all(rows(out[k]) == rows(tables[k]) for k in tables) and {r["n"] for r in out["audit"].collect()} == {0}


def test_it_runs_on_the_tables_that_enrichment_writes(spark):
    import json
    from datetime import datetime

    segs = spark.createDataFrame([(1, "bad", datetime(2020, 1, 1), ["s:1"]), (2, "good", datetime(2020, 1, 2), ["s:2"])], "segment_id long, thread_key string, started_at timestamp, source_event_ids array<string>")
    reply = json.dumps({"summary": "x", "facts": [{"subject": "Ann", "predicate": "likes", "object": "tea", "confidence": 0.9}], "commitments": [{"text": "call", "direction": "i_owe"}]})
    empty = lambda s: spark.createDataFrame([], s)
    out = enrichment.write_enrichment(spark.createDataFrame([(1, reply), (2, reply)], "segment_id long, reply string"), segs, empty(schema.ENTITY), empty(schema.FACT), empty(schema.COMMITMENT), empty(schema.MENTION), empty(schema.DEPENDENCY), ["likes"])
    events = spark.createDataFrame([("s", "1", "bad"), ("s", "2", "good")], "source string, source_id string, thread_key string")
    tables = {k: out[k] for k in ("segments", "facts", "commitments", "mentions", "deps")} | {"events": events, "life_events": empty(schema.LIFE_EVENT)}
    doomed = spark.createDataFrame([("bad",)], "thread_key string")
    after = erasure.purge(doomed, **tables)
    assert {k: v.count() for k, v in after.items() if k != "audit"} == {"events": 1, "segments": 1, "facts": 1, "commitments": 1, "mentions": 1, "life_events": 0, "deps": 2}
    assert {r["leftovers"] for r in erasure.proof(doomed, tables, after).collect()} == {0}


def test_rebuilt_threads_leave_tables_of_the_same_kind(spark):
    assert {"source_segment_id", "source_event_ids"} <= set(spark.createDataFrame([], schema.FACT).columns) & set(spark.createDataFrame([], schema.COMMITMENT).columns)
    assert segments.MAX_EVENTS == 15


def test_large_tables_stay_where_they_are_when_little_is_erased(spark):
    """What is erased is small, but by its plan alone it could be as large as what it is drawn from."""
    many = spark.range(2_000_000)
    events = many.select(F.lit("a").alias("source"), F.col("id").cast("string").alias("source_id"), F.concat(F.lit("t"), F.col("id") % 50).alias("thread_key"))
    segments = events.groupBy("thread_key").agg(F.collect_list(F.concat_ws(":", "source", "source_id")).alias("source_event_ids")).select(F.substring("thread_key", 2, 9).cast("long").alias("segment_id"), "thread_key", "source_event_ids")
    mentions = many.select((F.col("id") % 7).alias("entity_id"), (F.col("id") % 50).alias("segment_id"))
    cites = F.array(F.concat(F.lit("a:"), F.col("id") % 20)).alias("source_event_ids")
    facts = many.limit(200).select(F.col("id").alias("fact_id"), (100 + F.col("id")).alias("source_segment_id"), cites)
    commitments = many.limit(0).select(F.col("id").alias("commitment_id"), F.col("id").alias("source_segment_id"), F.col("id").alias("resolution_segment_id"), F.lit("open").alias("status"), cites)
    life = many.limit(0).select(F.col("id").alias("life_event_id"), cites)
    deps = facts.select(F.lit("fact").alias("projection_kind"), F.col("fact_id").alias("projection_id"), F.lit("a").alias("source"), (F.col("fact_id") % 20).cast("string").alias("source_id"))
    doomed = events.where("thread_key in ('t3', 't4')").select("thread_key")
    tables = {"events": events, "segments": segments, "facts": facts, "commitments": commitments, "mentions": mentions, "life_events": life, "deps": deps}
    after = erasure.purge(doomed, **tables)
    for name in ("mentions", "events"):
        plan = after[name]._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan, plan
    assert after["mentions"].count() == 1_920_000
    assert sorted(r["fact_id"] for r in after["facts"].where("fact_id < 20").collect()) == [k for k in range(20) if k not in (3, 4)]
    assert after["deps"].count() == 180
    assert {r["leftovers"] for r in erasure.proof(doomed, tables, after).collect()} == {0}
