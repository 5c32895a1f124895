"""The folder of tables, the command line over it, and the operations' smaller sides."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog import __main__ as cli
from emberlog import schema
from emberlog.api import Archive, page
from emberlog.operators import lifecycle
from emberlog.sources import policy
from emberlog.store import Store

T0 = datetime(2020, 2, 3, 8)


def row(i, minute, text, thread="telegram:1", source="telegram"):
    return (source, i, T0 + timedelta(minutes=minute), "message", "Ann", text, json.dumps({"chat_title": "Chat"}), None, thread, T0 + timedelta(minutes=minute))


def test_stages_of_the_command_line(spark, tmp_path):
    root, first, more = str(tmp_path / "archive"), str(tmp_path / "first"), str(tmp_path / "more")
    spark.createDataFrame([row("1:1", 0, "password: hunter22"), row("1:2", 1, "b"), row("1:3", 2, "c"), row("s:1", 5, "coded", "wakapi:p", "wakapi")], schema.EVENT).write.parquet(first)
    spark.createDataFrame([row("1:2", 1, "edited"), row("1:4", 3, "d")], schema.EVENT).write.parquet(more)
    store = Store(spark, root)
    assert cli.main(["all", "--root", root, "--input", first], spark) == 0
    one = {r["thread_key"]: r for r in store.read("segments").collect()}
    assert set(one) == {"telegram:1", "wakapi:p"} and one["telegram:1"]["raw_text"] == "Ann: password: [REDACTED:labelled]\nAnn: b\nAnn: c" and len(one["wakapi:p"]["embedding"]) == 1024
    assert one["telegram:1"]["embed_text"].startswith("[chat: Chat] [with: Ann] [date: 2020-02]")
    cli.main(["ingest", "--root", root, "--input", more], spark)
    cli.main(["segment", "--root", root], spark)
    two = {r["thread_key"]: r for r in store.read("segments").collect()}
    assert two["telegram:1"]["segment_id"] == one["telegram:1"]["segment_id"] and two["telegram:1"]["event_count"] == 4 and two["telegram:1"]["embedding"] is None and two["wakapi:p"]["embedding"] is not None
    assert {r["source"]: r["last_ingested_at"] for r in store.read("sources").collect()} == {"telegram": T0 + timedelta(minutes=3), "wakapi": T0 + timedelta(minutes=5)}
    cli.main(["resegment", "--root", root, "--thread", "telegram:1", "--max-messages", "1"], spark)
    assert sorted(r["event_count"] for r in store.read("segments").collect()) == [1, 2, 2]
    with pytest.raises(SystemExit):
        cli.main(["resegment", "--root", root], spark)
    with pytest.raises(SystemExit):
        cli.main(["ingest", "--root", root], spark)


def test_rerank_sees_the_pool(spark):
    segs = spark.createDataFrame([(k, T0, "t", f"word{k} " + ("apple" if k < 3 else "pear"), [1.0, float(k)], "x" if k % 2 else None) for k in range(80)], "segment_id long, started_at timestamp, thread_key string, raw_text string, embedding array<float>, enrich_text string").withColumn("sources", F.array(F.lit("s")))
    events = spark.createDataFrame([row("1", 0, "a")], schema.EVENT)
    archive = Archive(spark, segs, events, spark.createDataFrame([], schema.COMMITMENT))
    seen = []

    def rerank(question, texts):
        seen.append(len(texts))
        return [len(texts) - 1, 0, 0, 10_000]

    plain = [r["id"] for r in archive.recall("apple", [1.0, 0.0], 5).collect()]
    deep = [r["id"] for r in archive.recall("apple", [1.0, 0.0], 40).collect()]
    got = [r["id"] for r in archive.recall("apple", [1.0, 0.0], 5, rerank).collect()]
    assert seen == [40] and got == [deep[-1], *[i for i in deep if i != deep[-1]][:4]] and plain == deep[:5]
    table, total = archive.stats(spark.createDataFrame([("telegram",), ("jira",)], "source string"))
    assert {tuple(r) for r in table.collect()} == {("telegram", 1), ("jira", 0)} and tuple(total.first()) == (80, 80, 40) and archive.health()
    quiet = spark.createDataFrame([("telegram", False)], "source string, enabled boolean")
    assert archive.freshness(T0, quiet).count() == 0 and archive.freshness(T0).count() == 1


def test_pages(spark):
    rows = spark.range(10)
    assert [[r["id"] for r in page(rows, ["id"], 4, k).collect()] for k in (0, 4, 8, 12)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], []]


def test_seven_counts(spark):
    d = spark.createDataFrame([("a",), ("a",)], "thread_key string")
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, thread_key string")
    s = spark.createDataFrame([(1, "a", [1.0]), (2, "a", None), (3, "b", [1.0])], "segment_id long, thread_key string, embedding array<float>")
    m = spark.createDataFrame([(7, 1), (8, 3)], "entity_id long, segment_id long")
    f = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "fact_id long, source_segment_id long")
    c = spark.createDataFrame([(1, 3, 1), (2, 1, None)], "commitment_id long, source_segment_id long, resolution_segment_id long")
    got = dict(lifecycle.purge_counts(d, e, s, m, f, c).collect())
    assert got == {"events": 2, "segments": 2, "embedded": 1, "entity_mentions": 1, "facts": 2, "commitments": 1, "commitments_resolved_by": 1}


def test_configured():
    assert policy.configured("wakapi", {"dsn": " x ", "user": "u", "other": None}) == {"dsn": "x", "user": "u"}
    assert policy.configured("wakapi", {"dsn": "x", "user": " "}) is None and policy.configured("calendar", {"dsn": "x"}) is None
    assert set(policy.SETTINGS) <= {p[0] for p in policy.POLICIES}


def test_infrastructure_is_no_source():
    from emberlog.sources import readers

    assert policy.admitted(["telegram", "jira"]) == ["telegram", "jira"] and not {*policy.NOT_SOURCES} & {p[0] for p in policy.POLICIES}
    for bad, more in ((["grafana"], []), (["qdrant"], []), (["telegram", "jira"], ["jira"])):
        with pytest.raises(policy.NotASource):
            policy.admitted(bad, more)
    with pytest.raises(policy.NotASource):
        readers.register("vaultwarden")(lambda: None)
