"""One commit or nothing: the store, and what an edited event, a stream, a model and a new cut do to the tables."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog import __main__ as cli
from emberlog import schema
from emberlog.store import Change, Conflict, Store
from emberlog.streaming.ingest import archive_stream

T0 = datetime(2020, 2, 3, 8)


def row(i, minute, text, thread="telegram:1", year=2020):
    at = T0.replace(year=year) + timedelta(minutes=minute)
    return ("telegram", i, at, "message", "Ann", text, json.dumps({"chat_title": "Chat"}), None, thread, at)


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_a_change_that_fails_leaves_the_state(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "a"))
    store.write("t", spark.range(3))
    store.write("u", spark.range(1))
    change = store.change()
    change.write("t", spark.range(9))
    change.write("u", spark.range(9))
    real = store.files()

    class Files:
        """Fails on the way to the new state."""

        def __getattr__(self, name):
            return getattr(real, name)

        def rename(self, a, b):
            raise OSError("lost")

    monkeypatch.setattr(Store, "files", lambda self: Files())
    with pytest.raises(OSError):
        change.commit()
    monkeypatch.undo()
    assert ids(store.read("t")) == [0, 1, 2] and ids(store.read("u")) == [0]
    change.commit()
    assert ids(store.read("t")) == list(range(9)) == ids(store.read("u")) and ids(store.read("t", version=1)) == [0, 1, 2]


def test_the_second_of_two_changes_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    one, two = store.change(), store.change()
    one.write("t", spark.range(1))
    two.write("t", spark.range(2))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert ids(store.read("t")) == [0] and not store.has("x") and store.read("x", "id long").count() == 0
    with pytest.raises(FileNotFoundError):
        store.read("x")


def test_only_touched_years_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    rows = spark.createDataFrame([(1, T0), (2, T0.replace(year=2021)), (3, None)], "id long, ts timestamp")
    change = store.change()
    change.write_years("t", rows, "ts", [0, 2020, 2021])
    change.commit()
    before = store.manifest()["tables"]["t"]["folders"]
    change = store.change()
    change.write_years("t", store.read("t", years=[2021]).unionByName(spark.createDataFrame([(4, T0.replace(year=2021))], rows.schema)), "ts", [2021])
    change.commit()
    after = store.manifest()["tables"]["t"]["folders"]
    assert ids(store.read("t")) == [1, 2, 3, 4] and ids(store.read("t", years=[2021])) == [2, 4] and ids(store.read("t", years=[1999])) == []
    assert {y for y in after if after[y] != before[y]} == {"2021"}
    assert store.vacuum(1) == 1 and ids(store.read("t")) == [1, 2, 3, 4] and store.versions() == [2]


@pytest.fixture
def archive(spark, tmp_path):
    root, first = str(tmp_path / "archive"), str(tmp_path / "first")
    rows = [row(f"1:{k}", k, f"word number {k} of a long enough talk") for k in range(6)] + [row("2:1", 0, "b" * 90, "telegram:2", 2021)]
    spark.createDataFrame(rows, schema.EVENT).write.parquet(first)
    cli.main(["all", "--root", root, "--input", first], spark)
    return Store(spark, root), root


def reply(text):
    if "bbb" in text:
        raise OSError("busy")
    return json.dumps({"summary": "talk", "topics": ["x"], "facts": [{"subject": "Ann", "predicate": "likes", "object": "tea", "confidence": 0.9}], "commitments": [{"text": "call", "direction": "i_owe"}]})


def test_an_edited_event_reaches_its_segment(spark, archive, tmp_path):
    store, root = archive
    before = {r["thread_key"]: r for r in store.read("segments").collect()}
    events = store.manifest()["tables"]["events"]["folders"]
    spark.createDataFrame([row("1:2", 2, "edited: password: hunter22"), row("1:9", 400, "new")], schema.EVENT).write.parquet(str(tmp_path / "more"))
    cli.main(["ingest", "--root", root, "--input", str(tmp_path / "more")], spark)
    after = {r["thread_key"]: r for r in store.read("segments").collect()}
    one, two = before["telegram:1"], after["telegram:1"]
    assert two["segment_id"] == one["segment_id"] and two["source_event_ids"] == one["source_event_ids"] and two["embedding"] is None and one["embedding"] is not None
    assert "edited: password: [REDACTED:labelled]" in two["raw_text"] and "number 2" not in two["raw_text"] and two["raw_text"] in two["embed_text"]
    assert after["telegram:2"] == before["telegram:2"] and store.read("events").count() == 8
    now = store.manifest()["tables"]["events"]["folders"]
    assert {y for y in now if now[y] != events.get(y)} == {"2020"}


def test_what_the_model_says_and_a_new_cut(spark, archive, capsys):
    store, root = archive
    assert cli.main(["enrich", "--root", root], spark) == 0 and "skipped" in capsys.readouterr().err
    cli.main(["enrich", "--root", root, "--model", "tests.test_store:reply"], spark)
    assert store.read("facts").count() == 1 and store.read("commitments").count() == 1 and store.read("mentions").count() == 1 and store.read("deps").count() == 12
    texts = {r["thread_key"]: r["enrich_text"] for r in store.read("segments").collect()}
    assert "tea" in texts["telegram:1"] and texts["telegram:2"] is None
    cli.main(["enrich", "--root", root, "--model", "tests.test_store:reply"], spark)  # only the one that failed is asked again
    assert store.read("facts").count() == 1
    cli.main(["resegment", "--root", root, "--thread", "telegram:1", "--max-messages", "2"], spark)
    assert store.read("facts").count() == 0 and store.read("commitments").count() == 0 and store.read("mentions").count() == 0 and store.read("deps").count() == 0
    assert store.read("segments").count() == 3 and store.read("segments").where("enrich_text is not null").count() == 0


def test_a_source_that_fails_does_not_stop_the_others(spark, archive, tmp_path):
    store, root = archive
    (tmp_path / "wakapi.jsonl").mkdir()
    spark.createDataFrame([row("3:1", 1, "later")], schema.EVENT).write.parquet(str(tmp_path / "good"))
    cli.main(["ingest", "--root", root, "--input", f"{tmp_path}/jira.parquet,{tmp_path}/good"], spark)
    got = {r["source"]: r for r in store.read("sources").collect()}
    assert got["jira"]["last_error"].startswith("AnalysisException") and got["telegram"]["last_error"] is None and store.read("events").count() == 8


def test_stream_and_batch_give_the_same_segments(spark, tmp_path):
    rows = [row(f"1:{k}", k * 3, f"text {k} " * 5) for k in range(24)]
    whole, parts = str(tmp_path / "whole"), tmp_path / "parts"
    spark.createDataFrame(rows, schema.EVENT).write.parquet(whole)
    cli.main(["ingest", "--root", str(tmp_path / "a"), "--input", whole], spark)
    cli.main(["segment", "--root", str(tmp_path / "a")], spark)
    store = Store(spark, str(tmp_path / "b"))

    def arrive(some):
        spark.createDataFrame(some, schema.EVENT).coalesce(1).write.mode("append").parquet(str(parts))
        stream = spark.readStream.schema(schema.EVENT).parquet(str(parts))
        archive_stream(stream, store, lambda batch: cli.ingested(store, batch), str(tmp_path / "checkpoint")).awaitTermination(120)
        cli.main(["segment", "--root", str(tmp_path / "b")], spark)

    for k in range(0, 24, 12):
        arrive(rows[k : k + 12])
    fields = lambda s: sorted((r["raw_text"], tuple(r["source_event_ids"])) for r in s.read("segments").collect())
    assert fields(store) == fields(Store(spark, str(tmp_path / "a")))
    number = store.manifest()["notes"]["stream events"]
    arrive([row("1:3", 9, "changed afterwards")])
    assert store.manifest()["notes"]["stream events"] == number + 1
    assert sum("changed afterwards" in t for t, _ in fields(store)) == 1


def test_a_batch_given_again_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "b"))
    made = []

    def change(batch):
        made.append(batch.count())
        c = Change(store)
        c.write("t", batch.select(F.lit(1).alias("id")))
        return c

    spark.createDataFrame([row("1", 0, "a")], schema.EVENT).write.parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):  # a checkpoint that was lost gives batch 0 again
        archive_stream(spark.readStream.schema(schema.EVENT).parquet(str(tmp_path / "in")), store, change, str(tmp_path / checkpoint)).awaitTermination(120)
    assert made == [1] and store.versions() == [1]
