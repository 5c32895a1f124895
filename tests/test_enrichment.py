"""Replies made safe, what is written beside a segment and replaced, the gate, vectors, and threads cut anew."""

import json
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import enrichment as E
from emberlog.operators import search, segments

T0 = datetime(2021, 8, 9, 10)
KNOWN = ["lives_in", "likes"]


def cleaned(spark, reply):
    raw = reply if isinstance(reply, str) or reply is None else json.dumps(reply)
    return spark.createDataFrame([(raw,)], "r string").select(E.clean(F.col("r"), KNOWN, "Kim", ("me", "I")).alias("c")).first()["c"]


def test_clean_bounds_and_types(spark):
    fact = lambda s, p, o, c=0.7: {"subject": s, "predicate": p, "object": o, "confidence": c}
    got = cleaned(spark, {
        "summary": "  a \n b ", "topics": ["  Work ", "work", "", 7, *[f"t{k}" for k in range(9)]], "importance": 7, "sentiment": "-3",
        "facts": ["noise", fact(" ME ", "Lives In", " Rome  now"), fact("Ann", "hates", "x"), fact("", "likes", "x"), fact("Ann", "likes", ""), fact("Bob", "likes", "tea", "much"), *[fact(f"p{k}", "likes", "x") for k in range(9)]],
        "commitments": [{"text": "call", "direction": "i_owe", "due": "2021-09-01", "confidence": 2}, {"text": "x", "direction": "both"}, {"text": " ", "direction": "i_owe"}, 5, {"text": "y" * 400, "direction": "owed_to_me", "due": "soon"}],
    })
    assert got["summary"] == "a b" and got["topics"] == ["work", "7", "t0", "t1", "t2", "t3"] and got["importance"] == 1 and got["sentiment"] == -1
    assert [tuple(f) for f in got["facts"][:2]] == [("Kim", "lives_in", "Rome now", 0.7), ("Bob", "likes", "tea", 0.5)] and len(got["facts"]) == E.MOST_FACTS
    assert [tuple(c) for c in got["commitments"]] == [("call", "i_owe", date(2021, 9, 1), 1.0), ("y" * 300, "owed_to_me", None, 0.5)]


@pytest.mark.parametrize("reply", [None, "", "no json", "[]", "{}", "```json\n{}\n```", '{"topics": null, "facts": null, "summary": null}'])
def test_clean_of_nothing(spark, reply):
    got = cleaned(spark, reply)
    assert got["summary"] is None and not got["topics"] and not got["facts"] and not got["commitments"] and got["importance"] == 0


EMPTY = {
    "entities": "entity_id long, entity_type string, canonical_name string, aliases array<string>, phonetic_keys array<string>, skeleton_keys array<string>, mention_count long, first_seen_at timestamp, last_seen_at timestamp",
    "facts": "fact_id long, subject_id long, predicate string, object string, t_valid timestamp, version long, confidence double, source_segment_id long, source_event_ids array<string>, extractor_version string",
    "commitments": "commitment_id long, text string, direction string, stated_at timestamp, due_at date, confidence double, source_segment_id long, source_event_ids array<string>, extractor_version string, status string, resolution_segment_id long",
    "mentions": "entity_id long, segment_id long, ts timestamp",
    "deps": "projection_kind string, projection_id long, source string, source_id string",
}


def test_a_second_pass_replaces_the_first(spark):
    segs = spark.createDataFrame([(k, T0 + timedelta(days=k), [f"s:{k}:a", f"s:{k}:b"], f"text {k}") for k in range(3)], "segment_id long, started_at timestamp, source_event_ids array<string>, raw_text string")
    state = {k: spark.createDataFrame([], v) for k, v in EMPTY.items()}
    reply = lambda name, thing: json.dumps({"summary": "sum", "topics": ["a"], "facts": [{"subject": name, "predicate": "likes", "object": thing}], "commitments": [{"text": thing, "direction": "i_owe"}]})

    def write(replies, now):
        rows = spark.createDataFrame(replies, "segment_id long, reply string")
        out = E.write_enrichment(rows, now["segments"], **{k: now[k] for k in EMPTY}, predicates=KNOWN)
        return {k: spark.createDataFrame(v.collect(), v.schema) for k, v in out.items()}

    once = write([(0, reply("Игорь", "tea")), (1, reply("Ihor", "rye")), (1, reply("Ihor", "rye"))], {"segments": segs} | state)
    assert once["entities"].count() == 1 and once["entities"].first()["mention_count"] == 2 and once["entities"].first()["canonical_name"] == "Игорь"
    assert sorted(once["entities"].first()["aliases"]) == ["Ihor", "Игорь"] and once["mentions"].count() == 2
    assert {(r["object"], r["version"]) for r in once["facts"].collect()} == {("tea", 1628503200000), ("rye", 1628589600000)}
    assert {(r["projection_kind"], r["source"], r["source_id"]) for r in once["deps"].collect()} == {(k, "s", f"{n}:{x}") for k in ("fact", "commitment") for n in (0, 1) for x in "ab"}
    texts = {r["segment_id"]: r["enrich_text"] for r in once["segments"].collect()}
    assert texts == {0: "sum a Игорь likes tea", 1: "sum a Ihor likes rye", 2: None}
    twice = write([(0, reply("Igor", "milk")), (2, "broken")], once)
    assert {r["object"] for r in twice["facts"].collect()} == {"milk", "rye"} and {r["text"] for r in twice["commitments"].collect()} == {"milk", "rye"}
    assert twice["deps"].count() == 8 and twice["entities"].count() == 1 and twice["entities"].first()["mention_count"] == 3 and twice["mentions"].count() == 2
    assert {r["segment_id"]: r["enrich_text"] for r in twice["segments"].collect()} == {0: "sum a Igor likes milk", 1: "sum a Ihor likes rye", 2: None}


def test_gate(spark):
    rows = spark.createDataFrame([(1, "fact", None, None), (2, "chat", None, None), (3, "boom", None, None), (4, "chat", 0.9, "v1"), (5, "fact", 0.1, "v0")], "segment_id long, raw_text string, gate_p double, gate_version string")

    def score(text):
        if text == "boom":
            raise ValueError
        return 0.8 if text == "fact" else 0.2

    out = E.gate_scores(rows, score, "v1")
    assert {r["segment_id"]: (r["gate_p"], r["gate_version"]) for r in out.collect()} == {1: (0.8, "v1"), 2: (0.2, "v1"), 3: (None, None), 4: (0.9, "v1"), 5: (0.8, "v1")}
    assert {r["segment_id"] for r in E.gated(out, skip=True).collect()} == {1, 3, 4, 5} and E.gated(out).count() == 5
    with pytest.raises(Exception, match="no text could be scored"):
        E.gate_scores(rows.where("segment_id = 3"), score, "v1").collect()


def test_pace_and_patience():
    now, slept, calls = [0.0], [], []
    pace = E.Pace(60, lambda: now[0], slept.append)
    for _ in range(3):
        pace.wait()
    assert slept == [1.0, 2.0]

    def flaky():
        calls.append(1)
        if len(calls) < 2:
            raise E.Transient
        return "ok"

    assert E.patiently(flaky, E.Pace(0)) == "ok" and len(calls) == 2
    with pytest.raises(E.Transient):
        E.patiently(lambda: (_ for _ in ()).throw(E.Transient()), E.Pace(0))


def test_embed_missing(spark):
    rows = spark.createDataFrame([(1, T0, "red apple", None), (2, T0 + timedelta(days=1), "red apples", None), (3, None, None, None), (4, T0, "x", [1.0, 0.0])], "segment_id long, started_at timestamp, embed_text string, embedding array<float>")
    some = {r["segment_id"]: r for r in E.embed_missing(rows, E.hashed_encoder, "h1", most=1).collect()}
    assert some[2]["embedder_version"] == "h1" and some[1]["embedding"] is None and some[4]["embedding"] == [1.0, 0.0]
    full = {r["segment_id"]: r["embedding"] for r in E.embed_missing(rows, E.hashed_encoder, "h1").collect()}
    assert len(full[1]) == 1024 and abs(np.linalg.norm(full[1]) - 1) < 1e-5 and np.dot(full[1], full[2]) > 0.4 and not any(full[3])


ROW = "source string, source_id string, ts timestamp, actor string, text string, reply_to string, thread_key string, density string, chat_title string, transcript string, ocr_text string"


def talk(ids, minutes, thread="t", density="narrative"):
    return [("s", i, T0 + timedelta(minutes=m), "me", "some words " + i, None, thread, density, None, None, None) for i, m in zip(ids, minutes, strict=True)]


def test_new_events_go_on_with_the_open_segment(spark):
    first = talk("abc", [0, 1, 2]) + talk("xyz", [300, 301, 302]) + talk("p", [5], "rolls", "telemetry")
    events = spark.createDataFrame(first, ROW)
    empty = segments.segment_fields(segments.numbered(events.where("false")))
    now = segments.advance_segments(events, empty.limit(0))
    assert sorted((r["thread_key"], r["event_count"], r["replaces"]) for r in now.collect()) == [("rolls", 1, None), ("t", 3, None), ("t", 3, None)]
    kept = spark.createDataFrame(now.drop("replaces").collect(), now.drop("replaces").schema)
    more = spark.createDataFrame(first + talk("w", [303]) + talk("kl", [100, 101]) + talk("q", [9], "rolls", "telemetry"), ROW)
    out = {tuple(r["source_event_ids"]): r for r in segments.advance_segments(more, kept).collect()}
    assert set(out) == {("s:x", "s:y", "s:z", "s:w"), ("s:k", "s:l"), ("s:q",)}
    last = kept.where("array_contains(source_event_ids, 's:x')").first()["segment_id"]
    assert out["s:x", "s:y", "s:z", "s:w"]["replaces"] == last and out["s:k", "s:l"]["replaces"] is None


def test_rebuild_of_named_threads(spark):
    events = spark.createDataFrame(talk([f"{k:02}" for k in range(40)], range(40)) + talk("z", [0], "other"), ROW)
    old = spark.createDataFrame([(1, "t", ["s:00"]), (2, "other", ["s:z"])], "segment_id long, thread_key string, source_event_ids array<string>")
    facts = spark.createDataFrame([(10, 1), (11, 2)], "fact_id long, source_segment_id long")
    owed = spark.createDataFrame([(20, 1, None, "open"), (21, 2, 1, "done"), (22, 2, 2, "done")], "commitment_id long, source_segment_id long, resolution_segment_id long, status string")
    mentions = spark.createDataFrame([(5, 1), (5, 2)], "entity_id long, segment_id long")
    deps = spark.createDataFrame([("fact", 10), ("fact", 20), ("commitment", 20), ("fact", 11)], "projection_kind string, projection_id long")
    out = segments.rebuild_threads(spark.createDataFrame([("t",)], "thread_key string"), events, old, facts, owed, mentions, deps, max_events=8)
    assert sorted(r["event_count"] for r in out["segments"].collect()) == [8] * 5 and [r["segment_id"] for r in out["kept"].collect()] == [2]
    assert [r["fact_id"] for r in out["facts"].collect()] == [11] and [r["segment_id"] for r in out["mentions"].collect()] == [2]
    assert sorted(map(tuple, out["commitments"].collect())) == [(21, 2, None, "open"), (22, 2, 2, "done")]
    assert sorted(map(tuple, out["deps"].collect())) == [("fact", 11), ("fact", 20)]


def test_kept_index_gives_the_same_answers(spark, tmp_path):
    texts = ["Привет мир", "café au lait", "cafe мир", "nothing here"] + [f"filler {k}" for k in range(60)]
    rows = spark.createDataFrame([(k, t, [float(k % 7), 1.0]) for k, t in enumerate(texts)], "segment_id long, raw_text string, embedding array<float>")
    search.keep_index(rows, f"{tmp_path}/small", buckets=4)
    for question in ("мир CAFÉ", "привет?", "unheard of", ""):
        plain, kept = (search.hybrid_search(rows, question, [1.0, 0.0], index=i).collect() for i in (None, f"{tmp_path}/small"))
        assert plain == kept
    assert [r["id"] for r in search.hybrid_search(rows, "МИР café", None).collect()] == [2, 0, 1]
