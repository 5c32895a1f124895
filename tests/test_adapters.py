"""One golden for each source: what is read, between which bounds, and what the events say."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators import sessions
from emberlog.sources import adapters as A
from emberlog.sources import policy

T0 = datetime(2022, 5, 6, 7)
at = lambda minutes: T0 + timedelta(minutes=minutes)
text = lambda minutes: at(minutes).strftime("%Y-%m-%d %H:%M:%S")
epoch = lambda minutes: int((at(minutes) - datetime(1970, 1, 1)).total_seconds())
lit = lambda minutes: F.lit(at(minutes))


def got(df):
    return {r["source_id"]: r for r in df.collect()}


def test_telegram(spark):
    m = spark.createDataFrame([(1, k, text(k), body, out, "Ann", "Chat", None, reply, text(k + 30)) for k, body, out, reply in [(1, "a", 0, None), (2, None, 1, 1), (3, "c", 0, 0), (60, "d", 0, None)]] + [(9, 1, text(1), "bot", 0, "B", "Bot", None, None, text(31)), (8, 1, text(1), "lost chat", 0, "C", "x", None, None, text(31)), (1, 99, "no date", "x", 0, "A", "c", None, None, text(31))], "chat_id long, id long, date string, text string, is_outgoing int, sender_name string, chat_title string, media_type string, reply_to_id long, synced_at string")
    chats = spark.createDataFrame([(1, "user"), (9, "user")], "chat_id long, type string")
    out = spark.createDataFrame([(9,), (9,)], "chat_id long")
    x = got(A.telegram(m, chats, out))
    assert set(x) == {"1:1", "1:2", "1:3", "1:60", "8:1"}
    assert (x["1:2"]["actor"], x["1:2"]["text"], x["1:2"]["reply_to"], x["1:2"]["ts"], x["1:2"]["watermark_ts"]) == ("me", "", "1:1", at(2), at(32))
    assert x["1:1"]["actor"] == "Ann" and x["1:3"]["reply_to"] is None and json.loads(x["1:1"]["payload"])["direction"] == "received"
    assert set(got(A.telegram(m, chats, out, lit(43), lit(40)))) == set() and set(got(A.telegram(m, chats, out, lit(42), lit(33)))) == {"1:3"}
    assert set(got(A.telegram(m, chats, out, personal_only=True))) == {"1:1", "1:2", "1:3", "1:60"}


@pytest.mark.parametrize("form", ["text", "millis"])
def test_wakapi(spark, form):
    beats = [("p", 0, "go", "f1"), ("q", 5, None, "g"), ("p", 14, "py", "f2"), ("p", 29, "", "f1"), ("p", 45, "go", None)]
    rows = spark.createDataFrame([(p, text(m) + "+00:00" if form == "text" else epoch(m) * 1000, lang, f, "me") for p, m, lang, f in beats], f"project string, time {'string' if form == 'text' else 'long'}, language string, entity string, user_id string")
    x = got(A.wakapi(rows, user="me"))
    assert set(x) == {"p:2022-05-06T07:00:00+00:00", "q:2022-05-06T07:05:00+00:00", "p:2022-05-06T07:45:00+00:00"}
    one = x["p:2022-05-06T07:00:00+00:00"]
    assert (one["text"], one["watermark_ts"], one["thread_key"]) == ("coded on p for 29 min (go, py)", at(29), "wakapi:p") and json.loads(one["payload"])["files_touched"] == 2
    assert x["q:2022-05-06T07:05:00+00:00"]["text"] == "coded on q for 1 min ()"
    assert [r["ts"] for r in A.wakapi(rows, lit(5), lit(29), "me").collect()] == [at(14)] and A.wakapi(rows, user="other").count() == 0


def test_owntracks(spark):
    rows = spark.createDataFrame([("location", epoch(m), 10.0 + d, 20.0) for m, d in [(0, 0), (10, 0.001), (21, 0.002), (30, 0.5), (40, 0.5)]] + [("lwt", epoch(50), 1.0, 1.0), ("location", None, 1.0, 1.0)], "_type string, tst long, lat double, lon double")
    x = A.owntracks(rows).collect()
    assert [(r["source_id"], r["text"], r["watermark_ts"]) for r in x] == [("stay:2022-05-06T07:00:00+00:00", "stayed at 10.0010,20.0000 for 21 min", at(21))]
    assert A.owntracks(rows, lit(0)).count() == 0 and A.owntracks(rows, until=lit(20)).count() == 0


def test_firefly(spark):
    j = spark.createDataFrame([(1, at(0), "rent", "Withdrawal", 5, None), (2, at(9), "gone", "Deposit", None, at(9)), (3, at(10), "coffee", "Withdrawal", None, None)], "journal_id long, date timestamp, description string, type string, category_id long, deleted_at timestamp")
    legs = spark.createDataFrame([(1, 1, 1, "55.000000000000", None), (2, 1, 2, "-55.000000000000", None), (3, 3, 1, "0.500000000000", None), (4, 3, 2, "-0.5", None), (5, 3, 1, "7", at(11)), (6, 2, 1, "3", None)], "leg_id long, journal_id long, account_id long, amount string, deleted_at timestamp").withColumns({"amount": F.col("amount").cast("decimal(32,12)"), "currency": F.when(F.col("leg_id") < 3, "UAH")})
    accounts = spark.createDataFrame([(1, "shop"), (2, "card")], "account_id long, name string")
    cats = spark.createDataFrame([(5, "home")], "category_id long, category string")
    x = got(A.firefly(j, legs, accounts, cats))
    assert {k: (r["text"], r["thread_key"]) for k, r in x.items()} == {"1": ("Withdrawal: rent — 55 UAH", "firefly:home"), "3": ("Withdrawal: coffee — 0.5", "firefly:uncategorized")}
    assert json.loads(x["1"]["payload"]) == {"amount": 55.0, "currency": "UAH", "from": "card", "to": "shop", "category": "home", "type": "Withdrawal"}
    assert set(got(A.firefly(j, legs, accounts, cats, lit(0), lit(10)))) == {"3"}


def test_immich(spark):
    hours = [0, 2.5, 5, 16.9, 17.5, 20.4, 41, 60]  # from 07:00: sets that cross midnight
    a = spark.createDataFrame([(f"a{k:02}", at(h * 60), "timeline", None, "me", "IMAGE") for k, h in enumerate(hours)] + [("h", at(1), "hidden", None, "me", "VIDEO"), ("d", at(1), "timeline", at(2), "me", "IMAGE"), ("n", None, "timeline", None, "me", "IMAGE")], "asset_id string, created_at timestamp, visibility string, deleted_at timestamp, owner_id string, type string")
    e = spark.createDataFrame([("a00", None, "Lviv", "Ukraine", None, None), ("a01", None, "Kyiv", "Ukraine", 50.4, 30.5), ("a07", at(41 * 60 + 5), None, None, None, None)], "asset_id string, taken_at timestamp, city string, country string, lat double, lon double")
    x = A.immich(a, e).orderBy("ts").collect()
    assert [(r["ts"], r["watermark_ts"], json.loads(r["payload"])["count"]) for r in x] == [(at(0), at(300), 3), (at(16.9 * 60), at(20.4 * 60), 3), (at(41 * 60), at(41 * 60 + 5), 2)]
    assert x[0]["text"] == "took 3 photos at Kyiv, Lviv, Ukraine" and x[1]["text"] == "took 3 photos at unknown place"
    assert json.loads(x[0]["payload"])["lat"] == 50.4 and json.loads(x[0]["payload"])["asset_ids"] == ["a00", "a01", "a02"] and x[0]["source_id"] == "photoset:2022-05-06T07:00:00+00:00"
    assert [r["ts"] for r in A.immich(a, e, lit(0), lit(150)).collect()] == [at(150)]
    assert A.immich(a, e, owner="you").count() == 0 and A.immich(a.where("false"), e).count() == 0


def test_timeline_sessions_equal_one_sweep(spark):
    import random

    r = random.Random(4)
    stamps, t = [], 0.0
    for _ in range(300):
        t += r.choice([1, 30, 170, 181, 400, 3000])
        stamps.append(t)
    want, start, last = [], None, None
    for s in stamps:
        start = s if last is None or s - last > 180 else start
        want.append((at(s), at(start)))
        last = s
    rows = spark.createDataFrame([(at(s),) for s in stamps], "ts timestamp")
    assert sorted((x["ts"], x["session_start"]) for x in sessions.timeline_sessions(rows, "ts", 180 * 60).collect()) == want


def test_nytka(spark):
    u = spark.createDataFrame([(1, "c1", at(0), " hi ", True, "s0", 1), (2, "c1", at(1), "yo", False, "s1", 2), (3, "c1", at(2), "  ", False, "s1", 2), (4, "c2", at(3), "open", True, None, None), (5, "c3", at(4), "left out", True, None, None), (6, "c1", at(90), "muted", False, "s9", None)], "segment_id long, conversation string, started_at timestamp, text string, is_user boolean, speaker string, speaker_id long")
    c = spark.createDataFrame([("c1", True, at(30), "pin"), ("c2", False, at(30), "pin"), ("c3", True, at(30), "pin")], "conversation string, closed boolean, updated_at timestamp, origin string")
    v = spark.createDataFrame([(2, "Ann")], "speaker_id long, person string")
    gone = spark.createDataFrame([("c3",)], "conversation string")
    from emberlog.functions.times import parse_mute_windows

    mute = parse_mute_windows('[{"days": [5], "start": "08:20", "end": "09:00"}]')
    x = got(A.nytka(u, c, v, gone, mute))
    assert {k: (r["text"], r["actor"], r["watermark_ts"]) for k, r in x.items()} == {"1": ("hi", "me", at(30)), "2": ("yo", "Ann", at(30))}
    assert set(got(A.nytka(u, c, v, gone, None, since=lit(40), until=lit(30)))) == {"1", "2", "6"} and A.nytka(u, c, v, gone, since=lit(41)).count() == 0
    events = A.nytka(u, c, v, gone).unionByName(A.nytka(u.withColumn("conversation", F.lit("c7")).withColumn("segment_id", F.col("segment_id") + 100), c.where("conversation = 'c1'").withColumn("conversation", F.lit("c7")), v, gone))
    merged = u.where("segment_id = 2").withColumn("conversation", F.lit("c8"))
    assert {r[0] for r in A.deleted_upstream(events, c.where("false"), merged).collect()} == {"nytka:c7"}
    assert A.deleted_upstream(events, c.unionByName(c.limit(1).withColumn("conversation", F.lit("c7"))), merged).count() == 0


def test_karakeep(spark):
    b = spark.createDataFrame([("l", epoch(0), None, "my note"), ("t", epoch(1), "own", None), ("e", epoch(2), "", ""), ("x", None, "no date", None)], "id string, createdAt long, title string, note string")
    links = spark.createDataFrame([("l", "http://l", "page", "about"), ("e", "http://e", None, None)], "id string, url string, title string, description string")
    texts = spark.createDataFrame([("t", "body", "http://t")], "id string, text string, sourceUrl string")
    x = got(A.karakeep(b, links, texts))
    assert {k: r["text"] for k, r in x.items()} == {"l": "page\nabout\nmy note", "t": "own\nbody", "e": "http://e"} and json.loads(x["l"]["payload"])["has_note"]
    assert set(got(A.karakeep(b, links, texts, lit(0), lit(1)))) == {"t"}


def test_paperless(spark):
    d = spark.createDataFrame([(1, T0.date(), "bill", "x" * 5000, "Ann", "invoice"), (2, T0.date() + timedelta(days=1), None, None, None, None)], "id long, created date, title string, content string, correspondent string, doctype string")
    x = got(A.paperless(d))
    assert x["1"]["text"] == "bill\n" + "x" * 4000 and json.loads(x["1"]["payload"])["truncated"] and x["2"]["text"] == "document\n" and x["1"]["ts"] == datetime(2022, 5, 6)
    assert set(got(A.paperless(d, F.lit(datetime(2022, 5, 6)), F.lit(datetime(2022, 5, 7))))) == {"2"}


def test_forgejo(spark):
    push = json.dumps({"Commits": [{"Sha1": "1", "Message": " fix a\n"}, {"Sha1": "2", "Message": ""}, {"Message": "add b"}]})
    cases = [(5, push), (5, "{}"), (24, None), (6, ""), (10, "a comment"), (10, "{broken"), (9, '["x"]')]
    rows = spark.createDataFrame([(k, epoch(k), op, c, "r", "me@x", False) for k, (op, c) in enumerate(cases)] + [(98, epoch(0), 1, None, "r", "me@x", True), (99, epoch(50), 1, None, "r", "you@x", False)], "id long, created_unix long, op_type int, content string, repo string, email string, is_deleted boolean")
    x = got(A.forgejo(rows, author="me@x"))
    assert [x[str(k)]["text"] for k in range(7)] == ["[r] fix a; add b", "[r] pushed", "[r] published release", "[r] action 6", "[r] a comment", "[r] {broken", '[r] ["x"]']
    assert set(x) == set(map(str, range(7))) and x["0"]["kind"] == "repo_activity" and x["0"]["actor"] == "me@x"
    assert set(got(A.forgejo(rows, lit(2), lit(4)))) == {"3", "4"}


def test_miniflux(spark):
    e = spark.createDataFrame([(1, at(0), "t1", "u", "f", "read", False), (2, at(1), "t2", "u", "f", "unread", True), (3, at(2), "t3", "u", "f", "unread", False)], "id long, published_at timestamp, title string, url string, feed string, status string, starred boolean")
    assert {k: r["text"] for k, r in got(A.miniflux(e)).items()} == {"1": "t1 (f)", "2": "t2 (f)"} and set(got(A.miniflux(e, lit(0)))) == {"2"} and set(got(A.miniflux(e, until=lit(0)))) == {"1"}


def test_lastfm(spark):
    rows = [(epoch(m), a, "n", w) for m, a, w in [(0, "x", 1), (10, "y", 1), (40, "x", 1), (71, "z", 1), (80, "z", 1), (90, None, 2), (91, None, 2), (92, "", 2)]] + [(None, "live", "n", 1)]
    t = spark.createDataFrame(rows, "uts long, artist string, name string, window int")
    x = got(A.lastfm(t))
    assert {k: (r["text"], r["watermark_ts"]) for k, r in x.items()} == {"listen:2022-05-06T07:00:00+00:00": ("listened to 3 tracks, mostly x", at(40)), "listen:2022-05-06T08:30:00+00:00": ("listened to 3 tracks, mostly unknown", at(92))}
    assert json.loads(x["listen:2022-05-06T07:00:00+00:00"]["payload"]) == {"tracks": 3, "top_artist": "x", "artists": ["x", "y"], "ended_at": "2022-05-06T07:40:00+00:00", "hour": 7}
    assert A.lastfm(t, lit(0), lit(80)).count() == 0


PROJECTED = [
    (A.calendar, "id string, start timestamp, summary string, description string, calendar string, attendees array<string>, location string, end timestamp, recurring_event_id string", ("7", at(1), "stand-up", None, None, None, "room", at(2), None), ("stand-up", "calendar:primary", "me", "calendar_event", None)),
    (A.gmail, "id string, date timestamp, subject string, body string, thread_id string, from string, in_reply_to string, to array<string>, labels array<string>", ("7", at(1), "hello", "b" * 4000, None, "ann", "6", None, None), ("hello\n" + "b" * 3000, "gmail:7", "ann", "email", "6")),
    (A.github, "id string, ts timestamp, repo string, title string, message string, type string, actor string, url string", ("7", at(1), "r", None, "msg", "push", "ann", None), ("[r] msg", "github:r", "ann", "push", None)),
    (A.jira, "key string, updated timestamp, summary string, description string, project string, assignee string, status string, resolution string", ("K-1", at(1), "s", None, "K", "ann", "open", None), ("K-1: s\n", "jira:K", "ann", "ticket", None)),
    (A.slack, "channel string, ts string, datetime timestamp, text string, user string, thread_ts string, channel_name string", ("c", "1.5", at(1), "t", "ann", "1.0", "n"), ("t", "slack:c", "ann", "message", "c:1.0")),
    (A.notion, "id string, created_time timestamp, title string, content string, parent_id string, url string, last_edited_time timestamp", ("7", at(1), "t", "c" * 5000, None, None, None), ("t\n" + "c" * 4000, "notion:root", "me", "note", None)),
    (A.linkedin, "id string, posted_at timestamp, text string, impressions long, reactions long, comments long, url string", ("7", at(1), None, 1, 2, 3, None), ("", "linkedin:posts", "me", "post", None)),
]


@pytest.mark.parametrize("adapter, schema, row, want", PROJECTED)
def test_projected_sources(spark, adapter, schema, row, want):
    rows = spark.createDataFrame([row], schema)
    x = adapter(rows).first()
    assert (x["text"], x["thread_key"], x["actor"], x["kind"], x["reply_to"], x["ts"]) == (*want, at(1))
    assert adapter(rows, lit(1)).count() == 0 and adapter(rows, lit(0), lit(1)).count() == 1 and adapter(rows, until=lit(0)).count() == 0


def test_dawarich(spark):
    p = spark.createDataFrame([("u", k, at(m), 10.0 + d, 20.0) for k, (m, d) in enumerate([(0, 0), (10, 0.0005), (25, 0.001), (30, 0.9), (40, 0.0), (45, 0.0), (50, 0.0)])] + [("u", 99, at(60), None, 1.0)], "user string, id long, ts timestamp, lat double, lon double")
    x = A.dawarich(p).collect()
    assert [(r["source_id"], r["text"]) for r in x] == [("stay:0", "stayed at 10.0005,20.0000 for 25 min")]
    assert A.dawarich(p, lit(0)).count() == 0


def test_policy(spark):
    assert len(policy.POLICIES) == 19 and {r["source"] for r in policy.enabled(spark).collect()} == {"telegram", "wakapi", "dawarich", "calendar"}
    assert policy.conflicts(["owntracks", "dawarich", "github", "forgejo"]) == [("dawarich", "owntracks")]
    assert {s for s, _, _, bank in policy.POLICIES if bank is None} == {"miniflux", "nytka", "owntracks"}
