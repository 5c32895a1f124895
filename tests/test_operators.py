"""Segments, sessions, state changes and checks, against brute force and stated goldens."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators import facts, lifecycle, quality, segments, sessions
from emberlog.sources import policy, readers

T0 = datetime(2026, 3, 1, 9)


def rows_of(minutes, reply=None, text="some words here", thread="t"):
    return [("s", str(k), T0 + timedelta(minutes=m), "me", text, (reply or {}).get(k), thread) for k, m in enumerate(minutes)]


SCHEMA = "source string, source_id string, ts timestamp, actor string, text string, reply_to string, thread_key string"


def sizes(spark, rows, **kw):
    out = segments.segment_threads(spark.createDataFrame(rows, SCHEMA), **kw).groupBy("thread_key", "segment").count().orderBy("thread_key", "segment").collect()
    return [r["count"] for r in out]


@pytest.mark.parametrize("cap, n", [(30, 2), (15, 3)])
def test_cap(spark, cap, n):
    assert len(sizes(spark, rows_of(range(40)), max_events=cap, max_tokens=10**6)) == n


def test_reply_keeps_a_segment_open(spark):
    assert sizes(spark, rows_of([0, 1, 2, 92, 93, 94], {3: "0"})) == [6]
    assert sizes(spark, rows_of([0, 1, 2, 92, 93, 94])) == [3, 3]


def test_islands_equal_one_sweep(spark):
    r = random.Random(1)
    rows, want = [], {}
    for t in range(12):
        at, minutes, reply = 0.0, [], {}
        for k in range(r.randint(1, 60)):
            at += r.choice([0.5, 3, 20, 40, 90, 130, 500])
            minutes.append(at)
            if k and r.random() < 0.3:
                reply[k] = str(r.randrange(k))
        own = rows_of(minutes, reply, "words " * r.randint(1, 12), f"t{t}")
        rows += own
        plain = [(m * 60, len(f"me: {x[4]}"), int(x[5]) if x[5] else -1, k) for k, (m, x) in enumerate(zip(minutes, own, strict=True))]
        parts = segments.cut(plain, 1800)
        n = max(parts) + 1
        of = lambda f, p: f(plain[k][0] for k in range(len(plain)) if parts[k] == p)
        final = segments.merge_runts([parts.count(p) for p in range(n)], [of(min, p) for p in range(n)], [of(max, p) for p in range(n)])
        want[f"t{t}"] = [final[p] for p in parts]
    got = {}
    for x in segments.segment_threads(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(x["thread_key"], {})[int(x["source_id"])] = x["segment"]
    # source ids are strings: rows of one instant do not occur here, so the order is by time.
    assert {t: [v[k] for k in range(len(v))] for t, v in got.items()} == want


def test_fitted_gaps(spark):
    r = random.Random(2)
    rows, at = [], 0.0
    for _ in range(300):
        for _ in range(r.randint(2, 25)):
            at += r.uniform(5, 180)
            rows.append(("two peaks", at))
        at += r.choice([1, 2, 8, 24]) * 3600
    rows += [("one gap", 700.0 * k) for k in range(200)] + [("few", float(k)) for k in range(5)] + [("same instant", 5.0)] * 150 + [(None, 40.0 * k * k) for k in range(150)]
    table = spark.createDataFrame(rows, "thread string, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = {x["thread"]: x for x in segments.fit_gaps(table, "thread", "ts").collect()}
    assert got["two peaks"]["method"] == "valley" and 600 <= got["two peaks"]["gap_seconds"] < 3600
    assert tuple(got["one gap"])[1:] == (700, "p90", 199)
    assert tuple(got["few"])[1:] == (1800, "default", 5) and tuple(got["same instant"])[1:] == (1800, "default", 0)
    assert segments.fit_gaps(table.where("false"), "thread", "ts").count() == 0


def test_voice_and_images_count_for_the_cap(spark):
    rows = [("s", str(k), T0 + timedelta(minutes=k), "me", None, "w" * 300 if k % 2 else None, "i" * 300 if not k % 2 else None, None, "t") for k in range(8)]
    table = spark.createDataFrame(rows, "source string, source_id string, ts timestamp, actor string, text string, transcript string, ocr_text string, reply_to string, thread_key string")
    got = {x["source_id"]: x["segment"] for x in segments.segment_threads(table).collect()}
    assert [got[str(k)] for k in range(8)] == [0, 0, 0, 1, 1, 1, 1, 1]  # the last two are too few to stand alone


def test_long_threads_cross_batches(spark):
    """More rows of one thread than an Arrow batch holds, against one sweep."""
    r = random.Random(7)
    at, minutes, reply = 0.0, [], {}
    for k in range(1200):
        at += r.choice([0.5, 3, 20, 40, 130])
        minutes.append(at)
        if k and r.random() < 0.3:
            reply[k] = f"{r.randrange(max(0, k - 20), k):05}"
    rows = [("s", f"{k:05}", T0 + timedelta(minutes=m), "me", "some words here", reply.get(k), "t") for k, m in enumerate(minutes)]
    parts = segments.cut([(m * 60, len("me: some words here"), int(reply[k]) if k in reply else -1, k) for k, m in enumerate(minutes)], 1800)
    n = max(parts) + 1
    of = lambda f, p: f(minutes[k] * 60 for k in range(len(minutes)) if parts[k] == p)
    final = segments.merge_runts([parts.count(p) for p in range(n)], [of(min, p) for p in range(n)], [of(max, p) for p in range(n)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {x["source_id"]: x["segment"] for x in segments.segment_threads(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[f"{k:05}"] for k in range(1200)] == [final[p] for p in parts]


def test_cluster_stays_by_brute_force(spark):
    r = random.Random(3)
    pts = [("u", k, T0 + timedelta(minutes=k), 50 + r.choice([0, 0.0004, 0.0009, 0.3]) + r.random() * 1e-4, 30.0) for k in range(60)]
    got = {x["id"]: x["cluster"] for x in sessions.dbscan(spark.createDataFrame(pts, "u string, id long, ts timestamp, lat double, lon double"), "u").collect()}
    near = {a[1]: [b[1] for b in pts if abs(a[3] - b[3]) <= 0.0015] for a in pts}
    core = {i for i, n in near.items() if len(n) >= 3}
    assert all((got[i] is None) == (not (core & set(near[i]))) for i in near)
    assert all(got[i] == got[j] for i in core for j in near[i] if j in core)


STATE = "source string, source_id string, ts timestamp, text string, payload string, watermark_ts timestamp"


def test_upsert_is_guarded_and_idempotent(spark):
    row = lambda i, text: ("s", i, T0, text, "{}", T0)
    state = spark.createDataFrame([row("1", "a"), row("2", "b")], STATE)
    new = spark.createDataFrame([row("1", "A"), row("2", ""), row("3", "c")], STATE)
    once = lifecycle.upsert_events(state, new)
    assert {(r["source_id"], r["text"], r["change"]) for r in once.collect()} == {("1", "A", "updated"), ("2", "b", "kept"), ("3", "c", "new")}
    again = lifecycle.upsert_events(once.drop("change"), new)
    assert {r["change"] for r in again.collect()} == {"kept"}


def test_conflicts_never_end_before_they_begin(spark):
    f = spark.createDataFrame([(1, 1, "lives_in", 1, T0 + timedelta(days=9)), (2, 1, "lives_in", 2, T0), (3, 1, "likes", 1, T0), (4, 1, "likes", 2, T0)], "fact_id long, subject_id long, predicate string, version long, t_valid timestamp").withColumns({"t_invalid": F.lit(None).cast("timestamp"), "t_expired": F.lit(None).cast("timestamp")})
    p = spark.createDataFrame([("lives_in", True), ("likes", False)], "predicate string, single_valued boolean")
    got = {r["fact_id"]: r["t_invalid"] for r in facts.resolve_conflicts(f, p).collect()}
    assert got == {1: T0 + timedelta(days=9), 2: None, 3: None, 4: None}


@pytest.mark.parametrize("days, silent, status", [(range(20), 3, "ok"), (range(20), 4, "silent"), (range(0, 200, 10), 15, "ok"), (range(0, 200, 10), 30, "silent"), (range(20), 400, "dormant"), (range(3), 1, "unknown")])
def test_freshness(spark, days, silent, status):
    rows = [("k", T0 + timedelta(days=d)) for d in days]
    now = T0 + timedelta(days=max(days) + silent)
    assert quality.freshness(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", F.lit(now)).first()["status"] == status


def test_jsonl_skips_what_is_broken(spark, tmp_path):
    (tmp_path / "a.rec").write_text('2026\t*\t{"a": 1}\n\nnot json\n{"a": 2}\n{"a": \n')
    assert sorted(r["a"] for r in readers.read_jsonl(spark, str(tmp_path), "a int", "*.rec").collect()) == [1, 2]


def test_sqlite(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t(id INT, name TEXT)")
        db.executemany("INSERT INTO t VALUES(?, ?)", [(k, f"n{k}") for k in range(100)])
    assert readers.read_sqlite(spark, path, "id long, name string", table="t").agg(F.sum("id"), F.count("*")).first() == (4950, 100)
    assert readers.read_sqlite(spark, path, "id long", query="SELECT id FROM t WHERE id > 97").count() == 2


def test_registry_and_isolation():
    import emberlog.sources.adapters  # noqa: F401

    assert set(readers.REGISTRY) <= {p[0] for p in policy.POLICIES}
    with pytest.raises(ValueError):
        readers.register("telegram")(lambda: None)
    out = readers.ingest_all(["a", "b"], lambda n: 1 if n == "a" else 1 // 0)
    assert out["a"] == {"ok": True, "events": 1} and not out["b"]["ok"]
    assert readers.parse_dsn("mysql://u:p%40ss@h:3306/db") == {"host": "h", "port": 3306, "user": "u", "password": "p@ss", "database": "db"}


GOOD = [
    "WITH x AS (SELECT * FROM five) SELECT count(*) AS n FROM x", "with a as (select 1 as x), b as (select * from a) select * from b", "select * from five f join (select id from five) g on f.id = g.id where f.id in (select id from five)",
    "select (select max(id) from five) as m", "with x as (with y as (select * from five) select * from y) select * from x", "select * from five lateral view explode(array(1)) t as z", "select sum(id) over (order by id) as s from FIVE", "select 1 as one", "select * from range(3)", "select * from values (1), (2) t(a)",
]
BAD = [
    "DROP VIEW five", "CREATE TABLE z AS SELECT 1", "SET a=b", "INSERT INTO five SELECT 1", "explain select 1", "show tables", "garbage in",
    # a name that only the expression itself has, outside its scope or one level down
    "with secret as (select * from secret) select * from secret", "with x as (with secret as (select * from secret) select * from secret) select * from x", "with five as (select * from secret) select * from five", "with a as (select * from b), b as (select 1) select * from a", "select * from (with secret as (select 1) select * from secret) join secret",
    # tables in subqueries, of any kind
    "select * from (select * from secret)", "select * from five where id in (select id from secret)", "select (select max(id) from secret)", "select exists(select 1 from secret)", "select * from five, lateral (select * from secret)", "select * from five union all select * from secret", "from secret |> select *",
    # other ways to a table or out of the tables
    "SELECT * FROM parquet.`/tmp`", "select * from identifier('secret')", "select * from spark_catalog.default.five", "select * from read_files('/tmp')",
    "SELECT reflect('java.lang.System', 'exit', 1)", "select `reflect`/**/('java.lang.System', 'exit', 1)", "select identifier('reflect')('a')", "select * from five where java_method('a', 'b') = 1 order by reflect('a', 'b')",
]


def test_tally_reads_only(spark):
    from emberlog.api import NotAQuery, tally

    spark.range(5).createOrReplaceTempView("five")
    spark.range(5).createOrReplaceTempView("secret")
    assert tally(spark, GOOD[0], ["five"])[1] == [{"n": "5"}]
    for sql in GOOD:
        assert tally(spark, sql, ["five"])[1]
    assert tally(spark, "select id, id from five where id = 1", ["five"])[1] == [{"id": "1", "id_2": "1"}]
    for sql in BAD:
        with pytest.raises(NotAQuery):
            tally(spark, sql, ["five"])


def test_span_of_a_question_is_that_of_the_driver(spark):
    from emberlog.functions import text as T

    questions = ["what happened in 2024", "in January 2020", "взимку 2021", "в травні 2019", "лето 2022", "autumn 1995", "2019 or 2020", "no year", "2024 and 2024 fall", "МАРТ 2023", "May 1979", ""]
    got = spark.createDataFrame([(q,) for q in questions], "q string").select("q", T.question_span(F.col("q")).alias("s")).collect()
    for r in got:
        want = T.question_window(r["q"])
        assert (None if r["s"] is None else (r["s"]["date_from"], r["s"]["date_to"])) == (None if want is None else tuple(x.replace(tzinfo=None) for x in want)), r["q"]


def test_sample_of_a_quiet_source_is_its_past(spark):
    rows = spark.createDataFrame([("a", k, T0 + timedelta(days=k)) for k in range(50)] + [("b", k, T0 - timedelta(days=k)) for k in range(40)] + [("c", 1, None)], "source string, source_id long, ts timestamp")
    got = quality.doctor_sample(rows, "source", ["ts", "source_id"], F.lit(T0 + timedelta(days=30)))
    assert {(r["source"], r["dormant"]): r["n"] for r in got.groupBy("source", "dormant").agg(F.count("*").alias("n")).collect()} == {("a", False): 20, ("b", True): 25, ("c", True): 1}


def test_closed_sessions_stream(spark, tmp_path):
    from emberlog.streaming.ingest import closed_sessions

    src, rows = str(tmp_path / "in"), [("a", T0), ("a", T0 + timedelta(minutes=10)), ("a", T0 + timedelta(hours=2)), ("a", T0 + timedelta(hours=9))]
    spark.createDataFrame(rows, "k string, ts timestamp").write.parquet(src)
    out = closed_sessions(spark.readStream.schema("k string, ts timestamp").parquet(src), ["k"], 900)
    q = out.writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["started_at"], r["n"]) for r in spark.table("closed").collect()} >= {(T0, 2)}
