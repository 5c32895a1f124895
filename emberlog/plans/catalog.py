"""Registered queries on the driver's tables, each with the SQL that gives the same rows.

Stand-ins: events are events (thread: user or type), segments are documents with embeddings and the time of the event
of the same id, facts are orders (subject: customer, predicate: priority, version: day), sources are document sources.
Instants that depend on "now" are literals.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.api import Archive
from emberlog.functions import text as T
from emberlog.functions import stems, times, vectors
from emberlog.operators import density, erasure, facts, lifecycle, nearest, quality, resolve, search, segments, sessions, views
from emberlog.store import scratch_path

Q: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents; a table of few files is dealt out first, as one file's row groups keep few tasks busy with its texts."""
    d, tasks = read(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return d.repartition(tasks) if len(d.inputFiles()) < tasks else d


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as archive events of one source: a thread and an actor a user."""
    e = read(spark, sf_dir, "events")
    return e.select(F.lit("driver").alias("source"), F.col("event_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value", F.col("props").alias("payload"), F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("text"), F.lit(None).cast("string").alias("reply_to"), F.concat(F.lit("u"), F.col("user_id")).alias("thread_key"), F.concat(F.lit("user "), F.col("user_id")).alias("actor"), "event_id")


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, v, e = texts(spark, sf_dir), read(spark, sf_dir, "embeddings"), read(spark, sf_dir, "events")
    base = d.join(v, d["doc_id"] == v["vec_id"], "left").join(e.select("event_id", "ts", "event_type"), d["doc_id"] == e["event_id"], "left")
    return base.select(F.col("doc_id").alias("segment_id"), F.concat(F.lit("c"), F.pmod("doc_id", F.lit(7))).alias("thread_key"), F.array("source").alias("sources"), F.col("ts").alias("started_at"), F.coalesce("text", F.lit("")).alias("raw_text"), "embedding", (F.col("doc_id") % 11 != 5).alias("is_substantive"), "label", "lang")


def seg_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of segs and what search asks of them, without vectors and times: no text is shuffled for a join."""
    return texts(spark, sf_dir).select(F.col("doc_id").alias("segment_id"), F.coalesce("text", F.lit("")).alias("raw_text"), (F.col("doc_id") % 11 != 5).alias("is_substantive"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 3) -> list[float]:
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"), F.lit(1).alias("polarity"), F.round(F.pmod("o_orderkey", F.lit(10)) / 10, 1).alias("confidence"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("version"), F.col("o_orderdate").alias("t_valid"), F.lit(None).cast("timestamp_ntz").alias("t_invalid"), F.lit(None).cast("timestamp_ntz").alias("t_expired"))


QUESTION = "thingble ofinand tionthe the whenre erorthe anded"
NOW = datetime(2024, 3, 1)

#: The default analyzer in SQL.
MARKED, BARE = "".join(T.MARKED), "".join(T.MARKED.values())
TOKENS_SQL = lambda text: f"regexp_extract_all(lower(regexp_replace(translate({text}, '{MARKED}', '{BARE}'), '[\\x{{0300}}-\\x{{036F}}]', '', 'g')), '[\\p{{L}}\\p{{N}}_]+')"
SEG_SQL = "seg AS (SELECT d.doc_id AS segment_id, 'c' || (d.doc_id % 7) AS thread_key, d.source, e.ts AS started_at, coalesce(d.text, '') AS raw_text, v.embedding, v.label, d.lang, d.doc_id % 11 <> 5 AS is_substantive FROM documents d LEFT JOIN embeddings v ON d.doc_id = v.vec_id LEFT JOIN events e ON d.doc_id = e.event_id), sub AS (SELECT * FROM seg WHERE is_substantive)"
POST_SQL = f"post AS (SELECT DISTINCT segment_id AS id, unnest({TOKENS_SQL('raw_text')}) AS lexeme FROM sub), df AS (SELECT lexeme, count(*) AS df FROM post GROUP BY 1)"
TERMS_SQL = f"term AS (SELECT lexeme, ln((SELECT count(*) FROM sub) / df.df::DOUBLE) AS idf FROM (SELECT DISTINCT unnest({TOKENS_SQL(f"'{QUESTION}'")}) AS lexeme) JOIN df USING (lexeme) WHERE df.df < 0.05 * (SELECT count(*) FROM sub))"
COS = "1 - list_sum(list_transform(list_zip(a, b), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b, lambda x: x::DOUBLE * x::DOUBLE))))"
DENSE_SQL = f"pairs AS (SELECT segment_id AS id, embedding AS a, (SELECT embedding FROM embeddings WHERE vec_id = 3) AS b FROM sub WHERE embedding IS NOT NULL), dist AS (SELECT id, {COS} AS distance FROM pairs), dense AS (SELECT id, distance, row_number() OVER (ORDER BY round(distance, 9), id) AS dense_rank FROM dist QUALIFY dense_rank <= 100)"
LEX_SQL = "lex AS (SELECT id, sum(idf) AS score, row_number() OVER (ORDER BY round(sum(idf), 9) DESC, id) AS lex_rank FROM post JOIN term USING (lexeme) GROUP BY id QUALIFY lex_rank <= 100)"


@query("hybrid_search", f"WITH {SEG_SQL}, {POST_SQL}, {TERMS_SQL}, {LEX_SQL}, {DENSE_SQL}, u AS (SELECT id, 1.0::DOUBLE / (60 + dense_rank) AS s, dense_rank, NULL AS lex_rank FROM dense UNION ALL SELECT id, 1.0::DOUBLE / (60 + lex_rank), NULL, lex_rank FROM lex) SELECT id, round(sum(s), 9) AS score, max(dense_rank) AS dense_rank, max(lex_rank) AS lex_rank FROM u GROUP BY id ORDER BY round(sum(s), 12) DESC, id LIMIT 20")
def hybrid_search(spark, sf_dir):
    return search.hybrid_search(segs(spark, sf_dir), QUESTION, query_vector(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query("lexical_topk", f"WITH {SEG_SQL}, {POST_SQL}, {TERMS_SQL}, {LEX_SQL} SELECT id, round(score, 6) AS score, lex_rank FROM lex")
def lexical_topk(spark, sf_dir):
    s = search.substantive(segs(spark, sf_dir))
    posts = search.matches(s, search.question_terms(spark, QUESTION), "segment_id", "raw_text")
    terms = search.kept_terms(QUESTION, posts.groupBy("lexeme").agg(F.count("*").alias("df")), s.count())
    return search.lexical_topk(posts, terms).withColumn("score", F.round("score", 6))


@query("dense_topk", f"WITH {SEG_SQL}, {DENSE_SQL} SELECT id, round(distance, 6) AS distance, dense_rank FROM dense")
def dense_topk(spark, sf_dir):
    return search.dense_topk(segs(spark, sf_dir), "segment_id", query_vector(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query("dense_topk_clustered", f"WITH {SEG_SQL}, {DENSE_SQL} SELECT id, round(distance, 6) AS distance FROM dense")
def dense_topk_clustered(spark, sf_dir):
    """The rows of dense_topk, from kept clusters."""
    name = scratch_path(spark, "near")
    nearest.keep_vectors(segs(spark, sf_dir), name)
    return nearest.Vectors(spark, name).nearest(query_vector(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


FILTER_SQL = "started_at >= TIMESTAMP '2024-01-02' AND started_at <= TIMESTAMP '2024-01-20' AND thread_key IN ('c1', 'c2', 'c4', 'c5') AND source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7')"


@query("recall_filtered", f"WITH {SEG_SQL}, {POST_SQL}, {TERMS_SQL}, ok AS (SELECT * FROM sub WHERE {FILTER_SQL}), {LEX_SQL.replace('FROM post JOIN term', 'FROM post JOIN ok ON id = segment_id JOIN term')}, {DENSE_SQL.replace('FROM sub', 'FROM ok')}, u AS (SELECT id, 1.0::DOUBLE / (60 + dense_rank) AS s, dense_rank, NULL AS lex_rank FROM dense UNION ALL SELECT id, 1.0::DOUBLE / (60 + lex_rank), NULL, lex_rank FROM lex), best AS (SELECT id, round(sum(s), 9) AS score, max(dense_rank) AS dense_rank, max(lex_rank) AS lex_rank FROM u GROUP BY id ORDER BY round(sum(s), 12) DESC, id LIMIT 20) SELECT best.*, substr(raw_text, 1, 2000) AS text, started_at FROM best JOIN seg ON id = segment_id")
def recall_filtered(spark, sf_dir):
    """A question about some days, threads and sources over a kept index and kept vectors; frequencies are the archive's."""
    s, name = segs(spark, sf_dir), scratch_path(spark, "recall")
    search.keep_index(s, name)
    nearest.keep_vectors(s, name)
    archive = Archive(spark, s, events(spark, sf_dir), spark.createDataFrame([], schema.COMMITMENT))
    found = archive.recall(QUESTION, query_vector(spark, sf_dir), index=name, vectors=nearest.Vectors(spark, name), date_from=datetime(2024, 1, 2), date_to=datetime(2024, 1, 20), threads=["c1", "c2", "c4", "c5"], sources=[f"src{k}" for k in range(1, 8)])
    return found.withColumn("score", F.round("score", 9))


@query("rrf", f"WITH {SEG_SQL}, {DENSE_SQL}, other AS (SELECT segment_id AS id, row_number() OVER (ORDER BY started_at, segment_id) AS r FROM seg QUALIFY r <= 100), u AS (SELECT id, dense_rank AS r FROM dense UNION ALL SELECT id, r FROM other) SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM u GROUP BY id")
def rrf(spark, sf_dir):
    s = segs(spark, sf_dir)
    early = search.top_ranked(s.select(F.col("segment_id").alias("id"), "started_at"), [F.asc("started_at"), F.asc("id")], 100, "rank")
    dense = search.dense_topk(s, "segment_id", query_vector(spark, sf_dir))
    return search.reciprocal_rank_fusion([dense.select("id", "dense_rank"), early.select("id", "rank")]).withColumn("score", F.round("score", 9))


@query("lexeme_df", f"WITH {SEG_SQL}, {POST_SQL} SELECT lexeme, df FROM df")
def lexeme_df(spark, sf_dir):
    return search.lexeme_df(seg_texts(spark, sf_dir), "segment_id", "raw_text")


STEM_SQL = "lexeme"
for _p in stems.PATTERNS:
    STEM_SQL = f"regexp_replace({STEM_SQL}, '{_p}', '\\1')"


@query("stemmed_df", f"WITH {SEG_SQL}, post AS (SELECT DISTINCT segment_id AS id, unnest({TOKENS_SQL('raw_text')}) AS lexeme FROM sub), s AS (SELECT DISTINCT id, {STEM_SQL} AS lexeme FROM post) SELECT lexeme, count(*) AS df FROM s GROUP BY 1")
def stemmed_df(spark, sf_dir):
    return search.lexeme_df(seg_texts(spark, sf_dir), "segment_id", "raw_text", stems.stems)


@query("result_slots", f"WITH {SEG_SQL}, r AS (SELECT source, row_number() OVER (PARTITION BY lang ORDER BY started_at, segment_id) AS rank FROM seg) SELECT source, count(*) AS slots FROM r WHERE rank <= 20 GROUP BY 1")
def result_slots(spark, sf_dir):
    """The first results of a question a language; a segment's first event is of its source."""
    s = segs(spark, sf_dir).withColumn("source_event_ids", F.array(F.concat_ws(":", F.get("sources", F.lit(0)), "segment_id")))
    ranked = s.select(F.col("lang").alias("question"), F.col("segment_id").alias("id"), F.row_number().over(Window.partitionBy("lang").orderBy("started_at", "segment_id")).alias("rank"))
    return quality.result_slots(ranked, s)


@query("normalised", "SELECT vec_id, round(list_sum(list_transform(u, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS size, round(u[1]::DOUBLE, 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))::FLOAT) AS u FROM embeddings)")
def normalised(spark, sf_dir):
    u = read(spark, sf_dir, "embeddings").select("vec_id", vectors.normalise(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 5).alias("size"), F.round(F.get("u", F.lit(0)).cast("double"), 6).alias("first"))


@query("first_mention", f"WITH {SEG_SQL} SELECT segment_id, started_at AS ts FROM seg WHERE contains(lower(raw_text), 'thingble') OR contains(lower(raw_text), 'onnand') ORDER BY started_at, segment_id LIMIT 20")
def first_mention(spark, sf_dir):
    s = segs(spark, sf_dir).withColumnRenamed("started_at", "ts")
    return search.first_mention(s, ["thingble", "onnand"], text_col="raw_text", order=["segment_id"]).select("segment_id", "ts")


@query("stratified", f"WITH {SEG_SQL}, pairs AS (SELECT segment_id AS id, started_at, embedding AS a, (SELECT embedding FROM embeddings WHERE vec_id = 3) AS b FROM sub WHERE embedding IS NOT NULL), dist AS (SELECT id, to_timestamp(floor(epoch_us(started_at) / 604800000000.0) * 604800)::TIMESTAMP AS bin_start, {COS} AS distance FROM pairs) SELECT bin_start, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY bin_start ORDER BY round(distance, 9), id) AS rank_in_bin FROM dist QUALIFY rank_in_bin <= 5")
def stratified(spark, sf_dir):
    out = search.stratified_search(segs(spark, sf_dir), query_vector(spark, sf_dir), 7 * 86400, 5)
    return out.select(F.col("bin_start").cast("timestamp_ntz").alias("bin_start"), "id", F.round("distance", 6).alias("distance"), "rank_in_bin")


@query("timeline", f"WITH {SEG_SQL} SELECT segment_id, started_at, substr(raw_text, 1, 300) AS text FROM sub WHERE started_at BETWEEN '2024-01-02' AND '2024-01-03' AND source IN ('src1', 'src2', 'src3')")
def timeline(spark, sf_dir):
    return search.timeline(segs(spark, sf_dir), datetime(2024, 1, 2), datetime(2024, 1, 3), ["src1", "src2", "src3"]).select("segment_id", "started_at", "text")


@query("ground", f"WITH {SEG_SQL} SELECT segment_id, substr(raw_text, 1, 2000) AS text FROM seg WHERE segment_id IN (3, 17, 99)")
def ground(spark, sf_dir):
    return search.ground(segs(spark, sf_dir), [3, 17, 99]).select("segment_id", "text")


@query("cheap_signals", "SELECT vec_id AS id, round((1.0 / (60 + vec_id)) * (1 + 0.10 * least(label, 10) / 10.0) * (1 + 0.15 * (1 - least(vec_id % 5, 3) / 3.0)) * (1 + 0.10 * (vec_id % 11) / 10.0) * (CASE WHEN vec_id % 2 = 0 THEN 1.25 ELSE 1.0 END) * exp(-0.6931471805599453 * greatest(0, vec_id % 90 - 7) * greatest(0, vec_id % 90 - 7) / 900.0), 9) AS boosted FROM embeddings")
def cheap_signals(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    c = v.select(F.col("vec_id").alias("id"), (1.0 / (60 + F.col("vec_id"))).alias("score"), F.col("label").alias("mentions"), (F.col("vec_id") % 5).alias("distance"), (F.col("vec_id") % 11).alias("importance"), (F.col("vec_id") % 2 == 0).alias("participant"), (F.col("vec_id") % 90).alias("age_days"))
    return search.cheap_signals(c, recency=True).select("id", F.round("boosted", 9).alias("boosted"))


@query("rerank", f"WITH {SEG_SQL}, {DENSE_SQL} SELECT id, row_number() OVER (ORDER BY CASE id WHEN 7 THEN 1 WHEN 3 THEN 2 ELSE 100 + dense_rank END) AS position FROM dense")
def rerank(spark, sf_dir):
    """The pool is the nearest hundred; a reranker gave two of them places."""
    pool = search.dense_topk(segs(spark, sf_dir), "segment_id", query_vector(spark, sf_dir))
    ranked = search.apply_ranking(pool.select("id", F.col("dense_rank").alias("rank")), [7, 3, 7, 999_999_999])
    return search.top_ranked(ranked, [F.asc("place"), F.asc("id")], 100, "position").select("id", "position")


@query("daily_rollup", "SELECT ts::DATE AS day, event_type, count(*) AS n, sum(length(props))::BIGINT AS chars FROM events GROUP BY 1, 2")
def daily_rollup(spark, sf_dir):
    return views.daily_rollup(read(spark, sf_dir, "events"), ["event_type"], "ts", "props")


@query("monthly_topics", "SELECT date_trunc('month', ts)::DATE AS month, topic, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT ts, value, unnest([event_type, 'u' || (user_id % 10)]) AS topic FROM events) GROUP BY 1, 2")
def monthly_topics(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("topics", F.array("event_type", F.concat(F.lit("u"), F.col("user_id") % 10)))
    return views.monthly_topics(e, "ts", "topics", "value").withColumn("mean", F.round("mean", 6))


@query("stats", "SELECT source, count(*) AS n, count(l.doc_id) AS labelled, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE lang = 'en') AS english, max(d.doc_id) AS newest FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def stats(spark, sf_dir):
    l = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(l, F.col("doc_id") == F.col("l_id"), "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count("l_id").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("lang") == "en").alias("english"), F.max("doc_id").alias("newest"))


GAP_SQL = "g AS (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) / 1e6 AS gap FROM events)"


@query("thread_gaps", f"WITH {GAP_SQL} SELECT event_type, count(*) AS n_samples, round(quantile_cont(gap, 0.5), 3) AS p50, round(quantile_cont(gap, 0.75), 3) AS p75, round(quantile_cont(gap, 0.9), 3) AS p90 FROM g WHERE gap > 0 GROUP BY 1 HAVING count(*) >= 100")
def thread_gaps(spark, sf_dir):
    out = segments.gap_percentiles(read(spark, sf_dir, "events"), "event_type", "ts", ["event_id"])
    return out.select("event_type", "n_samples", *[F.round(c, 3).alias(c) for c in ("p50", "p75", "p90")])


@query("fit_gaps_sql", f"WITH {GAP_SQL}, p AS (SELECT event_type, count(*) AS n_samples, round(quantile_cont(gap, 0.75))::BIGINT AS r FROM g WHERE gap > 0 GROUP BY 1 HAVING count(*) >= 100) SELECT event_type, n_samples, greatest(600, least(21600, r)) AS gap_seconds, CASE WHEN r < 600 THEN 'low' WHEN r > 21600 THEN 'high' END AS clamped FROM p")
def fit_gaps_sql(spark, sf_dir):
    return segments.gap_percentiles(read(spark, sf_dir, "events"), "event_type", "ts", ["event_id"]).select("event_type", "n_samples", "gap_seconds", "clamped")


def fit_sql(key: str, least: int) -> str:
    """CTEs that end in fit(key, gap_seconds, method, n_samples)."""
    return f"""lagged AS (SELECT {key} AS key, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {key} ORDER BY ts))) / 1e6 AS gap FROM events),
tot AS (SELECT key, count(*) AS n_events, count(*) FILTER (WHERE gap > 0) AS n_gaps FROM lagged GROUP BY key),
good AS (SELECT lagged.key AS key, gap, log10(gap) AS x FROM lagged JOIN tot ON lagged.key = tot.key WHERE gap > 0 AND n_events >= {least} AND n_gaps >= {least}),
span AS (SELECT key, min(x) AS lo, (max(x) - min(x)) / 60 AS step, quantile_cont(gap, 0.9) AS p90 FROM good GROUP BY key),
bins AS (SELECT good.key AS key, least(floor((x - lo) / step), 59)::INT AS bin, count(*) AS c FROM good JOIN span ON good.key = span.key GROUP BY 1, 2),
grid AS (SELECT span.key AS key, i, coalesce(c, 0)::DOUBLE AS c FROM span CROSS JOIN range(60) t(i) LEFT JOIN bins ON bins.key = span.key AND bin = i),
smooth AS (SELECT key, i, coalesce(lag(c, 2) OVER w, 0) * (1::DOUBLE / 9) + coalesce(lag(c, 1) OVER w, 0) * (2::DOUBLE / 9) + c * (3::DOUBLE / 9) + coalesce(lead(c, 1) OVER w, 0) * (2::DOUBLE / 9) + coalesce(lead(c, 2) OVER w, 0) * (1::DOUBLE / 9) AS v FROM grid WINDOW w AS (PARTITION BY key ORDER BY i)),
lim AS (SELECT key, lo, step, p90, greatest(1, least(ceil((log10(600) - lo) / step), 58))::INT AS a, ceil((log10(21600) - lo) / step) AS z FROM span),
lim2 AS (SELECT key, lo, step, p90, a, greatest(a + 1, least(z, 59))::INT AS b FROM lim),
shape AS (SELECT lim2.key AS key, lo, step, p90, a, b, min(v) FILTER (WHERE i >= a AND i < b) AS low, max(v) FILTER (WHERE i < a) AS l, max(v) FILTER (WHERE i >= b) AS r FROM lim2 JOIN smooth ON lim2.key = smooth.key GROUP BY ALL),
dip AS (SELECT shape.key AS key, p90, CASE WHEN b - a >= 3 AND l > 0 AND r > 0 AND low < 0.6 * least(l, r) THEN pow(10, lo + step * (SELECT min(i) FROM smooth WHERE smooth.key = shape.key AND i >= a AND i < b AND v = low)) END AS valley FROM shape),
fit AS (SELECT tot.key AS key, CASE WHEN p90 IS NULL THEN 1800 ELSE greatest(600, least(21600, trunc(coalesce(valley, p90)))) END::BIGINT AS gap_seconds, CASE WHEN valley IS NOT NULL THEN 'valley' WHEN p90 IS NOT NULL THEN 'p90' ELSE 'default' END AS method, CASE WHEN n_events < {least} THEN n_events ELSE n_gaps END AS n_samples FROM tot LEFT JOIN dip ON tot.key = dip.key)"""


@query("fit_gaps", f"WITH {fit_sql('event_type', 100)} SELECT key AS event_type, gap_seconds, method, n_samples FROM fit")
def fit_gaps(spark, sf_dir):
    return segments.fit_gaps(read(spark, sf_dir, "events"), "event_type", "ts")


#: The cut and the merge one row after the other; every fourth event answers the third one before it.
CUT_SQL = f"""WITH RECURSIVE {fit_sql("'u' || user_id", 20)},
r AS (SELECT 'u' || user_id AS thread_key, event_id, ts, epoch_us(ts) / 1e6 AS s, length('user ' || user_id || ': ' || event_type || ' ' || props) AS size, row_number() OVER w AS k, CASE WHEN event_id % 4 = 0 THEN row_number() OVER w - 3 END AS reply, gap_seconds AS gap
    FROM events JOIN fit ON key = 'u' || user_id WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR)),
c AS (SELECT thread_key, k, s, k AS first, size AS chars, 0 AS unit FROM r WHERE k = 1
    UNION ALL
    SELECT thread_key, k, s, CASE WHEN new THEN k ELSE first END, CASE WHEN new THEN size ELSE chars + 1 + size END, unit + new::INT
    FROM (SELECT r.thread_key AS thread_key, r.k AS k, r.s AS s, r.size AS size, c.first AS first, c.chars AS chars, c.unit AS unit,
        (r.s - c.s > r.gap AND NOT (coalesce(r.reply >= c.first, false) AND r.s - c.s < 4 * r.gap)) OR r.k - c.first >= 15 OR greatest(1, c.chars // 3) >= 250 AS new
        FROM c JOIN r ON r.thread_key = c.thread_key AND r.k = c.k + 1)),
u AS (SELECT thread_key, unit, count(*) AS n, min(s) AS a, max(s) AS b FROM c GROUP BY 1, 2),
v AS (SELECT *, a - lag(b) OVER w AS before, coalesce(lead(a) OVER w - b, 1e300) AS after FROM u WINDOW w AS (PARTITION BY thread_key ORDER BY unit)),
m AS (SELECT thread_key, unit, n AS held, 0 AS segment FROM v WHERE unit = 0
    UNION ALL
    SELECT v.thread_key, v.unit, CASE WHEN v.n < 3 AND before <= after AND held + v.n <= 30 THEN held + v.n ELSE v.n END, segment + CASE WHEN v.n < 3 AND before <= after AND held + v.n <= 30 THEN 0 ELSE 1 END
    FROM m JOIN v ON v.thread_key = m.thread_key AND v.unit = m.unit + 1),
cut AS (SELECT r.thread_key AS thread_key, r.event_id AS event_id, r.ts AS ts, m.segment::BIGINT AS segment FROM r JOIN c ON r.thread_key = c.thread_key AND r.k = c.k JOIN m ON m.thread_key = c.thread_key AND m.unit = c.unit)"""


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events, of which every fourth answers the third one before it in its thread."""
    e = events(spark, sf_dir)
    before = F.lag("source_id", 3).over(Window.partitionBy("thread_key").orderBy("ts", "source_id"))
    return e.withColumn("reply_to", F.when(F.col("event_id") % 4 == 0, before))


@query("segment_threads", f"{CUT_SQL} SELECT thread_key, event_id::VARCHAR AS source_id, segment FROM cut")
def segment_threads(spark, sf_dir):
    gaps = segments.fit_gaps(events(spark, sf_dir), "thread_key", "ts", 20)
    return segments.segment_threads(answered(spark, sf_dir), gaps).select("thread_key", "source_id", "segment")


@query("segment_fields", f"""{CUT_SQL},
f AS (SELECT cut.thread_key AS thread_key, segment, min(cut.ts) AS started_at, max(cut.ts) AS ended_at, count(*)::INT AS event_count, list('driver:' || cut.event_id ORDER BY cut.ts, cut.event_id::VARCHAR) AS source_event_ids,
    string_agg('user ' || user_id || ': ' || CASE WHEN cut.event_id % 5 = 0 THEN 'said ' || event_type WHEN cut.event_id % 7 = 0 THEN '' ELSE event_type || ' ' || props END, chr(10) ORDER BY cut.ts, cut.event_id::VARCHAR) AS raw_text, arg_min(event_type, (cut.ts, cut.event_id::VARCHAR)) AS title, any_value(user_id) AS user_id,
    sum(CASE WHEN cut.event_id % 5 = 0 OR cut.event_id % 7 = 0 THEN 0 ELSE length(event_type || ' ' || props) END) AS chars, count(DISTINCT CASE WHEN cut.event_id % 5 = 0 OR cut.event_id % 7 = 0 THEN '' ELSE lower(event_type || ' ' || props) END) AS kinds FROM cut JOIN events e ON cut.event_id = e.event_id GROUP BY 1, 2)
SELECT thread_key, started_at, ended_at, event_count, source_event_ids, raw_text, '[chat: ' || title || '] [with: user ' || user_id || '] [date: ' || strftime(started_at, '%Y-%m') || '] [weekday: ' || dayname(started_at) || ']' || chr(10) || raw_text AS embed_text, greatest(1, length(raw_text) // 3)::BIGINT AS tokens, CASE WHEN event_count < 3 THEN chars > 80 ELSE chars >= 80 AND kinds >= 3 END AS is_substantive FROM f""")
def segment_fields(spark, sf_dir):
    """Every fifth event is a voice message and every seventh of the others is empty."""
    e = answered(spark, sf_dir)
    gaps = segments.fit_gaps(e, "thread_key", "ts", 20)
    cut = segments.segment_threads(e, gaps).select("thread_key", "source_id", "segment")
    voice, empty = F.col("event_id") % 5 == 0, F.col("event_id") % 7 == 0
    members = e.join(cut, ["thread_key", "source_id"]).withColumns({"density": F.lit("narrative"), "chat_title": F.col("event_type"), "text": F.when(voice, F.lit(None).cast("string")).when(empty, "").otherwise(F.col("text")), "transcript": F.when(voice, F.concat(F.lit("said "), F.col("event_type"))), "ocr_text": F.lit(None).cast("string")})
    out = segments.segment_fields(members)
    return out.select("thread_key", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"), "event_count", "source_event_ids", "raw_text", "embed_text", F.col("tokens").cast("long").alias("tokens"), "is_substantive")


@query("sessionize", "WITH m AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > 21600, false)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m) SELECT user_id, session::BIGINT AS session, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n, greatest(1, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6))::BIGINT AS minutes, list_sort(list(DISTINCT event_type)) AS kinds FROM s GROUP BY user_id, session")
def sessionize(spark, sf_dir):
    s = sessions.gap_sessions(read(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600, ["event_id"])
    return sessions.summarise_sessions(s, ["user_id"], "ts", F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query("islands", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events) SELECT user_id, event_type, island, count(*) AS n, min(ts) AS started_at, max(ts) AS ended_at FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def islands(spark, sf_dir):
    i = sessions.islands(read(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"]).withColumn("island", F.col("island").cast("long"))
    return i.groupBy("user_id", "event_type", "island").agg(F.count("*").alias("n"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")).where("n >= 2")


@query("stays", "WITH p AS (SELECT user_id, event_id, ts, floor(value / 100) * 0.01 AS lat, (event_id % 2) * 0.001 AS lon FROM events), m AS (SELECT *, coalesce(abs(lat - lag(lat) OVER w) > 0.0015 OR abs(lon - lag(lon) OVER w) > 0.0015, false)::INT AS moved FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(moved) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stay FROM m) SELECT user_id, stay::BIGINT AS stay, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM s GROUP BY user_id, stay HAVING count(*) >= 2 AND epoch_us(max(ts)) - epoch_us(min(ts)) >= 1200000000")
def stays(spark, sf_dir):
    p = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.floor(F.col("value") / 100) * F.lit(0.01)).alias("lat"), ((F.col("event_id") % 2) * F.lit(0.001)).alias("lon"))
    return sessions.stays(p, ["user_id"], "ts", order=["event_id"]).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("cluster_stays", "WITH p AS (SELECT user_id, event_id AS id, ts, floor(value / 100) AS cell, floor(value / 100) * 0.01 AS lat, (event_id % 2) * 0.001 AS lon FROM events), c AS (SELECT user_id, cell, row_number() OVER (PARTITION BY user_id ORDER BY min(id)) - 1 AS cluster FROM p GROUP BY user_id, cell HAVING count(*) >= 3), m AS (SELECT p.*, coalesce(cluster, -1) AS cluster FROM p LEFT JOIN c ON p.user_id = c.user_id AND p.cell = c.cell), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) - row_number() OVER (PARTITION BY user_id, cluster ORDER BY ts, id) AS island FROM m) SELECT user_id, cluster::BIGINT AS cluster, island::BIGINT AS island, min(id) AS stay_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM r WHERE cluster >= 0 GROUP BY 1, 2, 3 HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 1200000000")
def cluster_stays(spark, sf_dir):
    p = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "ts", (F.floor(F.col("value") / 100) * 0.01).alias("lat"), ((F.col("event_id") % 2) * 0.001).alias("lon"))
    out = sessions.cluster_stays(p, "user_id", "ts")
    return out.withColumns({"island": F.col("island").cast("long"), "lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("density_clusters", """WITH RECURSIVE p AS (SELECT user_id, event_id AS id, floor(value / 25) * 0.0011 + (event_id % 3) * 0.0003 AS lat, (event_id % 7) * 0.0006 AS lon FROM events),
near AS (SELECT x.user_id, x.id AS a, y.id AS b FROM p x JOIN p y ON x.user_id = y.user_id AND (x.lat - y.lat) * (x.lat - y.lat) + (x.lon - y.lon) * (x.lon - y.lon) <= 0.0015::DOUBLE * 0.0015::DOUBLE),
core AS (SELECT user_id, a AS id FROM near GROUP BY 1, 2 HAVING count(*) >= 3),
link AS (SELECT near.user_id, a, b FROM near JOIN core c ON a = c.id JOIN core d ON b = d.id),
reach AS (SELECT user_id, id AS a, id AS b FROM core UNION SELECT r.user_id, r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
head AS (SELECT user_id, a AS id, min(b) AS root FROM reach GROUP BY 1, 2),
num AS (SELECT user_id, root, row_number() OVER (PARTITION BY user_id ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT user_id, root FROM head)),
mine AS (SELECT near.user_id, near.a AS id, min(cluster) AS cluster FROM near JOIN head ON near.b = head.id JOIN num ON num.user_id = head.user_id AND num.root = head.root GROUP BY 1, 2)
SELECT p.user_id, p.id, mine.cluster::BIGINT AS cluster FROM p LEFT JOIN mine ON p.id = mine.id""")
def density_clusters(spark, sf_dir):
    """Points that straddle cells, some of them on a border between two clusters."""
    e = read(spark, sf_dir, "events")
    p = e.select("user_id", F.col("event_id").alias("id"), (F.floor(F.col("value") / 25) * F.lit(0.0011) + (F.col("event_id") % 3) * F.lit(0.0003)).alias("lat"), ((F.col("event_id") % 7) * F.lit(0.0006)).alias("lon"))
    return density.density_clusters(p, "user_id")


@query("current_facts", "SELECT o_custkey AS subject_id, o_orderpriority AS predicate, o_orderkey AS fact_id, o_orderstatus AS object FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def current_facts(spark, sf_dir):
    return facts.current_facts(fact_rows(spark, sf_dir), ["subject_id", "predicate"], [F.desc("version"), F.desc("fact_id")]).select("subject_id", "predicate", "fact_id", "object")


@query("best_fact", "SELECT o_custkey AS subject_id, o_orderpriority AS predicate, o_orderkey AS fact_id FROM orders WHERE o_orderkey % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY year(o_orderdate) DESC, o_orderkey % 10 DESC, o_orderkey DESC) = 1")
def best_fact(spark, sf_dir):
    """The version is the year, so that confidence decides; every fifth fact is no longer valid."""
    rows = fact_rows(spark, sf_dir).withColumns({"version": F.year("t_valid").cast("long"), "t_invalid": F.when(F.col("fact_id") % 5 == 0, F.col("t_valid"))})
    return facts.best_fact(rows, ["subject_id", "predicate"], "fact_id")


@query("fact_conflicts", "SELECT o_orderkey AS fact_id, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN greatest(lead(o_orderdate) OVER w, o_orderdate) END AS t_invalid FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) QUALIFY (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AND lead(o_orderdate) OVER w IS NOT NULL")
def fact_conflicts(spark, sf_dir):
    rows = fact_rows(spark, sf_dir)
    predicates = rows.select("predicate").distinct().withColumn("single_valued", F.col("predicate").rlike("^[12]"))
    return facts.resolve_conflicts(rows, predicates).where("t_invalid is not null").select("fact_id", "t_invalid")


@query("superseded", "SELECT o_orderkey AS fact_id, lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS t_invalid FROM orders")
def superseded(spark, sf_dir):
    return facts.invalidate_superseded(fact_rows(spark, sf_dir)).select("fact_id", "t_invalid")


@query("facts_as_of", "WITH f AS (SELECT o_orderkey AS fact_id, o_custkey AS subject_id, o_orderdate AS t_valid, lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS t_invalid FROM orders) SELECT fact_id, subject_id FROM f WHERE t_valid <= TIMESTAMP '1998-06-01' AND (t_invalid IS NULL OR t_invalid > TIMESTAMP '1998-06-01')")
def facts_as_of(spark, sf_dir):
    return facts.facts_as_of(facts.invalidate_superseded(fact_rows(spark, sf_dir)), F.lit(datetime(1998, 6, 1)).cast("timestamp_ntz")).select("fact_id", "subject_id")


@query("promotable", "WITH m AS (SELECT o_custkey AS s, l_partkey AS seg, l_suppkey AS th FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'), c AS (SELECT s, count(DISTINCT seg) AS segments, count(DISTINCT th) AS threads FROM m GROUP BY s HAVING count(DISTINCT seg) >= 3 AND count(DISTINCT th) >= 2) SELECT o_orderkey AS fact_id, o_custkey AS subject_id, segments, threads FROM orders JOIN c ON s = o_custkey WHERE o_orderkey % 10 >= 7 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def promotable(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    f = fact_rows(spark, sf_dir)
    m = l.join(f.select("fact_id", "subject_id"), F.col("l_orderkey") == F.col("fact_id")).select("subject_id", F.col("l_partkey").alias("segment_id"), F.col("l_suppkey").alias("thread_key"), F.col("l_returnflag").alias("source"))
    evidence = l.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("evidence_sources"))
    rows = f.join(evidence, F.col("fact_id") == F.col("k"), "left").withColumn("promoted_at", F.lit(None).cast("timestamp"))
    return facts.promotable(rows, m, spark.range(1).select(F.lit("R").alias("source"))).select("fact_id", "subject_id", "segments", "threads")


@query("forgotten_commitments", "SELECT o_orderkey, datediff('day', o_orderdate::DATE, DATE '2001-09-01') AS age_days FROM orders WHERE o_orderstatus = 'O' AND datediff('day', o_orderdate::DATE, DATE '2001-09-01') > 120")
def forgotten_commitments(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("resolved_by", F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey")))
    return views.forgotten_commitments(o, "o_orderdate", F.lit(datetime(2001, 9, 1)), 120).select("o_orderkey", F.col("age_days").cast("long").alias("age_days"))


@query("on_this_day", "SELECT o_orderkey, o_orderdate FROM orders WHERE month(o_orderdate) = 3 AND day(o_orderdate) = 14 AND o_orderdate < TIMESTAMP '2000-01-01' AND NOT (o_orderdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-31')")
def on_this_day(spark, sf_dir):
    sensitive = spark.sql("select timestamp_ntz '1997-03-01' as starts_at, cast(null as timestamp_ntz) as ends_at")
    return views.on_this_day(read(spark, sf_dir, "orders"), "o_orderdate", F.lit(datetime(2000, 3, 14)).cast("timestamp_ntz"), sensitive).select("o_orderkey", "o_orderdate")


@query("unsegmented", "SELECT event_id FROM events WHERE event_id % 3 <> 0 OR event_type = 'click'")
def unsegmented(spark, sf_dir):
    e = events(spark, sf_dir)
    s = e.where("event_id % 3 = 0 and event_type <> 'click'").groupBy("thread_key").agg(F.collect_list(F.concat_ws(":", "source", "source_id")).alias("source_event_ids"))
    return segments.unsegmented(e, s).select("event_id")


@query("upsert_events", "WITH old AS (SELECT event_id, event_type || ' ' || props AS text FROM events WHERE event_id % 4 <> 0), new AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'edited' ELSE event_type || ' ' || props END AS text FROM events WHERE event_id % 2 = 0) SELECT coalesce(old.event_id, new.event_id)::VARCHAR AS source_id, CASE WHEN old.event_id IS NULL THEN new.text WHEN new.text IS NOT NULL AND new.text <> '' AND new.text <> old.text THEN new.text ELSE old.text END AS text, CASE WHEN old.event_id IS NULL THEN 'new' WHEN new.text IS NOT NULL AND new.text <> '' AND new.text <> old.text THEN 'updated' ELSE 'kept' END AS change FROM old FULL JOIN new ON old.event_id = new.event_id")
def upsert_events(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("watermark_ts", F.col("ts"))
    state = e.where("event_id % 4 <> 0").drop("event_id")
    edited = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 3 == 0, "edited").otherwise(F.col("text"))
    incoming = e.where("event_id % 2 = 0").withColumn("text", edited).drop("event_id")
    return lifecycle.upsert_events(state, incoming, redacted=False).select("source_id", "text", "change")


@query("watermarks", "SELECT event_type AS source, greatest(TIMESTAMP '2024-01-10', max(ts)) AS last_ingested_at FROM events GROUP BY 1")
def watermarks(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    sources = e.select(F.col("event_type").alias("source")).distinct().withColumn("last_ingested_at", F.expr("timestamp_ntz '2024-01-10'"))
    return lifecycle.advance_watermarks(sources, e.select(F.col("event_type").alias("source"), F.col("ts").alias("watermark_ts")))


@query("purge_preview", "WITH doomed AS (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0), gone AS (SELECT o_orderkey FROM orders JOIN doomed ON o_custkey = user_id) SELECT (SELECT count(*) FROM events JOIN doomed USING (user_id)) AS events, (SELECT count(*) FROM gone) AS segments, (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN gone ON l_orderkey = o_orderkey) AS facts")
def purge_preview(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("thread_key", F.col("user_id"))
    s = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_custkey").alias("thread_key"))
    f = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("fact_id")).agg(F.collect_set("l_orderkey").alias("evidence"))
    return lifecycle.purge_preview(e.where("user_id % 10 = 0").select("thread_key").distinct(), e, s, f)


PURGE_SQL = """doomed AS (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0),
ev AS (SELECT event_id, user_id, 'driver:' || event_id AS key, user_id % 10 = 0 AS gone FROM events),
seg AS (SELECT user_id AS segment_id, user_id % 10 = 0 AS gone, count(*) AS n FROM events GROUP BY user_id),
fact AS (SELECT o_orderkey AS id, 1 + o_custkey % 100 AS segment_id, [o_orderkey % 500, o_orderkey % 77] AS cites FROM orders),
com AS (SELECT o_orderkey AS id, 1 + o_orderkey % 100 AS segment_id, CASE WHEN o_orderkey % 3 = 0 THEN 1 + (o_orderkey // 7) % 90 END AS resolved_by FROM orders),
men AS (SELECT l_partkey AS entity_id, 1 + l_suppkey % 100 AS segment_id FROM lineitem),
life AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN [] WHEN c_custkey % 7 = 0 THEN NULL ELSE [c_custkey % 300, c_custkey % 40, c_custkey % 300] END AS cites FROM customer),
gl AS (SELECT list(event_id) AS g FROM ev WHERE gone),
cut AS (SELECT id, len(list_filter(cites, lambda x: NOT list_contains(g, x))) AS rest, cites FROM life, gl)"""


def archive_tables(spark, sf_dir):
    """A whole archive: segments by user, facts and commitments from orders, mentions from line items, life events from
    customers, dependencies of every fact and commitment on the events that it cites."""
    e, o = events(spark, sf_dir), read(spark, sf_dir, "orders")
    keys = lambda *ids: F.transform(F.array(*ids), lambda x: F.concat(F.lit("driver:"), x))
    key, cust, none = F.col("o_orderkey"), F.col("c_custkey"), F.lit(None).cast("array<string>")
    out = {
        "events": e.select("source", "source_id", "thread_key", "ts", "text"),
        "segments": e.groupBy("user_id", "thread_key").agg(F.array_sort(F.collect_list(F.concat_ws(":", "source", "source_id"))).alias("source_event_ids")).select(F.col("user_id").cast("long").alias("segment_id"), "thread_key", "source_event_ids", F.when(F.col("user_id") % 3 > 0, F.array(F.lit(1.0))).alias("embedding")),
        "facts": o.select(key.alias("fact_id"), (1 + F.col("o_custkey") % 100).alias("source_segment_id"), keys(key % 500, key % 77).alias("source_event_ids")),
        "commitments": o.select(key.alias("commitment_id"), (1 + key % 100).alias("source_segment_id"), F.when(key % 3 == 0, 1 + F.expr("o_orderkey div 7") % 90).alias("resolution_segment_id"), F.lit("done").alias("status"), keys(key % 500).alias("source_event_ids")),
        "mentions": read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), (1 + F.col("l_suppkey") % 100).alias("segment_id")),
        "life_events": read(spark, sf_dir, "customer").select(cust.alias("life_event_id"), F.when(cust % 5 == 0, F.array().cast("array<string>")).when(cust % 7 == 0, none).otherwise(keys(cust % 300, cust % 40, cust % 300)).alias("source_event_ids")),
    }
    cited = lambda kind: out[f"{kind}s"].select(F.lit(kind).alias("projection_kind"), F.col(f"{kind}_id").alias("projection_id"), F.lit("driver").alias("source"), F.explode("source_event_ids").alias("k")).withColumn("source_id", F.substring_index("k", ":", -1)).drop("k")
    return out | {"deps": cited("fact").unionByName(cited("commitment")).distinct()}


@query("purge_audit", f"""WITH {PURGE_SQL}, gone AS (SELECT event_id FROM ev WHERE gone), seg_gone AS (SELECT segment_id FROM seg WHERE gone),
f AS (SELECT id, cites, segment_id IN (SELECT segment_id FROM seg_gone) OR len(list_filter(cites, lambda x: NOT list_contains(g, x))) = 0 AS out FROM fact, gl),
c AS (SELECT id, id % 500 AS cite, resolved_by, segment_id IN (SELECT segment_id FROM seg_gone) OR id % 500 IN (SELECT event_id FROM gone) AS out FROM com),
d AS (SELECT DISTINCT 'f' AS k, id, unnest(cites) AS e, out FROM f UNION SELECT 'c', id, cite, out FROM c)
SELECT 'events_deleted' AS kind, (SELECT count(*) FROM gone) AS n, 0 AS leftovers
UNION ALL SELECT 'segments_deleted', (SELECT count(*) FROM seg_gone), 0
UNION ALL SELECT 'facts_deleted', (SELECT count(*) FROM f WHERE out), 0
UNION ALL SELECT 'commitments_deleted', (SELECT count(*) FROM c WHERE out), 0
UNION ALL SELECT 'mentions_deleted', (SELECT count(*) FROM men WHERE segment_id IN (SELECT segment_id FROM seg_gone)), 0
UNION ALL SELECT 'life_events_deleted', (SELECT count(*) FROM cut WHERE len(cites) > 0 AND rest = 0), 0
UNION ALL SELECT 'deps_deleted', (SELECT count(*) FROM d WHERE out OR e IN (SELECT event_id FROM gone)), 0
UNION ALL SELECT 'commitments_reopened', (SELECT count(*) FROM c WHERE NOT out AND resolved_by IN (SELECT segment_id FROM seg_gone)), NULL""")
def purge_audit(spark, sf_dir):
    """What an erasure of every tenth user takes from each table, and what its proof finds left there."""
    tables = archive_tables(spark, sf_dir)
    doomed = tables["events"].where("cast(substring(thread_key, 2) as int) % 10 = 0").select("thread_key")
    after = erasure.purge(doomed, **tables)
    left = erasure.proof(doomed, tables, after).select(F.concat("table", F.lit("_deleted")).alias("kind"), F.col("leftovers").cast("int").alias("leftovers"))
    return after["audit"].join(left, "kind", "left").select("kind", "n", "leftovers")


@query("excluded_threads", "SELECT c_custkey AS chat_id FROM customer WHERE lower(c_name) LIKE '%7' UNION SELECT c_custkey FROM customer WHERE c_custkey % 13 = 0 UNION SELECT 42 UNION SELECT 777000")
def excluded_threads(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    chats = c.select(F.col("c_custkey").cast("long").alias("chat_id"), F.when(F.endswith("c_name", F.lit("7")), "some_BOT").otherwise("human").alias("username"))
    tags = c.where("c_custkey % 13 = 0").select(F.col("c_custkey").cast("long").alias("chat_id"), F.lit("chat:bot").alias("tag"))
    return lifecycle.excluded_threads(chats, tags, ["42"])


@query("freshness", "WITH d AS (SELECT user_id, ts::DATE AS day, max(ts) AS last_ts FROM events GROUP BY 1, 2), g AS (SELECT *, datediff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS gap FROM d), a AS (SELECT user_id, max(last_ts) AS last_event, count(*) AS active_days, max(gap) AS longest, (epoch_us(TIMESTAMP '2024-02-04') - epoch_us(max(last_ts))) / 86400e6 AS silent FROM g GROUP BY 1), b AS (SELECT *, CASE WHEN active_days >= 10 THEN longest END AS usual_gap_days FROM a) SELECT user_id, last_event, active_days, usual_gap_days::BIGINT AS usual_gap_days, round(silent, 1) AS days_silent, CASE WHEN silent > 365 THEN 'dormant' WHEN usual_gap_days IS NULL THEN 'unknown' WHEN silent > greatest(3, 2 * usual_gap_days) THEN 'silent' ELSE 'ok' END AS status FROM b")
def freshness(spark, sf_dir):
    return quality.freshness(read(spark, sf_dir, "events"), "user_id", "ts", F.lit(datetime(2024, 2, 4)))


DOCTOR_ROWS = "r AS (SELECT ['immich', 'telegram', 'wakapi', 'karakeep', 'lastfm'][1 + (event_id // 25) % 5] AS source, event_id // 25 AS run, CASE WHEN event_id % 9 = 7 AND (event_id // 25) % 8 = 3 THEN 'twice' ELSE event_id::VARCHAR END AS source_id, event_id, CASE WHEN event_id % 211 = 5 THEN NULL WHEN (event_id // 25) % 3 = 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (event_id % 25) * CASE WHEN (event_id // 25) % 2 = 0 THEN 50 ELSE 90 END WHEN (event_id // 25) % 11 = 4 THEN ts - INTERVAL 1 HOUR * (event_id % 25) * 40 ELSE ts END AS ts, ts + INTERVAL 1 DAY * CASE WHEN event_id % 40 = 3 THEN 4 ELSE 0 END AS mark, CASE WHEN (event_id // 25) % 4 = 1 AND event_id % 2 = 0 THEN ' ' WHEN (event_id // 25) % 4 = 2 AND event_id % 3 > 0 THEN NULL ELSE props END AS text, CASE WHEN (event_id // 25) % 7 = 1 THEN 'default' ELSE event_type END AS thread_key FROM events)"


@query("doctor_checks", f"""WITH {DOCTOR_ROWS},
k AS (SELECT *, source || ':' || run AS name, CASE WHEN source IN ('immich', 'wakapi', 'lastfm') THEN 'telemetry' WHEN source = 'telegram' THEN 'narrative' ELSE 'discrete' END AS density FROM r),
l AS (SELECT name, any_value(source) AS source, any_value(density) AS density, count(*) AS n, list(ts ORDER BY event_id) FILTER (WHERE ts IS NOT NULL) AS t, list(mark ORDER BY event_id) FILTER (WHERE mark IS NOT NULL) AS m, count(source_id) - count(DISTINCT source_id) AS dup, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS empty, list(DISTINCT thread_key) AS threads, count(*) FILTER (WHERE mark - ts > INTERVAL 3 DAY) AS long_span FROM k GROUP BY name),
g AS (SELECT *, list_sort(list_transform(range(1, len(t)), lambda i: (epoch_us(t[i + 1]) - epoch_us(t[i])) / 1e6)) AS gaps FROM l),
p AS (SELECT name, 'missing timestamps' AS problem, n - coalesce(len(t), 0) AS n FROM g WHERE coalesce(len(t), 0) < n
UNION ALL SELECT name, 'out of order', 0 FROM g WHERE t <> list_sort(t) AND m <> list_sort(m)
UNION ALL SELECT name, 'timestamps look like import time', len(t) FROM g WHERE len(t) >= 10 AND epoch_us(list_max(t)) - epoch_us(list_min(t)) < 3600000000 AND source IN ('immich', 'paperless', 'karakeep')
UNION ALL SELECT name, 'duplicate ids', dup FROM g WHERE dup > 0
UNION ALL SELECT name, 'telemetry not rolled up', len(list_filter(gaps, lambda x: x < 60)) FROM g WHERE density = 'telemetry' AND len(t) >= 10 AND gaps[len(gaps) // 2 + 1] < 60
UNION ALL SELECT name, 'mostly empty text', empty FROM g WHERE density = 'narrative' AND empty > 0.5 * n
UNION ALL SELECT name, 'default thread', n FROM g WHERE density = 'narrative' AND threads = ['default']
UNION ALL SELECT name, 'rollup span over three days', long_span FROM g WHERE density = 'telemetry' AND long_span > 0)
SELECT problem, count(*) AS sources, sum(n)::BIGINT AS n, min(name) AS first, max(name) AS last FROM p GROUP BY problem""")
def doctor_checks(spark, sf_dir):
    """Runs of 25 events in the order of their ids, with every kind of fault somewhere."""
    e = read(spark, sf_dir, "events")
    run, i = F.expr("event_id div 25"), F.col("event_id")
    source = F.element_at(F.array(*map(F.lit, ("immich", "telegram", "wakapi", "karakeep", "lastfm"))), (1 + run % 5).cast("int"))
    at = F.when(i % 211 == 5, None).when(run % 3 == 0, F.expr("timestamp_ntz '2024-01-01'") + F.make_dt_interval(secs=(i % 25) * F.when(run % 2 == 0, 50).otherwise(90))).when(run % 11 == 4, F.col("ts") - F.make_dt_interval(hours=((i % 25) * 40).cast("int"))).otherwise(F.col("ts"))
    rows = e.select(
        source.alias("source"), run.alias("run"), F.when((i % 9 == 7) & (run % 8 == 3), "twice").otherwise(i.cast("string")).alias("source_id"), i.alias("place"), at.alias("ts"), (F.col("ts") + F.make_dt_interval(days=F.when(i % 40 == 3, 4).otherwise(0))).alias("watermark_ts"),
        F.when((run % 4 == 1) & (i % 2 == 0), " ").when((run % 4 == 2) & (i % 3 > 0), None).otherwise(F.col("props")).alias("text"), F.when(run % 7 == 1, "default").otherwise(F.col("event_type")).alias("thread_key"),
    )
    density = F.when(F.col("source").isin("immich", "wakapi", "lastfm"), "telemetry").when(F.col("source") == "telegram", "narrative").otherwise("discrete")
    rows = rows.withColumns({"density": density, "name": F.concat_ws(":", "source", "run")})
    out = quality.doctor_checks(rows, "name", ["place"], source=F.col("source"))
    return out.groupBy("problem").agg(F.count("*").alias("sources"), F.sum("n").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


@query("coerce_ts", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN make_timestamp((1700000000 + event_id) * 1000000) WHEN 1 THEN make_timestamp((1700000000000 + event_id) * 1000) WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('day', ts) END AS at FROM events")
def coerce_ts(spark, sf_dir):
    """Numbers by their size; texts with a zone, with a date alone, with digits alone and with none of these."""
    e = read(spark, sf_dir, "events")
    k, i = F.col("event_id") % 6, F.col("event_id")
    raw = F.when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 3, F.date_format("ts", "yyyy-MM-dd")).when(k == 4, (i + 1700000000).cast("string")).otherwise("not a time")
    number = F.when(k == 0, i + 1700000000).when(k == 1, i + 1700000000000)
    return e.select("event_id", F.coalesce(times.epoch_ts(number), times.coerce_ts(raw)).cast("timestamp_ntz").alias("at"))


@query("json_payload", "SELECT (props->>'$.k')::INT AS k, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def json_payload(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("route_intent", r"WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(t, '\b(how many|how much|count|most often|statistics|average)\b') THEN 'aggregate' WHEN regexp_matches(t, '\bfirst\b.{0,20}\b(mention|time|said|heard)\b|\bearliest\b|\bwhen did i first\b', 's') THEN 'first_mention' WHEN regexp_matches(t, '\bevolv|\bover the years\b|\bover time\b|\btrajector|\bhow did my\b.{0,30}\bchange\b', 's') THEN 'evolution' WHEN regexp_matches(t, '\btimeline\b|\bchronolog|\bwhat happened\b') THEN 'timeline' ELSE 'lookup' END AS kind FROM q")
def route_intent(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.route_intent(F.coalesce("text", F.lit("")))["kind"].alias("kind"))


PHONETIC_SQL = "lower(c_name)"
for _p, _r in [("[^a-z0-9]", ""), *((p, r.replace("$1", "\\1")) for p, r in T.PHONETIC_FOLDS if p != r"(.)\1+")]:
    if _p == "[aeiou]+$":
        # RE2 has no back references: doubled letters and digits are folded one by one.
        for _c in "abcdefghijklmnopqrstuvwxyz0123456789":
            PHONETIC_SQL = f"regexp_replace({PHONETIC_SQL}, '{_c}{_c}+', '{_c}', 'g')"
    PHONETIC_SQL = f"regexp_replace({PHONETIC_SQL}, '{_p}', '{_r}', 'g')"


@query("phonetic_key", f"WITH k AS (SELECT c_custkey, {PHONETIC_SQL} AS phonetic FROM customer) SELECT c_custkey, phonetic, translate(phonetic, 'aeiou', '') AS skeleton FROM k")
def phonetic_key(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", T.phonetic_key(F.col("c_name")).alias("phonetic"), T.skeleton_key(F.col("c_name")).alias("skeleton"))


@query("resolve_candidates", "WITH a AS (SELECT s_suppkey AS id, lower(n_name) AS ph, translate(lower(n_name), 'aeiou', '') AS sk FROM supplier JOIN nation ON s_nationkey = n_nationkey), b AS (SELECT n_nationkey AS cand, lower(n_name) AS ph, translate(lower(n_name), 'aeiou', '') AS sk FROM nation), u AS (SELECT id, cand, 1 AS tier FROM a JOIN b ON a.ph = b.ph UNION ALL SELECT id, cand, 2 FROM a JOIN b ON a.sk = b.sk WHERE length(a.sk) >= 2) SELECT id, cand, min(tier) AS tier FROM u GROUP BY 1, 2")
def resolve_candidates(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("ph"), F.translate(F.lower("n_name"), "aeiou", "").alias("sk"))
    a = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), "ph", "sk")
    return resolve.candidates(a, n.select(F.col("n_nationkey").alias("cand"), "ph", "sk"))


def redaction_sql() -> str:
    """CTEs that end in red(doc_id, source, text, r): the same patterns one after the other, in RE2's dialect.

    RE2 has no look-around: what stands before or after a secret is caught and put back, twice where two may touch, and
    the code shapes of a bare secret are tested apart, line by line.
    """
    sql = "coalesce(text, '')"
    for kind, pattern in T.SECRETS:
        mark, put = f"[REDACTED:{kind}]", f"[REDACTED:{kind}]"
        if kind == "url_password":
            pattern, put = r"(://)([^\s/:@\[][^\s/:@]*:[^\s/@]+)@", rf"\1{mark}@"
        elif kind == "labelled":
            pattern, put = r"(?i)(^|[^\p{L}\p{N}])((?:password|passwd|pwd|passphrase|пароль|пасс|secret|api[ _-]?key|token|токен)\s*[:=]\s*)([^\s,;\[][^\s,;]{3,})", rf"\1\2{mark}"
        sql = f"regexp_replace({sql}, '{pattern}', '{put}', 'g')"
        if kind == "labelled":
            sql = f"regexp_replace({sql}, '{pattern}', '{put}', 'g')"
    label = r"(?i)(?:key|token|pass|passwd|password|passphrase|pwd|secret|парол[\p{L}\p{N}_]*|ключ[\p{L}\p{N}_]*|токен[\p{L}\p{N}_]*)([^\p{L}\p{N}_]|$)"
    line = r"^[ \t]*\S{20,}[ \t\r]*$"
    bad = r"\S://|^[ \t]*://|^[ \t]*www\.|^[ \t]*\[REDACTED|\(.*\)|=[\"'']|[;{}][ \t\r]*$"
    one = f"CASE WHEN regexp_matches(l, '{line}') AND regexp_matches(l, '[0-9]') AND regexp_matches(l, '[A-Za-z]') AND NOT regexp_matches(l, '{bad}') THEN regexp_replace(l, '\\S{{20,}}', '[REDACTED:bare_secret]') ELSE l END"
    return f"first AS (SELECT doc_id, source, text, {sql} AS s FROM documents), red AS (SELECT doc_id, source, text, CASE WHEN regexp_matches(s, '{label}') THEN array_to_string(list_transform(string_split(s, chr(10)), lambda l: {one}), chr(10)) ELSE s END AS r FROM first)"


@query("redact_counts", r"SELECT count(*) FILTER (WHERE regexp_matches(text, '\b(AKIA|ASIA)[0-9A-Z]{16}\b')) AS aws, count(*) FILTER (WHERE regexp_matches(text, '\bsk-[A-Za-z0-9_-]{20,}')) AS api, count(*) AS n FROM documents")
def redact_counts(spark, sf_dir):
    d = texts(spark, sf_dir).select("text", T.redact(F.col("text")).alias("r"))
    has = lambda kind: F.count_if(F.regexp_count("r", F.lit(rf"\[REDACTED:{kind}\]")) > F.regexp_count("text", F.lit(rf"\[REDACTED:{kind}\]")))
    return d.agg(has("aws_key").alias("aws"), has("api_key").alias("api"), F.count("*").alias("n"))


@query("redaction_by_kind", f"WITH {redaction_sql()}, k AS (SELECT source, unnest(regexp_extract_all(r, '\\[REDACTED:(\\w+)\\]', 1)) AS kind, 1 AS n FROM red UNION ALL SELECT source, unnest(regexp_extract_all(text, '\\[REDACTED:(\\w+)\\]', 1)), -1 FROM red) SELECT source, kind, sum(n)::BIGINT AS n FROM k GROUP BY 1, 2 HAVING sum(n) > 0")
def redaction_by_kind(spark, sf_dir):
    d = texts(spark, sf_dir).select("source", "text", T.redact(F.col("text")).alias("r"))
    return d.select("source", F.explode(T.redaction_kinds(F.col("r"), F.col("text"))).alias("kind")).groupBy("source", "kind").agg(F.count("*").alias("n"))


@query("eval_recall", f"WITH {SEG_SQL}, gold AS (SELECT lang AS question, segment_id AS id FROM seg WHERE segment_id % 9 = 0), ranked AS (SELECT lang AS question, segment_id AS id, row_number() OVER (PARTITION BY lang ORDER BY started_at, segment_id) AS rank FROM seg QUALIFY rank <= 50), h AS (SELECT g.question, count(r.rank) AS found, count(*) AS wanted, max(CASE WHEN r.rank = 1 THEN 1 ELSE 0 END) AS first FROM gold g LEFT JOIN ranked r ON g.question = r.question AND g.id = r.id GROUP BY 1), k AS (SELECT *, CASE WHEN question IN ('en', 'de') THEN 'lookup' ELSE 'timeline' END AS kind FROM h) SELECT kind, count(*) AS questions, round(avg(found / wanted::DOUBLE), 6) AS recall, round(avg(first), 6) AS p_at_1 FROM k GROUP BY 1 UNION ALL SELECT 'overall', count(*), round(avg(found / wanted::DOUBLE), 6), round(avg(first), 6) FROM k")
def eval_recall(spark, sf_dir):
    from pyspark.sql import Window

    s = segs(spark, sf_dir).select(F.col("lang").alias("question"), F.col("segment_id").alias("id"), "started_at")
    ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("started_at", "id"))).where("rank <= 50")
    kinds = s.select("question").distinct().withColumn("kind", F.when(F.col("question").isin("en", "de"), "lookup").otherwise("timeline"))
    out = quality.evaluate(ranked, s.where("id % 9 = 0").select("question", "id"), kinds)
    return out.select("kind", "questions", F.round("recall", 6).alias("recall"), F.round("p_at_1", 6).alias("p_at_1"))


@query("round_robin_budget", "WITH g AS (SELECT user_id AS question, event_type AS bin, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rank_in_bin, 1 + event_id % 4 AS size FROM events), c AS (SELECT *, sum(size) OVER (PARTITION BY question ORDER BY rank_in_bin, bin ROWS UNBOUNDED PRECEDING) AS upto FROM g) SELECT question, bin, rank_in_bin, least(size, 20 - (upto - size))::BIGINT AS take FROM c WHERE 20 - (upto - size) > 0")
def round_robin_budget(spark, sf_dir):
    from pyspark.sql import Window

    g = read(spark, sf_dir, "events").select(F.col("user_id").alias("question"), F.col("event_type").alias("bin"), F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).cast("long").alias("rank_in_bin"), (1 + F.col("event_id") % 4).alias("size"))
    return quality.within_budget(g, 20).select("question", "bin", "rank_in_bin", "take")


@query("muted", "WITH l AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, isodow(ts) AS d FROM events) SELECT event_id FROM l WHERE (d <= 5 AND m >= 570 AND m < 600) OR (d = 5 AND m >= 1320) OR (d = 6 AND m < 360)")
def muted(spark, sf_dir):
    w = times.parse_mute_windows('[{"days": [1, 2, 3, 4, 5], "start": "09:30", "end": "10:00"}, {"days": [5], "start": "22:00", "end": "06:00"}]')
    e = read(spark, sf_dir, "events")
    return e.where(times.is_muted(F.col("ts").cast("timestamp"), w)).select("event_id")


@query("gate_queue", f"WITH {SEG_SQL} SELECT segment_id FROM sub WHERE source IN ('src1', 'src2') AND NOT (segment_id % 2 = 0 AND (segment_id % 100) / 100.0 < 0.42)")
def gate_queue(spark, sf_dir):
    s = segs(spark, sf_dir).withColumns({"enrich_text": F.lit(None).cast("string"), "gate_version": F.when(F.col("segment_id") % 2 == 0, "1"), "gate_p": (F.col("segment_id") % 100) / 100})
    policy = spark.createDataFrame([("src1", "narrative", "b"), ("src2", "narrative", "b"), ("src3", "narrative", None), ("src4", "telemetry", "b")], "source string, density string, bank string")
    return lifecycle.gate_queue(s, policy).select("segment_id")


@query("money", "SELECT o_orderkey, CASE WHEN contains(s, '.') THEN regexp_replace(s, '\\.?0+$', '') ELSE s END AS amount FROM (SELECT o_orderkey, o_totalprice::DECIMAL(18, 2)::DECIMAL(32, 12)::VARCHAR AS s FROM orders)")
def money(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", T.money(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))


@query("dump_lines", "SELECT 'doc:' || doc_id || chr(9) || regexp_replace(coalesce(text, ''), '[\\t\\n\\r]', ' ', 'g') AS line FROM documents")
def dump_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id"), F.lit("\t"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\n\r]", " ")).alias("line"))


@query("tally", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def tally(spark, sf_dir):
    read(spark, sf_dir, "events").createOrReplaceTempView("tally_events")
    return spark.sql("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM tally_events GROUP BY event_type")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
