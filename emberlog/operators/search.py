"""Ranked retrieval: exact vectors, rare-term scores and their fusion; earliest mentions; bins of time; timelines."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from math import ceil, log
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from emberlog.functions.text import let, lexemes, tokens, unaccent
from emberlog.functions.times import bin_start, recency_factor
from emberlog.functions.vectors import cosine_distance
from emberlog.store import keep, kept

RARE = 0.05
CALLS = ThreadPoolExecutor(8, "search")


def restrict(segments: DataFrame, date_from: datetime | None = None, date_to: datetime | None = None, threads: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """Both date bounds are inclusive and test started_at; a filter that is not given is not in the plan."""
    if date_from is not None:
        segments = segments.where(F.col("started_at") >= F.lit(date_from))
    if date_to is not None:
        segments = segments.where(F.col("started_at") <= F.lit(date_to))
    if threads is not None:
        segments = segments.where(F.col("thread_key").isin(threads))
    if sources is not None:
        segments = segments.where(F.arrays_overlap("sources", F.array(*map(F.lit, sources))))
    return segments


def substantive(segments: DataFrame) -> DataFrame:
    """What ranked search looks at: not the segments that hold too little."""
    return segments.where(F.coalesce("is_substantive", F.lit(True))) if "is_substantive" in segments.columns else segments


def postings(segments: DataFrame, id_col: str, text_col: str, *more: str, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """lexeme, id and more: one row for each distinct lexeme of a substantive segment."""
    return substantive(segments).select(F.explode(lexemes(F.col(text_col), stem)).alias("lexeme"), F.col(id_col).alias("id"), *more)


def lexeme_df(segments: DataFrame, id_col: str, text_col: str, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    return postings(segments, id_col, text_col, stem=stem).groupBy("lexeme").agg(F.count("*").alias("df"))


#: What filters ask about; kept beside each posting and vector.
FILTERED = ["started_at", "thread_key", "sources"]


def keep_index(segments: DataFrame, name: str, id_col: str = "segment_id", text_col: str = "raw_text", buckets: int | None = None, stem: Callable[[Column], Column] | None = None) -> None:
    """Write what questions need, once for each state of the archive, as tables or, if name is a path, under it:
    name_postings (bucket, lexeme, id and the FILTERED columns that there are), in folders by bucket (a folder for 10,000
    segments unless buckets says otherwise), sorted by lexeme and time, and name_df (bucket, lexeme, df); bucket -1 of it
    holds the number of substantive segments and, under the empty lexeme, that of buckets.

    A question reads the folders of its own terms, and of those only the row groups whose terms, times and threads can
    fit. Lexemes of 5 % of the segments and more rank nothing and have no postings, so none makes a hot folder; what is
    left is dealt by folder and, where one is large, by lexeme within it, so that a task sorts about POSTS_A_TASK postings
    once, however many there are. Texts are cut into lexemes once; stem (stems.stems, or one of your own) is part of the
    index: Index must be given the same.
    """
    spark = segments.sparkSession
    own = [c for c in FILTERED if c in segments.columns]
    held = substantive(segments).select(lexemes(F.col(text_col), stem).alias("lexemes"), F.col(id_col).alias("id"), *own)
    held.persist(StorageLevel.DISK_ONLY)  # memory is for the sort
    try:
        n = held.count()
        buckets = buckets or min(MOST_BUCKETS, 1 + n // 10_000)
        sizes = spark.sql(f"select * from values (-1, cast(null as string), {n}l), (-1, '', {buckets}l) as t(bucket, lexeme, df)")
        posts = held.select(F.explode("lexemes").alias("lexeme"), "id", *own)
        counts = posts.groupBy("lexeme").agg(F.count("*").alias("df")).withColumn("bucket", bucket_of(F.col("lexeme"), buckets)).select("bucket", "lexeme", "df")
        keep(counts.repartition("bucket").sortWithinPartitions("bucket", "lexeme").unionByName(sizes).write.partitionBy("bucket"), f"{name}_df")
        rare = kept(spark, f"{name}_df").where((F.col("bucket") >= 0) & (F.col("df") < RARE * n)).agg(F.sum("df")).first()[0] or 0
        parts = max(1, ceil(rare / buckets / POSTS_A_TASK))
        # As many lexemes as 20 segments hold on average, at most.
        common = kept(spark, f"{name}_df").where((F.col("bucket") >= 0) & (F.col("df") >= RARE * n)).select("lexeme")
        dealt = posts.join(F.broadcast(common), "lexeme", "left_anti")
        # A row of no lexeme, so that an index without postings is a table all the same. It comes before the sort, as rows that lose their order are sorted again when they are written.
        nothing = spark.sql("select cast(null as string) as lexeme").select("lexeme", *[F.lit(None).cast(k).alias(c) for c, k in dealt.dtypes if c != "lexeme"])
        bucket = F.coalesce(bucket_of(F.col("lexeme"), buckets), F.lit(-1))
        dealt = dealt.unionByName(nothing).repartitionById(buckets * parts, F.greatest(bucket, F.lit(0)) * parts + F.coalesce(part_of(F.col("lexeme"), buckets, parts), F.lit(0)))
        dealt = dealt.withColumn("bucket", bucket).sortWithinPartitions("bucket", "lexeme", *own[:1], "id")
        keep(dealt.write.partitionBy("bucket").option("compression", "zstd"), f"{name}_postings")
    finally:
        held.unpersist()


MOST_BUCKETS = 4096
#: Some 70 MB while they are sorted.
POSTS_A_TASK = 500_000


def bucket_of(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(lexeme.cast("binary")), F.lit(buckets)).cast("int")


def part_of(lexeme: Column, buckets: int, parts: int) -> Column:
    """Which of the parts of its bucket a lexeme goes to; a lexeme is in one."""
    return F.pmod(F.floor(F.crc32(lexeme.cast("binary")) / buckets), F.lit(parts)).cast("int")


class Index:
    """A kept index by its name, with the stemmer it was kept with; how much it holds is read once."""

    def __init__(self, spark: SparkSession, name: str, stem: Callable[[Column], Column] | None = None):
        self.stem = stem
        self.spark, self.df, self.postings = spark, kept(spark, f"{name}_df"), kept(spark, f"{name}_postings")
        sizes = dict(self.df.where("bucket = -1").select("lexeme", "df").collect())
        self.n, self.buckets = sizes[None], sizes[""]

    def of(self, rows: DataFrame, words: list[str]) -> DataFrame:
        own = sorted({crc32(w.encode()) % self.buckets for w in words})
        return rows.where(F.col("bucket").isin(own) & F.col("lexeme").isin(words))

    def frequencies(self, words: list[str]) -> dict[str, int]:
        return dict(self.of(self.df, words).select("lexeme", "df").collect()) if words else {}


def question_terms(spark: SparkSession, question: str, stem: Callable[[Column], Column] | None = None) -> list[str]:
    """The distinct tokens of a question, by the same analyzer as the texts'; folded while planned, without a job."""
    one = spark.sql("select * from values (:q) as t(q)", {"q": question})
    return list(dict.fromkeys(one.select(tokens(F.col("q"), stem=stem)).collect()[0][0] or []))


def matches(segments: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """lexeme, id of the given terms only: whole words looked up in each text, without cutting it into words."""
    clean = F.lower(unaccent(F.col(text_col)))
    edge = r"[\p{L}\p{N}_]"
    found = lambda t, c: F.when(F.contains(c, F.lit(t)) & c.rlike(f"(?<!{edge})\\Q{t}\\E(?!{edge})"), F.lit(t))
    hits = let(clean, lambda c: F.array_compact(F.array(*[found(t, c) for t in terms]) if terms else F.array().cast("array<string>")))
    return segments.select(F.explode(hits).alias("lexeme"), F.col(id_col).alias("id"))


def kept_terms(question: str, df: DataFrame, n: int, unknown_as_rare: bool = False) -> DataFrame:
    """lexeme, idf of the question's terms that fewer than 5 % of the segments hold; bounded by the question."""
    terms = df.sparkSession.range(1).select(F.explode(F.array_distinct(tokens(F.lit(question)))).alias("lexeme"))
    found = terms.join(df, "lexeme", "left" if unknown_as_rare else "inner")
    count = F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)) if unknown_as_rare else F.col("df")
    return found.where(count < RARE * n).select("lexeme", F.log(F.lit(float(n)) / count).alias("idf"))


def top_ranked(scored: DataFrame, order: list[Column], k: int, rank: str) -> DataFrame:
    """Top k first, then ranks from 1 over those k rows only."""
    top = scored.orderBy(*order).limit(k)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def lexical_topk(posts: DataFrame, terms: DataFrame, k: int = 100) -> DataFrame:
    """id, score (sum of idf over distinct matched terms), lex_rank. The terms are a question's: small, broadcast."""
    scored = posts.join(F.broadcast(terms), "lexeme").groupBy("id").agg(F.sum("idf").alias("score"))
    return top_ranked(scored.withColumn("order_score", F.round("score", 9)), [F.desc("order_score"), F.asc("id")], k, "lex_rank").select("id", "score", "lex_rank")


def dense_rows(segments: DataFrame, id_col: str, vector: list[float], k: int, vector_col: str = "embedding") -> DataFrame:
    """id, distance of the k nearest by exact cosine distance, in order."""
    q = F.lit(np.array(vector, np.float64))
    scored = segments.select(F.col(id_col).alias("id"), cosine_distance(F.col(vector_col), q).alias("distance")).where("distance is not null")
    return scored.withColumn("o", F.round("distance", 9)).orderBy("o", "id").limit(k).drop("o")


def dense_topk(segments: DataFrame, id_col: str, vector: list[float], k: int = 100, vector_col: str = "embedding") -> DataFrame:
    """id, distance, dense_rank of substantive segments by exact cosine distance."""
    top = dense_rows(substantive(segments), id_col, vector, k, vector_col)
    return top.withColumn("dense_rank", F.row_number().over(Window.orderBy(F.round("distance", 9), "id")).cast("long"))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """id, score = sum of 1 / (k + rank) over lists of (id, rank); a missing rank adds nothing."""
    every = lists[0].toDF("id", "rank")
    for more in lists[1:]:
        every = every.unionByName(more.toDF("id", "rank"))
    return every.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def term_hits(segments: DataFrame, words: list[str], id_col: str, text_col: str, kept: Column) -> DataFrame:
    """id, hits (places in words of those that a text holds), kept: one row a segment, texts read once."""
    clean = F.lower(unaccent(F.col(text_col)))
    edge = r"[\p{L}\p{N}_]"
    found = lambda k, t, c: F.when(F.contains(c, F.lit(t)) & c.rlike(f"(?<!{edge})\\Q{t}\\E(?!{edge})"), F.lit(k))
    hits = let(clean, lambda c: F.array_compact(F.array(*[found(k, t, c) for k, t in enumerate(words)]) if words else F.array().cast("array<int>")))
    return segments.select(F.col(id_col).alias("id"), hits.alias("hits"), kept.alias("kept"))


def best_hits(hits: DataFrame, weights: list[float | None], k: int) -> list[int]:
    """The ids of the k best by the summed weights of what they hold; words without a weight count for nothing."""
    table = F.array(*[F.lit(w or 0.0) for w in weights]) if weights else F.array().cast("array<double>")
    score = F.aggregate("hits", F.lit(0.0), lambda a, i: a + F.get(table, i))
    scored = hits.where("kept").select("id", F.round(score, 9).alias("score")).where("score > 0")
    return [r["id"] for r in scored.orderBy(F.desc("score"), "id").limit(k).collect()]


def filter_of(segments: DataFrame, date_from: datetime | None = None, date_to: datetime | None = None, threads: list[str] | None = None, sources: list[str] | None = None) -> Column:
    """restrict() as a condition; columns that it does not need may be missing."""
    out = F.lit(True)
    if date_from is not None:
        out &= F.col("started_at") >= F.lit(date_from)
    if date_to is not None:
        out &= F.col("started_at") <= F.lit(date_to)
    if threads is not None:
        out &= F.col("thread_key").isin(threads)
    if sources is not None:
        out &= F.arrays_overlap("sources", F.array(*map(F.lit, sources)))
    return F.coalesce(out, F.lit(False))


#: Postings that are scored where the question was asked; beyond, by a job, and from AT_ONCE on the rarest terms' first.
AT_HAND, AT_ONCE = 1 << 16, 5_000_000


def best_postings(posts: DataFrame, idf: dict[str, float], df: dict[str, int], k: int, at_once: int = AT_ONCE) -> list[int]:
    """The ids of the k best by the summed idf of their lexemes, from postings (lexeme, id), each once.

    A few postings are added up at once. Of many, terms are taken from the rarest on. As soon as the k-th best score so far is above what all terms that are left add up to,
    no segment without one of the terms so far can be among the best: the common terms' postings are then read for those
    that still can be, and not ranked as a whole.
    """
    order = sorted(idf, key=lambda t: (-idf[t], t))
    weight = lambda some: F.coalesce(*[F.when(F.col("lexeme") == t, F.lit(idf[t])) for t in some])
    scored = lambda some, rows: rows.where(F.col("lexeme").isin(some)).groupBy("id").agg(F.sum(weight(some)).alias("score"))
    best = lambda rows: [r["id"] for r in rows.select("id", F.round("score", 9).alias("o")).orderBy(F.desc("o"), "id").limit(k).collect()]
    if order and sum(df[t] for t in order) <= AT_HAND:
        got = posts.where(F.col("lexeme").isin(order)).select("lexeme", "id").toArrow()
        score: dict = {}
        for t, i in zip(got.column("lexeme").to_pylist(), got.column("id").to_pylist(), strict=True):
            score[i] = score.get(i, 0.0) + idf[t]
        return sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]
    upto, total = 0, 0
    while upto < len(order):
        while upto < len(order) and (total + df[order[upto]] <= at_once or total == 0):
            total, upto = total + df[order[upto]], upto + 1
        first, rest = order[:upto], order[upto:]
        if not rest:
            break
        more = sum(idf[t] for t in rest)
        so_far = scored(first, posts)
        tail = so_far.orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("least"), F.count("*").alias("n")).first()
        if tail["n"] == k and tail["least"] > more + 1e-8:
            able = so_far.where(F.col("score") + more >= tail["least"] - 1e-8)
            extra = scored(rest, posts.join(able.select("id"), "id", "left_semi"))
            return best(able.join(extra.withColumnRenamed("score", "more"), "id", "left").select("id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")))
        total = 0
    return best(scored(order, posts)) if order else []


def hybrid_search(segments: DataFrame, question: str, vector: list[float] | None, n_candidates: int = 100, n_final: int = 20, rrf_k: int = 60, id_col: str = "segment_id", text_col: str = "raw_text", enrich_col: str | None = None, df: DataFrame | None = None, n: int | None = None, index: Index | str | None = None, vectors=None, **filters) -> DataFrame:
    """id, score, dense_rank, lex_rank of the n_final best by fused ranks. Without frequencies it is dense only, and
    without a vector lexical only; never a recency prior.

    segments is the whole archive; filters (date_from, date_to, threads, sources) say what may be found in it. Only
    substantive segments are ranked, and frequencies are always those of all substantive segments. index: a kept
    index (keep_index) or its name; without one, texts are searched for the question's terms in one pass, from which
    frequencies and scores both come. vectors: kept vectors (nearest.Vectors); without them all are compared.

    A list holds n_candidates ids, and they are fused where the question was asked.
    """
    spark = segments.sparkSession
    own = substantive(segments)
    kept_rows = filter_of(segments, **filters)
    near = None
    if vector is not None:  # beside the words, as both are short jobs that wait for each other's tasks
        near = CALLS.submit(lambda: [r["id"] for r in (vectors.nearest(vector, n_candidates, **filters) if vectors is not None else dense_rows(own.where(kept_rows), id_col, vector, n_candidates)).collect()])
    index = Index(spark, index) if isinstance(index, str) else index
    words = question_terms(spark, question, index.stem if index is not None else None)
    known = dict(df.where(F.col("lexeme").isin(words)).collect()) if df is not None else None
    if index is not None:
        known = known if known is not None else index.frequencies(words)
        n = n if n is not None else index.n
        idf = {t: log(n / known[t]) for t in words if t in known and known[t] < RARE * n}
        lexical = best_postings(index.of(index.postings, [*idf]).where(kept_rows), idf, known, n_candidates) if idf else []
    else:
        hits = term_hits(own, words, id_col, text_col, kept_rows).persist()
        try:
            if known is None or n is None:
                counted = hits.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("hits", k)).alias(f"_{k}") for k in range(len(words))]).first()
                n = n if n is not None else counted["n"]
                known = known if known is not None else {t: counted[f"_{k}"] for k, t in enumerate(words) if counted[f"_{k}"]}
            idf = {t: log(n / known[t]) for t in words if t in known and known[t] < RARE * n}
            lexical = best_hits(hits, [idf.get(t) for t in words], n_candidates) if idf else []
        finally:
            hits.unpersist()
    dense = near.result() if near is not None else []
    enriched: list[int] = []
    if enrich_col is not None and n:
        rare = {t: log(n / max(1, known.get(t, 1))) for t in words if known.get(t, 1) < RARE * n}
        extra = term_hits(own.where(F.col(enrich_col).isNotNull()), words, id_col, enrich_col, kept_rows)
        enriched = best_hits(extra, [rare.get(t) for t in words], n_candidates) if rare else []
    score: dict[int, float] = {}
    for ids in (dense, lexical, enriched):
        for rank, i in enumerate(ids, 1):
            score[i] = score.get(i, 0.0) + 1.0 / (rrf_k + rank)
    rank = lambda ids: {i: r for r, i in enumerate(ids, 1)}
    by_vector, by_word = rank(dense), rank(lexical)
    best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:n_final]
    kind = dict(segments.dtypes)[id_col]
    return few_rows(spark, [(i, score[i], by_vector.get(i), by_word.get(i)) for i in best], f"id {kind}, score double, dense_rank bigint, lex_rank bigint")


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A handful of rows of numbers as literals in the plan, so that reading them needs no job; others as a table."""
    columns = [c.split(" ") for c in schema.split(", ")]
    if any(isinstance(v, str) for r in rows for v in r):
        return spark.createDataFrame(rows, schema)
    told = lambda v, kind: f"cast({'null' if v is None else repr(v)} as {kind})"
    values = ", ".join(f"({', '.join(told(v, k) for v, (_, k) in zip(r, columns, strict=True))})" for r in rows or [(None,) * len(columns)])
    return spark.sql(f"select * from values {values} as t({', '.join(c for c, _ in columns)}){'' if rows else ' where false'}")


def phrase_in(text: Column, phrase: str) -> Column:
    """The phrase's tokens one after the other."""
    padded = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    want = F.concat(F.lit(" "), F.array_join(tokens(F.lit(phrase)), " "), F.lit(" "))
    return (F.length(F.trim(want)) > 0) & F.contains(padded, want)


def first_mention(events: DataFrame, patterns: list[str], n: int = 20, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The n earliest events that hold a pattern as a phrase or, ignoring case, as a substring (no wildcards)."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | phrase_in(F.col(text_col), p) | F.contains(F.lower(text_col), F.lit(p.lower()))
    return events.where(hit).orderBy("ts", *(order or ["source", "source_id"])).limit(n)


def stratified_search(segments: DataFrame, vector: list[float], bin_seconds: int, per_bin: int = 10, id_col: str = "segment_id", vector_col: str = "embedding", ts_col: str = "started_at") -> DataFrame:
    """bin_start, id, distance, rank_in_bin: the nearest per_bin substantive segments of each bin of time."""
    q = F.lit(np.array(vector, np.float64))
    scored = substantive(segments).select(bin_start(F.col(ts_col), bin_seconds).alias("bin_start"), F.col(id_col).alias("id"), cosine_distance(F.col(vector_col), q).alias("distance")).where("distance is not null")
    w = Window.partitionBy("bin_start").orderBy(F.round("distance", 9), "id")
    return scored.withColumn("rank_in_bin", F.row_number().over(w).cast("long")).where(F.col("rank_in_bin") <= per_bin)


def timeline(segments: DataFrame, start: datetime, end: datetime, sources: list[str] | None = None, most_chars: int = 300) -> DataFrame:
    """Substantive segments that start in the closed interval, oldest first, without limit."""
    found = substantive(restrict(segments, start, end, None, sources))
    return found.withColumn("text", F.substring("raw_text", 1, most_chars)).orderBy("started_at", "segment_id")


def ground(segments: DataFrame, ids: list[int], most_chars: int = 2000) -> DataFrame:
    return segments.where(F.col("segment_id").isin(ids)).withColumn("text", F.substring("raw_text", 1, most_chars))


def cheap_signals(candidates: DataFrame, recency: bool = False) -> DataFrame:
    """score times small boosts: mentions (to 10) up to 10 %, graph distance (to 3) up to 15 %, importance up to 10 %,
    a shared participant a quarter; recency only if asked for."""
    boost = 1 + 0.10 * F.least(F.coalesce("mentions", F.lit(0)), F.lit(10)) / 10
    boost = boost * (1 + 0.15 * (1 - F.least(F.coalesce("distance", F.lit(3)), F.lit(3)) / 3))
    boost = boost * (1 + 0.10 * F.coalesce("importance", F.lit(0.0)) / 10)
    boost = boost * F.when(F.coalesce("participant", F.lit(False)), 1.25).otherwise(1.0)
    if recency:
        boost = boost * recency_factor(F.col("age_days"))
    return candidates.withColumn("boosted", F.col("score") * boost)


def apply_ranking(candidates: DataFrame, order: list[int], id_col: str = "id", rank_col: str = "rank") -> DataFrame:
    """Candidates in a given order of ids: those first (repeats and unknown ids ignored), the rest in their own order."""
    given = list(dict.fromkeys(order))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, given)) if given else F.array().cast("array<long>"), F.col(id_col)), F.lit(0)), F.lit(len(given) + 1) + F.col(rank_col))
    return candidates.withColumn("place", place).orderBy("place", id_col)
