"""The seven operations of the archive over registered tables, and SQL that only reads."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.text import question_window
from emberlog.operators import nearest, quality, search, views

LOG = logging.getLogger(__name__)
# Characters of a segment that answers hold (recall; for or against a claim; bins of time), and that a reranker is shown.
RETURNED, CLAIMED, BINNED, RERANKED = 2000, 1500, 800, 700

class NotAQuery(ValueError):
    pass


#: Functions that reach outside the tables they are given, by name; table functions are named the other way round.
FORBIDDEN_CALLS = {"reflect", "java_method", "try_reflect", "read_files", "input_file_name", "current_user", "session_user", "user"}
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}
#: Leaves of a parsed plan that read no table.
PLAIN_LEAVES = {"OneRowRelation", "UnresolvedInlineTable", "LocalRelation", "Range", "UnresolvedSubqueryColumnAliases"}


class Scope:
    """Walks a parsed plan and knows which names each part of it can see: a common table expression's body sees those
    before it and around it, never its own name, so a table of that name is judged as a table."""

    def __init__(self, spark: SparkSession, tables: list[str]):
        jvm = spark._jvm
        kind = lambda name: jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{name}")
        self.command = [kind("plans.logical.Command"), kind("plans.logical.ParsedStatement")]
        self.tables = {t.lower() for t in tables}

    def plan(self, node, names: frozenset = frozenset()) -> None:
        kind = node.getClass().getSimpleName()
        if any(c.isInstance(node) for c in self.command):
            raise NotAQuery("only queries are allowed")
        if "UnresolvedIdentifier" in kind:
            raise NotAQuery("names must be written out")
        if kind == "UnresolvedWith":
            for each in items(node.cteRelations()):
                self.plan(each._2(), names)
                names |= {each._1().lower()}
        if kind == "UnresolvedRelation":
            parts = [p.lower() for p in items(node.multipartIdentifier())]
            if len(parts) != 1 or not ({*parts} & (names | self.tables)):
                raise NotAQuery(f"unknown table: {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            if ".".join(items(node.name())).lower() not in TABLE_FUNCTIONS:
                raise NotAQuery("a function that reaches outside is not allowed")
        elif node.children().isEmpty() and kind not in PLAIN_LEAVES:
            raise NotAQuery(f"{kind} is not allowed")
        for e in items(node.expressions()):
            self.expression(e, names)
        for child in items(node.children()):
            self.plan(child, names)

    def expression(self, e, names: frozenset) -> None:
        kind = e.getClass().getSimpleName()
        if "UnresolvedIdentifier" in kind:
            raise NotAQuery("names must be written out")
        if kind == "UnresolvedFunction" and [*items(e.nameParts())][-1].lower() in FORBIDDEN_CALLS:
            raise NotAQuery("a function that reaches outside is not allowed")
        if hasattr_plan(e):
            self.plan(e.plan(), names)
        for child in items(e.children()):
            self.expression(child, names)


def items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def hasattr_plan(e) -> bool:
    """Whether an expression holds a query of its own."""
    return any(m.getName() == "plan" and m.getParameterCount() == 0 for m in e.getClass().getMethods())


def tally(spark: SparkSession, sql: str, views_allowed: list[str], timeout: float = 10.0, most: int = 200) -> tuple[str, list[dict]]:
    """The SQL and its first rows as strings. Its parsed plan must be one pure query over the given views; it is
    cancelled after timeout seconds."""
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:  # a parser's error is the question's fault
        raise NotAQuery(str(error).split("\n")[0]) from error
    Scope(spark, views_allowed).plan(parsed)
    tag = f"tally-{uuid.uuid4().hex}"
    spark.addTag(tag)
    timer = threading.Timer(timeout, lambda: spark.interruptTag(tag))
    timer.start()
    try:
        df = spark.sql(sql)
        names = [c if c not in df.columns[:k] else f"{c}_{k + 1}" for k, c in enumerate(df.columns)]
        rows = df.toDF(*(f"_{k}" for k in range(len(names)))).select(*[F.col(f"_{k}").cast("string").alias(c) for k, c in enumerate(names)]).limit(most).collect()
    finally:
        timer.cancel()
        spark.removeTag(tag)
    return sql, [r.asDict() for r in rows]


@dataclass
class Archive:
    """recall, first_mention, evolution, timeline, tally, commitments, ground over segments and events."""

    spark: SparkSession
    segments: DataFrame
    events: DataFrame
    commitments_table: DataFrame

    def recall(self, question: str, vector: list[float] | None = None, limit: int = 20, rerank: Callable[[str, list[str]], list[int]] | None = None, pool: int = 40, enrich: bool = False, index: str | None = None, vectors: nearest.Vectors | None = None, **filters) -> DataFrame:
        """id, score, ranks, text and started_at of the best segments; a year that the question names confines it.

        rerank(question, texts) gives places in a new order, the best first; it sees the first RERANKED characters of the best
        of max(limit, pool), and what it leaves out follows in the old order; if it fails, the old order stands. enrich fuses
        the enrichment's own list in. index and vectors: what is kept of this archive; filters may go with both.
        """
        if not filters.get("date_from") and not filters.get("date_to") and (span := question_window(question)):
            filters |= {"date_from": span[0], "date_to": span[1]}
        wide = max(limit, pool) if rerank else limit
        found = search.hybrid_search(self.segments, question, vector, n_final=wide, enrich_col="enrich_text" if enrich else None, index=index, vectors=vectors, **filters)
        texts = self.found_in(found).select(F.col("segment_id").alias("id"), F.substring("raw_text", 1, RETURNED).alias("text"), "started_at")
        out = found.join(texts, "id").orderBy(F.desc("score"), "id")
        if rerank is None:
            return out
        rows = out.collect()  # at most max(limit, pool) of them
        try:
            order = [rows[k]["id"] for k in rerank(question, [(r["text"] or "")[:RERANKED] for r in rows]) if 0 <= k < len(rows)]
        except Exception:  # a reranker that fails costs the new order, not the answer
            LOG.warning("the reranker failed; the order of the search stands", exc_info=True)
            order = []
        ranked = self.spark.createDataFrame([(*r, k + 1) for k, r in enumerate(rows)], out.schema.add("rank", "long"))
        return search.apply_ranking(ranked, order).limit(limit).drop("place", "rank")

    def found_in(self, found: DataFrame) -> DataFrame:
        """The segments of a search's few results by their ids as literals, which reach the scan, so that no text of others moves."""
        return self.segments.where(F.col("segment_id").isin([r["id"] for r in found.select("id").collect()]))

    def stats(self, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The sources' table with events, and one row: segments, embedded and enriched ones."""
        counted = self.events.groupBy("source").agg(F.count("*").alias("events"))
        has = lambda c: F.count_if(F.col(c).isNotNull()) if c in self.segments.columns else F.lit(0).cast("long")
        return sources.join(counted, "source", "left").withColumn("events", F.coalesce("events", F.lit(0))), self.segments.agg(F.count("*").alias("total"), has("embedding").alias("embedded"), has("enrich_text").alias("enriched"))

    def health(self) -> bool:
        """Whether the archive can be read at all."""
        self.events.limit(1).collect()
        return True

    def first_mention(self, term: str) -> DataFrame:
        return search.first_mention(self.events, [term.lower()])

    def evolution(self, vector: list[float], bin_seconds: int = 90 * 86400, per_bin: int = 10) -> DataFrame:
        """The nearest segments of each bin of time with the head of their text and their events, oldest bin first."""
        found = search.stratified_search(self.segments, vector, bin_seconds, per_bin)
        return self.quoted(found, BINNED).orderBy("bin_start", "rank_in_bin")

    def contradictions(self, claim: str, vector: list[float] | None = None, limit: int = 20, index: str | None = None, vectors: nearest.Vectors | None = None) -> DataFrame:
        """What speaks for or against a claim, in order of time: that a view changed shows in no order by score."""
        found = search.hybrid_search(self.segments, claim, vector, n_final=limit, index=index, vectors=vectors)
        return self.quoted(found, CLAIMED, self.found_in(found)).orderBy("started_at", "id")

    def quoted(self, found: DataFrame, most_chars: int, segments: DataFrame | None = None) -> DataFrame:
        """found (id ...) with started_at, the head of the text, and the events that it rests on where they are known."""
        segments = segments if segments is not None else self.segments
        events = F.col("source_event_ids") if "source_event_ids" in segments.columns else F.lit(None).cast("array<string>")
        return found.join(segments.select(F.col("segment_id").alias("id"), "started_at", F.substring("raw_text", 1, most_chars).alias("text"), events.alias("source_event_ids")), "id")

    def timeline(self, start: datetime, end: datetime, sources: list[str] | None = None) -> DataFrame:
        return search.timeline(self.segments, start, end, sources)

    def tally(self, sql: str) -> tuple[str, list[dict]]:
        return tally(self.spark, sql, [t.name for t in self.spark.catalog.listTables() if t.isTemporary])

    def commitments(self, days: int = 90, now: datetime | None = None) -> DataFrame:
        return views.forgotten_commitments(self.commitments_table, "created_at", F.lit(now or datetime.now(timezone.utc)), days)

    def ground(self, ids: list[int]) -> DataFrame:
        return search.ground(self.segments, ids)

    def freshness(self, now: datetime | None = None, sources: DataFrame | None = None) -> DataFrame:
        """Per source; those that sources (source, enabled) says are retired are not judged."""
        events = self.events
        if sources is not None:
            events = events.join(sources.where("enabled = false").select("source"), "source", "left_anti")
        return quality.freshness(events, "source", "ts", F.lit(now or datetime.now(timezone.utc)))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit in the given order."""
    return rows.orderBy(*order).offset(offset).limit(limit)
