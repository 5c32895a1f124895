"""Changes of state: guarded upserts, watermarks, refreshes, what an erasure would take. Each returns the new state of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import redact, redact_payload

KEY = ["source", "source_id", "ts"]


def upsert_events(state: DataFrame, incoming: DataFrame, redacted: bool = True) -> DataFrame:
    """state after incoming events, with change: new, updated, kept.

    Text and payload of a known event change only if the new text differs and is not empty; the newest of several
    incoming rows with one key counts. One full join on the key; write the years it touches by dynamic overwrite.
    """
    rows = incoming.withColumns({"text": redact(F.col("text")), **({"payload": redact_payload(F.col("payload"))} if "payload" in incoming.columns else {})}) if redacted else incoming
    newest = rows.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in KEY]), F.struct("watermark_ts", "text")).alias("i"))
    old = state.select(*KEY, F.struct(*[c for c in state.columns if c not in KEY]).alias("s"))
    both = old.join(newest, KEY, "full")
    changes = F.col("s").isNotNull() & ~F.col("s.text").eqNullSafe(F.col("i.text")) & (F.coalesce("i.text", F.lit("")) != "")
    change = F.when(F.col("s").isNull(), "new").when(changes, "updated").otherwise("kept")
    pick = lambda c: (F.when(F.col("s").isNull() | (changes if c in ("text", "payload") else F.lit(False)), F.col(f"i.{c}")).otherwise(F.col(f"s.{c}"))).alias(c)
    return both.select(*KEY, *[pick(c) for c in state.columns if c not in KEY], change.alias("change"))


def advance_watermarks(sources: DataFrame, batch: DataFrame) -> DataFrame:
    """last_ingested_at becomes the newest watermark of the batch, never an older one."""
    newest = batch.groupBy("source").agg(F.max("watermark_ts").alias("w"))
    return sources.join(newest, "source", "left").withColumn("last_ingested_at", F.greatest("last_ingested_at", "w")).drop("w")


def citing(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """segment_id of segments that cite one of the event keys (source, source_id): exploded ids, an equi join."""
    wanted = keys.select(F.concat_ws(":", "source", "source_id").alias("key")).distinct()
    return segments.select("segment_id", F.explode("source_event_ids").alias("key")).join(wanted, "key", "left_semi").select("segment_id").distinct()


def refresh_segments(segments: DataFrame, changed: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Segments that cite changed events take their rebuilt texts and lose what was derived from the old ones."""
    touched = citing(segments, changed)
    new = rebuilt.select("segment_id", F.col("raw_text").alias("_raw"), F.col("embed_text").alias("_embed"))
    out = segments.join(touched.withColumn("_t", F.lit(True)), "segment_id", "left").join(new, "segment_id", "left")
    t = F.coalesce("_t", F.lit(False))
    cleared = {c: F.when(~t, F.col(c)) for c in ("embedding", "enrich_text") if c in segments.columns}
    return out.withColumns({"raw_text": F.when(t, F.coalesce("_raw", "raw_text")).otherwise(F.col("raw_text")), "embed_text": F.when(t, F.coalesce("_embed", "embed_text")).otherwise(F.col("embed_text")), **cleared}).drop("_t", "_raw", "_embed")


def excluded_threads(chats: DataFrame, tags: DataFrame, explicit: list[str]) -> DataFrame:
    """thread ids that fetching leaves out: bots by name or tag, the service account, and explicit ones."""
    named = chats.where(F.endswith(F.lower(F.coalesce("username", F.lit(""))), F.lit("bot"))).select("chat_id")
    tagged = tags.where("tag = 'chat:bot'").select("chat_id")
    given = chats.sparkSession.createDataFrame([(int(x),) for x in [*explicit, 777000]], "chat_id long")
    return named.union(tagged).union(given).distinct()


def purge_preview(doomed: DataFrame, events: DataFrame, segments: DataFrame, facts: DataFrame) -> DataFrame:
    """How many events, segments and facts an erasure of threads (thread_key) takes."""
    gone = segments.join(doomed, "thread_key", "left_semi").select("segment_id")
    e = events.join(doomed, "thread_key", "left_semi").agg(F.count("*").alias("events"))
    f = facts.select("fact_id", F.explode("evidence").alias("segment_id")).join(gone, "segment_id", "left_semi").agg(F.countDistinct("fact_id").alias("facts"))
    return e.crossJoin(gone.agg(F.count("*").alias("segments"))).crossJoin(f)


def purge_counts(doomed: DataFrame, events: DataFrame, segments: DataFrame, mentions: DataFrame, facts: DataFrame, commitments: DataFrame) -> DataFrame:
    """kind, n: what an erasure of threads (thread_key) takes, in seven kinds, and what it opens again.

    facts, commitments (source_segment_id, and resolution_segment_id of those that a segment resolved), mentions
    (segment_id). One row a kind; an equi join each, counted where the rows are.
    """
    own = segments.join(doomed.distinct(), "thread_key", "left_semi")
    ids = own.select("segment_id")
    of = lambda rows, c: rows.join(ids.withColumnRenamed("segment_id", c), c, "left_semi")
    counts = [
        ("events", events.join(doomed.distinct(), "thread_key", "left_semi")), ("segments", own), ("embedded", own.where("embedding is not null")), ("entity_mentions", of(mentions, "segment_id")),
        ("facts", of(facts, "source_segment_id")), ("commitments", of(commitments, "source_segment_id")), ("commitments_resolved_by", of(commitments, "resolution_segment_id")),
    ]
    out = None
    for kind, rows in counts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def redaction_backfill(events: DataFrame) -> DataFrame:
    """Events whose text or payload a redaction changes, with the new ones; nothing else is rewritten."""
    payload = "payload" in events.columns
    out = events.withColumns({"redacted": redact(F.col("text")), **({"redacted_payload": redact_payload(F.col("payload"))} if payload else {})})
    changed = ~F.col("redacted").eqNullSafe(F.col("text"))
    return out.where(changed | ~F.col("redacted_payload").eqNullSafe(F.col("payload")) if payload else changed)


def gate_queue(segments: DataFrame, sources: DataFrame, threshold: float = 0.42, version: str = "1") -> DataFrame:
    """Segments to enrich: substantive, narrative, of a source with a bank, not yet enriched, and not scored below the
    threshold by this version of the gate."""
    own = F.col("source") == F.element_at("sources", 1)
    policy = sources.select("source", "density", "bank")  # one row a registered adapter
    rows = segments.join(policy, own).where("density = 'narrative' and bank is not null and coalesce(is_substantive, true) and enrich_text is null")
    scored: Column = F.coalesce((F.col("gate_version") == version) & (F.col("gate_p") < threshold), F.lit(False))
    return rows.where(~scored)
