"""Tables of the archive and the rules that rows must keep. There are no constraints in Parquet: violations() finds what breaks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "source string, source_id string, ts timestamp, kind string, actor string, text string, payload string, reply_to string, thread_key string, watermark_ts timestamp"
SEGMENT = "segment_id long, thread_key string, sources array<string>, source_event_ids array<string>, started_at timestamp, ended_at timestamp, event_count int, raw_text string, embed_text string, enrich_text string, topics array<string>, embedding array<float>, is_substantive boolean, segmenter_version string"
FACT = "fact_id long, subject_id long, predicate string, object string, polarity int, confidence double, version long, t_valid timestamp, t_invalid timestamp, t_created timestamp, t_expired timestamp, source_segment_id long, source_event_ids array<string>, extractor_version string"
COMMITMENT = "commitment_id long, text string, direction string, stated_at timestamp, due_at date, confidence double, status string, resolution_segment_id long, source_segment_id long, source_event_ids array<string>, extractor_version string"
ENTITY = "entity_id long, entity_type string, canonical_name string, aliases array<string>, phonetic_keys array<string>, skeleton_keys array<string>, mention_count long, first_seen_at timestamp, last_seen_at timestamp"
MENTION = "entity_id long, segment_id long, ts timestamp"
DEPENDENCY = "projection_kind string, projection_id long, source string, source_id string"
LIFE_EVENT = "life_event_id long, title string, started_at timestamp, ended_at timestamp, is_sensitive boolean, source_event_ids array<string>"

DENSITIES = ["narrative", "telemetry", "discrete", "ambient"]

#: Fact predicates, and whether a later value replaces an earlier one.
PREDICATES = [
    ("lives_in", True), ("works_at", True), ("job_title", True), ("studies_at", True), ("relationship", True),
    ("owns", False), ("likes", False), ("dislikes", False), ("plans", False), ("visited", False), ("bought", False),
    ("learned", False), ("uses", False), ("health", False), ("opinion", False), ("knows", False),
]


def violations(segments: DataFrame | None = None, facts: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame | None:
    """rule and key of every row that breaks a rule; each given table is scanned once."""
    checks = [
        (sources, "density", ~F.col("density").isin(DENSITIES) if sources is not None else None, "source"),
        (segments, "segment_time_order", F.expr("ended_at < started_at"), "segment_id"),
        (facts, "fact_valid_order", F.expr("t_invalid < t_valid"), "fact_id"),
        (facts, "fact_evidence_nonempty", F.expr("coalesce(size(source_event_ids), 0) = 0"), "fact_id"),
    ]
    found = [df.where(bad).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key")) for df, rule, bad, key in checks if df is not None]
    out = None
    for f in found:
        out = f if out is None else out.unionByName(f)
    return out
