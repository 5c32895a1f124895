"""Facts with world time and system time: what holds now or then, and how later facts end earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_facts(facts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest live positive fact of each subject and predicate."""
    live = facts.where("t_invalid is null and t_expired is null and polarity = 1")
    return live.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def best_fact(facts: DataFrame, keys: list[str], value: str, single: bool = True) -> DataFrame:
    """Of the valid facts the one of the greatest version, then confidence (for predicates with many values version
    alone), then value."""
    by = F.struct("version", "confidence", value) if single else F.struct("version", value)
    return facts.where("t_invalid is null").groupBy(*keys).agg(F.max_by(value, by).alias(value))


def resolve_conflicts(facts: DataFrame, predicates: DataFrame) -> DataFrame:
    """All facts; an earlier live one of a single-valued predicate ends where the next begins, never before it began."""
    live = F.expr("t_invalid is null and t_expired is null and single_valued")
    marked = facts.join(predicates.select("predicate", "single_valued"), "predicate", "left").withColumn("_live", F.coalesce(live, F.lit(False)))
    w = Window.partitionBy("subject_id", "predicate", "_live").orderBy("version", "fact_id")
    following = F.lead("t_valid").over(w)
    ended = F.when(F.col("_live") & following.isNotNull(), F.greatest(following, F.col("t_valid"))).otherwise(F.col("t_invalid"))
    return marked.withColumn("t_invalid", ended).drop("_live", "single_valued")


def invalidate_superseded(facts: DataFrame) -> DataFrame:
    """Every open fact ends where the next of its subject and predicate begins."""
    w = Window.partitionBy("subject_id", "predicate").orderBy("version", "fact_id")
    return facts.withColumn("t_invalid", F.coalesce("t_invalid", F.lead("t_valid").over(w)))


def facts_as_of(facts: DataFrame, at: Column) -> DataFrame:
    return facts.where((F.col("t_valid") <= at) & (F.col("t_invalid").isNull() | (F.col("t_invalid") > at)))


def promotable(facts: DataFrame, mentions: DataFrame, bankless: DataFrame, least_confidence: float = 0.7, least_segments: int = 3, least_threads: int = 2) -> DataFrame:
    """Live, unpromoted, confident facts whose subject is seen in enough segments and threads of sources with a bank.

    mentions: subject_id, segment_id, thread_key, source. bankless: source names that count for nothing, and whose
    evidence bars a fact (evidence_sources).
    """
    spread = mentions.join(bankless.select("source"), "source", "left_anti").groupBy("subject_id").agg(F.countDistinct("segment_id").alias("segments"), F.countDistinct("thread_key").alias("threads"))
    enough = spread.where((F.col("segments") >= least_segments) & (F.col("threads") >= least_threads))
    live = facts.where((F.col("confidence") >= least_confidence) & F.expr("t_invalid is null and t_expired is null and promoted_at is null"))
    barred = live.select("fact_id", F.explode("evidence_sources").alias("source")).join(bankless.select("source"), "source", "left_semi").select("fact_id")
    return live.join(barred, "fact_id", "left_anti").join(enough, "subject_id")
