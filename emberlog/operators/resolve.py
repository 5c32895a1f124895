"""Which known entities a name may mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(mentions: DataFrame, entities: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """id, cand, tier: entities with the same phonetic key (1) or skeleton of two characters and more (2); the first
    tier of a pair counts. scope (id, cand) keeps only pairs that share a chat."""
    one = mentions.join(entities, "ph").select("id", "cand", F.lit(1).alias("tier"))
    two = mentions.where(F.length("sk") >= 2).join(entities, "sk").select("id", "cand", F.lit(2).alias("tier"))
    out = one.unionByName(two).groupBy("id", "cand").agg(F.min("tier").alias("tier"))
    return out.join(scope, ["id", "cand"], "left_semi") if scope is not None else out
