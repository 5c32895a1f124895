"""What a step leaves on disk when it is done."""

from pyspark.sql import functions as F

from emberlog.llm import common, jaccard_join


def shuffle_files(spark) -> set[str]:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {blocks.apply(k).toString() for k in range(blocks.size()) if blocks.apply(k).isShuffle()}


def test_a_written_table_keeps_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = common.materialize(spark.range(1000).repartition(3).groupBy(F.col("id") % 7).count())
    assert rows.count() == 7 and spark.conf.get(common.CLEANUP) == "false"
    own = {x for x in shuffle_files(spark) - before if not x.endswith(".index")}
    rows = common.materialize(rows.repartition(3))
    assert rows.count() == 7 and len(own) <= 4, own  # only count()'s own may be left


def test_near_duplicates_leave_neither_sets_nor_pairs(spark, monkeypatch):
    made, dropped = [], []
    keep, drop = common.materialize, common.drop_scratch
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, *a: made.append(keep(df, *a)) or made[-1])
    monkeypatch.setattr(jaccard_join, "drop_scratch", lambda s, df: dropped.append(df.columns) or drop(s, df))
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join([*words[:-1], f"x{k}"])) for k in range(6)] + [(9, "alone and nothing like the others at all")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 9: 9}
    assert [c for c in dropped if "hashes" in c] and [c for c in dropped if c == ["bucket", "node", "n"]]
    assert len(dropped) >= len([m for m in made if "sketch" in m.columns or "bucket" in m.columns])
