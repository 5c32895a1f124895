"""Operator 9 [native]: canonical exact digests.

A text is normalised (NFKC), case-folded and its white space folded; the fingerprint is 128 bits of xxhash over that.
Inside a bucket of equal hashes the canonical bytes are compared: each bucket of two and more keeps its least and its
greatest text, and where these differ, texts that a hash collision put together get different fingerprints. Two
fingerprints are alike (1.0) if equal and else not (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import hex_of, materialize, table, total_bytes

#: Text in one range of ids, about; ranges are sorted one by one and may spill. Beyond MOST_RANGES they get longer.
RANGE_BYTES, MOST_RANGES = 4 << 20, 65_536
#: Most keys of buckets of two and more (16 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, runs of white space to one space, none at the ends. ICU does the first two in the JVM."""
    # Plain ASCII needs no tables: there NFKC changes nothing and case folding is lower-casing.
    plain = F.lower(text)
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)), F.lit(True))
    # Case folding can undo a composition; a second pass makes equal what is canonically equal.
    folded = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    base = F.when(F.octet_length(text) == F.length(text), plain).otherwise(folded)
    return F.btrim(F.regexp_replace(base, r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    return F.struct(F.xxhash64(canon).alias("low"), F.xxhash64(F.lit("wide"), canon).alias("high"))


def digest(text: Column) -> Column:
    """canon, low and high of a text, which is made canonical once."""
    return F.element_at(F.transform(F.array(canonical(text)), lambda c: F.struct(c.alias("canon"), wide_hash(c).alias("key"))), 1)


def colliding(keys: DataFrame, texts: DataFrame) -> DataFrame | None:
    """key, sha, place of texts whose bucket holds different bytes, numbered in order of their bytes; None, as nearly
    always, if there is no such bucket.

    keys: low and high of every text; texts: key and canon of the same. Only the texts of buckets with two rows and more
    are moved, and of these a task sends the least and the greatest of each bucket, so a text that a third of all
    documents share is two rows a task.
    """
    many = materialize(keys.groupBy("low", "high").count().where("count > 1").select("low", "high"))
    flat = texts.select("key.low", "key.high", "canon")
    shared = flat.join(F.broadcast(many) if many.count() <= BROADCAST_KEYS else many, ["low", "high"], "left_semi")
    odd = shared.groupBy("low", "high").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("low", "high")
    odd = materialize(odd)
    if not odd.head(1):
        return None
    members = flat.join(odd, ["low", "high"], "left_semi").distinct()
    placed = members.withColumn("place", F.row_number().over(Window.partitionBy("low", "high").orderBy("canon")))
    return materialize(placed.select(F.struct("low", "high").alias("key"), sha(F.col("canon")).alias("sha"), "place"))


def sha(canon: Column) -> Column:
    """Names a text where its place among colliding ones is looked up."""
    return F.unhex(F.sha2(canon, 256))


def fingerprint(row: Column, place: Column) -> Column:
    return F.concat(hex_of(row["low"], row["high"]), F.when(place > 1, F.concat(F.lit("-"), place)).otherwise(""))


def named(rows: DataFrame, odd: DataFrame | None, key: str, name_of: str, name: str) -> DataFrame:
    """rows with the fingerprint of the columns key and sha."""
    if odd is None:
        return rows.withColumn(name, fingerprint(F.col(key), F.lit(1)))
    marks = odd.select(F.col("key").alias(key), F.col("sha").alias(name_of), "place")
    return rows.join(marks, [key, name_of], "left").withColumn(name, fingerprint(F.col(key), F.coalesce("place", F.lit(1)))).drop("place")


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_chars, key and canon of every text (null: empty); one narrow pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), digest(text).alias("d")).select("doc_id", "n_chars", "d.key", "d.canon")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every whole text. Null texts are empty; null ids and repeated rows stay; an empty
    table gives an empty result; other columns are not read."""
    texts = digested(docs, id_col, text_col)
    rows = materialize(texts.select("doc_id", "n_chars", "key", sha(F.col("canon")).alias("sha")))
    odd = colliding(rows.select("key.low", "key.high"), texts)
    return named(rows, odd, "key", "sha", "fingerprint").select("doc_id", "n_chars", "fingerprint")


def bucket_of(bounds: list[int], ranges: int) -> Column:
    """How many of the sorted bounds are at most doc_id, by binary search. Nulls come before all, in ranges of their own
    by the text's hash (tie), from -1 down."""
    unsigned = F.col("tie").cast("double") / 2.0**64 + 0.5
    null = -1 - F.least(F.lit(ranges - 1), F.floor(unsigned * ranges)).cast("int")
    if not bounds:
        return F.when(F.col("doc_id").isNull(), null).otherwise(0)
    steps, reach = [], 1
    while reach <= len(bounds):
        steps.append(reach)
        reach *= 2
    array = F.lit(bounds)
    found = F.lit(0)
    step = lambda at, s: F.when((at + s <= len(bounds)) & (F.get(array, at + s - 1) <= F.col("doc_id")), at + s).otherwise(at)
    return F.when(F.col("doc_id").isNull(), null).otherwise(F.aggregate(F.array(*[F.lit(s) for s in reversed(steps)]), found, step))


def with_next(texts: DataFrame, ranges: int) -> DataFrame:
    """Each row of (doc_id, text) with key, canon, next_text and next_key: the row after it in descending doc_id, nulls
    last, after the last the first. Rows of one id are ordered by their hash.

    Ids are cut into ranges at approximate quantiles. The first row of each range (a table of one row a range) is also
    given to the range before it, so that ranges can be worked on apart; texts are shuffled once.
    """
    spark = texts.sparkSession
    quantiles = texts.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None
    bounds = sorted(set(quantiles or []))
    ranged = texts.withColumn("tie", F.xxhash64("text")).withColumn("range", bucket_of(bounds, ranges).cast("int"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect()  # one id a range: twice the ranges at most
    heads = sorted(heads, key=lambda r: -r["range"])
    # Range r ends where the next lower one begins; the lowest ends where the highest begins.
    links = [(heads[(k + 1) % len(heads)]["range"], heads[(k + 1) % len(heads)]["doc_id"], heads[k]["range"]) for k in range(len(heads))]
    link = F.broadcast(spark.createDataFrame(links, "head_range int, head_id long, range int"))
    first = ranged.withColumnRenamed("range", "own").join(link, (F.col("own") == F.col("head_range")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    first = first.withColumn("rn", F.row_number().over(Window.partitionBy("range").orderBy("tie"))).where("rn = 1")
    columns = ["range", "doc_id", "tie", "text"]
    rows = ranged.select(*columns, F.lit(0).alias("guest")).unionByName(first.select(*columns, F.lit(1).alias("guest")))
    w = Window.partitionBy("range").orderBy("guest", *order)
    # Dealt out first, so that a text is made canonical once and its canonical form does not travel.
    rows = rows.repartition("range").withColumn("d", digest(F.col("text"))).select("*", "d.key", "d.canon").drop("d")
    out = rows.withColumns({"next_text": F.lead("text").over(w), "next_key": F.lead("key").over(w)})
    return out.where("guest = 0")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness to those and to the next document's.

    Edited text: the last third (rounded down) of the code points replaced by as many first ones (or all) of the next
    document in descending doc_id. An only document is its own next. Null texts are empty, null ids come last and
    repeated rows each get a row; an empty table gives an empty result; other columns are not read.
    """
    ranges = max(64, min(MOST_RANGES, total_bytes(docs, text_col) // RANGE_BYTES))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    k = (F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - k), F.substring("next_text", F.lit(1), k))
    whole = with_next(texts, ranges).withColumn("edited", edited)
    # Equal keys are held against the bytes right here; the next text is made canonical only where its key is the same.
    same_next = F.when(F.col("key") == F.col("next_key"), F.col("canon") == canonical(F.col("next_text"))).otherwise(False)
    rows = whole.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "key", sha(F.col("canon")).alias("sha"), digest(F.col("edited")).alias("e"), same_next.alias("same_next"))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", "key", "sha", F.col("e.key").alias("edited_key"), sha(F.col("e.canon")).alias("edited_sha"), F.col("e.canon").alias("edited_canon"), "same_next")
    # Edited texts are written down for the comparison; the documents' own are made canonical again from the table.
    rows = materialize(rows, compression="zstd")
    keys = rows.select("key.low", "key.high").unionByName(rows.select("edited_key.low", "edited_key.high"))
    texts = digested(docs, id_col, text_col).select("key", "canon").unionByName(rows.select(F.col("edited_key").alias("key"), F.col("edited_canon").alias("canon")))
    odd = colliding(keys, texts)
    out = named(named(rows.drop("edited_canon"), odd, "key", "sha", "fingerprint"), odd, "edited_key", "edited_sha", "edited_fingerprint")
    near = (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near.alias("near_edited"), F.col("same_next").cast("double").alias("near_next"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op9_fingerprints": op9_fingerprints}
ORACLES: dict[str, str] = {}
