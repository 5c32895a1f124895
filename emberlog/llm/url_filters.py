"""Operator 2 [native]: URL filters by a sort-merge range join with a stack of active nested rules.

A canonical key (host labels reversed, then the path) turns "this host and its subdomains" and "this path and what it
begins" into intervals of sorted strings. Intervals of prefixes nest or are disjoint, so a sweep in key order needs a
stack with one slot for each nesting level: a rule enters its level's slot, and is active for a key as long as it begins
the key. No other rule of its level can lie between a rule and a key that it begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import materialize, table

BREAK = "\x00"
#: Most (host, rule host) rows that are broadcast (some 100 bytes each); more are joined by shuffle, which adaptive
#: execution splits where one host is very common.
BROADCAST_HOSTS = 100_000


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if null or without ://."""
    rest = F.expr("substring({0}, locate('://', {0}) + 3)".format("url"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(url.contains("://"), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    rest = F.expr("substring({0}, locate('://', {0}) + 3)".format("url"))
    return F.when(url.contains("://"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def prefix_sweep(points: DataFrame, rules: DataFrame, levels: int) -> DataFrame:
    """points (key) and rules (key, level < levels, payload): key and stack, the payloads of the rules that begin key.

    points must be distinct; each row of the result is one of them. The union is dealt by key ranges. For each range
    and level the last rule of all earlier ranges is carried in as an extra row, a table of at most ranges x levels
    rows; after that each range is swept on its own, so no task sees more than its range however common a host is.
    """
    rule = F.struct(F.col("key").alias("from"), "payload").alias("rule")
    starts = rules.select("key", F.col("level").cast("int").alias("level"), rule)
    kind = dict(starts.dtypes)["rule"]
    queries = points.select("key", F.lit(None).cast("int").alias("level"), F.lit(None).cast(kind).alias("rule"))
    events = starts.unionByName(queries).repartitionByRange(F.col("key"), F.col("level").asc_nulls_last())
    # Written once: both uses below must see the same ranges.
    events = materialize(events.withColumn("range", F.spark_partition_id()))
    tails = events.where("level is not null").groupBy("range", "level").agg(F.max_by("rule", "key").alias("rule"))
    ranges = events.select("range").distinct()
    slots = ranges.crossJoin(F.broadcast(ranges.sparkSession.range(levels).select(F.col("id").cast("int").alias("level"))))
    earlier = Window.partitionBy("level").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.join(tails, ["range", "level"], "left").withColumn("rule", F.last("rule", ignorenulls=True).over(earlier)).where("rule is not null")
    rows = carried.select("range", F.lit(0).alias("carried_last"), F.lit("").alias("key"), "level", "rule").unionByName(events.withColumn("carried_last", F.lit(1)))
    sweep = Window.partitionBy("range").orderBy("carried_last", "key", F.col("level").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    slot = [F.last(F.when(F.col("level") == k, F.col("rule")), ignorenulls=True).over(sweep) for k in range(levels)]
    swept = rows.select("key", "level", "carried_last", F.array(*slot).alias("slots")).where("level is null")
    return swept.select("key", F.expr("transform(filter(slots, r -> r is not null and startswith(key, r.from)), r -> r.payload)").alias("stack"))


def url_filters(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    rules (host, path, verdict): a rule fits its host and all subdomains if the url's path starts with its path. The
    longest rule (host and path together, then the longer host) wins; of equal rules with different verdicts allow
    wins. Without a fitting rule rule is null and verdict is default. Null urls, urls without :// and empty tables of
    either kind are fine: host and path are then empty. Repeated rows are judged alike; other columns are not read.

    Work is done on distinct (host, path) pairs, pre-aggregated before the shuffle, so copies of a url cost nothing;
    the final join back is a plain equi join that adaptive execution can split where one url is very common.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    clean = rules.where("host is not null and host <> '' and path is not null and verdict is not null").select(F.lower("host").alias("host"), "path", "verdict")
    clean = clean.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(host_key(F.col("host")).alias("node"), "host", "path", "verdict")
    clean = materialize(clean)
    nodes = clean.select(F.col("node").alias("key"), (F.size(F.split("node", r"\.")) - 2).alias("level"), F.col("node").alias("payload")).distinct()
    # A rule's level among those of its host: how many of them begin its path.
    full = clean.withColumn("key", F.concat("node", F.lit(BREAK), "path"))
    begins = full.select("key", F.explode(F.expr("transform(sequence(0, length(path)), n -> concat(node, '\\0', substring(path, 1, n)))")).alias("other"))
    depth = begins.join(full.select(F.col("key").alias("other")), "other").groupBy("key").agg((F.count("*") - 1).alias("level"))
    payload = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    path_rules = full.join(depth, "key").select("key", "level", payload.alias("payload"))
    host_levels = (nodes.agg(F.max("level")).first()[0] or 0) + 1
    path_levels = (path_rules.agg(F.max("level")).first()[0] or 0) + 1

    pairs = materialize(urls.select("host", "path").distinct())
    hosts = pairs.select("host").distinct().select("host", host_key(F.col("host")).alias("key"))
    found = prefix_sweep(hosts.select("key"), nodes, host_levels).where(F.size("stack") > 0)
    active = materialize(hosts.join(found, "key").select("host", F.explode("stack").alias("node")))
    # A host with a third of all pages is many pairs: hosts under a rule go to them while their number allows it.
    keyed = pairs.join(F.broadcast(active) if active.count() <= BROADCAST_HOSTS else active, "host").select("host", "path", F.concat("node", F.lit(BREAK), "path").alias("key"))
    keyed = materialize(keyed)
    best = prefix_sweep(keyed.select("key").distinct(), path_rules, path_levels).where(F.size("stack") > 0).select("key", F.array_max("stack").alias("best"))
    judged = keyed.join(best, "key").groupBy("host", "path").agg(F.max("best").alias("best"))
    out = urls.join(judged, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the contract: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rules over all pages; nulls and repeats as url_filters has them."""
    one = lambda r: F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), r, strict=True)])
    rules = spark.range(1).select(F.inline(F.array(*map(one, RULES))))
    return url_filters(table(spark, sf_dir, "pages"), rules)


def oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rest = "substr(url, instr(url, '://') + 3)"
    return f"""
WITH rules(h, p, v) AS (VALUES {rules}),
u AS (SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
fit AS (SELECT DISTINCT host, path, max({{'n': length(h) + length(p), 'k': length(h), 'rule': h || p, 'v': v}}) AS b
    FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, u.host AS host, u.path AS path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict FROM u LEFT JOIN fit ON u.host = fit.host AND u.path = fit.path"""


QUERIES = {"op2_url_filters": op2_url_filters}
ORACLES = {"op2_url_filters": oracle()}
