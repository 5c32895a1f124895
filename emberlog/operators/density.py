"""Density clusters of points on a plane, by cells: no user's points meet in one task, and no pairs within a cell are made.

Cells are so small that the points of one are all near each other: a cell with enough points is one node of core points,
however many they are. Only points of thin cells are compared one by one, and cells next to each other by the boxes around
their points, then by boxes of parts of them, and only where these leave it open by points.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.store import written

#: Parts of a cell in each direction for the second look.
PARTS = 8
#: Links up to which components are found where the job was called from: some 20 MB of names.
AT_HAND = 100_000
#: Cells of a tile in each direction: neighbours are looked for by tile, and a cell lies within reach of four tiles at most.
TILE = 4
#: Cells of a field in each direction: links within a field are joined in one place first, links between fields after.
FIELD = 64
CELL = ["g", "a", "b"]


def joined_roots(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(node, least node of its component) of a few links."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in root]


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node that it is linked to, over any number of links) of links (x, y), whichever way round.

    Few links are joined at once; many in rounds, in each of which every node's larger neighbours are linked to the least
    one it knows, and then its smaller ones, until nothing moves: about as many rounds as the length of a chain has digits.
    """
    spark = links.sparkSession
    links = written(links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    if links.limit(AT_HAND + 1).count() <= AT_HAND:
        return spark.createDataFrame(joined_roots([tuple(r) for r in links.collect()]), "node string, root string")
    mark = lambda rows: tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
    before = mark(links)
    while True:
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.min("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        small = large.groupBy("x").agg(F.min("y").alias("m"))
        moved = large.join(small, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionByName(small.select("x", F.col("m").alias("y")))
        links = written(moved.distinct(), "links")
        after = mark(links)
        if after == before:
            return links.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(links.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
        before = after


def contracted(links: DataFrame) -> DataFrame:
    """node, root of links (x, hx, y, hy) between nodes of the fields hx and hy: as components gives them.

    A field has so few cells, and so few nodes, that all links within it are joined at once, several fields together;
    only links from one field to another go through the rounds, between what their fields have made of their ends.
    """
    links = written(links, "links")
    inner, outer = links.where("hx = hy"), links.where("hx <> hy")
    groups = -(-inner.count() // AT_HAND) or 1

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        both = joined_roots(list(zip(rows.column("x").to_pylist(), rows.column("y").to_pylist(), strict=True)))
        return pa.table({"node": pa.array([n for n, _ in both], pa.string()), "root": pa.array([r for _, r in both], pa.string())})

    dealt = inner.select("x", "y", F.pmod(F.xxhash64("hx"), F.lit(groups)).alias("h"))
    own = written(dealt.groupBy("h").applyInArrow(join, "node string, root string"), "fields")
    if outer.isEmpty():
        return own
    end = lambda rows, c: rows.join(own.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
    between = components(end(end(outer.select("x", "y"), "x"), "y"))
    far = between.select(F.col("node").alias("root"), F.col("root").alias("far"))
    alone = between.join(own.select("node"), "node", "left_anti")
    return own.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root")).unionByName(alone)


def boxes(points: DataFrame, by: list[str]) -> DataFrame:
    """The box around the points of each group."""
    return points.groupBy(*by).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))


def square(x: Column) -> Column:
    return x * x


def least_and_most() -> tuple[Column, Column]:
    """Squared least and greatest distance of points of the boxes s, n, w, e and s2, n2, w2, e2."""
    apart = lambda a, b, c, d: F.greatest(F.lit(0.0), F.col(c) - F.col(b), F.col(a) - F.col(d))
    across = lambda a, b, c, d: F.greatest(F.col(d) - F.col(a), F.col(b) - F.col(c))
    return square(apart("s", "n", "s2", "n2")) + square(apart("w", "e", "w2", "e2")), square(across("s", "n", "s2", "n2")) + square(across("w", "e", "w2", "e2"))


def tile(c: str) -> Column:
    return F.floor(F.col(c) / TILE)


def tiles_in_reach(rows: DataFrame, back: int) -> DataFrame:
    """rows (a, b), once for each tile (ta, tb) that holds a cell up to 2 further on in a, back before it, and 2 either way in b."""
    of = lambda c, less: F.sequence(F.floor((F.col(c) - less) / TILE), F.floor((F.col(c) + 2) / TILE))
    return rows.withColumn("ta", F.explode(of("a", back))).withColumn("tb", F.explode(of("b", 2)))


def field(g: str, a: str, b: str) -> Column:
    return F.struct(F.col(g).alias("g"), F.floor(F.col(a) / FIELD).alias("a"), F.floor(F.col(b) / FIELD).alias("b"))


def linked_cells(dense: DataFrame, eps: float, side: float) -> DataFrame:
    """x, hx, y, hy: pairs of dense cells (points g, a, b, lat, lon) that hold two points within eps of each other, and
    their fields."""
    limit = F.lit(eps * eps)
    other = lambda rows, more=(): rows.select("g", F.col("a").alias("a2"), F.col("b").alias("b2"), *[F.col(c).alias(f"{c}2") for c in more])
    low, high = least_and_most()
    whole = boxes(dense, CELL)
    after = (F.col("a2") > F.col("a")) | ((F.col("a2") == F.col("a")) & (F.col("b2") > F.col("b")))
    beside = F.col("a2").between(F.col("a"), F.col("a") + 2) & F.col("b2").between(F.col("b") - 2, F.col("b") + 2) & after
    pairs = tiles_in_reach(whole, 0).join(other(whole, "snwe").withColumns({"ta": tile("a2"), "tb": tile("b2")}), ["g", "ta", "tb"]).where(beside)
    pairs = pairs.where(low <= limit).withColumn("sure", high <= limit)
    pairs = written(pairs.select("g", "a", "b", "a2", "b2", "sure"), "cells")
    ends = [cell_name("g", "a", "b").alias("x"), field("g", "a", "b").alias("hx"), cell_name("g", "a2", "b2").alias("y"), field("g", "a2", "b2").alias("hy")]
    part = lambda c: F.floor(F.col(c) / (side / PARTS))
    placed = dense.withColumns({"u": part("lat"), "v": part("lon")})
    parts = boxes(placed, [*CELL, "u", "v"])
    open_pairs = pairs.where("not sure").drop("sure")
    seen = open_pairs.join(parts, CELL).join(other(parts, ("u", "v", *"snwe")), ["g", "a2", "b2"]).where(low <= limit).withColumn("sure", high <= limit)
    seen = written(seen.select("g", "a", "b", "u", "v", "a2", "b2", "u2", "v2", "sure"), "parts")
    second = seen.where("sure").select("g", "a", "b", "a2", "b2").distinct()
    rest = seen.where("not sure").drop("sure").join(second, ["g", "a", "b", "a2", "b2"], "left_anti")
    exact = rest.join(placed, [*CELL, "u", "v"]).join(other(placed, ("u", "v", "lat", "lon")), ["g", "a2", "b2", "u2", "v2"])
    third = exact.where(square(F.col("lat") - F.col("lat2")) + square(F.col("lon") - F.col("lon2")) <= limit).select("g", "a", "b", "a2", "b2").distinct()
    return pairs.where("sure").select(*ends).unionByName(second.select(*ends)).unionByName(third.select(*ends))


def cell_name(g: str, a: str, b: str) -> Column:
    return F.concat_ws(":", F.lit("c"), F.col(a).cast("string"), F.col(b).cast("string"), F.col(g))


def point_name(g: str, lat: str, lon: str) -> Column:
    return F.concat_ws(":", F.lit("p"), F.col(lat).cast("string"), F.col(lon).cast("string"), F.col(g))


def density_clusters(points: DataFrame, key: str, eps: float = 0.0015, least: int = 3) -> DataFrame:
    """key, id, cluster (null: noise) of points (key, id, lat, lon): density clusters within each key.

    A point with least points within eps (itself included) is a core point; core points within eps of each other are of
    one cluster, numbered from 0 by the least id of its core points; another point within eps of core points is of the
    first of their clusters, else noise. A null key is one key; points without both coordinates are noise; points that
    share a place count one by one.
    """
    side = eps * 0.7071
    g = F.when(F.col(key).isNull(), "n").otherwise(F.concat(F.lit("k"), F.col(key).cast("string")))
    place = points.select(key, "id", g.alias("g"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    place = place.withColumns({c: F.when(~F.isnan(c), F.col(c) + 0.0) for c in ("lat", "lon")}).withColumns({"a": F.floor(F.col("lat") / side), "b": F.floor(F.col("lon") / side)})
    # From here on a row a place, with how many points it has and their least id.
    spots = written(place.where("lat is not null and lon is not null").groupBy(*CELL, "lat", "lon").agg(F.count("*").alias("n"), F.min("id").alias("id")), "spots")
    cells = spots.groupBy(*CELL).agg(F.sum("n").alias("in_cell"), F.min("id").alias("first"))
    marked = written(spots.join(cells, CELL).withColumn("dense", F.col("in_cell") >= least), "marked")
    dense, thin = marked.where("dense"), marked.where("not dense")
    asked = tiles_in_reach(thin.select("g", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("id").alias("x_id"), "a", "b"), 2)
    asked = asked.withColumnsRenamed({"a": "a1", "b": "b1"})
    spread = marked.select(*CELL, "lat", "lon", "n", "dense", tile("a").alias("ta"), tile("b").alias("tb"))
    reach = F.col("a").between(F.col("a1") - 2, F.col("a1") + 2) & F.col("b").between(F.col("b1") - 2, F.col("b1") + 2)
    within = square(F.col("lat") - F.col("lat1")) + square(F.col("lon") - F.col("lon1")) <= eps * eps
    # Of a dense cell only its cell, of a thin one the place: rows that count together have the same y.
    place_of = lambda c: F.when(~F.col("dense"), F.col(c)).alias(c)
    found = asked.join(spread, ["g", "ta", "tb"]).where(reach & within).select("g", "a1", "b1", "lat1", "lon1", "x_id", *CELL[1:], place_of("lat"), place_of("lon"), "n")
    found = found.groupBy("g", "a1", "b1", "lat1", "lon1", "a", "b", "lat", "lon").agg(F.sum("n").alias("n"), F.min("x_id").alias("x_id"))
    named_y = F.when(F.col("lat").isNull(), cell_name("g", "a", "b")).otherwise(point_name("g", "lat", "lon")).alias("y")
    near = written(found.select("g", "a1", "b1", "lat1", "lon1", "a", "b", "n", "x_id", point_name("g", "lat1", "lon1").alias("x"), named_y), "near")
    core = near.groupBy("x").agg(F.sum("n").alias("n"), F.min("x_id").alias("first"), *[F.first(c).alias(c) for c in ("g", "a1", "b1", "lat1", "lon1")]).where(F.col("n") >= least)
    core = core.select(F.col("x").alias("node"), "first", "g", F.col("a1").alias("a"), F.col("b1").alias("b"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon"))
    crowded = cells.where(F.col("in_cell") >= least).select(cell_name("g", "a", "b").alias("node"), "first", *CELL, F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    nodes = written(core.unionByName(crowded), "nodes")
    points_at = nodes.where("lat is not null").select("node")
    to_core = near.join(nodes.select(F.col("node").alias("y")), "y", "left_semi")
    own_links = to_core.join(points_at.withColumnRenamed("node", "x"), "x", "left_semi").where("x <> y")
    links = linked_cells(dense, eps, side).unionByName(own_links.select("x", field("g", "a1", "b1").alias("hx"), "y", field("g", "a", "b").alias("hy")))
    named = nodes.join(contracted(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = named.groupBy("g", "root").agg(F.min("first").alias("first"))
    numbers = firsts.withColumn("cluster", (F.row_number().over(Window.partitionBy("g").orderBy("first")) - 1).cast("long"))  # a row a cluster
    known = written(named.join(numbers.select("root", "cluster"), "root").select("node", *CELL, "lat", "lon", "cluster"), "known")
    border = to_core.join(points_at.withColumnRenamed("node", "x"), "x", "left_anti").join(known.select(F.col("node").alias("y"), "cluster"), "y")
    border = border.groupBy("g", "a1", "b1", "lat1", "lon1").agg(F.min("cluster").alias("cluster")).withColumnsRenamed({"a1": "a", "b1": "b", "lat1": "lat", "lon1": "lon"})
    # A row a cell: a dense cell's cluster (no place), or those of a thin cell's places, fewer than least.
    every = known.drop("node").unionByName(border).groupBy(*CELL).agg(F.collect_list(F.struct("lat", "lon", "cluster")).alias("of"))
    own = F.filter("of", lambda e: e["lat"].isNull() | ((e["lat"] == F.col("lat")) & (e["lon"] == F.col("lon"))))
    return place.join(every, CELL, "left").select(key, "id", F.get(own, F.lit(0))["cluster"].alias("cluster"))
