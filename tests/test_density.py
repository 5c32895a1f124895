"""Density clusters by cells against the definition, point by point."""

import random

import pytest

from emberlog.operators import density, sessions

POINTS = "who string, id long, lat double, lon double"
EPS = 1.5


def brute(rows, least=3):
    out = {}
    for who in {r[0] for r in rows}:
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == who and r[2] is not None and r[3] is not None)
        near = {p[0]: [q[0] for q in own if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= EPS * EPS] for p in own}
        core = {i for i, ns in near.items() if len(ns) >= least}
        label, n = {}, 0
        for i in sorted(core):
            if i in label:
                continue
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = n
                    todo += [y for y in near[x] if y in core]
            n += 1
        for r in (r for r in rows if r[0] == who):
            some = [label[y] for y in near.get(r[1], []) if y in core]
            out[who, r[1]] = label.get(r[1], min(some, default=None))
    return out


def make(kind):
    r = random.Random(kind)
    if kind == "spread":
        return [(r.choice(["a", "b", None]), k, r.uniform(-9, 9), r.uniform(-9, 9)) for k in range(260)]
    if kind == "chain":  # a step short of eps, over many cells, with a gap that is just too wide
        return [("a", 200 - k, k * 1.49 + (0.1 if k >= 40 else 0.0) * 3, -k * 0.1) for k in range(90)]
    if kind == "hot":  # half of all points in one cell, many at one place, beside another dense cell on either side of eps
        near = [("a", k, r.uniform(0, 0.9), r.uniform(0, 0.9)) for k in range(120)] + [("a", 500 + k, 0.5, 0.5) for k in range(60)]
        return near + [("a", 900 + k, r.uniform(2.1, 2.9), r.uniform(0.2, 0.9)) for k in range(40)] + [("b", 1000 + k, x, 0.0) for k, x in enumerate([0.0, 0.1, 0.2, 1.65, 1.75, 1.9, 4.0, 4.1, 4.2, 5.71])]
    return [("a", k, round(r.uniform(-4, 4), 0), round(r.uniform(-4, 4), 0)) for k in range(60)] + [("a", 100, None, 1.0), ("a", 101, 1.0, float("nan")), ("c:d", 102, 0.0, 0.0), ("c:d", 103, -0.0, 0.0), ("c:d", 104, 1.5, 0.0)]


@pytest.mark.parametrize("kind", ["spread", "chain", "hot", "grid"])
def test_clusters_are_those_of_the_definition(spark, kind):
    rows = make(kind)
    got = {(x["who"], x["id"]): x["cluster"] for x in density.density_clusters(spark.createDataFrame(rows, POINTS), "who", EPS).collect()}
    clean = [(w, i, a, b if b == b else None) for w, i, a, b in rows]
    assert len(got) == len(rows) and got == brute(clean)


def test_components_in_rounds_are_those_at_once(spark, monkeypatch):
    r = random.Random(4)
    pairs = [(f"n{k}", f"n{k + 1}") for k in range(70) if k % 23] + [(f"m{r.randrange(60)}", f"m{r.randrange(60)}") for _ in range(50)]
    df = spark.createDataFrame(pairs, "x string, y string")
    at_once = {tuple(x) for x in density.components(df).collect()}
    monkeypatch.setattr(density, "AT_HAND", 0)
    assert {tuple(x) for x in density.components(df).collect()} == at_once
    assert {x[0] for x in at_once} == {n for p in pairs if p[0] != p[1] for n in p}


def test_no_points(spark):
    assert density.density_clusters(spark.createDataFrame([], POINTS), "who", EPS).count() == 0
    assert sessions.dbscan is density.density_clusters


def test_links_within_fields_are_joined_before_those_between_them(spark, monkeypatch):
    r = random.Random(5)
    place = {f"n{k}": ("k", r.randrange(3), 0) for k in range(60)}
    pairs = [(*r.sample(sorted(place), 2),) for _ in range(45)]
    rows = [(x, place[x], y, place[y]) for x, y in pairs]
    df = spark.createDataFrame(rows, "x string, hx struct<g: string, a: bigint, b: bigint>, y string, hy struct<g: string, a: bigint, b: bigint>")
    whole = sorted(map(tuple, density.components(df.select("x", "y")).collect()))
    seen = []
    plain = density.components
    monkeypatch.setattr(density, "components", lambda links: (seen.append(links.count()), plain(links))[1])
    assert sorted(map(tuple, density.contracted(df).collect())) == whole
    assert seen == [sum(place[x] != place[y] for x, y in pairs)]
    seen.clear()
    inner = df.where("hx = hy")
    assert sorted(map(tuple, density.contracted(inner).collect())) == sorted(map(tuple, plain(inner.select("x", "y")).collect())) and not seen


def test_a_point_goes_to_four_tiles_at_most(spark):
    cells = spark.createDataFrame([(a, b) for a in range(-9, 9) for b in range(-5, 5)], "a long, b long")
    got = {}
    for x in density.tiles_in_reach(cells, 2).collect():
        got.setdefault((x["a"], x["b"]), []).append((x["ta"], x["tb"]))
    for (a, b), tiles in got.items():
        assert len(tiles) <= 4
        assert set(tiles) == {((a + i) // density.TILE, (b + j) // density.TILE) for i in range(-2, 3) for j in range(-2, 3)}
