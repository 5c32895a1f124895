"""Centroid clustering, the quality classifier and importance resampling against brute force, on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import pairwise

import duckdb
import numpy as np
import pytest

from emberlog.llm import centroids, jaccard_join, quality_classifier, resampling

VECTORS = "vec_id long, embedding array<float>, cluster string, v int"
DOCS = "doc_id long, text string, score string, rank string, y int, place string"


def brute_clusters(rows, k, rounds, seed, width, scale):
    """Vector by vector and centroid by centroid, in Python's integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    at = [v for _, _, v in sorted((digest(i), np.array(v, "<i4").tobytes(), v) for i, v in kept)][:k]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        at = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(at)]
    out = [(i, *near(v)) for i, v in kept]
    total = Counter()
    for _, d, n in out:
        total[n] += d
    return sorted(((i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()) for i, d, n in out), key=str)


@pytest.mark.parametrize("size", [1.0, 60.0])
def test_clusters_are_those_of_all_comparisons(spark, size):
    r = np.random.default_rng(4)
    kinds = r.normal(size=(5, 6)) * size
    rows = [(k, (kinds[k % 5] + r.normal(size=6) * 0.4 * size).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[7][1]) for k in range(90)] + [rows[3], rows[3], (None, rows[5][1])]
    rows += [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 5 + [None]), (504, [float("nan")] * 6), (505, [float("inf")] * 6), (506, [0.0] * 6)]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], VECTORS).repartition(5)
    got = centroids.centroid_clusters(df, width=6, rounds=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, 8, 4, 3, 6, 1024)


def test_clusters_of_ties_of_few_and_of_no_vectors(spark):
    corners = [(k, [float(k & 1), float(k >> 1)]) for k in range(4)] + [(9, [0.5, 0.5])] * 3
    df = spark.createDataFrame([(*x, None, None) for x in corners], VECTORS)
    got = centroids.centroid_clusters(df, k=5, rounds=3, width=2, scale=2)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(corners, 5, 3, 3, 2, 2)
    assert centroids.centroid_clusters(df, k=50, rounds=2, width=2).count() == 7
    assert centroids.centroid_clusters(df.where("vec_id < 0")).count() == 0
    assert centroids.centroid_clusters(df, width=64).count() == 0


def test_components_beyond_64_bits_are_exact(spark):
    rows = [(k, [3e38 * (1 if k % 2 else -1), 1.0 * k]) for k in range(20)] + [(99, [1e-3, 5.0])]
    df = spark.createDataFrame([(*x, None, None) for x in rows], VECTORS)
    got = centroids.centroid_clusters(df, k=3, rounds=2, width=2).collect()
    assert len(got) == 21
    sign = {r["vec_id"]: r["cluster"] for r in got}
    assert not {sign[k] for k in range(1, 20, 2)} & {sign[k] for k in range(0, 20, 2)}


def test_nearest_is_the_nearest_of_all():
    r = np.random.default_rng(2)
    for scale, k in ((3, 40), (1000, 7), (2**20, 1), (2**40, 9)):
        vectors, own = r.integers(-scale, scale + 1, (400, 3)), r.integers(-scale, scale + 1, (k, 3))
        number, best = centroids.nearest(vectors, own)
        far = ((vectors.astype(object)[:, None] - own.astype(object)[None]) ** 2).sum(2)
        assert list(number) == [min(range(k), key=lambda c: (d[c], c)) for d in far] and [int(x) for x in best] == [min(d) for d in far]


def test_cluster_sql_says_the_same(spark):
    r = np.random.default_rng(8)
    rows = [(k, r.normal(size=64).astype(np.float32).tolist() if k % 11 else None) for k in range(120)]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    want = con.execute(f"select vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 from ({centroids.sql()})").fetchall()
    got = centroids.centroid_clusters(spark.createDataFrame([(*x, None, None) for x in rows], VECTORS))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def text_of(r, good):
    words = ["".join(r.choice("abcdefgéñ") for _ in range(r.randint(1, 7))) for _ in range(r.randint(5, 60))]
    return " ".join(words).capitalize() + "." if good else r.choice([" | ".join(words), "!! ".join(w.upper() for w in words), " ".join(w for w in words for _ in range(4)), "*** ".join(words)])


def test_classifier_tells_held_out_texts_apart(spark):
    r = random.Random(3)
    rows = [(k, text_of(r, k % 6 != 0), None, None, 0, None) for k in range(600)]
    rows += [(None, "plain words", None, None, 0, None), (1000, None, None, None, 0, None), (1001, "", None, None, 0, None), (1002, "x" * 2_500_000, None, None, 0, None), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 6 != 0), None) for k in range(600)] + [(4, None, None), (None, 0, None), (77777, 0, None), (7, 1, None), (5, 2, "x")], "doc_id long, quality int, text string")
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) and x["held_out"] == (zlib.crc32(str("" if x["doc_id"] is None else x["doc_id"]).encode()) % 4 == 2) for x in got)
    held = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 600 and x["held_out"]]
    assert len(held) > 100 and sum(x["predicted"] == (x["doc_id"] % 6 != 0) for x in held) >= 0.97 * len(held)
    assert len({x["score"] for x in got if x["doc_id"] == 0}) == 1
    few = quality_classifier.quality_scores(docs, labels, most=100).collect()
    own = [x for x in few if x["doc_id"] is not None and x["doc_id"] < 600 and x["held_out"]]
    assert sum(x["predicted"] == (x["doc_id"] % 6 != 0) for x in own) >= 0.9 * len(own)


def test_held_out_labels_change_nothing(spark):
    r = random.Random(5)
    docs = spark.createDataFrame([(k, text_of(r, k % 3 != 0), None, None, 0, None) for k in range(120)], DOCS)
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    one = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(120)], "doc_id long, quality int")
    other = spark.createDataFrame([(k, int(k % 3 != 0) ^ held(k)) for k in range(120)], "doc_id long, quality int")
    scores = lambda labels: {x["doc_id"]: x["score"] for x in quality_classifier.quality_scores(docs, labels).collect()}
    assert scores(one) == scores(other)


def test_classifier_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, 0, None), (2, None, None, None, 0, None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [x["score"] for x in quality_classifier.quality_scores(docs, none).collect()] == [0.5, 0.5]
    alike = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {round(x["score"], 6) for x in quality_classifier.quality_scores(docs, alike).collect()} == {0.75}
    assert quality_classifier.quality_scores(docs.where("doc_id > 9"), alike).count() == 0


def test_features_are_those_of_each_text_alone():
    import pyarrow as pa

    r = random.Random(9)
    texts = [text_of(r, k % 2) for k in range(30)] + ["", "a", "ab", " \n", "É"]
    owner, buckets = quality_classifier.features(pa.array(texts))
    for k, t in enumerate(texts):
        alone = quality_classifier.features(pa.array([t]))[1]
        assert list(buckets[owner == k]) == list(alone) and list(quality_classifier.unpacked(quality_classifier.packed(alone))) == list(alone)


def test_dual_coordinate_descent_reaches_the_optimum():
    """The primal value at its solution is close to the dual's: no better plane exists."""
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 40, 8) + (20 if k % 2 else 0)) for k in range(80)]
    y = np.where(np.arange(80) % 2, 1, -1)
    model = quality_classifier.coordinate_descent(rows, y)
    x = np.zeros((80, quality_classifier.BUCKETS))
    for k, own in enumerate(rows):
        x[k, own] = model.ratios[own] / np.sqrt((model.ratios[own] ** 2).sum())
    value = lambda w, b: (w @ w + b * b) / 2 + quality_classifier.COST * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = value(model.weights, model.bias)
    for _ in range(200):
        assert best <= value(model.weights + r.normal(size=x.shape[1]) * 0.02 * (model.ratios != 0), model.bias + r.normal() * 0.02) + 1e-3


def brute_resample(docs, target, percent=25, least=20, seed=7, buckets=10_000):
    import re

    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(upper))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in pairwise(w))]]

    own, aim = [feats(t) for _, t in docs], [feats(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in aim for b in f)
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    rows = []
    for (i, _), (n, f) in zip(docs, own, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return rows, able[: percent * len(able) // 100]


WORDS = ["alpha", "BETA", "gamma2", "Δελτα", "é", "x" * 40, "the", "a-b", "日本語", "y" * 33 + "é", "0"]


@pytest.fixture(params=[(300, 1), (2500, 7)])
def corpus(request):
    n, parts = request.param
    r = random.Random(n)
    docs = [(k * 7 % n, r.choice([" ", "\n", "\x00", "--"]).join(r.choice(WORDS) for _ in range(r.randint(0, 60)))) for k in range(n)]
    docs += [(n + k, docs[3][1]) for k in range(n // 3)] + [docs[5]] * (n // 4) + [(None, docs[9][1]), (None, None), (None, ""), (n * 2, None), (n * 2 + 1, "loneé" * 30_000)]
    return docs, ["alpha beta 日本語", "", None, "GAMMA2 the the the"], parts


def test_resampling_is_the_exact_draw(spark, corpus, monkeypatch):
    docs, target, parts = corpus
    monkeypatch.setattr(resampling, "RANGE", 50)
    df = spark.createDataFrame([(i, t, "clash", "clash", 0, "clash") for i, t in docs], DOCS).repartition(parts)
    aim = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    got = [tuple(r) for r in importance(df, aim)]
    rows, drawn = brute_resample(docs, target)
    assert sorted((r[:4] for r in got), key=str) == sorted((r[:4] for r in rows), key=str)
    ranked = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r[3], r[0]) for r in ranked] == [(r[3], r[0]) for r in drawn]


def importance(docs, target):
    return resampling.importance_resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "one two", None, None, 0, None)], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance(docs.where("doc_id > 5"), none) == []
    assert [(r["n_features"], r["rank"]) for r in importance(docs, none)] == [(3, None)]


def test_tournament_merges_any_runs():
    r = random.Random(2)
    for k in (1, 2, 3, 5, 8, 13):
        runs = []
        for _ in range(k):
            n = r.randint(0, 40)
            rows = {"score": np.array([r.randint(0, 9) for _ in range(n)]), "doc_id": np.array([r.randint(0, 9) for _ in range(n)]), "null_id": np.zeros(n, np.int8)}
            order = resampling.key_order(rows)
            runs.append({c: v[order] for c, v in rows.items()})
        merged = [(run, at) for run, a, b in resampling.Tournament(runs).merge() for at in range(a, b)]
        keys = [(-runs[run]["score"][at], runs[run]["doc_id"][at], run) for run, at in merged]
        assert keys == sorted(keys) and len(set(merged)) == sum(len(x["score"]) for x in runs)


def test_hashes_are_the_librarys():
    import pyarrow as pa

    texts = ["abc def " + "q" * n + " z " + "p" * (70 - n) for n in range(1, 70)] + ["", "one"]
    f = resampling.Features(pa.array(texts))
    for k, t in enumerate(texts):
        w = t.split()
        want = sorted(zlib.crc32(x.encode()) % resampling.BUCKETS for x in [*w, *map(" ".join, pairwise(w))])
        assert sorted(f.bucket[f.text == k]) == want


def test_resampling_sql_says_the_same(spark):
    r = random.Random(6)
    docs = [(k, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 60)))) for k in range(200)] + [(500, None)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.execute("create table benchmark as select 1::bigint as item_id, 'alpha BETA the 日本語' as text")
    want = con.execute(f"select doc_id, n_features, weight, score, rank from ({resampling.SQL})").fetchall()
    df = spark.createDataFrame([(i, t, None, None, 0, None) for i, t in docs], DOCS)
    got = map(tuple, importance(df, spark.createDataFrame([(1, "alpha BETA the 日本語")], "item_id long, text string")))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_links_of_one_part_are_joined_without_rounds(spark, monkeypatch):
    r = random.Random(5)
    path = list(range(1000, 1060))
    r.shuffle(path)
    links = [*zip(path, path[1:], strict=False), *((-7, x) for x in range(40)), *((r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)), (5, 5), (-(1 << 63), (1 << 63) - 1)]
    root = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in root:
        for a, b in (x for x in links if x[0] != x[1]):
            root[a] = root[b] = min(root[a], root[b])
    table = spark.createDataFrame(links, "a long, b long")
    written, plain = [], jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df: (written.append(1), plain(df))[1])
    assert dict(map(tuple, jaccard_join.components(table).collect())) == root
    assert len(written) == 1
    monkeypatch.setattr(jaccard_join, "PART_LINKS", 30)
    assert dict(map(tuple, jaccard_join.components(table).collect())) == root
    assert len(written) > 3
    assert jaccard_join.components(table.limit(0)).count() == 0
