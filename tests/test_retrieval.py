"""Ranked search with filters, over kept postings and kept vectors, against the plain way and against brute force."""

import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.api import Archive
from emberlog.operators import nearest, search

T0 = datetime(2021, 5, 1)
SEGMENTS = "segment_id long, thread_key string, sources array<string>, started_at timestamp, raw_text string, embedding array<float>, is_substantive boolean, enrich_text string"


def make_rows(n=400, seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(150)]
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    rows = []
    for k in range(n):
        text = " ".join(r.choice(words[: 1 + int(150 * r.random() ** 2)]) for _ in range(r.randint(3, 25)))
        vector = [x + r.gauss(0, 0.2) for x in centres[k % 10]]
        rows.append((k, f"t{k % 5}", ["a"] if k % 3 else ["a", "b"], T0 + timedelta(days=k % 60), text, vector if k % 13 else None, k % 7 != 3, "w140 paraphrase" if k % 50 == 1 else None))
    rows[20] = (*rows[20][:5], [0.0] * 8, True, None)
    for k in range(n, n + 60):  # copies: ids decide
        rows.append((k, "t1", ["b"], T0, rows[5][4], rows[5][5], True, None))
    return rows


ROWS = make_rows()
FILTERS = [{}, {"threads": ["t1"]}, {"date_from": T0 + timedelta(days=10), "date_to": T0 + timedelta(days=25)}, {"sources": ["b"]}, {"threads": ["t2", "t4"], "sources": ["a"], "date_to": T0 + timedelta(days=40)}, {"threads": []}]


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    return f"{tmp_path_factory.mktemp('kept')}/archive"


@pytest.fixture(scope="module")
def archive(spark, place):
    rows = spark.createDataFrame(ROWS, SEGMENTS).repartition(4).cache()
    search.keep_index(rows, place, buckets=8)
    nearest.keep_vectors(rows, place, centres=12)
    return rows


def passes(row, date_from=None, date_to=None, threads=None, sources=None):
    return (date_from is None or row[3] >= date_from) and (date_to is None or row[3] <= date_to) and (threads is None or row[1] in threads) and (sources is None or bool({*row[2]} & {*sources}))


def brute(question, vector, filters, enrich=False, candidates=100, final=20):
    """Row by row, as the statement has it: frequencies of all substantive rows, then the filters."""
    lexemes = lambda t: {*re.findall(r"\w+", (t or "").lower())}
    own = [x for x in ROWS if x[6]]
    df = Counter(w for x in own for w in lexemes(x[4]))
    some = [x for x in own if passes(x, **filters)]
    words, lists = lexemes(question), []
    if vector is not None:
        cos = lambda v: 1 - sum(a * b for a, b in zip(v, vector, strict=True)) / (math.sqrt(sum(a * a for a in v)) * math.sqrt(sum(b * b for b in vector)))
        lists.append([i for _, i in sorted((round(cos([float(np.float32(a)) for a in x[5]]), 9), x[0]) for x in some if x[5] is not None and any(x[5]))][:candidates])
    idf = {w: math.log(len(own) / df[w]) for w in words if w in df and df[w] < 0.05 * len(own)}
    ranked = lambda weight, text: [i for s, i in sorted((-round(sum(weight[w] for w in lexemes(x[text]) if w in weight), 9), x[0]) for x in some) if s < 0][:candidates]
    lists.append(ranked(idf, 4))
    if enrich:
        lists.append(ranked({w: math.log(len(own) / max(1, df.get(w, 1))) for w in words if df.get(w, 1) < 0.05 * len(own)}, 7))
    score = Counter()
    for ids in lists:
        for rank, i in enumerate(ids, 1):
            score[i] += 1 / (60 + rank)
    return sorted(score, key=lambda i: (-round(score[i], 12), i))[:final]


@pytest.mark.parametrize("filters", FILTERS)
@pytest.mark.parametrize("question", ["w1 w120 w133 w149 nowhere", "w140 paraphrase", ""])
def test_filtered_search_is_the_statement(spark, archive, place, filters, question):
    vector = [1.0, -0.5, 0.3, 0.0, 0.2, 1.0, -1.0, 0.7]
    want = brute(question, vector, filters)
    plain = search.hybrid_search(archive, question, vector, **filters).collect()
    kept = search.hybrid_search(archive, question, vector, index=place, vectors=nearest.Vectors(spark, place), **filters).collect()
    assert [r["id"] for r in plain] == want and plain == kept
    both = search.hybrid_search(archive, question, vector, enrich_col="enrich_text", **filters)
    assert [r["id"] for r in both.collect()] == brute(question, vector, filters, True)


def test_a_word_of_one_thread_is_rare_in_the_archive(spark):
    rows = [(k, "T1" if k < 40 else "T2", f"common {'special' if k < 30 else 'plain'} {k}", True) for k in range(1000)]
    s = spark.createDataFrame(rows, "segment_id long, thread_key string, raw_text string, is_substantive boolean")
    assert [r["id"] for r in search.hybrid_search(s, "special", None, threads=["T1"]).collect()] == list(range(20))
    recalled = Archive(spark, s.withColumns({"started_at": F.lit(T0), "embedding": F.lit(None).cast("array<float>")}), s, spark.createDataFrame([], schema.COMMITMENT)).recall("special", threads=["T1"])
    assert [r["id"] for r in recalled.collect()] == list(range(20))


@pytest.mark.parametrize("at_once", [1, 20, 60, 10_000])
def test_common_terms_are_only_read_for_those_that_can_win(spark, at_once, monkeypatch):
    r = random.Random(at_once)
    idf = {f"t{k}": 0.5 + k for k in range(8)}
    posts = [(t, i) for n, t in enumerate(idf) for i in r.sample(range(300), 100 - 12 * n)]
    score = Counter()
    for t, i in posts:
        score[i] += idf[t]
    df = Counter(t for t, _ in posts)
    monkeypatch.setattr(search, "AT_HAND", 0 if at_once < 10_000 else 10_000)
    rows = spark.createDataFrame(posts, "lexeme string, id long")
    for k in (1, 5, 50, 400):
        assert search.best_postings(rows, idf, df, k, at_once) == [i for _, i in sorted((-round(s, 9), i) for i, s in score.items())][:k]
    assert search.best_postings(rows, {}, {}, 5) == []


@pytest.mark.parametrize("filters", FILTERS)
@pytest.mark.parametrize("k", [1, 7, 100, 1000])
def test_kept_vectors_give_the_full_scan(spark, archive, place, filters, k, monkeypatch):
    monkeypatch.setattr(nearest, "AT_ONCE", 0 if k > 1 else 10_000)
    kept = nearest.Vectors(spark, place)
    for vector in (ROWS[5][5], ROWS[77][5], [-1.0] * 8):
        got = [tuple(x) for x in kept.nearest(vector, k, **filters).collect()]
        want = [tuple(x) for x in search.dense_rows(search.substantive(archive).where(search.filter_of(archive, **filters)), "segment_id", vector, k).collect()]
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([d for _, d in got], [d for _, d in want], atol=1e-9)


def test_few_of_clustered_vectors_are_read(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(nearest, "AT_ONCE", 0)
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 32))
    rows = [(k, (centres[k % 40] + r.normal(size=32) * 0.05).tolist()) for k in range(8000)]
    nearest.keep_vectors(spark.createDataFrame(rows, "segment_id long, embedding array<float>"), f"{tmp_path}/clustered", centres=64)
    kept = nearest.Vectors(spark, f"{tmp_path}/clustered")
    want = sorted(range(8000), key=lambda k: (1 - np.dot(np.float32(rows[k][1]).astype(float), rows[17][1]) / (np.linalg.norm(np.float32(rows[k][1]).astype(float)) * np.linalg.norm(rows[17][1])), k))[:50]
    assert [x["id"] for x in kept.nearest(rows[17][1], 50).collect()] == want
    assert kept.read[1] == 8000 and kept.read[0] < 8000 / 5


def test_no_vectors_at_all(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "segment_id long, embedding array<float>")
    nearest.keep_vectors(rows, f"{tmp_path}/none")
    assert nearest.Vectors(spark, f"{tmp_path}/none").nearest([1.0, 0.0]).count() == 0


def test_a_failing_reranker_costs_nothing(spark, archive):
    a = Archive(spark, archive, archive, spark.createDataFrame([], schema.COMMITMENT))
    shown = []

    def broken(question, texts):
        shown.extend(texts)
        raise OSError("no answer")

    plain = a.recall("w120 w133", None, 5).collect()
    assert [r["id"] for r in a.recall("w120 w133", None, 5, broken).collect()] == [r["id"] for r in plain]
    assert shown and max(map(len, shown)) <= 700


def test_bins_and_claims_quote_their_segments(spark, archive):
    a = Archive(spark, archive.withColumn("source_event_ids", F.array(F.concat(F.lit("a:"), F.col("segment_id")))), archive, spark.createDataFrame([], schema.COMMITMENT))
    bins = a.evolution(ROWS[5][5], 20 * 86400, 2).collect()
    assert [r["bin_start"] for r in bins] == sorted(r["bin_start"] for r in bins) and all(r["source_event_ids"] == [f"a:{r['id']}"] for r in bins)
    assert not {r["id"] for r in bins} & {x[0] for x in ROWS if not x[6]}
    claims = a.contradictions("w120 w133", None, 8).collect()
    assert len(claims) == 8 and [r["started_at"] for r in claims] == sorted(r["started_at"] for r in claims)


FORMS = [["книга", "книги", "книгу", "книгой", "книгам", "книгах"], ["стол", "стола", "столу", "столом", "столами"], ["дорога", "дороги", "дорогу", "дорогою", "дорогами"], ["новый", "новая", "новые", "нового", "новыми"], ["зелений", "зелена", "зеленого", "зеленими"], ["читать", "читает", "читали"], ["walk", "walks", "walked", "walking"]]


def test_forms_of_a_word_share_a_stem(spark):
    from emberlog.functions import stems

    rows = [(k, w) for k, forms in enumerate(FORMS) for w in forms]
    got = spark.createDataFrame(rows, "k int, w string").select("k", stems.stem(F.col("w")).alias("s")).distinct().collect()
    assert len(got) == len(FORMS) == len({r["s"] for r in got}), got
    kept = spark.createDataFrame([("я",), ("мы",), ("x1s",), ("日本",), ("",), ("дом",)], "w string").select("w", stems.stem(F.col("w")).alias("s")).collect()
    assert all(r["w"] == r["s"] for r in kept)


def test_a_stemmed_index_finds_other_forms(spark, tmp_path):
    from emberlog.functions import stems

    rows = [(1, "Он купил новую книгу"), (2, "Зелені дороги")] + [(k, f"filler {k}") for k in range(10, 80)]
    s = spark.createDataFrame(rows, "segment_id long, raw_text string")
    search.keep_index(s, f"{tmp_path}/stemmed", stem=stems.stems)
    index = search.Index(spark, f"{tmp_path}/stemmed", stems.stems)
    for question, want in (("книги", [1]), ("новая книга", [1]), ("дорогою", [2]), ("зеленими", [2]), ("поезд", [])):
        assert [r["id"] for r in search.hybrid_search(s, question, None, index=index).collect()] == want, (question, search.question_terms(spark, question, stems.stems))


def test_an_index_of_nothing(spark, tmp_path):
    s = spark.createDataFrame([(1, "same"), (2, "same")], "segment_id long, raw_text string")
    for k, rows in enumerate((s, s.where("segment_id > 5"))):
        search.keep_index(rows, f"{tmp_path}/{k}")
        assert search.hybrid_search(rows, "same or other", None, index=f"{tmp_path}/{k}").count() == 0


def test_a_task_sorts_few_postings_and_once(spark, archive, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "POSTS_A_TASK", 100)
    search.keep_index(archive, f"{tmp_path}/cut", buckets=2)
    got = search.Index(spark, f"{tmp_path}/cut").postings.where("lexeme is not null").select("*", F.input_file_name().alias("file")).collect()
    assert sorted((r["lexeme"], r["id"]) for r in got) == sorted((w, x[0]) for w, ids in postings_by_word().items() if len(ids) < search.RARE * sum(x[6] for x in ROWS) for x in ids)
    files = Counter(r["file"] for r in got)
    assert len(files) >= 6 and max(files.values()) < 400
    assert all(len({r["file"] for r in got if r["lexeme"] == w}) == 1 for w in {r["lexeme"] for r in got})
    for file in files:
        rows = [(r["lexeme"], r["started_at"], r["id"]) for r in spark.read.parquet(file).collect()]
        assert rows == sorted(rows)


def postings_by_word():
    out = {}
    for x in ROWS:
        for w in {*re.findall(r"\w+", x[4].lower())} if x[6] else ():
            out.setdefault(w, []).append(x)
    return out


def test_the_texts_of_what_was_found_are_asked_by_id(spark, archive):
    out = Archive(spark, archive, archive, spark.createDataFrame([], schema.COMMITMENT)).recall(ROWS[5][4], ROWS[5][5], limit=3)
    ids = [r["id"] for r in out.collect()]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(ids) == 3 and all(f"{i}" in plan.split("segment_id#", 1)[1] for i in ids) and " IN (" in plan


def test_stems_of_many_words_are_those_of_each(spark):
    from emberlog.functions import stems
    from emberlog.functions import text as T

    rows = [(["cats", "столами", "x1s", "", "日本", "catsа", "houses", "s", "нее"],), ([],), (None,), (["runs", None, "runs"],), (["runs\ncats", "dogs"],), ([None, "runs\ncats"],), (["boxes\n"],), ([""],), ([None],), (["walks\rruns", "cats dogs"],)]
    got = spark.createDataFrame(rows, "w array<string>").select(stems.stems(F.col("w")).alias("all"), F.transform("w", stems.stem).alias("each")).collect()
    assert [r["all"] for r in got] == [r["each"] for r in got]
    asked = []
    text = spark.createDataFrame([("Cats cats cat dogs cats",)], "t string")
    assert text.select(T.lexemes(F.col("t"), lambda words: (asked.append(words), stems.stems(words))[1])).first()[0] == ["cat", "dog"]
    assert text.select(asked[0]).first()[0] == ["cats", "cat", "dogs"]


def test_frequencies_are_found_without_joining_texts(spark):
    from emberlog.plans import catalog

    for name in ("lexeme_df", "stemmed_df"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "embedding" not in plan
