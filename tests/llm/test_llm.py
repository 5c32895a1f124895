"""The training-data operators against brute force, the library itself, or an exact round trip, on small tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import encoding, fingerprints, jaccard_join, line_dedup, lm_scoring, packing, quality, substring_dedup, token_counts, url_filters
from emberlog.llm.common import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string"


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    rows = []
    for k in range(60):
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 25))).capitalize() for _ in range(r.randint(1, 12))]
        rows.append("\n".join(lines))
    for k in range(20):  # near copies: some words changed
        words = rows[k].split(" ")
        for _ in range(1 + len(words) // 40):
            words[r.randrange(len(words))] = "changed"
        rows.append(" ".join(words))
    rows += rows[:5] + [None, "", "   \n\t ", "one", "two words", "don't <|endoftext|> 's x\x1cy ΣΑΣ ½ é 　 \U0001f44d\U0001f3fd", "z" * 3000, "a b c d e f g h " * 400, rows[3], rows[3]]
    return list(enumerate(rows)) + [(7, rows[7]), (None, rows[8]), (None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", None, "clash") for i, t in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=False):
    return WORD.findall((text or "").translate(UPPER) if lower else text or "")


def bag(rows):
    return sorted(map(tuple, rows), key=str)


def test_token_counts(docs, nothing):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = bag((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert bag(token_counts.token_counts(docs, path).collect()) == want
    assert token_counts.token_counts(nothing, path).count() == 0


def test_encoding_round_trip(docs, nothing):
    from tokenizers import Tokenizer

    path = vocabulary_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = encoding.bpe_decode(encoding.bpe_encode(docs, path), path).collect()
    want = bag((i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for i, t in ROWS)
    assert bag((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got) == want
    assert encoding.bpe_encode(nothing, path).count() == 0


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    cap = 64
    got = packing.pack_documents(docs, path, cap).toPandas()
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in ROWS]
    want = bag((-1 if i is None else i, p, p * cap, len(x[p * cap : p * cap + cap]), zlib.crc32(np.array(x[p * cap : p * cap + cap], "<u4").tobytes())) for i, x in ids for p in range(-(-len(x) // cap)))
    assert bag((-1 if math.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= cap and list(g["offset"]) == list(np.cumsum([0, *g["length"]])[:-1])
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // cap) * 1.1 + 1
    assert packing.pack_documents(nothing, path).count() == 0


def test_residual_rounds(spark):
    r = random.Random(1)
    rows = [(k, 0, 0, r.choice([3, 30, 51, 60, 99, 100]), 0) for k in range(2000)]
    got = packing.best_fit_packing(spark.createDataFrame(rows, packing.PIECES), 100, group_items=100).toPandas()
    assert sorted(got["doc_id"]) == list(range(2000)) and got.groupby("sequence_id")["length"].sum().max() <= 100


@pytest.mark.parametrize("sizes", [[37], [60, 70], [1], list(range(1, 101)), [100], [30, 90, 95]])
def test_residual_rounds_end_close_to_the_bound(spark, sizes):
    r = random.Random(len(sizes))
    rows = [(k if k % 9 else None, k % 3, 0, r.choice(sizes), 0) for k in range(3000)]
    got = packing.best_fit_packing(spark.createDataFrame(rows, packing.PIECES), 100, group_items=40).toPandas()
    assert len(got) == 3000
    fills = got.groupby("sequence_id")["length"].sum()
    assert fills.max() <= 100
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == list(np.cumsum([0, *g["length"]])[:-1])
    alone = packing.best_fit([x[3] for x in rows], 100)
    assert len(fills) <= 1.1 * len(alone) + 2
    assert (fills <= 50).sum() <= 1


def test_words_of_plain_letters_are_those_of_the_library():
    from emberlog.llm import bpe

    path = vocabulary_path("word_bpe_49k.json")
    lib, encoder, counter = bpe.library(path), bpe.WordEncoder(path), bpe.WordCounter(path)
    assert all(map(encoder.plain, ["Größe,", "été", "съёмка's", "l'Été", "naïve_42!"]))
    assert not any(map(encoder.plain, ["e\u0301", "\u0130", "日本", "a\u00a0b", "ς", "a\tb"]))
    r = random.Random(31)
    some = [*map(chr, bpe.PLAIN_LETTERS), *"abcXYZ019'.,_-#s", "'s", "'RE", "\u0301", "\u0306", "\u00d7"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(1, 9))) for _ in range(20_000)] + [f"{x}{chr(c)}{y}" for c in bpe.PLAIN_LETTERS for x in ("", "a", "A'", "1") for y in ("", "b", "'s", "1")]
    for text in texts:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(ids, "<u4").tobytes() and counter.count(text) == len(ids), text
    encoder.split = None  # the library is not asked for these
    assert len(encoder.encode("Zürcher Straßenlaternen mögen's, весёлые ёжики")) > 0


def random_texts(n, seed=3):
    """Texts of any code point, a third of their characters, among letters, spaces and special strings."""
    r = random.Random(seed)
    points = [chr(k) for k in range(1, 0x30000) if not 0xD800 <= k < 0xE000]
    some = [*"abcXYZ 12\x85 \x1c\x0bé><|Σß 's 'T  \n\t\r", "<|endoftext|>"]
    return ["".join(r.choice(points) if r.random() < 1 / 3 else r.choice(some) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_tokens_of_any_code_point_are_the_librarys():
    from emberlog.llm import bpe

    word, byte = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.json")
    texts = random_texts(10_000) + [f"a{chr(k)}b" for k in range(1, 0x30000) if not 0xD800 <= k < 0xE000]
    count, encode, prefix = bpe.WordCounter(word), bpe.WordEncoder(word), bpe.PrefixEncoder(byte)
    for k in range(0, len(texts), 10_000):
        part = texts[k : k + 10_000]
        by_word = [x.ids for x in bpe.library(word).encode_batch(part, add_special_tokens=False)]
        assert list(map(encode.encode, part)) == [np.array(x, "<u4").tobytes() for x in by_word]
        assert list(map(count.count, part)) == list(map(len, by_word))
        assert list(map(prefix.encode, part)) == [np.array(x.ids, "<u4").tobytes() for x in bpe.library(byte).encode_batch(part, add_special_tokens=False)]


def test_url_filters(spark):
    rules = [(h, p, v) for h, p, v in url_filters.RULES] + [("b.example.com", "/en/77", "block"), ("example.com", "/en/7", "block"), ("a.b.example.com", "", "allow"), ("org", "/\U0010ffff", "block"), ("org", "/\U0010ffff\U0010ffff", "allow")]
    hosts = ["example.com", "b.example.com", "x.b.example.com", "a.b.example.com", "notexample.com", "com", "Example.NET", "example.org:80", "", "\U0010ffff.com", "c.\U0010ffff.org", "a.com"]
    paths = ["/en/7", "/en/77x", "/en/", "/EN/7", "/de/8?x", "/de/9#y", "/es/", "", "?q=://z", "/en/\U0010ffff", "/en/\U0010ffffz", "/\U0010ffff", "/\U0010ffff\U0010ffff\U0010ffff", "/\U0010fffe"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "no scheme", "://", "", "http://example.com/en/7"]
    pages = spark.createDataFrame([(k if k % 7 else None, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")

    def judge(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u[u.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0].translate(UPPER)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [(len(h) + len(p), len(h), h + p, "allow" if (h, p) == ("example.com", "/en/7") else v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")

    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert bag(url_filters.url_filters(pages, r).collect()) == bag((k if k % 7 else None, *judge(u)) for k, u in enumerate(urls))
    assert url_filters.url_filters(pages.where("false"), r).count() == 0
    assert {x["verdict"] for x in url_filters.url_filters(pages, r.where("false")).collect()} == {"allow"}


def test_quality_statistics(docs, nothing):
    def stats(t):
        w = words(t)
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        c = collections.Counter(zip(w, w[1:], w[2:]))
        cov = {i + d for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for d in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cov)

    got = quality.quality_rules(docs)
    assert bag(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()) == bag((i, *stats(t)) for i, t in ROWS)
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(nothing).count() == 0


def test_outliers_go_and_clean_stay(spark):
    r = random.Random(4)
    text = lambda junk: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) + (r.choice(["***", "$$$", "%%%"]) if junk else "") for _ in range(120))
    rows = [(k, text(k % 20 == 0), "en", "s") for k in range(400)]
    got = {x["doc_id"]: x["kept"] for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {k for k, kept in got.items() if not kept} == set(range(0, 400, 20))


def test_each_kind_of_junk_goes_by_itself(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))

    def text(kind):
        if kind == 0:  # one symbol for each two words: 9 % of the characters
            return " | ".join(line(2) for _ in range(60))
        if kind == 1:  # 40 % of the words repeated, no line
            phrase = line(6)
            return " ".join(line(12) + " " + phrase for _ in range(10)) + " " + line(30)
        if kind == 2:  # half of the lines repeated, two words each
            again = line(2)
            return "\n".join(line(6) + "\n" + again for _ in range(20))
        if kind == 3:  # clean and short: one line of five occurs again
            again = line(2)
            return "\n".join([again, line(30), line(30), again, line(20)])
        return "\n".join(line(20) for _ in range(r.randint(4, 20)))

    rows = [(k, text(k % 20), "en", "s") for k in range(400)]
    got = {x["doc_id"]: x for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(x["base_failed"] for x in got.values())
    assert {k for k, x in got.items() if not x["kept"]} == {k for k in got if k % 20 in (0, 1, 2)}


def test_mcd_resists_a_cluster_of_outliers(spark):
    r = np.random.default_rng(0)
    clean = r.normal([1.5, 0.1, 0.1, 0.1], [0.1, 0.05, 0.05, 0.05], (900, 4))
    bad = r.normal([1.5, 0.9, 0.9, 0.9], 0.02, (150, 4))
    rows = [("g", *map(float, x)) for x in np.vstack([clean, bad])]
    fit = quality.mcd(spark.createDataFrame(rows, "grp string, " + ", ".join(f"{f} double" for f in quality.FEATURES))).first()
    assert np.allclose([fit[f"m{i}"] for i in range(4)], clean.mean(0), atol=0.02)


def test_quality_verdicts_by_brute_force(spark):
    """The estimate, the distances and the verdicts again, a document at a time, with a small language and a null one."""
    r = random.Random(21)
    word = lambda a, b: "".join(r.choice("abcdefgh") for _ in range(r.randint(a, b)))

    def text(k):
        lines = [" ".join(word(2, 7 + k % 3) + (r.choice("*|") if r.random() < (0.02 if k % 11 else 0.5) else "") for _ in range(r.randint(8, 20))) for _ in range(r.randint(6, 14))]
        return "\n".join(lines + lines[: k % 5 if k % 13 == 0 else 0])

    rows = [(k, text(k), "en" if k % 3 else "de" if k % 9 else None, "s" if k % 2 else "t") for k in range(700)] + [(900, "too short", "en", "s"), (None, None, None, None)]
    got = {x["doc_id"]: x for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    P, B, F4 = quality.P, quality.BIN, quality.FEATURES
    stats = {i: got[i] for i, *_ in rows if not got[i]["base_failed"]}
    x = {i: [math.log(s["word_chars"] / s["n_words"]), math.sqrt(s["n_symbols"] / s["word_chars"]), math.sqrt(s["n_dup_lines"] / sum(1 for z in (rows[i][1]).split("\n") if z.strip())), math.sqrt(s["n_repeat_words"] / s["n_words"])] for i, s in stats.items()}
    assert all(abs(a - stats[i][f]) < 1e-9 for i in x for a, f in zip(x[i], F4, strict=True))

    def quantile(values, share):
        return (sorted(math.floor(v / B) for v in values)[math.ceil(len(values) * share) - 1] + 1) * B

    def distance(v, m, cov, one_sided=False):
        d = np.array(v) - m
        if one_sided:
            d[1:] = np.maximum(d[1:], 0)
        y = np.linalg.solve(np.linalg.cholesky(cov), d)
        return float(y @ y)

    def estimate(ids):
        mid = [quantile([x[i][k] for i in ids], 0.5) for k in range(P)]
        mad = [quantile([abs((math.floor(x[i][k] / B) + 0.5) * B - mid[k]) for i in ids], 0.5) for k in range(P)]
        m, cov = np.array(mid), np.diag([(v * 1.4826) ** 2 + quality.RIDGE[k] for k, v in enumerate(mad)])
        for step in range(quality.STEPS):
            d = {i: math.log1p(distance(x[i], m, cov)) for i in ids}
            edge = quantile(list(d.values()), quality.SHARE)
            near = np.array([x[i] for i in ids if d[i] <= edge])
            m = near.mean(0)
            cov = (near.T @ near / len(near) - np.outer(m, m)) * (quality.CONSISTENT if step == quality.STEPS - 1 else 1.0) + np.diag(quality.RIDGE)
        return m, cov

    of = {i: (rows[i][2] or "", rows[i][3]) for i in x}
    fits = {}
    for i in x:
        for level in (("s", *of[i]), ("l", of[i][0]), ("a",)):
            ids = [j for j in x if level[0] == "a" or of[j][0] == of[i][0] and (level[0] == "l" or of[j] == of[i])]
            if len(ids) >= quality.MIN_GROUP or level[0] == "a":
                break
        if level not in fits:
            fits[level] = estimate(ids)
        m, cov = fits[level]
        lines = sum(1 for z in rows[i][1].split("\n") if z.strip())
        sizes = [stats[i]["n_words"], stats[i]["word_chars"], lines, stats[i]["n_words"]]
        want = distance(x[i], m, cov + np.diag([a / n for (a, _), n in zip(quality.NOISE, sizes, strict=True)]), True)
        assert abs(got[i]["distance"] - want) < 1e-6 * max(1, want)
        assert got[i]["kept"] == (want <= quality.CUTOFF)
    assert len(fits) >= 3 and 20 < sum(not got[i]["kept"] for i in x) < 150
    assert not got[900]["kept"] and not got[None]["kept"]


def test_line_dedup(docs, nothing):
    seen, want = set(), []
    order = sorted(ROWS, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    for i, t in order:
        lines = (t or "").split("\n")
        real = [k for k, x in enumerate(lines) if WORD.search(x)]
        grams = [tuple(lines[j] for j in real[k : k + 3]) for k in range(len(real) - 2)]
        gone = set()
        for k, g in enumerate(grams):
            if g in seen:
                gone |= set(real[k : k + 3])
            seen.add(g)
        want.append((i, len(real), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    assert bag(line_dedup.line_dedup(docs).collect()) == bag(want)
    assert line_dedup.line_dedup(nothing).count() == 0


@pytest.mark.parametrize("single", [1, 5, 9])
def test_line_dedup_single_lines(spark, docs, nothing, single):
    r = random.Random(8)
    pool = [" ".join(r.choice(["a", "bc", "é", "def"]) for _ in range(r.randint(1, 12))) for _ in range(60)]
    rows = ROWS + [(k, "\n".join(r.choice([*pool, "", " \t"]) for _ in range(r.randint(1, 6)))) for k in range(1000, 1100)]
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        lines = (t or "").split("\n")
        real = [k for k, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for k in range(len(real)):
            for size in (1, 3):
                gram = tuple(lines[j] for j in real[k : k + size])
                if len(gram) == size and (size == 3 or len(words(gram[0])) >= single):
                    if gram in seen:
                        gone |= set(real[k : k + size])
                    seen.add(gram)
        want.append((i, len(real), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(line_dedup.line_dedup(table, single=single).collect()) == bag(want)
    assert line_dedup.line_dedup(nothing, single=single).count() == 0


def test_pipeline_cuts_single_repeated_lines(spark):
    import corpus_pipeline

    license = "this line of nine words stands in every text"
    rows = [(1, f"first own text here\n{license}"), (2, f"{license}\nsecond own text here"), (3, license), (4, f"{license}\n{license}\nshort\nlast"), (5, "short")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, table, "").collect()}
    assert got == {1: rows[0][1], 2: "second own text here", 4: "short\nlast", 5: "short"}


def test_pipeline_keeps_one_of_each_group(spark):
    import corpus_pipeline

    r = random.Random(10)
    text = lambda: [f"w{r.randrange(10**6)}" for _ in range(80)]
    near = lambda w: [*w[:-1], "other"]
    a, b, c, d, e = (text() for _ in range(5))
    # repeated rows; null ids only; a null id beside an id; an id with two texts, one of them a near copy
    rows = [(1, a), (1, a), (1, near(a)), (None, b), (None, near(b)), (None, near(b)), (4, near(c)), (None, c), (4, near(d)), (5, d), (5, e), (None, []), (6, [])]
    table = spark.createDataFrame([(i, " ".join(w), "en", "s", None) for i, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates(spark, table, "").collect()]
    left = lambda *some: sorted(g for g in got if g[1] in [" ".join(w) for w in some])
    assert len(left(a, near(a))) == len(left(b, near(b))) == 1
    assert left(c, near(c)) == [(4, " ".join(near(c)))] and left(d, near(d)) == [(4, " ".join(near(d)))] and left(e) == [(5, " ".join(e))]
    assert len(got) == 7 and sum(not x for _, x in got) == 2
    final = corpus_pipeline.substrings(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in got], table.schema), "").collect()
    assert len(final) == 7


@pytest.mark.parametrize("size", [8, 35])
def test_substring_dedup(docs, nothing, size):
    c = collections.Counter(tuple(w[k : k + size]) for _, t in ROWS for w in [words(t)] for k in range(len(w) - size + 1))
    want = []
    for i, t in ROWS:
        w = words(t)
        gone = {k + d for k in range(len(w) - size + 1) if c[tuple(w[k : k + size])] > 1 for d in range(size)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert bag(substring_dedup.substring_dedup(docs, size).collect()) == bag(want)
    assert substring_dedup.substring_dedup(nothing, size).count() == 0


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_jaccard_components(docs, nothing, size, percent):
    def shingles(t):
        w = words(t, True)
        return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in ROWS]
    comp = list(range(len(ROWS)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(ROWS)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                comp[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(ROWS):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(ROWS)]
    assert bag(jaccard_join.jaccard_components(docs, size, percent).collect()) == bag(want)
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_many_unlinked_copies_of_one_template(spark):
    """500 texts with the same words but for their own 12 of 100, and ten that are near to one of them each."""
    r = random.Random(12)
    template = [f"t{k}" for k in range(100)]
    own = []
    for k in range(500):
        w = template[:]
        for j in r.sample(range(100), 12):
            w[j] = f"u{k}x{j}"
        own.append(w)
    rows = [*own, *([*w[:-1], "end"] for w in own[::50])]
    sets = [frozenset(zip(w, w[1:], w[2:], w[3:])) for w in rows]
    near = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if near(sets[a], sets[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = [new if c == old else c for c in comp]
    assert len(set(comp)) <= 501 and len(set(comp)) > 400
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.jaccard_components(table, 4, 85).collect()}
    assert got == dict(enumerate(comp))


def test_sketch_distance_never_exceeds_difference():
    import pyarrow as pa

    r = random.Random(2)
    base = [str(r.random()) for _ in range(200)]
    other = base[:]
    for k in r.sample(range(200), 8):
        other[k] = "x"
    s = jaccard_join.Shingles(pa.array([" ".join(base), " ".join(other)]), 4)
    f = jaccard_join.fold_sketches(s)
    a, b = (set(s.h[s.begins[k] : s.begins[k + 1]].tolist()) for k in (0, 1))
    assert np.bitwise_count((f[0] ^ f[1]).view(np.uint64)).sum() <= len(a ^ b)


def test_fingerprints(docs, nothing):
    import unicodedata

    canon = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip()
    plain = [(i, t) for i, t in ROWS[: len(ROWS) - 3]]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs.where(f"doc_id < {len(plain)}").dropDuplicates(["doc_id", "text"])).collect()}
    order = sorted(plain, reverse=True, key=lambda x: x[0])
    names = {}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + following[:m]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert names.setdefault(canon(t), r["fingerprint"]) == r["fingerprint"] and names.setdefault(canon(edited), r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert (r["near_edited"], r["near_next"]) == (float(canon(t) == canon(edited)), float(canon(t) == canon(following)))
    assert len(set(names.values())) == len(names)
    assert fingerprints.edited_fingerprints(docs).count() == len(ROWS) and fingerprints.edited_fingerprints(nothing).count() == 0


def test_fingerprints_of_colliding_hashes(spark, monkeypatch):
    """With a hash of a few values only, the bytes alone tell texts apart."""
    monkeypatch.setattr(fingerprints, "wide_hash", lambda c: F.struct((F.length(c) % 3).cast("long").alias("low"), F.lit(1).cast("long").alias("high")))
    texts = ["abc", "ABC ", "xyz", "a", "b", None, "", "dddd", "abc", "ＡＢＣ"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (fingerprints.fingerprints(table).collect(), fingerprints.edited_fingerprints(table).collect()):
        got = {r["doc_id"]: r["fingerprint"] for r in rows}
        same = [{0, 1, 8, 9}, {2}, {3}, {4}, {5, 6}, {7}]
        assert [{i for i in got if got[i] == got[min(g)]} for g in same] == same
    near = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in rows}
    # next of 9 is 8, of 6 is 5, of 0 is 9; texts under three characters have nothing to replace
    assert near[9][1] == near[6][1] == near[0][1] == 1 and near[8][1] == near[4][1] == near[3][1] == 0
    assert near[9][0] == near[3][0] == near[5][0] == 1.0 or near[9][0] == 0.0


def test_fingerprints_with_many_null_and_equal_ids(spark):
    r = random.Random(5)
    rows = [(r.choice([None, 5, 7, k]), "t" * r.randrange(9) + str(r.randrange(50))) for k in range(400)]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert bag((x["doc_id"], x["n_chars"]) for x in got) == bag((i, len(t)) for i, t in rows)
    # the texts in order are a ring: each is some row's next once
    assert sum(x["near_next"] for x in got) < len(got)


def test_lm_scores(docs, nothing):
    path = vocabulary_path("byte_bpe_50k.json")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(x for i, t in ROWS if not held(i) for x in [*words(t, True), "\n"])
    n, v = sum(c.values()), len(c)
    want = [(i, held(i), len(words(t)) + 1, sum(c[x] > 0 for x in [*words(t, True), "\n"]), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*words(t, True), "\n"]), 6)) for i, t in ROWS]
    got = lm_scoring.lm_scores(docs, path).collect()
    assert bag((*r[:5], round(r["base_score"], 6)) for r in got) == bag(want)
    assert all(r["score"] < 0 and r["spelled"] < 0 for r in got)
    again = lm_scoring.lm_scores(docs.repartition(7), path).collect()  # the same weights however tasks are dealt
    assert bag((r["doc_id"], r["n_tokens"], round(r["score"], 5), round(r["spelled"], 5)) for r in again) == bag((r["doc_id"], r["n_tokens"], round(r["score"], 5), round(r["spelled"], 5)) for r in got)
    assert lm_scoring.lm_scores(nothing, path).count() == 0


def test_lm_scores_loop_by_loop(spark, monkeypatch):
    """The query's scores again, token by token and word by word, with the model that it fitted."""
    path = vocabulary_path("byte_bpe_50k.json")
    r = random.Random(3)
    texts = [" ".join(r.choice(["Some", "words", "other", "things", "ünseen" + str(r.randrange(99)), "z" * 70]) for _ in range(r.randrange(60))) for _ in range(40)] + [None, ""]
    models = []
    fit = lm_scoring.fitted
    monkeypatch.setattr(lm_scoring, "fitted", lambda *a: models.append(fit(*a)) or models[-1])
    got = {x["doc_id"]: x for x in lm_scoring.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    (model,) = models
    w, cut = {k: x.astype(float) for k, x in model.w.items()}, lm_scoring.subwords(path).slow
    W, R, E = lm_scoring.WIDTH, lm_scoring.RADIX, lm_scoring.END
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(x for i, t in enumerate(texts) if not held(i) for x in [*words(t, True), None])
    n, v = sum(c.values()), len(c)

    def logprob(ids, k):
        """Of ids[k], from the ids of its window before it."""
        first = max(0, k // lm_scoring.FRESH * lm_scoring.FRESH - lm_scoring.CONTEXT)
        base = k // lm_scoring.FRESH * lm_scoring.FRESH - lm_scoring.CONTEXT
        before = lambda j: ids[j - 1] if j else E
        x = [model.embed[before(j)].astype(float) + model.place[j - base] for j in range(first, k + 1)]
        qkv = [y @ w["qkv"] for y in x]
        s = np.exp([np.clip(qkv[-1][:W] @ y[W : 2 * W] * W**-0.5, -30, 30) for y in qkv])
        z = x[-1] + sum(a * y[2 * W :] for a, y in zip(s / s.sum(), qkv, strict=True)) @ w["out"]
        z = z / (1 + np.abs(z))
        hi, lo = divmod(ids[k], R)
        a = z @ w["high"] + model.prior_high[before(k)]
        b = (z + w["given"][hi]) @ w["low"] + model.prior_low[before(k), hi]
        return a[hi] - math.log(np.exp(a).sum()) + b[lo] - math.log(np.exp(b).sum())

    for i, t in enumerate(texts):
        own = words(t, True)
        pieces = [cut(b" " + x.encode()) for x in own]
        ids = [*(k for p in pieces for k in p), E]
        each = [logprob(ids, k) for k in range(len(ids))]
        assert abs(sum(each) / math.log(10) - got[i]["spelled"]) < 1e-3
        score, at = 0.0, 0
        for x, p in [*zip(own, pieces, strict=True), (None, [E])]:
            score += math.log10((c[x] + v * math.exp(sum(each[at : at + len(p)]))) / (n + v))
            at += len(p)
        assert abs(score - got[i]["score"]) < 1e-3


def test_lm_fit_reads_every_training_text_and_gains_on_the_prior(spark):
    path = vocabulary_path("byte_bpe_50k.json")
    r = random.Random(9)
    names = [x + "zq" for x in "abcdefgh"]  # a bigram of subwords sees the common ending, not which word it ends
    texts = [" ".join(names[(k + r.randrange(2)) % 8] for k in range(r.randrange(8), 700)) for _ in range(150)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    # Few distinct texts, none of them in the first classes of a fine hash.
    table = table.where(F.pmod(F.xxhash64("text"), F.lit(48)) > 2).cache()
    rows = table.orderBy("doc_id").toArrow()
    _, _, tokens, begins = lm_scoring.token_stream(rows, path)
    held = np.array([zlib.crc32(str(i).encode()) % 7 == 2 for i in rows.column("doc_id").to_pylist()])
    low = np.zeros((lm_scoring.END + 1, lm_scoring.END + 1))
    learned = np.repeat(~held, np.diff(begins))
    np.add.at(low, (lm_scoring.previous(tokens, begins)[learned], tokens[learned]), 1)
    low = low.reshape(-1, lm_scoring.RADIX, lm_scoring.RADIX)
    prior = lm_scoring.Model(lm_scoring.smoothed(low.sum(2)), lm_scoring.smoothed(low))
    prior.w["high"][:] = 0
    prior.w["low"][:] = 0
    by_prior = dict(zip(rows.column("doc_id").to_pylist(), prior.score(tokens, begins) / math.log(10), strict=True))
    got = lm_scoring.lm_scores(table, path).collect()
    assert len(got) == rows.num_rows > 60
    gain = {held: sum(x["spelled"] - by_prior[x["doc_id"]] for x in got if x["held_out"] == held) / sum(x["n_tokens"] for x in got if x["held_out"] == held) for held in (False, True)}
    assert min(gain.values()) > 0.02, gain


def test_lm_gradients_and_probabilities():
    r = np.random.default_rng(3)
    model = lm_scoring.Model(np.zeros((lm_scoring.END + 1, lm_scoring.RADIX)), np.zeros((lm_scoring.END + 1, lm_scoring.RADIX, lm_scoring.RADIX)))
    model.w = {k: x.astype(float) for k, x in model.w.items()}
    tokens, begins = r.integers(0, lm_scoring.END, 50), np.array([0, 20, 50])
    before = lm_scoring.previous(tokens, begins)
    _, index, inside = lm_scoring.text_windows(begins)
    assert sorted(index[:, lm_scoring.CONTEXT :][inside[:, lm_scoring.CONTEXT :]]) == list(range(50))
    loss = lambda: -(model.forward(before, tokens, index, inside) * inside[:, lm_scoring.CONTEXT :]).sum() / 50
    for name, g in model.gradients(before, tokens, index, inside).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = model.w[name][at]
        model.w[name][at] = old + 1e-5
        up = loss()
        model.w[name][at] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-5
        model.w[name][at] = old
    every = [np.exp(model.forward(np.array([lm_scoring.END]), np.array([t]), np.zeros((1, lm_scoring.SPAN), int), np.arange(lm_scoring.SPAN)[None] == lm_scoring.CONTEXT)[0, 0]) for t in range(lm_scoring.END + 1)]
    assert abs(sum(every) - 1) < 1e-6


def stage_rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_pipeline_stages_by_brute_force(spark, docs, nothing):
    """Every stage on the same rows: nulls, empty and wordless texts, repeated rows, long texts, a clashing column."""
    import corpus_pipeline as C
    from tokenizers import Tokenizer

    base = stage_rows(docs)
    blank = lambda t: not WORD.search(t or "")

    judged = collections.Counter((r["doc_id"], r["text_hash"]) for r in quality.quality_rules(docs).collect() if r["kept"])
    hashed = [(r["doc_id"], r["h"], (r["doc_id"], r["text"], r["lang"], r["source"])) for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    assert bag(stage_rows(C.quality(spark, docs, ""))) == bag(row for i, h, row in hashed if (i, h) in judged)

    seen, want = set(), []
    for i, t, lang, source in sorted(base, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        lines = (t or "").split("\n")
        real = [k for k, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for k in range(len(real)):
            for size in (1, 3):
                gram = tuple(lines[j] for j in real[k : k + size])
                if len(gram) == size and (size == 3 or len(words(gram[0])) >= 5):
                    gone |= set(real[k : k + size]) if gram in seen else set()
                    seen.add(gram)
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or not blank(left):
            want.append((i, left, lang, source))
    assert bag(stage_rows(C.lines(spark, docs, ""))) == bag(want)

    def shingles(t):
        w = words(t, True)
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, comp = [shingles(x[1]) for x in base], list(range(len(base)))
    for a in range(len(base)):
        for b in range(a):
            if sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    got = stage_rows(C.near_duplicates(spark, docs, ""))
    groups = collections.defaultdict(list)
    for c, s, row in zip(comp, sets, base, strict=True):
        groups[c if s else ("empty", row)].append(row)
    assert len(got) == len(groups)
    for members in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in members)
        assert sum(row in {m for m in members if (m[0] is None, m[0] or 0) == least} for row in got) == 1

    c = collections.Counter(tuple(w[k : k + 50]) for _, t, _, _ in base for w in [words(t)] for k in range(len(w) - 49))
    want = []
    for i, t, lang, source in base:
        w = words(t)
        gone = {k + d for k in range(len(w) - 49) if c[tuple(w[k : k + 50])] > 1 for d in range(50)}
        if not gone:
            want.append((i, t or "", lang, source))
        elif len(gone) < len(w):
            want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), lang, source))
    assert bag(stage_rows(C.substrings(spark, docs, ""))) == bag(want)

    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    packed = C.packing(spark, docs, "").collect()
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _, _ in base]
    assert bag((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == bag((i, p, len(x[p : p + 4096]), zlib.crc32(np.array(x[p : p + 4096], "<u4").tobytes())) for i, x in ids for p in range(0, len(x), 4096))
    for name, stage in C.STAGES:
        out = stage(spark, nothing, "")
        assert out.count() == 0 and (name == C.STAGES[-1][0] or out.columns == C.COLUMNS)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS and set(kept.columns) == set(docs.columns)
    rejected = quality.quality_rules(docs).where("not kept").count()
    assert kept.count() == docs.count() - rejected
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["op2_url_filters", "op6_line_dedup"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    from emberlog.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert bag(registry.queries()[name](spark, "/root/testdata/sf0.001").select(columns).collect()) == bag(got.fetchall())


def test_pipeline_asks_for_written_verdicts(spark, docs):
    import corpus_pipeline as C

    plan = C.quality(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "kept" in plan and "sqrt" not in plan and "repeat_words" not in plan


def test_what_is_asked_again_and_again_is_worked_on_once():
    from emberlog.llm import bpe

    asked = []
    known = bpe.Recent(lambda k: asked.append(k) or k.upper(), 20)
    for k in range(200):
        assert known["often"] == "OFTEN" and known[f"once{k}"] == f"ONCE{k}"
        assert len(known) + len(known.older) <= 20
    assert asked.count("often") == 1 and known["x" * 65] == "X" * 65 and "x" * 65 not in known
