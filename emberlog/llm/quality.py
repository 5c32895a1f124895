"""Operator 4 [native]: quality rules by robust multivariate outliers (minimum covariance determinant).

Each document's statistics become a vector; for each language and source a centre and covariance are fitted to the
tightest three quarters of its documents (concentration steps from a median start), and documents far away in that
metric, on the side where text is worse, are rejected. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import SPACE_CLASS, materialize, table

SYMBOLS = "#*$%&|<>"
FEATURES = ["f_word_length", "f_symbols", "f_dup_lines", "f_repeats"]
P = len(FEATURES)
#: Share of a group that the estimate is fitted to, and the factor that makes it consistent for normal data (P = 4).
SHARE, CONSISTENT = 0.75, 1.485
STEPS = 3
#: Medians and distance quantiles come from counts in bins of this width, so they are exact to it and the same in any order.
BIN = 0.002
#: Added to each variance: what is constant in the clean part must not make small deviations infinitely far.
RIDGE = [0.02**2, 0.01**2, 0.04**2, 0.04**2]
#: What chance adds to each variance of one document: the root of a share of n parts varies by 1 / (4 n), and a repeat covers six words.
NOISE = [(0.25, "n_words"), (0.25, "word_chars"), (0.25, "n_lines"), (1.5, "n_words")]
#: Groups with fewer documents use the estimate of their language, or else of all documents.
MIN_GROUP = 200
#: Squared distance from which a document is rejected: the 0.999 quantile of chi-square with P degrees of freedom.
CUTOFF = 18.467


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, the first included."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        repeated = let(placed, lambda s: F.filter(s, lambda x, k: same(s, k, k - 1) | same(s, k, k + 1)))
        places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))
    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(windows(w), counted)))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, the two group columns (null: empty), n_words and the base statistics of every whole text (null: no words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(group_cols[0]).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(group_cols[1]).cast("string"), F.lit("")).alias("source"), text.alias("text"))
    words = F.array_remove(F.split("text", f"{SPACE_CLASS}+"), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    stats = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    line_stats = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = rows.select(
        "doc_id", "lang", "source", stats.alias("w"), line_stats.alias("l"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), F.xxhash64("text").alias("text_hash"),
    )
    return out.select("doc_id", "text_hash", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def features(stats: DataFrame) -> DataFrame:
    """The transformed vector: log mean word length and square roots of three shares (0 without words)."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return stats.withColumns({"f_word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), "f_symbols": share("n_symbols", "word_chars"), "f_dup_lines": share("n_dup_lines", "n_lines"), "f_repeats": share("n_repeat_words", "n_words")})


def weighted_quantile(counts: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """keys and name: the upper edge of the bin (keys, bin, n) in which the share of each group's values is reached."""
    w = Window.partitionBy(*keys)
    upto = counts.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    return upto.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(((F.min("bin") + 1) * BIN).alias(name))


def binned_quantile(rows: DataFrame, keys: list[str], value: Column, share: float, name: str) -> DataFrame:
    """keys and name: the quantile of value by group, exact to BIN."""
    return weighted_quantile(rows.groupBy(*keys, F.floor(value / BIN).alias("bin")).agg(F.count("*").alias("n")), keys, share, name)


def squared_distance(rows: DataFrame, one_sided: bool = False) -> tuple[DataFrame, Column]:
    """From the joined columns m0.. (centre) and c00.. (lower triangle of the Cholesky factor). one_sided: a share below
    its centre counts as the centre, as fewer symbols, repeated lines or repeated words make no text worse."""
    y: list[Column] = []
    for i, f in enumerate(FEATURES):
        rest = F.col(f) - F.col(f"m{i}")
        rest = F.greatest(rest, F.lit(0.0)) if one_sided and i else rest
        for j in range(i):
            rest = rest - F.col(f"c{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"c{i}{i}"))
        y.append(F.col(f"y{i}"))
    return rows, sum((v * v for v in y[1:]), y[0] * y[0])


def with_distance(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """grp, the features and d2; and edge, where fit has one. Expressions are put together before they are planned."""
    z = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    y = [sum((F.col(f"w{i}{j}") * z[j] for j in range(i)), F.col(f"w{i}{i}") * z[i]) for i in range(P)]
    more = [c for c in ("edge",) if c in fit.columns]
    return rows.join(fit, "grp").select("grp", *FEATURES, *more, sum((v * v for v in y[1:]), y[0] * y[0]).alias("d2"))


def with_inverse(fit: DataFrame) -> DataFrame:
    """The factor's columns c00.. and those of its inverse, w00.., one group a row: distances of rows are sums then."""
    for j in range(P):
        for i in range(j, P):
            rest = F.lit(1.0) if i == j else -sum((F.col(f"c{i}{k}") * F.col(f"w{k}{j}") for k in range(j + 1, i)), F.col(f"c{i}{j}") * F.col(f"w{j}{j}"))
            fit = fit.withColumn(f"w{i}{j}", rest / F.col(f"c{i}{i}"))
    return fit


def with_factor(rows: DataFrame) -> DataFrame:
    """From columns v00.. (lower triangle of a covariance) to c00.. beside the other columns."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"v{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
            rows = rows.withColumn(f"c{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"c{j}{j}"))
    return rows


def cholesky(fit: DataFrame) -> DataFrame:
    """The factor of each group's covariance, one group a row."""
    lower = [(i, j) for i in range(P) for j in range(i + 1)]
    return with_inverse(with_factor(fit)).select("grp", *[f"m{i}" for i in range(P)], *[f"{x}{i}{j}" for x in "cw" for i, j in lower])


def widened(rows: DataFrame) -> DataFrame:
    """c00.. of each document's group with what chance adds for a document of this size."""
    back = {f"v{i}{j}": sum((F.col(f"c{i}{k}") * F.col(f"c{j}{k}") for k in range(1, j + 1)), F.col(f"c{i}0") * F.col(f"c{j}0")) for i in range(P) for j in range(i + 1)}
    back |= {f"v{i}{i}": back[f"v{i}{i}"] + F.lit(a) / F.greatest(F.col(n), F.lit(1)) for i, (a, n) in enumerate(NOISE)}
    return with_factor(rows.withColumns(back))


def concentrate(rows: DataFrame, scale: float) -> DataFrame:
    """Centre and covariance (times scale, plus the ridge) of rows by group."""
    sums = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    products = [F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"v{i}{j}") for i in range(P) for j in range(i + 1)]
    got = rows.groupBy("grp").agg(*sums, *products)
    return cholesky(got.withColumns({f"v{i}{j}": (F.col(f"v{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale + (RIDGE[i] if i == j else 0.0) for i in range(P) for j in range(i + 1)}))


def mcd(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate for each grp of rows (grp and the features).

    Starts from medians and a diagonal of median absolute deviations; each step keeps the SHARE of a group that is
    nearest under the present estimate and refits to it, which never raises the determinant.
    """
    # One pass over the rows: counts by group, feature and bin, pre-aggregated before the shuffle. The rest is bins.
    binned = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.floor(F.col(f) / BIN).alias("bin")) for i, f in enumerate(FEATURES)])).alias("x")).groupBy("grp", "x.k", "x.bin").agg(F.count("*").alias("n"))
    binned = materialize(binned)
    median = weighted_quantile(binned, ["grp", "k"], 0.5, "mid")
    away = binned.join(median, ["grp", "k"]).select("grp", "k", F.floor(F.abs((F.col("bin") + 0.5) * BIN - F.col("mid")) / BIN).alias("bin"), "n")
    spread = weighted_quantile(away.groupBy("grp", "k", "bin").agg(F.sum("n").alias("n")), ["grp", "k"], 0.5, "mad")
    start = median.join(spread, ["grp", "k"]).groupBy("grp").agg(*[F.max(F.when(F.col("k") == i, F.col("mid"))).alias(f"m{i}") for i in range(P)], *[F.max(F.when(F.col("k") == i, F.pow(F.col("mad") * 1.4826, 2) + RIDGE[i])).alias(f"v{i}{i}") for i in range(P)])
    fit = materialize(cholesky(start.withColumns({f"v{i}{j}": F.lit(0.0) for i in range(P) for j in range(i)})))
    for step in range(STEPS):
        # The edge is written before it is used: two small plans, each planned anew as its stages end, weigh less on the driver than one.
        edge = materialize(fit.join(binned_quantile(with_distance(rows, fit), ["grp"], F.log1p("d2"), SHARE, "edge"), "grp"))
        kept = with_distance(rows, edge).where(F.log1p("d2") <= F.col("edge"))
        fit = materialize(concentrate(kept, CONSISTENT if step == STEPS - 1 else 1.0))
    return fit


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_words, the base statistics, base_failed, distance (squared; null if base_failed) and kept.

    A document without words fails the base rule, as do those under 50 words or with more than half of their words in
    repeated windows; they take no part in the fit. The rest are judged against their language and source (null counts
    as its own value), or their language, or all documents, whichever is the first with MIN_GROUP documents. Rejected:
    one-sided distance (odd word lengths, more symbols, repeated lines or repeated words than the centre) beyond cutoff,
    under the group's covariance widened by what chance gives a document of its size.
    Repeated rows are judged alike; an empty table gives an empty result; other columns are not read.

    The text is read once and no text is shuffled: what is grouped are four numbers a document. A hot source only adds
    to bin counts and sums, which are pre-aggregated before each shuffle.
    """
    stats = materialize(features(text_statistics(docs, id_col, text_col, group_cols)).withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)))
    levels = [F.concat_ws("\x01", F.lit("s"), "lang", "source"), F.concat_ws("\x01", F.lit("l"), "lang"), F.lit("a")]
    passed = stats.where("not base_failed")
    rows = passed.select(F.explode(F.array(*levels)).alias("grp"), *FEATURES)
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n")).where((F.col("n") >= MIN_GROUP) | (F.col("grp") == "a")).select("grp")
    big = materialize(sizes)
    fit = mcd(rows.join(big, "grp"))
    # Each (language, source) picks its level once; then one join gives every document its estimate.
    names = passed.select("lang", "source").distinct().select("lang", "source", F.posexplode(F.array(*levels)).alias("k", "grp"))
    chosen = names.join(big, "grp").groupBy("lang", "source").agg(F.min_by("grp", "k").alias("grp"))
    # Written down like the estimates: the plan that reads every document stays a small one.
    fits = materialize(chosen.join(fit, "grp").select(F.concat_ws("\x01", "lang", "source").alias("grp"), *[c for c in fit.columns if c[0] in "mc"]))
    judged, d2 = squared_distance(widened(stats.withColumn("grp", F.concat_ws("\x01", "lang", "source")).join(fits, "grp", "left")), one_sided=True)
    distance = F.when(~F.col("base_failed"), d2)
    kept = ~F.col("base_failed") & F.coalesce(distance <= cutoff, F.lit(True))
    return judged.select("doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), distance.alias("distance"), *FEATURES)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents; nulls, empty texts, repeats and empty tables as quality_rules has them."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("text_hash", *FEATURES)


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES: dict[str, str] = {}
