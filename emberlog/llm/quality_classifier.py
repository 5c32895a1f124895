"""Operator 12: quality classifier by naive Bayes support vectors.

A text's features are indicators of n-grams: of its bytes (one to three), and of what its words look like (one to three
words; a word is its case, digits, last character and whether it repeats one of the three words before it). Each indicator
is scaled by the log ratio of its frequency in the two classes, the vector is brought to unit length, and a linear
hinge-loss model is fitted by dual coordinate descent. Margins become probabilities by a sigmoid that is fitted to margins
of texts the model had not seen.

The model is fitted in one task to a bounded sample of labelled texts (most); everything else is narrow: texts are scored
where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import map_arrow, materialize, slices, table, text_rows
from emberlog.llm.words import Words

BITS = 16
BUCKETS = 1 << BITS
#: About how many labelled texts the model is fitted to (all, where there are fewer), chosen by a hash of the id.
MOST_LABELLED = 8000
COST, EPOCHS, FOLDS, SMOOTHING = 1.0, 12, 3, 1.0
#: Texts and bytes of text whose features a task holds at once.
TEXTS, PIECE_BYTES = 1 << 14, 1 << 20


def hashed(values: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of integers; a kind has its own hash."""
    h = (values.astype(np.uint64) + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.uint32)


def runs(symbols: np.ndarray, owner: np.ndarray, longest: int, radix: int, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every run of one to longest symbols of one text."""
    code = np.zeros(len(symbols), np.uint64)
    for n in range(1, longest + 1):
        code = code[: len(symbols) - n + 1] * np.uint64(radix) + symbols[n - 1 :].astype(np.uint64)
        if not len(code):
            return
        inside = owner[n - 1 :] == owner[: len(code)]
        yield owner[: len(code)][inside], hashed(code[inside], 16 * kind + n)


def word_looks(words: Words) -> np.ndarray:
    """For each word a number below 4096: case, digits, last byte's class, and which of the three words before it equals it."""
    data, starts, ends = words.data, words.starts, words.ends
    upper, lower, digit = ((data >= a) & (data <= b) for a, b in ((65, 90), (97, 122), (48, 57)))
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    within = lambda mask: (c := count(mask))[ends] - c[starts]
    n_upper, n_lower, n_digit = within(upper), within(lower), within(digit)
    last = data[ends - 1]
    kind = np.select([(last >= 128) | ((last | 32) >= 97) & ((last | 32) <= 122), (last >= 48) & (last <= 57), np.isin(last, np.frombuffer(b".,;:", np.uint8)), last == 33, last == 63], [0, 1, 2, 3, 4], 5)
    hashes, owner = words.hashes(), words.docs()
    again = np.zeros(len(starts), np.int64)
    for back in (3, 2, 1):
        same = np.zeros(len(starts), bool)
        same[back:] = (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])
        again[same] = back
    size = ends - starts
    case = np.select([n_upper == 0, (n_upper == 1) & upper[starts], n_lower == 0], [0, 1, 2], 3)
    return ((((case * 2 + (n_digit > 0)) * 6 + kind) * 4 + again) * 4 + np.digitize(size, [2, 6, 20])).astype(np.uint32)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket), each pair once, in order; texts: fewer than 2^16."""
    words = Words(texts)
    sizes = np.diff(words.offsets)
    of_byte = np.repeat(np.arange(len(sizes)), sizes)
    codes = [(o.astype(np.uint32) << np.uint32(BITS)) | b for stream in (runs(words.data, of_byte, 3, 256, 0), runs(word_looks(words) if len(words) else np.zeros(0, np.uint32), words.docs(), 3, 4096, 1)) for o, b in stream]
    codes = np.sort(np.concatenate([*codes, np.zeros(0, np.uint32)]))
    codes = codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes
    return (codes >> np.uint32(BITS)).astype(np.int64), (codes & np.uint32(BUCKETS - 1)).astype(np.int64)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch, PIECE_BYTES):
        for at in range(0, part.num_rows, TEXTS):
            yield part.slice(at, TEXTS)


def packed(buckets: np.ndarray) -> bytes:
    """A text's buckets: 16-bit numbers, or a bit each where those are longer; 8 KB at most."""
    if 2 * len(buckets) < BUCKETS // 8:
        return buckets.astype("<u2").tobytes()
    bits = np.zeros(BUCKETS, bool)
    bits[buckets] = True
    return np.packbits(bits).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    if len(blob) < BUCKETS // 8:
        return np.frombuffer(blob, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8)))


class Model:
    """weights: of unit-length vectors of scaled indicators; ratios: what indicators are scaled by; slope and shift of the sigmoid."""

    def __init__(self, weights: np.ndarray, ratios: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.ratios, self.bias, self.slope, self.shift = weights, ratios, bias, slope, shift

    def margins(self, owner: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        length = np.sqrt(np.bincount(owner, (self.ratios**2)[buckets], n))
        return np.bincount(owner, (self.weights * self.ratios)[buckets], n) / np.maximum(length, 1e-12) + self.bias

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log of how much more frequent each indicator is among the texts of class 1 than among those of class -1."""
    p, q = (SMOOTHING + np.bincount(np.concatenate([*(x for x, c in zip(rows, y, strict=True) if c == side), np.zeros(0, np.int64)]), minlength=BUCKETS) for side in (1, -1))
    return np.log((p / p.sum()) / (q / q.sum()))


def coordinate_descent(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """min |w|^2 / 2 + COST * sum of max(0, 1 - y w.x), by its dual, one text at a time in a fixed random order."""
    ratios = log_ratios(rows, y)
    values = [ratios[x] / max(1e-12, np.sqrt((ratios[x] ** 2).sum())) for x in rows]
    square = [float((v * v).sum()) + 1.0 for v in values]
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (float(w[x] @ v) + bias) - 1
            new = min(COST, max(0.0, alpha[i] - gradient / square[i]))
            if step := (new - alpha[i]) * y[i]:
                w[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return Model(w, ratios, bias)


def sigmoid_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift for which the smoothed classes are likeliest, by Newton's method."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(at[0], 1e-6)), float(at[1])


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """The model of texts (their buckets) and classes (1, -1), in a fixed order; without both classes only their share counts."""
    if not ((y > 0).any() and (y < 0).any()):
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    unseen = np.zeros(len(y))
    fold = np.zeros(len(y), np.int64)  # dealt out within each class
    for side in (1, -1):
        fold[y == side] = np.arange((y == side).sum()) % FOLDS
    for k in range(FOLDS):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(own) and (y[rest] > 0).any() and (y[rest] < 0).any():
            part = coordinate_descent([rows[i] for i in rest], y[rest])
            owner = np.repeat(np.arange(len(own)), [len(rows[i]) for i in own])
            unseen[own] = part.margins(owner, np.concatenate([rows[i] for i in own]), len(own))
    model = coordinate_descent(rows, y)
    model.slope, model.shift = sigmoid_fit(unseen, y)
    return model


def learned(docs: DataFrame, labels: DataFrame, most: int) -> Model:
    """The model of about most labelled texts: read by a filter on a set of ids of that size, which is broadcast."""
    ids = labels.where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).select("id", "y").distinct()
    share = min(1.0, most / max(1, ids.count()))
    some = materialize(ids.where(F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1 << 24)) < int(share * (1 << 24))))
    # Of documents that share an id the least text is learned from, so one id is one text.
    texts = docs.join(F.broadcast(some.select("id").distinct()), docs["doc_id"] == F.col("id")).groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = texts.join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("doc_id", "y", "text")

    def prepare(batch: pa.RecordBatch) -> dict:
        blobs: list[bytes] = []
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            owner, buckets = features(part.column("text"))
            blobs += [packed(b) for b in np.split(buckets, np.searchsorted(owner, np.arange(1, part.num_rows)))]
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "features": pa.array(blobs, pa.binary())}

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(r["doc_id"], r["y"], r["features"]) for b in batches for r in b.to_pylist()]
        got.sort()
        model = fit([unpacked(f) for _, _, f in got], np.array([1 if y else -1 for _, y, _ in got], np.int64))
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "ratios": [model.ratios.tobytes()], "bias": [model.bias], "slope": [model.slope], "shift": [model.shift]})

    examples = map_arrow(rows, prepare, "doc_id long, y int, features binary", PIECE_BYTES)
    got = examples.repartition(1).mapInArrow(fit_all, "weights binary, ratios binary, bias double, slope double, shift double").collect()
    if not got:  # no partition at all
        return fit([], np.zeros(0, np.int64))
    one = got[0]
    return Model(np.frombuffer(bytes(one["weights"])), np.frombuffer(bytes(one["ratios"])), one["bias"], one["slope"], one["shift"])


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", cutoff: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted (score >= cutoff) of every whole text.

    Learned from are labels 0 and 1 of documents whose crc32 of the id as text, modulo 4, is not 2 (a null id counts as
    the empty string and is never learned from); the others are held out. Null texts are empty; repeated rows are scored
    alike; an id with both labels counts as one text of each; of documents that share an id the least text is learned
    from. Without labels of both kinds every score is the smoothed share of label 1 (0.5 without any). An empty table
    gives an empty result. Only id and text of docs and id and label of labels are read.
    """
    out_of = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 4 == 2
    rows = text_rows(docs, id_col, text_col)
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    model = learned(rows, known.where(~out_of("id")), most)

    def score(batch: pa.RecordBatch) -> dict:
        out = []
        for part in pieces(batch):
            owner, buckets = features(part.column("text"))
            out.append(model.probabilities(model.margins(owner, buckets, part.num_rows)))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(np.concatenate(out))}

    scored = map_arrow(rows.withColumn("held_out", out_of("doc_id")), score, "doc_id long, held_out boolean, score double", PIECE_BYTES)
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents; nulls and repeats as quality_scores has them."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_quality_classifier": op12_quality_classifier}
ORACLES: dict[str, str] = {}
