"""Enrichment: a model's replies made safe and written beside their segments, the gate before it, and vectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import let, phonetic_key, skeleton_key, squeeze, strip_fences

# How many topics, facts and commitments one segment may give, and whose promises there are.
MOST_TOPICS, MOST_FACTS, MOST_COMMITMENTS = 6, 8, 4
DIRECTIONS = ["i_owe", "owed_to_me"]
#: Lists hold raw JSON elements, so one that is no object spoils nothing but itself.
REPLY = "summary string, topics array<string>, importance string, sentiment string, facts array<string>, commitments array<string>"
FACT = "subject string, predicate string, object string, confidence string"
PROMISE = "text string, direction string, due string, confidence string"
#: Characters of a text that a model is shown.
MOST_CHARS = 8000


def clamped(value: Column, low: float, high: float, default: float) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), number)))


def line(value: Column, most: int) -> Column:
    return squeeze(F.coalesce(value, F.lit("")), most)


def clean(reply: Column, predicates: list[str], owner: str = "the owner", aliases: tuple[str, ...] = ("me",)) -> Column:
    """A JSON reply as summary, topics, importance, sentiment, facts and commitments, all bounded, typed and clamped.

    Facts with a predicate outside the vocabulary go, and so do those without subject or object, and commitments without
    a text or of another direction. The owner's names are one name. A reply that is no JSON object gives nothing.
    """
    named = [a.strip().lower() for a in (*aliases, owner) if a.strip()]

    def fact(raw: Column) -> Column:
        f = F.from_json(raw, FACT)
        who = F.trim(line(f["subject"], 80))
        subject = F.when(F.lower(who).isin(named), owner).otherwise(who)
        predicate = F.replace(F.lower(line(f["predicate"], 40)), F.lit(" "), F.lit("_"))
        return F.struct(subject.alias("subject"), predicate.alias("predicate"), line(f["object"], 200).alias("object"), clamped(f["confidence"], 0, 1, 0.5).alias("confidence"))

    def promise(raw: Column) -> Column:
        c = F.from_json(raw, PROMISE)
        due = F.when(c["due"].rlike(r"^\d{4}-\d{2}-\d{2}$"), c["due"].try_cast("date"))
        return F.struct(line(c["text"], 300).alias("text"), c["direction"].alias("direction"), due.alias("due"), clamped(c["confidence"], 0, 1, 0.5).alias("confidence"))

    def whole(r: Column) -> Column:
        topics = F.array_distinct(F.filter(F.transform(F.coalesce(r["topics"], F.array().cast("array<string>")), lambda t: F.lower(line(t, 40))), lambda t: t != ""))
        known = lambda f: f["predicate"].isin(predicates) & (f["subject"] != "") & (f["object"] != "")
        facts = F.filter(F.transform(F.coalesce(r["facts"], F.array().cast("array<string>")), fact), known)
        promises = F.filter(F.transform(F.coalesce(r["commitments"], F.array().cast("array<string>")), promise), lambda c: (c["text"] != "") & F.coalesce(c["direction"].isin(DIRECTIONS), F.lit(False)))
        return F.struct(F.nullif(line(r["summary"], 600), F.lit("")).alias("summary"), F.slice(topics, 1, MOST_TOPICS).alias("topics"), clamped(r["importance"], 0, 1, 0.0).alias("importance"), clamped(r["sentiment"], -1, 1, 0.0).alias("sentiment"), F.slice(facts, 1, MOST_FACTS).alias("facts"), F.slice(promises, 1, MOST_COMMITMENTS).alias("commitments"))

    return let(F.from_json(strip_fences(reply), REPLY), whole)


def fact_line(f: Column) -> Column:
    """How a fact reads in a text."""
    return F.concat_ws(" ", f["subject"], F.replace(f["predicate"], F.lit("_"), F.lit(" ")), f["object"])


def find_or_create(names: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, entity_id) for names (name, seen, one row a mention), and the entities after these mentions.

    A name is the known person of its phonetic key (of several the most mentioned, then the least id), else the one of
    its own name, else a new one for all names of that key, called by the one seen first. Mentions, first and last sight
    and aliases are brought up to date. Skeleton keys are kept and never decide.
    """
    keyed = names.groupBy("name").agg(F.count("*").alias("n"), F.min("seen").alias("a"), F.max("seen").alias("b")).withColumn("key", phonetic_key(F.col("name")))
    person = entities.where("entity_type = 'person'")
    by_key = person.select(F.explode("phonetic_keys").alias("key"), "mention_count", "entity_id").groupBy("key").agg(F.min_by("entity_id", F.struct(-F.col("mention_count"), "entity_id")).alias("by_key"))
    by_name = person.groupBy(F.col("canonical_name").alias("name")).agg(F.min("entity_id").alias("by_name"))
    found = keyed.join(by_key, "key", "left").join(by_name, "name", "left").withColumn("entity_id", F.coalesce("by_key", "by_name", F.xxhash64(F.lit("person"), "key")))
    fresh = found.where("by_key is null and by_name is null").groupBy("entity_id", "key").agg(F.min_by("name", F.struct("a", "name")).alias("canonical_name"))
    bare = skeleton_key(F.col("canonical_name"))
    created = fresh.select("entity_id", F.lit("person").alias("entity_type"), "canonical_name", F.array().cast("array<string>").alias("aliases"), F.array("key").alias("phonetic_keys"), F.when(F.length(bare) >= 2, F.array(bare)).otherwise(F.array().cast("array<string>")).alias("skeleton_keys"), F.lit(0).cast("long").alias("mention_count"), F.lit(None).cast("timestamp").alias("first_seen_at"), F.lit(None).cast("timestamp").alias("last_seen_at"))
    seen = found.groupBy("entity_id").agg(F.sum("n").alias("_n"), F.min("a").alias("_a"), F.max("b").alias("_b"), F.array_sort(F.collect_set("name")).alias("_names"))
    every = entities.select(created.columns).unionByName(created).join(seen, "entity_id", "left")
    none = F.array().cast("array<string>")
    return found.select("name", "entity_id"), every.withColumns({"mention_count": (F.col("mention_count") + F.coalesce("_n", F.lit(0))).cast("long"), "first_seen_at": F.least("first_seen_at", "_a"), "last_seen_at": F.greatest("last_seen_at", "_b"), "aliases": F.array_union(F.coalesce("aliases", none), F.coalesce("_names", none))}).select(created.columns)


def write_enrichment(replies: DataFrame, segments: DataFrame, entities: DataFrame, facts: DataFrame, commitments: DataFrame, mentions: DataFrame, deps: DataFrame, predicates: list[str], version: str = "enrich-1", owner: str = "the owner", aliases: tuple[str, ...] = ("me",)) -> dict[str, DataFrame]:
    """The tables after replies (segment_id, reply) are written: what a segment gave before is replaced, not added to.

    facts: fact_id, subject_id, predicate, object, t_valid, version, confidence, source_segment_id, source_event_ids,
    extractor_version. commitments: commitment_id, text, direction, stated_at, due_at, confidence, source_segment_id,
    source_event_ids, extractor_version, status, resolution_segment_id. mentions: entity_id, segment_id, ts. deps:
    projection_kind, projection_id, source, source_id. A fact's version is its segment's start in milliseconds, so that
    order by version is order in time. Embedding and embed_text stay as they are.
    """
    one = replies.dropDuplicates(["segment_id"])
    got = segments.select("segment_id", "started_at", "source_event_ids").join(one, "segment_id").withColumn("c", clean(F.col("reply"), predicates, owner, aliases))
    ids = got.select("segment_id")
    said = got.select("segment_id", "started_at", "source_event_ids", F.posexplode("c.facts").alias("k", "f"))
    who, known = find_or_create(said.select(F.col("f.subject").alias("name"), F.col("started_at").alias("seen")), entities)
    said = said.withColumn("name", F.col("f.subject")).join(who, "name")
    new_facts = said.select(
        F.xxhash64(F.lit("fact"), "segment_id", "k").alias("fact_id"), F.col("entity_id").alias("subject_id"), F.col("f.predicate").alias("predicate"), F.col("f.object").alias("object"), F.lit(1).alias("polarity"), F.col("started_at").alias("t_valid"), F.unix_millis(F.col("started_at").cast("timestamp")).alias("version"),
        F.col("f.confidence").alias("confidence"), F.col("segment_id").alias("source_segment_id"), "source_event_ids", F.lit(version).alias("extractor_version"),
    )
    promised = got.select("segment_id", "started_at", "source_event_ids", F.posexplode("c.commitments").alias("k", "p"))
    new_promises = promised.select(
        F.xxhash64(F.lit("commitment"), "segment_id", "k").alias("commitment_id"), F.col("p.text").alias("text"), F.col("p.direction").alias("direction"), F.col("started_at").alias("stated_at"), F.col("p.due").alias("due_at"), F.col("p.confidence").alias("confidence"),
        F.col("segment_id").alias("source_segment_id"), "source_event_ids", F.lit(version).alias("extractor_version"), F.lit("open").alias("status"), F.lit(None).cast("long").alias("resolution_segment_id"),
    )
    before = ids.withColumnRenamed("segment_id", "source_segment_id")
    kinds = [("fact", facts, new_facts), ("commitment", commitments, new_promises)]
    lost = [rows.join(before, "source_segment_id", "left_semi").select(F.lit(kind).alias("projection_kind"), F.col(f"{kind}_id").alias("projection_id")) for kind, rows, _ in kinds]
    cited = [rows.select(F.lit(kind).alias("projection_kind"), F.col(f"{kind}_id").alias("projection_id"), F.explode("source_event_ids").alias("ref")) for kind, _, rows in kinds]
    refs = cited[0].unionByName(cited[1]).select("projection_kind", "projection_id", F.substring_index("ref", ":", 1).alias("source"), F.expr("substring(ref, instr(ref, ':') + 1)").alias("source_id"))
    after = {f"{kind}s": rows.join(before, "source_segment_id", "left_anti").unionByName(new, allowMissingColumns=True).select(rows.columns) for kind, rows, new in kinds}
    text = F.nullif(F.trim(F.concat_ws(" ", "c.summary", F.array_join("c.topics", " "), F.array_join(F.transform("c.facts", fact_line), " "))), F.lit(""))
    fields = {"summary": F.col("c.summary"), "topics": F.col("c.topics"), "importance": F.col("c.importance"), "sentiment": F.col("c.sentiment"), "enrich_text": text, "extractor_version": F.lit(version)}
    done = got.select("segment_id", *[c.alias(f"_{k}") for k, c in fields.items()], F.lit(True).alias("_done"))
    old = {k: F.col(k) if k in segments.columns else F.lit(None) for k in fields}
    marked = segments.join(done, "segment_id", "left")
    return after | {
        "segments": marked.withColumns({k: F.when(F.col("_done"), F.col(f"_{k}")).otherwise(old[k]) for k in fields}).drop("_done", *[f"_{k}" for k in fields]),
        "entities": known,
        "mentions": mentions.join(ids, "segment_id", "left_anti").unionByName(said.select("entity_id", "segment_id", F.col("started_at").alias("ts")).distinct()),
        "deps": deps.join(lost[0].unionByName(lost[1]), ["projection_kind", "projection_id"], "left_anti").unionByName(refs.distinct()),
    }


class Pace:
    """At most rpm calls a minute in one task; 0: no limit. From the first call on time is a grid of slots of 60 / rpm
    seconds, and each call takes the first slot that has neither passed nor been taken."""

    def __init__(self, rpm: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rpm, self.clock, self.sleep, self.start, self.taken = rpm, clock, sleep, None, -1

    def wait(self) -> None:
        if self.rpm <= 0:
            return
        self.start = self.clock() if self.start is None else self.start
        passed = (self.clock() - self.start) * self.rpm / 60
        self.taken = max(self.taken + 1, ceil(passed))
        if self.taken > passed:
            self.sleep((self.taken - passed) * 60 / self.rpm)


class Transient(Exception):
    """A failure that may pass: too many requests, or the other side's fault."""


def patiently(call: Callable[[], object], pace: Pace) -> object:
    """The call's result; a transient failure is tried once more, any other raises at once."""
    pace.wait()
    try:
        return call()
    except Transient:
        pace.wait()
        return call()


def gate_scores(segments: DataFrame, score: Callable[[str], float], version: str, rpm: float = 0, tasks: int = 1) -> DataFrame:
    """segments with gate_p and gate_version of this version: known scores stay, others are asked for.

    score sees the first MOST_CHARS characters. rpm is shared out among tasks, in which the unknown are dealt. A text
    that cannot be scored gets none; if none of a task's texts can, the gate itself is broken and the job fails.
    """
    known = F.coalesce((F.col("gate_version") == version) & F.col("gate_p").isNotNull(), F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace, good, bad = Pace(rpm / tasks), 0, None
        for rows in batches:
            out = []
            for text in rows["raw_text"]:
                try:
                    out.append(float(patiently(lambda: score((text or "")[:MOST_CHARS]), pace)))  # noqa: B023
                    good += 1
                except Exception as error:  # noqa: BLE001  one text's failure is not the gate's
                    out.append(None)
                    bad = error
            yield pd.DataFrame({"segment_id": rows["segment_id"], "_p": pd.array(out, dtype="Float64")})
        if bad is not None and not good:
            raise RuntimeError("no text could be scored") from bad

    asked = segments.where(~known).select("segment_id", "raw_text").repartition(tasks).mapInPandas(run, "segment_id long, _p double")
    out = segments.join(asked, "segment_id", "left")
    return out.withColumns({"gate_p": F.when(known, F.col("gate_p")).otherwise(F.col("_p")), "gate_version": F.when(known | F.col("_p").isNotNull(), F.lit(version)).otherwise(F.col("gate_version"))}).drop("_p")


def asked(segments: DataFrame, model: Callable[[str], str], rpm: float = 0, tasks: int = 1) -> DataFrame:
    """segment_id, reply of a model that is asked about the first MOST_CHARS characters of each text; a text that fails has
    no reply. rpm is shared out among tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(rpm / tasks)
        for rows in batches:
            out = []
            for text in rows["raw_text"]:
                try:
                    out.append(patiently(lambda: model((text or "")[:MOST_CHARS]), pace))  # noqa: B023
                except Exception:  # noqa: BLE001  asked again in the next run
                    out.append(None)
            yield pd.DataFrame({"segment_id": rows["segment_id"], "reply": out})

    return segments.select("segment_id", "raw_text").repartition(tasks).mapInPandas(run, "segment_id long, reply string")


def gated(scored: DataFrame, threshold: float = 0.42, skip: bool = False) -> DataFrame:
    """scored with passes: p of threshold and more, or no score. With skip only those are left; else all, as a shadow."""
    out = scored.withColumn("passes", F.coalesce(F.col("gate_p") >= threshold, F.lit(True)))
    return out.where("passes") if skip else out


def hashed_encoder(dimensions: int = 1024) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for an encoder where no model is at hand: signed hashes of words and their letter triples."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                for part in (word, *(f"#{word}#"[k : k + 3] for k in range(len(word)))):
                    h = zlib.crc32(part.encode())
                    row[h % dimensions] += 1 if h >> 31 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(size, 1e-9)

    return encode


def embed_missing(segments: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], version: str, batch: int = 64, most: int | None = None) -> DataFrame:
    """segments with embedding and embedder_version where there was none, the newest first where most limits a run.

    load builds the encoder (texts to rows of one width), once a Python worker; rows come in Arrow batches.
    """
    missing = segments.where("embedding is null")
    todo = missing if most is None else missing.orderBy(F.desc_nulls_last("started_at"), F.desc("segment_id")).limit(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for rows in batches:
            for k in range(0, len(rows), batch):
                some = rows.iloc[k : k + batch]
                yield pd.DataFrame({"segment_id": some["segment_id"], "_v": list(encode(some["embed_text"].tolist()).astype(np.float32))})

    made = todo.select("segment_id", F.coalesce("embed_text", F.lit("")).alias("embed_text")).mapInPandas(run, "segment_id long, _v array<float>")
    out = segments.join(made, "segment_id", "left")
    stamp = F.when(F.col("_v").isNotNull(), F.lit(version)).otherwise(F.col("embedder_version") if "embedder_version" in segments.columns else F.lit(None))
    return out.withColumns({"embedder_version": stamp, "embedding": F.coalesce("_v", "embedding")}).drop("_v")
