"""python -m emberlog COMMAND --root FOLDER: the archive's stages over the tables of a folder.

ingest takes events (schema.EVENT) from Parquet or JSON-lines paths; fit-gaps, segment, resegment and embed follow; all runs
them in order; enrich asks a model about segments; doctor prints what is odd, freshness which sources went quiet; vacuum
deletes what no late state names. Every command is one commit, or one for each path.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import schema
from emberlog.operators import enrichment, lifecycle, quality, segments
from emberlog.sources.policy import policies
from emberlog.store import Change, Store, keep, kept, scratch_path

GAPS = "thread_key string, gap_seconds long, method string, n_samples long"
SOURCES = "source string, last_ingested_at timestamp, last_error string"
DERIVED = {"entities": schema.ENTITY, "facts": schema.FACT, "commitments": schema.COMMITMENT, "mentions": schema.MENTION, "deps": schema.DEPENDENCY}


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows, written down: what several tables of a change come from is worked out once."""
    path = scratch_path(rows.sparkSession, name)
    keep(rows.write, path)
    return kept(rows.sparkSession, path)



def described(store: Store, rows: DataFrame | None = None) -> DataFrame:
    """Events with what segmentation needs besides: density by source policy, chat title, transcript, OCR text."""
    rows = store.read("events", schema.EVENT) if rows is None else rows
    known = policies(store.spark).select("source", "density")  # a row a source policy
    more = {c: F.lit(None).cast("string") for c in ("transcript", "ocr_text") if c not in rows.columns}
    return rows.join(F.broadcast(known), "source", "left").withColumns({"chat_title": F.get_json_object("payload", "$.chat_title"), **more})


def ingested(store: Store, incoming: DataFrame, max_events: int = segments.MAX_EVENTS) -> Change:
    """The change that events make: they are upserted in the years they touch, segments that cite a changed event are
    written anew from their events, and each source's watermark moves, all in one commit."""
    incoming = incoming.select(*[c.split(" ")[0] for c in schema.EVENT.split(", ")])
    change = store.change()
    years = sorted(r[0] for r in incoming.select(F.coalesce(F.year("ts"), F.lit(0)).alias("y")).distinct().collect())  # a few dozen
    done = written(lifecycle.upsert_events(store.read("events", schema.EVENT, years), incoming), "ingest")
    change.write_years("events", done.drop("change"), "ts", years)
    changed = done.where("change = 'updated'").select("source", "source_id")
    if store.has("segments") and not changed.isEmpty():
        old = store.read("segments", schema.SEGMENT)
        now = described(store, store.read("events", schema.EVENT).where(~F.coalesce(F.year("ts"), F.lit(0)).isin(years)).unionByName(done.drop("change")))
        new = written(segments.rewritten(changed, now, old, max_events), "segments")
        change.write("segments", new)
    sources = store.read("sources", SOURCES)
    fresh = incoming.select("source").distinct().join(sources.select("source"), "source", "left_anti").withColumns({"last_ingested_at": F.lit(None).cast("timestamp"), "last_error": F.lit(None).cast("string")})
    moved = lifecycle.advance_watermarks(sources.unionByName(fresh), incoming)
    well = incoming.select("source").distinct().withColumn("_well", F.lit(True))
    change.write("sources", moved.join(well, "source", "left").withColumn("last_error", F.when(F.col("_well").isNull(), F.col("last_error"))).drop("_well"))
    return change


def ingest(store: Store, args: argparse.Namespace) -> None:
    """Each path of the input is a commit of its own; one that cannot be read is noted with the source it is named after,
    and does not stop the others."""
    reader = store.spark.read
    for path in args.input.split(","):
        try:
            incoming = reader.schema(schema.EVENT).json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)
            ingested(store, incoming, args.max_messages).commit()
        except Exception as error:  # one source's failure is its own
            source = path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
            failed(store, source, f"{type(error).__name__}: {error}"[:500])
            print(f"{path}: {type(error).__name__}", file=sys.stderr)


def failed(store: Store, source: str, error: str) -> None:
    sources = store.read("sources", SOURCES)
    own = store.spark.createDataFrame([(source, None, error)], SOURCES)
    old = sources.where(F.col("source") == source).select("last_ingested_at")
    kept_mark = own.drop("last_ingested_at").join(old.agg(F.max("last_ingested_at").alias("last_ingested_at")), F.lit(True), "left")  # a row on either side
    store.write("sources", sources.where(F.col("source") != source).unionByName(kept_mark.select(sources.columns)))


def fit_gaps(store: Store, args: argparse.Namespace) -> None:
    store.write("gaps", segments.fit_gaps(described(store).where("density = 'narrative'"), "thread_key", "ts"))


def segment(store: Store, args: argparse.Namespace) -> None:
    old = store.read("segments", schema.SEGMENT)
    new = segments.advance_segments(described(store), old, store.read("gaps", GAPS), args.max_messages)
    left = old.join(new.where("replaces is not null").select(F.col("replaces").alias("segment_id")), "segment_id", "left_anti")
    # What takes a segment's place keeps its id and starts without anything derived.
    named = new.withColumn("segment_id", F.coalesce("replaces", "segment_id")).drop("replaces")
    store.write("segments", left.unionByName(named.drop(*[c for c in named.columns if c not in left.columns]), allowMissingColumns=True))


def derived(store: Store) -> dict[str, DataFrame]:
    """What enrichment has written."""
    return {name: store.read(name, kind) for name, kind in DERIVED.items()}


def resegment(store: Store, args: argparse.Namespace) -> None:
    """Threads are cut anew; what was drawn from their old segments goes in the same commit."""
    if not args.thread:
        raise SystemExit("resegment needs --thread")
    old = store.read("segments", schema.SEGMENT)
    threads = store.spark.createDataFrame([(t,) for t in args.thread], "thread_key string")
    more = derived(store)
    out = segments.rebuild_threads(threads, described(store), old, more["facts"], more["commitments"], more["mentions"], more["deps"], store.read("gaps", GAPS), args.max_messages)
    change = store.change()
    change.write("segments", out["kept"].unionByName(out["segments"].drop(*[c for c in out["segments"].columns if c not in old.columns]), allowMissingColumns=True))
    for name in ("facts", "commitments", "mentions", "deps"):
        change.write(name, out[name].select(more[name].columns))
    change.commit()


def enrich(store: Store, args: argparse.Namespace) -> None:
    """Substantive narrative segments of sources with a bank that have no enrichment yet, the newest first and --limit of
    them, are given to the model (--model module:function, a text to a JSON reply); what it says is written in one commit. A
    text that fails is left for the next run. With --gate (module:function, a text to a probability) scores are kept, and with
    --skip those under the threshold are not asked about."""
    if not args.model:
        print("enrich is skipped: no --model", file=sys.stderr)
        return
    old = store.read("segments", schema.SEGMENT)
    known = {c: F.lit(None).cast(k) for c, k in (("gate_p", "double"), ("gate_version", "string")) if c not in old.columns}
    rows = old.withColumns(known)
    policy = policies(store.spark).select("source", "density", "bank")
    queue = lifecycle.gate_queue(rows, policy, threshold=-1.0)
    if args.thread:
        queue = queue.where(F.col("thread_key").isin(args.thread))
    queue = written(queue.orderBy(F.desc("started_at"), "segment_id").limit(args.limit).select(rows.columns), "queue")
    if args.gate:
        queue = written(enrichment.gate_scores(queue, loaded(args.gate), args.gate, args.rpm), "scored")
        scored = queue.select("segment_id", F.col("gate_p").alias("_p"), F.col("gate_version").alias("_v"))
        rows = rows.join(scored, "segment_id", "left").withColumns({"gate_p": F.coalesce("_p", "gate_p"), "gate_version": F.coalesce("_v", "gate_version")}).drop("_p", "_v")
        queue = enrichment.gated(queue, skip=args.skip)
    replies = written(enrichment.asked(queue, loaded(args.model), args.rpm), "replies").where("reply is not null")
    more = derived(store)
    out = enrichment.write_enrichment(replies, rows, more["entities"], more["facts"], more["commitments"], more["mentions"], more["deps"], [p for p, _ in schema.PREDICATES])
    change = store.change()
    change.write("segments", out["segments"])
    for name in DERIVED:
        change.write(name, out[name])
    change.commit()


def loaded(name: str):
    """module:function"""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def embed(store: Store, args: argparse.Namespace) -> None:
    store.write("segments", enrichment.embed_missing(store.read("segments", schema.SEGMENT), enrichment.hashed_encoder, "hashed-1").drop("embedder_version"))


def doctor(store: Store, args: argparse.Namespace) -> None:
    since = F.current_timestamp() - F.expr("interval 90 days")
    rows = quality.doctor_sample(described(store), "source", ["watermark_ts", "ts", "source_id"], since)
    quality.doctor_checks(rows, "source", ["watermark_ts", "ts", "source_id"]).show(1000, False)


def freshness(store: Store, args: argparse.Namespace) -> None:
    quality.freshness(store.read("events", schema.EVENT), "source", "ts", F.current_timestamp()).show(1000, False)


COMMANDS = {"ingest": ingest, "fit-gaps": fit_gaps, "segment": segment, "resegment": resegment, "embed": embed, "enrich": enrich, "vacuum": lambda store, args: store.vacuum(), "doctor": doctor, "freshness": freshness}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="emberlog")
    parser.add_argument("command", choices=[*COMMANDS, "all"])
    parser.add_argument("--root", required=True)
    parser.add_argument("--input")
    parser.add_argument("--max-messages", type=int, default=segments.MAX_EVENTS)
    parser.add_argument("--thread", action="append")
    parser.add_argument("--model")
    parser.add_argument("--gate")
    parser.add_argument("--skip", action="store_true")
    parser.add_argument("--rpm", type=float, default=0)
    parser.add_argument("--limit", type=int, default=2000)
    args = parser.parse_args(argv)
    names = ["ingest", "fit-gaps", "segment", "embed"] if args.command == "all" else [args.command]
    if "ingest" in names and not args.input:
        parser.error("ingest needs --input")
    store = Store(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), args.root)
    for name in names:
        COMMANDS[name](store, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
