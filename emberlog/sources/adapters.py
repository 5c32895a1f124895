"""Adapters: each turns a source's own tables into events (schema.EVENT). The tables come from any reader.

Every adapter takes since (exclusive) and until (inclusive) and applies them to the rows it reads, so they reach the
scan; telegram and nytka apply them to the instant of the last change and read ten minutes back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import money
from emberlog.functions.times import instant, is_muted
from emberlog.operators.sessions import gap_sessions, stays, timeline_sessions
from emberlog.sources.readers import register

OVERLAP = "interval 10 minutes"


def iso(ts: Column) -> Column:
    """An instant as ISO 8601 in UTC, with microseconds only where there are some."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == 0, "").otherwise(F.date_format(utc, ".SSSSSS")), F.lit("+00:00"))


def event(rows: DataFrame, source: str, source_id: Column, ts: Column, text: Column, thread_key: Column | None = None, kind: str | Column = "event", actor: Column | None = None, payload: list[Column] | None = None, reply_to: Column | None = None, watermark: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select(
        F.lit(source).alias("source"), source_id.cast("string").alias("source_id"), ts.cast("timestamp").alias("ts"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (actor if actor is not None else null).alias("actor"), text.alias("text"),
        (F.to_json(F.struct(*payload)) if payload else null).alias("payload"), (reply_to.cast("string") if reply_to is not None else null).alias("reply_to"), (thread_key if thread_key is not None else F.lit("default")).alias("thread_key"), (watermark if watermark is not None else ts).cast("timestamp").alias("watermark_ts"),
    )


def between(rows: DataFrame, col: Column, since: Column | None, until: Column | None) -> DataFrame:
    """Exclusive since, inclusive until; what is not given is not in the plan."""
    rows = rows.where(col > since) if since is not None else rows
    return rows.where(col <= until) if until is not None else rows


def some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def keyed(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), c.cast("string"))


def stay_text(minutes: Column) -> Column:
    return F.concat(F.lit("stayed at "), F.format_string("%.4f,%.4f", "lat", "lon"), F.lit(" for "), minutes.cast("string"), F.lit(" min"))


@register("telegram")
def telegram(messages: DataFrame, chats: DataFrame, excluded: DataFrame, since: Column | None = None, until: Column | None = None, personal_only: bool = False) -> DataFrame:
    """Every message written after since (its text, a late transcript, an edit), without the excluded chats (chat_id).

    chats (chat_id, type) may lack some: their messages stay. Rows without a readable date are left out.
    """
    synced, date = instant(messages, "synced_at"), instant(messages, "date")
    rows = between(messages, synced, since - F.expr(OVERLAP) if since is not None else None, until)
    rows = rows.where(date.isNotNull()).join(excluded.select("chat_id").distinct(), "chat_id", "left_anti").join(chats.select("chat_id", F.col("type").alias("chat_type")), "chat_id", "left")
    rows = rows.where("chat_type = 'user'") if personal_only else rows
    outgoing = F.coalesce(F.col("is_outgoing") == 1, F.lit(False))
    payload = [F.col("chat_id"), F.col("chat_title"), F.col("chat_type"), F.col("media_type"), F.when(outgoing, "sent").otherwise("received").alias("direction")]
    answered = F.when(F.col("reply_to_id").isNotNull() & (F.col("reply_to_id") != 0), F.concat_ws(":", F.col("chat_id").cast("string"), F.col("reply_to_id").cast("string")))
    return event(rows, "telegram", F.concat_ws(":", F.col("chat_id").cast("string"), F.col("id").cast("string")), date, F.coalesce("text", F.lit("")), keyed("telegram", F.col("chat_id")), "message", F.when(outgoing, "me").otherwise(F.col("sender_name")), payload, answered, F.coalesce(synced, date))


@register("wakapi")
def wakapi(heartbeats: DataFrame, since: Column | None = None, until: Column | None = None, user: str | None = None) -> DataFrame:
    """Sessions per project that fifteen minutes without a heartbeat end; the watermark is a session's end."""
    rows = heartbeats if user is None else heartbeats.where(F.col("user_id") == user)
    rows = rows.withColumn("ts", instant(heartbeats, "time")).where("ts is not null")
    rows = gap_sessions(between(rows, F.col("ts"), since, until), ["project"], "ts", 900, ["entity"])
    languages = F.array_sort(F.collect_set(some(F.col("language"))))
    got = rows.groupBy("project", "session").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), languages.alias("languages"), F.countDistinct(some(F.col("entity"))).alias("files_touched"))
    minutes = F.greatest(F.lit(1), F.floor((F.unix_micros("b") - F.unix_micros("a")) / 60e6))
    text = F.concat(F.lit("coded on "), F.col("project"), F.lit(" for "), minutes.cast("string"), F.lit(" min ("), F.array_join("languages", ", "), F.lit(")"))
    payload = [F.col("project"), F.col("languages"), F.col("files_touched"), minutes.alias("minutes"), iso(F.col("b")).alias("ended_at")]
    return event(got, "wakapi", F.concat_ws(":", F.col("project"), iso(F.col("a"))), F.col("a"), text, keyed("wakapi", F.col("project")), "coding_session", F.lit(user) if user else None, payload, None, F.col("b"))


@register("owntracks")
def owntracks(records: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Stays from location records (_type, tst, lat, lon, and user where several are read)."""
    points = records.where("_type = 'location' and tst is not null and lat is not null and lon is not null").withColumn("ts", F.timestamp_seconds("tst"))
    points = points if "user" in points.columns else points.withColumn("user", F.lit(""))
    s = stays(between(points, F.col("ts"), since, until), ["user"], "ts", order=["lat", "lon"])
    minutes = F.floor((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 60e6)
    payload = [F.col("lat"), F.col("lon"), minutes.alias("minutes"), F.col("n").alias("points"), iso(F.col("ended_at")).alias("ended_at")]
    return event(s, "owntracks", F.concat_ws(":", F.lit("stay"), some(F.col("user")), iso(F.col("started_at"))), F.col("started_at"), stay_text(minutes), F.lit("owntracks:stays"), "stay", F.lit("me"), payload, None, F.col("ended_at"))


@register("firefly")
def firefly(journals: DataFrame, legs: DataFrame, accounts: DataFrame, categories: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The positive leg of each journal that is not deleted; the account of its negative leg by a pre-aggregated join.

    journals: journal_id, date, description, type, category_id, deleted_at; legs: leg_id, journal_id, account_id,
    amount, currency, deleted_at; accounts: account_id, name; categories: category_id, category.
    """
    live = legs.where("deleted_at is null")
    names = lambda name: accounts.select("account_id", F.col("name").alias(name))
    positive = live.where("amount > 0").drop("deleted_at").join(names("to_name"), "account_id", "left")
    negative = live.where("amount < 0").groupBy("journal_id").agg(F.min_by("account_id", "leg_id").alias("account_id")).join(names("from_name"), "account_id", "left").select("journal_id", "from_name")
    date = instant(journals, "date")
    own = between(journals.where("deleted_at is null").withColumn("date", date), F.col("date"), since, until)
    rows = positive.join(own, "journal_id").join(negative, "journal_id", "left").join(categories.select("category_id", "category"), "category_id", "left")
    text = F.trim(F.concat(F.coalesce("type", F.lit("None")), F.lit(": "), F.coalesce("description", F.lit("None")), F.lit(" — "), money(F.col("amount")), F.lit(" "), F.coalesce("currency", F.lit(""))))
    payload = [F.col("amount").cast("double").alias("amount"), F.col("currency"), F.col("from_name").alias("from"), F.col("to_name").alias("to"), F.col("category"), F.col("type")]
    return event(rows, "firefly", F.col("journal_id"), F.col("date"), text, keyed("firefly", F.coalesce(some(F.col("category")), F.lit("uncategorized"))), "transaction", F.lit("me"), payload)


@register("immich")
def immich(assets: DataFrame, exif: DataFrame, since: Column | None = None, until: Column | None = None, owner: str | None = None) -> DataFrame:
    """Photo sets: silence of three hours ends one. Neither hidden, locked nor deleted assets; days are worked on apart."""
    rows = assets.where("deleted_at is null and visibility not in ('hidden', 'locked')")
    rows = rows if owner is None else rows.where(F.col("owner_id") == owner)
    rows = rows.join(exif, "asset_id", "left").withColumn("ts", F.coalesce("taken_at", "created_at")).where("ts is not null")
    rows = timeline_sessions(between(rows, F.col("ts"), since, until), "ts", 3 * 3600)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "asset_id")))
    listed = lambda c: F.array_sort(F.collect_set(some(F.col(c))))
    # The first 200 ids of a set: a set is what three hours of silence end, and its ids alone are held.
    ids = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ts", "asset_id"))), 1, 200), lambda x: x["asset_id"])
    got = rows.groupBy("session_start").agg(F.max("ts").alias("b"), F.count("*").alias("n"), listed("city").alias("places"), listed("country").alias("countries"), listed("type").alias("types"), first("lat").alias("lat"), first("lon").alias("lon"), ids.alias("asset_ids"))
    place = F.coalesce(some(F.array_join(F.array_sort(F.array_union("places", "countries")), ", ")), F.lit("unknown place"))
    payload = [F.col("n").alias("count"), *[F.col(c) for c in ("asset_ids", "places", "countries", "types", "lat", "lon")], iso(F.col("b")).alias("ended_at")]
    return event(got, "immich", keyed("photoset", iso(F.col("session_start"))), F.col("session_start"), F.concat(F.lit("took "), F.col("n").cast("string"), F.lit(" photos at "), place), F.lit("immich:photos"), "photo_session", F.lit("me"), payload, None, F.col("b"))


@register("nytka")
def nytka(utterances: DataFrame, conversations: DataFrame, voices: DataFrame, excluded: DataFrame, mute: list | None = None, zone: str = "UTC", since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Utterances of closed conversations (conversation, closed, updated_at, origin), without blank and muted ones.

    since and until bound the conversation's last change, both inclusive, and since reads ten minutes back.
    """
    closed = conversations.where("closed")
    closed = closed.where(F.col("updated_at") >= since - F.expr(OVERLAP)) if since is not None else closed
    closed = closed.where(F.col("updated_at") <= until) if until is not None else closed
    rows = utterances.join(closed.select("conversation", "updated_at", "origin"), "conversation").join(excluded.select("conversation"), "conversation", "left_anti").where(F.btrim("text") != "")
    rows = rows.join(voices.select("speaker_id", "person"), "speaker_id", "left")
    rows = rows.where(~is_muted(F.col("started_at"), mute, zone)) if mute else rows
    actor = F.when(F.col("is_user"), "me").otherwise(F.coalesce(some(F.col("person")), some(F.col("speaker"))))
    payload = [F.col("conversation").alias("conversation_id"), F.col("origin"), F.col("speaker_id"), F.lit("Nytka").alias("chat_title")]
    return event(rows, "nytka", F.col("segment_id"), F.col("started_at"), F.btrim("text", F.lit(" \t\n\r")), keyed("nytka", F.col("conversation")), "utterance", actor, payload, None, F.col("updated_at"))


def deleted_upstream(events: DataFrame, conversations: DataFrame, utterances: DataFrame, source: str = "nytka") -> DataFrame:
    """thread_key of threads whose conversation is gone and of whose utterances none is left, in any conversation: a
    conversation that was merged into another is gone as well, but its utterances live on and must not be erased."""
    own = events.where(F.col("source") == source).select("thread_key", F.substring_index("thread_key", ":", -1).alias("conversation"), "source_id")
    gone = own.join(conversations.select(F.col("conversation").cast("string")), "conversation", "left_anti")
    alive = gone.join(utterances.select(F.col("segment_id").cast("string").alias("source_id")), "source_id", "left_semi").select("thread_key")
    return gone.select("thread_key").distinct().join(alive, "thread_key", "left_anti")


@register("karakeep")
def karakeep(bookmarks: DataFrame, links: DataFrame, texts: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Bookmarks with what there is of title, description, body and note, else the address. createdAt: epoch seconds."""
    ts = instant(bookmarks, "createdAt")
    rows = between(bookmarks, ts, since, until).where(ts.isNotNull())
    rows = rows.join(links.select("id", F.col("url").alias("link_url"), F.col("title").alias("link_title"), "description"), "id", "left").join(texts.select("id", F.col("text").alias("body"), F.col("sourceUrl").alias("text_url")), "id", "left")
    title, url = F.coalesce("title", "link_title"), F.coalesce("link_url", "text_url")
    text = F.concat_ws("\n", some(title), some(F.col("description")), some(F.col("body")), some(F.col("note")))
    payload = [url.alias("url"), title.alias("title"), F.coalesce(F.col("note") != "", F.lit(False)).alias("has_note")]
    return event(rows, "karakeep", F.col("id"), ts, F.coalesce(some(text), url, F.lit("")), F.lit("karakeep:saved"), "bookmark", F.lit("me"), payload)


@register("paperless")
def paperless(documents: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Documents with the first 4,000 characters of their text (id, created, title, content, correspondent, doctype)."""
    created = instant(documents, "created")
    rows = between(documents, created, since, until)
    content = F.coalesce("content", F.lit(""))
    text = F.concat(F.coalesce(some(F.col("title")), F.lit("document")), F.lit("\n"), F.substring(content, 1, 4000))
    return event(rows, "paperless", F.col("id"), created, text, F.lit("paperless:docs"), "document", F.col("correspondent"), [F.col("title"), F.col("correspondent"), F.col("doctype"), (F.length(content) > 4000).alias("truncated")])


# Operation types that are named.
FORGE_ACTIONS = {
    1: "created repository",
    5: "pushed",
    7: "opened pull request",
    9: "pushed tag",
    10: "commented",
    11: "merged pull request",
    12: "closed issue",
    24: "published release",
}


@register("forgejo")
def forgejo(actions: DataFrame, since: Column | None = None, until: Column | None = None, author: str | None = None) -> DataFrame:
    """Actions that are not deleted (id, created_unix, op_type, content, repo, email, is_deleted); author: an e-mail.

    Text: [repo] and the commit messages of a push, else what the content says if it is no JSON object, else the
    operation's name or number.
    """
    at = F.timestamp_seconds("created_unix")
    rows = between(actions.where("not is_deleted"), at, since, until)
    rows = rows if author is None else rows.where(F.col("email") == author)
    is_object = F.try_parse_json("content").isNotNull() & F.ltrim("content").startswith("{")
    commits = F.from_json("content", "Commits array<struct<Message string>>")["Commits"]
    messages = F.array_join(F.transform(F.filter(commits, lambda c: F.coalesce(c["Message"] != "", F.lit(False))), lambda c: F.btrim(c["Message"], F.lit(" \t\n\r"))), "; ")
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in FORGE_ACTIONS.items() for x in kv])[F.col("op_type")], F.concat(F.lit("action "), F.col("op_type").cast("string")))
    said = F.when(is_object, some(messages)).otherwise(some(F.col("content")))
    text = F.concat(F.lit("["), F.coalesce("repo", F.lit("None")), F.lit("] "), F.coalesce(said, named))
    return event(rows, "forgejo", F.col("id"), at, text, keyed("forgejo", F.coalesce("repo", F.lit("None"))), "repo_activity", F.col("email"), [F.col("repo"), F.col("op_type")])


@register("miniflux")
def miniflux(entries: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Entries that were read or starred (id, published_at, title, url, feed, status, starred)."""
    at = instant(entries, "published_at")
    rows = between(entries.where("status = 'read' or starred"), at, since, until)
    return event(rows, "miniflux", F.col("id"), at, F.concat(F.coalesce("title", F.lit("None")), F.lit(" ("), F.coalesce("feed", F.lit("None")), F.lit(")")), keyed("miniflux", F.coalesce("feed", F.lit("None"))), "article_read", F.lit("me"), [F.col("url"), F.col("feed"), F.coalesce("starred", F.lit(False)).alias("starred")])


@register("lastfm")
def lastfm(tracks: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Listening sessions of three tracks and more (uts, artist, name, window); silence of thirty minutes ends one, and
    so does a fetch window. Of artists played equally often the last in the alphabet is the top one."""
    rows = between(tracks.where("uts is not null").withColumn("ts", F.timestamp_seconds("uts")), F.timestamp_seconds("uts"), since, until)
    rows = gap_sessions(rows.withColumn("artist", some(F.col("artist"))), ["window"], "ts", 1800, ["name"])
    per = rows.groupBy("window", "session", "artist").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("plays"))
    top = F.max_by("artist", F.when(F.col("artist").isNotNull(), F.struct("plays", "artist")))
    got = per.groupBy("window", "session").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("plays").alias("n"), top.alias("top"), F.slice(F.array_sort(F.collect_set("artist")), 1, 30).alias("artists")).where("n >= 3")
    text = F.concat(F.lit("listened to "), F.col("n").cast("string"), F.lit(" tracks, mostly "), F.coalesce("top", F.lit("unknown")))
    payload = [F.col("n").alias("tracks"), F.coalesce("top", F.lit("unknown")).alias("top_artist"), F.col("artists"), iso(F.col("b")).alias("ended_at"), F.hour(F.to_utc_timestamp("a", F.current_timezone())).alias("hour")]
    return event(got, "lastfm", keyed("listen", iso(F.col("a"))), F.col("a"), text, F.lit("lastfm:listening"), "listening_session", F.lit("me"), payload, None, F.col("b"))


def simple(source: str, ts: str, fields: Callable[[], dict]):
    """An adapter that only projects; fields are the arguments of event besides the source and the instant."""

    @register(source)
    def read(rows: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
        when = instant(rows, ts)
        return event(between(rows, when, since, until), source, ts=when, **fields())

    return read


def head(title: str, body: str, most: int) -> Column:
    """A title line and the first characters of a body, either may be missing."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, most))


C = F.col
calendar = simple("calendar", "start", lambda: {"source_id": C("id"), "text": F.concat_ws(" ", some(C("summary")), some(C("description"))), "thread_key": keyed("calendar", F.coalesce("calendar", F.lit("primary"))), "kind": "calendar_event", "actor": F.lit("me"), "payload": [F.coalesce("attendees", F.array().cast("array<string>")).alias("attendees"), C("location"), C("end").alias("ended_at"), C("recurring_event_id").isNotNull().alias("recurring")]})
gmail = simple("gmail", "date", lambda: {"source_id": C("id"), "text": head("subject", "body", 3000), "thread_key": keyed("gmail", F.coalesce("thread_id", "id")), "kind": "email", "actor": C("from"), "reply_to": C("in_reply_to"), "payload": [C("to"), C("labels"), C("subject")]})
github = simple("github", "ts", lambda: {"source_id": C("id"), "text": F.concat(F.lit("["), F.coalesce("repo", F.lit("None")), F.lit("] "), F.coalesce(some(C("title")), some(C("message")), C("type"), F.lit("event"))), "thread_key": keyed("github", F.coalesce("repo", F.lit("None"))), "kind": F.coalesce("type", F.lit("github_event")), "actor": C("actor"), "payload": [C("repo"), C("url"), C("type")]})
jira = simple("jira", "updated", lambda: {"source_id": C("key"), "text": F.concat(C("key"), F.lit(": "), head("summary", "description", 2000)), "thread_key": keyed("jira", C("project")), "kind": "ticket", "actor": C("assignee"), "payload": [C("status"), C("key"), C("project"), C("resolution")]})
slack = simple("slack", "datetime", lambda: {"source_id": F.concat_ws(":", "channel", "ts"), "text": F.coalesce("text", F.lit("")), "thread_key": keyed("slack", C("channel")), "kind": "message", "actor": C("user"), "reply_to": F.when(some(C("thread_ts")).isNotNull(), F.concat_ws(":", "channel", "thread_ts")), "payload": [C("channel"), C("channel_name")]})
notion = simple("notion", "created_time", lambda: {"source_id": C("id"), "text": head("title", "content", 4000), "thread_key": keyed("notion", F.coalesce("parent_id", F.lit("root"))), "kind": "note", "actor": F.lit("me"), "payload": [C("title"), C("url"), C("last_edited_time").alias("last_edited")]})
linkedin = simple("linkedin", "posted_at", lambda: {"source_id": C("id"), "text": F.coalesce("text", F.lit("")), "thread_key": F.lit("linkedin:posts"), "kind": "post", "actor": F.lit("me"), "payload": [C("impressions"), C("reactions"), C("comments"), C("url")]})


@register("dawarich")
def dawarich(points: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Stays of clustered GPS points (user, id, ts, lat, lon)."""
    from emberlog.operators.sessions import cluster_stays

    s = cluster_stays(between(points.where("lat is not null and lon is not null"), F.col("ts"), since, until), "user", "ts")
    minutes = F.floor((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 60e6)
    payload = [F.col("lat"), F.col("lon"), minutes.alias("minutes"), F.col("n").alias("points"), iso(F.col("ended_at")).alias("ended_at"), F.lit(None).cast("string").alias("place_name")]
    return event(s, "dawarich", keyed("stay", F.col("stay_id")), F.col("started_at"), stay_text(minutes), F.lit("dawarich:stays"), "stay", F.lit("me"), payload, None, F.col("ended_at"))
