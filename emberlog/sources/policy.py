"""What each source is: how dense, how important, and where its facts may go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Source, density, tier (1 core, 2 behaviour, 3 artifact, 4 ambient), bank (None: never promoted).
POLICIES = [
    ("telegram", "narrative", 1, "personal"),
    ("wakapi", "telemetry", 1, "projects"),
    ("dawarich", "telemetry", 1, "personal"),
    ("calendar", "discrete", 1, "personal"),
    ("firefly", "discrete", 2, "finance"),
    ("lastfm", "telemetry", 2, "personal"),
    ("forgejo", "narrative", 2, "projects"),
    ("jira", "discrete", 2, "employer"),
    ("immich", "telemetry", 3, "personal"),
    ("paperless", "discrete", 3, "personal"),
    ("gmail", "narrative", 3, "personal"),
    ("notion", "narrative", 3, "learning"),
    ("karakeep", "discrete", 3, "learning"),
    ("github", "narrative", 3, "projects"),
    ("linkedin", "discrete", 3, "social"),
    ("slack", "narrative", 3, "employer"),
    ("miniflux", "ambient", 4, None),
    ("nytka", "narrative", 4, None),
    ("owntracks", "telemetry", 4, None),
]
#: Two readers of one thing: use one of each pair.
CONFLICTS = [("dawarich", "owntracks")]


# Services that describe the machine and not the life; none may become a source by mistake.
NOT_SOURCES = [
    "activepieces", "adguard", "alerting", "apprise", "autoheal", "beszel", "changedetection", "cloudflared", "diun", "dozzle", "forgejo-runner", "gatus", "ghostfolio", "glance", "goflow2",
    "headscale", "homepage", "host", "khoj", "komodo", "langfuse", "librechat", "litellm", "metamcp", "mikrotik", "mktxp", "monitoring", "n8n", "netalertx", "nextcloud", "ntfy", "pangolin", "pocket-id",
    "qdrant", "searxng", "sonarqube", "tinyauth", "uptime-kuma", "vaultwarden", "watchtower", "website", "whisperx", "zerobyte",
]


class NotASource(ValueError):
    pass


def admitted(names: list[str], more_refused: list[str] | None = None) -> list[str]:
    """names, if all of them are declared sources; raises for those that are refused (NOT_SOURCES, and of one's own) and for
    those that have no policy."""
    refused = {*NOT_SOURCES, *(more_refused or [])}
    known = {p[0] for p in POLICIES}
    for name in names:
        if name in refused:
            raise NotASource(f"{name} is infrastructure, not a source")
        if name not in known:
            raise NotASource(f"{name} has no policy")
    return names


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "source string, density string, tier int, bank string")


def enabled(spark: SparkSession, max_tier: int = 1) -> DataFrame:
    return policies(spark).where(f"tier <= {int(max_tier)}")


def conflicts(active: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for a, b in CONFLICTS if a in active and b in active]


#: The settings that a source needs; it is left out where one is missing, and sources without an entry need a reader.
SETTINGS = {
    "telegram": ["dsn"], "wakapi": ["dsn", "user"], "dawarich": ["dsn", "user"], "immich": ["dsn"], "paperless": ["dsn"], "firefly": ["dsn"], "karakeep": ["dsn"], "miniflux": ["dsn"], "forgejo": ["dsn"], "nytka": ["dsn"],
    "owntracks": ["root"], "lastfm": ["key", "user"], "github": ["token"],
}


def configured(source: str, settings: dict[str, str | None]) -> dict[str, str] | None:
    """The source's settings without blanks, or None if it is not set up: that is no failure, but left out."""
    own = {k: v.strip() for k, v in settings.items() if v and v.strip()}
    return own if source in SETTINGS and all(k in own for k in SETTINGS[source]) else None
