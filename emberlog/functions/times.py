"""Time functions: reading instants in any form, bins, mute windows, recency."""

from __future__ import annotations

import json
from datetime import time
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A whole date, and a time of day and zone where there are some; anything shorter is no instant.
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?(?:[+-]\d{2}(?::?\d{2})?)?)?$"
COMPACT = [(r"^\d{8}$", "yyyyMMdd"), (r"^\d{8}T\d{4}$", "yyyyMMdd'T'HHmm"), (r"^\d{8}T\d{6}$", "yyyyMMdd'T'HHmmss")]


def coerce_ts(value: Column) -> Column:
    """An instant from text: ISO 8601 with a whole date, with or without zone (none: UTC); anything else is null, numbers
    in a text too."""
    text = F.replace(F.btrim(value, F.lit(" \t\n\r")), F.lit("Z"), F.lit("+00:00"))
    whole = F.regexp_replace(F.regexp_replace(text, ",", "."), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})([+-].*)?$", "$1:00$2")
    zoned = F.regexp_replace(whole, r"(:\d{2}[\d.:]*[+-]\d{2})(?::?(\d{2}))?$", "$1:$2")
    zoned = F.regexp_replace(zoned, r"([+-]\d{2}):$", "$1:00")
    out = F.when(text.rlike(ISO), F.try_to_timestamp(zoned))
    for pattern, form in COMPACT:
        out = F.when(text.rlike(pattern), F.try_to_timestamp(text, F.lit(form))).otherwise(out)
    return out


def epoch_ts(value: Column) -> Column:
    """An instant from a number: epoch seconds, or milliseconds beyond 1e11."""
    number = value.cast("double")
    return F.timestamp_micros((F.when(number > 1e11, number / 1000).otherwise(number) * 1e6).cast("long"))


def instant(rows: DataFrame, name: str) -> Column:
    """The instant in a column, read by the column's type: text, number, date or timestamp."""
    kind = dict(rows.dtypes)[name]
    if kind == "string":
        return coerce_ts(F.col(name))
    if kind.startswith(("timestamp", "date")):
        return F.col(name).cast("timestamp")
    return epoch_ts(F.col(name))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def bin_start(ts: Column, width_seconds: int) -> Column:
    """The start of the fixed-width bin, aligned to the epoch."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts.cast("timestamp")) / (width_seconds * 1_000_000)) * width_seconds)


def recency_factor(age_days: Column, grace: float = 7.0, half: float = 30.0) -> Column:
    """Gaussian: 1 up to grace days, 0.5 at half days beyond it."""
    eff = F.greatest(F.lit(0.0), age_days - grace)
    return F.exp(F.lit(-0.6931471805599453) * eff * eff / (half * half))


def parse_mute_windows(raw: str | None) -> list[tuple[frozenset[int], int, int]]:
    """(days 1-7, start second, end second) of each window of a JSON list; none for a null, blank or empty setting.

    ValueError, without the value, if it is malformed: windows that cannot be read must stop a source.
    """
    if not raw or not raw.strip():
        return []
    seconds = lambda t: t.hour * 3600 + t.minute * 60 + t.second
    try:
        out = [(frozenset(map(int, w["days"])), *(seconds(time.fromisoformat(w[k])) for k in ("start", "end"))) for w in json.loads(raw)]
        if any(not days or not days <= frozenset(range(1, 8)) for days, _, _ in out):
            raise ValueError
        return out
    except (KeyError, TypeError, ValueError):
        raise ValueError("malformed mute windows") from None


def is_muted(ts: Column, windows: list[tuple[frozenset[int], int, int]], zone: str = "UTC") -> Column:
    """Weekly half-open windows in local time; an end at or before the start lies on the next day, days name the start.
    An unknown zone is UTC."""
    try:
        ZoneInfo(zone)
    except (KeyError, ValueError, OSError):
        zone = "UTC"
    local = F.from_utc_timestamp(ts, zone)
    second, day = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local), F.weekday(local) + 1
    yesterday = F.pmod(day - 2, F.lit(7)) + 1
    out = F.lit(False)
    for days, start, end in windows:
        if end > start:
            out = out | (day.isin(*days) & (second >= start) & (second < end))
        else:
            out = out | (day.isin(*days) & (second >= start)) | (yesterday.isin(*days) & (second < end))
    return out
