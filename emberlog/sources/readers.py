"""Readers: JSON lines, SQLite as a partitioned data source, API windows, and a registry with isolated failures."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from emberlog.sources.policy import admitted

#: Fixed value: API sources are read from here on.
ORIGIN = datetime(2018, 12, 1, tzinfo=timezone.utc)


def read_jsonl(spark: SparkSession, path: str, schema: str, glob: str | None = None) -> DataFrame:
    """Objects of every line; blank, broken and other lines are skipped; of tab-separated lines the last field counts."""
    reader = spark.read.option("recursiveFileLookup", "true")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    body = F.trim(F.regexp_extract("value", r"([^\t]*)$", 1))
    parsed = lines.select(body.alias("line")).where(F.col("line").startswith("{")).select(F.from_json("line", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.where("r is not null and r._broken is null").select("r.*").drop("_broken")


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.columns = options, [f.name for f in schema.fields]

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        """Ranges of rowid of a table; a query is one partition."""
        if "query" in self.options:
            return [RowRange(0, 0)]
        with self.connect() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // int(self.options.get("numpartitions", "4"))))
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        with self.connect() as db:
            names = ", ".join(f'"{c}"' for c in self.columns)
            if "query" in self.options:
                cursor = db.execute(f"SELECT {names} FROM ({self.options['query']})")
            else:
                cursor = db.execute(f'SELECT {names} FROM "{self.options["table"]}" WHERE rowid >= ? AND rowid < ?', (part.low, part.high))
            while rows := cursor.fetchmany(5000):
                yield from rows


class SqliteSource(DataSource):
    """spark.read.format("sqlite_ro").schema(...).option("path", file).option("table", name) or option("query", sql)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> str:
        raise ValueError("give a schema: sqlite columns hold any type")

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, schema: str, table: str | None = None, query: str | None = None) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    what = ("query", query) if query else ("table", table)
    return spark.read.format("sqlite_ro").schema(schema).option("path", path).option(*what).load()


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Postgres or MariaDB, where their driver jar is on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize="5000", **options).load()


def windows(since: datetime | None, until: datetime, width: timedelta) -> list[tuple[datetime, datetime]]:
    """[start, end) windows from since (default ORIGIN; without zone: UTC) to until."""
    utc = lambda t: t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    at, until, out = utc(since or ORIGIN), utc(until), []
    while at < until:
        out.append((at, min(at + width, until)))
        at += width
    return out


def read_api(spark: SparkSession, fetch: Callable[[datetime, datetime], Iterator[tuple]], schema: str, since: datetime | None, until: datetime, width: timedelta) -> DataFrame:
    """Rows of fetch(start, end), one window a task."""
    spans = windows(since, until, width)
    frame = spark.createDataFrame([(a.timestamp(), b.timestamp()) for a, b in spans], "a double, b double").repartition(max(1, len(spans)))

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            for a, b in pdf.itertuples(index=False):
                rows = list(fetch(datetime.fromtimestamp(a, timezone.utc), datetime.fromtimestamp(b, timezone.utc)))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return frame.mapInPandas(run, schema)


def parse_dsn(dsn: str) -> dict[str, object]:
    """host, port, user, password, database of a database url, percent-decoded."""
    u = urlsplit(dsn)
    return {"host": u.hostname, "port": u.port, "user": unquote(u.username or ""), "password": unquote(u.password or ""), "database": unquote(u.path.lstrip("/"))}


REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        admitted([name])
        if name in REGISTRY:
            raise ValueError(f"source {name} is registered already")
        REGISTRY[name] = f
        return f

    return add


def ingest_all(names: list[str], sink: Callable[[str], int]) -> dict[str, dict]:
    """sink(name) for each source; one that fails does not stop the others."""
    out: dict[str, dict] = {}
    for name in names:
        try:
            out[name] = {"ok": True, "events": sink(name)}
        except Exception as e:  # one source's failure is its result
            out[name] = {"ok": False, "error": f"{type(e).__name__}: {e}"}
    return out
