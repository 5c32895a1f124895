"""Tables of an archive in one folder: data folders that never change, and a manifest that says which of them are the state."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir; only a local session may be without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/emberlog-{name}-{uuid.uuid4().hex}"


def keep(writer: DataFrameWriter, name: str) -> None:
    """Write a table by its name, or under its path where the name is one."""
    writer = writer.mode("overwrite").format("parquet")
    writer.save(name) if "/" in name else writer.saveAsTable(name)


def kept(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a scratch table: read again without their work, and of a known size when joins are planned."""
    path = scratch_path(rows.sparkSession, name)
    keep(rows.write, path)
    return kept(rows.sparkSession, path)


class Conflict(RuntimeError):
    """Someone else has committed since this change began."""


class Store:
    """root/data holds folders that are written once; root/state/<number>.json names those of every table, and the highest
    number is the state. All that one change does becomes the state by one rename, or nothing does.

    A table may be kept by year: then only the years that a change touches are written, the others are named again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def files(self):
        return self.path("state").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self.files().exists(self.path("state")):
            return []
        names = (f.getPath().getName() for f in self.files().listStatus(self.path("state")))
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def manifest(self, version: int | None = None) -> dict:
        """version, tables (name: schema, year (whether it is kept by year), folders by year) and notes."""
        version = version if version is not None else max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "tables": {}, "notes": {}}
        stream = self.files().open(self.path(f"state/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def has(self, name: str) -> bool:
        return name in self.manifest()["tables"]

    def read(self, name: str, schema: str | None = None, years: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or an empty one of the schema if it is not there yet; years: only these folders of a table kept by year."""
        known = self.manifest(version)["tables"].get(name)
        if known is None:
            if schema is None:
                raise FileNotFoundError(name)
            return self.spark.createDataFrame([], schema)
        kind = StructType.fromJson(known["schema"])
        wanted = None if years is None else {str(y) for y in years}
        folders = [f"{self.root}/data/{f}" for year, f in sorted(known["folders"].items()) if wanted is None or not known["year"] or year in wanted]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def write(self, name: str, rows: DataFrame) -> None:
        """A change of one table."""
        change = self.change()
        change.write(name, rows)
        change.commit()

    def change(self) -> Change:
        return Change(self)

    def vacuum(self, keep_versions: int = 5) -> int:
        """Delete manifests but the last ones, and the data folders that none of those names; how many folders went."""
        keep = self.versions()[-keep_versions:]
        used = {f for v in keep for t in self.manifest(v)["tables"].values() for f in t["folders"].values()}
        files, gone = self.files(), 0
        for v in self.versions()[:-keep_versions]:
            files.delete(self.path(f"state/{v:012d}.json"), False)
        if files.exists(self.path("data")):
            for table in files.listStatus(self.path("data")):
                for folder in files.listStatus(table.getPath()):
                    if f"{table.getPath().getName()}/{folder.getPath().getName()}" not in used:
                        files.delete(folder.getPath(), True)
                        gone += 1
        return gone


class Change:
    """What becomes the state at commit(), all of it or nothing. Until then nobody sees what is written."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.manifest()
        self.tables, self.notes = dict(self.base["tables"]), dict(self.base["notes"])

    def folder(self, name: str, rows: DataFrame) -> str:
        own = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.root}/data/{own}")
        return own

    def write(self, name: str, rows: DataFrame) -> None:
        self.tables[name] = {"schema": rows.schema.jsonValue(), "year": False, "folders": {"": self.folder(name, rows)}}

    def write_years(self, name: str, rows: DataFrame, ts: str, years: list[int]) -> None:
        """rows are all rows of these years (of the time ts; a null time is year 0); other years stay as they are."""
        old = self.tables.get(name, {"folders": {}})["folders"]
        year = F.coalesce(F.year(ts), F.lit(0))
        new = {str(y): self.folder(name, rows.where(year == y)) for y in years}
        self.tables[name] = {"schema": rows.schema.jsonValue(), "year": True, "folders": old | new}

    def commit(self) -> int:
        """The number of the new state. Raises Conflict if the state is not the one that this change began with."""
        store, number = self.store, self.base["version"] + 1
        body = json.dumps({"version": number, "tables": self.tables, "notes": self.notes}).encode()
        files, to = store.files(), store.path(f"state/{number:012d}.json")
        draft = store.path(f"state/draft-{uuid.uuid4().hex}")
        stream = files.create(draft)
        try:
            stream.write(body)
        finally:
            stream.close()
        if files.exists(to) or not files.rename(draft, to):
            files.delete(draft, False)
            raise Conflict(f"state {number} is there already")
        return number
