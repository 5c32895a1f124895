"""What the operators share: tables, scratch tables on shared storage, Arrow helpers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 form of "white space" in the word contracts: space and the ASCII controls 9 to 13.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir. Where none is set, a local session, whose executors are
    this machine, has one of its own; a cluster must name one, as its executors would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints/emberlog"


#: Whether Spark deletes a query's shuffle files when it ends, and not only when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write df as a Parquet table on shared storage and read it back: cuts lineage, survives lost executors. The shuffle
    files of the write go with it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/emberlog-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/emberlog-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty) under names that cannot clash with other columns."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, slice_bytes: int = 2 << 20) -> DataFrame:
    """mapInArrow by slices of about slice_bytes of text (one text at least), so memory stays bounded for any batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, slice_bytes):
                out = fn(part)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch with a column named text into runs of rows of about slice_bytes."""
    if batch.num_rows == 0:
        return
    sizes = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + slice_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def total_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one scalar, for choosing how many parts to make."""
    return df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def hex_of(low: Column, high: Column) -> Column:
    """128 bits held in two longs as 32 hex digits."""
    return F.concat(F.lpad(F.lower(F.hex(high)), 16, "0"), F.lpad(F.lower(F.hex(low)), 16, "0"))


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabularies are; they are a parameter of every operator that needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)


