"""Helpers shared by the training-data operators: shared folders, ragged numpy gathers, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, a session on one machine gets a folder of its own, and a
    cluster an error: its executors do not see each other's disks."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return f"{base.rstrip('/')}/tidemark/{app}/{name}-{uuid.uuid4().hex}"


#: Where set, materialize() notes here what it writes.
_notes: list[str] | None = None


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of all tables that are written in the block."""
    global _notes
    before, _notes = _notes, []
    try:
        yield _notes
    finally:
        _notes = before


def remove(spark: SparkSession, paths: list[str], docs: DataFrame | None = None) -> list[str]:
    """Delete tables; gives back those that `docs` still reads, which stay."""
    used = set()
    if docs is not None:
        leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
        for k in range(leaves.size()):
            leaf = leaves.apply(k)
            if leaf.getClass().getSimpleName() == "LogicalRelation":
                roots = leaf.relation().location().rootPaths()
                used |= {roots.apply(i).toUri().getPath() for i in range(roots.size())}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    kept = []
    for name in paths:
        path = hadoop(name)
        if path.toUri().getPath() in used:
            kept.append(name)
        else:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return kept


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if _notes is not None:
        _notes.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python a thousand at a time, unless the session says otherwise: with whole texts the default of ten
    thousand makes batches of tens of megabytes in the JVM and in each worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix_base(counts: DataFrame, key: str, value: str, by: list[str] | None = None, width: int = 1024) -> DataFrame:
    """(by, key, base): the sum of `value` over all smaller keys. Two levels, so that no task sees all keys: blocks of
    `width` keys are scanned on their own, and only the blocks' sums are scanned together. `key` is a long, at least 0."""
    by = by or []
    c = counts.select(*by, key, value, F.expr(f"{key} div {width}").alias("_block"))
    w = Window.partitionBy(*by, "_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inside = c.select(*by, "_block", key, F.coalesce(F.sum(value).over(w), F.lit(0)).alias("_in"))
    if by:
        top = Window.partitionBy(*by)
    else:
        top = Window.partitionBy(F.lit(0))
    top = top.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = c.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    blocks = blocks.select(*by, "_block", F.coalesce(F.sum("_sum").over(top), F.lit(0)).alias("_base"))
    on = [inside[x].eqNullSafe(blocks[x]) for x in [*by, "_block"]]
    joined = inside.join(blocks, on)
    return joined.select(*[inside[x] for x in by], inside[key], (F.col("_in") + F.col("_base")).alias("base"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (64 bit, from 0) of a string or binary array; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.large_binary()
    column = column.cast(pa.large_string()).cast(big) if pa.types.is_string(column.type) else column.cast(big)
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i]+1, ... (lens[i] of them), one span after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
