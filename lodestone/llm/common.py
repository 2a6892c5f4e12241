"""Helpers shared by the training-data operators: paths, materialisation, digests."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder; read by Spark, so any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below the one all executors share (``spark.checkpoint.dir``).

    Only where that setting is missing on a master of one machine, as in tests, a temporary folder stands in,
    which is removed with the session's process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="lodestone-"))
        base = "file://" + _LOCAL[0].name
    return f"{base.rstrip('/')}/lodestone/{what}-{uuid.uuid4().hex}"


_MADE: list[list[str]] = []


@contextlib.contextmanager
def tracked(spark: SparkSession) -> Iterator[None]:
    """Remove what is written by ``materialise`` inside once the block ends; what is read later must lie elsewhere."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` made, when nothing will read them any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, what)
    if _MADE:
        _MADE[-1].append(path)
    # what was shuffled on the way is not needed once the table is written
    clean, was = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    try:
        was = spark.conf.get(clean, None)
        spark.conf.set(clean, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, was) if was is not None else spark.conf.unset(clean)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written to the shared folder; what it wrote on its way there is removed."""
    path = shared_dir(spark, what)
    with tracked(spark):
        df = make()
        schema = df.schema
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_or_empty(name: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names an operator is about to produce."""
    wanted = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in wanted])


def buckets_for(df: DataFrame, text: str, bytes_each: int = 8 << 20) -> int:
    """How many exchange buckets a corpus needs: proportional to its characters."""
    total = df.select(F.sum(F.length(F.col(text))).alias("n")).first()["n"] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // bytes_each))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift and multiply rounds), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
