"""A stream of file changes (path, content, op) kept as an index, batch by batch.

Every micro-batch writes the chunks of the paths it changed, and a mark for each of those paths; the newest batch of a
path is what counts. So a batch costs what it changes, not what there is, and a repeated batch rewrites only itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.code import code_chunks

CHUNK = "rel_path string, chunk_key string, heading string, variant string, text string, line int"


def latest(changes: DataFrame) -> DataFrame:
    """The last change of every path, by ``seq``."""
    rank = F.row_number().over(Window.partitionBy("rel_path").orderBy(F.desc("seq")))
    return changes.withColumn("rn", rank).filter("rn = 1").drop("rn")


def apply_changes(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks after changes (rel_path, content, op, seq): an upsert replaces a path's chunks, a delete drops them."""
    last = latest(changes)
    kept = chunks.join(last.select("rel_path"), "rel_path", "left_anti")
    return kept.unionByName(code_chunks(last.filter("op <> 'delete'")))


def changed_rows(changes: DataFrame) -> DataFrame:
    """What a batch writes: the chunks of its upserts, and for every path it names a row without a key."""
    last = latest(changes)
    marks = last.select("rel_path", *(F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in CHUNK.split(", ")[1:])))
    return code_chunks(last.filter("op <> 'delete'")).unionByName(marks)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table as of the last batch."""
    rows = spark.read.schema(f"{CHUNK}, batch long").parquet(path)
    newest = rows.filter("chunk_key IS NULL").groupBy("rel_path").agg(F.max("batch").alias("batch"))
    return rows.filter("chunk_key IS NOT NULL").join(newest, ["rel_path", "batch"], "left_semi").drop("batch")


def maintain(stream: DataFrame, path: str, checkpoint: str):
    """Keep a chunk table below ``path`` up to date with a stream of changes; ``current`` reads it."""

    def write(batch: DataFrame, n: int) -> None:
        changed_rows(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
