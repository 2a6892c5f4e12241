"""Token-id files of directly addressable codes.

An id is split into chunks of eight bits, one level each. A level holds its chunks as bytes, a bitmap that
says which of them continue on the next level, and a rank directory (set bits before every 512th bit). The
k-th id is read by following ranks from level to level, without decoding a block; a slice reads contiguous
bytes of each level.

A file is a header, the documents' ids and bounds, then the levels. It is written by Spark's own writer, one
file per shard, so that any file system Spark reaches will do. Shards are cut at whole documents after about
``shard_tokens`` ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import buckets_for, materialise, shared_dir, table, text_or_empty
from lodestone.llm.wordhash import text_groups

MAGIC = b"LDAC0001"
HEADER = "<8sqqqqq"  # magic, partition, ids before in the partition, documents, ids, levels
BLOCK = 512


def dac_encode(ids: np.ndarray) -> bytes:
    """The levels of an array of ids below 2**32: each (chunks, set bits), then its three arrays."""
    rest, out, levels = ids.astype(np.uint32), [], 0
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.empty(0, np.int64)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        out += [struct.pack("<qq", len(rest), int(ones.sum())), ranks.tobytes(), bitmap.tobytes(), rest.astype(np.uint8).tobytes()]
        levels += 1
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return struct.pack("<q", levels) + b"".join(out)


class DacReader:
    """Random access to the ids in a buffer made by ``dac_encode``: ``reader[i]``, ``reader.slice(a, b)`` and ``len``.

    An empty buffer has no ids; a place outside of it is an IndexError, a slice is cut to what there is.
    """

    def __init__(self, raw: bytes | memoryview, at: int = 0):
        (levels,), at = struct.unpack_from("<q", raw, at), at + 8
        self.levels = []
        for _ in range(levels):
            n, _ones = struct.unpack_from("<qq", raw, at)
            blocks, at = -(-n // BLOCK), at + 16
            ranks = np.frombuffer(raw, "<u4", blocks, at)
            bitmap = np.frombuffer(raw, np.uint8, -(-n // 8), at + 4 * blocks)
            at += 4 * blocks + len(bitmap)
            self.levels.append((ranks, bitmap, np.frombuffer(raw, np.uint8, n, at)))
            at += n

    def __len__(self) -> int:
        return len(self.levels[0][2])

    @staticmethod
    def _rank(level, i: int) -> int:
        """Set bits before position i."""
        ranks, bitmap, chunks = level
        if i >= len(chunks):
            i = len(chunks)
        if not i:
            return 0
        block = (i - 1) // BLOCK
        bits = np.unpackbits(bitmap[block * BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * BLOCK]
        return int(ranks[block]) + int(bits.sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for level in self.levels:
            value |= int(level[2][i]) << shift
            if not level[1][i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids from a up to b."""
        a, b = max(a, 0), min(b, len(self))
        if a >= b:
            return np.empty(0, np.uint32)
        out, where, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for level in self.levels:
            out[where] |= level[2][a:b].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(level[1][a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a].astype(bool)
            where, shift = where[more], shift + 8
            if not len(where):
                break
            a = self._rank(level, a)
            b = a + len(where)
        return out


def write_token_files(
    df: DataFrame, path: str, tokens_of, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 22
) -> None:
    """Write every row's ids, as ``tokens_of(texts)`` yields them (bytes of unsigned 32-bit integers, little-endian), to files below ``path``.

    Rows go by ascending id (nulls first, then by text). A null text counts as empty; its ids are what
    ``tokens_of`` gives for an empty text. Repeated rows are written each. An empty table writes no shard.
    Ids of rows must be integers.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    parts = buckets_for(rows, "text", 16 << 20)

    def shard(part: int, before: int, ids: list, blobs: list[bytes]) -> bytes:
        sizes = np.array([len(x) // 4 for x in blobs], np.int64)
        names = np.array([0 if i is None else i for i in ids], "<i8")
        known = np.array([i is not None for i in ids], np.uint8)
        flat = np.frombuffer(b"".join(blobs), "<u4")
        head = struct.pack(HEADER, MAGIC, part, before, len(ids), len(flat), 8)
        return head + names.tobytes() + known.tobytes() + np.cumsum([0, *sizes]).astype("<i8").tobytes() + dac_encode(flat)

    def run(batches):
        part, before, held, ids, blobs = TaskContext.get().partitionId(), 0, 0, [], []
        for rows in (g for b in batches for g in text_groups(b, 1, 1 << 21)):
            for i, raw in zip(rows.column(0).to_pylist(), tokens_of(rows.column(1).to_pylist()), strict=True):
                ids.append(i)
                blobs.append(raw)
                held += len(raw) // 4
                if held >= shard_tokens:
                    yield pa.RecordBatch.from_arrays([pa.array([shard(part, before, ids, blobs)], pa.binary())], names=["value"])
                    before, held, ids, blobs = before + held, 0, [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([shard(part, before, ids, blobs)], pa.binary())], names=["value"])

    shards = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text").mapInArrow(run, "value binary")
    # the writer adds a line end after each shard, which the header's sizes leave out
    shards.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (part, start, n_tokens, doc_id, ids_crc32, ids) from the files; start counts within the part."""

    def run(batches):
        for rows in batches:
            for raw in rows.column(0):
                raw = raw.as_buffer()
                magic, part, before, n, _, _ = struct.unpack_from(HEADER, raw, 0)
                if magic != MAGIC:
                    raise ValueError("not a token file")
                at = struct.calcsize(HEADER)
                names = np.frombuffer(raw, "<i8", n, at)
                known = np.frombuffer(raw, np.uint8, n, at + 8 * n).astype(bool)
                ends = np.frombuffer(raw, "<i8", n + 1, at + 9 * n)
                ids = DacReader(raw, at + 9 * n + 8 * (n + 1))
                flat = ids.slice(0, len(ids)).astype("<u4")
                crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part)), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), pa.array(names, mask=~known), pa.array(crcs, pa.int64()), lists],
                    names=["part", "start", "n_tokens", "doc_id", "ids_crc32", "ids"],
                )

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(run, "part long, start long, n_tokens long, doc_id long, ids_crc32 long, ids array<int>")


def byte_tokens(texts: list[str]):
    """Ids of the byte-level vocabulary, then 0: the tokenizer file's ids by way of the same vocabulary as ranks,
    which is several times faster; the string of the end token in a text gives that token, as in the file."""
    for text in texts:
        yield np.append(_byte_encoding().encode_to_numpy(text, allowed_special="all"), 0).astype("<u4").tobytes()


_ENCODING = []


def _byte_encoding():
    if not _ENCODING:
        import base64

        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = public_tokenizers.PATTERN
        _ENCODING.append(tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256}))
    return _ENCODING[0]


def token_file_digests(df: DataFrame) -> DataFrame:
    """Write the files of a table of documents, read them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = df.sparkSession
    path = shared_dir(spark, "token-files")
    write_token_files(df, path, byte_tokens)
    read = materialise(read_token_files(spark, path).drop("ids"), "token-index")
    totals = read.groupBy("part").agg(F.sum("n_tokens").alias("__n")).orderBy("part").collect()  # one row per partition
    starts = np.cumsum([0, *(r[1] for r in totals)]).tolist()
    base = spark.createDataFrame([(r[0], s) for r, s in zip(totals, starts, strict=False)], "part long, __base long")
    return read.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("start") + F.col("__base")).alias("start"), "n_tokens", "ids_crc32"
    )


def op9_token_files(spark, sf_dir):
    """Every document's place in the token files.

    Null and empty texts, null ids, repeated rows and empty tables as in ``write_token_files``.
    """
    return token_file_digests(table(spark, sf_dir, "documents"))
