"""Best-fit decreasing packing of token pieces into sequences of bounded length.

Best fit decreasing only looks at lengths, and there are at most ``capacity`` of them. The plan is therefore
made from the histogram of lengths, which is bounded whatever the corpus size: a segment tree over remaining
capacities finds the tightest open bin in logarithmic time, and equal pieces that land in equal bins are
placed as one run, with the very result of placing them one by one. Pieces then look up their own place by
their rank among pieces of the same length, which is computed in parallel (ranks within hash slots of a
length plus the sizes of the slots before), so a hot length is spread over all slots.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import flat_encoder
from lodestone.llm.common import materialise, table, without
from lodestone.llm.wordhash import text_groups


class CapacityTree:
    """How many open bins have each remaining capacity; finds the least capacity that still fits."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = self.width + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def push(self, capacity: int, first: int, n: int) -> None:
        if n and capacity:
            self.ranges[capacity].append((first, n))
            self._add(capacity, n)

    def pop(self, capacity: int) -> tuple[int, int]:
        first, n = self.ranges[capacity].pop()
        self._add(capacity, -n)
        return first, n

    def tightest(self, length: int) -> int | None:
        """The least capacity of at least ``length`` with an open bin."""
        node = self.width + length
        if self.count[node]:
            return length
        while node > 1:  # up until a right sibling has bins, then down its leftmost path
            if not node & 1 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.width:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.width


def plan_runs(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Runs ``(length, first rank, first bin, pieces per bin, offset in bin)``, sorted; int64, one row each.

    Each open range of bins moves at most log2(capacity) times and each length opens, splits or tops up a
    constant number of ranges, so there are O(capacity log capacity) runs.
    """
    tree, bins, runs = CapacityTree(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while rank < n:
            room = tree.tightest(length)
            if room is None:
                room, first, free = capacity, bins, n
                fresh = True
            else:
                (first, free), fresh = tree.pop(room), False
            each = room // length
            full = min((n - rank) // each, free)
            if full:
                took = full
                runs.append((length, rank, first, each, capacity - room))
                rank += full * each
                tree.push(room - each * length, first, full)
            else:
                took = 1
                runs.append((length, rank, first, n - rank, capacity - room))
                tree.push(room - (n - rank) * length, first, 1)
                rank = n
            if fresh:
                bins += took
            else:
                tree.push(room, first + took, free - took)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


SLOT_ROWS = 200_000  # pieces of one length are numbered in slots of about so many rows at most


def best_fit_pack(pieces: DataFrame, keys: list[str], length_col: str = "length", capacity: int = 4096) -> DataFrame:
    """``pieces`` with sequence_id and offset: each piece's sequence and its place there, gapless from 0.

    ``keys`` order pieces of equal length. Lengths must lie between 1 and ``capacity`` (an error otherwise,
    nulls included). Rows that agree in all keys are placed one by one in an unspecified order; nulls in keys
    are allowed. No rows give no rows. Columns that bear an output's name are replaced. ``pieces`` is read
    twice, so pass a materialised table where making it is expensive.
    """
    pieces = without(pieces, "sequence_id", "offset")
    slots = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces.count() // SLOT_ROWS)
    salted = pieces.withColumn("__slot", F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int"))
    sizes = salted.groupBy(length_col, "__slot").agg(F.count(F.lit(1)).alias("__n"))
    histogram = {r[0]: r[1] for r in sizes.groupBy(length_col).agg(F.sum("__n")).collect()}  # at most capacity rows
    if any(k is None or not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    runs = pieces.sparkSession.sparkContext.broadcast(plan_runs(histogram, capacity))
    before = sizes.withColumn(
        "__base", F.sum("__n").over(Window.partitionBy(length_col).orderBy("__slot")) - F.col("__n")
    ).select(F.col(length_col).alias("__length"), F.col("__slot").alias("__of"), "__base")
    ranked = salted.withColumn(
        "__rank", F.row_number().over(Window.partitionBy(length_col, "__slot").orderBy(*keys)).cast("long") - 1
    )
    ranked = ranked.join(
        before, (ranked[length_col] == before["__length"]) & (ranked["__slot"] == before["__of"])
    ).withColumn("__rank", F.col("__rank") + F.col("__base"))

    def place(batches):
        table = runs.value
        at_of = table[:, 0] << 40 | table[:, 1]
        for rows in batches:
            length, rank = rows.column(0).to_numpy().astype(np.int64), rows.column(1).to_numpy()
            run = table[np.searchsorted(at_of, length << 40 | rank, side="right") - 1]
            within = rank - run[:, 1]
            out = [pa.array(run[:, 2] + within // run[:, 3]), pa.array(run[:, 4] + within % run[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*rows.columns[2:], *out], names=[*rows.schema.names[2:], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(F.col(length_col).alias("__l"), "__rank", *pieces.columns).mapInArrow(
        place, f"{fields}, sequence_id long, offset long"
    )


def token_pieces(
    df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]): every text's ids and ``end_id``, cut by ``capacity``.

    A null or empty text is the end id alone. Repeated rows and null ids give rows of their own.
    """

    def run(batches):
        for rows in itertools.chain.from_iterable(text_groups(b, 1, 1 << 21) for b in batches):
            texts = ["" if t is None else t for t in rows.column(1).to_pylist()]
            of, piece, start, length, crc, blobs = [], [], [], [], [], []
            for i, ids in enumerate(flat_encoder(path).batch(texts)):
                ids = np.append(ids, end_id).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    raw = ids[a : a + capacity].tobytes()
                    of.append(i), piece.append(k), start.append(a), length.append(len(raw) // 4)
                    crc.append(zlib.crc32(raw))
                    if with_ids:
                        blobs.append(raw)
            columns = [rows.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat = np.frombuffer(b"".join(blobs), "<u4").astype(np.int32)
                ends = np.cumsum([0, *length]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long{ids}"
    )


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, pieces); a group holds at most one capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", id_col, "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("__p")).select(
        "sequence_id",
        F.flatten(F.transform("__p", lambda p: p["ids"])).alias("ids"),
        F.transform("__p", lambda p: F.struct(p[id_col].alias(id_col), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("pieces"),
    )


def pack_documents(df: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """Pieces of documents with their places; ids are left out, their checksums stay."""
    made = materialise(token_pieces(df, path, capacity, with_ids=False), "pieces")
    return best_fit_pack(made, ["doc_id", "piece"], "length", capacity)


def op8_packing(spark, sf_dir):
    """All documents packed into sequences of at most 4096 tokens.

    Null and empty texts, null ids, repeated rows and empty tables as in ``token_pieces`` and ``best_fit_pack``.
    """
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
