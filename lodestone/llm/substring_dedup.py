"""Removal of repeated passages, level by level in windows of doubled length.

The wanted length is halved down to a few words (50: 25, 12, 6), and levels go up from there. At a level, a wanted
window is represented by the least hash among the windows of the level's length inside it, which two equal windows
share; only those representatives are compared across documents. A wanted window goes on to the doubled length if
its representative was met in another document too, and documents without such windows are done. At the wanted
length, windows that start in a document with a smaller id are removed, and every word that such a window covers.
Levels end where no candidate survives.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import buckets_for, discard, materialise, mix64, table, text_or_empty, without
from lodestone.llm.wordhash import bucket_entries, gathered, join, key_buckets, scatter, text_groups, window_hashes, word_hashes

LEAST = 6  # words of the shortest level, at least
HOT_KEYS = 1024


def levels(window: int) -> list[int]:
    """Lengths from the shortest level up to the window: each is half the next, and there are two at least."""
    out = [window]
    while len(out) < 2 or out[0] // 2 >= LEAST:
        out.insert(0, out[0] // 2)
    return out


def sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """Least (``np.minimum``) or greatest of every n consecutive values, by doubling."""
    size, level = 1, x
    while 2 * size <= n:
        level, size = least(level[:-size], level[size:]), 2 * size
    return least(level[: len(x) - n + 1], level[n - size :]) if size < n else level


class Windows:
    """All windows of a group of texts."""

    def __init__(self, texts: pa.Array, window: int):
        self.window = window
        self.words, self.counts = word_hashes(texts, lower=False)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        n = max(0, len(self.words) - window + 1)
        self.starts = np.flatnonzero(self.text[:n] == self.text[window - 1 :]) if n else np.empty(0, np.int64)

    def least(self, size: int) -> np.ndarray:
        """The representative of each window: the least hash of ``size`` consecutive words inside it."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        return sliding(window_hashes(self.words, size), self.window - size + 1, np.minimum)[self.starts]

    def candidates(self, size: int, known: pa.Array) -> np.ndarray:
        """Which windows have a representative that ``known`` (a list for each text) holds."""
        of = np.repeat(np.arange(len(known)), pc.list_value_length(known).to_numpy(zero_copy_only=False))
        values = known.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        mine = mix64(self.text[self.starts].astype(np.uint64) + np.uint64(1))
        return np.isin(self.least(size) ^ mine, values ^ mix64(of.astype(np.uint64) + np.uint64(1)))

    def whole(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits for the windows that start at the given words: their halves joined, in two ways."""
        half = self.window // 2
        hashes = window_hashes(self.words, half)
        a, b = hashes[at], hashes[at + half]
        if self.window % 2:
            c = hashes[at + self.window - half]
            return join(join(a, b), c), (join(join(c, a), b) >> np.uint64(32)).astype(np.uint32)
        return join(a, b), (join(b, a) >> np.uint64(32)).astype(np.uint32)


def _extend(rows: DataFrame, window: int, before: int | None, size: int) -> DataFrame:
    """(id, known): per document its representatives of a level that another document has too.

    ``rows`` are (id, text), and known, the representatives of the level ``before``, if there is one.
    """

    def emit(batches):
        for batch in batches:
            for group in text_groups(batch, 1):
                w = Windows(group.column(1), window)
                least, own = w.least(size), w.text[w.starts]
                if before:
                    keep = w.candidates(before, group.column(2))
                    least, own = least[keep], own[keep]
                change = np.ones(len(own), bool)
                change[1:] = (own[1:] != own[:-1]) | (least[1:] != least[:-1])
                ids = group.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(least[change].view(np.int64)), pa.array(ids[own[change]])], names=["key", "id"])

    entries = materialise(rows.mapInArrow(emit, "key long, id long"), "representatives")
    # counted by partial aggregation; keys that hold over a HOT_KEYS-th of all entries, fewer than that, are broadcast
    counts = entries.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("c"))
    shared = materialise(counts.filter("a <> b").select("key", "c"), "shared")
    often = F.col("c") * HOT_KEYS > entries.count()
    marked = entries.join(F.broadcast(shared.filter(often).select("key", F.lit(True).alias("hot"))), "key", "left")
    rest = marked.filter("hot IS NULL").join(shared.filter(~often), "key", "left_semi")
    return marked.filter("hot").unionByName(rest).groupBy("id").agg(F.collect_set("key").alias("known"))


def _survivors(rows: DataFrame, window: int) -> DataFrame:
    """(id, text, known): documents with windows that repeat at every level below the window, and their representatives."""
    current, before = rows, None
    for size in levels(window)[:-1]:
        known = materialise(_extend(current, window, before, size), "level")
        was, current = current, materialise(current.select("id", "text").join(known, "id"), "survivors")
        if before:
            discard(was)
        before = size
        if current.isEmpty():
            break
    return current


def to_documents(ids: np.ndarray, values: np.ndarray, buckets: int):
    """Values on their way to the documents they belong to: a blob for each bucket of documents."""
    if len(ids):
        order = np.argsort(ids, kind="stable")
        docs, slots = np.unique(ids[order], return_inverse=True)
        bucket = mix64(docs.view(np.uint64)) % np.uint64(buckets)
        yield scatter(values[order], slots, docs, bucket[slots])


def settle(batches):
    """One row (id, known) for each document, with all its values."""
    for _, blobs in gathered(batches):
        docs, values, slots = bucket_entries([b for (b,) in blobs])
        ids = docs[slots]
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
        ends = np.append(starts[1:], len(ids))
        found = [values[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.array(found, pa.binary())], names=["id", "known"])


def _repeats(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """(id, known): per document, where windows begin that also start in a document with a smaller id.

    ``rows`` are (id, text, known) of ``_survivors``. What a group of documents can decide by itself goes straight to
    the documents: of equal windows only those of the group's smallest id meet others, so a hot window is met once
    for each group and not once for each document.
    """
    half = levels(window)[-2]

    def emit(batches):
        for batch in batches:
            for group in text_groups(batch, 1):
                w = Windows(group.column(1), window)
                at = w.starts[w.candidates(half, group.column(2))]
                if not len(at):
                    continue
                one, two = w.whole(at)
                own = w.text[at]
                ids = group.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                places = at - w.first[own]
                drop = above_least(ids[own], one, two)
                for rows in to_documents(ids[own[drop]], places[drop].astype(np.uint64), buckets):
                    yield pa.RecordBatch.from_arrays([pc.subtract(-1, rows.column(0)), rows.column(1)], names=["bucket", "blob"])
                one, two, own, places = one[~drop], two[~drop], own[~drop], places[~drop]
                yield scatter(one, own, ids, key_buckets(one, buckets), two, places)

    def meet(batches):
        for (bucket,), blobs in gathered(batches):
            if bucket < 0:  # on its way to documents already
                for (blob,) in blobs:
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - bucket]), pa.array([blob], pa.binary())], names=["bucket", "blob"])
                continue
            docs, keys, slots, extra, places = bucket_entries([b for (b,) in blobs])
            ids = docs[slots]
            drop = above_least(ids, keys, extra)
            yield from to_documents(ids[drop], places[drop].astype(np.uint64), buckets)

    found = rows
    for step in (emit, meet):
        found = found.mapInArrow(step, "bucket long, blob binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return found.mapInArrow(settle, "id long, known binary")


def above_least(ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which entries have an equal key (in two parts) at a smaller id."""
    order = np.lexsort((ids, two, one))
    a, b = one[order], two[order]
    new = np.ones(len(ids), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(ids), bool)
    out[order] = ids[order] > ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def substring_dedup(df: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with n_words, n_removed, kept_sha256 and, if wanted, kept_text: the kept words joined by one space.

    A word goes if a window of ``window`` words that covers it also starts in a row with a smaller id; windows are
    judged on the input. Repeats within a row, or between rows of equal id, remove nothing. A null text has no
    words; a row with a null id keeps all and removes nothing elsewhere. Texts shorter than a window stay. Columns
    with these names are replaced.
    """
    if window < 4:
        raise ValueError("a window has at least four words")
    df = without(df, "n_words", "n_removed", "kept_sha256", "kept_text")
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    left = _survivors(rows, window)
    starts = materialise(_repeats(left, window, buckets_for(left, "text")), "repeats")
    discard(left)
    starts = starts.select(F.col("id").alias("__id"), F.col("known").alias("__starts"))
    joined = df.join(starts.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col("__id"), "left").drop("__id")

    def keep(batches):
        for batch in batches:
            texts, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            counts, removed, digests, kept = [], [], [], []
            for text, begins in zip(texts, starts, strict=True):
                words = text.encode("utf-8", "replace").split()
                n = len(words)
                if begins:
                    covered = np.zeros(n + 1, np.int32)
                    at = np.unique(np.frombuffer(begins, "<u8").astype(np.int64))
                    at = at[at + window <= n]
                    covered[at] += 1
                    np.add.at(covered, at + window, -1)
                    words = list(itertools.compress(words, (np.cumsum(covered)[:n] == 0).tolist()))
                out = b" ".join(words)
                counts.append(n), removed.append(n - len(words)), digests.append(hashlib.sha256(out).hexdigest())
                kept.append(out.decode("utf-8") if keep_text else None)
            columns = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *columns[: 3 + keep_text]], names=[*names, *["n_words", "n_removed", "kept_sha256", "kept_text"][: 3 + keep_text]])

    # all columns pass through beside the text, whatever their names
    passed = joined.select(text_or_empty(text_col).alias("__text"), "__starts", *df.columns)
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return passed.mapInArrow(keep, fields + ", n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else ""))


def op4_substring_dedup(spark, sf_dir):
    """Every document without passages that documents of smaller id have.

    Nulls, short and empty texts, ties, repeated rows and empty tables as in ``substring_dedup``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, 50, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
keyed AS (SELECT doc_id, i, list_slice(words, i, i + 49) AS k FROM starts),
bad AS (SELECT doc_id, i FROM keyed QUALIFY doc_id > min(doc_id) OVER (PARTITION BY k)),
word AS (SELECT doc_id, unnest(words) AS x, unnest(range(1, len(words) + 1)) AS i FROM w),
marked AS (SELECT word.doc_id, x, word.i, coalesce(max(CASE WHEN bad.i IS NOT NULL THEN 1 END)
           OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
           FROM word LEFT JOIN bad USING (doc_id, i)),
kept AS (SELECT doc_id, sum(gone) AS gone, string_agg(x, ' ' ORDER BY i) FILTER (gone = 0) AS t FROM marked GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
