"""Hashes of words and of windows of words, vectorised, and their exchange by hash bucket.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D. The exchange packs hashes with the documents they come
from into binary rows, one per hash bucket and group of documents, so that a shuffle moves a few large rows
instead of one small row per word.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.common import mix64

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if len(_POWERS.get("up", ())) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts in order, and the number of words of each text. Nulls have none."""
    texts = pa.array(["" if t is None else t for t in texts.to_pylist()], pa.string()) if texts.null_count else texts
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, width, len(texts) + 1, texts.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    at = ends[1:-1]
    at = at[at < len(raw)]
    begins[at] |= word[at]  # a text's first word is one even if the text before ends in a word
    first = np.flatnonzero(begins)
    lasts = np.flatnonzero(word & ~np.append(word[1:] & ~begins[1:], False)) + 1
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    up, down = _powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[:-1], out=sums[1:])
    hashes = mix64((sums[lasts] - sums[first]) * up[first] + (lasts - first).astype(np.uint64) * BASE)
    return hashes, np.searchsorted(first, ends[1:]) - np.searchsorted(first, ends[:-1])


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n consecutive values, put together from runs of doubled lengths."""
    level, size, out, done = h, 1, None, 0
    while True:
        if n & size:
            out = level if out is None else join(out[: max(0, len(level) - done)], level[done:])
            done += size
        if 2 * size > n:
            return out[: max(0, len(h) - n + 1)]
        level, size = join(level[:-size] if size < len(level) else level[:0], level[size:]), 2 * size


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a window from those of its two parts."""
    n = min(len(a), len(b))
    return mix64(a[:n] * np.uint64(0xA0761D6478BD642F) + (b[:n] ^ np.uint64(0xE7037ED1A0B428DB)))


def text_groups(rows: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts together have about ``limit`` bytes, whole texts each."""
    sizes = np.array([0 if x is None else x for x in pc.binary_length(rows.column(column)).to_pylist()], np.int64)
    a, total = 0, np.cumsum(sizes)
    while a < rows.num_rows:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, side="right")))
        yield rows.slice(a, b - a)
        a = b


def key_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, from all its bits, however many buckets there are; blobs store the lower 48."""
    return mix64(keys) % np.uint64(buckets)


def scatter(keys: np.ndarray, slots: np.ndarray, docs: np.ndarray, bucket: np.ndarray, *extra: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, blob) of entries: a key (48 bits are kept), one of ``docs`` (int64) by its number in ``slots``, and
    unsigned extras of 16 or 32 bits. Entries must come in order of slots. A blob holds each document once."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    extra = [x.astype("<u2" if x.dtype == np.uint16 else "<u4") for x in extra]
    bucket, keys, slots, extra = bucket[order], keys[order], slots[order], [x[order] for x in extra]
    low, high = keys.astype("<u4"), (keys >> np.uint64(32)).astype("<u2")
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
    fresh = np.ones(len(slots), bool)
    fresh[1:] = (slots[1:] != slots[:-1]) | (bucket[1:] != bucket[:-1])
    heads = np.flatnonzero(fresh)
    lengths = np.diff(np.append(heads, len(slots)))
    names, where = docs[slots[heads]].astype("<i8"), np.searchsorted(heads, starts)
    where = np.append(where, len(heads))
    lengths = lengths.astype("<u1" if lengths.max(initial=0) < 256 else "<u4")
    shape = struct.pack("<BB", lengths.itemsize, len(extra)) + bytes(x.itemsize for x in extra)
    blobs = []
    for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
        x, y = where[k], where[k + 1]
        head = struct.pack("<ii", y - x, b - a) + shape
        blobs.append(b"".join([head, names[x:y].tobytes(), lengths[x:y].tobytes(), low[a:b].tobytes(), high[a:b].tobytes(), *(e[a:b].tobytes() for e in extra)]))
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def bucket_entries(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of one bucket: documents, keys (lower 48 bits), each entry's document by number, and extras."""
    names, lengths, keys, extras = [], [], [], []
    for blob in blobs:
        n_docs, n, wide, more = struct.unpack_from("<iiBB", blob)
        sizes, at = blob[10 : 10 + more], 10 + more
        names.append(np.frombuffer(blob, "<i8", n_docs, at))
        at += 8 * n_docs
        lengths.append(np.frombuffer(blob, f"<u{wide}", n_docs, at).astype(np.int64))
        at += wide * n_docs
        keys.append(np.frombuffer(blob, "<u4", n, at).astype(np.uint64) | np.frombuffer(blob, "<u2", n, at + 4 * n).astype(np.uint64) << np.uint64(32))
        at += 6 * n
        own = []
        for size in sizes:
            own.append(np.frombuffer(blob, f"<u{size}", n, at).astype(np.uint32))
            at += size * n
        extras.append(own)
    lengths = np.concatenate(lengths)
    return np.concatenate(names), np.concatenate(keys), np.repeat(np.arange(len(lengths)), lengths), *(np.concatenate(x) for x in zip(*extras, strict=True))


def gathered(batches, key_columns: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of consecutive rows with equal leading columns, from batches sorted by them: (key, rows)."""
    current, held = None, []
    for rows in batches:
        for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if row[:key_columns] != current:
                if held:
                    yield current, held
                current, held = row[:key_columns], []
            held.append(row[key_columns:])
    if held:
        yield current, held

