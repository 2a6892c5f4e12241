"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Every pre-token holds one leaf per adjacent pair: ``rank << shift | position``, or a sentinel where the pair
has no merge. The root is the minimum, so it yields the leftmost pair of lowest rank; a merge rewrites three
leaves and the paths above them, logarithmic in the pre-token's length, until the root is the sentinel. The
trees of many pre-tokens of similar length are the rows of one numpy array and step together.

Texts are split exactly as the tokenizer file says, distinct pre-tokens are encoded once per batch, and a
bounded cache carries them from batch to batch.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.llm.wordhash import text_groups

NONE = np.int64(np.iinfo(np.int64).max)


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies, by the published rule:
    printable Latin-1 stands for itself, the others are numbered from U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def latin_pattern(pattern: str) -> re.Pattern:
    """The same pattern for texts of Latin-1 characters only, its properties spelt out, for the faster ``re``."""
    member = {
        k: "".join(re.escape(chr(c)) for c in range(256) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s")
    }
    out, inside, i = [], False, 0
    while i < len(pattern):
        for k, chars in member.items():
            if pattern.startswith(k, i):
                out.append(chars if inside else f"[{chars}]")
                i += len(k)
                break
        else:
            if pattern.startswith(r"\S", i):
                out.append(f"[^{member[r'\s']}]")
                i += 2
                continue
            inside = (inside or pattern[i] == "[") and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return re.compile("".join(out))


BEYOND_LATIN = re.compile("[^\x00-\xff]")


class Vocabulary:
    """A tokenizer file of kind BPE over bytes, with or without an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens = [""] * (1 + max([*model["vocab"].values(), *(a["id"] for a in spec["added_tokens"])]))
        for token, i in model["vocab"].items():
            self.tokens[i] = token
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        vocab = model["vocab"]
        alphabet = byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in alphabet], np.int64)
        self.last_id = np.array([vocab[c + self.suffix] for c in alphabet], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[order]
        self.pair_rank = order.astype(np.int64)
        self.pair_into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        whole = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
        steps = whole["normalizers"] if whole["type"] == "Sequence" else [whole]
        kinds = [s["type"] for s in steps]
        for s in steps:  # runs of white space made one space change nothing where white space is dropped
            known = s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " "
            if not known:
                raise ValueError(f"a normalizer that is not known: {s['type']}")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        splits = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        given = [s["pattern"]["Regex"] for s in splits if s["type"] == "Split"]
        if {s["type"] for s in splits} - {"Split", "ByteLevel"} or "Replace" in kinds and not given:
            raise ValueError("a pre-tokenizer that is not known")
        # without a Split step a ByteLevel step splits by the pattern published with that kind of vocabulary
        self.split = regex.compile(
            given[0] if given else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        self.latin = latin_pattern(self.split.pattern)
        self.byte_of = {c: b for b, c in enumerate(alphabet)} if (spec["decoder"] or {}).get("type") == "ByteLevel" else None
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # lowering is per character, so a capital sigma never becomes a final one
            text = text.lower() if text.isascii() else text.replace("Σ", "σ").lower()
        return text

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text in order; those that are special tokens stand for themselves."""
        if self.cut is None or "<|" not in text:
            return self._split(self.normal(text))
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self._split(self.normal(part))
        return out

    def _split(self, text: str) -> list[str]:
        return (self.split if BEYOND_LATIN.search(text) else self.latin).findall(text)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE."""
        keys = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], NONE)

    def encode_flat(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end (special tokens as they are) and each piece's number of ids; trees of
        similar size step together."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        sizes, found = np.zeros(len(pieces), np.int64), []
        special = [i for i, p in enumerate(pieces) if p in self.special] if self.special else []
        if special:
            found.append((np.array(special), np.array([self.special[pieces[i]] for i in special]), np.ones(len(special), np.int64)))
        lengths = np.array([len(b) for b in raw], np.int64)
        lengths[special] = 0
        levels = np.maximum(1, np.ceil(np.log2(np.maximum(lengths, 1)))).astype(np.int64)
        for level in np.unique(levels[lengths > 0]).tolist():
            members = np.flatnonzero((levels == level) & (lengths > 0))
            step = max(1, (1 << 16) >> level)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                found.append((part, *self._forest([raw[i] for i in part], level)))
        for part, _, counts in found:
            sizes[part] = counts
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int64)
        for part, ids, counts in found:
            out[np.repeat(starts[part] - np.cumsum(counts) + counts, counts) + np.arange(len(ids))] = ids
        return out, sizes

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of every piece."""
        ids, sizes = self.encode_flat(pieces)
        ends = np.cumsum(sizes)
        return [ids[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]

    def _forest(self, words: list[bytes], levels: int) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), 1 << levels
        sizes = np.array([len(w) for w in words])
        grid = np.zeros((n, width), np.int64)
        inside = np.arange(width) < sizes[:, None]
        flat = np.frombuffer(b"".join(words), np.uint8)
        grid[inside] = self.byte_id[flat]
        grid[np.arange(n), sizes - 1] = self.last_id[flat[np.cumsum(sizes) - 1]]
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        alive = inside.copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        ranks = self.ranks(grid[:, :-1], grid[:, 1:])
        fits = inside[:, 1:] & (ranks != NONE)
        leaves = np.full((n, width), NONE, np.int64)
        leaves[:, :-1][fits] = ranks[fits] << levels | np.broadcast_to(np.arange(width - 1), fits.shape)[fits]
        tree[:, width:] = leaves
        for level in range(levels - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            root = tree[rows, 1]
            p = root & (width - 1)
            q = after[rows, p]
            grid[rows, p] = self.pair_into[root >> levels]
            alive[rows, q] = False
            z = after[rows, q]
            after[rows, p] = z
            has_next = z < sizes[rows]
            before[rows[has_next], z[has_next]] = p[has_next]
            o = before[rows, p]
            has_prev = o >= 0
            right = np.where(has_next, z, p)
            rank = np.where(has_next, self.ranks(grid[rows, p], grid[rows, right]), NONE)
            tree[rows, width + p] = np.where(rank != NONE, (rank << levels) | p, NONE)
            tree[rows, width + q] = NONE
            left = np.where(has_prev, o, p)
            rank = np.where(has_prev, self.ranks(grid[rows, left], grid[rows, p]), NONE)
            new = np.where(rank != NONE, (rank << levels) | left, NONE)
            tree[rows[has_prev], width + o[has_prev]] = new[has_prev]
            for leaf in (q, p, left):
                at = width + leaf
                for _ in range(levels):
                    at = at >> 1
                    tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            rows = rows[tree[rows, 1] != NONE]
        return grid[alive], alive.sum(1)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes put together where the file has a byte-level decoder (invalid UTF-8 gives
        U+FFFD), else the tokens joined by one space."""
        tokens = [self.tokens[i] for i in ids]
        if self.byte_of is None:
            return " ".join(tokens)
        raw = bytearray()
        for t in tokens:
            known = all(c in self.byte_of for c in t)
            raw += bytes(self.byte_of[c] for c in t) if known else t.encode()
        return raw.decode("utf-8", "replace")


class Encoder:
    """A vocabulary with a bounded cache from pre-token to ``render(ids)``."""

    def __init__(self, path: str, render, limit: int = 300_000):
        self.vocabulary, self.render, self.limit, self.cache = Vocabulary(path), render, limit, {}

    def batch(self, texts: list[str], group: int = 1 << 21) -> Iterator[list]:
        """For every text the rendered pre-tokens in order; texts are taken in groups of bounded size."""
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= group):
                size += len(texts[b])
                b += 1
            split = [self.vocabulary.pieces(t) for t in texts[a:b]]
            if len(self.cache) > self.limit:
                self.cache.clear()
            cache = self.cache
            new = [p for p in set().union(*split) if p not in cache]
            for p, ids in zip(new, self.vocabulary.encode_pieces(new), strict=True):
                cache[p] = self.render(ids)
            get = cache.__getitem__
            for pieces in split:
                yield list(map(get, pieces))
            a = b


class FlatEncoder:
    """Ids of many texts at once as one flat array: tokens are dictionary-encoded, and the ids of distinct
    pre-tokens are kept in a pool of bounded size."""

    def __init__(self, path: str, limit: int = 300_000):
        self.vocabulary, self.limit = Vocabulary(path), limit
        self._clear()

    def _clear(self) -> None:
        self.entry: dict[str, int] = {}
        self.starts, self.sizes, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def batch(self, texts: list[str], group: int = 1 << 21) -> Iterator[np.ndarray]:
        """Every text's ids, in order; texts are taken in groups of bounded size."""
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= group):
                size += len(texts[b])
                b += 1
            split = [self.vocabulary.pieces(t) for t in texts[a:b]]
            ends = np.cumsum([len(x) for x in split])
            coded = pa.array(list(itertools.chain.from_iterable(split)), pa.large_string()).dictionary_encode()
            ids, ends_of = self._look_up(coded.dictionary.to_pylist(), coded.indices.to_numpy())
            ends = np.concatenate([[0], ends_of])[ends]
            for x, y in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                yield ids[x:y]
            a = b

    def _look_up(self, words: list[str], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.entry) > self.limit:
            self._clear()
        new = [w for w in words if w not in self.entry]
        if new:
            made, sizes = self.vocabulary.encode_flat(new)
            self.entry.update(zip(new, range(len(self.entry), len(self.entry) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.pool = np.concatenate([self.pool, made.astype(np.uint32)])
        rows = np.array([self.entry[w] for w in words], np.int64)[at] if words else np.empty(0, np.int64)
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[rows] - ends + sizes, sizes) + np.arange(total)], ends


_ENCODERS: dict[tuple, object] = {}


def _words(path: str) -> Encoder:
    """Per pre-token: ids in decimal, tokens, number of ids. One encoder per Python worker."""
    if (path, "words") not in _ENCODERS:
        tokens: list[str] = []

        def render(ids):
            ids = ids.tolist()
            return " ".join(map(str, ids)), " ".join([tokens[i] for i in ids]), len(ids)

        made = _ENCODERS[path, "words"] = Encoder(path, render)
        tokens += made.vocabulary.tokens
    return _ENCODERS[path, "words"]


def flat_encoder(path: str) -> FlatEncoder:
    """One encoder per Python worker and file; it is rebuilt wherever a worker is new."""
    if (path, "flat") not in _ENCODERS:
        _ENCODERS[path, "flat"] = FlatEncoder(path)
    return _ENCODERS[path, "flat"]


def encode_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>), one for every row of ``df``.

    Ids are those of the tokenizer file without added special tokens; the strings of special tokens in a
    text give their ids. A null or empty text gives an empty array. Repeated rows and null ids stay as they
    are; an empty table gives an empty result; a text of any length is encoded whole.
    """

    def run(batches):
        for rows in itertools.chain.from_iterable(text_groups(b, 1, 1 << 21) for b in batches):
            ids = list(flat_encoder(path).batch(["" if t is None else t for t in rows.column(1).to_pylist()]))
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that a column of ids decodes to (null ids: null; no ids: empty)."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        vocabulary = flat_encoder(path).vocabulary
        return column.map(lambda ids: None if ids is None else vocabulary.decode(ids))

    return df.withColumn(out, decoded(F.col(ids_col)))


def bpe_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the decimal ids and of the decoded text, without keeping either.

    For vocabulary files without a decoder, whose decoded text is the tokens joined by a space. Nulls, empty
    texts and repeats as in ``encode_ids``.
    """

    def run(batches):
        for rows in itertools.chain.from_iterable(text_groups(b, 1, 1 << 21) for b in batches):
            texts = ["" if t is None else t for t in rows.column(1).to_pylist()]
            counts, of_ids, of_text = [], [], []
            for pieces in _words(path).batch(texts):
                counts.append(sum([p[2] for p in pieces]))
                of_ids.append(hashlib.sha256(" ".join([p[0] for p in pieces]).encode()).hexdigest())
                of_text.append(hashlib.sha256(" ".join([p[1] for p in pieces]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op2_bpe(spark, sf_dir):
    """Every document encoded and decoded again; nulls, repeats and empty tables as in ``encode_ids``."""
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
