"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a slot holds a bit per language, and the AND of an n-gram's
slots is the set of languages that contain it. A text's popcount per language, corrected for the share of
false positives that the language's slice has at its fill, decides. N-grams are 2 to 4 characters of
lower-cased words, their edges included; any other character is an edge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import mix64, table, text_or_empty

SIZES = (2, 3, 4)
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes of all texts, the text each belongs to, and each text's number of letters."""
    joined = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in joined])
    codes = np.concatenate(joined) if joined else np.empty(0, np.uint32)
    letter = letters()[codes]
    n_letters = np.bincount(of[letter], minlength=len(texts))
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # one edge before a word
    keep[1:] |= letter[:-1]  # and one after it
    codes, of, letter = np.where(letter, codes, 0)[keep].astype(np.uint64), of[keep], letter[keep]
    hashes, owners = [], []
    for n in SIZES:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        h = np.full(size, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : k + size]
        whole = np.ones(size, bool)  # edges only at the ends, and not just edges
        for k in range(1, n - 1):
            whole &= letter[k : k + size]
        if n == 2:
            whole = letter[:size] | letter[1 : 1 + size]
        hashes.append(h[whole])
        owners.append(of[:size][whole])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int32), n_letters
    return mix64(np.concatenate(hashes)), np.concatenate(owners), n_letters


def _groups(texts: list[str], limit: int = 1 << 18):
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= limit):
            size += len(texts[b])
            b += 1
        yield a, b
        a = b


class LanguageFilter:
    """Languages, the slots' bitmasks and each slice's share of false positives."""

    def __init__(self, languages: list[str], slots: np.ndarray):
        self.languages, self.slots = languages, slots
        fill = np.array([(slots >> np.uint64(i) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false_positive = fill**2

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        m = np.uint64((1 << bits) - 1)
        return (hashes & m).astype(np.int64), (hashes >> np.uint64(32) & m).astype(np.int64)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language and score of each text; ``und`` and 0 without letters or without languages, ties to the first."""
        bits, named, scores = int(len(self.slots)).bit_length() - 1, [], []
        for a, b in _groups(texts):
            h, of, n_letters = grams(texts[a:b])
            one, two = self.places(h, bits)
            masks = self.slots[one] & self.slots[two]
            n = np.maximum(np.bincount(of, minlength=b - a), 1)
            hits = np.stack([np.bincount(of[(masks >> np.uint64(i) & np.uint64(1)).astype(bool)], minlength=b - a) for i in range(len(self.languages))], 1) if self.languages else np.zeros((b - a, 0))
            share = np.clip((hits / n[:, None] - self.false_positive) / np.maximum(1 - self.false_positive, 1e-9), 0, 1)
            for i in range(b - a):
                if not n_letters[i] or not self.languages:
                    named.append("und"), scores.append(0.0)
                    continue
                best, total = int(share[i].argmax()), float(share[i].sum())
                named.append(self.languages[best]), scores.append(float(share[i, best]) / total if total else 0.0)
        return named, scores


def fit(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = 1500, slot_bits: int = 20,
    least_share: float = 0.004, beside_best: float = 0.15, id_col: str = "doc_id",
) -> LanguageFilter:
    """A filter from labelled rows; rows without text or language teach nothing.

    About ``per_language`` rows of each language are drawn by a hash of their ids (the documented bound of the
    fit); rows with a null id are drawn together or not at all. An n-gram is a language's own if at least ``least_share`` of its sampled texts hold it and
    that share is at least ``beside_best`` of the largest share any language has, which keeps foreign passages
    and wrong labels out. At most 64 languages.
    """
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.pmod(F.xxhash64(F.lit("fit"), id_col), F.lit(1 << 24)) / float(1 << 24)).alias("r")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if len(languages) > 64:
        raise ValueError("at most 64 languages")
    if not languages:
        return LanguageFilter([], np.zeros(1 << slot_bits, np.uint64))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(per_language / counts[k]))])
    sample = rows.filter(F.col("r") < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
                parts = []
                for a, b in _groups(own):
                    h, of, _ = grams(own[a:b])
                    # one of each n-gram in a text; pairs are told apart by their mixed hash
                    _, at = np.unique(h + mix64(of.astype(np.uint64) + np.uint64(1)), return_index=True)
                    parts.append(h[at])
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n, pa.int64()), pa.array([len(own)] * len(h), pa.int64())], names=["lang", "gram", "n", "own"])

    size = {r[0]: r[1] for r in sample.groupBy("lang").count().collect()}
    each = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(1.0 / max(size.get(k, 0), 1)))])
    bit = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(np.uint64(1 << i).astype(np.int64).item()).cast("long"))])
    found = (
        sample.mapInArrow(count, "lang string, gram long, n long, own long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("share", F.col("n") * each[F.col("lang")])
        .filter((F.col("share") >= least_share) & ((F.col("n") > 1) | (F.col("share") > 0.02)))
        .groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("of"), F.max("share").alias("best"))
        .select("gram", F.explode("of").alias("x"), "best")
        .filter(F.col("x.share") >= beside_best * F.col("best"))
        .groupBy("gram").agg(F.bit_or(bit[F.col("x.lang")]).alias("mask"))
    )
    # shares of at least least_share bound what comes here: languages * n-grams of a text / least_share
    pulled = found.toArrow()
    slots = np.zeros(1 << slot_bits, np.uint64)
    hashes, masks = (pulled.column(i).to_numpy().view(np.uint64) for i in (0, 1))
    for place in LanguageFilter.places(hashes, slot_bits):
        np.bitwise_or.at(slots, place, masks)
    return LanguageFilter(languages, slots)


def predict(df: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (0 to 1: the best language's share of all corrected popcounts).

    A text that is null or has no letter gives ``und`` and 0, as does a filter without languages; ties go to
    the first language in order. Existing columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def named(texts: pd.Series) -> pd.DataFrame:
        langs, scores = shared.value.predict(["" if t is None else t for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    out = df.drop("lang_pred", "score").withColumn("__p", named(text_or_empty(text_col)))
    return out.select("*", "__p.lang_pred", "__p.score").drop("__p")


def op6_langid(spark, sf_dir):
    """The language of every document, learnt from the documents that are not held out.

    One row for every document, repeated ones too; a null id is not held out. Null, empty and letterless texts and
    empty tables as in ``predict`` and ``fit``.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    model = fit(docs.filter(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")
