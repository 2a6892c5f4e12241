"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

The texts are read once into a narrow table (id, 64-bit hash, SHA-256). Pass one folds every hash into filter
one, a bitmap of 64-bit words with over 256 bits for each row, built by partial aggregation: a row sets one bit of one
word, and a word that was given more rows than it has bits set has seen one of its bits before. Pass two collects
what such words were given in filter two, which is smaller and is sent to all tasks. Probing filter two in a
second scan tells rows that are unique for certain, which pass straight through, from those that are
possibly repeated: only these shuffle, as (id, digest) or with their columns, to meet their group by SHA-256.

Groups that hold over a ``HOT_GROUPS``-th of those rows, of which there are fewer than that, meet their rows by
broadcast, so a hot group is counted by map-side combining and never gathered. Both filters are sized by the number
of rows; filter two has ``2**filter_bits`` bits at most, which bounds the broadcast. A filter that is too small for
the corpus makes more rows shuffle but never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, table, text_or_empty, without

HOT_GROUPS = 1024
OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")


def _word(h: str, bits: int) -> Column:
    """The word of a hash in a filter of ``2**bits`` bits: its uppermost bits."""
    return F.expr(f"shiftrightunsigned({h}, {64 - (bits - 6)})")


def _mask(h: str, *shifts: int) -> str:
    """A word with a bit set for each six bits of the hash."""
    return "(" + " | ".join(f"shiftleft(CAST(1 AS BIGINT), CAST(shiftright({h}, {s}) & 63 AS INT))" for s in shifts) + ")"


def repeated_filter(hashes: DataFrame, n: int, filter_bits: int) -> tuple[DataFrame, int]:
    """Rows ``(__word, __bits)`` of filter two over a column ``__h`` of ``n`` hashes, and the logarithm of its bits.

    Every hash that occurs more than once is in it; of those that occur once, a few are.
    """
    one = min(max(n - 1, 1).bit_length() + 8, 56)
    two = min(max(one - 4, 12), filter_bits)
    seen = hashes.groupBy(_word("__h", one).alias("__w")).agg(
        F.count(F.lit(1)).alias("__n"), F.bit_or(F.expr(_mask("__h", 0))).alias("__once"),
        F.bit_or(F.expr(_mask("__h", 0, 6))).alias("__bits"),
    )
    again = seen.filter(F.col("__n") > F.bit_count("__once"))
    # filter two's word is a prefix of filter one's
    found = again.groupBy(F.expr(f"shiftrightunsigned(__w, {one - two})").alias("__word")).agg(F.bit_or("__bits").alias("__bits"))
    return found, two


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 26, keep_columns: bool = True) -> DataFrame:
    """All rows of ``df`` plus keep_id, group_size, kept and text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest
    id stays. Rows that repeat both id and text all carry the same keep_id and are all ``kept`` (they are
    one document; group_size counts each of them). A null id loses to any other; a group of null ids only
    has keep_id null and stays. An empty table gives an empty result. Columns of ``df`` that bear an
    output's name are replaced. Without ``keep_columns`` rows hold the id and the outputs only, and the texts are
    read once instead of twice (and a third time for the rows that shuffle).
    """
    if not 12 <= filter_bits <= 30:
        raise ValueError("filter_bits must lie between 12 and 30")
    rows = without(df, *OUTPUTS).withColumns(
        {"__h": F.xxhash64(text_or_empty(text_col)), "text_sha256": F.sha2(text_or_empty(text_col).cast("binary"), 256)}
    )
    hashes = materialise(rows.select(F.col(id_col).alias("__id"), "__h", "text_sha256"), "hashes")
    found, bits = repeated_filter(hashes.select("__h"), hashes.count(), filter_bits)
    found = materialise(found, "filter")
    if not keep_columns:
        rows = hashes.withColumnRenamed("__id", id_col)

    def probe(of: DataFrame) -> DataFrame:
        hit = F.expr(f"coalesce(__bits & {_mask('__h', 0, 6)} = {_mask('__h', 0, 6)}, false)")
        return of.withColumn("__word", _word("__h", bits)).join(F.broadcast(found), "__word", "left").withColumn("__maybe", hit).drop("__word", "__bits", "__h")

    groups = materialise(
        probe(hashes).filter("__maybe").groupBy(F.col("text_sha256").alias("__sha"))
        .agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size")).filter("__size > 1"),
        "groups",
    )
    total = groups.agg(F.sum("__size")).first()[0] or 0
    hot = groups.filter(F.col("__size") * HOT_GROUPS > total)  # so there are fewer than HOT_GROUPS of them
    placed = probe(rows).join(F.broadcast(hot), F.col("__maybe") & (F.col("text_sha256") == F.col("__sha")), "left")
    alone = {"keep_id": F.when(F.col("__size").isNotNull(), F.col("__keep")).otherwise(F.col(id_col)), "group_size": F.coalesce("__size", F.lit(1).cast("long"))}
    here = placed.filter("NOT __maybe OR __sha IS NOT NULL").withColumns(alone)
    shuffled = (
        placed.filter("__maybe AND __sha IS NULL").drop("__sha", "__keep", "__size")
        .join(groups, F.col("text_sha256") == F.col("__sha"), "left").withColumns(alone)
    )
    whole = here.unionByName(shuffled).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    return whole.drop("__maybe", "__sha", "__keep", "__size")


def op1_exact_dedup(spark, sf_dir):
    """Every document with the copy that stays for it; nulls, ties, repeats and empty tables as in ``exact_dedup``."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep_columns=False).select("doc_id", *OUTPUTS)


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
