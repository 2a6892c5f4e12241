"""N-gram Jaccard join as a blocked sparse matrix product of documents by n-grams.

Documents with equal n-gram sets form a class and are one row of the matrix. Columns met in one class only add
nothing to any product; what remains of a row must reach the least overlap its size allows, else the row is
discarded. Of the rows that are left, the rarest columns, as many as leave less than the least overlap behind, must be
shared by any two that link: they are the rows' ties, and only tied rows are multiplied.

Copies of one text are tied by nearly all their columns. So the best connected row of every tie is multiplied with the
others of that tie first, which joins most near copies in a pass whose size grows with the ties. Then only ties between
different components are left. Their rows are multiplied in blocks, either the rows of each tie or those of each cluster of
ties, whichever copies rows less often; blocks of rows of one component, of sizes too far apart, or whose columns of their
own rule out a link are not paired. The product of two blocks accumulates overlap counts and skips rows that are linked
already.

Columns that a large share of all rows has, and sets that a large share of all documents has, are found first and take
another way, so that no bucket gathers them. Results are exact up to collisions of hashes: 64 bits for a whole set, 48 for
an n-gram.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import buckets_for, materialise, mix64, table, text_or_empty
from lodestone.llm.components import components
from lodestone.llm.wordhash import bucket_entries, gathered, key_buckets, scatter, text_groups, window_hashes, word_hashes

BLOCK_ROWS, BLOCK_ENTRIES = 1024, 1 << 21
STARS = 2  # passes in which the best connected rows meet the others
HOT_SHARE, HOT_LEAST, HOT_COLUMNS = 10_000, 1024, 1 << 17  # hot: in a 10,000th of all rows, and 1024; at most so many columns
EVERYWHERE = (1 << 16) - 1  # the frequency given to a hot column; others count one less at most
HOT_GROUPS, SALTS = 1024, 256  # groups that hold over such a part of all rows are dealt out by so many salts


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, sorted within each; the text of each; each text's set size.

    A text with fewer than n words has its whole sequence as its only n-gram; without words it has none.
    """
    words, counts = word_hashes(texts, lower=True)
    text = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    hashes, owners = [], []
    if len(words) >= n:
        at = np.flatnonzero(text[: len(words) - n + 1] == text[n - 1 :])
        hashes.append(window_hashes(words, n)[at])
        owners.append(text[at])
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            h = np.full(len(short), size, np.uint64)
            for k in range(size):
                h = mix64(h * np.uint64(0x8CB92BA72F3D8DD7) + words[ends[short] - size + k])
            hashes.append(h)
            owners.append(short)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    h, of = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, of, np.bincount(of, minlength=len(texts))


def set_keys(h: np.ndarray, of: np.ndarray, n_texts: int) -> np.ndarray:
    """64 bits (int64) that tell sets apart: sums of mixed hashes, which need no order."""
    out = np.zeros(n_texts, np.uint64)
    np.add.at(out, of, mix64(h ^ np.uint64(0x5851F42D4C957F2D)))
    return mix64(out).view(np.int64)


def least_overlap(n, percent: int):
    """The overlap that a set of n needs with any set it links to: J >= t implies overlap >= t * n."""
    return -(-n * percent // 100)


def may_link(n_a, n_b, k_a, k_b, percent: int):
    """Whether sizes allow a link: n columns in all, k of them shared with any other row."""
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & ((100 - percent) * np.minimum(k_a, k_b) >= percent * ((n_a - k_a) + (n_b - k_b)))


def multiply(sizes: np.ndarray, rows: list[np.ndarray], side: np.ndarray | None, percent: int, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among rows (of the two sides, if sides are given) that suffice to connect all that are linked.

    Row by row of the sparse product: overlaps of one row with all others are counted over the postings of its
    columns. Rows of one component so far (``group``, if some are known) need no further product; rows whose sizes rule
    out a link neither.
    """
    n = len(rows)
    lengths = np.array([len(r) for r in rows])
    columns, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(n), lengths)
    by_column = np.argsort(inverse, kind="stable")
    posting, bounds = owner[by_column], np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(columns)))])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    weight = np.bincount(owner, np.diff(bounds)[inverse], minlength=n) / np.maximum(lengths, 1)
    group = np.arange(n) if group is None else np.unique(group, return_inverse=True)[1]
    found = []
    for i in np.argsort(-weight, kind="stable"):  # the best connected first: they gather the rest
        fits = (group != group[i]) & may_link(sizes, sizes[i], lengths, lengths[i], percent)
        if side is not None:
            fits &= side != side[i]
        if not fits.any():
            continue
        own = inverse[starts[i] : starts[i + 1]]
        reach = bounds[own + 1] - bounds[own]
        ends = np.cumsum(reach)
        met = posting[np.repeat(bounds[own] - ends + reach, reach) + np.arange(ends[-1] if len(ends) else 0)]
        overlap = np.bincount(met, minlength=n)
        for j in np.flatnonzero(fits & (100 * overlap >= percent * (sizes + sizes[i] - overlap))):
            if group[j] != group[i]:
                found.append((int(i), int(j)))
                group[group == group[j]] = group[i]
    return found


def link_rows(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def sets_of(rows: DataFrame, n: int) -> DataFrame:
    """(id, n, node): every row's set size and the 64 bits that stand for its set; on the first row of a group of
    documents also the columns that many of the group's sets have, and in how many."""

    def describe(batches):
        for batch in batches:
            for group in text_groups(batch, 1):
                h, of, sizes = shingle_sets(group.column(1), n)
                keys = set_keys(h, of, group.num_rows)
                _, first = np.unique(keys, return_index=True)
                distinct = np.zeros(group.num_rows, bool)
                distinct[first] = True
                columns, times = np.unique(h[distinct[of]], return_counts=True)
                often = times >= max(8, len(first) // 50)
                none = [None] * (group.num_rows - 1)
                heavy = pa.array([columns[often].view(np.int64).tolist(), *none], pa.list_(pa.int64()))
                counts = pa.array([times[often].tolist(), *none], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([group.column(0), pa.array(sizes, pa.int64()), pa.array(keys), heavy, counts], names=["id", "n", "node", "heavy", "times"])

    return rows.mapInArrow(describe, "id long, n long, node long, heavy array<long>, times array<long>")


def matrix_rows(rows: DataFrame, described: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, n, k, w, h, rare): a row for each class that shares enough columns to link: its size, how many columns it
    shares, how common they are, the shared columns themselves, and its ties."""
    spark = rows.sparkSession
    buckets = buckets_for(rows, "text", 16 << 20)  # a document is named once in each bucket, so few and large ones
    least = max(HOT_LEAST, described.count() // HOT_SHARE)
    heavy = described.filter("heavy IS NOT NULL").select(F.explode(F.arrays_zip("heavy", "times")).alias("x"))
    heavy = heavy.groupBy(F.col("x.heavy").alias("g")).agg(F.sum("x.times").alias("c")).filter(F.col("c") >= least)
    # both lists are bounded: so many columns at most, and fewer than HOT_SHARE sets
    hot = np.sort(heavy.orderBy(F.desc("c"), "g").limit(HOT_COLUMNS).select("g").toArrow().column(0).to_numpy().view(np.uint64))
    common = {r[0]: r[1] for r in classes.filter(F.col("c") > least).select("node", "least").collect()}
    shared = spark.sparkContext.broadcast((hot, common))

    def direct(made: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pc.subtract(-1, made.column(0)), made.column(1)], names=["bucket", "blob"])

    def emit(batches):
        hot, common = shared.value
        for batch in batches:
            for group in text_groups(batch, 1):
                h, of, sizes = shingle_sets(group.column(1), n)
                keys = set_keys(h, of, group.num_rows)
                _, first = np.unique(keys, return_index=True)  # of equal sets in a group one speaks for all
                speaks = np.zeros(group.num_rows, bool)
                speaks[first] = True
                if common:  # and of a very common set, one in all
                    for i, (own, key) in enumerate(zip(group.column(0).to_pylist(), keys.tolist(), strict=True)):
                        if key in common:
                            speaks[i] = common[key] == own
                mine, owners = speaks[of], key_buckets(keys.view(np.uint64), buckets)
                # a set's size goes straight to its row, as a column of no frequency
                said = np.flatnonzero(speaks & (sizes > 0))
                if len(said):
                    yield direct(scatter(sizes[said].astype(np.uint64), said, keys, owners[said], np.zeros(len(said), np.uint16)))
                everywhere = np.isin(h, hot) & mine
                mine &= ~everywhere
                if mine.any():
                    yield scatter(h[mine], of[mine], keys, key_buckets(h[mine], buckets))
                if everywhere.any():
                    x, y = h[everywhere], of[everywhere]
                    yield direct(scatter(x, y, keys, owners[y], np.full(len(x), EVERYWHERE, np.uint16)))

    def meet(batches):
        for (bucket,), blobs in gathered(batches):
            if bucket < 0:  # on its way to the rows already
                for (blob,) in blobs:
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - bucket]), pa.array([blob], pa.binary())], names=["bucket", "blob"])
                continue
            docs, h, slots = bucket_entries([b for (b,) in blobs])
            nodes, of_doc = np.unique(docs, return_inverse=True)
            row = of_doc[slots]
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            df = np.diff(np.append(np.flatnonzero(first), len(h)))[np.cumsum(first) - 1]
            keep = df > 1
            order = np.argsort(row[keep], kind="stable")
            h, row, df = h[keep][order], row[keep][order], df[keep][order]
            if len(h):
                yield scatter(h, row, nodes, key_buckets(nodes.view(np.uint64), buckets)[row], np.minimum(df, EVERYWHERE - 1).astype(np.uint16))

    def bound(batches):
        for _, blobs in gathered(batches):
            docs, h, slots, df = bucket_entries([b for (b,) in blobs])
            nodes, of_doc = np.unique(docs, return_inverse=True)
            row, n_columns = of_doc[slots], np.zeros(len(nodes), np.int64)
            n_columns[row[df == 0]] = h[df == 0].astype(np.int64)
            row, h, df = row[df > 0], h[df > 0], df[df > 0]
            table = np.column_stack([nodes, n_columns])
            order = np.lexsort((h, df, row))  # rarest columns first
            h, row, df = h[order], row[order], df[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row, df = h[new], row[new], df[new]
            shared = np.bincount(row, minlength=len(table))
            fits = (shared > 0) & (100 * shared >= percent * table[:, 1])  # a row must reach the least overlap of its size
            weight = np.bincount(row, df, minlength=len(table)).astype(np.int64) // table[:, 1]
            h = h[fits[row]]
            table, shared, weight = table[fits], shared[fits], weight[fits]
            ends = np.cumsum(shared)
            take = table[:, 1] - least_overlap(table[:, 1], percent) + 1 - (table[:, 1] - shared)
            for a in range(0, len(table), 1000):
                part = range(a, min(a + 1000, len(table)))
                own = [h[ends[i] - shared[i] : ends[i]] for i in part]
                rare = [x[: max(0, take[i])].view(np.int64) for x, i in zip(own, part, strict=True)]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, rare)]).astype(np.int32), pa.array(np.concatenate(rare)))
                columns = [pa.array(x[part].astype(np.int64)) for x in (table[:, 0], table[:, 1], shared, weight)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in own], pa.binary()), lists], names=["node", "n", "k", "w", "h", "rare"])

    met = rows.filter("id IS NOT NULL").mapInArrow(emit, "bucket long, blob binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    by_node = met.mapInArrow(meet, "bucket long, blob binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return by_node.mapInArrow(bound, "node long, n long, k long, w long, h binary, rare array<long>")


class Salt:
    """Deals the rows of groups out, so that no task gets a hot group whole.

    ``rows`` get a salt by their node where their group (``key``) is hot; tables with a row for each group are repeated
    for every salt of a hot group, of which there are fewer than ``HOT_GROUPS``.
    """

    def __init__(self, rows: DataFrame, key: str):
        self.key, counts = key, rows.groupBy(key).agg(F.count(F.lit(1)).alias("__c"))
        self.hot = [r[0] for r in counts.filter(F.col("__c") * HOT_GROUPS > rows.count()).select(key).collect()]

    def rows(self, df: DataFrame) -> DataFrame:
        return df.withColumn("salt", F.when(F.col(self.key).isin(self.hot), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(0)).cast("long"))

    def groups(self, df: DataFrame) -> DataFrame:
        every = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
        return df.withColumn("salt", F.explode(F.when(F.col(self.key).isin(self.hot), every).otherwise(F.array(F.lit(0).cast("long")))))

    def join(self, df: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
        return self.rows(df).join(self.groups(groups), [self.key, "salt"], how).drop("salt")


def ties_of(left: DataFrame) -> DataFrame:
    """(g, node, n, k, w): the rows of each tie that more than one row has; of ties with the same rows, one."""
    ties = materialise(left.select(F.explode("rare").alias("g"), "node", "n", "k", "w"), "all-ties")
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"s{i}") for i in range(2)]
    groups = ties.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("m"), *same).filter("c > 1")
    alone = materialise(groups.groupBy("c", "m", "s0", "s1").agg(F.min("g").alias("g")).select("g"), "groups")
    return Salt(ties, "g").join(ties, alone)


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with comp: the component of node so far, itself if there is none."""
    if labels is None:
        return rows.withColumn("comp", F.col("node"))
    known = labels.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    return rows.join(known, F.col("node") == F.col("__n"), "left").withColumn("comp", F.coalesce("__c", "node")).drop("__n", "__c")


def fitting(n: str, k: str, m: str, j: str, percent: int) -> Column:
    """``may_link`` as a column."""
    sizes = F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})")
    return sizes & F.expr(f"{100 - percent} * least({k}, {j}) >= {percent} * ({n} - {k} + {m} - {j})")


def star_links(members: DataFrame, left: DataFrame, percent: int, salt: Salt) -> tuple[DataFrame, DataFrame]:
    """Links of each tie's best connected row with the other rows of the tie, and those rows as (g, u)."""
    best = members.groupBy("g").agg(F.max(F.struct("w", "node", "n", "k", "comp")).alias("b"))
    best = best.select("g", F.col("b.node").alias("u"), F.col("b.n").alias("un"), F.col("b.k").alias("uk"), F.col("b.comp").alias("uc"))
    pairs = salt.join(members, best).filter(F.col("comp") != F.col("uc")).filter(fitting("n", "k", "un", "uk", percent))
    pairs = materialise(pairs.select("u", "node").distinct(), "stars")
    blocks = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("long").alias("blocks"))
    rows = left.select("node", "n", "h")
    others = pairs.join(blocks, "u").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks"))).join(rows, "node").select("u", "b", F.lit(1).alias("side"), "node", "n", "h")
    hubs = blocks.join(rows.withColumnRenamed("node", "u"), "u").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    hubs = hubs.select("u", "b", F.lit(0).alias("side"), F.col("u").alias("node"), "n", "h")

    def product(batches):
        hub, size, current = np.empty(0, np.uint64), 0, None
        for batch in batches:
            found = []
            for u, b, side, node, n, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if side == 0:
                    hub, size, current = np.sort(np.frombuffer(h, "<u8")), n, (u, b)
                    continue
                if current != (u, b):
                    raise ValueError("a row without its best connected row")
                own = np.frombuffer(h, "<u8")
                at = np.searchsorted(hub, own)
                overlap = int((hub[np.minimum(at, len(hub) - 1)] == own).sum())
                if 100 * overlap >= percent * (size + n - overlap):
                    found.append((u, node))
            if found:
                yield link_rows(found)

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = hubs.unionByName(others).repartition(parts, "u", "b").sortWithinPartitions("u", "b", "side").mapInArrow(product, "u long, v long")
    return links, best.select("g", "u")


CELL = ["big", "sc", "heavy"]
FEW_COPIES = 8  # of a row, on average, up to which ties are multiplied without weighing clusters against them
CELLS = 1024  # a cluster of more cells is multiplied tie by tie, so that pairs of cells stay few


def cut_blocks(members: DataFrame, percent: int, most: int | None = None) -> tuple[DataFrame, DataFrame, Salt]:
    """Rows (t, node, comp, big, sc, heavy) of groups ``t`` with their cells, and the pairs of cells to be multiplied.

    A group of at most a block is one cell. A larger one is cut by component (of those that fill a block), by size
    class, and by whether a row's own columns leave it room for such another row; cells are cut into ``blocks``. Pairs
    of cells hold ``copies``: how many rows they send out. Groups of over ``most`` cells get no pairs.
    """
    salt = Salt(members, "t")
    whole = members.groupBy("t").agg(F.count(F.lit(1)).alias("rows"), F.sum("k").alias("entries"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    whole = whole.filter("c1 <> c2").withColumn("large", (F.col("rows") > BLOCK_ROWS) | (F.col("entries") > BLOCK_ENTRIES)).select("t", "large")
    of_comp = members.groupBy("t", "comp").agg(F.count(F.lit(1)).alias("of_comp")).filter(F.col("of_comp") >= BLOCK_ROWS)
    of_comp = salt.groups(of_comp).select(F.col("t").alias("t3"), F.col("comp").alias("comp3"), F.col("salt").alias("salt3"), "of_comp")
    size_class = F.floor(F.log("n") / F.lit(math.log(100 / percent) * 1.0001)) if percent < 100 else F.col("n")
    heavy = F.expr(f"{2 * percent} * (n - k) > {100 - percent} * k")
    none = F.lit(0).cast("long")
    rows = (
        salt.rows(salt.join(members, whole))
        .join(of_comp, F.col("large") & (F.col("t") == F.col("t3")) & (F.col("comp") == F.col("comp3")) & (F.col("salt") == F.col("salt3")), "left")
        .select(
            "t", "node", "comp", "k",
            F.when(F.col("of_comp").isNotNull(), F.col("comp")).alias("big"),
            F.when(F.col("large"), size_class.cast("long")).otherwise(none).alias("sc"),
            (F.col("large") & heavy).alias("heavy"),
        )
    )
    rows = materialise(rows, "cells")
    cells = rows.groupBy("t", *CELL).agg(F.count(F.lit(1)).alias("rows"), F.sum("k").alias("entries"))
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("entries") / BLOCK_ENTRIES)).cast("long")
    cells = cells.select("t", F.struct(*CELL).alias("cell"), "rows", blocks.alias("blocks"))
    if most:
        cells = cells.join(cells.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("t"), "t", "left_semi")
    other = cells.select(F.col("t").alias("t2"), F.col("cell").alias("to"), F.col("blocks").alias("to_blocks"))
    a, b = F.col("cell"), F.col("to")
    wanted = (F.abs(a["sc"] - b["sc"]) <= 1) & ~(a["heavy"] & b["heavy"])
    wanted &= a["big"].isNull() | b["big"].isNull() | (a["big"] != b["big"])
    pairs = cells.join(other, (F.col("t") == F.col("t2")) & wanted).filter(~a.eqNullSafe(b) | (F.col("rows") > 1))
    pairs = pairs.select("t", "cell", "blocks", "to", "to_blocks", (F.col("rows") * F.col("to_blocks")).alias("copies"))
    return rows.drop("k"), materialise(pairs, "cells"), salt


def block_links(members: DataFrame, left: DataFrame, percent: int, salt: Salt) -> DataFrame:
    """Links (u, v) among the rows of ties (g, node, n, k, comp) that lie in different components so far."""
    live = members.groupBy("g").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("g")
    members = materialise(salt.join(members, live, "left_semi").select("g", "node", "n", "k", "comp"), "ties")
    key = lambda way, of: F.xxhash64(F.lit(way), of).alias("t")
    by_tie, tie_pairs, tie_salt = cut_blocks(members.select(key("tie", "g"), "node", "n", "k", "comp"), percent)

    def chosen(rows: DataFrame, pairs: DataFrame, dealt: Salt) -> DataFrame:
        pairs = pairs.withColumnRenamed("cell", "from").drop("copies")
        return dealt.join(rows.withColumn("cell", F.struct(*CELL)).drop(*CELL), pairs).filter(F.col("cell").eqNullSafe(F.col("from")))

    copies = tie_pairs.agg(F.sum("copies")).first()[0] or 0
    if copies <= FEW_COPIES * left.count():
        met = chosen(by_tie, tie_pairs, tie_salt)
    else:  # whichever way copies rows less often, cluster by cluster
        first = members.groupBy("g").agg(F.min("node").alias("u"))
        clusters = components(salt.join(members, first).filter("u <> node").select("u", F.col("node").alias("v")).distinct())
        named = materialise(members.join(clusters, "node").withColumnRenamed("component", "cluster"), "ties")
        whole = materialise(named.select(key("cluster", "cluster"), "node", "n", "k", "comp").distinct(), "clusters")
        by_cluster, cluster_pairs, cluster_salt = cut_blocks(whole, percent, CELLS)
        of_tie = materialise(named.select(key("tie", "g"), key("cluster", "cluster").alias("c")).distinct(), "ways")
        cost = tie_pairs.join(of_tie, "t").groupBy("c").agg(F.sum("copies").alias("by_tie"))
        other = cluster_pairs.groupBy(F.col("t").alias("c2")).agg(F.sum("copies").alias("by_cluster"))
        cheaper = F.coalesce(F.col("by_tie") < F.col("by_cluster"), F.lit(True))
        ways = materialise(cost.join(other, F.col("c") == F.col("c2"), "left").select("c", cheaper.alias("ties")), "ways")
        met = chosen(by_tie, tie_pairs.join(of_tie.join(ways.filter("ties"), "c").select("t"), "t", "left_semi"), tie_salt)
        clustered = cluster_pairs.join(ways.filter("NOT ties").select(F.col("c").alias("t")), "t", "left_semi")
        met = met.unionByName(chosen(by_cluster, clustered, cluster_salt))
    own, x, alike = F.col("own"), F.col("x"), F.col("cell").eqNullSafe(F.col("to"))
    ahead = F.hash("cell", F.lit(1)) < F.hash("to", F.lit(1))
    ahead = F.when(F.hash("cell", F.lit(1)) == F.hash("to", F.lit(1)), F.to_json("cell") < F.to_json("to")).otherwise(ahead)
    placed = (
        met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("to_blocks") - 1)))
        .withColumn("a", F.when(alike, F.least(own, x)).when(ahead, own).otherwise(x))
        .withColumn("b", F.when(alike, F.greatest(own, x)).when(ahead, x).otherwise(own))
        .withColumn("side", F.when(alike, F.when(F.col("a") == F.col("b"), F.lit(2)).otherwise((own == F.col("b")).cast("int"))).otherwise((~ahead).cast("int")))
        .withColumn("at", F.when(ahead, F.xxhash64("t", "cell", "to", "a", "b")).otherwise(F.xxhash64("t", "to", "cell", "a", "b")))
        .select("at", "side", "node", "comp")
    )
    placed = placed.join(left.select("node", "n", "h"), "node").select("at", "side", "node", "n", "comp", "h")

    def product(batches):
        for _, members in gathered(batches):
            members.sort(key=lambda x: x[1])
            side = np.array([x[0] for x in members])
            links = multiply(
                np.array([x[2] for x in members]), [np.frombuffer(x[4], "<u8") for x in members], None if side[0] == 2 else side, percent,
                np.array([x[3] for x in members]),
            )
            if links:
                yield link_rows([(members[a][1], members[b][1]) for a, b in links])

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(product, "u long, v long")


def jaccard_components(df: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id), one for every row of ``df``.

    Sets are the distinct n-grams of words of the lower-cased text (see ``shingle_sets``); rows link when
    100 * overlap >= percent * union. component_id is the smallest id reachable by links, itself included. Rows
    without words are linked with nothing. Rows that repeat an id are given each; a row with a null id is linked with
    nothing and has a null component. Ids of other types than integers are cast to long. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    described = materialise(sets_of(rows, n), "sets")
    classes = materialise(
        described.filter("n > 0 AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c")), "classes"
    )
    left = materialise(matrix_rows(rows, described, classes, n, percent), "rows")
    ties = materialise(ties_of(left), "ties")
    salt = Salt(ties, "g")
    links, labels, open_ties = None, None, ties
    for _ in range(STARS):
        open_ties = labelled(open_ties.drop("comp"), labels)
        found, best = star_links(open_ties, left, percent, salt)
        found = materialise(found, "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        done = labelled(best.withColumnRenamed("u", "node"), labels).select("g", F.col("comp").alias("done"))
        here = labelled(open_ties.drop("comp"), labels)
        open_ties = materialise(salt.join(here, done).filter("comp <> done").drop("done"), "ties")
    links = links.unionByName(materialise(block_links(labelled(ties, labels), left, percent, salt), "links"))
    # a class speaks by its smallest id, so the smallest of a component is its smallest id
    named = classes.select("node", "least")
    ends = links.join(named.select(F.col("node").alias("u"), F.col("least").alias("a")), "u").join(named.select(F.col("node").alias("v"), F.col("least").alias("b")), "v")
    linked = components(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("id2"), "component")
    named = named.join(linked, F.col("least") == F.col("id2"), "left").select(F.col("node").alias("of"), F.coalesce("component", "least").alias("component_id"))
    known = (F.col("node") == F.col("of")) & (F.col("n") > 0) & F.col("id").isNotNull()
    return described.join(named, known, "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(df: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component; rows with a null id stay.

    All columns of ``df`` pass through. Rows that repeat the smallest id all stay.
    """
    found = jaccard_components(df, n, percent, id_col, text_col)
    drop = found.filter("component_id <> id").select(F.col("id").alias("__drop")).distinct()
    return df.join(drop, F.col(id_col).cast("long") == F.col("__drop"), "left_anti")


def op3_jaccard_join(spark, sf_dir):
    """Every document with the size of its 5-gram set and the smallest id it is linked with.

    Nulls, empty texts, repeated rows and empty tables as in ``jaccard_components``.
    """
    return jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least AS component_id FROM sets JOIN (SELECT u, min(v) AS least FROM reach GROUP BY u) ON u = doc_id
"""
