"""Approximate nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

Nearest by Euclidean distance is maximum inner product with a per-row term: argmin |q - x| = argmax q.x - |x|^2/2.
A product quantiser with 16 centres per pair of dimensions is fitted under the anisotropic loss
``|r|^2 + (eta - 1) (r.x/|x|)^2`` of residuals r, which weighs the part of the error that is parallel to the vector
and so changes the largest inner products. Two four-bit codes share a byte; a query's tables for both are added
into one of 256 entries, so a scan adds one table row per byte and query block. The best rows of every chunk by
table score are reranked on the original vectors in double precision.

Every row is indexed. Queries are taken in rounds of bounded size; a task keeps the best of all its chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, shared_dir, table


@dataclass
class Quantiser:
    """Centres (subspaces, 16, 2) for vectors of ``dim`` components, and the weight of parallel error."""

    dim: int
    centres: np.ndarray
    eta: float

    def split(self, x: np.ndarray) -> np.ndarray:
        m = len(self.centres)
        return np.pad(x, ((0, 0), (0, 2 * m - x.shape[1]))).reshape(len(x), m, 2)

    def assign(self, x: np.ndarray, passes: int = 2, codes: np.ndarray | None = None) -> np.ndarray:
        """Codes (n, subspaces) by coordinate descent on the anisotropic loss."""
        parts = self.split(x.astype(np.float32))
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30).astype(np.float32)[:, None, None]
        if codes is None:
            codes = np.stack([((parts[:, j, None] - c) ** 2).sum(2).argmin(1) for j, c in enumerate(self.centres)], 1)
        along = np.stack([((parts[:, j] - c[codes[:, j]]) * unit[:, j]).sum(1) for j, c in enumerate(self.centres)], 1)
        total = along.sum(1)
        for _ in range(passes):
            for j, c in enumerate(self.centres):
                r = parts[:, j, None] - c
                par = (r * unit[:, j, None]).sum(2)
                rest = (total - along[:, j])[:, None]
                codes[:, j] = ((r**2).sum(2) + (self.eta - 1) * (rest + par) ** 2).argmin(1)
                new = par[np.arange(len(x)), codes[:, j]]
                total += new - along[:, j]
                along[:, j] = new
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Centres that minimise the loss for given codes: a two by two system each."""
        parts = self.split(x.astype(np.float32))
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30).astype(np.float32)[:, None, None]
        along = np.stack([((parts[:, j] - c[codes[:, j]]) * unit[:, j]).sum(1) for j, c in enumerate(self.centres)], 1)
        total = along.sum(1)
        for j, c in enumerate(self.centres):
            rest = total - along[:, j]
            for k in range(16):
                own = codes[:, j] == k
                if own.any():
                    u, v = unit[own, j], parts[own, j]
                    a = own.sum() * np.eye(2) + (self.eta - 1) * u.T @ u
                    b = v.sum(0) + (self.eta - 1) * ((rest[own] + (v * u).sum(1))[:, None] * u).sum(0)
                    c[k] = np.linalg.solve(a, b)
            new = ((parts[:, j] - c[codes[:, j]]) * unit[:, j]).sum(1)
            total += new - along[:, j]
            along[:, j] = new

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes a byte (n, ceil(subspaces / 2))."""
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with both centres of a byte (bytes, 256, queries)."""
        one = np.einsum("qmd,mkd->mkq", self.split(queries.astype(np.float32)), self.centres).astype(np.float32)
        one = np.pad(one, ((0, len(one) % 2), (0, 0), (0, 0)))
        return (one[1::2][:, :, None] + one[::2][:, None]).reshape(len(one) // 2, 256, len(queries))


def train(sample: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 1) -> Quantiser:
    """Fit centres to a sample; ``threshold`` is the least cosine whose products matter, which sets eta."""
    d = sample.shape[1]
    m, rng = -(-d // 2), np.random.default_rng(seed)
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    pick = sample[rng.choice(len(sample), 16, replace=len(sample) < 16)].astype(np.float32)
    q = Quantiser(d, np.zeros((m, 16, 2), np.float32), eta)
    q.centres = q.split(pick).transpose(1, 0, 2).copy() + rng.normal(0, 1e-6, (m, 16, 2)).astype(np.float32)
    codes = None
    for k in range(rounds):
        codes = q.assign(sample, 0 if k < rounds // 2 else 1, None if k < rounds // 2 else codes)
        q.refit(sample, codes)
    return q


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (vec_id, v) that take part: id and vector known, every component finite, not all zero."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~odd & F.exists("v", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build_index(rows: DataFrame, quantisers: dict[int, Quantiser]) -> DataFrame:
    """``rows`` of ``usable`` with their packed codes, by the quantiser of their length; every row is indexed."""
    shared = rows.sparkSession.sparkContext.broadcast(quantisers)

    def run(batches):
        for batch in batches:
            for dim, part in by_length(batch):
                q = shared.value[dim]
                packed = q.pack(q.assign(matrix(part.column(1))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in packed], pa.binary())], names=["vec_id", "v", "codes"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, codes binary")


def by_length(batch: pa.RecordBatch):
    """The rows of a batch by the length of their vectors: (length, rows)."""
    lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        yield int(dim), batch.take(pa.array(np.flatnonzero(lengths == dim)))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed component by component in order."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        d = rows[:, j] - query[j]
        total += d * d
    return np.sqrt(total)


def scan(own: np.ndarray, v: np.ndarray, codes: np.ndarray, ids: np.ndarray, queries: np.ndarray, tables: np.ndarray, k: int, shortlist: int) -> list[list[tuple]]:
    """Of one chunk of the index the ``k`` nearest (distance, id) of each query, by table scores, then by distance.

    Equal vectors are scanned once and stand for their smallest ids; an id counts once, with its nearest vector.
    """
    order = np.argsort(own, kind="stable")
    own, v, codes = own[order], v[order], codes[order]
    _, first, which = np.unique(v.view(f"V{v.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    by = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which))
    scores = np.repeat((-0.5 * (v[first] ** 2).sum(1)).astype(np.float32)[:, None], len(ids), 1)
    for j, t in enumerate(tables):
        scores += t[codes[first, j]]
    n = min(shortlist, len(first))
    best = np.argpartition(-scores.T, n - 1, axis=1)[:, :n]
    out = []
    for a, query in enumerate(queries):
        near = distances(v[first[best[a]]], query)
        found: dict[int, float] = {}
        furthest = 0.0
        for i in np.argsort(near, kind="stable"):
            if len(found) >= k and near[i] > furthest:
                break
            group = best[a][i]
            members = np.unique(own[by[(ends[group - 1] if group else 0) : ends[group]]])[: k + 1]
            for x in members[members != ids[a]][:k].tolist():
                if x not in found:
                    found[x] = furthest = float(near[i])
        out.append(sorted((d, x) for x, d in found.items())[:k])
    return out


def search_round(index: DataFrame, quantisers: dict[int, Quantiser], asked: dict[int, tuple], k: int, shortlist: int, chunk: int, path: str) -> None:
    """Scan the index once for a bounded set of queries ({length: (ids, vectors)}) and write what each task found."""
    shared = index.sparkSession.sparkContext.broadcast((asked, quantisers))

    def run(batches):
        asked, quantisers = shared.value
        held: dict[tuple, list] = {}
        for batch in batches:
            for dim, rows in by_length(batch):
                if dim not in asked:
                    continue
                ids, queries = asked[dim]
                for a in range(0, rows.num_rows, chunk):
                    part = rows.slice(a, chunk)
                    codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    v, own = np.ascontiguousarray(matrix(part.column(1))), part.column(0).to_numpy()
                    for b in range(0, len(ids), 512):
                        some, wanted = ids[b : b + 512], queries[b : b + 512]
                        for i, found in enumerate(scan(own, v, codes, some, wanted, quantisers[dim].tables(wanted), k, shortlist)):
                            key = (dim, b + i)
                            held[key] = nearest_ids(held.get(key, []) + found, k)
        rows = [(int(asked[dim][0][i]), x, d) for (dim, i), found in held.items() for d, x in found]
        for a in range(0, len(rows), 1 << 16):
            some = rows[a : a + (1 << 16)]
            columns = [pa.array([r[i] for r in some], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    index.mapInArrow(run, "query_id long, vec_id long, score double").write.mode("append").parquet(path)
    shared.destroy()


def nearest_ids(found: list[tuple], k: int) -> list[tuple]:
    """The ``k`` nearest of (distance, id), an id once."""
    best: dict[int, float] = {}
    for d, x in sorted(found):
        best.setdefault(x, d)
    return sorted((d, x) for x, d in best.items())[:k]


def nearest(
    df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    sample: int = 20_000, shortlist: int = 96, chunk: int = 8192, per_round: int = 16_384,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's ``k`` nearest rows found, nearest first.

    ``score`` is the Euclidean distance of the original vectors; ties go to the smaller id; a row with the
    query's own id is no candidate. Vectors that are null, empty or zero, hold null or non-finite components,
    or have a null id take no part. A distance needs two vectors of one length, so every length is a space of
    its own, with its own codebooks. Rows that repeat an id and vector count once, as queries and as
    candidates; an id with several vectors counts once, with the two that are nearest. Different ids with equal
    vectors count each. Codebooks are fitted to about ``sample`` rows of each length, drawn by a hash of the id
    (the bound of the fit); all rows are indexed and scanned. Queries go in rounds of about ``per_round``, each
    of which scans the index, writes what it found and frees its memory. No rows, no neighbours.
    """
    spark, rows = df.sparkSession, usable(df, id_col, vec_col)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = {r[0]: r[1] for r in rows.groupBy(F.size("v").alias("d")).count().collect()}  # a row for each length
    if not sizes:
        return none
    share = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, sample / n)])
    drawn = F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 24)) / float(1 << 24)
    fit = rows.filter((drawn < share[F.size("v")]) | share[F.size("v")].isNull()).select("vec_id", "v").toArrow().combine_chunks()
    fitted = {d: matrix(part.column(1)) for batch in fit.to_batches() for d, part in by_length(batch)}
    for d in sizes.keys() - fitted.keys():  # a length that every draw missed
        fitted[d] = matrix(rows.filter(F.size("v") == d).limit(sample).select("v").toArrow().column(0))
    quantisers = {d: train(x) for d, x in sorted(fitted.items())}
    index = materialise(build_index(rows, quantisers), "ann-index")
    asked = materialise(usable(queries, id_col, vec_col).distinct(), "ann-queries")
    rounds = max(1, -(-asked.count() // per_round))
    path = shared_dir(spark, "ann-found")
    none.select("query_id", "vec_id", "score").write.parquet(path)
    for r in range(rounds):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).orderBy("vec_id").toArrow().combine_chunks()
        some = {d: (p.column(0).to_numpy(), matrix(p.column(1))) for batch in part.to_batches() for d, p in by_length(batch)}
        if some:
            search_round(index, quantisers, some, k, shortlist, chunk, path)
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(path)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir):
    """The ten nearest vectors of every vector whose id is divisible by 100.

    Null, zero and non-finite vectors take no part; ties, repeated rows, other lengths and empty tables as in ``nearest``.
    """
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


#: Exact search: held against the query where its recall is full.
ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b)) AS score FROM v q JOIN v c
         ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM near QUALIFY rank <= 10
"""
