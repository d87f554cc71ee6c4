"""Exact vector search by pruned cells.

Vectors are written by cells, those of one nearest centre together; a cell has its centre c, its radius r and its size. For a
query vector q no vector of a cell scores more than q·c + |q| r, and in each group of eight components the same bound holds, so their sum is
another bound. A search looks into the cells of the greatest bounds until it has k vectors; the k-th score of these prunes all cells whose
bound is below it. What is left is read and scored in full, so results are those of comparing with every vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.operators.ranking import Best, top_k
from lanternflow.sources.scratch import scratch_path

#: Vectors that centres are fitted on, rounds of fitting, and cells at most.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 4096
_GROUPS = 8
_MARGIN = 2e-6


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)


def fit_centres(x: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Centres of cells by k-means; an empty cell takes a vector that is far from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = _nearest_centre(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = np.argsort(((x - centres[own]) ** 2).sum(axis=1))[::-1][: len(empty)]
            centres[empty] = x[far]
    return centres


def _group_norms(x: np.ndarray) -> np.ndarray:
    """Lengths of x within each group of components."""
    return np.stack([np.sqrt((part**2).sum(axis=1)) for part in np.array_split(x, min(_GROUPS, x.shape[1]), axis=1)], axis=1)


class VectorIndex:
    """Vectors by cells. visited: of the last search, pairs of query vectors and vectors that were scored, of how many there are."""

    def __init__(self, rows: DataFrame, path: str | None = None, cells: int | None = None):
        """rows: chunk_id and embedding, all of one length; those without a vector are passed over. Centres are fitted on SAMPLE vectors at most, every vector is indexed."""
        self.spark = rows.sparkSession
        self.path = path or scratch_path(self.spark, "vectors")
        self.visited: dict[str, int] = {}
        source = rows.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter("embedding is not null")
        n = source.count()
        cells = cells or max(1, min(MOST_CELLS, int(n**0.5) // 2))
        sample = source.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).collect()
        self.centres = fit_centres(np.array([r["embedding"] for r in sample], dtype=np.float64), cells) if sample else np.zeros((0, 0))
        centres = self.centres
        k = min(_GROUPS, centres.shape[1]) if len(centres) else 0

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    x = _matrix(part.column(1), part.num_rows)
                    own = _nearest_centre(x, centres)
                    off = x - centres[own]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.sqrt((off**2).sum(axis=1))), pa.array(list(_group_norms(off)), pa.list_(pa.float64())), pa.array(own.astype(np.int32))], names=["chunk_id", "embedding", "far", "parts", "cell"])

        schema = "chunk_id long, embedding array<float>, far double, parts array<double>, cell int"
        self.sizes = np.zeros(len(centres), dtype=np.int64)
        self.radius, self.spread = np.zeros(len(centres)), np.zeros((len(centres), k))
        self.table = self.spark.createDataFrame([], schema)
        if n:
            placed = source.mapInArrow(assign, schema)
            placed.repartitionByRange("cell", "chunk_id").write.partitionBy("cell").parquet(self.path)
            self.table = self.spark.read.schema(schema).parquet(self.path)
            most = [F.max(F.col("parts")[g]).alias(f"p{g}") for g in range(k)]
            for r in self.table.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), *most).collect():  # one row a cell
                self.sizes[r["cell"]], self.radius[r["cell"]] = r["n"], r["r"]
                self.spread[r["cell"]] = [r[f"p{g}"] for g in range(k)]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that a vector of each cell can score, for each query vector; nothing of an empty cell."""
        whole = np.sqrt((q**2).sum(axis=1))[:, None] * self.radius[None, :]
        parts = _group_norms(q) @ self.spread.T
        out = q @ self.centres.T + np.minimum(whole, parts)
        out[:, self.sizes == 0] = -np.inf
        return out

    def search(self, query_vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
        """query_id, chunk_id and vector_score of at least the k nearest chunks of each query (query_id, vector; several vectors of a query count as their best).

        Queries are a stated set, taken in blocks of about `block` vectors.
        """
        schema = "query_id long, chunk_id long, vector_score double"
        out = self.spark.createDataFrame([], schema)
        self.visited = {"pairs": 0, "of": 0}
        n_blocks = max(1, -(-query_vectors.count() // block)) if k > 0 and self.sizes.sum() else 0
        for b in range(n_blocks):
            part = query_vectors.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).orderBy("query_id").collect()
            if not part:
                continue
            ids = np.array(sorted({r["query_id"] for r in part}), dtype=np.int64)
            owners = np.searchsorted(ids, np.array([r["query_id"] for r in part]))
            q = np.array([list(r["vector"]) for r in part], dtype=np.float64)
            bound = self.bounds(q)
            visit = np.isfinite(bound)
            if len(self.centres) > 1:
                # The cells of the greatest bounds that hold k vectors together, for each query vector.
                order = np.argsort(-bound, axis=1)
                held = np.cumsum(self.sizes[order], axis=1)
                first = np.zeros_like(visit)
                np.put_along_axis(first, order, (held - self.sizes[order]) < k, axis=1)
                near = self._scored(q, owners, ids, first & visit, k, schema)
                kth = {r["query_id"]: r["vector_score"] for r in top_k(near, "vector_score", k).filter(F.col("rank") == k).collect()}  # one row a query
                least = np.array([kth.get(int(x), -np.inf) for x in ids]) - _MARGIN
                visit &= bound >= least[owners][:, None]
            self.visited["pairs"] += int((visit * self.sizes[None, :]).sum())
            self.visited["of"] += int(len(q) * self.sizes.sum())
            out = out.union(self._scored(q, owners, ids, visit, k, schema))
        return out

    def _scored(self, q: np.ndarray, owners: np.ndarray, ids: np.ndarray, visit: np.ndarray, k: int, schema: str) -> DataFrame:
        """The k best chunks of each query in each task. visit: which query vector looks into which cell."""
        cells = np.flatnonzero(visit.any(axis=0)).tolist()
        rows = self.table if len(cells) == int((self.sizes > 0).sum()) else self.table.filter(F.col("cell").isin(cells))
        packed = np.packbits(visit, axis=0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(k)
            for batch in batches:
                every = batch.column(2).to_numpy(zero_copy_only=False)
                for cell in np.unique(every):
                    asks = np.flatnonzero(np.unpackbits(packed[:, cell], count=len(q)))
                    own = np.flatnonzero(every == cell)
                    if not len(asks):
                        continue
                    first = np.flatnonzero(np.concatenate([[True], owners[asks][1:] != owners[asks][:-1]]))
                    names = ids[owners[asks][first]]
                    for at in range(0, len(own), 2048):
                        part = batch.take(pa.array(own[at : at + 2048]))
                        chunk = part.column(0).to_numpy(zero_copy_only=False)
                        scores = np.round(np.maximum.reduceat(q[asks] @ _matrix(part.column(1), len(chunk)).T, first, axis=0), 6)
                        least = np.partition(scores, -k, axis=1)[:, -k][:, None] if len(chunk) > k else -np.inf
                        i, c = np.nonzero(scores >= least)
                        best.add(names[i], chunk[c], scores[i, c])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.best()], names=["query_id", "chunk_id", "vector_score"])

        return rows.select("chunk_id", "embedding", "cell").mapInArrow(run, schema)
