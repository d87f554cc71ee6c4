"""Embedding near-dedup by sorted projection passes.

1. Equal vectors become one node with a number of copies. In each of PASSES passes a node gets HASHES random hashes: the
   number and sign of the largest of 64 random projections (cross-polytope hashing). They are concatenated, all nodes are
   ordered lexicographically by them, and a node's rank in each pass is stored.
2. A window pass compares each node with the WINDOW next ones of its order. Blocks hold equally many nodes, so
   no key, however frequent, makes a block larger.
3. Of a run of nodes whose first hashes are equal, a window sees only a part. Runs longer than a window are compared whole, in tiles of
   bounded size. So what a pass compares does not depend on how many nodes are alike, and nothing is cut off. As many hashes
   count as are needed for about a window of nodes a run, were nodes spread evenly.
4. A pair counts in the first pass that compares it; that can be told from the ranks and runs of its two nodes alone. So no pairs are
   written: a block gives the number of links of each node, and a spanning forest of them.
5. Forests of all passes are joined to connected components.

A pair of cosine 0.95 has an equal hash with probability 0.60 (measured; 0.97: 0.68). With one, two, three or four hashes (up to
8 thousand, 1 million, 134 million, 17 billion nodes) it is compared in no pass with probability 4e-7, 8e-4, 0.02 or 0.11 at exactly
0.95, and 1e-8, 2e-4, 4e-3 or 0.02 at 0.97; windows find more than that. A link that is missed lowers n_links; it parts a class
only where no other way joins it.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.llm.ngram_join import components
from lanternflow.llm.shared import hot_join, materialise

PASSES, HASHES, WINDOW = 16, 5, 64
#: Two vectors link from this cosine on.
THRESHOLD = 0.95
#: Nodes of a block of a window pass, and of one side of a tile.
BLOCK_ROWS, TILE_ROWS = 2048, 1024
_DIRECTIONS, _BITS = 64, 7
#: Longer vectors are hashed by a sketch of this many components; cosines are always those of the whole vectors.
_MOST_DIM = 1024
_SEED = 20240229


def _read(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """vec_id, digest and bytes of vectors; digest and bytes are null where a vector links with nothing."""
    for batch in batches:
        column = batch.column(1)
        digests: list[bytes | None] = []
        vectors: list[bytes | None] = []
        for x in column:
            v = None
            if x.is_valid and len(x.values):
                if not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # no negative zeros
                    v = v.astype(kind) if np.isfinite(v).all() and v.any() else None
            vectors.append(None if v is None else v.tobytes())
            digests.append(None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "digest", "vec"])


def unit(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    x = np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@functools.lru_cache(maxsize=4)
def _projections(dim: int) -> tuple[tuple[np.ndarray, np.ndarray] | None, np.ndarray]:
    rng = np.random.default_rng([_SEED, dim])
    sketch = (rng.integers(0, _MOST_DIM, dim), rng.choice([-1.0, 1.0], dim)) if dim > _MOST_DIM else None
    return sketch, rng.standard_normal((PASSES, min(dim, _MOST_DIM), HASHES * _DIRECTIONS))


def hashes(x: np.ndarray) -> np.ndarray:
    """The concatenated hashes of each row in each pass."""
    sketch, directions = _projections(x.shape[1])
    if sketch:
        place, sign = sketch
        x = np.stack([np.bincount(place, row * sign, _MOST_DIM) for row in x])
    out = np.zeros((len(x), PASSES), dtype=np.int64)
    for p in range(PASSES):
        y = (x @ directions[p]).reshape(len(x), HASHES, _DIRECTIONS)
        best = np.abs(y).argmax(axis=2)
        sign = np.take_along_axis(y, best[:, :, None], axis=2)[:, :, 0] > 0
        for h in range(HASHES):
            out[:, p] = (out[:, p] << _BITS) | (best[:, h] * 2 + sign[:, h])
    return out


def _sign(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """node, dim and the keys of all passes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            vectors = part.column(1).to_pylist()
            size = np.array([len(v) for v in vectors])
            keys = np.zeros((len(size), PASSES), dtype=np.int64)
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                keys[own] = hashes(unit([vectors[k] for k in own], kind))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "dim", "keys"])


class _Found:
    """Links of a block: how many each node has, and which nodes they join."""

    def __init__(self, table: pa.Table, window: int):
        self.k = table.column("pass")[0].as_py()
        self.window = window
        self.node = table.column("node").to_numpy()
        self.copies = table.column("copies").to_numpy()
        self.ranks, self.runs = (table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, PASSES) for c in ("ranks", "runs"))
        self.n = np.zeros(len(self.node), dtype=np.int64)
        self.above = np.arange(len(self.node))

    def _top(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = self.above[self.above[x]]
            x = self.above[x]
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Linked pairs of this pass; those that an earlier pass compared have been counted there."""
        for q in range(self.k):
            known = np.abs(self.ranks[i, q] - self.ranks[j, q]) <= self.window
            known |= (self.runs[i, q] >= 0) & (self.runs[i, q] == self.runs[j, q])
            i, j = i[~known], j[~known]
        np.add.at(self.n, i, self.copies[j])
        np.add.at(self.n, j, self.copies[i])
        # Pairs that are joined by now drop out, so the loop runs once for each link of the forest.
        while len(i):
            a, b = int(i[0]), int(j[0])
            x, y = self._top(a), self._top(b)
            if x != y:
                self.above[max(x, y)] = min(x, y)
            tops = self.above
            while True:
                higher = tops[tops]
                if (higher == tops).all():
                    break
                tops = higher
            self.above = tops
            left = tops[i] != tops[j]
            i, j = i[left], j[left]

    def table(self) -> pa.Table:
        has = np.flatnonzero(self.n)
        return pa.table({"node": self.node[has], "n": self.n[has], "root": self.node[[self._top(int(x)) for x in has]] if len(has) else np.zeros(0, np.int64)})


def _segments(vectors: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of one length."""
    size = np.array([len(v) for v in vectors])
    cuts = np.concatenate([[0], np.flatnonzero(size[1:] != size[:-1]) + 1, [len(size)]])
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())


def _window(table: pa.Table, kind: str, window: int) -> pa.Table:
    """The links of a block's nodes with those of the window after each; nodes with halo belong to the next block."""
    table = table.sort_by("rank")
    found = _Found(table, window)
    home = ~table.column("halo").to_numpy()
    vectors = table.column("vec").to_pylist()
    for a, b in _segments(vectors):
        x = unit(vectors[a:b], kind)
        for at in range(0, b - a, window):
            near = x[at : at + window] @ x[at : at + 2 * window].T
            i, j = np.nonzero(near >= THRESHOLD)
            good = (j > i) & (j - i <= window) & home[a + at + i]
            if good.any():
                found.add(a + at + i[good], a + at + j[good])
    return found.table()


def _tile(table: pa.Table, kind: str, window: int) -> pa.Table:
    """The links of two parts of a run that are farther apart than a window."""
    table = table.sort_by("rank")
    found = _Found(table, window)
    rank, side = table.column("rank").to_numpy(), table.column("side").to_numpy()
    x = unit(table.column("vec").to_pylist(), kind)
    one = table.column("one")[0].as_py()
    home = np.flatnonzero(side == one)
    visit = home if table.column("two")[0].as_py() == one else np.flatnonzero(side != one)
    for at in range(0, len(home), 256):
        own = home[at : at + 256]
        i, j = np.nonzero(x[own] @ x[visit].T >= THRESHOLD)
        i, j = own[i], visit[j]
        good = rank[j] - rank[i] > window
        found.add(i[good], j[good])
    return found.table()


def _ranked(keys: DataFrame, n_nodes: int, window: int) -> DataFrame:
    """node, pass, rank (place in the pass' order) and run (rank of the first node of a run longer than a window; else -1) of node, dim and keys."""
    spark = keys.sparkSession
    depth = min(HASHES, max(1, math.ceil(math.log(max(2, n_nodes / window)) / math.log(2 * _DIRECTIONS))))
    order = ["pass", "dim", "key", "node"]
    rows = keys.select("node", "dim", F.posexplode("keys").alias("pass", "key"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_nodes * PASSES // 1_000_000)
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = materialise(rows.withColumn("part", F.spark_partition_id()).withColumn("place", place), "sorted")
    sizes = rows.groupBy("pass", "part").agg(F.count("*").alias("c"), F.min("place").alias("low")).orderBy("pass", "part").collect()  # PASSES + parts rows at most
    offsets, before = [], {}
    for r in sizes:
        offsets.append((r["pass"], r["part"], before.get(r["pass"], 0) - r["low"]))
        before[r["pass"]] = before.get(r["pass"], 0) + r["c"]
    moved = F.broadcast(spark.createDataFrame(offsets or [(0, 0, 0)], "pass int, part int, move long"))
    cell = F.concat_ws("/", "pass", "dim", F.shiftright("key", _BITS * (HASHES - depth)))
    ranked = materialise(rows.join(moved, ["pass", "part"]).select("node", "pass", (F.col("place") + F.col("move")).alias("rank"), cell.alias("cell")), "ranked")
    long_runs = ranked.groupBy("cell").agg(F.count("*").alias("c"), F.min("rank").alias("run")).filter(F.col("c") > window + 1)
    out = hot_join(ranked, materialise(long_runs, "runs"), "cell", "c", "left")
    return out.select("node", "pass", "rank", F.coalesce("run", F.lit(-1)).alias("run"), F.coalesce("c", F.lit(0)).alias("c"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", window: int = WINDOW, block_rows: int = BLOCK_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors. block_rows is not under window.

    A vector that is null, empty, zero, or holds a null or a number that is not finite links with nothing, and so do vectors of
    different lengths with each other; such a row's class is itself. Each row is a vector of its own, also if its id repeats:
    equal vectors link. component_id is the smallest id of the class, null only where all ids of the class are; kept is
    vec_id = component_id, two nulls being equal. Very long vectors are compared whole. Other columns are not read. An
    empty table gives no rows.
    """
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    kind = "<f4" if single else "<f8"
    column = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), column.alias("v"))
    rows = materialise(source.mapInArrow(lambda b: _read(b, kind), "vec_id long, digest binary, vec binary"), "vectors")
    sets = rows.filter("vec is not null").groupBy("digest").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n_nodes = sets.count()

    keys = sets.select("node", "vec").mapInArrow(lambda b: _sign(b, kind), "node long, dim long, keys array<long>")
    ranked = materialise(_ranked(keys, n_nodes, window), "ranks")
    per = F.array_sort(F.collect_list(F.struct("pass", "rank", "run", "c")))
    places = ranked.groupBy("node").agg(per.alias("at"))  # PASSES entries each
    placed = sets.select("node", "copies", "vec").join(places, "node")
    placed = materialise(placed.select("node", "copies", "vec", "at", F.col("at.rank").alias("ranks"), F.col("at.run").alias("runs")), "placed")
    every = placed.select("node", "copies", "vec", "ranks", "runs", F.explode("at").alias("p"))

    block = F.expr(f"p.rank div {block_rows}")
    both = F.when((F.col("p.rank") % block_rows < window) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    blocks = every.select("node", "copies", "vec", "ranks", "runs", F.col("p.pass").alias("pass"), F.col("p.rank").alias("rank"), block.alias("own"), F.explode(both).alias("block"))
    blocks = blocks.withColumn("halo", F.col("own") != F.col("block")).drop("own")
    out = "node long, n long, root long"
    near = blocks.groupBy("pass", "block").applyInArrow(lambda t: _window(t, kind, window), out)

    part = F.expr(f"(p.rank - p.run) div {tile_rows}")
    last = F.expr(f"(p.c - 1) div {tile_rows}")
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda o: F.struct(F.least(o, part).alias("one"), F.greatest(o, part).alias("two")))
    tiled = every.filter("p.run >= 0").select("node", "copies", "vec", "ranks", "runs", F.col("p.pass").alias("pass"), F.col("p.rank").alias("rank"), F.col("p.run").alias("run"), part.alias("side"), F.explode(tiles).alias("t"))
    tiled = tiled.select("node", "copies", "vec", "ranks", "runs", "pass", "rank", "run", "side", "t.one", "t.two")
    near = near.unionByName(tiled.groupBy("pass", "run", "one", "two").applyInArrow(lambda t: _tile(t, kind, window), out))

    near = materialise(near, "links")
    pairs = near.filter("node != root").select(F.greatest("node", "root").alias("a"), F.least("node", "root").alias("b")).distinct()
    classes = components(materialise(pairs, "pairs"))
    counts = near.groupBy("node").agg(F.sum("n").alias("n"))
    named = sets.select("node", "digest", "copies", "least").join(counts, "node", "left").join(classes.select(F.col("id").alias("node"), "comp"), "node", "left")
    named = named.select("digest", "copies", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    named = materialise(named.filter("n_links > 0"), "named")
    least = materialise(named.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "least")
    named = materialise(hot_join(named, least, "comp", "members").select("digest", "copies", "n_links", "component_id"), "classes")
    joined = hot_join(rows.select("vec_id", "digest"), named, "digest", "copies", "left")
    own = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


#: All pairs, and the classes that they make.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS len FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.len * b.len) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM v LEFT JOIN degree ON degree.a = vec_id LEFT JOIN least ON least.a = vec_id"""
