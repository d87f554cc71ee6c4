"""A lexical index in immutable segments, whose postings lie in blocks by impact.

A segment deals its chunks into buckets. In a bucket, the postings of a term are ordered by what they can contribute to a score and cut
into blocks; a block is a row with its greatest term frequency and least length, which bound all its contributions whatever the index' mean
length has become. Tiers of blocks are folders: the first block of each term, and then ever larger groups of further ones.

A search takes a lower bound of each query's k-th score from the first blocks alone, and then reads just the blocks that can still lead to
it: a block matters if its bound and the greatest contributions of the query's other terms reach that score (MaxScore). All other blocks hold
no chunk of the result, so results are exact. Buckets are those of the stored table, so postings are not shuffled.

New chunks make a new segment; deleted ones are listed beside their segment, with what they take off document frequencies. Counts are
summed over segments, so scores are those of an index made anew. compact() joins all segments to one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternflow.functions import text as T
from lanternflow.operators.ranking import Best
from lanternflow.sources.scratch import materialise, scratch_path

#: Postings of a block, and chunks of a bucket: a task holds one bucket, so its memory does not grow with the table.
BLOCK_POSTINGS, BUCKET_DOCS = 256, 2_000
_LEAST_BUCKETS = 8
#: Posting and query pairs that are scored at once.
_PAIRS = 2_000_000
#: Scores are rounded to six digits.
_MARGIN = 2e-6
#: Pairs of queries and chunks, or of queries and terms, that go to all tasks at once: some MB.
PAIR_BLOCK = 200_000
SCORES = "query_id long, chunk_id long, bm25 double"
_POSTS = "bucket int, chunk_id bigint, term string, tf bigint, doc_len bigint"
_BLOCKS = "bucket int, term string, block bigint, max_tf bigint, min_len bigint, postings array<struct<chunk_id:bigint,tf:bigint,doc_len:bigint>>, tier int"


def postings(rows: DataFrame) -> DataFrame:
    """chunk_id, term, tf, doc_len."""
    tokens = rows.select("chunk_id", T.tokenize(F.col("text")).alias("tokens"))
    every = tokens.select("chunk_id", F.size("tokens").cast("long").alias("doc_len"), F.explode("tokens").alias("term"))
    return every.groupBy("chunk_id", "term", "doc_len").agg(F.count("*").alias("tf")).select("chunk_id", "term", "tf", "doc_len")


def term_stats(posts: DataFrame, n_docs: int) -> DataFrame:
    """term, df, idf."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", T.idf(F.lit(n_docs), F.col("df")))


@dataclass
class Segment:
    """Where a segment lies and what it counts. dead: folders of deleted chunks; dead_docs and dead_len are sums over them."""

    path: str
    buckets: int
    n_docs: int
    total_len: int
    avg_len: float
    dead: list[str] = field(default_factory=list)
    dead_docs: int = 0
    dead_len: int = 0


class Index:
    """A lexical index below a path. It can be opened again from its path, grow, shrink and be compacted; each change writes a new manifest."""

    def __init__(self, rows: DataFrame | None, path: str | None = None, spark: SparkSession | None = None, block_postings: int = BLOCK_POSTINGS):
        """rows: chunk_id and text; none opens what is below path. path: a new folder in the scratch folder if not given."""
        self.spark = spark or rows.sparkSession
        self.path = path or scratch_path(self.spark, "lexical")
        self.block_postings = block_postings
        self.segments: list[Segment] = []
        self.read_blocks: dict[str, int] = {}
        self._tables: dict[str, str] = {}
        if rows is None:
            last = self.spark.read.schema("version long, manifest string").parquet(f"{self.path}/manifest").orderBy(F.desc("version")).first()
            self.version = last["version"]
            self.segments = [Segment(**s) for s in json.loads(last["manifest"])]
        else:
            self.version = -1
            self.add(rows)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(None, path, spark)

    def _commit(self) -> None:
        self.version += 1
        text = json.dumps([s.__dict__ for s in self.segments])
        self.spark.range(1).coalesce(1).select(F.lit(self.version).cast("long").alias("version"), F.lit(text).alias("manifest")).write.mode("append").parquet(f"{self.path}/manifest")

    # Counts

    @property
    def n_docs(self) -> int:
        return sum(s.n_docs - s.dead_docs for s in self.segments)

    @property
    def avg_len(self) -> float:
        total = sum(s.total_len - s.dead_len for s in self.segments)
        return total / self.n_docs if total else 1.0

    @property
    def postings(self) -> DataFrame:
        """chunk_id, term, tf and doc_len of all chunks that are not deleted."""
        out = self.spark.createDataFrame([], "chunk_id long, term string, tf long, doc_len long")
        for s in self.segments:
            out = out.unionByName(self._live(s).select("chunk_id", "term", "tf", "doc_len"))
        return out

    def terms(self, wanted: DataFrame) -> DataFrame:
        """term, df and idf of the wanted terms (term)."""
        counts = self.spark.createDataFrame([], "term string, df long")
        for s in self.segments:
            counts = counts.unionByName(self.spark.read.schema("term string, df long").parquet(f"{s.path}/terms"))
            for d in s.dead:
                counts = counts.unionByName(self.spark.read.schema("term string, df long").parquet(f"{d}/terms"))
        df = counts.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return df.withColumn("idf", T.idf(F.lit(self.n_docs), F.col("df")))

    # Storage

    def _posts(self, s: Segment) -> DataFrame:
        return self.spark.read.schema(_POSTS).parquet(f"{s.path}/posts")

    def _live(self, s: Segment) -> DataFrame:
        """The postings of a segment's chunks that are not deleted."""
        rows = self._posts(s)
        return rows.join(self._dead(s).select("chunk_id"), "chunk_id", "left_anti") if s.dead else rows

    def _docs(self, s: Segment) -> DataFrame:
        return self.spark.read.schema("bucket int, chunk_id long, doc_len long").parquet(f"{s.path}/docs")

    def _dead(self, s: Segment) -> DataFrame:
        return self.spark.read.schema("bucket int, chunk_id long, doc_len long").parquet(*(f"{d}/docs" for d in s.dead))

    def _blocks(self, s: Segment) -> DataFrame:
        """The blocks of a segment, as a table whose buckets Spark knows."""
        if s.path not in self._tables:
            name = f"blocks_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({_BLOCKS}) USING parquet PARTITIONED BY (tier) CLUSTERED BY (bucket) SORTED BY (term) INTO {s.buckets} BUCKETS LOCATION '{s.path}/blocks'")
            self.spark.sql(f"MSCK REPAIR TABLE {name}") if self.spark.conf.get("spark.sql.catalogImplementation") == "hive" else self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
            self._tables[s.path] = name
        return self.spark.table(self._tables[s.path])

    def _write(self, docs: DataFrame, posts: DataFrame, path: str, buckets: int) -> None:
        """The blocks of a segment and its counts. docs and posts are written."""
        counts = docs.agg(F.count("*").alias("n"), F.sum("doc_len").alias("t")).first()
        n_docs, total = counts["n"], counts["t"] or 0
        avg = total / n_docs if total else 1.0
        impact = T.saturated_tf(F.col("tf").cast("double"), F.col("doc_len").cast("double"), F.lit(float(avg)))
        order = Window.partitionBy("bucket", "term").orderBy(impact.desc(), "chunk_id")
        rows = posts.repartition(buckets, "bucket").withColumn("block", ((F.row_number().over(order) - 1) / self.block_postings).cast("long"))
        blocks = rows.groupBy("bucket", "term", "block").agg(F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"), F.collect_list(F.struct("chunk_id", "tf", "doc_len")).alias("postings"))
        # The first block, then 3, 12, 48 and so on.
        tier = F.when(F.col("block") == 0, 0).otherwise(F.floor(F.log(4.0, F.col("block").cast("double"))) + 1).cast("int")
        name = f"blocks_{uuid.uuid4().hex}"
        blocks.withColumn("tier", tier).write.partitionBy("tier").bucketBy(buckets, "bucket").sortBy("term").option("path", f"{path}/blocks").saveAsTable(name)
        self._tables[path] = name
        posts.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/terms")
        self.segments.append(Segment(path, buckets, n_docs, int(total), float(avg)))

    def add(self, rows: DataFrame) -> None:
        """A new segment of chunks (chunk_id, text). A chunk that is there already has to be deleted first."""
        rows = rows.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text")
        path = f"{self.path}/segment-{uuid.uuid4().hex}"
        buckets = max(_LEAST_BUCKETS, -(-rows.count() // BUCKET_DOCS))
        bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")
        tokens = rows.withColumn("bucket", bucket).repartition(buckets, "bucket").select("bucket", "chunk_id", T.tokenize(F.col("text")).alias("tokens"))
        tokens.select("bucket", "chunk_id", F.size("tokens").cast("long").alias("doc_len"), "tokens").write.parquet(f"{path}/docs")
        held = self.spark.read.parquet(f"{path}/docs")
        # A bucket's tokens are counted in its own task, and its postings are one file.
        every = held.repartition(buckets, "bucket").select("bucket", "chunk_id", "doc_len", F.explode("tokens").alias("term"))
        every.groupBy("bucket", "chunk_id", "term", "doc_len").agg(F.count("*").alias("tf")).select("bucket", "chunk_id", "term", "tf", "doc_len").write.parquet(f"{path}/posts")
        self._write(held, self.spark.read.schema(_POSTS).parquet(f"{path}/posts"), path, buckets)
        self._commit()

    def delete(self, gone: DataFrame) -> None:
        """Chunks (chunk_id) that no search finds any more. Unknown ones change nothing."""
        gone = materialise(gone.select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct(), "gone")
        for s in self.segments:
            docs = self._docs(s).join(gone, "chunk_id", "left_semi")
            if s.dead:
                docs = docs.join(self._dead(s).select("chunk_id"), "chunk_id", "left_anti")
            path = f"{s.path}/dead-{uuid.uuid4().hex}"
            docs.select("bucket", "chunk_id", "doc_len").write.parquet(f"{path}/docs")
            found = self.spark.read.parquet(f"{path}/docs")
            count = found.agg(F.count("*").alias("n"), F.sum("doc_len").alias("t")).first()
            if count["n"]:
                lost = self._posts(s).join(found.select("chunk_id"), "chunk_id", "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
                lost.write.parquet(f"{path}/terms")
                s.dead.append(path)
                s.dead_docs += count["n"]
                s.dead_len += int(count["t"] or 0)
        self._commit()

    def replace(self, rows: DataFrame) -> None:
        """Chunks (chunk_id, text) anew, whether they were there or not."""
        self.delete(rows.select("chunk_id"))
        self.add(rows)

    def compact(self) -> None:
        """One segment of all chunks that are not deleted, from the stored postings."""
        docs, posts = None, None
        for s in self.segments:
            own_docs, own_posts = self._docs(s), self._posts(s)
            if s.dead:
                dead = self._dead(s).select("chunk_id")
                own_docs, own_posts = own_docs.join(dead, "chunk_id", "left_anti"), own_posts.join(dead, "chunk_id", "left_anti")
            docs = own_docs if docs is None else docs.unionByName(own_docs)
            posts = own_posts if posts is None else posts.unionByName(own_posts)
        path = f"{self.path}/segment-{uuid.uuid4().hex}"
        buckets = max(_LEAST_BUCKETS, -(-self.n_docs // BUCKET_DOCS))
        bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")
        for df, name in ((docs, "docs"), (posts, "posts")):
            df.withColumn("bucket", bucket).repartition(buckets, "bucket").write.parquet(f"{path}/{name}")
        self.segments = []
        self._write(self.spark.read.schema("bucket int, chunk_id long, doc_len long").parquet(f"{path}/docs"), self.spark.read.schema(_POSTS).parquet(f"{path}/posts"), path, buckets)
        self._commit()

    # Search

    def _bound(self) -> Column:
        """What a posting of a block adds to a score for an idf of 1, at most."""
        return T.saturated_tf(F.col("max_tf").cast("double"), F.col("min_len").cast("double"), F.lit(float(self.avg_len)))

    def weights(self, asked: DataFrame) -> DataFrame:
        """query_id, term and idf of asked (query_id, term), written."""
        return materialise(asked.join(self.terms(asked), "term").select("query_id", "term", "idf"), "weights")

    def scores(self, weights: DataFrame, pairs: DataFrame) -> DataFrame:
        """query_id, chunk_id and bm25 of the pairs (query_id, chunk_id) that share a term of weights (query_id, term, idf); both are written.

        Pairs are taken in blocks of about PAIR_BLOCK, and so are the terms of their queries: both go to all tasks, so postings are not shuffled.
        """
        n_blocks = max(1, -(-max(pairs.count(), weights.count()) // PAIR_BLOCK))
        out = self.spark.createDataFrame([], SCORES)
        part = T.saturated_tf(F.col("tf").cast("double"), F.col("doc_len").cast("double"), F.lit(float(self.avg_len)))
        for b in range(n_blocks):
            own = lambda df: df.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)  # noqa: B023,E731
            used = self.postings.join(F.broadcast(own(weights).select("term").distinct()), "term", "left_semi")
            found = used.join(F.broadcast(own(pairs).select("query_id", "chunk_id")), "chunk_id").join(F.broadcast(own(weights)), ["query_id", "term"])
            out = out.unionByName(found.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("idf") * part), 6).alias("bm25")))
        return out

    def all_scores(self, weights: DataFrame) -> DataFrame:
        """query_id, chunk_id and bm25 of all pairs that share a term of weights (query_id, term, idf), which are written.

        Weights go to all tasks in blocks, and only postings of their terms are dealt out, by bucket: a task scores one bucket, and a frequent term
        lies in all of them.
        """
        n_blocks = max(1, -(-weights.count() // PAIR_BLOCK))
        out = self.spark.createDataFrame([], SCORES)
        part = T.saturated_tf(F.col("tf").cast("double"), F.col("doc_len").cast("double"), F.lit(float(self.avg_len)))
        for b in range(n_blocks):
            own = weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)
            for s in self.segments:
                used = self._live(s).join(F.broadcast(own.select("term").distinct()), "term", "left_semi").repartition(s.buckets, "bucket")
                found = used.join(F.broadcast(own), "term").groupBy("bucket", "query_id", "chunk_id").agg(F.round(F.sum(F.col("idf") * part), 6).alias("bm25"))
                out = out.unionByName(found.select("query_id", "chunk_id", "bm25"))
        return out

    def top_k(self, weights: DataFrame, k: int) -> DataFrame:
        """query_id, chunk_id and bm25 of at least the k best chunks of each query, from weights: those of a stated block of queries.

        A query's terms that together do not reach its k-th score are not essential: a chunk of the result has another term, too. Only essential
        terms find chunks; those that may still be in the result are then scored in full, in the task of their bucket: one more pass over the
        blocks, however many chunks are near.
        """
        rows = weights.groupBy("term", "idf").agg(F.collect_list("query_id").alias("q")).orderBy("term").collect()  # terms of a block of queries
        if not rows:
            return self.spark.createDataFrame([], SCORES)
        kernel = _Kernel([r["term"] for r in rows], np.array([r["idf"] for r in rows]), [r["q"] for r in rows], float(self.avg_len), k)
        known = weights.select("term", "idf").distinct()
        tops = None
        for s in self.segments:
            own = self._blocks(s).select("term", "block", "max_tf", "min_len").join(F.broadcast(known), "term")
            own = own.groupBy("term").agg(F.max(F.col("idf") * self._bound()).alias("most"), F.count("*").alias("n"), F.max("block").alias("last"))
            tops = own if tops is None else tops.unionByName(own)
        tops = tops.groupBy("term").agg(F.max("most").alias("most"), F.sum("n").alias("n"), F.max("last").alias("last")).collect()  # one row a term
        n_blocks = sum(r["n"] for r in tops)
        if not any(r["last"] for r in tops):  # first blocks alone
            self.read_blocks = {"blocks": n_blocks, "read": n_blocks}
            return self._scored(kernel, known.withColumn("least", F.lit(float("-inf"))), True)
        first = self._scored(kernel, known.withColumn("least", F.lit(float("-inf"))), True)
        w = Window.partitionBy("query_id").orderBy(F.desc("bm25"))
        kth = {r["query_id"]: r["bm25"] for r in first.withColumn("n", F.row_number().over(w)).filter(F.col("n") == k).collect()}  # one row a query
        most = {r["term"]: r["most"] for r in tops}
        kernel, least = (whole := kernel).pruned(np.array([most.get(t, 0.0) for t in kernel.terms]), kth)
        known = self.spark.createDataFrame([(r["term"], float(r["idf"]), float(x)) for r, x in zip(rows, least)], "term string, idf double, least double")
        known = known.filter(F.col("least") < float("inf"))
        self._count(known, n_blocks)
        found = self._scored(kernel, known, False)
        opened = kernel.slack > 0
        if not opened.any():
            return found
        found = materialise(found, "found")
        is_open = F.broadcast(self.spark.createDataFrame([(q,) for q in kernel.ids[opened].tolist()], "query_id long"))
        return found.join(is_open, "query_id", "left_anti").unionByName(self._completed(whole.of(opened), found.join(is_open, "query_id", "left_semi").select("query_id", "chunk_id")))

    def _completed(self, kernel: _Kernel, pairs: DataFrame) -> DataFrame:
        """The k best of the pairs (query_id, chunk_id) of each query in each bucket, with their scores. Pairs go to the bucket of their chunk."""
        terms = [(t, float(i), float("-inf")) for t, i, own in zip(kernel.terms, kernel.idf, kernel.askers) if len(own)]
        known = self.spark.createDataFrame(terms, "term string, idf double, least double")
        out = None
        for s in self.segments:
            own = pairs.join(self._dead(s).select("chunk_id"), "chunk_id", "left_anti") if s.dead else pairs
            own = own.withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(s.buckets)).cast("int")).groupBy("bucket")
            rows = self._needed(s, known).select("bucket", "term", "postings").groupBy("bucket")
            one = rows.cogroup(own).applyInArrow(lambda live, near: kernel.these(live, near), SCORES)
            out = one if out is None else out.unionByName(one)
        return out

    def _needed(self, s: Segment, known: DataFrame, tiers: list[int] | None = None) -> DataFrame:
        blocks = self._blocks(s)
        if tiers is not None:
            blocks = blocks.filter(F.col("tier").isin(tiers))
        return blocks.join(F.broadcast(known), "term").filter(F.col("idf") * self._bound() >= F.col("least"))

    def _count(self, known: DataFrame, n: int) -> None:
        """How many blocks the terms of a search have, and how many it reads; the tiers that hold them."""
        self._tiers: dict[str, list[int]] = {}
        read = 0
        for s in self.segments:
            per = self._needed(s, known).groupBy("tier").agg(F.count("*").alias("n")).collect()
            self._tiers[s.path] = sorted(r["tier"] for r in per)
            read += sum(r["n"] for r in per)
        self.read_blocks = {"blocks": n, "read": read}

    def _scored(self, kernel: _Kernel, known: DataFrame, first: bool) -> DataFrame:
        out = self.spark.createDataFrame([], SCORES)
        for s in self.segments:
            rows = self._needed(s, known, [0] if first else self._tiers[s.path]).select("bucket", "term", "postings").groupBy("bucket")
            if s.dead:
                dead = self._dead(s).select("bucket", "chunk_id").groupBy("bucket")
                out = out.unionByName(rows.cogroup(dead).applyInArrow(lambda live, gone: kernel.without(live, gone), SCORES))
            else:
                out = out.unionByName(rows.applyInArrow(lambda live: kernel.all(live), SCORES))
        return out


class _Kernel:
    """Scores the blocks of a bucket against a block of queries, and keeps the k best chunks of each query."""

    def __init__(self, terms: list[str], idf: np.ndarray, askers: list[list[int]], avg_len: float, k: int):
        self.terms, self.idf, self.avg_len, self.k = terms, idf, avg_len, k
        self.ids = np.array(sorted({q for a in askers for q in a}), dtype=np.int64)
        self.askers = [np.searchsorted(self.ids, np.array(sorted(a))) for a in askers]
        #: What terms that are passed over can add to a query's scores, and the score that is wanted then.
        self.slack, self.wanted = np.zeros(len(self.ids)), np.full(len(self.ids), -np.inf)

    def pruned(self, most: np.ndarray, kth: dict[int, float]) -> tuple[_Kernel, np.ndarray]:
        """A kernel that passes over terms that are not essential, and the least contribution of each term that matters to one of its queries.

        most: the greatest contribution of each term; kth: lower bounds of k-th scores. A contribution matters if with the most of the query's
        other terms it reaches the k-th score.
        """
        wanted = np.array([kth.get(int(q), -np.inf) for q in self.ids]) - _MARGIN
        whole = np.zeros(len(self.ids))
        for top, own in zip(most, self.askers):
            whole[own] += top
        slack = np.zeros(len(self.ids))
        essential: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(most)
        for t in np.argsort(most, kind="stable"):  # the least first: as many as do not reach the score together
            own = self.askers[t]
            over = slack[own] + most[t] < wanted[own]
            slack[own[over]] += most[t]
            essential[t] = own[~over]
        least = np.array([(wanted[own] - (whole[own] - top)).min() if len(own) else np.inf for top, own in zip(most, essential)])
        out = _Kernel(self.terms, self.idf, [[]] * len(most), self.avg_len, self.k)
        out.ids, out.askers, out.slack, out.wanted = self.ids, essential, slack, wanted
        return out, least

    def of(self, chosen: np.ndarray) -> _Kernel:
        """A kernel of some of the queries."""
        out = _Kernel(self.terms, self.idf, [[]] * len(self.terms), self.avg_len, self.k)
        out.ids, out.slack, out.wanted = self.ids[chosen], self.slack[chosen], self.wanted[chosen]
        place = np.cumsum(chosen) - 1
        out.askers = [place[own[chosen[own]]] for own in self.askers]
        return out

    def all(self, table: pa.Table) -> pa.Table:
        return self._best(table, None)

    def these(self, table: pa.Table, pairs: pa.Table) -> pa.Table:
        """The k best of pairs alone."""
        chunk, query = (pairs.column(c).to_numpy() for c in ("chunk_id", "query_id"))
        order = np.argsort(chunk)
        return self._best(table, None, (chunk[order], np.searchsorted(self.ids, query[order])))

    def without(self, table: pa.Table, dead: pa.Table) -> pa.Table:
        return self._best(table, dead.column("chunk_id").to_numpy())

    def _best(self, table: pa.Table, dead: np.ndarray | None, only: tuple[np.ndarray, np.ndarray] | None = None) -> pa.Table:
        best, rest = Best(self.k), []
        if table.num_rows:
            lists = table.column("postings").combine_chunks()
            term = np.repeat(pd.Index(self.terms).get_indexer(table.column("term").to_pandas()), pc.list_value_length(lists).to_numpy())
            flat = lists.flatten()
            chunk, tf, length = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("chunk_id", "tf", "doc_len"))
            if dead is not None and len(dead):
                live = ~np.isin(chunk, dead)
                term, chunk, tf, length = term[live], chunk[live], tf[live], length[live]
            order = np.argsort(chunk, kind="stable")
            term, chunk, tf, length = term[order], chunk[order], tf[order].astype(float), length[order].astype(float)
            weight = self.idf[term] * tf * (T.BM25_K1 + 1) / (tf + T.BM25_K1 * (1 - T.BM25_B + T.BM25_B * length / self.avg_len))
            self._score(term, chunk, weight, best, rest, only)
        columns = [np.concatenate(c) for c in zip(best.best(), *rest)]
        return pa.table(dict(zip(("query_id", "chunk_id", "bm25"), columns)))

    def _score(self, term: np.ndarray, chunk: np.ndarray, weight: np.ndarray, best: Best, rest: list, only: tuple[np.ndarray, np.ndarray] | None) -> None:
        """Postings in order of chunks, so many of them at once as make _PAIRS pairs with queries; a chunk's stay together.

        rest gets what may be in the result of a query some of whose terms are passed over. only: chunks, in order, and queries of the pairs that count.
        """
        width = np.array([len(a) for a in self.askers])
        flat = np.concatenate(self.askers)
        begin = np.cumsum(width) - width
        n = width[term]
        done = np.concatenate([[0], np.cumsum(n)])
        starts = np.concatenate([[0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(chunk)]])
        at = 0
        while at < len(starts) - 1:
            a = starts[at]
            to = max(at + 1, int(np.searchsorted(done[starts], done[a] + _PAIRS, side="right")) - 1)
            b = starts[min(to, len(starts) - 1)]
            own = slice(a, b)
            ids, place = np.unique(chunk[own], return_inverse=True)
            count = n[own]
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            pair = np.repeat(place, count) * len(self.ids) + flat[np.repeat(begin[term[own]], count) + nth]
            gain = np.repeat(weight[own], count)
            if only is not None:
                lies = slice(*np.searchsorted(only[0], [ids[0], ids[-1] + 1]))
                near, asker = only[0][lies], only[1][lies]
                at_place = np.searchsorted(ids, near)
                there = ids[at_place] == near
                wanted = np.zeros(len(ids) * len(self.ids), dtype=bool)
                wanted[at_place[there] * len(self.ids) + asker[there]] = True
                pair, gain = pair[wanted[pair]], gain[wanted[pair]]
            found, where = np.unique(pair, return_inverse=True)
            q, names, score = found % len(self.ids), ids[found // len(self.ids)], np.round(np.bincount(where, gain, len(found)).astype(float), 6)
            full = self.slack[q] == 0
            best.add(self.ids[q[full]], names[full], score[full])
            near = ~full & (score + self.slack[q] >= self.wanted[q])
            rest.append((self.ids[q[near]], names[near], score[near]))
            at = min(to, len(starts) - 1)
