"""Lexical, vector and hybrid retrieval for many queries at once.

A corpus has chunk_id, extract_id, url, text and embedding; queries have query_id and text, query vectors
query_id and vector (several for a query with variants).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternflow.functions import text as T
from lanternflow.operators.lexical import Index, postings, term_stats
from lanternflow.operators.ranking import top_k
from lanternflow.operators.vectors import VectorIndex
from lanternflow.sources.scratch import materialise

__all__ = ["Index", "VectorIndex", "postings", "term_stats", "top_k"]

#: Queries (or their vectors) of one pass over the corpus; more of them take more passes.
QUERY_BLOCK = 4096


def corpus(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks that have an embedding: the retrieval corpus has a row for each embedding."""
    return chunks.join(embeddings, "chunk_id")


def corpus_stats(rows: DataFrame) -> DataFrame:
    """One row: n_docs and avg_len (1 where it would be 0)."""
    avg = F.avg(F.size(T.tokenize(F.col("text"))))
    return rows.agg(F.count("*").alias("n_docs"), F.when(avg > 0, avg).otherwise(F.lit(1.0)).alias("avg_len"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: distinct tokens of a query and of its variants."""
    variants = T.query_variants(F.col("text"))
    tokens = F.flatten(F.transform(F.array_union(F.array("text"), variants), T.tokenize))
    return queries.select("query_id", F.explode(F.array_distinct(tokens)).alias("term"))


def bm25(rows: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id and bm25 of all chunks that share a term with the query. For the best of them take bm25_top_k()."""
    index = rows if isinstance(rows, Index) else Index(rows)
    return index.all_scores(index.weights(query_terms(queries)))


def bm25_of(index: Index, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, chunk_id and bm25 of the written pairs (query_id, chunk_id) that share a term."""
    return index.scores(index.weights(query_terms(queries)), pairs)


def bm25_top_k(index: Index, queries: DataFrame, k: int, block: int = QUERY_BLOCK, weights: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, bm25 and rank: the k best chunks of each query among those that share a term with it.

    Queries are a stated set, taken in blocks of about `block`; their terms and weights go to all tasks. A task holds a
    bucket of chunks, and keeps k of them a query; blocks of postings that cannot lead to the k-th score are not read. weights: index.weights()
    of the queries' terms, made here if not given.
    """
    out = queries.sparkSession.createDataFrame([], "query_id long, chunk_id long, bm25 double")
    n_blocks = max(1, -(-queries.count() // block)) if k > 0 else 0
    if n_blocks and weights is None:
        weights = index.weights(query_terms(queries))
    for b in range(n_blocks):
        out = out.union(index.top_k(weights if n_blocks == 1 else weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b), k))
    return top_k(out, "bm25", k)


def vector_top_k(rows: DataFrame | VectorIndex, query_vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, chunk_id, vector_score and rank: the k nearest chunks of each query by dot product.

    A query's score is the best of its vectors. rows without an index are indexed here. Chunks without a vector are passed over.
    """
    index = rows if isinstance(rows, VectorIndex) else VectorIndex(rows)
    return top_k(index.search(query_vectors, k, block), "vector_score", k)


def with_text(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """Ranked chunks with extract_id, url and text."""
    return ranked.join(rows.select("chunk_id", "extract_id", "url", "text"), "chunk_id")


def zero_filled(scores: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best bm25 scores of each query, and zero rows for the k smallest chunk ids that are not among them, so that a query with few matches still has k candidates."""
    least = [r["chunk_id"] for r in rows.select("chunk_id").orderBy("chunk_id").limit(2 * k).collect()]
    if not least:
        return scores
    fill = queries.select("query_id", F.explode(F.array(*(F.lit(x).cast("long") for x in least))).alias("chunk_id"))
    fill = fill.join(scores, ["query_id", "chunk_id"], "left_anti").withColumn("bm25", F.lit(0.0))
    return scores.unionByName(fill)


def candidates(rows: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int, index: Index | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """query_id, chunk_id, vector_score, bm25, from_vector, from_bm25 of the union of both candidate sets.

    Both scores of a candidate are its own, whichever side found it. index, vectors: of the rows; built here if not given.
    """
    index = index or Index(rows)
    near = vector_top_k(vectors or rows, query_vectors, max(k, T.VECTOR_CANDIDATES)).select("query_id", "chunk_id", F.lit(True).alias("v"))
    wide = max(k, T.BM25_CANDIDATES)
    weights = index.weights(query_terms(queries))
    found = materialise(bm25_top_k(index, queries, wide, weights=weights).drop("rank"), "found")  # read twice
    words = top_k(zero_filled(found, rows, queries, wide), "bm25", wide).select("query_id", "chunk_id", F.lit(True).alias("w"))
    both = materialise(near.join(words, ["query_id", "chunk_id"], "full"), "candidates")
    both = both.join(index.scores(weights, both), ["query_id", "chunk_id"], "left")
    exact = both.join(rows.select("chunk_id", "embedding"), "chunk_id").join(query_vectors, "query_id")
    score = F.round(F.max(T.dot(F.col("embedding"), F.col("vector"))), 6)
    return exact.groupBy("query_id", "chunk_id").agg(
        score.alias("vector_score"),
        F.coalesce(F.first("bm25"), F.lit(0.0)).alias("bm25"),
        F.coalesce(F.first("v"), F.lit(False)).alias("from_vector"),
        F.coalesce(F.first("w"), F.lit(False)).alias("from_bm25"),
    )


def fuse(found: DataFrame) -> DataFrame:
    """Normalised scores of candidates and their weighted sum, rounded so that copies tie."""
    w = Window.partitionBy("query_id")
    norm = lambda c: T.min_max(F.col(c), F.min(c).over(w), F.max(c).over(w))
    out = found.withColumn("vector_norm", norm("vector_score")).withColumn("bm25_norm", norm("bm25"))
    score = F.round(T.FUSION_ALPHA * F.col("vector_norm") + (1 - T.FUSION_ALPHA) * F.col("bm25_norm"), 6)
    return out.select("*", score.alias("score")).withColumn("vector_norm", F.round("vector_norm", 6)).withColumn("bm25_norm", F.round("bm25_norm", 6))


def hybrid_search(rows: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 10, index: Index | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """The k best chunks of each query with the full explanation of their scores. An empty corpus gives no rows."""
    if k < 0:
        raise ValueError("k must not be negative")
    best = top_k(fuse(candidates(rows, queries, query_vectors, k, index, vectors)), "score", k)
    details = rows.select("chunk_id", "extract_id", "url", T.preview(F.col("text")).alias("chunk_preview"))
    return best.join(details, "chunk_id").select("query_id", "rank", "score", "chunk_id", "extract_id", "url", "from_vector", "from_bm25", "vector_score", "bm25", "vector_norm", "bm25_norm", "chunk_preview")


def parent_extracts(scored: DataFrame, extracts: DataFrame, most: int | None = None, max_chars: int | None = None) -> DataFrame:
    """The extracts of ranked chunks, each once with its best chunk, in rank order. A cap of 0 still leaves one.

    max_chars: what follows so many characters of a text is cut off.
    """
    own = Window.partitionBy("query_id", "extract_id").orderBy("rank")
    first = scored.withColumn("n", F.row_number().over(own)).filter("n = 1")
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    first = first.withColumn("position", position)
    if most is not None:
        first = first.filter(F.col("position") <= max(most, 1))
    text = extracts.select("extract_id", T.strip(F.coalesce("text", F.lit(""))).alias("text"))
    if max_chars is not None:
        text = text.withColumn("text", F.substring("text", 1, max_chars))
    return first.select("query_id", "position", "score", "chunk_id", "extract_id").join(text, "extract_id")


def build_context(parents: DataFrame, glossary: list[str] | None = None) -> DataFrame:
    """query_id and context: glossary blocks, then a block for each extract, in order."""
    block = F.concat(F.format_string("[extract_id=%d score=%s]\n", "extract_id", T.fixed(F.col("score"))), F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", block.alias("block")))), lambda x: x["block"])
    notes = F.array(*(F.lit("[glossary]\n" + g) for g in glossary or [])) if glossary else F.array().cast("array<string>")
    return parents.groupBy("query_id").agg(F.array_join(F.concat(notes, ordered), "\n\n---\n\n").alias("context"))


def source_links(ranked: DataFrame, most: int | None = 3) -> DataFrame:
    """One link for each extract of ranked chunks, with the score detail of its best chunk."""
    own = Window.partitionBy("query_id", "extract_id").orderBy("rank")
    first = ranked.withColumn("n", F.row_number().over(own)).filter("n = 1").drop("n", "chunk_preview")
    out = first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")).drop("rank")
    return out if most is None else out.filter(F.col("position") <= max(most, 1))


def rag_prompts(queries: DataFrame, contexts: DataFrame, system: str) -> DataFrame:
    """Prompt rows; a query without context is flagged, not dropped."""
    joined = queries.join(contexts, "query_id", "left")
    context = F.coalesce("context", F.lit(""))
    return joined.select("query_id", F.lit(system).alias("system"), F.concat(F.lit("Question: "), "text", F.lit("\n\nContext:\n"), context).alias("prompt"), (context != "").alias("has_context"))
