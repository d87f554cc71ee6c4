"""Continuous forms: feedback state, page ingest, discovered urls and captures, and embedding of pending chunks.

State is kept in tables by the hash of its key (KeyedTable). A micro-batch is reduced first, and rewrites only the parts that hold its keys,
each in one step; so a batch that runs again after a failure changes nothing more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lanternflow.functions import text as T
from lanternflow.operators.chats import cache_of
from lanternflow.operators.ingest import discovered_upsert
from lanternflow.operators.parsing import pages_to_chunks
from lanternflow.operators.tables import KeyedTable, last_of
from lanternflow.sources.scratch import materialise

#: How long ratings are remembered and may come late, in seconds (or units of a numeric time).
LATE_BY = 7 * 86_400
_CACHE = ["question_hash", "question_norm", "good_count", "bad_count", "answer_text", "sources_json", "created_at", "updated_at", "last_used_at"]


class FeedbackState:
    """The answer cache as a stream of ratings makes it.

    Three kinds of rows share a part: base, entries as of all ratings that are older than late_by; log, the ratings since; and state,
    the entries as of both. A rating counts once, however often it comes, and at its place in time (ts, event_id), however late; those that come
    more than late_by after the newest rating that was seen before are passed over. The log is bounded by late_by, and a batch reads and
    writes only the parts of its questions.
    """

    def __init__(self, spark: SparkSession, path: str, late_by: int = LATE_BY, time_type: str = "timestamp", buckets: int = 64):
        self.spark, self.path, self.late_by, self.time_type = spark, path, late_by, time_type
        schema = f"kind string, question_hash string, event_id bigint, question_norm string, answer_text string, sources_json string, rating int, ts {time_type}, good_count bigint, bad_count bigint, created_at {time_type}, updated_at {time_type}, last_used_at {time_type}"
        self.table = KeyedTable(spark, f"{path}/feedback", schema, ["kind", "question_hash", "event_id"], buckets, ["question_hash"])

    def read(self) -> DataFrame:
        return self.table.read().filter("kind = 'state'").select(*_CACHE)

    def _clock(self, number: int, batch: DataFrame):
        """The newest time before this batch, as it was when the batch first ran; then the batch's own is noted."""
        path, kind = f"{self.path}/clock", "batch long, newest string"
        newest = batch.agg(F.max("ts").cast("string").alias("newest")).select(F.lit(number).cast("long").alias("batch"), "newest")
        newest.coalesce(1).write.mode("overwrite").parquet(f"{path}/n={number}")
        return self.spark.read.schema(kind).parquet(path).filter(F.col("batch") < number).agg(F.max(F.col("newest").cast(self.time_type)).cast("string")).first()[0]

    def fold(self, batch: DataFrame, number: int) -> list[int]:
        """Takes up a batch of ratings (question, answer, rating, ts, event_id, and sources_json if there are). Returns the parts that it wrote."""
        norm = T.normalize_question(F.col("question"))
        sources = F.col("sources_json") if "sources_json" in batch.columns else F.lit(None).cast("string")
        rows = batch.filter("rating in (1, -1)").select(T.hash_question(norm).alias("question_hash"), F.col("event_id").cast("long").alias("event_id"), norm.alias("question_norm"), F.col("answer").alias("answer_text"), sources.alias("sources_json"), F.col("rating").cast("int").alias("rating"), "ts")
        rows = materialise(last_of(rows, ["question_hash", "event_id"], ["ts"]), "ratings")
        newest = self._clock(number, rows)
        old = F.lit(False)
        if newest is not None:
            edge = F.lit(newest).cast(self.time_type) - (F.make_dt_interval(secs=F.lit(self.late_by)) if self.time_type.startswith("timestamp") else F.lit(self.late_by))
            old = F.col("ts") < edge
        late = rows.filter(~old)

        def make(held: DataFrame) -> DataFrame:
            logged = held.filter("kind = 'log'").select(*rows.columns)
            every = logged.unionByName(late.join(logged.select("question_hash", "event_id"), ["question_hash", "event_id"], "left_anti"))
            every = materialise(every.withColumn("old", old), "log")
            base = held.filter("kind = 'base'").select(*_CACHE)
            rated = lambda df: df.withColumnRenamed("answer_text", "answer")
            base = materialise(cache_of(rated(every.filter("old")), base), "base")
            state = cache_of(rated(every.filter("not old")), base)
            parts = [base.withColumn("kind", F.lit("base")), state.withColumn("kind", F.lit("state")), every.filter("not old").drop("old").withColumn("kind", F.lit("log"))]
            return parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)

        return self.table.change(rows, make)


def fold_feedback(events: DataFrame, path: str, late_by: int = LATE_BY) -> None:
    """Runs a stream of ratings over all that is available now; the cache is FeedbackState(...).read()."""
    state = FeedbackState(events.sparkSession, path, late_by, dict(events.dtypes)["ts"])
    _run(events.writeStream.foreachBatch(lambda batch, number: state.fold(batch, number)), path, "checkpoint-feedback")


def last_state(spark: SparkSession, path: str, time_type: str = "timestamp") -> DataFrame:
    """The cache that fold_feedback() has made below path, from ratings whose ts has this type."""
    return FeedbackState(spark, path, time_type=time_type).read()


def discovered_table(spark: SparkSession, path: str, time_type: str = "bigint") -> KeyedTable:
    return KeyedTable(spark, f"{path}/discovered", f"url string, kind string, discovered_at {time_type}", ["url"])


def keep_discovered(found: DataFrame, path: str) -> None:
    """Runs a stream of found urls (url, kind, discovered_at) into discovered_table(): new ones are added, a changed kind replaces the old one, the first time stays."""
    table = discovered_table(found.sparkSession, path, dict(found.dtypes)["discovered_at"])

    def fold(batch: DataFrame, number: int) -> None:
        batch = materialise(batch.filter("url is not null"), "found")
        # Only urls of the batch are merged; what else their parts hold stays.
        table.change(batch, lambda held: discovered_upsert(held, batch))

    _run(found.writeStream.foreachBatch(fold), path, "checkpoint-discovered")


def captures_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, f"{path}/captures", "url string, html string, content_hash string, last_scraped timestamp, last_changed timestamp", ["url"])


def keep_captures(captures: DataFrame, path: str) -> None:
    """Runs a stream of captures (url, html, captured_at) into captures_table(). The last capture of a url in a batch counts; one that is not newer than what is kept changes nothing."""
    table = captures_table(captures.sparkSession, path)

    def fold(batch: DataFrame, number: int) -> None:
        last = last_of(batch.filter("url is not null").select("url", "html", "captured_at"), ["url"], ["captured_at"])
        last = materialise(last.withColumn("hash", F.coalesce(T.content_hash(F.col("html")), F.lit(""))).withColumnRenamed("html", "new_html"), "captures")

        def make(held: DataFrame) -> DataFrame:
            joined = held.join(last, "url", "full")
            newer = F.col("captured_at").isNotNull() & (F.col("last_scraped").isNull() | (F.col("captured_at") > F.col("last_scraped")))
            change = newer & ~F.col("hash").eqNullSafe(F.col("content_hash"))
            pick = lambda when, new, old: F.when(when, F.col(new)).otherwise(F.col(old)).alias(old)
            return joined.select("url", pick(change, "new_html", "html"), pick(change, "hash", "content_hash"), pick(newer, "captured_at", "last_scraped"), pick(change, "captured_at", "last_changed"))

        table.change(last, make)

    _run(captures.writeStream.foreachBatch(fold), path, "checkpoint-captures")


def chunks_table(spark: SparkSession, path: str) -> KeyedTable:
    """Chunks with their vectors by page. A row with extract_index -1 says which capture of a page its chunks are from."""
    schema = "page_id bigint, extract_index int, chunk_index int, text string, embedding array<float>, content_hash string, captured_at timestamp"
    return KeyedTable(spark, f"{path}/chunks", schema, ["page_id", "extract_index", "chunk_index"], by=["page_id"])


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    """page_id, extract_index, chunk_index, text and embedding of the last capture of each page."""
    return chunks_table(spark, path).read().filter("extract_index >= 0").select("page_id", "extract_index", "chunk_index", "text", "embedding")


def ingest_pages(pages: DataFrame, path: str, rules: DataFrame, **options) -> None:
    """Runs a stream of captures (page_id, site_id, html, captured_at) to chunks and their vectors.

    A page that is captured again with other content replaces its chunks and vectors, however many it had; the same content is not parsed
    again, and a capture that is not newer than what is kept changes nothing.
    """
    table = chunks_table(pages.sparkSession, path)
    by_page = F.col("extract_index") < 0

    def fold(batch: DataFrame, number: int) -> None:
        last = last_of(batch.filter("page_id is not null").select("page_id", "site_id", "html", "captured_at"), ["page_id"], ["captured_at"])
        last = materialise(last.withColumn("content_hash", F.coalesce(T.content_hash(F.col("html")), F.lit(""))), "captures")

        def make(held: DataFrame) -> DataFrame:
            held = materialise(held, "held")
            kept = held.filter(by_page).select("page_id", F.col("content_hash").alias("old_hash"), F.col("captured_at").alias("old_at"))
            newer = last.join(kept, "page_id", "left").filter("old_at is null or captured_at > old_at")
            newer = materialise(newer.withColumn("fresh", ~F.col("content_hash").eqNullSafe(F.col("old_hash"))), "newer")
            fresh = newer.filter("fresh")
            chunks = materialise(pages_to_chunks(fresh, rules).withColumn("chunk_id", F.monotonically_increasing_id()), "chunks")
            chunks = chunks.join(embed(chunks, **options), "chunk_id").drop("chunk_id")
            marks = newer.select("page_id", F.lit(-1).alias("extract_index"), F.lit(-1).alias("chunk_index"), "content_hash", "captured_at")
            stay = held.join(fresh.select("page_id"), "page_id", "left_anti").filter(~by_page)
            old = held.filter(by_page).join(newer.select("page_id"), "page_id", "left_anti")
            return stay.unionByName(old).unionByName(marks, allowMissingColumns=True).unionByName(chunks, allowMissingColumns=True)

        table.change(last, make)

    _run(pages.writeStream.foreachBatch(fold), path, "checkpoint-pages")


def hashed_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a sentence encoder: tokens counted in buckets by their MD5, of length 1."""
    import hashlib
    import re

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for k, text in enumerate(texts):
            for term in re.findall(r"[a-z0-9]+", text.lower()):
                out[k, int(hashlib.md5(term.encode()).hexdigest()[:4], 16) % dim] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def embed(chunks: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_encoder, batch: int = 64) -> DataFrame:
    """chunk_id and embedding of chunks (chunk_id, text). The encoder is made once a worker and called on batches of texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                vectors = encode([t or "" for t in part["text"]])
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "embedding": list(vectors)})

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id long, embedding array<float>")


def embed_pending(chunks: DataFrame, embeddings: DataFrame, **options) -> DataFrame:
    """Embeddings of the chunks that have none."""
    return embed(chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti"), **options)


def run_to_table(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Runs a stream over all that is available now, and appends each micro-batch, with its number, to a Parquet table.

    A batch that is written again after a failure replaces itself: its folder is its number.
    """

    def write(df: DataFrame, number: int) -> None:
        (each(df) if each else df).write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    _run(stream.writeStream.outputMode(mode).foreachBatch(write), path)


def _run(writer: DataStreamWriter, path: str, checkpoint: str = "checkpoint") -> None:
    query = writer.option("checkpointLocation", f"{path}/{checkpoint}").trigger(availableNow=True).start()
    query.awaitTermination()
