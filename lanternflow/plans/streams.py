"""Registered queries that run as streams over the given tables, or fill tables from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.functions import text as T
from lanternflow.operators import tables as B
from lanternflow.plans import app, content
from lanternflow.sources import schemas as S
from lanternflow.sources.scratch import materialise, scratch_path
from lanternflow.streaming import streams as W


def _feed(parts: list[DataFrame], name: str, run: Callable[[DataFrame, str], None]) -> str:
    """Writes parts of a table one after the other, and after each lets the stream take up what is new, from its checkpoint; the path of what comes of it."""
    spark = parts[0].sparkSession
    path = scratch_path(spark, name)
    for part in parts:
        part.write.mode("append").parquet(f"{path}/source")
        run(spark.readStream.schema(part.schema).parquet(f"{path}/source"), path)
    return path


def feedback_cache_stream(spark, d):
    """The same rows as feedback_cache, from the events in four parts of their time; every seventh comes a part late, every fifth again in the next part."""
    events = app._feedback(spark, d)
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    span = (hi - lo).total_seconds() + 1
    part = F.least(F.lit(3), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(str(lo)).cast("timestamp"))) / F.lit(span * 250_000)))
    placed = events.withColumn("part", part)
    first = placed.withColumn("part", F.col("part") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    again = placed.filter("event_id % 5 = 0").withColumn("part", F.col("part") + 1)
    every = first.unionByName(again)
    parts = [every.filter(F.col("part") == k).drop("part") for k in range(5)]
    path = _feed(parts, "feedback", lambda stream, path: W.fold_feedback(stream, path, int(span * 0.6)))
    return W.last_state(spark, path, dict(events.dtypes)["ts"]).select("question_hash", "question_norm", "good_count", "bad_count", "answer_text")


def _captured(pages: DataFrame, at: str) -> DataFrame:
    return pages.withColumn("captured_at", F.lit(at).cast("timestamp"))


def ingest_stream(spark, d):
    """Pages to chunks to vectors: half of them, the other half, and then every seventh again, cut to its heading; old captures that come last change nothing."""
    pages = content._site_pages(spark, d).select("page_id", "site_id", "html")
    short = pages.filter("page_id % 7 = 0").withColumn("html", F.regexp_replace("html", r"(?s)</h1>.*?</article>", "</h1></article>"))
    rules = materialise(content._rules(spark, d), "rules")
    parts = [_captured(pages.filter("page_id % 2 = 0"), "2024-01-01"), _captured(pages.filter("page_id % 2 = 1"), "2024-01-02"), _captured(short, "2024-01-03"), _captured(pages.filter("page_id % 14 = 0"), "2024-01-02")]
    path = _feed(parts, "ingest", lambda stream, path: W.ingest_pages(stream, path, rules))
    out = W.current_chunks(spark, path)
    return out.select("page_id", F.col("extract_index").cast("long").alias("extract_index"), F.col("chunk_index").cast("long").alias("chunk_index"), "text", F.size("embedding").cast("long").alias("dim"))


def discovered_stream(spark, d):
    """The same rows as discovered_upsert, from two parts of a stream."""
    old, found = content._discovered(spark, d)
    path = _feed([old, found], "discovered", W.keep_discovered)
    return W.discovered_table(spark, path).read()


def snapshot_stream(spark, d):
    """The table of snapshot_merge, from a stream of both scrapes."""
    first = B.keep_first(content._old(spark, d), ["url"], ["content_hash"]).select("url", "html")
    second = B.keep_first(content._new(spark, d), ["url"], ["html"])
    path = _feed([_captured(first, "2024-01-01"), _captured(second, "2024-02-01"), _captured(first, "2023-12-01")], "captures", W.keep_captures)
    return W.captures_table(spark, path).read().select("url", "content_hash", F.unix_seconds("last_scraped").alias("scraped_s"), F.unix_seconds("last_changed").alias("changed_s"))


def embed_pending(spark, d):
    chunks = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    done = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"))
    out = W.embed_pending(chunks, done)
    return out.select("chunk_id", F.round(T.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


def append_rows(spark, d):
    """Labels appended in two parts to a table that was empty."""
    labels = spark.read.parquet(f"{d}/labels.parquet")
    path = scratch_path(spark, "labels")
    S.append(S.empty(spark, "labels"), path, "labels")
    for part in (0, 1):
        S.append(labels.filter(F.pmod("doc_id", F.lit(2)) == part), path, "labels")
    return S.read(spark, path, "labels")


def decode_vectors(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    back = rows.select("vec_id", "embedding", S.encode_vector("embedding").alias("bytes")).select("vec_id", "embedding", F.octet_length("bytes").cast("long").alias("n_bytes"), S.decode_vector("bytes").alias("again"))
    return back.select("vec_id", "n_bytes", (F.col("again") == F.col("embedding")).alias("same"))


def schema_contract(spark, d):
    """Differences between the given tables and their declared schemas, with the number of rows read."""
    out = None
    for name in ("pages", "embeddings", "documents", "conversations", "labels", "benchmark"):
        df = spark.read.parquet(f"{d}/{name}.parquet")
        wrong = len(S.differences(df, name))
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(wrong).cast("long").alias("n_differences"))
        out = row if out is None else out.union(row)
    return out


_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows, 0::BIGINT AS n_differences FROM {n}" for n in ("pages", "embeddings", "documents", "conversations", "labels", "benchmark"))

ORACLES = {
    "feedback_cache_stream": app.ORACLES["feedback_cache"],
    "ingest_stream": content._SITE_CHUNKS.replace("context || first || markdown AS txt", "context || first || CASE WHEN page_id % 7 = 0 THEN regexp_extract(markdown, '^[^\\n]*') ELSE markdown END AS txt") + " SELECT k AS page_id, 0::BIGINT AS extract_index, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS chunk_index, part AS text, 64::BIGINT AS dim FROM f",
    "discovered_stream": content.ORACLES["discovered_upsert"],
    "snapshot_stream": "SELECT url, content_hash, scraped_s, changed_s FROM (" + content.ORACLES["snapshot_merge"] + ")",
    "embed_pending": "SELECT doc_id AS chunk_id, 1.0::DOUBLE AS norm FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND regexp_matches(lower(text), '[a-z0-9]') UNION ALL SELECT doc_id, 0.0 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND NOT regexp_matches(lower(text), '[a-z0-9]')",
    "append_rows": "SELECT doc_id, quality, toxic FROM labels",
    "decode_vectors": "SELECT vec_id, 4 * len(embedding) AS n_bytes, true AS same FROM embeddings",
    "schema_contract": _COUNTS,
}

QUERIES = {name: globals()[name] for name in ORACLES}
ORACLES = {name: sql for name, sql in ORACLES.items() if sql}
