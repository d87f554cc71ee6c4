"""Declared schemas, checked when a table is read, and the codec of vector columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructType

SCHEMAS = {
    "sites": "id bigint, root_url string, selector string, breadcrumb_selector string, split_function string, name string",
    "discovered_urls": "id bigint, site_id bigint, url string, kind string, discovered_at timestamp",
    "pages": "page_id bigint, url string, html string",
    "extracts": "id bigint, page_id bigint, pdf_id bigint, extract_index bigint, text string",
    "chunks": "id bigint, extract_id bigint, chunk_index bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "users": "id bigint, created_at timestamp, display_name string",
    "user_ips": "ip string, user_id bigint, created_at timestamp",
    "chats": "id bigint, user_id bigint, created_at timestamp, last_message_at timestamp, title string",
    "cache_entries": "id bigint, question_norm string, question_hash string, answer_text string, sources_json string, good_count bigint, bad_count bigint, created_at timestamp, updated_at timestamp, last_used_at timestamp",
    "messages": "id bigint, chat_id bigint, role string, content string, sources_json string, debug_json string, created_at timestamp, stream_id string, cached_from bigint, question_norm string",
    "feedback": "id bigint, message_id bigint, user_id bigint, rating int, note string, created_at timestamp",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def differences(df: DataFrame, name: str) -> list[tuple[str, str | None, str | None]]:
    """(column, declared type, found type) of what is not as declared. Integers of another width are as declared."""
    wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint"}
    kind = lambda t: wide.get(t, t)
    declared = {f.name: f.dataType.simpleString() for f in schema(name)}
    found = dict(df.dtypes)
    return [(c, declared.get(c), found.get(c)) for c in sorted(declared.keys() | found.keys()) if kind(declared.get(c, "")) != kind(found.get(c, ""))]


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table at path; a declared column that is absent is an error, as is one of another type."""
    df = spark.read.parquet(path)
    wrong = [d for d in differences(df, name) if d[1] is not None]
    if wrong:
        raise ValueError(f"{name} at {path} is not as declared: {wrong}")
    return df


def append(df: DataFrame, path: str, name: str) -> None:
    """Adds rows to the table at path, with the declared types and order of columns; rows with other columns are refused, and nothing is written."""
    wrong = differences(df, name)
    if wrong:
        raise ValueError(f"rows for {name} are not as declared: {wrong}")
    df.select(*(F.col(f.name).cast(f.dataType) for f in schema(name))).write.mode("append").parquet(path)


@F.pandas_udf(BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    """float32, little-endian."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def decode_vector(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f4"))
