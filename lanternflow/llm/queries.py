"""The registered queries of this subpackage and the DuckDB statements they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.llm import chat_format, decontamination, embedding_dedup, exact_dedup, html_extract, ngram_join, packing, prefix_trie, structure_repair, suffix_dedup, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document with its id: bad if of low quality or toxic."""
    labels = _table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), outcomes)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(chat_format.turn_records().alias("record"))
    return chat_format.format_records(turns.union(spark.createDataFrame([(chat_format.FORGED,)], "record string")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair_conversations(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_toxicity": op2_toxicity,
        "op3_warc": op3_warc,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_url_filters": op5_url_filters,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_html_extraction": op7_html_extraction,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_embedding_near_dedup": op11_embedding_near_dedup,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_structure_repair": op13_structure_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": warc.ORACLE,
        "op5_url_filters": url_filter.ORACLE,
        "op8_chat_formatting": chat_format.ORACLE,
        "op9_exact_dedup": exact_dedup.ORACLE,
        "op11_embedding_near_dedup": embedding_dedup.ORACLE,
        "op12_prefix_trie": prefix_trie.ORACLE,
        "op13_structure_repair": structure_repair.ORACLE,
    }
