"""Registered query that answers questions from the cache first, and its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.operators import chats as C
from lanternflow.operators import retrieval as R
from lanternflow.plans import retrieval as P


def _cache(spark, d):
    """A good answer to every third question; another third has a good and a bad rating."""
    items = P._queries(spark, d)
    event = lambda rating, later, wanted: items.filter(wanted).select((F.col("query_id") * 2 + later).alias("event_id"), F.col("text").alias("question"), F.concat(F.lit("A"), F.col("query_id").cast("string")).alias("answer"), F.lit(rating).alias("rating"), F.timestamp_seconds(F.col("query_id") * 2 + later).alias("ts"))
    return C.feedback_cache(event(1, 0, "query_id % 3 < 2").unionByName(event(-1, 1, "query_id % 3 = 1")))


def routed_answers(spark, d):
    """All questions: the cached answer, or the prompt that retrieval makes for those that the cache does not answer."""

    def retrieve(questions: DataFrame) -> DataFrame:
        vectors = P._query_vectors(spark, d).join(questions.select("query_id"), "query_id", "left_semi")
        best = R.hybrid_search(P._corpus(spark, d), questions, vectors, P.K, *P._indexed(spark, d))
        return R.rag_prompts(questions, R.build_context(R.parent_extracts(best, P._extracts(spark, d), 6)), P.SYSTEM)

    out = C.answered(P._queries(spark, d), _cache(spark, d), retrieve)
    return out.select("query_id", "route", F.md5("text").alias("text_md5"))


_NONE = C.NO_CONTEXT.replace("'", "''")
ORACLES = {
    "routed_answers": P._BASE
    + f"""SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'cache' WHEN c IS NULL THEN 'none' ELSE 'retrieval' END AS route,
       md5(CASE WHEN query_id % 3 = 0 THEN 'A' || query_id WHEN c IS NULL THEN '{_NONE}' ELSE 'Question: ' || text || chr(10) || chr(10) || 'Context:' || chr(10) || c END) AS text_md5
FROM qs LEFT JOIN (SELECT query_id, {P._BLOCKS} AS c FROM parents GROUP BY query_id) USING (query_id)""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
