"""Registered retrieval queries over documents, embeddings and benchmark, and their DuckDB statements.

Chunks are documents that have a vector (doc_id = vec_id), three in a row form an extract; the benchmark's
texts are the questions, with the vector of the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.functions import text as T
from lanternflow.operators import retrieval as R

#: Fixed value: what the answering model is told.
SYSTEM = "Answer the question using only the provided context. If the answer is not in the context, say you don't know."
K = 10


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 3).alias("extract_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("url"), "text")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return R.corpus(_chunks(spark, d), _vectors(spark, d))


_INDEXES: dict[tuple[str, str], tuple[R.Index, R.VectorIndex]] = {}


def _there(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _indexed(spark: SparkSession, d: str) -> tuple[R.Index, R.VectorIndex]:
    """The corpus' stored indexes; all queries of a session share them as long as they are there."""
    key = spark.sparkContext.applicationId, d
    held = _INDEXES.get(key)
    if held is None or not all(_there(spark, index.path) for index in held):
        rows = _corpus(spark, d)
        held = _INDEXES[key] = R.Index(rows), R.VectorIndex(rows)
    return held


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).join(_vectors(spark, d), F.col("query_id") == F.col("chunk_id")).select("query_id", F.col("embedding").alias("vector"))


def _variant_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Up to three vectors a question: those of its number, and of 150 and 300 more."""
    steps = F.explode(F.array(*(F.col("query_id") + k for k in (0, 150, 300))))
    return _queries(spark, d).select("query_id", steps.alias("chunk_id")).join(_vectors(spark, d), "chunk_id").select("query_id", F.col("embedding").alias("vector"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.candidates(_corpus(spark, d), _queries(spark, d), _query_vectors(spark, d), K, *_indexed(spark, d))


def tokenize(spark, d):
    return _chunks(spark, d).select("chunk_id", F.size(T.tokenize(F.col("text"))).cast("long").alias("n_tokens"), F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


def term_postings(spark, d):
    return R.postings(_corpus(spark, d))


def term_stats(spark, d):
    rows = _corpus(spark, d)
    return R.term_stats(R.postings(rows), rows.count()).withColumn("idf", F.round("idf", 6))


def corpus_stats(spark, d):
    return R.corpus_stats(_corpus(spark, d)).withColumn("avg_len", F.round("avg_len", 6))


def bm25_query_terms(spark, d):
    return R.query_terms(_queries(spark, d))


def query_variants(spark, d):
    """Questions from order priorities and segments, with an alias of the synonym group put in by the row's number."""
    alias = F.element_at(F.array(F.lit("MyWay"), F.lit("prepay"), F.lit("Prepaid"), F.lit("other")), (F.col("c_custkey") % 4 + 1).cast("int"))
    ask = _t(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("how does "), alias, F.lit(" work for "), F.lower("c_mktsegment"), F.lit("?")).alias("text"))
    return ask.select("query_id", F.posexplode(T.query_variants(F.col("text"))).alias("n", "variant")).select("query_id", F.col("n").cast("long").alias("n"), "variant")


def many_synonyms(spark, d):
    """A group of synonyms for every part: its name's first two words, and the part's number in two forms; questions name parts in either way."""
    parts = _t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("group_id"))
    names = F.array(F.concat(F.lit("part no "), F.col("group_id").cast("string")), F.concat(F.lit("item"), F.col("group_id").cast("string")), F.concat(F.lit("p"), F.col("group_id").cast("string"), F.lit("++")))
    groups = parts.select("group_id", names.alias("aliases"))
    n = groups.count()
    word = F.element_at(names, (F.col("query_id") % 3 + 1).cast("int"))
    ask = _t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("query_id")).withColumn("group_id", F.col("query_id") % n)
    ask = ask.select("query_id", F.concat(F.lit("Where is "), F.initcap(word), F.lit(" on the shelf?")).alias("text"))
    return T.variants_of(ask, groups).select("query_id", F.posexplode("variants").alias("n", "variant")).select("query_id", F.col("n").cast("long").alias("n"), "variant")


def bm25_scores(spark, d):
    return R.bm25(_indexed(spark, d)[0], _queries(spark, d))


def topk_per_query(spark, d):
    return R.bm25_top_k(_indexed(spark, d)[0], _queries(spark, d), 5)


def index_refresh(spark, d):
    """An index of half of the corpus, its texts in capitals and turned round for every fifth, that takes up the other half, loses every
    eleventh chunk, gets the changed ones as they are now, and is compacted and opened again before a last chunk goes."""
    rows = _corpus(spark, d).select("chunk_id", "text")
    old = rows.withColumn("text", F.when(F.col("chunk_id") % 5 == 0, F.reverse(F.upper("text"))).otherwise(F.col("text")))
    index = R.Index(old.filter("chunk_id % 2 = 0"))
    index.add(old.filter("chunk_id % 2 = 1"))
    index.delete(rows.filter("chunk_id % 11 = 3"))
    index.replace(rows.filter("chunk_id % 5 = 0 AND chunk_id % 11 != 3"))
    index.compact()
    index = R.Index.open(spark, index.path)
    index.delete(rows.filter("chunk_id = 0"))
    return R.bm25_top_k(index, _queries(spark, d), 5)


def vector_search(spark, d):
    rows = _corpus(spark, d)
    best = R.vector_top_k(_indexed(spark, d)[1], _query_vectors(spark, d), K)
    return R.with_text(best, rows).select("query_id", "chunk_id", "vector_score", "rank", F.md5("text").alias("text_md5"))


def vector_variants(spark, d):
    return R.vector_top_k(_indexed(spark, d)[1], _variant_vectors(spark, d), K)


def candidate_union(spark, d):
    return _candidates(spark, d).select("query_id", "chunk_id", "from_vector", "from_bm25")


def candidate_counts(spark, d):
    flag = lambda c: F.sum(F.col(c).cast("long"))
    return _candidates(spark, d).groupBy("query_id").agg(flag("from_vector").alias("vector"), flag("from_bm25").alias("bm25"), F.count("*").alias("merged"))


def minmax_normalize(spark, d):
    return R.fuse(_candidates(spark, d)).select("query_id", "chunk_id", "vector_norm", "bm25_norm", "score")


def hybrid_search(spark, d):
    return R.hybrid_search(_corpus(spark, d), _queries(spark, d), _query_vectors(spark, d), K, *_indexed(spark, d))


def _extracts(spark, d):
    """Three documents in a row, joined by blank lines, are an extract's text."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", "text")))
    return _chunks(spark, d).groupBy("extract_id").agg(F.array_join(parts.getField("text"), "\n\n").alias("text"))


def provenance(spark, d):
    best = R.vector_top_k(_indexed(spark, d)[1], _query_vectors(spark, d), K)
    return best.join(_chunks(spark, d).select("chunk_id", "extract_id", "url"), "chunk_id").select("query_id", "rank", "chunk_id", "extract_id", "url")


def parent_extracts(spark, d):
    out = R.parent_extracts(hybrid_search(spark, d), _extracts(spark, d), 6)
    return out.select("query_id", "position", "score", "chunk_id", "extract_id", F.md5("text").alias("text_md5"))


def short_extracts(spark, d):
    """Parent extracts of the vector search, 100 characters of each."""
    best = R.vector_top_k(_indexed(spark, d)[1], _query_vectors(spark, d), K).withColumnRenamed("vector_score", "score")
    scored = best.join(_chunks(spark, d).select("chunk_id", "extract_id"), "chunk_id")
    return R.parent_extracts(scored, _extracts(spark, d), None, 100).select("query_id", "position", "score", "chunk_id", "extract_id", "text")


def build_context(spark, d):
    parents = R.parent_extracts(hybrid_search(spark, d), _extracts(spark, d), 6)
    return R.build_context(parents, T.GLOSSARY).select("query_id", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("context_md5"))


def source_links(spark, d):
    return R.source_links(hybrid_search(spark, d), 3)


def rag_prompts(spark, d):
    parents = R.parent_extracts(hybrid_search(spark, d), _extracts(spark, d), 6)
    out = R.rag_prompts(_queries(spark, d), R.build_context(parents), SYSTEM)
    return out.select("query_id", "has_context", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def chunk_preview(spark, d):
    return _chunks(spark, d).select("chunk_id", T.preview(F.col("text")).alias("preview"), F.substring(T.strip(F.regexp_replace("text", "\n", " ")), 1, 200).alias("line"))


def l2_normalize(spark, d):
    scaled = _vectors(spark, d).select("chunk_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    out = scaled.select("chunk_id", T.l2_normalize(F.col("v")).alias("v"))
    return out.select("chunk_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(T.dot(F.col("v"), F.col("v")), 6).alias("norm"))


def pending_embeddings(spark, d):
    return _chunks(spark, d).join(_vectors(spark, d), "chunk_id", "left_anti").select("chunk_id", "extract_id")


_BASE = r"""
WITH chunks AS (
  SELECT doc_id AS chunk_id, doc_id // 3 AS extract_id, source || '/' || doc_id AS url, text FROM documents
), corpus AS (
  SELECT c.*, CAST(e.embedding AS DOUBLE[]) AS v FROM chunks c JOIN embeddings e ON c.chunk_id = e.vec_id
), qs AS (
  SELECT item_id AS query_id, text FROM benchmark
), qv AS (
  SELECT query_id, CAST(embedding AS DOUBLE[]) AS qvec FROM qs JOIN embeddings ON query_id = vec_id
), tok AS (
  SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM corpus
), posts AS (
  SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL
), lens AS (
  SELECT chunk_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS doc_len FROM corpus
), stats AS (
  SELECT count(*) AS n_docs, CASE WHEN avg(doc_len) > 0 THEN avg(doc_len) ELSE 1.0 END AS avg_len FROM lens
), terms AS (
  SELECT term, count(*) AS df, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts, stats GROUP BY term
), qt AS (
  SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM qs
), bm AS (
  SELECT query_id, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS bm25
  FROM posts JOIN terms USING (term) JOIN qt USING (term) JOIN lens USING (chunk_id), stats GROUP BY query_id, chunk_id
), vec AS (
  SELECT query_id, chunk_id, round(list_inner_product(v, qvec), 6) AS vector_score FROM corpus, qv
), every AS (
  SELECT query_id, chunk_id, vector_score, coalesce(bm25, 0.0) AS bm25 FROM vec LEFT JOIN bm USING (query_id, chunk_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_id) AS vr,
         row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS br FROM every
), cand AS (
  SELECT query_id, chunk_id, vector_score, bm25, vr <= 50 AS from_vector, br <= 50 AS from_bm25 FROM ranked WHERE vr <= 50 OR br <= 50
), lims AS (
  SELECT query_id, min(vector_score) AS vlo, max(vector_score) AS vhi, min(bm25) AS blo, max(bm25) AS bhi FROM cand GROUP BY query_id
), normed AS (
  SELECT cand.*, CASE WHEN vhi - vlo <= 1e-12 THEN 0.0 ELSE (vector_score - vlo) / (vhi - vlo) END AS vn,
         CASE WHEN bhi - blo <= 1e-12 THEN 0.0 ELSE (bm25 - blo) / (bhi - blo) END AS bn FROM cand JOIN lims USING (query_id)
), fused AS (
  SELECT query_id, chunk_id, vector_score, bm25, from_vector, from_bm25, round(vn, 6) AS vector_norm, round(bn, 6) AS bm25_norm,
         round(0.7 * vn + (1 - 0.7) * bn, 6) AS score FROM normed
), hybrid AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused
), best AS (
  SELECT hybrid.*, extract_id, url, text FROM hybrid JOIN chunks USING (chunk_id) WHERE rank <= 10
), extracts AS (
  SELECT extract_id, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY chunk_id), '^\s+|\s+$', '', 'g') AS text FROM chunks GROUP BY extract_id
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, extract_id ORDER BY rank) AS n FROM best) WHERE n = 1
), parents AS (
  SELECT query_id, position, score, chunk_id, f.extract_id, e.text FROM firsts f JOIN extracts e USING (extract_id) WHERE position <= 6
)
"""
_VECTOR = "SELECT query_id, chunk_id, vector_score, vr AS rank FROM ranked WHERE vr <= 10"
_BLOCKS = r"string_agg('[extract_id=' || extract_id || ' score=' || printf('%.4f', score) || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position)"

ORACLES = {
    "tokenize": "SELECT doc_id AS chunk_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS tokens FROM documents",
    "term_postings": _BASE + "SELECT chunk_id, term, tf, doc_len FROM posts JOIN lens USING (chunk_id)",
    "term_stats": _BASE + "SELECT term, df, round(idf, 6) AS idf FROM terms",
    "corpus_stats": _BASE + "SELECT n_docs, round(avg_len, 6) AS avg_len FROM stats",
    "bm25_query_terms": _BASE + "SELECT query_id, term FROM qt",
    "query_variants": r"""
WITH q AS (
  SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN 'MyWay' WHEN 1 THEN 'prepay' WHEN 2 THEN 'Prepaid' ELSE 'other' END AS word, lower(c_mktsegment) AS s FROM customer
), v AS (
  SELECT query_id, s, unnest(CASE word WHEN 'other' THEN ['other'] ELSE ['myway', 'prepaid', 'prepay'] END) AS w FROM q
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY w) - 1 AS n, 'how does ' || w || ' work for ' || s || '?' AS variant FROM v""",
    "many_synonyms": "WITH q AS (SELECT c_custkey AS query_id, c_custkey % (SELECT count(*) FROM part) AS g FROM customer), v AS (SELECT query_id, unnest(['part no ' || g, 'item' || g, 'p' || g || '++']) AS w FROM q) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY w) - 1 AS n, 'Where is ' || w || ' on the shelf?' AS variant FROM v",
    "bm25_scores": _BASE + "SELECT query_id, chunk_id, bm25 FROM bm",
    "topk_per_query": _BASE + "SELECT * FROM (SELECT query_id, chunk_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM bm) WHERE rank <= 5",
    "index_refresh": _BASE.replace("FROM chunks c JOIN embeddings e ON c.chunk_id = e.vec_id", "FROM chunks c JOIN embeddings e ON c.chunk_id = e.vec_id WHERE chunk_id % 11 <> 3 AND chunk_id <> 0") + "SELECT * FROM (SELECT query_id, chunk_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM bm) WHERE rank <= 5",
    "vector_search": _BASE + "SELECT query_id, chunk_id, vector_score, vr AS rank, md5(text) AS text_md5 FROM ranked JOIN chunks USING (chunk_id) WHERE vr <= 10",
    "vector_variants": _BASE.replace(
        "SELECT query_id, CAST(embedding AS DOUBLE[]) AS qvec FROM qs JOIN embeddings ON query_id = vec_id",
        "SELECT query_id, CAST(embedding AS DOUBLE[]) AS qvec FROM qs JOIN embeddings ON vec_id IN (query_id, query_id + 150, query_id + 300)",
    ).replace("round(list_inner_product(v, qvec), 6) AS vector_score FROM corpus, qv", "round(max(list_inner_product(v, qvec)), 6) AS vector_score FROM corpus, qv GROUP BY query_id, chunk_id") + _VECTOR,
    "candidate_union": _BASE + "SELECT query_id, chunk_id, from_vector, from_bm25 FROM cand",
    "candidate_counts": _BASE + "SELECT query_id, count(*) FILTER (from_vector) AS vector, count(*) FILTER (from_bm25) AS bm25, count(*) AS merged FROM cand GROUP BY query_id",
    "minmax_normalize": _BASE + "SELECT query_id, chunk_id, vector_norm, bm25_norm, score FROM fused",
    "hybrid_search": _BASE + "SELECT query_id, rank, score, chunk_id, extract_id, url, from_vector, from_bm25, vector_score, bm25, vector_norm, bm25_norm, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 220) AS chunk_preview FROM best".replace("\\\\", "\\"),
    "provenance": _BASE + "SELECT query_id, vr AS rank, chunk_id, extract_id, url FROM ranked JOIN chunks USING (chunk_id) WHERE vr <= 10",
    "parent_extracts": _BASE + "SELECT query_id, position, score, chunk_id, extract_id, md5(text) AS text_md5 FROM parents",
    "short_extracts": _BASE + "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY vr) AS position, vector_score AS score, chunk_id, extract_id, substr(text, 1, 100) AS text FROM (SELECT r.*, e.extract_id, e.text, row_number() OVER (PARTITION BY query_id, e.extract_id ORDER BY vr) AS n FROM ranked r JOIN chunks c USING (chunk_id) JOIN extracts e ON c.extract_id = e.extract_id WHERE vr <= 10) WHERE n = 1",
    "build_context": _BASE + f"SELECT query_id, length(c) AS n_chars, md5(c) AS context_md5 FROM (SELECT query_id, '[glossary]' || chr(10) || '{T.GLOSSARY[0].replace(chr(39), chr(39) * 2)}' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || {_BLOCKS} AS c FROM parents GROUP BY query_id)",
    "source_links": _BASE + "SELECT query_id, score, chunk_id, extract_id, url, from_vector, from_bm25, vector_score, bm25, vector_norm, bm25_norm, position FROM firsts WHERE position <= 3",
    "rag_prompts": _BASE + f"SELECT query_id, c IS NOT NULL AS has_context, length(p) AS n_chars, md5(p) AS prompt_md5 FROM (SELECT query_id, c, 'Question: ' || text || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(c, '') AS p FROM qs LEFT JOIN (SELECT query_id, {_BLOCKS} AS c FROM parents GROUP BY query_id) USING (query_id))",
    "chunk_preview": r"SELECT doc_id AS chunk_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 220) AS preview, substr(regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g'), 1, 200) AS line FROM documents",
    "l2_normalize": "WITH s AS (SELECT vec_id AS chunk_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS v FROM embeddings), n AS (SELECT chunk_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM s) SELECT chunk_id, round(v[1], 6) AS first, round(list_inner_product(v, v), 6) AS norm FROM n",
    "pending_embeddings": "SELECT doc_id AS chunk_id, doc_id // 3 AS extract_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
}

QUERIES = {name: globals()[name] for name in ORACLES}
