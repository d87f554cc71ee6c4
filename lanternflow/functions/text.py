"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the retrieval model.
BM25_K1, BM25_B = 1.5, 0.75
FUSION_ALPHA = 0.70
VECTOR_CANDIDATES, BM25_CANDIDATES = 50, 50
SYNONYMS = [["myway", "prepay", "prepaid"]]
GLOSSARY = ["Glossary: 'Prepay' and 'MyWay' refer to the same program; treat them as identical terms."]


#: White space of any kind, as Unicode has it.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_question(c: Column) -> Column:
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def hash_question(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def content_hash(html: Column) -> Column:
    return F.md5(html)


def tokenize(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def preview(c: Column, length: int = 220) -> Column:
    return F.substring(squeeze(F.coalesce(c, F.lit(""))), 1, length)


def clean_title(c: Column) -> Column:
    return F.substring(squeeze(F.coalesce(c, F.lit(""))), 1, 80)


def _rewritten(query: Column, aliases: Column) -> Column:
    """A query with every alias hit replaced by each of the aliases; itself without a hit."""
    literal = lambda x: F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    # An alias ends where no word goes on; one that begins or ends with another sign, as c++, has no word boundary there.
    pattern = F.concat(F.lit(r"(?i)(?<!\w)(?:"), F.array_join(F.transform(aliases, literal), "|"), F.lit(r")(?!\w)"))
    safe = lambda x: F.regexp_replace(x, r"([\\$])", r"\\$1")
    return F.when(F.regexp_like(query, pattern), F.transform(aliases, lambda a: F.regexp_replace(query, pattern, safe(a)))).otherwise(F.array(query))


def query_variants(c: Column, groups: list[list[str]] | None = None) -> Column:
    """Distinct rewritings of a query: every alias hit of a group becomes each alias of it; the query itself if none is hit.

    For many groups take variants_of().
    """
    out = F.array(c)
    for group in groups or SYNONYMS:
        aliases = F.array(*map(F.lit, sorted(group, key=len, reverse=True)))
        out = F.array_distinct(F.flatten(F.transform(out, lambda q: _rewritten(q, aliases))))  # noqa: B023
    return F.array_sort(out)


def variants_of(queries: DataFrame, groups: DataFrame) -> DataFrame:
    """query_id and variants of queries (query_id, text), as query_variants() gives them, for any number of groups (group_id, aliases).

    Runs of words of a query are looked up among the aliases, as long as the longest of these; only the groups that are hit rewrite it, by their number.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\w+"), F.lit(0))
    known = groups.select("group_id", F.explode("aliases").alias("alias")).select("group_id", words(F.col("alias")).alias("w")).filter("size(w) > 0")
    longest = known.agg(F.max(F.size("w"))).first()[0] or 0
    known = known.select("group_id", F.array_join("w", " ").alias("run"))
    at = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda k: k)).alias("at")
    runs = queries.select("query_id", words(F.coalesce("text", F.lit(""))).alias("w")).select("query_id", "w", at)
    runs = runs.select("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(max(1, longest))), lambda n: F.array_join(F.slice("w", F.col("at"), n), " "))).alias("run"))
    # Groups are made from few columns and look small by the files' size, so that they would be broadcast; they are merged whatever their number.
    hit = runs.join(known.hint("merge"), "run").select("query_id", "group_id").distinct().join(groups.select("group_id", "aliases").hint("merge"), "group_id")
    own = hit.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("group_id", "aliases"))).alias("own"))
    longest_first = lambda a: F.array_sort(a, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).otherwise(F.when(x > y, 1).otherwise(0)))
    step = lambda out, g: F.array_distinct(F.flatten(F.transform(out, lambda q: _rewritten(q, longest_first(g["aliases"])))))
    joined = queries.join(own.hint("merge"), "query_id", "left").withColumn("own", F.coalesce("own", F.array()))
    return joined.select("query_id", F.array_sort(F.aggregate("own", F.array(F.col("text")), step)).alias("variants"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def saturated_tf(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    """0 where the denominator is not positive."""
    below = tf + BM25_K1 * (1 - BM25_B + BM25_B * doc_len / avg_len)
    return F.when(below > 0, tf * (BM25_K1 + 1) / below).otherwise(F.lit(0.0))


def min_max(value: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi - lo <= 1e-12, F.lit(0.0)).otherwise((value - lo) / (hi - lo))


def fixed(c: Column, digits: int = 4) -> Column:
    """A number with so many digits, as Python and C write it: its binary value is rounded, an exact half to even. (format_string rounds the decimal form half up.)"""
    unit = 10**digits
    size = F.abs(c)
    low = F.floor(size * unit)
    # Halves of 26 bits, whose products with 2 * unit are exact: the sign of size * 2 * unit - (2 * low + 1) is right.
    split = size * F.lit(134217729.0)
    high = split - (split - size)
    over = high * (2.0 * unit) - (2 * low + 1).cast("double") + (size - high) * (2.0 * unit)
    n = F.when((over > 0) | ((over == 0) & (low % 2 == 1)), low + 1).otherwise(low)
    sign = F.when(c < 0, "-").otherwise("")
    text = F.concat(sign, F.floor(n / unit).cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0"))
    return F.when(size < 1e6, text).otherwise(F.format_string(f"%.{digits}f", c))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def clean_ip(c: Column) -> Column:
    """An address from a header value: no quotes, what follows for=, the first of a list, no closed brackets, no port."""
    unquoted = lambda x: F.regexp_replace(F.regexp_replace(strip(x), '^"+|"+$', ""), "^'+|'+$", "")
    text = unquoted(F.coalesce(c, F.lit("")))
    after = F.when(text.contains("for="), strip(F.substring_index(F.regexp_replace(text, r"(?s)^.*?for=", ""), ";", 1))).otherwise(text)
    first = unquoted(F.substring_index(after, ",", 1))
    bare = F.regexp_replace(first, r"^([^:]*):[0-9]+$", "$1")
    return F.when(first.startswith("[") & first.contains("]"), F.regexp_extract(first, r"^\[([^\]]*)", 1)).otherwise(bare)


def client_ip(headers: list[Column], peer: Column) -> Column:
    """The first usable address of the headers, else of the peer, else unknown."""
    return F.coalesce(*(F.nullif(clean_ip(h), F.lit("")) for h in headers), F.nullif(clean_ip(peer), F.lit("")), F.lit("unknown"))
