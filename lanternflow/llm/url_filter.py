"""URL filters: host and path rules, and for the rest an empirical-Bayes host reputation.

Rules win where one fits. All other pages are judged by the share of bad pages that their host is
believed to have. Labelled pages give each host k bad ones of n. Counts are small for most hosts, so
they are shrunk: the rate of a suffix (com) is a beta-binomial posterior under the global rate, that of
a registered domain (example.com) under its suffix's rate, that of a host under its domain's. How much
a level is shrunk, the strength of its prior in pages, is estimated by moments from how its members'
rates scatter. A page is blocked when even the lower bound of the host's posterior (mean minus z
standard deviations, a normal approximation) is above the limit, so a host of which little is known is allowed.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.llm.shared import hot_join, materialise

#: (rule, verdict); a rule is host/path.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
LIMIT, Z = 0.25, 1.645
#: What is believed without any labelled page: so many bad pages of so many.
PRIOR_BAD, PRIOR_PAGES = 1, 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Suffixes of two labels under which names are registered.
_DOUBLE = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "ac.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za"]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty if it is null or has no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _LOWER), F.regexp_extract(text, pattern, 2)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without its port. A bare name or a numeric address is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    double = two.isin(_DOUBLE)
    numeric = name.rlike(r"^[\d.]+$")
    return F.when(numeric, name).when(double, F.substring_index(name, ".", -3)).otherwise(two), F.when(numeric, F.lit("")).when(double, two).otherwise(F.substring_index(name, ".", -1))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null. Of equally long ones the longer host wins."""
    fits = []
    for rule, verdict in rules:
        own, slash, rest = rule.partition("/")
        fit = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)), F.lit(len(own)), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(members: DataFrame, prior: Column, least: float = 1.0, most: float = 10_000.0) -> float:
    """How many pages a prior counts for, by moments of the members' k of n around it."""
    spread = prior * (1 - prior)
    row = members.agg(
        F.sum((F.col("k") - F.col("n") * prior) ** 2 - F.col("n") * spread).alias("between"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("all"),
    ).first()
    if not row["all"]:
        return most
    within = max(1 / (most + 1), min(1 / (least + 1), row["between"] / row["all"]))
    return 1 / within - 1


def host_reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """host, pages, rate (posterior mean of the share of bad pages) and bound (its lower bound). hosts: host, domain, suffix, pages, n labelled, k bad."""
    total = hosts.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    overall = ((total["k"] or 0) + PRIOR_BAD) / ((total["n"] or 0) + PRIOR_PAGES)
    suffixes = hosts.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    s = _strength(suffixes, F.lit(overall))
    suffixes = suffixes.select("suffix", ((F.col("k") + s * overall) / (F.col("n") + s)).alias("prior"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).join(suffixes, "suffix")
    s = _strength(domains, F.col("prior"))
    domains = domains.select("domain", "suffix", ((F.col("k") + s * F.col("prior")) / (F.col("n") + s)).alias("prior"))
    known = hosts.join(domains, ["domain", "suffix"])
    s = _strength(known, F.col("prior"))
    a, b = F.col("k") + s * F.col("prior"), F.col("n") - F.col("k") + s * (1 - F.col("prior"))
    mean = a / (a + b)
    return known.select("host", "pages", mean.alias("rate"), (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] | None = None, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, rate and bound for every row of pages (page_id, url).

    outcomes: page_id and bad (boolean) of labelled pages; an id that repeats is bad if any of its rows is.
    A null url or one without :// has an empty host and path, fits no rule, and is judged like a host of that
    name. Rows that repeat are judged each; a null page_id has no outcome. Without outcomes every host keeps the
    overall prior. Other columns are not read.
    """
    host, path = split_url(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    domain, suffix = domain_and_suffix(F.col("host"))
    bad = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = (
        urls.join(bad, "page_id", "left")
        .groupBy("host")
        .agg(F.count("*").alias("pages"), F.count("bad").cast("double").alias("n"), F.sum(F.coalesce(F.col("bad").cast("double"), F.lit(0.0))).alias("k"))
        .select("host", domain.alias("domain"), suffix.alias("suffix"), "pages", "n", "k")
    )
    reputation = materialise(host_reputation(materialise(hosts, "hosts"), z), "reputation")
    # Every host is in the table; pages of hot hosts are joined apart.
    judged = hot_join(urls, reputation, "host", "pages")
    judged = judged.withColumn("best", best_rule(F.col("host"), F.col("path"), RULES if rules is None else rules))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.round("rate", 6).alias("rate"),
        F.round("bound", 6).alias("bound"),
    )


#: The same chain of estimates over pages and labels, for hosts without ports.
ORACLE = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), o AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), h AS (
  SELECT host, CASE WHEN host LIKE '%.%' THEN regexp_extract(host, '([^.]*\.[^.]*)$', 1) ELSE host END AS domain,
         regexp_extract(host, '([^.]*)$', 1) AS suffix,
         count(bad)::DOUBLE AS n, sum(coalesce(bad, 0))::DOUBLE AS k
  FROM u LEFT JOIN o USING (page_id) GROUP BY host
), g AS (
  SELECT (sum(k) + 1) / (sum(n) + 20) AS m FROM h
), s0 AS (
  SELECT suffix, sum(k) AS k, sum(n) AS n, any_value(m) AS prior FROM h, g GROUP BY suffix
), s0s AS (
  SELECT 1 / greatest(1 / 10001.0, least(0.5, coalesce(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0))) - 1 AS s FROM s0
), s1 AS (
  SELECT suffix, (k + s * prior) / (n + s) AS prior FROM s0, s0s
), d0 AS (
  SELECT domain, suffix, sum(k) AS k, sum(n) AS n, any_value(prior) AS prior FROM h JOIN s1 USING (suffix) GROUP BY domain, suffix
), d0s AS (
  SELECT 1 / greatest(1 / 10001.0, least(0.5, coalesce(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0))) - 1 AS s FROM d0
), d1 AS (
  SELECT domain, suffix, (k + s * prior) / (n + s) AS prior FROM d0, d0s
), h0 AS (
  SELECT host, k, n, prior FROM h JOIN d1 USING (domain, suffix)
), h0s AS (
  SELECT 1 / greatest(1 / 10001.0, least(0.5, coalesce(sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0))) - 1 AS s FROM h0
), h1 AS (
  SELECT host, k + s * prior AS a, n - k + s * (1 - prior) AS b FROM h0, h0s
), h2 AS (
  SELECT host, a / (a + b) AS rate, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM h1
), r AS (
  SELECT * FROM (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'), ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')) AS t(rhost, rpath, rule, say)
), b AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(say, length(rule)) AS say
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(say, CASE WHEN bound > 0.25 THEN 'block' ELSE 'allow' END) AS verdict,
       round(rate, 6) AS rate, round(bound, 6) AS bound
FROM u JOIN h2 USING (host) LEFT JOIN b USING (page_id)
"""
