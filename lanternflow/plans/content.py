"""Registered queries on pages, links and table maintenance, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.functions import markup as M
from lanternflow.functions import text as T
from lanternflow.functions import urls as U
from lanternflow.operators import ingest as I
from lanternflow.operators import parsing as P
from lanternflow.operators import tables as B
from lanternflow.sources.scratch import materialise, scratch_path


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _root(c):
    return F.regexp_extract(c, r"^([a-z]+://[^/?#]*)", 1)


def _links(spark, d):
    return I.internal_links(_t(spark, d, "pages"), _root(F.col("url")))


def _with_links(spark, d):
    """The pages, each with links in single and no quotes, in capitals, and in a comment and a script."""
    n = F.col("page_id").cast("string")
    more = F.concat(F.lit("<A CLASS=x HREF='/s"), n, F.lit("?a=1&amp;b=2'>s</A><a href=/u"), n, F.lit('>u</a><!-- <a href="/c">c</a> --><script>"<a href=\'/j\'>"</script><a title=" href=\'/t\'>" href = "./d#'), n, F.lit('">d</a>'))
    return _t(spark, d, "pages").withColumn("html", F.concat("html", more))


def _old(spark, d):
    """Captures before the scrape: two thirds of the pages."""
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return _t(spark, d, "pages").filter("page_id % 3 != 0").select("url", "html", F.md5("html").alias("content_hash"), stamp.alias("last_scraped"), stamp.alias("last_changed"))


def _new(spark, d):
    """The scrape: all pages but every eleventh, every fifth of them changed."""
    return _t(spark, d, "pages").filter("page_id % 11 != 0").select("url", F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("<!-- v2 -->"))).otherwise(F.col("html")).alias("html"))


def _unique(df, keys=("url",)):
    return df.dropDuplicates(list(keys))


def keyed_scan(spark, d):
    return B.scan(_t(spark, d, "conversations"), {"conv_id": 7}).select("conv_id", "turn", "role")


def keyed_scan_limit(spark, d):
    return B.scan(_t(spark, d, "conversations").select("conv_id", "turn", "role"), {"role": "system"}, 5, ["conv_id", "turn"])


def content_hash(spark, d):
    return _t(spark, d, "pages").select("page_id", T.content_hash(F.col("html")).alias("content_hash"))


def url_host(spark, d):
    return _t(spark, d, "pages").select("page_id", U.url_host(F.col("url")).alias("host"))


def link_kind(spark, d):
    """Every fourth page's url gets a .PDF path, every fifth a content type."""
    url = F.when(F.col("page_id") % 4 == 0, F.concat(_root(F.col("url")), F.lit("/doc"), F.col("page_id").cast("string"), F.lit(".PDF?x=1"))).otherwise(F.col("url"))
    kind = F.when(F.col("page_id") % 5 == 0, F.lit("Application/PDF; q=1"))
    return _t(spark, d, "pages").select("page_id", U.link_kind(url, kind).alias("kind"))


def internal_links(spark, d):
    return I.internal_links(_with_links(spark, d), _root(F.col("url")))


def html_to_markdown(spark, d):
    return _t(spark, d, "pages").select("page_id", M.to_markdown(M.container(F.col("html"))).alias("markdown"))


def breadcrumbs(spark, d):
    return _t(spark, d, "pages").select("page_id", M.breadcrumb_context(F.col("html")).alias("context"))


def _markdown(spark, d):
    """Documents with blank lines for line ends, and a heading on every line that begins with T or D."""
    text = F.regexp_replace(F.regexp_replace("text", "\n", "\n\n"), r"(?md)^(?=[TD])", "## ")
    return _t(spark, d, "documents").select("doc_id", text.alias("text"))


def section_split(spark, d):
    rows = _markdown(spark, d).select("doc_id", F.posexplode(M.split_headings(F.col("text"))).alias("n", "piece"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), F.length("piece").cast("long").alias("n_chars"), F.md5("piece").alias("piece_md5"))


def pack_sections(spark, d):
    rows = _markdown(spark, d).select("doc_id", F.posexplode(M.pack_sections(M.split_headings(F.col("text")))).alias("n", "piece"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), "piece")


def chunk_extracts(spark, d):
    rows = _markdown(spark, d).select("doc_id", F.posexplode(M.chunk_extract(F.col("text"))).alias("chunk_index", "chunk"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")


def extract_windows(spark, d):
    rows = _markdown(spark, d).select("doc_id", F.posexplode(M.extract_windows(F.col("text"), F.lit("Context: A\n\n"), 2000)).alias("n", "extract"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), "extract")


def _rules(spark, d):
    """A rule for each site of the pages: sections, tabs or whole by the length of its address. A site's number is its smallest page."""
    sites = _t(spark, d, "pages").groupBy(_root(F.col("url")).alias("root_url")).agg(F.min("page_id").alias("site_id"))
    rule = F.element_at(F.array(F.lit("sections"), F.lit("tabs"), F.lit("whole")), (F.length("root_url") % 3 + 1).cast("int"))
    return sites.select("site_id", "root_url", U.url_host(F.col("root_url")).alias("name"), F.lit("body > article").alias("container"), F.lit("body > nav ul").alias("breadcrumb"), rule.alias("rule"), (F.length("root_url") % 2 == 0).alias("crumb_text"))


def site_rules(spark, d):
    """The rules after seeding: seeds for some of the sites, and for one that has no page."""
    rules = _rules(spark, d)
    seeds = rules.filter(F.length("root_url") % 5 == 0).withColumns({"rule": F.lit("whole"), "breadcrumb": F.lit("nav#none")})
    extra = spark.range(1).select((-F.col("id") - 1).alias("site_id"), *(F.lit(x).alias(c) for c, x in (("root_url", "https://seed.example"), ("name", "seed.example"), ("container", "#main"), ("breadcrumb", "nav"), ("rule", "tabs"))), F.lit(True).alias("crumb_text"))
    return P.seed_rules(rules, seeds.unionByName(extra))


def _site_pages(spark, d):
    """The pages with their site; those of sites with sections get an accordion, those of sites with tabs tabs, below the container."""
    rules = _rules(spark, d)
    pages = _t(spark, d, "pages").withColumn("root_url", _root(F.col("url"))).join(F.broadcast(rules.select("site_id", "root_url", "rule")), "root_url")
    accordion = F.concat(F.lit('<div class="x-accordion"><p>Accordion Item</p><p>Closed Title:</p><p>'), "url", F.lit("</p></div>"))
    tabs = F.concat(F.lit('<div class="doc-content-wrap"><p>How to</p></div><ul class="kt-tabs-title-list"><li>T</li></ul><div class="kt-tabs-content-wrap"><div class="x kt-inner-tab-1"><p>'), "url", F.lit('</p></div><div class="kt-inner-tab-2"><b>end</b></div></div>'))
    more = F.when(F.col("rule") == "sections", accordion).when(F.col("rule") == "tabs", tabs).otherwise(F.lit(""))
    return pages.select("page_id", "site_id", "url", F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), more)).alias("html"))


def pages_to_chunks(spark, d):
    out = P.pages_to_chunks(_site_pages(spark, d), _rules(spark, d))
    return out.select("page_id", F.col("extract_index").cast("long").alias("extract_index"), F.col("chunk_index").cast("long").alias("chunk_index"), "text")


def chunks_replaced(spark, d):
    """Every third page is parsed anew, cut to its heading; its old chunks go, however many they were."""
    pages, rules = _site_pages(spark, d), _rules(spark, d)
    short = pages.filter("page_id % 3 = 0").withColumn("html", F.regexp_replace("html", r"(?s)</h1>.*?</article>", "</h1></article>"))
    out = P.pages_to_chunks(short, rules, P.pages_to_chunks(pages, rules))
    return out.groupBy("page_id").agg(F.count("*").alias("n_chunks"), F.max("chunk_index").cast("long").alias("last"))


def pipeline_counts(spark, d):
    e = materialise(P.extracts(_site_pages(spark, d), _rules(spark, d)), "extracts")  # read twice, parsed once
    c = P.chunks(e)
    per = e.groupBy("page_id").agg(F.count("*").alias("n_extracts")).join(c.groupBy("page_id").agg(F.count("*").alias("n_chunks")), "page_id", "left")
    return per.select("page_id", "n_extracts", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def pipeline_totals(spark, d):
    """The chunks of every second page have a vector."""
    pages, rules = _site_pages(spark, d), _rules(spark, d)
    e = materialise(P.extracts(pages, rules), "extracts")
    c = P.chunks(e).select("page_id", F.concat_ws("/", "page_id", "extract_index", "chunk_index").alias("chunk_id"))
    c = materialise(c, "chunk_ids")
    return P.pipeline_totals(pages, e, c, c.filter("page_id % 2 = 0"), snapshot_merge(spark, d))


def tab_split(spark, d):
    return P.tab_split(_site_pages(spark, d), _rules(spark, d), 100_000)


def pending_urls(spark, d):
    found = _links(spark, d).select("url").distinct()
    kept = _links(spark, d).filter(F.length("url") % 3 == 0).select("url").distinct()
    return I.pending(found, kept, F.length("url") > 10)


def _discovered(spark, d):
    """Urls that are known, of half of the pages, and those that are found, of all."""
    old = _unique(_t(spark, d, "pages").filter("page_id % 2 = 0").select("url", F.lit("html").alias("kind"), F.lit(1).cast("long").alias("discovered_at")))
    found = _t(spark, d, "pages").select("url", F.when(F.length("url") % 2 == 0, F.lit("pdf")).otherwise(F.lit("html")).alias("kind"), F.lit(2).cast("long").alias("discovered_at"))
    return old, found


def pending_of_site(spark, d):
    """What is pending of the site of the smallest number: of its pages those that are even are captured."""
    pages = _site_pages(spark, d).select("page_id", "site_id", "url")
    site = pages.agg(F.min("site_id")).first()[0]
    return I.pending(pages, pages.filter("page_id % 2 = 0"), None, site).select("url", "site_id").distinct()


def discovered_upsert(spark, d):
    return I.discovered_upsert(*_discovered(spark, d))


def snapshot_merge(spark, d):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    out = I.snapshot_merge(B.keep_first(_old(spark, d), ["url"], ["content_hash"]), B.keep_first(_new(spark, d), ["url"], ["html"]), now)
    return out.select("url", "content_hash", F.unix_seconds("last_scraped").alias("scraped_s"), F.unix_seconds("last_changed").alias("changed_s"), "state")


def duplicate_content(spark, d):
    pages = _t(spark, d, "pages")
    again = pages.filter("page_id % 7 = 0").select((F.col("page_id") + 1_000_000).alias("id"), F.concat("url", F.lit("?copy")).alias("url"), "html")
    return I.duplicate_content(pages.select(F.col("page_id").alias("id"), "url", "html").union(again)).select("id", "canonical_id", "is_duplicate")


def link_frontier(spark, d):
    """From the first page, over the links of the captured pages: a page leads to the paths that it links to, a path to the pages that do."""
    held = _links(spark, d).select("src", U.url_path(F.col("url")).alias("dst"))
    links = held.unionByName(held.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    root = _t(spark, d, "pages").agg(F.min("url")).first()[0]
    return I.link_frontier(links, root, 400).select("node", F.col("depth").cast("long").alias("depth"))


def unique_violations(spark, d):
    return B.unique_violations(_t(spark, d, "pages").select(_root(F.col("url")).alias("root_url")), ["root_url"])


def upsert_by_key(spark, d):
    """A stored table that takes the orders, and then changes: three of each key they concern, of which the one of the greatest number wins."""
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"))
    changed = orders.filter("o_orderkey % 4 = 0").select((F.col("o_orderkey") * 2).alias("o_orderkey"), "price", F.explode(F.array(*map(F.lit, (2, 3, 1)))).alias("nth"))
    new = changed.select("o_orderkey", F.concat(F.lit("U"), F.col("nth").cast("string")).alias("o_orderstatus"), (F.col("price") + F.col("nth")).alias("price"), "nth")
    table = B.KeyedTable(spark, scratch_path(spark, "orders"), "o_orderkey bigint, o_orderstatus string, price double", ["o_orderkey"], 8)
    table.upsert(orders)
    table.upsert(new, ["nth"])
    return table.read().withColumn("price", F.round("price", 2))


def partial_update(spark, d):
    """Two changes of every third customer: the later one supplies a name to even ones alone, the earlier one names all and a segment."""
    old = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    some = _t(spark, d, "customer").filter("c_custkey % 3 = 0")
    early = some.select("c_custkey", F.concat("c_name", F.lit("-")).alias("c_name"), F.lit("early").alias("c_mktsegment"), F.lit(1).alias("nth"))
    late = some.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("*"))).alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"), F.lit(2).alias("nth"))
    return B.partial_update(old, late.union(early), ["c_custkey"], ["nth"])


def cascade_delete(spark, d):
    parents = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    children = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"))
    lines = _t(spark, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("parent_id"))
    a, b, c = B.cascade_delete(parents, children, lines, parents.filter("id % 3 = 0"))
    return a.select(F.lit("parent").alias("level"), F.col("id").cast("string").alias("id")).union(b.select(F.lit("child"), F.col("id").cast("string"))).union(c.select(F.lit("grandchild"), "id"))


def add_missing_columns(spark, d):
    return B.add_missing_columns(_t(spark, d, "nation"), {"n_comment": "string", "n_rank": "bigint"})


_MARKDOWN = r"""
a AS (SELECT page_id, nullif(regexp_extract(html, '(?s)<article(?: [^>]*)?>(.*?)</article>', 1), '') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '\s*\n\s*', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '<h1(?: [^>]*)?>', chr(10) || chr(10) || '# ', 'g'), '<h2(?: [^>]*)?>', chr(10) || chr(10) || '## ', 'g'), '</h[1-6]>|</?(?:p|div|section)(?: [^>]*)?>', chr(10) || chr(10), 'g') AS t FROM b),
e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '<br ?/?>', chr(10), 'g'), '<li(?: [^>]*)?>', chr(10) || '  * ', 'g'), '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', '[\2](\1)', 'g') AS t FROM c),
f AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '</?(?:b|strong)>', '**', 'g'), '</?(?:i|em)>', '_', 'g'), '<[^>]+>', '', 'g') AS t FROM e),
g AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&copy;', '©'), '&amp;', '&') AS t FROM f),
md AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS markdown FROM g)
"""
_SECTIONS = r"""
dm AS (SELECT doc_id, regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '(?m)^([TD])', '## \1', 'g') AS text FROM documents),
sp AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(#{1,3}\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS pieces FROM dm)
"""
#: Cuts x (k, txt) into f (k, n, part): chunks in order.
_FOLD = r"""
pre AS (SELECT k, txt, CASE WHEN starts_with(txt, 'Context:') AND strpos(txt, chr(10) || chr(10)) > 1 THEN substr(txt, 1, strpos(txt, chr(10) || chr(10)) + 1) ELSE '' END AS prefix FROM x),
cut(k, prefix, n, part, rest) AS (
  SELECT k, prefix, 0, '', CASE WHEN prefix <> '' THEN regexp_replace(substr(txt, length(prefix) + 1), '^\s+|\s+$', '', 'g') ELSE txt END FROM pre
  UNION ALL
  SELECT k, prefix, n + 1, regexp_replace(substr(rest, 1, stop), '^\s+|\s+$', '', 'g'), regexp_replace(substr(rest, stop + 1), '^\s+|\s+$', '', 'g') FROM (
    SELECT *, CASE WHEN regexp_matches(w, HEADING) THEN CASE WHEN length(regexp_extract(w, '(?sm)\A(.*)^#{1,6}\s', 1)) > LIMIT * 0.3 THEN length(regexp_extract(w, '(?sm)\A(.*)^#{1,6}\s', 1)) ELSE LIMIT END
      WHEN contains(w, chr(10) || chr(10)) AND length(regexp_extract(w, '(?s)\A(.*)\n\n', 1)) > LIMIT * 0.5 THEN length(regexp_extract(w, '(?s)\A(.*)\n\n', 1)) + 2 ELSE LIMIT END AS stop
    FROM (SELECT *, substr(rest, 1, LIMIT) AS w FROM cut WHERE length(rest) > LIMIT)) AS windows
),
f AS (SELECT k, n, prefix || part AS part FROM cut WHERE part <> '' UNION ALL SELECT k, 1000000 + n, prefix || rest FROM cut WHERE length(rest) <= LIMIT AND rest <> '')
"""
_CHUNKS = _FOLD.replace("LIMIT", "1000").replace("HEADING", r"'(?m)^#{1,6}\s'")
_WINDOWS = _FOLD.replace("LIMIT", "2000").replace("HEADING", "'[^\\s\\S]'")
_RULES = r"""
r AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root_url, min(page_id) AS site_id FROM pages GROUP BY 1),
rules AS (SELECT site_id, root_url, regexp_extract(root_url, '://([^:]*)', 1) AS name, 'body > article' AS container, 'body > nav ul' AS breadcrumb, ['sections', 'tabs', 'whole'][length(root_url) % 3 + 1] AS rule, length(root_url) % 2 = 0 AS crumb_text FROM r),
told AS (SELECT page_id, url, rule, 'Context: ' || array_to_string(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<li>(.*?)</li>', 1), lambda x: trim(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&amp;', '&'))), ' > ') || chr(10) || chr(10) AS context
  FROM pages JOIN rules ON root_url = regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)),
lead AS (SELECT page_id, rule, context, CASE rule WHEN 'sections' THEN 'Accordion Item' || chr(10) || chr(10) || 'Closed Title:' || chr(10) || chr(10) || url || chr(10) || chr(10) WHEN 'tabs' THEN 'How to' || chr(10) || chr(10) || 'Step 1: ' || url || chr(10) || chr(10) || 'Step 2: **end**' || chr(10) || chr(10) ELSE '' END AS first FROM told),
x AS (SELECT page_id AS k, context || first || markdown AS txt FROM lead JOIN md USING (page_id) WHERE markdown <> '')
"""
_SITE_CHUNKS = "WITH RECURSIVE " + _MARKDOWN.replace("f AS (", "f0 AS (").replace("FROM f)", "FROM f0)") + "," + _RULES + "," + _CHUNKS

ORACLES = {
    "keyed_scan": "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7",
    "keyed_scan_limit": "SELECT conv_id, turn, role FROM conversations WHERE role = 'system' ORDER BY conv_id, turn LIMIT 5",
    "content_hash": "SELECT page_id, md5(html) AS content_hash FROM pages",
    "url_host": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages",
    "link_kind": "SELECT page_id, CASE WHEN page_id % 4 = 0 OR page_id % 5 = 0 THEN 'pdf' ELSE 'html' END AS kind FROM pages",
    "internal_links": r"WITH r AS (SELECT url AS src, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT DISTINCT src, root || replace(href, '&amp;', '&') AS url FROM r WHERE href LIKE '/%' UNION SELECT url, unnest([regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/s' || page_id || '?a=1&b=2', regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/u' || page_id, regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || 'd#' || page_id]) FROM pages",
    "html_to_markdown": r"""
WITH a AS (SELECT page_id, nullif(regexp_extract(html, '(?s)<article(?: [^>]*)?>(.*?)</article>', 1), '') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '\s*\n\s*', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '<h1(?: [^>]*)?>', chr(10) || chr(10) || '# ', 'g'), '<h2(?: [^>]*)?>', chr(10) || chr(10) || '## ', 'g'), '</h[1-6]>|</?(?:p|div|section)(?: [^>]*)?>', chr(10) || chr(10), 'g') AS t FROM b),
e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '<br ?/?>', chr(10), 'g'), '<li(?: [^>]*)?>', chr(10) || '  * ', 'g'), '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', '[\2](\1)', 'g') AS t FROM c),
f AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '</?(?:b|strong)>', '**', 'g'), '</?(?:i|em)>', '_', 'g'), '<[^>]+>', '', 'g') AS t FROM e),
g AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&copy;', '©'), '&amp;', '&') AS t FROM f)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS markdown FROM g""",
    "breadcrumbs": r"SELECT page_id, 'Context: ' || array_to_string(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<li>(.*?)</li>', 1), lambda x: trim(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&amp;', '&'))), ' > ') || chr(10) || chr(10) AS context FROM pages",
    "site_rules": "WITH " + _RULES.split("told AS")[0].rstrip().rstrip(",") + " SELECT site_id, root_url, name, container, CASE WHEN length(root_url) % 5 = 0 THEN 'nav#none' ELSE breadcrumb END AS breadcrumb, CASE WHEN length(root_url) % 5 = 0 THEN 'whole' ELSE rule END AS rule, crumb_text FROM rules UNION ALL SELECT -1, 'https://seed.example', 'seed.example', '#main', 'nav', 'tabs', true",
    "section_split": "WITH " + _SECTIONS + " SELECT doc_id, CAST(generate_subscripts(pieces, 1) - 1 AS BIGINT) AS n, length(unnest(pieces)) AS n_chars, md5(unnest(pieces)) AS piece_md5 FROM sp",
    "pack_sections": "WITH " + _SECTIONS + r""",
paras AS (SELECT doc_id, list_transform(pieces, lambda p: list_reduce(list_transform(string_split(p, chr(10) || chr(10)), lambda q: {'done': []::VARCHAR[], 'held': q}), lambda s, q: CASE WHEN length(s.held) + length(q.held) > 1000 AND s.held <> '' THEN {'done': list_append(s.done, regexp_replace(s.held, '^\s+|\s+$', '', 'g')), 'held': q.held} ELSE {'done': s.done, 'held': CASE WHEN s.held <> '' THEN s.held || chr(10) || chr(10) || q.held ELSE q.held END} END)) AS ends, pieces FROM sp),
ready AS (SELECT doc_id, list_transform(list_zip(pieces, ends), lambda z: [z[1]] || CASE WHEN z[2].held <> '' THEN list_append(z[2].done, regexp_replace(z[2].held, '^\s+|\s+$', '', 'g')) ELSE z[2].done END) AS parts FROM paras),
packed AS (SELECT doc_id, list_reduce(parts, lambda s, z: CASE WHEN length(s) > 0 AND length(s[-1]) < 100 THEN s[:-2] || [s[-1] || chr(10) || chr(10) || z[1]] WHEN length(z[1]) > 1000 THEN s || z[2:] ELSE s || [z[1]] END, []::VARCHAR[]) AS pieces FROM ready)
SELECT doc_id, CAST(generate_subscripts(pieces, 1) - 1 AS BIGINT) AS n, unnest(pieces) AS piece FROM packed""",
    "chunk_extracts": "WITH RECURSIVE " + _SECTIONS + ", x AS (SELECT doc_id AS k, text AS txt FROM dm)," + _CHUNKS + r" SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS chunk_index, part AS chunk FROM f WHERE regexp_matches(part, '\S')",
    "extract_windows": "WITH RECURSIVE " + _SECTIONS + ", x AS (SELECT doc_id AS k, text AS txt FROM dm)," + _WINDOWS + " SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS n, 'Context: A' || chr(10) || chr(10) || part AS extract FROM f",
    "pages_to_chunks": _SITE_CHUNKS + " SELECT k AS page_id, 0::BIGINT AS extract_index, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS chunk_index, part AS text FROM f",
    "chunks_replaced": _SITE_CHUNKS + " SELECT k AS page_id, CASE WHEN k % 3 = 0 THEN 1 ELSE count(*) END AS n_chunks, CASE WHEN k % 3 = 0 THEN 0 ELSE count(*) - 1 END AS last FROM f GROUP BY k",
    "pipeline_counts": _SITE_CHUNKS + " SELECT k AS page_id, 1::BIGINT AS n_extracts, count(*) AS n_chunks FROM f GROUP BY k",
    "pipeline_totals": _SITE_CHUNKS + " SELECT 'n_pages' AS name, count(*) AS n FROM pages UNION ALL SELECT 'n_extracts', count(*) FROM x UNION ALL SELECT 'n_chunks', count(*) FROM f UNION ALL SELECT 'n_pending', count(*) FROM f WHERE k % 2 = 1 UNION ALL SELECT 'n_new', count(DISTINCT url) FROM pages WHERE page_id % 11 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 <> 0)",
    "tab_split": "WITH " + _MARKDOWN + "," + _RULES + " SELECT page_id, 0::BIGINT AS part, first || markdown AS text FROM lead JOIN md USING (page_id) WHERE rule = 'tabs'",
    "pending_urls": r"WITH r AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || replace(unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)), '&amp;', '&') AS url FROM pages) SELECT url FROM r WHERE length(url) % 3 <> 0 AND length(url) > 10",
    "pending_of_site": "WITH p AS (SELECT page_id, url, min(page_id) OVER (PARTITION BY regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) AS site_id FROM pages) SELECT DISTINCT url, site_id FROM p WHERE site_id = (SELECT min(site_id) FROM p) AND url NOT IN (SELECT url FROM p WHERE page_id % 2 = 0)",
    "discovered_upsert": "WITH n AS (SELECT url, min(CASE WHEN length(url) % 2 = 0 THEN 'pdf' ELSE 'html' END) AS kind, bool_or(page_id % 2 = 0) AS known FROM pages GROUP BY url) SELECT url, kind, CAST(CASE WHEN known THEN 1 ELSE 2 END AS BIGINT) AS discovered_at FROM n",
    "snapshot_merge": """
WITH o AS (SELECT url, min(md5(html)) AS h FROM pages WHERE page_id % 3 <> 0 GROUP BY url),
n AS (SELECT url, md5(min(CASE WHEN page_id % 5 = 0 THEN html || '<!-- v2 -->' ELSE html END)) AS h FROM pages WHERE page_id % 11 <> 0 GROUP BY url)
SELECT url, coalesce(n.h, o.h) AS content_hash, CAST(CASE WHEN n.h IS NULL THEN 1704067200 ELSE 1706745600 END AS BIGINT) AS scraped_s,
       CAST(CASE WHEN n.h IS NULL OR n.h = o.h THEN 1704067200 ELSE 1706745600 END AS BIGINT) AS changed_s,
       CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'missing' WHEN n.h = o.h THEN 'same' ELSE 'changed' END AS state
FROM o FULL JOIN n USING (url)""",
    "duplicate_content": "WITH p AS (SELECT page_id AS id, md5(html) AS h FROM pages UNION ALL SELECT page_id + 1000000, md5(html) FROM pages WHERE page_id % 7 = 0) SELECT id, min(id) OVER (PARTITION BY h) AS canonical_id, id <> min(id) OVER (PARTITION BY h) AS is_duplicate FROM p",
    "link_frontier": r"""
WITH RECURSIVE r AS (SELECT url AS page, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages),
h AS (SELECT DISTINCT page, regexp_extract(replace(href, '&amp;', '&'), '^([^?#]*)', 1) AS path FROM r WHERE href LIKE '/%' AND NOT regexp_matches(lower(regexp_extract(href, '^([^?#]*)', 1)), '\.(jpg|png|gif|zip)$')),
e AS (SELECT page AS src, path AS dst FROM h UNION ALL SELECT path, page FROM h),
walk AS (SELECT min(url) AS node, 0 AS depth FROM pages UNION SELECT dst, depth + 1 FROM walk JOIN e ON src = node WHERE depth < 16)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY node ORDER BY depth, node LIMIT 400""",
    "unique_violations": "SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root_url, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1",
    "upsert_by_key": "WITH n AS (SELECT o_orderkey * 2 AS o_orderkey, 'U3' AS o_orderstatus, round(CAST(o_totalprice AS DOUBLE) + 3, 2) AS price FROM orders WHERE o_orderkey % 4 = 0) SELECT o_orderkey, o_orderstatus, round(CAST(o_totalprice AS DOUBLE), 2) AS price FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n",
    "partial_update": "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN c_name || '*' WHEN c_custkey % 3 = 0 THEN c_name || '-' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN 'early' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "cascade_delete": "SELECT 'parent' AS level, c_custkey::VARCHAR AS id FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'child', o_orderkey::VARCHAR FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT 'grandchild', l_orderkey || '/' || l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0)",
    "add_missing_columns": "SELECT *, CAST(NULL AS VARCHAR) AS n_comment, CAST(NULL AS BIGINT) AS n_rank FROM nation",
}

QUERIES = {name: globals()[name] for name in ORACLES}
ORACLES = {name: sql for name, sql in ORACLES.items() if sql}
