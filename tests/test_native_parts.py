"""Parts of pages found natively are those that the parser finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternflow.operators import parsing as P

NAV = "<nav class='b'><ul><li><a href='/'>Home</a></li><li> A &amp; <b>B</b></li></ul></nav>"
PAGES = [
    NAV + "<article id=x><p>one</p><article>in</article> two</article><article>no</article>",
    NAV + "<!-- <article>c</article> --><article>real</article>",
    NAV + "<script>'<article>'</script><ARTICLE\nclass=\"m\">up</ARTICLE >",
    "<nav>Home > Docs &gt; X</nav><article></article>",
    "<nav><li>A<li>B</nav><article>open items</article>",
    "<article title='<article>'>quoted</article>",
    "<article data-x='a>b'>angle</article>",
    "<article>never closed",
    "<section>none</section>",
    "</article><article>late</article>",
    "<article><details><summary>Accordion Item</summary>Closed Title</details> rest</article>",
    "",
    None,
]


def test_native_parts(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")
    for rule in ("whole", "sections"):
        for nav in ("nav", None):
            for from_text in (False, True):
                rules = spark.createDataFrame([(1, "r", "n", "article", nav, rule, from_text)], P.SITE_RULES)
                given = pages.withColumn("site_id", F.lit(1).cast("long"))
                joined = given.join(rules.select("site_id", "container", "breadcrumb", "rule", "crumb_text"), "site_id").drop("site_id")
                parsed = joined.select("page_id", "html", "container", "breadcrumb", "rule", "crumb_text").mapInPandas(P._parts, P._PARTS)
                want = {r["page_id"]: r for r in parsed.collect()}
                assert {r["page_id"]: r for r in P.page_parts(given, rules).collect()} == want
    native = {r[0] for r in joined.filter(P._native(joined)).select("page_id").collect()}
    assert {0, 3} <= native and not native & {1, 2, 5, 6, 7, 10}


def test_parts_come_in_slices():
    """A task hands on the parts of few pages at a time, however large Spark's batch is."""
    import pandas as pd

    pages = pd.DataFrame([(k, "<main>x</main>", "main", "", "whole", False) for k in range(950)])
    out = list(P._parts(iter([pages])))
    assert max(map(len, out)) <= 100 and [x for f in out for x in f["page_id"]] == list(range(950))
