"""Cutting of long texts, character references and links."""

import html as stdlib_html
import re
import time

from pyspark.sql import functions as F

from lanternflow.functions import markup as M
from lanternflow.functions import text as T

from test_text import one


def took(spark, text, column):
    df = spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("c")).select(F.size("c").alias("n"))
    began = time.time()
    return df.first()["n"], time.time() - began


def test_long_texts_are_cut_in_linear_time(spark):
    for piece in ("word and more words\n\n" * 20 + "## h\n", "no break at all "):
        for column in (M.chunk_extract, lambda c: M.extract_windows(c, F.lit("P"), 2000)):
            text = (piece * 200_000)[:1_600_000]
            took(spark, text[:100_000], column)  # loads classes
            n, seconds = took(spark, text, column)
            twice, longer = took(spark, text * 2, column)
            assert n < twice <= 2 * n + 2
            # Copies of all that is left for each part would take hundreds of times the first figure.
            assert longer < 12 * max(seconds, 0.3)


def cut(text, limit, least):
    """Windows as they are defined: one after the other, from what is left."""
    out = []
    while len(text) > limit:
        at = text.rfind("\n\n", 0, limit)
        at = at + 2 if at > limit * 0.5 else limit
        out += [text[:at].strip()] if text[:at].strip() else []
        text = text[at:].strip()
    return out + ([text] if text else [])


def test_windows_over_pieces(spark):
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choice(["ab ", "\n\n", "é" * 40, " " * 30, "\n", "  "]) for _ in range(rng.randrange(0, 1500))) for _ in range(30)]
    texts += [" " * 20_000, "x" + " " * 9_000 + "y", " " * 5000 + "x" * 4096 + "\n\n" + " " * 4096, "a" * 90 + " " * 30, "\n\n" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", M.extract_windows(F.col("t"), F.lit(""), 100).alias("c")).collect()
    for r in rows:
        assert r["c"] == cut(texts[r["i"]], 100, 0.5), r["i"]


def test_strip(spark):
    for text in ("  a b \n", "", "\x85　", "x", " \t"):
        assert one(spark, text, T.strip) == text.strip()


def test_character_references(spark):
    for text in ("a &lt;b&gt; &amp;amp; &eacute;&#8212;&#x1F600; & x &#0; &#xD800; &#99999999; &nbsp;|&quot;&#39;&NotEqualTilde;", "&unknown; &; && &#; &#x; &#xZ;", "plain", ""):
        assert one(spark, text, M.decode_entities) == stdlib_html.unescape(text)
    assert one(spark, None, M.decode_entities) is None


def test_links_in_any_form(spark):
    page = """<A HREF='/x'>1</A><a href=/y>2</a><a href="/z">3</a><!-- <a href="/no">4</a> --><a
 class="b c" title="a href='/no' >" href = "/q?a=1&amp;b=2">5</a><a data-href="/no">6</a><abbr href="/no">7</abbr>
 <script>var s='<a href="/no">';</script><a name=n href>8</a><a/href=/w>9</a><textarea><a href=/no></textarea><a href="/v" href="/no"><b>10</b></a><!-- open <a href="/no">"""
    assert one(spark, page, M.hrefs) == ["/x", "/y", "/z", "/q?a=1&b=2", "", "/w", "/v"]
    assert one(spark, None, M.hrefs) == one(spark, "", M.hrefs) == []
    many = "<a href='/x' title=\"y\">t</a> &eacute; " * 20_000
    assert len(one(spark, many, M.hrefs)) == 20_000
    wide = "<a " + 'x="y" ' * 3000 + "href='/u'>"
    assert one(spark, wide, M.hrefs) == ["/u"]


def shown(spark, html):
    return one(spark, html, M.to_markdown)


def test_markdown_of_lists_tables_and_links(spark):
    assert shown(spark, "<ol><li>one</li><li class=x>two</li></ol><p>and</p><ul><li>x</li></ul><OL><LI>again</OL>") == "1. one\n  2. two\n\nand\n\n  * x\n  1. again"
    assert shown(spark, "a<table><tr><th>h1</th><th>h2</th></tr>\n<tr><td>1</td> <td>2</td></tr></table>b") == "a\n\nh1 | h2\n 1 | 2\n\nb"
    assert shown(spark, "a<pre>x\n  y</pre>b\nc") == "a\n\n    x\n      y\n\nb c"
    assert shown(spark, "<A HREF='/u'>l</A> <a name=n>no</a> <a href=/v title='>'>v</a> <img src=/i.png alt=\"p &eacute;\"><img alt=q src='/j'><IMG SRC=/k>") == "[l](/u) no [v](/v) ![p é](/i.png)![q](/j)![](/k)"
    assert shown(spark, "1 &lt; 2 &#8212; &lt;b&gt; 3 < 4<hr>x<code>y</code>") == "1 < 2 — <b> 3 < 4\n\n* * *\n\nx`y`"
    assert shown(spark, "<p>a<!-- <b>no</b> --></p><script>no</script><style>no</style><!-- open") == "a"
    assert shown(spark, None) is None and shown(spark, "") == ""


def test_containers_that_nest(spark):
    for html, want in (("<article>a<article>b</article>c</article>d", "a<article>b</article>c"), ("<ARTICLE class=x>q</ARTICLE>", "q"), ("<article>open", "open"), ("<article></article>", None), ("<articles>no</articles>", None), (None, None)):
        assert one(spark, html, M.container) == want
