"""Pages to extracts to chunks, by the rules of their site."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.functions import elements as E
from lanternflow.functions import markup as M
from lanternflow.functions import text as T
from lanternflow.operators.tables import upsert

#: Rules of a site. container and breadcrumb are selectors of tags, #ids and .classes, joined by blanks and >; rule is
#: sections (accordions, then headings), tabs (tabs, then headings) or whole; crumb_text: a breadcrumb without items is cut at >.
SITE_RULES = "site_id long, root_url string, name string, container string, breadcrumb string, rule string, crumb_text boolean"
_PARTS = "page_id long, rule string, body string, intro string, steps array<struct<n:string,html:string>>, items array<string>, crumbs array<string>"
#: Fixed value: what stands between the items of an accordion.
_ITEM = "\n\nAccordion Item\n\nClosed Title:"
#: Pages whose parts a task holds at once.
_SLICE = 100


def seed_rules(rules: DataFrame, seeds: DataFrame) -> DataFrame:
    """The rules after seeding: a seed replaces the rule of its site, others are added."""
    return upsert(rules, seeds, ["site_id"])


def _parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The parts that the rules name, as source. A page without its container gives no row."""
    for f in (f[at : at + _SLICE] for f in frames for at in range(0, len(f), _SLICE)):
        rows = []
        for page_id, html, container, breadcrumb, rule, crumb_text in f.itertuples(index=False):
            page = E.Page(html or "")
            box = next(page.select(container), None)
            if box is None:
                continue
            intro, steps, items, gone = None, [], [], []
            if rule == "sections":
                gone = E.accordions(page, box)
                items = [page.outer(e) for e in gone]
            elif rule == "tabs":
                intro, steps, gone = E.tabs(page, box)
            body = page.without(box, gone)
            rows.append((page_id, rule, body, intro, [{"n": n, "html": h} for n, h in steps], items, E.crumbs(page, breadcrumb, bool(crumb_text))))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _PARTS.split(", ")])


def _native(joined: DataFrame) -> Column:
    """Whether a page's parts are found without a parser: plain tags for selectors, no tabs, nothing like an accordion, tags that are what they seem."""
    html, box, nav = F.col("html"), F.col("container"), F.col("breadcrumb")
    no_crumbs = F.coalesce(F.trim(nav) == "", F.lit(True))
    crumbs = no_crumbs | (M.is_tag(nav) & M.plain_elements(html, nav) & F.coalesce(M.plain_items(M.own_part(html, nav)), F.lit(True)))
    simple = (F.col("rule") != "tabs") & ((F.col("rule") != "sections") | ~html.rlike(r"(?i)<details|accordion|collapse"))
    return F.coalesce(M.is_tag(box) & simple & M.plain_elements(html, box) & crumbs, F.lit(False))


def page_parts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The parts of each page (page_id, site_id, html) that its site's rules name: body, intro, steps of tabs, accordion items and breadcrumbs.

    Where container and breadcrumb are plain tags and the page's tags are what they seem, all of it is native; other pages go through a parser in
    tasks. Native, an element ends at its own end tag, also where tags are not nested.
    """
    if "crumb_text" not in rules.columns:
        rules = rules.withColumn("crumb_text", F.lit(False))
    joined = pages.select("page_id", "site_id", "html").join(rules.select("site_id", "container", "breadcrumb", "rule", "crumb_text"), "site_id")
    joined = joined.select("page_id", "html", "container", "breadcrumb", "rule", "crumb_text")
    native = _native(joined)
    none = lambda kind: F.array().cast(kind)
    nav = F.when(F.trim("breadcrumb") != "", M.own_part(F.col("html"), F.col("breadcrumb")))
    plain = joined.filter(native).select(
        "page_id",
        "rule",
        M.own_part(F.col("html"), F.col("container")).alias("body"),
        F.lit(None).cast("string").alias("intro"),
        none("array<struct<n:string,html:string>>").alias("steps"),
        none("array<string>").alias("items"),
        M.crumb_items(nav, F.coalesce("crumb_text", F.lit(False))).alias("crumbs"),
    )
    return plain.filter("body is not null").unionByName(joined.filter(~native).mapInPandas(_parts, _PARTS))


def _filled(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, T.strip), lambda x: x != "")


def pieces(min_len: int = 100, max_len: int = 100_000) -> Column:
    """The packed pieces of a page's parts: accordion items, or introduction and steps of tabs, then what lies between headings."""
    items = _filled(F.flatten(F.transform("items", lambda x: F.split(M.to_markdown(x), _ITEM))))
    steps = F.transform("steps", lambda x: F.struct(x["n"].alias("n"), T.strip(M.to_markdown(x["html"])).alias("text")))
    told = F.transform(F.filter(steps, lambda x: x["text"] != ""), lambda x: F.concat(F.lit("Step "), x["n"], F.lit(": "), x["text"]))
    first = F.array_join(F.concat(F.filter(F.array("intro"), lambda x: x.isNotNull()), told), "\n\n")
    lead = F.when(F.col("rule") == "tabs", _filled(F.array(first))).otherwise(items)
    return M.pack_sections(F.concat(lead, M.split_headings(M.to_markdown(F.col("body")))), min_len, max_len)


def extracts(pages: DataFrame, rules: DataFrame, limit: int = 100_000) -> DataFrame:
    """page_id, extract_index and text of the pages (page_id, site_id, html) of known sites.

    The breadcrumb stands before each extract. A page without its container gives no rows.
    """
    context = F.when(F.size("crumbs") > 0, F.concat(F.lit("Context: "), F.array_join("crumbs", " > "), F.lit("\n\n"))).otherwise(F.lit(""))
    whole = F.when(F.col("rule").isin("sections", "tabs"), F.array_join(pieces(), "\n\n")).otherwise(M.to_markdown(F.col("body")))
    texts = page_parts(pages, rules).select("page_id", whole.alias("whole"), context.alias("context"))
    return texts.select("page_id", F.posexplode(M.extract_windows(F.col("whole"), F.col("context"), limit)).alias("extract_index", "text"))


def chunks(rows: DataFrame, limit: int = 1000) -> DataFrame:
    """page_id, extract_index, chunk_index and text."""
    return rows.select("page_id", "extract_index", F.posexplode(M.chunk_extract(F.col("text"), limit)).alias("chunk_index", "text"))


def pages_to_chunks(pages: DataFrame, rules: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """All chunks anew; or, with old ones, all chunks of the given pages of known sites replaced, however many they had."""
    new = chunks(extracts(pages, rules))
    if old is None:
        return new
    again = pages.join(rules.select("site_id"), "site_id", "left_semi").select("page_id").distinct()
    return old.join(again, "page_id", "left_anti").unionByName(new)


def pipeline_totals(pages: DataFrame, extracts: DataFrame, chunks: DataFrame, embedded: DataFrame, captured: DataFrame) -> DataFrame:
    """One row: pages, extracts and chunks in all, chunks without a vector (embedded: chunk_id), and captures that are new (state)."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    waiting = chunks.join(embedded.select("chunk_id"), "chunk_id", "left_anti")
    parts = [count(pages, "n_pages"), count(extracts, "n_extracts"), count(chunks, "n_chunks"), count(waiting, "n_pending"), count(captured.filter("state = 'new'"), "n_new")]
    rows = parts[0].select(F.lit("n_pages").alias("name"), F.col("n_pages").alias("n"))
    for part in parts[1:]:
        rows = rows.union(part.select(F.lit(part.columns[0]).alias("name"), F.col(part.columns[0]).alias("n")))
    return rows


def tab_split(pages: DataFrame, rules: DataFrame, max_len: int = 1000) -> DataFrame:
    """page_id, part and text of the packed pieces of the pages of sites with tabs."""
    parts = page_parts(pages, rules.filter("rule = 'tabs'"))
    return parts.select("page_id", F.posexplode(pieces(100, max_len)).alias("part", "text")).withColumn("part", F.col("part").cast("long"))
