"""Discovery and capture of pages as incremental table work.

pages: page_id, url, html, content_hash, last_scraped, last_changed. links: src, dst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.functions import markup as M
from lanternflow.functions import urls as U
from lanternflow.sources.scratch import scratch_path


def pending(discovered: DataFrame, pages: DataFrame, url_filter: Column | None = None, site_id: int | None = None) -> DataFrame:
    """Discovered urls that are not captured yet, and that the filter lets through; with site_id, those of that site (column site_id) alone."""
    if site_id is not None:
        discovered = discovered.filter(F.col("site_id") == site_id)
    out = discovered.join(pages.select("url"), "url", "left_anti")
    return out if url_filter is None else out.filter(url_filter)


def internal_links(pages: DataFrame, root: Column) -> DataFrame:
    """src and url of the distinct links of each page that stay on the root's site and lead to no asset."""
    found = pages.select(F.col("url").alias("src"), root.alias("root"), F.explode(M.hrefs(F.col("html"))).alias("href"))
    full = found.withColumn("full", U.resolve(F.col("href"), F.col("src"))).filter("full is not null")
    kept = full.filter(U.same_site(F.col("full"), F.col("root"))).select("src", U.canonical(F.col("full"), F.col("root")).alias("url"))
    return kept.filter(~U.is_asset(F.col("url"))).distinct()


def discovered_upsert(old: DataFrame, found: DataFrame) -> DataFrame:
    """url, kind, discovered_at: new urls are added, a changed kind replaces the old one, the first time stays."""
    new = found.groupBy("url").agg(F.min_by("kind", "discovered_at").alias("new_kind"), F.min("discovered_at").alias("seen"))
    return old.join(new, "url", "full").select("url", F.coalesce("new_kind", "kind").alias("kind"), F.coalesce("discovered_at", "seen").alias("discovered_at"))


def snapshot_merge(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Captures after a scrape (url, html): new ones enter, changed ones get the new html and both times, others only last_scraped."""
    fresh = new.select("url", F.col("html").alias("new_html"), F.md5("html").alias("new_hash"))
    joined = old.join(fresh, "url", "full")
    seen = F.col("new_hash").isNotNull()
    change = seen & ~F.col("new_hash").eqNullSafe(F.col("content_hash"))
    return joined.select(
        "url",
        F.when(change, F.col("new_html")).otherwise(F.col("html")).alias("html"),
        F.when(change, F.col("new_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(seen, now).otherwise(F.col("last_scraped")).alias("last_scraped"),
        F.when(change, now).otherwise(F.col("last_changed")).alias("last_changed"),
        F.when(F.col("content_hash").isNull(), F.lit("new")).when(change, F.lit("changed")).when(seen, F.lit("same")).otherwise(F.lit("missing")).alias("state"),
    )


def duplicate_content(pages: DataFrame) -> DataFrame:
    """Each capture (id, url, html) with the first one of equal content, and whether it is a duplicate.

    The first one is found by aggregation, and only content that repeats is joined back; null content is content like other.
    """
    hashed = pages.select("id", "url", F.coalesce(F.md5("html"), F.lit("")).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = hashed.join(first, "hash", "left").withColumn("canonical_id", F.coalesce("first_id", "id"))
    return joined.select("id", "url", "hash", "canonical_id", (F.col("id") != F.col("canonical_id")).alias("is_duplicate"))


#: Parts of the stored links, and bits of the filter of visited nodes (128 KB to 16 MB).
LINK_PARTS, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 27


def _maybe_in(rows: DataFrame, column: str, bits: DataFrame, n_bits: int) -> DataFrame:
    """rows with maybe: whether a filter of visited nodes has the node. bits: its blocks of 32,768 bits as 512 longs, n_bits / 32768 rows at most."""
    place = F.pmod(F.xxhash64(column), F.lit(n_bits))
    marked = rows.withColumn("place", place).withColumn("block", F.expr("place div 32768")).join(F.broadcast(bits), "block", "left")
    shift = ((F.lit(7) - F.expr("(place % 64) div 8")) * 8 + F.expr("place % 8")).cast("int")
    hit = F.call_function("shiftrightunsigned", F.get("words", F.expr("cast((place % 32768) div 64 as int)")), shift).bitwiseAND(F.lit(1)) == 1
    return marked.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("place", "block", "words")


def _bits(nodes: DataFrame, column: str, n_bits: int) -> DataFrame:
    place = nodes.select(F.pmod(F.xxhash64(column), F.lit(n_bits)).alias("p"))
    blocks = place.groupBy(F.expr("p div 32768").alias("block")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits"))
    return blocks.select("block", F.expr("transform(sequence(0, 511), k -> cast(conv(hex(substring(bits, k * 8 + 1, 8)), 16, -10) as bigint))").alias("words"))


def link_frontier(links: DataFrame, root: str, max_pages: int) -> DataFrame:
    """node and depth of the first max_pages nodes from the root, breadth first, by (depth, node).

    Links (src, dst) are written once, in parts by the hash of their source; a level reads the parts of its nodes alone. A filter of visited
    nodes, of bounded size, lets new nodes pass before anything is exchanged; only those that it may have seen are compared with
    the levels before. Each level is written, so the plan does not grow with the depth. It ends when a level is empty or enough nodes are seen.
    """
    spark = links.sparkSession
    path = scratch_path(spark, "frontier")
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(LINK_PARTS)).cast("int")
    edges = links.select("src", "dst").filter("src is not null and dst is not null").withColumn("part", part("src"))
    edges.repartitionByRange("part", "src", "dst").sortWithinPartitions("part", "src").write.partitionBy("part").parquet(f"{path}/links")
    stored = spark.read.schema("src string, dst string, part int").parquet(f"{path}/links")
    kind = "node string, depth int"
    level = lambda *k: spark.read.schema(kind).parquet(*(f"{path}/level={j}" for j in k))
    spark.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("depth")).write.parquet(f"{path}/level=0")
    depth, count, new = 0, 1, 1
    while new and count < max_pages:
        depth += 1
        front = level(depth - 1).select(F.col("node").alias("src"), part("node").alias("part"))
        parts = [r["part"] for r in front.select("part").distinct().collect()]  # LINK_PARTS at most
        n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * count + 1).bit_length()))
        reached = stored.filter(F.col("part").isin(parts)).join(front, ["part", "src"]).select(F.col("dst").alias("node"))
        seen = level(*range(depth))
        marked = _maybe_in(reached, "node", _bits(seen, "node", n_bits), n_bits)
        fresh = marked.filter("not maybe").select("node").unionByName(marked.filter("maybe").select("node").join(seen, "node", "left_anti"))
        fresh.distinct().select("node", F.lit(depth).alias("depth")).write.parquet(f"{path}/level={depth}")
        new = level(depth).count()
        count += new
    return level(*range(depth + 1)).orderBy("depth", "node").limit(max_pages)
