"""Conversation prefix trie by fixed-length block hashing.

1. A turn is the digest of its role and text, and its length; texts go no further. A rebuilt conversation streams through one
   task in order of its turns, BLOCK turns a block; a block's key is the hash of the key before it and its turns.
2. Conversations are grouped by block keys. All members of a block share what comes before it.
3. Where one block alone follows a key, its inner nodes have the block's members: they are read off. Only where siblings diverge are
   turn boundaries refined: one row of each different block, with its counts, is unfolded turn by turn and grouped anew.
4. Sums over a subtree need no walk of the tree. Each node is owned by its smallest member, so a conversation owns the nodes of its path
   from some depth on. With W the code points of a conversation's turns that it does not own, a subtree saves the sum of W over its
   members, less the W of its owner, less (members - 1) times the code points before it; its leaves are those that its members own.
5. The ids of equal conversations are sorted by ranges and joined to pieces where they lie; the pieces of a node are hashed in order.

Counts are aggregated before the shuffle, and keys of many children are joined apart. A conversation's chain of keys, and a digest
of many ids, can only be made from beginning to end: each streams through one task, which holds no more than a block or a piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternflow.llm.shared import hot_join, materialise

#: Turns of a block.
BLOCK = 4
#: The turns of a conversation that others may begin with, and the conversations that share them.
MOST_SHARED, FAMILY = 5, 100
_ROOT = b""
_PIECE_IDS = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 0), digest and chars of each turn, by turn (null first), role and text. Rows without a conv_id are no conversation's."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id is not null")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.select("conv_id", "turn", digest.alias("digest"), F.length("text").cast("long").alias("chars"), "role", F.substring("text", 1, 64).alias("begin"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "begin", "digest")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("i"), "digest", "chars")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations, and all conv_ids: a conversation begins with the first h turns of its family's first one."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    ids = rows.select("conv_id").distinct()
    own = rows.filter((F.col("i") >= h) | (base == F.col("conv_id")))
    first = rows.filter((F.col("conv_id") % FAMILY == 0) & (F.col("i") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    heirs = ids.filter(F.col("conv_id") % FAMILY != 0).select("conv_id", base.alias("base"), h.alias("h"))
    return own.unionByName(first.join(heirs, "base").filter(F.col("i") < F.col("h")).select(*own.columns)), ids


def _key(parent: Column, digests: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(parent, digests), 256), 1, 32))


_BLOCKS = "conv_id long, level long, parent binary, child binary, digests binary, chars array<long>, before long, total long, end binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of conversations whose turns come in order. end: the key of a conversation's last node, in its last block."""
    own: int | None = None
    key, before, level, seen, digests, chars = _ROOT, 0, 0, 0, [], []
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    for batch in batches:
        out = []
        for conv, digest, n, total, count in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != own:
                own, key, before, level, seen, digests, chars = conv, _ROOT, 0, 0, 0, [], []
            digests.append(digest)
            chars.append(n)
            seen += 1
            if len(digests) == BLOCK or seen == count:
                joined = b"".join(digests)
                child = hashlib.sha256(key + joined).digest()[:16]
                out.append((conv, level, key, child, joined, chars, before, total, child if seen == count else None))
                key, before, level, digests, chars = child, before + sum(chars), level + 1, [], []
        if out:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def blocks(seq: DataFrame) -> DataFrame:
    whole = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = seq.select("conv_id", "digest", "chars", F.sum("chars").over(whole).alias("total"), F.count("*").over(whole).alias("n"))
    return rows.mapInArrow(_blocks, _BLOCKS)


def _unfolded(groups: DataFrame, *columns: str) -> DataFrame:
    """A row for each turn of each block: key, pkey (of the node before it), depth, chars, before, and the given columns."""
    rows = groups.select("*", F.posexplode("chars").alias("j", "own"))
    cut = lambda n: F.substring("digests", F.lit(1), n * 32)
    inner = F.aggregate(F.slice("chars", F.lit(1), F.col("j")), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(
        _key(F.col("parent"), cut(F.col("j") + 1)).alias("key"),
        F.when(F.col("j") == 0, F.col("parent")).otherwise(_key(F.col("parent"), cut(F.col("j")))).alias("pkey"),
        (F.col("level") * BLOCK + F.col("j") + 1).alias("depth"),
        F.col("own").alias("chars"),
        (F.col("before") + inner).alias("before"),
        *columns,
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring ids of one key (both in order) as pieces of text."""
    own: bytes | None = None
    ids: list[int] = []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "first", "piece"])

    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (key != own or len(ids) == _PIECE_IDS):
                yield piece()
                ids = []
            own = key
            ids.append(conv)
    if ids:
        yield piece()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the pieces of each key, which come in order."""
    own: bytes | None = None
    sha = hashlib.sha256()
    for batch in batches:
        out = []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own is not None and key != own:
                out.append((own, sha.hexdigest()))
            if key != own:
                own, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["key", "ends"])
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "ends"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """key and ends: SHA-256 of the ascending, comma-joined ids (conv_id) of each key."""
    pieces = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, first long, piece string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "piece").mapInArrow(_joined, "key binary, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Null roles and texts are empty; rows without a conv_id belong to no conversation. Rows of equal turn are ordered by role,
    the text's beginning and its digest; repeated rows are turns like others. Very long texts are hashed where they are read, very long
    conversations stream. Other columns are not read. Without any conversation there is no node, not even a root.
    """
    seq, ids = rebuilt(materialise(turns(conversations), "turns"))
    parts = materialise(blocks(seq), "blocks")
    ids = materialise(ids, "conversations")

    groups = parts.groupBy("level", "parent", "child").agg(F.count("*").alias("n"), F.min("conv_id").alias("m"), F.first("digests").alias("digests"), F.first("chars").alias("chars"), F.first("before").alias("before"))
    groups = materialise(groups, "groups")
    siblings = materialise(groups.groupBy("parent").agg(F.count("*").alias("c")), "siblings")
    groups = materialise(hot_join(groups, siblings, "parent", "c").withColumn("diverge", F.col("c") > 1).drop("c"), "diverging")

    rows = _unfolded(groups, "n", "m", "diverge")
    names = ["key", "pkey", "depth", "n", "m", "chars", "before"]
    refined = rows.filter("diverge").groupBy("key", "pkey", "depth").agg(F.sum("n").alias("n"), F.min("m").alias("m"), F.first("chars").alias("chars"), F.first("before").alias("before"))
    zero, root = F.lit(0).cast("long"), F.lit(bytearray(_ROOT))
    top = ids.agg(F.count("*").alias("n"), F.min("conv_id").alias("m")).filter("n > 0").select(root.alias("key"), F.lit(None).cast("binary").alias("pkey"), zero.alias("depth"), "n", "m", zero.alias("chars"), zero.alias("before"))
    nodes = materialise(rows.filter("not diverge").select(*names).unionByName(refined.select(*names)).unionByName(top), "nodes")

    kids = nodes.filter("pkey is not null").groupBy(F.col("pkey").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", zero)), "counted")
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("pkey"), F.col("m").alias("parent_conv_id"), F.col("n_children").alias("c"))
    named = hot_join(nodes, materialise(parents, "parents"), "pkey", "c", "left").drop("c")

    owned = nodes.groupBy(F.col("m").alias("conv_id")).agg(F.sum("chars").alias("s"), F.count_if(F.col("n_children") == 0).alias("leaf"))
    totals = parts.filter("level = 0").select("conv_id", "total")
    attrs = ids.join(totals, "conv_id", "left").join(owned, "conv_id", "left")
    attrs = materialise(attrs.select("conv_id", (F.coalesce("total", zero) - F.coalesce("s", zero)).alias("w"), F.coalesce("leaf", zero).alias("leaf")), "owners")

    sums = [F.sum("w").alias("w"), F.sum("leaf").alias("leaf")]
    whole = parts.select("child", "conv_id").join(attrs, "conv_id").groupBy("child").agg(*sums)
    again = _unfolded(groups.join(whole, "child"), "w", "leaf", "diverge").select("key", "w", "leaf", "diverge")
    again = again.filter("not diverge").select("key", "w", "leaf").unionByName(again.filter("diverge").groupBy("key").agg(*sums)).unionByName(attrs.agg(*sums).select(root.alias("key"), "w", "leaf"))

    last = parts.filter("end is not null").select("conv_id", F.col("end").alias("key"))
    turnless = ids.join(totals, "conv_id", "left_anti").select("conv_id", root.alias("key"))
    ends = ends_digest(materialise(last.unionByName(turnless), "ends"))

    out = named.join(again, "key").join(ends, "key", "left").join(attrs.select(F.col("conv_id").alias("m"), F.col("w").alias("own_w")), "m")
    return out.select(
        F.col("m").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaf").alias("n_leaves"),
        (F.col("w") - F.col("own_w") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


#: All prefixes of all rebuilt conversations, grouped; subtrees by the prefixes of each node.
ORACLE = """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)
), seq AS (
  SELECT c, i, role, text FROM t JOIN ids USING (c) WHERE i >= h OR c % 100 = 0
  UNION ALL SELECT ids.c, i, role, text FROM ids JOIN t ON t.c = ids.c - ids.c % 100 AND i < h WHERE ids.c % 100 <> 0
), s AS (
  SELECT ids.c, coalesce(list({'r': role, 't': text} ORDER BY i) FILTER (role IS NOT NULL), []) AS turns FROM ids LEFT JOIN seq ON seq.c = ids.c GROUP BY ids.c
), p AS (
  SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM s
), n AS (
  SELECT d, turns[1:d]::VARCHAR AS k, turns[1:d] AS path, min(c) AS m, count(*) AS n, coalesce(length(any_value(turns[d].t)), 0) AS chars, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(turns) = d), '') AS ends FROM p GROUP BY ALL
), up AS (
  SELECT k, m, n, chars, d, path, unnest(range(0, d + 1)) AS a FROM n
), kids AS (
  SELECT path[1:d - 1]::VARCHAR AS k, d - 1 AS d, count(*) AS c FROM n WHERE d > 0 GROUP BY ALL
), sub AS (
  SELECT up.path[1:a]::VARCHAR AS k, a AS d, sum((n - 1) * chars) AS saved, count(*) FILTER (kids.k IS NULL) AS leaves FROM up LEFT JOIN kids ON kids.k = up.k AND kids.d = up.d GROUP BY ALL
)
SELECT n.m AS conv_id, n.d AS depth, above.m AS parent_conv_id, n.n AS n_convs, coalesce(kids.c, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN sub ON sub.k = n.k AND sub.d = n.d LEFT JOIN kids ON kids.k = n.k AND kids.d = n.d LEFT JOIN n AS above ON above.d = n.d - 1 AND above.k = n.path[1:n.d - 1]::VARCHAR"""
