"""N-gram Jaccard join: connected classes of documents whose five-word shingle sets overlap by 0.8 or more.

1. One pass over the texts makes, for each document, the size and digest of its shingle set, a hashed
   bitmap whose width grows with the set, and 40 keys, each of four minimum hashes. Two sets at the
   threshold share no key with a probability of (1 - 0.8**4)**40 = 7e-10. Equal sets are one node from here on.
2. The sets of a key are cut into size bands; a set links only with sizes of its own and the two next bands.
   All pairs are found in tiles of a part of a band against a part of such a band, or of a whole key if it is no larger than a part: the bitmaps bound the overlap
   from above, (|A| + |B| - differing bits) / 2, and what the bound leaves is verified on the sorted shingle arrays.
3. Leader tiles come first: one set of each band of a key (its leader) against all sets of the bands next to it. Of the
   leaders that the bound leaves to a set, the closest is verified. That joins nearly all of a large group.
4. Full tiles follow for all sets that share a key and still lie in different classes. Sets of the key's largest
   class need not meet each other, so only the others (strays) are dealt out over all parts. First each tile
   gives a spanning forest of its classes by its closest pairs, as long as that links classes; then all pairs of different
   classes that the bitmaps leave, but for those that were verified. No pair is dropped; pairs inside one class are not needed.
5. Classes are the connected components of all verified links (alternating large and small stars).

Counts and leaders of keys are aggregated before the shuffle, and frequent keys are joined apart, so no task holds
all sets of a key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.llm import shared
from lanternflow.llm.shared import drop_rows, hot_join, mix, popcount, row_key, shingle_runs, small_batches, split_by_bitmap

BANDS, ROWS = 40, 4
#: Two documents link when 100 * |intersection| >= PERCENT * |union|.
PERCENT = 80
#: Rows of a part of a band, and of a leader's tile.
TILE_ROWS, LEADER_ROWS = 512, 128
#: Width of a bitmap: this many bits for each shingle, rounded up to a power of two. Wider ones bound closer.
BITS_PER_SHINGLE = 4
_MIN_BITS, _MAX_BITS = 64, 1 << 18
_CHUNK = 1 << 19


def materialise(df: DataFrame, name: str) -> DataFrame:
    """A written table in Zstandard. The default codec takes buffers outside the heap, which many short tasks leave behind until the heap is collected."""
    return shared.materialise(df, name, "zstd")


_MULTIPLIERS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def enough(both: int, a: int, b: int) -> bool:
    return 100 * both >= PERCENT * (a + b - both)


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit for each shingle, at its hash modulo a power of two."""
    width = min(_MAX_BITS, max(_MIN_BITS, 1 << (BITS_PER_SHINGLE * len(shingles) - 1).bit_length()))
    bits = np.zeros(width, dtype=bool)
    bits[(shingles % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _least_hashes(runs: list[np.ndarray]) -> np.ndarray:
    """The keys of non-empty shingle sets, BANDS for each."""
    every = np.concatenate(runs)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])[:-1]])
    keys = np.zeros((len(runs), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(runs), band + 1, dtype=np.uint64)
        for m in _MULTIPLIERS[band * ROWS : (band + 1) * ROWS]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(every * m, starts))
        keys[:, band] = key
    return keys.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


_SIGNED = "n long, digest binary, sig binary, keys array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of text and other columns: the other columns and what _SIGNED names."""
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    for batch in small_batches(batches, 0, _CHUNK):
        runs = shingle_runs([(t or "").encode() for t in batch.column(0).to_pylist()])
        full = [k for k, r in enumerate(runs) if len(r)]
        keys = dict(zip(full, _least_hashes([runs[k] for k in full]))) if full else {}
        rows = []
        for k, run in enumerate(runs):
            run = np.unique(run)
            rows.append((len(run), _digest(run), bitmap(run), keys[k]) if len(run) else (0, None, None, None))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*batch.schema.names[1:], "n", "digest", "sig", "keys"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 0, _CHUNK):
        sets = [np.unique(r) for r in shingle_runs([(t or "").encode() for t in batch.column(0).to_pylist()])]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(r) for r in sets], pa.binary()), pa.array([r.tobytes() for r in sets], pa.binary())], names=["digest", "shingles"])


def _differing(a: bytes, b: bytes) -> int:
    """Differing bits of two bitmaps, the wider one folded to the width of the other."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    if len(a) != len(b):
        (x, wide), (y, narrow) = sorted([(x, len(a)), (y, len(b))], key=lambda p: -p[1])
        while wide > narrow:
            wide //= 2
            x = (x >> (8 * wide)) | (x & ((1 << (8 * wide)) - 1))
    return (x ^ y).bit_count()


def _leader_tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of tiles whose leader comes first: pairs whose bitmaps still allow the threshold, with the differing bits for each shingle of the two."""
    leader: tuple[int, int, bytes] | None = None
    for f in frames:
        out = []
        for hub, guest, node, n, sig in zip(f["hub"], f["guest"], f["node"], f["n"], f["sig"]):
            if not guest:
                leader = hub, n, sig
            elif leader is not None and leader[0] == hub:
                size, other = leader[1:]
                if 100 * min(n, size) >= PERCENT * max(n, size):
                    differ = _differing(sig, other)
                    if enough((n + size - differ) // 2, n, size):
                        out.append((hub, node, differ / (n + size)))
        yield pd.DataFrame(out, columns=["a", "b", "far"])


def _fold(sigs: list[bytes], width: int) -> np.ndarray:
    """Bitmaps folded to this many bytes, a row of words each."""
    out = np.zeros((len(sigs), width // 8), dtype=np.uint64)
    for k, s in enumerate(sigs):
        out[k] = np.bitwise_or.reduce(np.frombuffer(s, dtype=np.uint64).reshape(-1, width // 8), axis=0)
    return out


def _tile(n: np.ndarray, comp: np.ndarray, home: np.ndarray, visit: np.ndarray, sigs: list[bytes]) -> Iterator[tuple[float, int, int]]:
    """Row numbers of pairs of a tile, home rows against visiting rows of other classes, that the bitmaps leave, and how far they are apart."""
    wide = np.array([len(x) for x in sigs])

    def cross(home: np.ndarray, visit: np.ndarray, width: int) -> Iterator[tuple[float, int, int]]:
        if not len(home) or not len(visit):
            return
        one, two = _fold([sigs[k] for k in home], width), _fold([sigs[k] for k in visit], width)
        step = max(1, (1 << 20) // (len(visit) * one.shape[1]))
        for k in range(0, len(home), step):
            i = home[k : k + step]
            differ = popcount(one[k : k + step, None, :] ^ two[None, :, :]).sum(axis=2, dtype=np.int64)
            x, y = n[i][:, None], n[visit][None, :]
            both = np.minimum((x + y - differ) // 2, np.minimum(x, y))
            h, g = np.nonzero(enough(both, x, y) & (comp[i][:, None] != comp[visit][None, :]))
            yield from zip((differ[h, g] / (x + y)[h, g]).tolist(), i[h].tolist(), visit[g].tolist())

    for w in np.unique(wide):
        yield from cross(home[wide[home] == w], visit[wide[visit] == w], w)
        # A set twice as wide may still be near; one four times as wide is more than twice as large.
        yield from cross(home[wide[home] == 2 * w], visit[wide[visit] == w], w)
        yield from cross(home[wide[home] == w], visit[wide[visit] == 2 * w], w)


def _forest(pairs: Iterator[tuple[float, int, int]], comp: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """The closest pairs that join all classes which pairs join."""
    above: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for far, i, j in sorted(pairs):
        a, b = find(int(comp[i])), find(int(comp[j]))
        if a != b:
            above[a] = b
            yield far, i, j


def _full_tiles(frames: Iterator[pd.DataFrame], spanning: bool) -> Iterator[pd.DataFrame]:
    """Pairs of all tiles of a partition that is sorted by tile, or a spanning forest of each tile's. A tile that a batch ends in waits for the next one.

    guest: 0 for home rows, 1 for visiting ones, 2 for rows that are both.
    """
    held: pd.DataFrame | None = None

    def pairs(f: pd.DataFrame, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
        n, guest, node, sigs = f["n"].to_numpy(), f["guest"].to_numpy(), f["node"].tolist(), f["sig"].tolist()
        comp = f["comp"].to_numpy()
        found: set[tuple[int, int]] = set()
        for a, b in zip(cuts[:-1], cuts[1:]):
            home, visit = np.flatnonzero(guest[a:b] != 1), np.flatnonzero(guest[a:b] != 0)
            if len(home) and len(visit) and comp[a:b].min() != comp[a:b].max():
                near = _tile(n[a:b], comp[a:b], home, visit, sigs[a:b])
                for _, i, j in _forest(near, comp[a:b]) if spanning else near:
                    x, y = node[a + i], node[a + j]
                    found.add((x, y) if x < y else (y, x))
        if found:
            yield pd.DataFrame(sorted(found), columns=["a", "b"])

    for f in frames:
        f = pd.concat([held, f], ignore_index=True) if held is not None else f
        tile = f[["key", "tile_band", "h", "g"]].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1])
        yield from pairs(f.iloc[: cuts[-1]], cuts)
        held = f.iloc[cuts[-1] :]
    if held is not None:
        yield from pairs(held, np.array([0, len(held)]))


def _exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that reach the threshold. Rows are sorted by a and part: the array of a comes first, then those of its partners."""
    own: tuple[int, np.ndarray] | None = None
    for f in frames:
        found: list[tuple[int, int]] = []
        for a, b, shingles in zip(f["a"], f["b"], f["shingles"]):
            if pd.isna(b):
                own = a, np.frombuffer(shingles, dtype=np.uint64)
            elif own is not None and own[0] == a:
                x, y = own[1], np.frombuffer(shingles, dtype=np.uint64)
                if enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    found.append((int(a), int(b)))
        yield pd.DataFrame(found, columns=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame, source: DataFrame) -> DataFrame:
    """The written pairs (a, b) whose shingle sets reach the threshold.

    sets: node and place (of one of its rows in source). Texts that may be wanted are read again and made into sorted
    arrays; a set meets its partners in parts of TILE_ROWS.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(sets.select("node", "digest", "place"), "node")
    wanted = materialise(wanted, "wanted")
    near, _ = split_by_bitmap(source.select("text", "place"), F.col("place"), wanted.select(F.col("place").alias("k")))
    arrays = near.select("text").mapInArrow(_arrays, "digest binary, shingles binary").join(wanted.select("digest", "node"), "digest").dropDuplicates(["node"])
    arrays = materialise(arrays.select("node", "shingles"), "shingles")
    counts = pairs.groupBy("a").agg(F.count("*").alias("c")).withColumn("parts", F.ceil(F.col("c") / TILE_ROWS).cast("int"))
    dealt = hot_join(pairs, materialise(counts, "partners"), "a", "c").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    dealt = materialise(dealt, "dealt")
    first = dealt.select("a", "part").distinct().join(arrays.withColumnRenamed("node", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "part", "shingles")
    rest = dealt.join(arrays.withColumnRenamed("node", "b"), "b").select("a", "b", "part", "shingles")
    rows = first.unionByName(rest).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return rows.select("a", "b", "shingles").mapInPandas(_exact, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and comp (the smallest id that links reach) of every id in the written links (a, b).

    Each round takes the large star and then the small star of every node (Kiveris et al. 2014); minima are
    aggregated before the shuffle. Each star is written, as the next one reads it twice. It ends when every node but the
    smallest of its class has one edge, which leads there.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            edges = edges.select("u", "v").union(edges.select("v", "u"))
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = edges.join(least, "u")
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.filter("u != m").select("u", F.col("m").alias("v")))
        return out.filter("u != v").distinct()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    while True:
        for large in (True, False):
            edges = materialise(star(edges, large), "edges")
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
        per = ends.groupBy("id").agg(F.max("up").alias("up"), F.count("*").alias("c"))
        if not per.agg(F.count(F.when((F.col("up") > 0) & (F.col("c") > 1), 1))).first()[0]:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct())


def _leaders(members: DataFrame, keys: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of each set with the closest leader that its bitmap allows: a (leader), b.

    A leader has the smallest number of its band, and only leaders with a smaller number than the set's are tried, so
    links lead from set to set to the smallest one of a group.
    """
    met = hot_join(members, keys, "key", "c").select("node", "band", "c", F.explode("hubs").alias("hub"))
    met = met.filter((F.abs(F.col("hub.band") - F.col("band")) <= 1) & (F.col("hub.node") < F.col("node")))
    met = met.groupBy(F.col("hub.node").alias("hub"), "node").agg(F.max(F.ceil(F.col("c") / LEADER_ROWS)).cast("int").alias("parts"))
    met = materialise(met.withColumn("h", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "met")
    tile = ["hub", "parts", "h"]
    guests = met.join(sets.select("node", "n", "sig"), "node").select(*tile, F.lit(1).alias("guest"), "node", "n", "sig")
    homes = met.select(*tile).distinct().join(sets.select(F.col("node").alias("hub"), "n", "sig"), "hub").select(*tile, F.lit(0).alias("guest"), F.col("hub").alias("node"), "n", "sig")
    near = homes.unionByName(guests).repartition(*tile).sortWithinPartitions(*tile, "guest").mapInPandas(_leader_tiles, "a long, b long, far double")
    return near.groupBy("b").agg(F.min(F.struct("far", "a")).alias("x")).select("x.a", "b")


def _stray_pairs(members: DataFrame, classes: DataFrame, sets: DataFrame, spanning: bool) -> DataFrame:
    """Pairs (a, b) of sets of different classes that share a key and that the bitmaps leave; spanning: a forest of each tile's."""
    rows = materialise(members.join(classes.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "members")
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("alike")).groupBy("key").agg(F.sum("alike").alias("c"), F.max(F.struct("alike", "comp")).alias("most"))
    per = per.select("key", "c", (F.col("c") - F.col("most.alike")).alias("strays"), F.col("most.comp").alias("largest")).filter("strays > 0")
    rest = hot_join(rows, materialise(per, "split"), "key", "c").withColumn("stray", F.col("comp") != F.col("largest"))
    parts = lambda c: F.ceil(F.col(c) / TILE_ROWS).cast("int")
    own = lambda c: F.pmod(F.xxhash64("node"), parts(c)).cast("int")
    each = lambda c, f: F.transform(F.sequence(F.lit(0), parts(c) - 1), f)
    tile = lambda band, h, g, guest: F.struct(band.alias("tile_band"), h.alias("h"), g.alias("g"), F.lit(guest).alias("guest"))
    visits = each("strays", lambda o: tile(F.col("band"), o, own("c"), 1))
    homes = F.concat(*(each("c", lambda o: tile(F.col("band") + k, own("strays"), o, 0)) for k in (-1, 0, 1)))  # noqa: B023
    # A small key is one tile, so its sets travel once.
    whole = F.array(F.struct(F.lit(0).alias("tile_band"), F.lit(0).alias("h"), F.lit(0).alias("g"), F.when(F.col("stray"), 2).otherwise(1).alias("guest")))
    dealt = F.when(F.col("c") <= TILE_ROWS, whole).when(F.col("stray"), F.concat(visits, homes)).otherwise(visits)
    placed = rest.withColumn("tile", F.explode(dealt)).select("key", "node", "comp", "tile.*")
    placed = placed.join(sets.select("node", "n", "sig"), "node")
    by = ["key", "tile_band", "h", "g"]
    return placed.repartition(*by).sortWithinPartitions(*by).mapInPandas(lambda frames: _full_tiles(frames, spanning), "a long, b long").distinct()


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs, and the columns in carry.

    Words are what lies between white space (0x20, 0x09 to 0x0D), with A-Z in lower case. A text of one to
    four words has its whole sequence as the only shingle; a null, empty or blank text has none and links
    with nothing, its class is itself. Each row is a document of its own, also if its id repeats. component_id is
    the smallest id of the class; it is null where all ids of the class are. Other columns are not read, unless carry
    names them. An empty table gives no rows.
    """
    carry = carry or {}
    text, row = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    place = F.xxhash64(row, text)
    source = docs.select(text.alias("text"), row.alias("doc_id"), place.alias("place"), *(c.alias(n) for n, c in carry.items()))
    kind = ", ".join(f"{n} {t}" for n, t in source.dtypes[1:])
    signed = materialise(source.mapInArrow(_sign, f"{kind}, {_SIGNED}"), "signed")
    # Copies of one set are equal in n, sig and keys, too.
    sets = signed.filter("n > 0").groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("place").alias("place"), *(F.first(c).alias(c) for c in ("n", "sig", "keys")))
    # Numbers of the sets; they are fixed when the table is written.
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(101 / PERCENT)).cast("int")
    every = sets.select("node", band.alias("band"), F.explode("keys").alias("key"))
    # Keys of one set alone go no further.
    often = materialise(sets.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count("*").alias("c")).filter("c > 1").select("k"), "often")
    near, _ = split_by_bitmap(every, F.col("key"), often)
    near = materialise(near, "near")
    per = near.groupBy("key", "band").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    keys = materialise(per.groupBy("key").agg(F.sum("c").alias("c"), F.collect_list(F.struct("band", "node")).alias("hubs")).filter("c > 1"), "keys")
    members = materialise(hot_join(near, keys.select("key", "c"), "key", "c").drop("c"), "shared")

    links = materialise(verified(materialise(_leaders(members, keys, sets), "closest"), sets, source), "links")
    classes = materialise(components(links), "classes")
    tested = None
    for spanning in (True, False):
        while True:
            pairs = _stray_pairs(members, classes, sets, spanning)
            pairs = materialise(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            if pairs.isEmpty():
                break
            tested = pairs if tested is None else tested.union(pairs)
            new = materialise(verified(pairs, sets, source), "more_links")
            if new.isEmpty():
                break
            # Classes so far are stars already, so new links alone take rounds.
            classes = materialise(components(classes.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(new)), "classes")
            if not spanning:
                break
    return _labelled(signed, sets, classes, list(carry))


def _labelled(signed: DataFrame, sets: DataFrame, classes: DataFrame, carry: list[str]) -> DataFrame:
    """Rows with the smallest id of their class. Only sets that are linked or have copies are looked up."""
    linked = sets.select("node", "digest", "copies", "least").join(classes.select(F.col("id").alias("node"), "comp"), "node", "left")
    linked = materialise(linked.filter("comp is not null or copies > 1").withColumn("comp", F.coalesce("comp", "node")), "linked")
    least = materialise(linked.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "least")
    named = materialise(hot_join(linked, least, "comp", "members").select("digest", "copies", "comp", "component_id"), "named")
    out = hot_join(signed, named, "digest", "copies", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *carry, F.coalesce(F.col("comp").cast("string"), F.hex("digest")).alias("class"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one row of each class left, that of the smallest id (null last), with all their columns."""
    carry = dict(zip(("own_id", "own_sha"), row_key(id_col, text_col)))
    marked = materialise(jaccard_classes(docs, id_col, text_col, carry).filter("class is not null"), "marked")
    rest = marked.filter("not (doc_id <=> component_id)").select("own_id", "own_sha").distinct()
    first = marked.filter("doc_id <=> component_id").groupBy("class", "own_id", "own_sha").agg(F.count("*").alias("n"))
    first = materialise(first, "first")
    least = materialise(first.groupBy("class").agg(F.min("own_sha").alias("chosen"), F.count("*").alias("m")), "chosen")
    first = materialise(hot_join(first, least, "class", "m").withColumn("stays", F.col("own_sha") == F.col("chosen")), "staying")
    gone = materialise(rest.unionByName(first.filter("not stays").select("own_id", "own_sha")).distinct(), "gone")
    return drop_rows(docs, gone, materialise(first.filter("stays and n > 1").select("own_id", "own_sha"), "once"), id_col, text_col)
