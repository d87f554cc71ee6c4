"""Removal of repeated 100-byte strings by sorting suffixes.

Which suffixes meet: a 100-byte string is dealt out by its anchor, the 32-byte string in it with the least
hash (leftmost of equals). Equal strings have equal anchors at the same place, so suffixes are sorted only
against those with their anchor. Anchors that occur once cannot hold a repeat; they are found by counting
and dropped by a filter of fixed size before any text travels. Of the rest, a segment is sent: all 100-byte
strings of the document that have this anchor there, about 35 of them in 135 bytes.

Anchors that are in very many segments are not held by one task. Their segments are dealt out by their bytes and
a salt: all copies of a segment but the first are repeats as a whole, and are marked as they stream by. The first
ones meet once more without salt. Distinct segments of an anchor are sorted in one task if there are few;
if there are many, their strings are dealt out anew by longer anchors, of 66 bytes, then 83 and so on up to the whole string. Each
cuts a segment into a few pieces, which overlap by less than a string; only pieces whose anchor is still in many go on to the next.

Equal segments of an anchor are found first: all but the earliest are repeats as a whole, and only the distinct
ones are sorted. How they are sorted: deep-shallow. A multikey quicksort (eight bytes a key, three-way
partitions by a pivot) orders the suffixes to a shallow depth of 24 bytes; suffixes that are alone by then are done. The
groups that remain have long common prefixes. Blind tries order these: all members of a group are compared with its
first; the place where each leaves it is its branch, and members that leave at the same place by the same
key are a subtrie. What all members share is never read again. All groups of a batch are split at once, in numpy.

In the suffix array of the batch, suffixes that are equal to depth 100 are neighbours and one string; all but the
first in the corpus are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.llm.shared import BLOCK_BYTES, DOWN, materialise, mix, running_hash, small_batches

LENGTH, ANCHOR = 100, 32
SHALLOW = 3
#: Longer anchors, for strings whose anchor is in too many distinct segments; the last one is the string.
LONGER = (66, 83, 92, 96, 98, 100)
#: Places within a block of text are below BLOCK_BYTES.
_PLACE_BITS = BLOCK_BYTES.bit_length()
#: Bounds of the filter of repeated anchors, in bits: 128 KB to 32 MB. It has eight bits for each repeated anchor; beyond that more anchors pass and are dropped after the shuffle.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
_CHUNK = 1 << 19
_BATCH_SEGMENTS = 20_000
#: An anchor in more segments than this is frequent; one with more than SPLIT distinct segments is parted by longer anchors.
FREQUENT, SPLIT, SALTS = 1_000, 1_000, 64
_FOUND = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("key", pa.int64()), ("segment", pa.binary())])
_FOUND_SQL = "doc long, row long, lo long, hi long, key long, segment binary"
_SEGMENT_SQL = "key long, salt int, doc long, row long, start long, segment binary"
_LAST = [*range(0, LENGTH - 8, 8), LENGTH - 8]


def _anchors(data: np.ndarray, begins: np.ndarray, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of texts that lie one after the other in data, a block of bytes at a time: number of the text, first and last start within data, anchor's hash.

    begins: where texts begin, and the end of the last. Blocks overlap by what a string needs, so each string is in one of them.
    anchor: bytes of an anchor.
    """
    span = LENGTH - anchor + 1
    step = BLOCK_BYTES - LENGTH + 1
    for at in range(0, len(data) - LENGTH + 1, step):
        block = data[at : at + BLOCK_BYTES]
        total = running_hash(block)
        m = len(block) - anchor + 1
        hashes = mix((total[anchor:] - total[:m]) * DOWN[:m])
        low = np.uint64(_PLACE_BITS)
        least = (hashes >> low << low) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            rest = span - width
            least = np.minimum(least[:-rest], least[rest:])
        place = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        starts = np.arange(at, at + len(place))
        text = np.searchsorted(begins, starts, side="right") - 1
        whole = starts + LENGTH <= begins[text + 1]
        starts, text, place = starts[whole], text[whole], place[whole]
        if len(starts):
            first = np.flatnonzero(_runs(place, text))
            last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
            yield text[first], starts[first], starts[last], hashes[place[first]].view(np.int64)


def _joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    parts = [(t or "").encode() for t in texts]
    return b"".join(parts), np.concatenate([[0], np.cumsum([len(t) for t in parts])]).astype(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 0, _CHUNK):
        data, begins = _joined(batch.column(0).to_pylist())
        for _, _, _, key in _anchors(np.frombuffer(data, dtype=np.uint8), begins):
            keys, counts = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["key", "n"])


def _segments(known):
    """known: the filters of repeated and of frequent anchors, of one size. The salt of other anchors is -1.

    An anchor that a filter lets through by chance takes the way of those it looks like; the result is the same.
    """
    has = lambda bits, p: (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, frequent = (np.frombuffer(bits, dtype=np.uint8) for bits in known.value)
        for batch in small_batches(batches, 2, _CHUNK):
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, begins = _joined(batch.column(2).to_pylist())
            for text, first, last, key in _anchors(np.frombuffer(data, dtype=np.uint8), begins):
                p = key & (8 * len(repeated) - 1)
                keep = np.flatnonzero(has(repeated, p))
                own, key, p = text[keep], key[keep], p[keep]
                doc, row = ids[own].astype(np.int64), rows[own].astype(np.int64)
                salt = np.full(len(keep), -1, dtype=np.int32)
                if len(frequent):
                    of = np.flatnonzero(has(frequent, p))
                    salt[of] = mix((doc[of] ^ row[of]).view(np.uint64)) % np.uint64(SALTS)
                columns = [
                    pa.array(key, pa.int64()),
                    pa.array(salt, pa.int32()),
                    pa.array(doc, pa.int64()),
                    pa.array(row, pa.int64()),
                    pa.array(first[keep] - begins[own], pa.int64()),
                    pa.array([data[a : b + LENGTH] for a, b in zip(first[keep].tolist(), last[keep].tolist())], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "salt", "doc", "row", "start", "segment"])

    return run


def _pieces(anchor: int):
    """Segments cut into runs of strings of one longer anchor, with its hash for a key and a salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 3, _CHUNK):
            doc, row, start = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            segments = batch.column(3).to_pylist()
            begins = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
            data = b"".join(segments)
            for own, first, last, key in _anchors(np.frombuffer(data, dtype=np.uint8), begins, anchor):
                salt = mix((doc[own] ^ row[own]).view(np.uint64)) % np.uint64(SALTS)
                columns = [
                    pa.array(key, pa.int64()),
                    pa.array(salt.astype(np.int32), pa.int32()),
                    pa.array(doc[own], pa.int64()),
                    pa.array(row[own], pa.int64()),
                    pa.array(start[own] + first - begins[own], pa.int64()),
                    pa.array([data[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist())], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "salt", "doc", "row", "start", "segment"])

    return run


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True where a run of rows that are equal in all columns begins."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _sizes(label: np.ndarray) -> np.ndarray:
    """Of each row, how many rows have its label. label: rising numbers from 0."""
    return np.bincount(label)[label] if len(label) else label


def suffix_order(group: np.ndarray, places: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a batch: row numbers by group and then by the 100 bytes at their place in data, equal ones by number.

    Also, for each row of it, whether its string differs from that of the row before.
    """
    raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    words = np.zeros(len(data) + 1, dtype=np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | raw[k : k + len(words)]
    last = np.array(_LAST)
    order = np.argsort(group, kind="stable")
    new = np.ones(len(order), dtype=bool)
    # Places of order that lie in a bucket of more than one row, the bucket of each, and how many words all of a bucket share.
    label = np.cumsum(_runs(group[order])) - 1
    at = np.flatnonzero(_sizes(label) > 1)
    label = np.cumsum(_runs(label[at])) - 1
    depth = np.zeros(len(at), dtype=np.int64)
    deep: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):  # multikey quicksort: every bucket is parted by its pivot, what equals it goes one word deeper
        key = words[places[order[at]] + last[depth]]
        begin = np.flatnonzero(_runs(label))
        pivot = key[begin + np.bincount(label) // 2][label]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        by = np.argsort(label * 3 + side, kind="stable")
        order[at] = order[at][by]
        side, depth = side[by], depth[by] + (side[by] == 1)
        label = np.cumsum(_runs(label[by], side)) - 1
        many = _sizes(label) > 1
        down = many & (depth == SHALLOW)
        if down.any():
            deep.append((at[down], np.cumsum(_runs(label[down])) - 1))
        stay = many & ~down
        at, depth = at[stay], depth[stay]
        label = np.cumsum(_runs(label[stay])) - 1
    shift = np.cumsum([0, *(int(x[1][-1]) + 1 for x in deep)])
    at = np.concatenate([x[0] for x in deep]) if deep else np.zeros(0, np.int64)
    label = np.concatenate([x[1] + k for x, k in zip(deep, shift)]) if deep else at
    depth = np.full(len(at), SHALLOW)
    while len(at):  # blind tries: a level of branches of all buckets
        rows = order[at]
        leader = rows[np.flatnonzero(_runs(label))][label]
        leave = np.full(len(at), len(_LAST))
        left = np.flatnonzero(depth < len(_LAST))
        while len(left):
            d = last[depth[left]]
            same = words[places[rows[left]] + d] == words[places[leader[left]] + d]
            leave[left[~same]] = depth[left[~same]]
            left = left[same]
            depth[left] += 1
            left = left[depth[left] < len(_LAST)]
        equal = leave == len(_LAST)
        d = last[np.minimum(leave, len(_LAST) - 1)]
        key, other = words[places[rows] + d], words[places[leader] + d]
        key[equal] = 0
        side = np.where(equal, 1, np.where(key < other, 0, 2))
        # Smaller ones that leave the leader early come first; greater ones that leave it late.
        by = np.lexsort((rows, key, np.where(side == 0, leave, -leave), side, label))
        order[at] = rows[by]
        side, leave = side[by], leave[by]
        branch = _runs(label[by], side, leave, key[by])
        new[at[(side == 1) & ~branch]] = False
        label = np.cumsum(branch) - 1
        stay = (_sizes(label) > 1) & (side != 1)
        at, depth = at[stay], leave[stay] + 1
        label = np.cumsum(_runs(label[stay])) - 1
    return order, new


def _marked(t: pa.Table) -> pa.RecordBatch | None:
    """Byte ranges of strings that also start earlier. t: segments of whole key groups, sorted by key and place."""
    segments = t["segment"].to_pylist()
    key, doc, row, start = (t[c].to_numpy() for c in ("key", "doc", "row", "start"))
    seen: dict[bytes, int] = {}
    head = np.array([seen.setdefault(s, k) for k, s in enumerate(segments)])
    length = np.array([len(s) for s in segments])
    copy = np.flatnonzero((doc != doc[head]) | (row != row[head]) | (start != start[head]))
    of, lo, hi = [copy], [start[copy]], [start[copy] + length[copy]]
    distinct = np.flatnonzero(head == np.arange(len(head)))
    _, group = np.unique(key[distinct], return_inverse=True)
    distinct = distinct[np.bincount(group)[group] > 1]
    if len(distinct):
        count = length[distinct] - LENGTH + 1
        offset = np.concatenate([[0], np.cumsum(length[distinct])[:-1]])
        own = np.repeat(np.arange(len(distinct)), count)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        order, new = suffix_order(key[distinct][own], offset[own] + nth, b"".join(segments[k] for k in distinct))
        again = np.sort(order[~new])  # the first of equal strings is the one with the smallest place
        if len(again):
            seg, at = distinct[own[again]], (start[distinct[own]] + nth)[again]
            new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1)])
            first = np.flatnonzero(new)
            of.append(seg[first])
            lo.append(at[first])
            hi.append(at[np.concatenate([first[1:] - 1, [len(at) - 1]])] + LENGTH)
    seg = np.concatenate(of)
    if not len(seg):
        return None
    found = [pa.array(doc[seg]), pa.array(row[seg]), pa.array(np.concatenate(lo)), pa.array(np.concatenate(hi))]
    return pa.RecordBatch.from_arrays([*found, pa.nulls(len(seg), pa.int64()), pa.nulls(len(seg), pa.binary())], schema=_FOUND)


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is found in a partition that is dealt and sorted by _dealt().

    Without salt: whole key groups, in batches; groups of one segment are passed over. With salt: the first of equal
    segments goes on with its key and bytes, the other ones are marked as they come, and nothing is held.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    first: tuple = (None, None, None)

    def copies(t: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal first
        out = []
        for key, h, salt, doc, row, start, segment in zip(*(c.to_pylist() for c in t.columns)):
            group, place = (key, h, salt), (doc, row, start)
            if group != first[0]:
                first = (group, place, segment)
                out.append((*place, None, key, segment))
            elif segment != first[2]:  # another segment of the same hash
                out.append((*place, None, key, segment))
            elif place != first[1]:
                out.append((*place, start + len(segment), None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * len(_FOUND), _FOUND)], schema=_FOUND)

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        t = pa.Table.from_batches(held)
        key = t["key"].to_numpy()
        end = len(key) if last else int(np.searchsorted(key, key[-1], side="left"))
        held, size = t.slice(end).to_batches(), len(key) - end
        new = _runs(key[:end])
        many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1 if end else new
        t = t.slice(0, end).filter(pa.array(many))
        if t.num_rows:
            found = _marked(t)
            if found is not None:
                yield found

    for batch in batches:
        salted = batch["salt"].to_numpy() >= 0
        if salted.any():
            yield copies(batch.filter(pa.array(salted)))
            batch = batch.filter(pa.array(~salted))
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
            if size >= _BATCH_SEGMENTS:
                yield from cut(False)
    if held:
        yield from cut(True)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 1):
        rows = []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = (text or "").encode()
            spans: list[list[int]] = []
            for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or []):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            edges = [0, *(e for s in spans for e in s), len(data)]
            kept = hashlib.sha256()
            for a, b in zip(edges[::2], edges[1::2]):
                kept.update(data[a:b])
            rows.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _dealt(segments: DataFrame) -> DataFrame:
    """What _sorted_groups finds. segments: key, salt, doc, row, start and segment; those without salt (-1) meet by key alone."""
    h = F.when(F.col("salt") >= 0, F.xxhash64("segment")).otherwise(0)
    columns = ["key", "h", "salt", "doc", "row", "start"]
    dealt = segments.withColumn("h", h).select(*columns, "segment").repartition("key", "h", "salt")
    return dealt.sortWithinPartitions(*columns).mapInArrow(_sorted_groups, _FOUND_SQL)


#: Keys of eight bytes that are sent to all tasks at most; more of them are joined by a shuffle.
MOST_BROADCAST = 100_000


def repeated_ranges(docs: DataFrame, frequent: int = FREQUENT, split: int = SPLIT) -> DataFrame:
    """doc, row, lo, hi: byte ranges that repeated strings cover; ranges of a document may touch and overlap. docs: doc, row, text."""
    spark = docs.sparkSession
    keys = docs.select("text").mapInArrow(_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    keys = materialise(keys, "anchors")
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * keys.count() + 1).bit_length()))
    place = F.col("key").bitwiseAND(F.lit(n_bits - 1))
    placed = keys.select(place.alias("p"), (F.col("n") > frequent).alias("often"))
    bitmap = lambda only: F.expr(f"bitmap_construct_agg(p % 32768){only}")
    # n_bits / 32768 rows at most, of 8 KB each: 32 MB for a corpus of any size.
    blocks = placed.groupBy(F.expr("p div 32768").alias("block")).agg(bitmap("").alias("bits"), F.max("often").alias("has"), bitmap(" FILTER (WHERE often)").alias("often")).collect()
    bits, often = bytearray(n_bits // 8), bytearray(n_bits // 8)
    for r in blocks:
        bits[r["block"] * 4096 : r["block"] * 4096 + 4096] = r["bits"]
        if r["has"]:
            often[r["block"] * 4096 : r["block"] * 4096 + 4096] = r["often"]
    any_often = any(r["has"] for r in blocks)
    known = spark.sparkContext.broadcast((bytes(bits), bytes(often) if any_often else b""))
    segments = docs.select("doc", "row", "text").mapInArrow(_segments(known), _SEGMENT_SQL)
    parts: list[DataFrame] = []

    def firsts(found: DataFrame, salt: int) -> DataFrame:
        parts.append(found.filter("segment is null").select("doc", "row", "lo", "hi"))
        return found.filter("segment is not null").select("key", F.lit(salt).alias("salt"), "doc", "row", F.col("lo").alias("start"), "segment")

    found = firsts(materialise(_dealt(segments), "ranges"), 0)
    if any_often:
        for anchor in (*LONGER, None):
            distinct = firsts(materialise(_dealt(found), "distinct"), -1)
            many = distinct.groupBy("key").count().filter(F.col("count") > split).select("key")
            many = materialise(many, "many") if anchor else many.limit(0)  # of whole strings, those of a key are equal, but for collisions
            if not (n := many.count()):
                firsts(_dealt(distinct), -1)
                break
            many = F.broadcast(many) if n <= MOST_BROADCAST else many
            firsts(_dealt(distinct.join(many, "key", "left_anti")), -1)
            crowded = distinct.join(many, "key", "left_semi").select("doc", "row", "start", "segment")
            pieces = crowded.mapInArrow(_pieces(anchor), _SEGMENT_SQL)
            # A piece has a first one for each salt at most; these meet without it.
            found = firsts(materialise(_dealt(pieces), "pieces"), 0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs.

    Each byte that a 100-byte string covers is removed if that string also starts earlier, in a smaller id or in
    the same text before. A null text is empty; texts under 100 bytes stay whole. A null id comes before all
    others. Rows that repeat an id with another text are ordered by a hash of the text; rows that repeat both are
    one place, and have the same result. Other columns are not read. An empty table gives no rows.
    """
    least = -(2**63)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    ranges = repeated_ranges(source)
    by_text = ranges.groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = source.join(by_text, ["doc", "row"], "left").select(F.when(F.col("doc") != least, F.col("doc")).alias("doc_id"), "text", "ranges")
    return joined.mapInArrow(_rewrite, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
