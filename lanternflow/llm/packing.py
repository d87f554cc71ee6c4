"""Best-fit packing of token sequences by linear grouping.

The plan needs the lengths only, and a length is at most the capacity: the histogram on the driver
has `capacity` entries at most, whatever the corpus holds. On it:

1. large lengths, sorted downwards, are cut into groups of equal cardinality and rounded up to the
   largest length of their group;
2. configurations of these few sizes are optimised by column generation and used as often as the
   solution, rounded down, says; where rounding up costs too much, half as often, and the rest is grouped anew;
3. the documents themselves take the places of the rounded sizes; what rounding added goes to longer
   documents in the last two places of a sequence;
4. the large documents that rounding down left and the small ones, the longest first, go to the
   tightest gap that holds them.

All of it works on runs of equal lengths, so the plan is a table of a bounded number of intervals:
the documents of rank lo to hi among those of one length lie in these sequences at this offset.
Ranks come from counts by (length, bucket); a length has as many buckets as its count asks for, so one that many
documents share is no hot key.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternflow.llm.shared import materialise, small_batches

CAPACITY = 2048
GROUPS = 48
#: Steps of the column generation, several times what 80 sizes need.
ROUNDS = 2000
#: Times that the large documents are grouped anew, where once is not enough. All turns but the last use configurations half as often as
#: the solution says, so only what is left at last is packed as loosely as rounding up asks.
TURNS = 6
#: Documents of more than capacity // SMALL_SHARE are large: up to five of them are in one configuration.
SMALL_SHARE = 6
#: Rows of a bucket in which pieces of one length are numbered.
BUCKET_ROWS = 50_000
END_ID = b"\0\0\0\0"

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Fixed values of the vocabulary: its end marker, and where it cuts a text into words (without backtracking).
_END = "<|endoftext|>"
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class TokenIds:
    """Token ids of texts by a byte-level BPE vocabulary, as little-endian unsigned 32-bit numbers.

    The vocabulary file (ranks) holds the same vocabulary as the tokenizer file; encoding by ranks
    gives the same ids several times faster. The end marker's string in a text is the end marker.
    """

    def __init__(self, path: str | None):
        import tiktoken

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={_END: len(ranks)})

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


@functools.lru_cache(maxsize=1)
def token_ids(path: str | None) -> TokenIds:
    """One vocabulary a worker, however many tasks it runs."""
    return TokenIds(path)


def _pieces(capacity: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(path)
        for batch in small_batches(batches, 1):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for doc, text in zip(ids, texts):
                data = tokens.encode(text or "") + END_ID
                total = len(data) // 4
                start, size = 0, (total - 1) % capacity + 1
                for piece in range(-(-total // capacity)):
                    rows.append((doc, piece, start, size, zlib.crc32(data[4 * start : 4 * (start + size)])))
                    start, size = start + size, capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = [f.split()[0] for f in _PIECE.split(", ")]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """A row for each piece of at most `capacity` ids: ids of the text, then id 0. Only the first piece may be shorter."""
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(_pieces(capacity, tokenizer_path), _PIECE)


def _grouped(large: list[int], left: dict[int, int], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, downwards, and how many documents are rounded up to each: groups of equal cardinality take the length of their longest document."""
    falling = np.array(large[::-1])
    bounds = np.cumsum([left[n] for n in large[::-1]])
    total = int(bounds[-1])
    cuts = np.array(sorted({total * g // groups for g in range(groups + 1)}))
    tops = falling[np.searchsorted(bounds, cuts[:-1], side="right")]
    sizes, own = np.unique(-tops, return_inverse=True)  # groups of one size are one
    return -sizes, np.bincount(own, weights=np.diff(cuts)).astype(np.int64)


def _dearest(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth: its worth, and how often it holds each size. A table over the room, a level an item."""
    useful = np.flatnonzero(worth > 0)
    below = np.arange(capacity + 1) - sizes[useful, None]
    below[below < 0] = capacity + 1  # no room: worth nothing at all
    top, levels = np.append(np.zeros(capacity + 1), -np.inf), []
    for _ in range(capacity // int(sizes.min()) if len(useful) else 0):
        with_it = top[below] + worth[useful, None]
        chosen = with_it.argmax(axis=0)
        best = with_it[chosen, np.arange(capacity + 1)]
        better = best > top[:-1] + 1e-12
        if not better.any():
            break
        levels.append(np.where(better, useful[chosen], -1))
        top[:-1] = np.where(better, best, top[:-1])
    counts, room = np.zeros(len(sizes)), capacity
    for chosen in reversed(levels):
        if (i := int(chosen[room])) >= 0:
            counts[i] += 1
            room -= int(sizes[i])
    return float(top[capacity]), counts


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[list[int], int]]:
    """Configurations (sizes, falling) and how often each is used, never more often than demand allows.

    The fewest sequences as a linear programme by column generation: prices of the sizes from the configurations in
    use, then the configuration of most worth at these prices joins them, until none is worth more than a sequence.
    Uses are rounded down. After `rounds` steps what is found so far is taken: it needs no more sequences than before.
    """
    basis = np.diag(np.floor(capacity / sizes)).astype(float)
    used = demand / basis.diagonal()
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, column = _dearest(sizes, prices, capacity)
        if worth <= 1 + 1e-9:
            break
        along = np.linalg.solve(basis, column)
        ratios = np.where(along > 1e-9, used / np.where(along > 1e-9, along, 1.0), np.inf)
        # Of those that leave at once, the one with the largest step keeps the basis well-conditioned.
        basis[:, int(np.where(ratios <= ratios.min() + 1e-9, along, 0.0).argmax())] = column
        used = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0.0)
    out: list[tuple[list[int], int]] = []
    left = demand.astype(np.int64).copy()
    for column, times in zip(basis.T.astype(np.int64), np.floor(used + 1e-6).astype(np.int64)):
        held = np.flatnonzero(column)
        times = min(int(times), int((left[held] // column[held]).min()))
        if times > 0:
            left -= column * times
            out.append((np.repeat(sizes[held], column[held]).tolist(), times))
    return sorted(out, reverse=True)


def _documents(config: list[int], large: list[int], left: dict[int, int], capacity: int) -> list[int]:
    """Lengths (of large, rising, none used up) for the places of a configuration of these sizes.

    A place takes the longest document that fits its size, but the last two the pair that fills the room best and, of
    equal ones, is nearest to their sizes. A place that no document fits stays free.
    """
    places: list[int] = []
    room = capacity

    def longest(most: int) -> int:
        """Where the longest document of at most this length is; -1 if there is none."""
        k = bisect.bisect_right(large, most) - 1
        while k >= 0 and left[large[k]] <= places.count(large[k]):
            k -= 1
        return k

    for at, size in enumerate(config):
        last = at >= len(config) - 1
        if at == len(config) - 2:
            lengths = np.array([n for n in large if n < room and left[n] > places.count(n)], dtype=np.int64)
            other = np.searchsorted(lengths, room - lengths, side="right") - 1
            own = np.array([left[n] - places.count(n) for n in lengths.tolist()]) < 2
            other -= (other == np.arange(len(lengths))) & own  # a document is its own partner only if there are two of its length
            good = np.flatnonzero(other >= 0)
            if len(good):
                sums = lengths[good] + lengths[other[good]]
                good = good[sums == sums.max()]
                k = good[np.abs(lengths[good] - size).argmin()]
                places += [int(lengths[k]), int(lengths[other[k]])]
                break
        if (k := longest(room if last else size)) >= 0:
            places.append(large[k])
            room -= large[k]
    return places


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Intervals (length, lo, hi, sequence, per_sequence, offset) and the number of sequences.

    The document of rank r (lo <= r < hi) among those of this length lies in sequence
    sequence + (r - lo) // per_sequence at offset + (r - lo) % per_sequence * length.

    Large documents are grouped once; where that leaves more than a ten-thousandth above the lower bound, in several turns too,
    and the fewer sequences count.
    """
    longs = sum(c for n, c in histogram.items() if n > capacity // 2)
    least = max(longs, -(-sum(n * c for n, c in histogram.items()) // capacity))
    once = _plan(histogram, capacity, groups, 1)
    if once[1] <= least + max(1, least // 10_000):
        return once
    return min(once, _plan(histogram, capacity, groups, TURNS), key=lambda found: found[1])


def _plan(histogram: dict[int, int], capacity: int, groups: int, turns: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    intervals: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []

    def add_gap(room: int, base: int, count: int) -> None:
        if room and count:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(open_gaps, room)
            gaps[room].append((base, count))

    left = {n: c for n, c in histogram.items() if c}
    taken = dict.fromkeys(left, 0)
    large = sorted(n for n in left if n > capacity // SMALL_SHARE)
    sequence = 0
    for turn in range(turns):
        if not large:
            break
        for config, times in _configurations(*_grouped(large, left, groups), capacity):
            times = times if turn == turns - 1 else -(-times // 2)
            while times:
                places = _documents(config, large, left, capacity)
                if not places:
                    break
                run = min([times, *(left[n] // places.count(n) for n in places)])
                offset = 0
                for n in places:
                    intervals.append((n, taken[n], taken[n] + run, sequence, 1, offset))
                    taken[n] += run
                    left[n] -= run
                    offset += n
                for n in set(places):
                    if not left[n]:
                        large.remove(n)
                add_gap(capacity - offset, sequence, run)
                sequence += run
                times -= run
    for n in sorted(left, reverse=True):
        rank, rest = taken[n], left[n]
        while rest:
            k = bisect.bisect_left(open_gaps, n)
            if k == len(open_gaps):
                count = -(-rest // (capacity // n))
                add_gap(capacity, sequence, count)
                sequence += count
                continue
            room = open_gaps[k]
            base, count = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                open_gaps.pop(k)
            each = min(room // n, rest)
            take = min(count, rest // each)
            intervals.append((n, rank, rank + take * each, base, each, capacity - room))
            rank, rest = rank + take * each, rest - take * each
            add_gap(room - each * n, base, take)
            add_gap(room, base + take, count - take)
    return intervals, sequence


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, groups: int = GROUPS, bucket_rows: int = BUCKET_ROWS, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset: where each piece of each document lies.

    A null text is an empty one: its only id is 0. Null and repeated ids are kept, each row is packed. Other
    columns of docs are not read. An empty table gives no rows.

    Pieces of one length are numbered in buckets of about bucket_rows rows.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, id_col, text_col, capacity, tokenizer_path), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    intervals, _ = plan(histogram, capacity, groups)
    # The plan is bounded by capacity and groups, not by the corpus: one row a length.
    by_length: dict[int, list[tuple[int, ...]]] = {n: [] for n in histogram}
    for length, *rest in sorted(intervals):
        by_length[length].append(tuple(rest))
    rows = [(n, -(-histogram[n] // bucket_rows), own) for n, own in by_length.items()]
    kind = "length long, buckets long, places array<struct<lo:long,hi:long,base:long,each:long,at:long>>"
    places = F.broadcast(spark.createDataFrame(rows, kind))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets"))
    dealt = pieces.join(places.select("length", "buckets"), "length").withColumn("bucket", bucket)
    counts = dealt.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("first"))
    placed = ranked.join(places.select("length", "places"), "length").withColumn("place", _interval(F.col("places"), F.col("rank")))
    nth = F.col("rank") - F.col("place.lo")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("place.base") + F.floor(nth / F.col("place.each"))).alias("sequence_id"),
        (F.col("place.at") + (nth % F.col("place.each")) * F.col("length")).alias("offset"),
    )


def _interval(places: Column, rank: Column) -> Column:
    """The entry of places (rising, without gaps) that holds the rank, by halving. 24 steps are enough for 16 million entries, more than a row can hold."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(24))))
    start = lambda k: F.get(places, k)["lo"]
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < F.size(places)) & (start(at + step) <= rank), at + step).otherwise(at))
    return F.get(places, found)
