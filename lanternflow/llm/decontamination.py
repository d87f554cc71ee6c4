"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the number of their shingles: class k holds sizes in [2**k, 2**(k+1)).
For class k a document is read in windows of 4 * 2**k shingles, each 2 * 2**k after the last, so that
an item that lies in the document lies whole in one window, whatever the document's length. Between
such a window and an item that is contained to 0.8, the Jaccard similarity is at least
0.8 / 4.2 = 0.19, and one of the 64 minimum hashes agrees but for a probability of 1.4e-6. Windows
share the minima of base blocks, so a hash function costs one pass over the shingles.

Each candidate is verified by exact containment: the shingles of the item that the whole document has,
over all of the item's shingles.

Items are a stated query set. They are searched in blocks of a fixed number of items; a block is sent
to all tasks, and documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.llm.shared import SHINGLE_WORDS, in_chunks, materialise, mix, rolling, small_batches, split_by_bitmap, word_hashes

HASHES = 64
THRESHOLD = 0.8
ITEMS_PER_BLOCK = 20_000

#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII; all else separates them.
_SEPARATORS = np.ones(256, dtype=bool)
_SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_MULTIPLIERS = mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64)) | np.uint64(1)


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode()


class ItemIndex:
    """Minimum hashes and shingles of a block of test items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.words: list[int] = []
        for chunk in in_chunks([_bytes(t) for _, t in items]):
            at0 = len(self.words)
            words, at = word_hashes(chunk, _SEPARATORS)
            for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
                n = min(int(b - a), SHINGLE_WORDS)
                self.ids.append(items[at0 + k][0])
                self.sets.append(np.unique(rolling(words[a:b], n)) if n else np.zeros(0, np.uint64))
                self.words.append(n)
        #: By (words in a shingle, size class): the sorted minima of each hash function and the items they belong to.
        self.classes: dict[tuple[int, int], list[int]] = {}
        for i, (s, n) in enumerate(zip(self.sets, self.words)):
            if len(s):
                self.classes.setdefault((n, len(s).bit_length() - 1), []).append(i)
        self.minima: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for key, own in self.classes.items():
            tables = []
            for m in _MULTIPLIERS:
                least = np.array([(self.sets[i] * m).min() for i in own], dtype=np.uint64)
                order = np.argsort(least, kind="stable")
                tables.append((least[order], np.array(own)[order]))
            self.minima[key] = tables

    def contained(self, i: int, runs: dict[int, np.ndarray], threshold: float) -> tuple[int, float, int] | None:
        """(item id, containment, shared shingles) of item i in a document, if it reaches the threshold. runs: the document's shingles, by their words."""
        shared = int(np.isin(self.sets[i], runs[self.words[i]]).sum())
        return (self.ids[i], shared / len(self.sets[i]), shared) if shared >= threshold * len(self.sets[i]) else None


class _WindowSearch:
    """The window minima of many documents at once, looked up among those of the items: first in a bitmap, then in the sorted table."""

    def __init__(self, index: ItemIndex):
        self.index = index
        self.filters: dict[tuple[int, int], np.ndarray] = {}
        for key, tables in index.minima.items():
            bits = np.zeros(1 << 20, dtype=bool)
            for least, _ in tables:
                bits[(mix(least) >> np.uint64(44)).astype(np.int64)] = True
            self.filters[key] = bits

    def candidates(self, words: np.ndarray, at: np.ndarray) -> tuple[set[tuple[int, int]], dict[int, np.ndarray]]:
        """(document of the chunk, item) pairs with a minimum in common, and the chunk's shingles by their words."""
        runs = {n: rolling(words, n) for n in {n for n, _ in self.index.classes}}
        out: set[tuple[int, int]] = set()
        for (n, k), bits in self.filters.items():
            run = runs[n]
            size = np.maximum(0, np.diff(at) - n + 1)
            full = np.flatnonzero(size)
            if not len(full):
                continue
            half = 2 << k
            count = -(-size[full] // half)
            owner = np.repeat(full, count)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            starts = at[owner] + nth * half
            # A block ends where the document's shingles end: an odd entry of the index pairs is thrown away.
            ends = np.minimum(starts + half, at[owner] + size[owner])
            edges = np.stack([starts, ends], axis=1).ravel()
            edges = edges[:-1] if edges[-1] == len(run) else edges
            last = np.zeros(len(owner), dtype=bool)
            last[np.cumsum(count) - 1] = True
            pair = ~last[:-1]
            for m, (minima, items) in zip(_MULTIPLIERS, self.index.minima[n, k]):
                least = np.minimum.reduceat(run * m, edges)[::2]
                window = least.copy()
                window[:-1][pair] = np.minimum(least[:-1][pair], least[1:][pair])
                hit = np.flatnonzero(bits[(mix(window) >> np.uint64(44)).astype(np.int64)])
                lo, hi = np.searchsorted(minima, window[hit], "left"), np.searchsorted(minima, window[hit], "right")
                for j in np.flatnonzero(hi > lo):
                    out.update((int(owner[hit[j]]), int(i)) for i in items[lo[j] : hi[j]])
        return out, runs


class _Finder:
    def __init__(self, items: list[tuple[int, str | None]], threshold: float):
        self.index = ItemIndex(items)
        self.fast = _WindowSearch(self.index)
        self.threshold = threshold

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, int]]:
        """(number of the text, item id, containment, shared shingles) of all pairs."""
        begin = 0
        for chunk in in_chunks([_bytes(t) for t in texts]):
            words, at = word_hashes(chunk, _SEPARATORS)
            near, runs = self.fast.candidates(words, at)
            for d, i in sorted(near):
                a, b = int(at[d]), int(at[d + 1])
                found = self.index.contained(i, {n: r[a : max(a, b - n + 1)] for n, r in runs.items()}, self.threshold)
                if found:
                    yield begin + d, *found
            begin += len(chunk)


def _searcher(items: list[tuple[int, str | None]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(items, threshold)
        for batch in small_batches(batches, 1):
            ids = batch.column(0).to_pylist()
            rows = [(ids[row], *found) for row, *found in find(batch.column(1).to_pylist())]
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "containment", "n_shared"])

    return run


def _block(wanted: DataFrame, k: int, n_blocks: int) -> list[tuple[int, str | None]]:
    """Block k of the items: about items_per_block rows, however many items there are."""
    return [(r["id"], r["text"]) for r in wanted.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).collect()]


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """doc_id, item_id, containment and n_shared of all pairs with containment of at least threshold.

    Words are runs of letters and digits in lower case, so other punctuation or line breaks hide nothing. An
    item of fewer than five words is its whole sequence, looked for as such; an item without words is found
    nowhere. Null texts hold nothing. Rows that repeat an id are searched each, and equal results of an id are
    listed once. Other columns are not read. Without items, or without documents, there are no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    wanted = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    n_blocks = max(1, -(-wanted.count() // items_per_block))
    schema = "doc_id long, item_id long, containment double, n_shared long"
    out = None
    for k in range(n_blocks):
        found = source.mapInArrow(_searcher(_block(wanted, k, n_blocks), threshold), schema)
        if n_blocks > 1:
            found = materialise(found, "found")
        out = found if out is None else out.union(found)
    return out.distinct()


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """The rows of docs that contain no test item, with all their columns. With one block of items the decision is made where a row is read."""
    wanted = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    n_blocks = max(1, -(-wanted.count() // items_per_block))

    def searched(block: list[tuple[int, str | None]], at: int, wanted_rows: bool):
        """Rows without an item; or, of rows of digest and text, the digests of those with one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = _Finder(block, threshold)
            for batch in small_batches(batches, at):
                mask = np.full(batch.num_rows, wanted_rows)
                mask[[row for row, *_ in find(batch.column(at).to_pylist())]] = not wanted_rows
                kept = batch.filter(pa.array(mask))
                yield kept if wanted_rows else kept.select([0])

        return run

    if n_blocks == 1:
        return docs.mapInArrow(searched(_block(wanted, 0, 1), docs.columns.index(text_col), True), docs.schema)
    # Many items: a pass for each block lists the texts that hold one, and then all go at once.
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("text_sha")
    gone = None
    for k in range(n_blocks):
        found = materialise(docs.select(digest, text.alias("text")).mapInArrow(searched(_block(wanted, k, n_blocks), 1, False), "text_sha binary"), "contaminated")
        gone = found if gone is None else gone.union(found)
    gone = materialise(gone.distinct(), "gone")
    hashed = F.xxhash64("text_sha")
    near, other = split_by_bitmap(docs.select(F.struct("*").alias("row"), digest), hashed, materialise(gone.select(hashed.alias("k")), "places"))
    return other.unionByName(near.join(gone, "text_sha", "left_anti")).select("row.*")

