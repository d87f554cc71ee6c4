"""What the operators of this subpackage share: the scratch folder, word shingles, and batches of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.sources.scratch import materialise, scratch_path

__all__ = ["materialise", "scratch_path"]

SHINGLE_WORDS = 5

#: A-Z to a-z, byte by byte; words end at the ASCII white space bytes 0x20 and 0x09 to 0x0D.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: An odd multiplier and its inverse modulo 2**64, so that a word's hash does not depend on its place.
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


#: Texts are hashed in blocks of this many bytes, so the tables and the working memory do not grow with a text.
BLOCK_BYTES = 1 << 16
UP, DOWN = _powers(_BASE, BLOCK_BYTES + 1), _powers(_BASE_INVERSE, BLOCK_BYTES + 1)


def running_hash(data: np.ndarray) -> np.ndarray:
    """total[k]: hash of the first k bytes of a block, so that (total[b] - total[a]) * DOWN[a] is that of bytes a to b."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * UP[: len(data)], out=total[1:])
    return total


def word_hashes(texts: list[bytes], separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and for each text the number of words before it (one more entry at the end).

    A block ends with a word. A word longer than a block is hashed by itself, so equal words always have equal hashes.
    """
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    counts = np.zeros(len(begins), dtype=np.int64)
    out: list[np.ndarray] = []
    at = 0
    while at < len(data):
        block = data[at : at + BLOCK_BYTES]
        space = separators[block]
        if at + len(block) < len(data):
            ends = np.flatnonzero(space)
            if len(ends):
                block, space = block[: ends[-1] + 1], space[: ends[-1] + 1]
            else:  # the middle of one word
                stop = at + len(block)
                while not separators[data[stop]]:
                    stop += 1
                counts += begins > at
                out.append(_long_word(joined[at:stop]))
                at = stop
                continue
        start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        total = running_hash(_LOWER[block])
        out.append(mix((total[end] - total[start]) * DOWN[start]))
        counts += np.searchsorted(start, begins - at)
        at += len(block)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64), counts


def _long_word(word: bytes) -> np.ndarray:
    lower = _LOWER[np.frombuffer(word, dtype=np.uint8)].tobytes()
    return np.frombuffer(hashlib.blake2b(lower, digest_size=8).digest(), dtype=np.uint64)


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; it has n - 1 entries fewer than words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(len(words) - n + 1, dtype=np.uint64)
    for at in range(0, len(out), BLOCK_BYTES):
        part = np.full(min(BLOCK_BYTES, len(out) - at), n, dtype=np.uint64)
        for k in range(n):
            part = part * np.uint64(_BASE) + words[at + k : at + k + len(part)]
        out[at : at + len(part)] = mix(part)
    return out


def shingle_runs(texts: list[bytes], separators: np.ndarray = _SPACE) -> list[np.ndarray]:
    """Each text's five-word shingles in order, as hashes; with fewer words the whole sequence is the only one."""
    words, at = word_hashes(texts, separators)
    runs = rolling(words, SHINGLE_WORDS)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= SHINGLE_WORDS:
            out.append(runs[a : b - SHINGLE_WORDS + 1])
        else:
            out.append(rolling(words[a:b], int(b - a)) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def in_chunks(texts: Iterable[bytes], limit: int = _CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The texts in lists of about limit bytes; a longer text is alone."""
    chunk: list[bytes] = []
    size = 0
    for t in texts:
        if chunk and size + len(t) > limit:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t)
    if chunk:
        yield chunk


def small_batches(batches: Iterable[pa.RecordBatch], column: int, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose text (or bytes) column holds about limit bytes; a longer text is alone."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


#: A key with more than this share of all rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """left joined to right by key, no task holding more than HOT_SHARE of left for one key.

    right: written rows, one for each key, with the number of rows of left in the column weight. Hot keys are at most
    1 / HOT_SHARE rows, so they are sent to all tasks; the rest is an ordinary join. how: inner or left.
    """
    total, most = right.agg(F.sum(weight), F.max(weight)).first()
    limit = max(1000, int(HOT_SHARE * (total or 0)))
    if (most or 0) <= limit:
        return left.join(right, key, how)
    hot = right.filter(F.col(weight) > limit)
    cold = right.filter(F.col(weight) <= limit)
    few = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return few.unionByName(rest)


#: Bounds of a bitmap that tasks get, in bits: 128 KB to 16 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def split_by_bitmap(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose key (a long) may be in keys (one written column, k), and those whose key is not.

    A bitmap of bounded size tells them apart while the rows are read, so the others are not shuffled. It has eight bits for
    each key; beyond MOST_BITS more rows pass that are not in keys.
    """
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * n + 1).bit_length()))
    place = lambda c: F.pmod(c, F.lit(bits))
    blocks = keys.select(place(F.col("k")).alias("p")).groupBy(F.expr("p div 32768").alias("bit_block")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits"))
    # As 512 longs, from which one is picked by number.
    blocks = blocks.select("bit_block", F.expr("transform(sequence(0, 511), k -> cast(conv(hex(substring(bits, k * 8 + 1, 8)), 16, -10) as bigint))").alias("bit_set"))
    marked = rows.withColumn("bit_place", place(key)).withColumn("bit_block", F.expr("bit_place div 32768")).join(F.broadcast(blocks), "bit_block", "left")
    shift = ((F.lit(7) - F.expr("(bit_place % 64) div 8")) * 8 + F.expr("bit_place % 8")).cast("int")
    marked = marked.withColumn("bit_near", F.coalesce(F.call_function("shiftrightunsigned", F.get("bit_set", F.expr("cast((bit_place % 32768) div 64 as int)")), shift).bitwiseAND(F.lit(1)) == 1, F.lit(False)))
    names = rows.columns
    return marked.filter("bit_near").select(*names), marked.filter("not bit_near").select(*names)


def drop_rows(docs: DataFrame, gone: DataFrame, once: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose (id, text) is in gone, and with one row of each (id, text) in once.

    gone and once: written tables of own_id and own_sha, as row_key() gives them. Other rows are not shuffled.
    """
    own_id, own_sha = row_key(id_col, text_col)
    keyed = docs.select(F.struct("*").alias("row"), own_id.alias("own_id"), own_sha.alias("own_sha"))
    hashed = F.xxhash64("own_id", "own_sha")
    near, other = split_by_bitmap(keyed, hashed, materialise(gone.unionByName(once).select(hashed.alias("k")), "places"))
    out = other.unionByName(near.join(gone.unionByName(once), ["own_id", "own_sha"], "left_anti"))
    if not once.isEmpty():
        out = out.unionByName(near.join(once, ["own_id", "own_sha"], "left_semi").dropDuplicates(["own_id", "own_sha"]))
    return out.select("row.*")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """What tells rows of documents apart: the id as text (null: empty) and the SHA-256 of the text (null: empty)."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
