"""Vectorised text primitives over Arrow string columns (numpy), and the bounded sample that models are fitted on.

Every text primitive works on whole texts; temporaries are bounded by ``CHUNK`` bytes
of text (or one word, if a word is longer), not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: For classifiers: what separates words besides spaces, ASCII control bytes and punctuation.
NOT_WORD = np.zeros(256, dtype=bool)
NOT_WORD[:128] = [not chr(c).isalnum() for c in range(128)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _IPOW = _powers(_BASE, CHUNK + 1), _powers(_INV, CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(salt)) | U64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    if data is None or offsets[-1] == 0:
        return offsets - offsets[0], np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text; a longer text stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def words(offsets: np.ndarray, data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes, and per text the first word's index.

    Spaces are the ASCII ones (0x20, 0x09-0x0D); a word never spans two texts.
    """
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    solid = ~space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased; equal words have equal hashes anywhere."""
    out = np.empty(len(starts), dtype=U64)
    a, n = 0, len(starts)
    while a < n:
        b = int(np.searchsorted(ends, starts[a] + CHUNK, "right"))
        if b <= a:  # one word of more than CHUNK bytes
            out[a] = xxhash.xxh3_64_intdigest(_LOWER[data[starts[a] : ends[a]]].tobytes())
            a += 1
            continue
        lo, hi = starts[a], ends[b - 1]
        run = np.empty(hi - lo + 1, dtype=U64)
        run[0] = 0
        np.cumsum((_LOWER[data[lo:hi]].astype(U64) + U64(1)) * _POW[: hi - lo], out=run[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((run[e] - run[s]) * _IPOW[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        a = b
    return out


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``width``-word shingles of each text, and their offsets.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    factors = seeds(width, 77)
    n = len(hashes)
    grams = np.zeros(max(0, n - width + 1), dtype=U64)
    for j in range(width):
        grams += hashes[j : n - width + 1 + j] * factors[j] if len(grams) else 0
    grams = mix(grams)
    parts, sizes = [], np.zeros(len(first), dtype=np.int64)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            x = np.sort(grams[a : b - width + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            short = int((hashes[a:b] * factors[: b - a]).sum(dtype=U64))
            x = mix(np.array([(short + int(b - a) * 0xA0761D6478BD642F) % (1 << 64)], dtype=U64))
        else:
            continue
        parts.append(x)
        sizes[i + 1] = len(x)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.cumsum(sizes)


def bounded_sample(rows: DataFrame, id_col: str, size_col: str, group: str | None, most_rows: int, most_bytes: int) -> DataFrame:
    """The rows of the smallest hashed ids: at most ``most_rows`` a group and ``most_bytes`` of text (or one row).

    A first pass counts the groups, with map-side sums. Of a large group only ids under a hash bound that lets about one and a
    half times the wanted rows pass are ranked, so that no task ranks a group that grows with the data.
    """
    own = group or "_all"
    rows = rows if group else rows.withColumn("_all", F.lit(0))
    counts = rows.groupBy(own).agg(F.count(F.lit(1)).alias("_n"))
    hashed = F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) / float(1 << 40)
    near = rows.join(F.broadcast(counts), own).where(hashed * F.col("_n") < 1.5 * most_rows + 50)  # a row a group: languages, or one
    order = Window.partitionBy(own).orderBy(F.xxhash64(id_col), id_col, size_col)
    so_far = F.sum(size_col).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = near.withColumns({"_rank": F.row_number().over(order), "_sum": so_far})
    kept = ranked.where((F.col("_rank") <= most_rows) & ((F.col("_sum") <= most_bytes) | (F.col("_rank") == 1)))
    return kept.drop("_n", "_rank", "_sum", *([] if group else ["_all"]))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
