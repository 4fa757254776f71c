"""Benchmark decontamination by greedy string tiling (running Karp-Rabin)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T

#: Shortest tile, in words; share of an item's words that tiles must cover.
MIN_TILE, THRESHOLD = 5, 0.6
#: Benchmark text (bytes) that one block may hold; more is taken in further blocks.
BLOCK_BYTES = 16 << 20


class Items:
    """One block of benchmark items, indexed by the hash of every ``MIN_TILE``-word seed."""

    def __init__(self, ids: list[int], texts: list[str | None], min_tile: int, threshold: float):
        offsets, data = T.utf8(pa.array(texts, pa.string()))
        starts, ends, first = T.words(offsets, data)
        hashes = T.word_hashes(data, starts, ends)
        self.ids, self.s, self.threshold = np.asarray(ids, np.int64), min_tile, threshold
        self.words = [hashes[first[i] : first[i + 1]] for i in range(len(ids))]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        seeds, item, at = [], [], []
        for i, w in enumerate(self.words):
            h = rolling(w, self.reach(i))
            seeds.append(h)
            item.append(np.full(len(h), i))
            at.append(np.arange(len(h)))
        none = np.zeros(0, np.uint64)
        seeds, item, at = (np.concatenate([none, *x]) for x in (seeds, item, at))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.at = seeds[order], item[order].astype(np.int64), at[order].astype(np.int64)
        self.own = []  # per item its sorted seeds and their positions
        for i, w in enumerate(self.words):
            h = rolling(w, self.reach(i))
            by = np.argsort(h, kind="stable")
            self.own.append((h[by], by))
        self.reaches = sorted({self.reach(i) for i in range(len(ids)) if self.lengths[i]})

    def reach(self, i: int) -> int:
        """Seed length of item i: an item of fewer words than a tile is one seed."""
        return min(self.s, int(self.lengths[i]))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin fingerprints of all windows of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0 or width <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for factor, j in zip(T.seeds(width, 31), range(width), strict=True):
        out += words[j : j + n] * factor
    return T.mix(out ^ np.uint64(width))


#: Seed matches of one pair that are looked at together.
_HITS = 1 << 20


def matches(doc: np.ndarray, item: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, position in item, position in doc) of the maximal matches that hold a seed.

    ``at`` are seed positions of the doc; ``place[low[i] : high[i]]`` the item's positions with the seed of ``at[i]``. Seeds that
    follow one another on a diagonal are one match. They are taken in runs of about ``_HITS``, so that the memory
    grows with the matches of a pair (at most one a diagonal and break), not with its seeds.
    """
    count = high - low
    ends = np.cumsum(count)
    begin, p_all, q_all, n_all = 0, [], [], []
    while begin < len(at):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _HITS, "right")))
        n = count[begin:stop]
        p = np.repeat(at[begin:stop], n)
        q = place[np.repeat(low[begin:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        same = np.ones(len(p), bool)
        for j in range(least):  # words are compared, not only fingerprints
            same &= doc[p + j] == item[q + j]
        p, q = p[same], q[same]
        by = np.lexsort((p, p - q))
        p, q = p[by], q[by]
        fresh = np.concatenate(([True], (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)))[: len(p)]
        first = np.flatnonzero(fresh)
        p_all.append(p[first])
        q_all.append(q[first])
        n_all.append(np.diff(np.append(first, len(p))))
        begin = stop
    p, q, n = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (p_all, q_all, n_all))
    by = np.lexsort((p, p - q))  # matches that a cut between two runs of seeds has parted
    p, q, n = p[by], q[by], n[by]
    if not len(p):
        return n, q, p
    fresh = np.concatenate(([True], (p[1:] != p[:-1] + n[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1])))
    first = np.flatnonzero(fresh)
    return np.add.reduceat(n, first) + least - 1, q[first], p[first]


def tile(doc_words: int, item_words: int, found: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> np.ndarray:
    """Mask of the item's words covered by greedy string tiling.

    Again and again the longest match whose words are unmarked on both sides is marked, until none of
    ``least`` words is left; ties go to the earliest in the item, then in the doc. A match that tiles have cut
    goes back to the queue as its unmarked stretches, which are shorter.
    """
    in_doc, in_item = np.zeros(doc_words, bool), np.zeros(item_words, bool)
    queue = [(-n, q, p) for n, q, p in zip(*(x.tolist() for x in found), strict=True)]
    heapq.heapify(queue)
    while queue:
        n, q, p = heapq.heappop(queue)
        marked = in_doc[p : p - n] | in_item[q : q - n]
        if not marked.any():
            in_doc[p : p - n] = in_item[q : q - n] = True
            continue
        edges = np.concatenate(([-1], np.flatnonzero(marked), [-n]))
        for i in np.flatnonzero(np.diff(edges) > least):
            a = int(edges[i]) + 1
            heapq.heappush(queue, (a - int(edges[i + 1]), q + a, p + a))
    return in_item


def score(doc: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(item index, words covered, seeds hit) of every item that shares a seed with the text."""
    out = []
    for width in items.reaches:
        h = rolling(doc, width)
        if not len(h) or not len(items.seeds):
            continue
        lo, hi = np.searchsorted(items.seeds, h, "left"), np.searchsorted(items.seeds, h, "right")
        # The distinct (item, seed) groups that the text meets, then the text's positions of each item.
        met = np.unique(lo[hi > lo])
        owners = np.unique(np.concatenate([np.zeros(0, np.int64), *(items.item[a : np.searchsorted(items.seeds, items.seeds[a], "right")] for a in met)]))
        for i in owners:
            i = int(i)
            if items.reach(i) != width:
                continue
            seeds, place = items.own[i]
            low, high = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
            hit = np.flatnonzero(high > low)
            # Words under any seed bound what tiles can cover: an exact way to leave hopeless pairs.
            under = np.zeros(int(items.lengths[i]) + 1, np.int64)
            edge = np.zeros(len(seeds) + 1, np.int64)
            np.add.at(edge, low[hit], 1)
            np.add.at(edge, high[hit], -1)
            q = place[np.cumsum(edge)[:-1] > 0]
            np.add.at(under, q, 1)
            np.add.at(under, np.minimum(q + width, len(under) - 1), -1)
            if int((np.cumsum(under)[:-1] > 0).sum()) < items.threshold * items.lengths[i]:
                continue
            found = matches(doc, items.words[i], hit, low[hit], high[hit], place, width)
            out.append((i, int(tile(len(doc), len(items.words[i]), found, width).sum()), int((high - low).sum())))
    return out


_PAIRS = "doc_id long, item_id long, covered long, item_words long"


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, covered, item_words) of every pair whose tiles cover the threshold.

    A pair of a document and an item is tiled when they share a seed of ``min_tile``
    words; covered counts the item's words under tiles, in any order, so a reordered
    passage counts as a verbatim one. The items are a query set taken in blocks of at
    most ``block_bytes`` of text: the driver streams the items, holds one block and
    broadcasts it; documents are scanned once a block and never shuffled. Null or empty texts on either side match nothing. Repeated rows of
    either side give repeated results. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for ids, texts in _item_blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast((ids, texts))

        def batches(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value, min_tile, threshold)
            for batch in source:
                doc_ids = batch.column(0)
                offsets, data = T.utf8(batch.column(1))
                row, item, covered, length = [], [], [], []
                for a, b in T.blocks(offsets, T.CHUNK):
                    off, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                    starts, ends, first = T.words(off, part)
                    hashes = T.word_hashes(part, starts, ends)
                    for i in _touched(hashes, first, items):
                        for k, n, _ in score(hashes[first[i] : first[i + 1]], items):
                            if n >= threshold * items.lengths[k]:
                                row.append(a + i)
                                item.append(items.ids[k])
                                covered.append(n)
                                length.append(items.lengths[k])
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(covered, pa.int64()), pa.array(length, pa.int64())], ["doc_id", "item_id", "covered", "item_words"])

        part = rows.mapInArrow(batches, _PAIRS)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], _PAIRS)
    return out


def _touched(hashes: np.ndarray, first: np.ndarray, items: Items) -> np.ndarray:
    """Texts of a block with any seed in the index."""
    touched = np.zeros(len(first) - 1, bool)
    if not len(items.seeds):
        return np.flatnonzero(touched)
    for width in items.reaches:
        h = rolling(hashes, width)
        if len(h):
            lo = np.minimum(np.searchsorted(items.seeds, h), len(items.seeds) - 1)
            at = np.flatnonzero(items.seeds[lo] == h)
            touched[np.searchsorted(first, at, "right") - 1] = True
    return np.flatnonzero(touched)


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The benchmark's (ids, texts) in blocks; the driver holds one block at a time."""
    items = benchmark.where("item_id is not null and length(trim(text)) > 0").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text.encode())
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, contaminated, item_id, coverage.

    coverage is the highest share of an item's words covered by tiles of the text among
    items at or over the threshold (0 if none), item_id that item (the smallest of
    equals; null if none). Rows without doc_id cannot be told apart and are reported
    clean; repeated doc_ids share the worse verdict. Empty tables: no rows, or all clean.
    """
    worst = (
        contaminated_rows(docs, benchmark, **settings)
        .where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.struct((F.col("covered") / F.col("item_words")).alias("coverage"), (-F.col("item_id")).alias("item"))).alias("best"))
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(worst, "doc_id", "left").select(
        "doc_id",
        F.col("best").isNotNull().alias("contaminated"),
        (-F.col("best.item")).alias("item_id"),
        F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
