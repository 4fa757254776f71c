"""Near-duplicate detection: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .graph import components
from .store import Scratch

WIDTH, COORDINATES, BAND_ROWS = 5, 128, 4
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(values: np.ndarray, first: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of each set ``values[first[i]:first[i+1]]``: (sets, t) of uint64.

    Round i < t throws every element into a bin chosen by a hash of that round; round
    i >= t throws all of them into bin i - t, so every coordinate of a non-empty set is
    full after 2t rounds, and large sets stop after the first. A coordinate is the
    smallest (round, hash) that fell into it; two sets agree on it with the probability
    of their Jaccard similarity, concentrated as for t independent draws.
    """
    sets = len(first) - 1
    out = np.full((sets, t), _TOP, dtype=np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(first))
    shift, low = np.uint64(64 - int(t).bit_length() + 1), np.uint64((1 << 52) - 1)
    keys, live = values, owner
    for i in range(2 * t):
        if not len(keys):
            break
        h = T.mix(keys ^ _round_seeds(t)[i])
        bins = (h >> shift).astype(np.int64) if i < t else i - t
        np.minimum.at(out.reshape(-1), live * t + bins, (np.uint64(i) << np.uint64(52)) | (h & low))
        full = (out != _TOP).all(axis=1)
        if full[live].any():
            rest = ~full[live]
            keys, live = keys[rest], live[rest]
    return out


@lru_cache
def _round_seeds(t: int) -> np.ndarray:
    return T.seeds(2 * t, 4242)


def _texts_to_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row range, shingles, offsets) of a column, some hundred KB of text at a time."""
    offsets, data = T.utf8(column)
    for a, b in T.blocks(offsets, T.CHUNK):
        off, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        starts, ends, first = T.words(off, part)
        yield a, b, *T.shingle_sets(T.word_hashes(part, starts, ends), first, WIDTH)


def _segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return run[first[1:]] - run[first[:-1]]


_SKETCHES = "doc_id long, n long, set_a long, set_b long, bands array<long>, code binary"
#: A pair at similarity 0.75 agrees in 96 of 128 coordinates on average (deviation 4.9);
#: under 66 agreements (over six deviations) it is not verified.
_AGREE = 66
#: Buckets of more members are compared in cells of two blocks of about _BLOCK members.
_SMALL, _BLOCK = 16, 256
_FILTER_BITS = 26


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_bands = COORDINATES // BAND_ROWS
    factors = T.seeds(BAND_ROWS, 9)
    band_salt = T.seeds(n_bands, 5)
    for batch in batches:
        for a, b, grams, first in _texts_to_sets(batch.column(1)):
            s = sketch(grams, first)
            code = (T.mix(s) & np.uint64(255)).astype(np.uint8).tobytes()
            code = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((np.arange(b - a + 1, dtype=np.int32) * COORDINATES).tobytes()), pa.py_buffer(code)])
            s = s.reshape(b - a, n_bands, BAND_ROWS)
            keys = T.mix((s * factors).sum(axis=2, dtype=np.uint64) ^ band_salt)
            digest = [_segment_sum(T.mix(grams ^ np.uint64(c)), first).view(np.int64) for c in (0x1234567, 0x89ABCDEF01)]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * n_bands), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), *map(pa.array, digest), bands, code], ["doc_id", "n", "set_a", "set_b", "bands", "code"])


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, grams, first in _texts_to_sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(grams.view(np.int64)))], ["doc_id", "grams"])


def _promising_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (T.utf8(c)[1].reshape(-1, COORDINATES) for c in batch.columns[2:4])
        keep = pa.array((x == y).sum(axis=1) >= _AGREE, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        lo, do = T.utf8(batch.column(2))
        ro, dr = T.utf8(batch.column(3))
        for a, b in T.blocks(lo, T.CHUNK):
            sides = []
            for off, data in ((lo, do), (ro, dr)):
                o, d = off[a : b + 1] - off[a], data[off[a] : off[b]]
                starts, ends, first = T.words(o, d)
                sides.append(T.shingle_sets(T.word_hashes(d, starts, ends), first, WIDTH))
            (x, fx), (y, fy) = sides
            for i in range(b - a):
                u, v = x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]]
                both = np.sort(np.concatenate((u, v)))
                common = int((both[1:] == both[:-1]).sum())
                keep[a + i] = 100 * common >= 75 * (len(u) + len(v) - common) > 0
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each cell; its rows (key, i, j, blk, doc_id, part, text) come one after another."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        where = np.stack([rest.column(c).to_numpy() for c in range(3)])
        cuts = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1
        for a, b in zip(np.concatenate(([0], cuts[:-1])), cuts, strict=True) if len(cuts) else ():
            yield _cell_links(rest.slice(a, b - a))
        if len(cuts):
            rest = rest.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield _cell_links(rest)


def _cell_links(cell: pa.Table) -> pa.RecordBatch:
    i, j = cell.column(1)[0].as_py(), cell.column(2)[0].as_py()
    block, ids, part = (cell.column(c).to_numpy() for c in (3, 4, 5))
    grams, size = [], np.zeros(len(ids), np.int64)
    for a, b, g, first in _texts_to_sets(cell.column(6)):
        grams.append(g)
        size[a:b] = np.diff(first)
    owner = np.repeat(np.arange(len(ids)), size)
    _, where, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]), return_inverse=True, return_counts=True)
    shared = times[where] > 1
    owner, where = owner[shared], where[shared]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], np.unique(where[order], return_inverse=True)[1]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    common = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(where[-1]) + 1 if len(where) else 0, 2048):
        a, b = np.searchsorted(where, (lo, lo + 2048))
        has = np.zeros((len(ids), 2048), np.float32)
        has[owner[a:b], where[a:b] - lo] = 1
        common += has[left] @ has[right].T
    total = size[left][:, None] + size[right][None] - common
    x, y = np.nonzero((100 * common >= 75 * total) & (part[left][:, None] != part[right][None]))
    parent, found = {}, []

    def root(v: int) -> int:
        while parent.get(v, v) != v:
            v = parent[v]
        return v

    for u, v in zip(left[x], right[y], strict=True):
        ru, rv = root(part[u]), root(part[v])
        if ru != rv:
            parent[max(ru, rv)] = min(ru, rv)
            found.append((ids[u], ids[v]))
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their sets of distinct five-word
    shingles is 0.75 or more; a component is what links reach.

    Plan: (1) one pass makes sketches (128 coordinates, 32 bands of 4: a pair at exactly
    0.75 shares no band with probability 5e-6) and a 128-bit digest of each set. (2)
    Documents with equal sets collapse to the smallest id. (3) Band buckets of two or
    more sets compare every member with one leader: a star, linear in the bucket, not
    its square. Pairs whose sketches agree are joined with their texts and the links
    confirmed on full sets. (4) Components of the links. Leaders, compared with all of
    their bucket, leave it. What is unsettled are pairs of members of one bucket in
    different components. Members with too many shingles of their own for any link leave
    as well. The rest is compared, in small buckets pair by pair, in large ones block by
    block within a task. So every pair that shares a bucket is compared, connected already
    or excluded by a bound, and no large group is made into rows of pairs.

    Nulls, empty texts and texts without words have no shingles and link with
    nothing. A row without id is never linked; its component is null and it is kept.
    Rows repeating an id: each yields a row, linked if any of them is. Empty table:
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = scratch.save(rows.mapInArrow(_sketch_batches, _SKETCHES), "sketches")
    sets = scratch.save(
        sketches.where("doc_id is not null and n > 0").groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("code").alias("code")), "sets"
    )
    keyed = sets.select("rep", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("lead")).where("c > 1").select("key", "lead")
    members = scratch.save(keyed.join(shared, "key"), "members")
    facts = scratch.save(sets.select("rep", "n", F.lit(0).cast("long").alias("u"), "code").join(members.select("rep").distinct(), "rep", "left_semi"), "facts")
    # Only texts in some bucket of two take part from here on.
    # An inner join: Spark would push a semi-join below the filter, to where all texts are shuffled.
    ids = facts.select(F.col("rep").alias("doc_id")).distinct()
    texts = scratch.save(_perhaps_in(rows, ids).join(ids, "doc_id"), "texts")
    stars = members.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    links = _linked(stars, facts, texts, scratch)
    parts = scratch.save(components(links, scratch), "components")
    # What is left: buckets of several components, without the leaders compared with all others.
    label = parts.select(F.col("node").alias("rep"), F.col("component").alias("part"))
    left = members.where("rep <> lead").select("key", "rep").join(label, "rep", "left").select("key", "rep", F.coalesce("part", "rep").alias("part"))
    left = scratch.save(_mixed(left), "left")
    if not left.isEmpty():
        facts = scratch.save(_own_shingles(facts, texts, left), "facts")
        left = left.drop("m").join(facts.where("4 * (n - u) >= 3 * n").select("rep", "n", "u"), "rep")
        left = scratch.save(_mixed(left), "left")
        small = left.where(f"m <= {_SMALL}")
        one, other = (small.select("key", F.col("rep").alias(x), F.col("part").alias(f"p{x}"), F.col("n").alias(f"n{x}"), F.col("u").alias(f"u{x}")) for x in "ab")
        pairs = one.join(other, "key").where("a > b and pa <> pb and 7 * least(na - ua, nb - ub) >= 3 * (na + nb)").select("a", "b").distinct()
        more = _linked(pairs.join(stars, ["a", "b"], "left_anti"), facts, texts, scratch).union(_linked_in_cells(left.where(f"m > {_SMALL}"), texts, scratch))
        parts = scratch.save(components(links.union(more), scratch), "components")
    belongs = sets.select("set_a", "set_b", "n", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    belongs = belongs.select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"))
    return sketches.select("doc_id", "n", "set_a", "set_b").join(belongs, ["set_a", "set_b", "n"], "left").select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def _perhaps_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose doc_id is not in ``ids``; none that is in ``ids`` goes.

    One bit for each hash of an id, in bitmaps of 4 KiB: 2 ** _FILTER_BITS bits or 8 MiB at
    most, however many ids there are. So texts that no bucket needs are not shuffled. With
    very many ids all bits are set and all rows stay; the exact join after it decides.
    """
    bit = F.xxhash64("doc_id").bitwiseAND((1 << _FILTER_BITS) - 1)
    maps = ids.select(F.shiftright(bit, 15).alias("_at"), bit.bitwiseAND(32767).alias("_bit")).groupBy("_at").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    placed = rows.where("doc_id is not null").withColumn("_at", F.shiftright(bit, 15)).join(F.broadcast(maps), "_at")
    byte = F.conv(F.hex(F.substring("_map", (F.shiftright(bit.bitwiseAND(32767), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return placed.where(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1).select(*rows.columns)


def _side(facts: DataFrame, x: str) -> DataFrame:
    return facts.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("u").alias(f"u{x}"), F.col("code").alias(f"c{x}"))


def _linked(pairs: DataFrame, facts: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are links: sketches first, then full sets."""
    # With k = min(own shingles of a, of b that others have), the similarity is at most k / (na + nb - k).
    coded = pairs.join(_side(facts, "a"), "a").join(_side(facts, "b"), "b").where("7 * least(na - ua, nb - ub) >= 3 * (na + nb)")
    pairs = scratch.save(coded.select("a", "b", "ca", "cb").mapInArrow(_promising_batches, "a long, b long"), "pairs")
    sides = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return scratch.save(sides.select("a", "b", "ta", "tb").mapInArrow(_verify_batches, "a long, b long").distinct(), "links")


def _linked_in_cells(left: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between components within large buckets, without making the pairs as rows.

    A bucket's members fall into blocks of about ``_BLOCK`` by a hash; a cell is a pair
    of blocks. A task gets the texts of a cell and intersects its sets at once, and
    reports only links that join components.
    """
    blocks = F.ceil(F.col("m") / F.lit(_BLOCK)).cast("int")
    placed = left.select("key", "rep", "part", blocks.alias("k")).withColumn("blk", F.pmod(F.xxhash64("rep"), "k").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cells = placed.select("key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", F.col("rep").alias("doc_id"), "part").join(texts, "doc_id")
    dealt = cells.select("key", "i", "j", "blk", "doc_id", "part", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return scratch.save(dealt.mapInArrow(_cell_batches, "a long, b long").distinct(), "cell-links")


def _mixed(members: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, and m, their number in the bucket."""
    mixed = members.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("key", "m")
    return members.join(mixed, "key")


def _own_shingles(facts: DataFrame, texts: DataFrame, left: DataFrame) -> DataFrame:
    """``facts`` with u: how many of its shingles a document shares with no other one of ``left``.

    It can link only if 3/4 of its shingles occur elsewhere, so that a heavily
    edited copy is settled by counting, not by comparing it with its whole family.
    """
    some = texts.join(left.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    grams = some.mapInArrow(_shingle_batches, "doc_id long, grams array<long>").select("doc_id", F.explode("grams").alias("g"))
    lone = grams.groupBy("g").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")).where("rep = other").groupBy("rep").agg(F.count(F.lit(1)).alias("lone"))
    return facts.drop("u").join(lone, "rep", "left").select("rep", "n", F.coalesce("lone", F.lit(0)).alias("u"), "code")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
