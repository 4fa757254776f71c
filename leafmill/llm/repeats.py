"""Repeated-substring removal with suffix arrays built by two-stage sorting."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .store import Scratch

#: Length of a repeated string, and of the anchors that route its occurrences together.
LENGTH, ANCHOR = 50, 26
_WINDOW = LENGTH - ANCHOR + 1


# ---- suffix arrays -------------------------------------------------------------


def suffix_array(s: np.ndarray, wanted: np.ndarray | None = None, depth: int | None = None) -> np.ndarray:
    """Suffixes of ``s`` (small non-negative ints) in order, by two-stage sorting.

    Type-B suffixes are smaller than their successor, type-A ones larger (or the last).
    Only type B is sorted directly; type A is induced: scanning the array upwards,
    the predecessor of each entry, if of type A, goes to the front of its bucket. A
    bucket's type-A suffixes precede its type-B ones.

    With ``wanted`` (a mask), only these suffixes and those they are induced from are
    sorted; with ``depth``, suffixes that agree in so many symbols may stand in any order.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    s = s.astype(np.int64)
    b = np.zeros(n, bool)
    change = np.flatnonzero(s[:-1] != s[1:]) if n > 1 else np.zeros(0, np.int64)
    # Position i has the type of the first unequal neighbours at or after it; the tail is type A.
    nxt = np.searchsorted(change, np.arange(n))
    inside = nxt < len(change)
    at = change[nxt[inside]]
    b[np.flatnonzero(inside)] = s[at] < s[at + 1]
    need = np.ones(n, bool) if wanted is None else _with_sources(wanted, b)
    size = np.bincount(s[need])
    head = np.concatenate(([0], np.cumsum(size)))
    order = np.full(head[-1], -1, np.int64)
    direct = _sorted_directly(s, np.flatnonzero(b & need), depth or n)
    per = np.bincount(s[direct], minlength=len(size))
    first_b = head[1:] - per  # type B sits at the end of its bucket
    order[first_b[s[direct]] + np.arange(len(direct)) - np.concatenate(([0], np.cumsum(per)))[s[direct]]] = direct
    fill = head[:-1].copy()
    if need[n - 1]:
        order[fill[s[n - 1]]] = n - 1
        fill[s[n - 1]] += 1
    induced = need & ~b
    for c in np.flatnonzero(size):
        lo = head[c]
        while lo < fill[c]:  # type A of this bucket, as far as induced; may induce more of it
            hi = fill[c]
            _induce(order[lo:hi], s, induced, order, fill)
            lo = hi
        _induce(order[first_b[c] : head[c + 1]], s, induced, order, fill)
    return order


def _with_sources(wanted: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``wanted`` and, after each type-A position of it, all up to the next type-B one."""
    n = len(b)
    stop = np.append(np.flatnonzero(b), n - 1)
    from_a = np.flatnonzero(wanted & ~b)
    edge = np.bincount(from_a, minlength=n + 1) - np.bincount(stop[np.searchsorted(stop[:-1], from_a)] + 1, minlength=n + 1)
    return wanted | (np.cumsum(edge)[:n] > 0)


def _induce(entries: np.ndarray, s: np.ndarray, induced: np.ndarray, order: np.ndarray, fill: np.ndarray) -> None:
    before = entries[entries > 0] - 1
    before = before[induced[before]]
    if not len(before):
        return
    c = s[before]
    by = np.argsort(c, kind="stable")
    before, c = before[by], c[by]
    kinds, start, count = np.unique(c, return_index=True, return_counts=True)
    order[fill[c] + np.arange(len(c)) - np.repeat(start, count)] = before
    fill[kinds] += count


_STEP = 7  # symbols of at most 9 bits in one word


def _words(s: np.ndarray) -> np.ndarray:
    """The ``_STEP`` symbols from each position on as one number; a last 0 for the end."""
    n = len(s)
    pad = np.concatenate((s + 1, np.zeros(_STEP, np.int64)))
    word = np.zeros(n + 1, np.int64)
    for j in range(_STEP):
        word[:n] = word[:n] << 9 | pad[j : j + n]
    return word


def _sorted_directly(s: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """The given suffixes in order: seven symbols at a time, ties again with the next seven."""
    n, word = len(s), _words(s)
    rank = np.zeros(len(at), np.int64)
    depth = 0
    live = np.arange(len(at))
    while len(live) and depth < most:
        key = word[np.minimum(at[live] + depth, n)]
        by = np.lexsort((key, rank[live])) if depth else np.argsort(key)
        live = live[by]
        key, r = key[by], rank[live]
        fresh = np.concatenate(([True], (r[1:] != r[:-1]) | (key[1:] != key[:-1])))
        group = np.concatenate(([True], r[1:] != r[:-1]))
        base = np.maximum.accumulate(np.where(group, np.arange(len(live)), 0))
        rank[live] = r + np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0)) - base
        alone = fresh & np.concatenate((fresh[1:], [True]))
        live, depth = live[~alone], depth + _STEP
    return at[np.argsort(rank, kind="stable")]


def common_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length (up to ``most``) that each suffix shares with the one before it in order."""
    n, word = len(s), _words(s.astype(np.int64))
    out = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    for d in range(0, most, _STEP):
        x, y = word[np.minimum(a[live] + d, n)], word[np.minimum(b[live] + d, n)]
        for j in range(1, _STEP):
            out[live + 1] += (x >> 9 * (_STEP - j)) == (y >> 9 * (_STEP - j))
        same = x == y
        live = live[same]
        out[live + 1] += 1
        if not len(live):
            break
    return np.minimum(out, most)


# ---- anchors -------------------------------------------------------------------

_PRIME = 0x100000001B3
#: Bytes of text of a pack and of a row of it (a longer text is one of its own).
PACK, ROW = 1 << 22, 1 << 18
#: Bytes of text for each bucket of anchors and each partition of packs, and for each bucket of fragments: if all
#: anchors are shared, their fragments are four times the text.
BUCKET, FRAGMENTS = 1 << 24, 1 << 22
#: Windows of an anchor that occurs more often (counted up to a factor of 2) are dealt out one by one, by all their bytes.
HEAVY = 1 << 16


def _string_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` bytes from each position on, put together from powers of two."""
    part, width, whole, done = data.astype(np.uint64), 1, None, 0
    while True:
        if ANCHOR & width:
            whole = part if whole is None else part[: len(whole) - width] * np.uint64(pow(_PRIME, done, 1 << 64)) + whole[width:]
            done += width
        if 2 * width > ANCHOR:
            return T.mix(whole)
        part = part[:-width] * np.uint64(pow(_PRIME, width, 1 << 64)) + part[width:]
        width *= 2


def anchors(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first window, last window) of texts: every 50-byte window goes to one anchor.

    The anchor of a window is its 26-byte string of least hash: equal windows have equal
    anchors wherever they stand. Windows of one anchor that follow one another in
    a text make one fragment.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e.view(np.uint64), e, e
    low, width = _string_hashes(data), 1  # sliding minimum by doubling
    while 2 * width <= _WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[_WINDOW - width : _WINDOW - width + n])
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside = text[:n] == text[LENGTH - 1 :]
    cut = np.concatenate(([0], np.flatnonzero((low[1:] != low[:-1]) | (text[1:n] != text[: n - 1]) | (inside[1:] != inside[:-1])) + 1, [n]))
    a, b = cut[:-1], cut[1:] - 1
    a, b = a[inside[a]], b[inside[a]]
    return text[a].astype(np.int64), low[a], a, b


def _deal(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class _Pack:
    """Some texts, their anchors and, of these, the distinct hashes by bucket."""

    def __init__(self, rows: list[tuple], buckets: int):
        ids, sizes, data = (b"".join(c) for c in zip(*rows, strict=True))
        self.ids, self.data = np.frombuffer(ids, np.int64), np.frombuffer(data, np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.int64))))
        parts = []
        for i, j in T.blocks(self.offsets, T.CHUNK):
            base = self.offsets[i]
            text, g, a, b = anchors(self.offsets[i : j + 1] - base, self.data[base : self.offsets[j]])
            parts.append((text + i, g, a + base, b + base))
        text, self.g, self.a, self.b = (np.concatenate(c) for c in zip(*parts, strict=True))
        self.doc = self.ids[text]
        self.g = T.mix(self.g ^ np.uint64(_PRIME)) & ~np.uint64(0xFFFF)  # least hashes are small ones: spread them again
        by = np.argsort(self.g)
        fresh = np.concatenate(([True], self.g[by][1:] != self.g[by][:-1]))[: len(by)]
        self.first = np.flatnonzero(fresh)
        self.keys = self.g[by][self.first]
        self.bucket = _deal(self.keys, buckets)
        self.which = np.zeros(len(by), np.int64)
        self.which[by] = np.cumsum(fresh) - 1
        #: Occurrences of each anchor, as a power of 2 that is not less.
        self.times = np.ceil(np.log2(np.diff(np.append(self.first, len(by))))).astype(np.uint8)
        if len(by):
            self.twice = np.minimum.reduceat(self.doc[by], self.first) < np.maximum.reduceat(self.doc[by], self.first)
        else:
            self.twice = fresh

    def fragments(self, marks: list[tuple], parts: int) -> None:
        """Keep the anchors that ``marks`` (bucket, shared, heavy) call shared; ``frag`` numbers their distinct fragments.

        A fragment of a heavy anchor falls apart into its windows, each with a key from all its bytes. Fragments are
        ordered by bucket; ``rep`` is an occurrence of each, ``frag_key`` and ``frag_bucket`` are its key and bucket.
        """
        shared, heavy = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        for bucket, *masks in marks:
            lo, hi = np.searchsorted(self.bucket, (bucket, bucket + 1))
            for kind, mask in zip((shared, heavy), masks, strict=True):
                if len(mask):
                    kind[lo:hi] = np.unpackbits(np.frombuffer(mask, np.uint8))[: hi - lo]
        hit = shared[self.which]
        key, heavy = self.g[hit], heavy[self.which[hit]]
        self.doc, self.a, self.b = self.doc[hit], self.a[hit], self.b[hit]
        if heavy.any():
            count = (self.b - self.a + 1)[heavy]
            at = np.repeat(self.a[heavy] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            whole = T.mix(_hashes(self.data, at, np.full(len(at), LENGTH))) & ~np.uint64(0xFFFF)
            key = np.concatenate((key[~heavy], whole))
            self.doc = np.concatenate((self.doc[~heavy], np.repeat(self.doc[heavy], count)))
            self.a, self.b = np.concatenate((self.a[~heavy], at)), np.concatenate((self.b[~heavy], at))
        self.frag, self.rep = _distinct(key, self.a, self.b + LENGTH - self.a, self.data)
        self.frag_key = key[self.rep]
        self.frag_bucket = _deal(self.frag_key, parts)


def _pieces(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings data[at : at + size], one after another."""
    end = np.cumsum(size)
    return data[np.repeat(at - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


def _hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each string data[at : at + size], none of which is empty."""
    h = np.zeros(len(at), np.uint64)
    for i, j in T.blocks(np.concatenate(([0], np.cumsum(size))), T.CHUNK):
        x = _pieces(data, at[i:j], size[i:j]).astype(np.uint64)
        first = np.cumsum(size[i:j]) - size[i:j]
        place = np.arange(len(x), dtype=np.uint64) - np.repeat(first, size[i:j]).astype(np.uint64)
        h[i:j] = np.add.reduceat(T.mix((place << np.uint64(8)) + x), first)
    return h


def _distinct(key: np.ndarray, at: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each string's class, a string of each class); classes in order of ``key``.

    Strings of one class are equal in key and bytes, compared byte by byte with their
    neighbour in the order of (key, size, hash).
    """
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _hashes(data, at, size)
    by = np.lexsort((h, size, key))
    same = (key[by][1:] == key[by][:-1]) & (size[by][1:] == size[by][:-1]) & (h[by][1:] == h[by][:-1])
    x = by[1:][same]
    y = by[:-1][same]
    equal = np.ones(len(x), bool)
    for i, j in T.blocks(np.concatenate(([0], np.cumsum(size[x]))), T.CHUNK):
        other = _pieces(data, at[x[i:j]], size[x[i:j]]) != _pieces(data, at[y[i:j]], size[x[i:j]])
        equal[i:j] = np.add.reduceat(other, np.cumsum(size[x[i:j]]) - size[x[i:j]]) == 0
    same[same] = equal
    fresh = np.concatenate(([True], ~same))
    number = np.zeros(len(at), np.int64)
    number[by] = np.cumsum(fresh) - 1
    return number, by[fresh]


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on: zeros and leading bytes compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


_TEXTS = "pack long, at long, ids binary, sizes binary, data binary"


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        offsets, data = T.utf8(batch.column(1))
        for a, b in T.blocks(offsets, PACK):
            pack = int.from_bytes(os.urandom(8), "big", signed=True)
            rows = T.blocks(offsets[a : b + 1], ROW)
            yield _batch([(pack, n, ids[a + i : a + j].astype(np.int64).tobytes(), np.diff(offsets[a + i : a + j + 1]).tobytes(), data[offsets[a + i] : offsets[a + j]].tobytes()) for n, (i, j) in enumerate(rows)], _TEXTS)


_TYPES = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, fields, strict=True)], [f for f, _ in fields])


def _ranges(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cut = np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if a < b:
            yield int(sorted_keys[a]), int(a), int(b)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one; binary values are views of the batch."""
    for batch in batches:
        columns = [(c, pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type)) for c in batch.columns]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_buffer() if view else c[i].as_py() for c, view in columns)


def _lumps(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of about a megabyte."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= 1 << 20:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each bucket; a partition's rows come in the order of column 0."""
    held, bucket = [], None
    for row in _rows(batches):
        if row[0] != bucket and held:
            yield bucket, held
            held = []
        bucket = row[0]
        held.append(row)
    if held:
        yield bucket, held


_KEYS = "b long, pack long, at long, keys binary, twice binary, times binary"


def _key_batches(buckets: int):
    """A pack's rows follow one another where they are read; a pack that is read in two pieces is two, told apart by their first rows."""

    def keys(pack: int, at: int, texts: list[tuple]) -> Iterator[tuple]:
        p = _Pack(texts, buckets)
        for k, i, j in _ranges(p.bucket):
            yield k, pack, at, _planes(p.keys[i:j]), np.packbits(p.twice[i:j]).tobytes(), p.times[i:j].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        begin, last, held = None, None, []
        for pack, at, *text in _rows(batches):
            if (pack, at - 1) != last and held:
                yield from keys(*begin, held)
                held = []
            if not held:
                begin = pack, at
            last = pack, at
            held.append(text)
        if held:
            yield from keys(*begin, held)

    return lambda batches: _lumps(run(batches), _KEYS)


_MARKS = "pack long, at long, b long, shared binary, heavy binary"


def _mark_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of each pack's anchors of a bucket occur in several packs or in two texts of one, and which of these too often."""

    def run() -> Iterator[tuple]:
        for bucket, rows in _by_bucket(batches):
            keys = [_numbers(r[3], np.uint64) for r in rows]
            twice = np.concatenate([np.unpackbits(np.frombuffer(r[4], np.uint8))[: len(k)] for r, k in zip(rows, keys, strict=True)])
            times = np.concatenate([np.frombuffer(r[5], np.uint8) for r in rows])
            _, number, packs = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            shared = packs > 1
            shared[number[twice > 0]] = True
            heavy = shared & (np.bincount(number, np.ldexp(1.0, times)) > HEAVY)
            done = 0
            for r, k in zip(rows, keys, strict=True):
                some = number[done : done + len(k)]
                done += len(k)
                yield r[1], r[2], bucket, np.packbits(shared[some]).tobytes(), np.packbits(heavy[some]).tobytes() if heavy[some].any() else b""

    return _lumps(run(), _MARKS)


def _packs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[int, int, _Pack, list[tuple], list[tuple]]]:
    """(pack, first row, texts, marks, verdicts) from parcels in the order of pack, kind and first row.

    The marks tell where a pack was cut; texts before the first mark have no anchors.
    """

    def pieces(pack: int, texts: list, marks: dict, verdicts: dict) -> Iterator[tuple]:
        begins = sorted(marks) or [0]
        for n, begin in enumerate(begins):
            lo, hi = begin if n else -1, begins[n + 1] if n + 1 < len(begins) else float("inf")
            yield pack, begin, _Pack([t for at, t in texts if lo <= at < hi], buckets), marks.get(begin, []), verdicts.get(begin, [])

    held, texts, marks, verdicts = None, [], {}, {}
    for pack, kind, at, b, *parts in _rows(batches):
        if pack != held and texts:
            yield from pieces(held, texts, marks, verdicts)
            texts, marks, verdicts = [], {}, {}
        held = pack
        if kind == 0:
            texts.append((at, parts[:3]))
        else:
            (marks if kind == 1 else verdicts).setdefault(at, []).append((b, *parts[: 2 if kind == 1 else 4]))
    if texts:
        yield from pieces(held, texts, marks, verdicts)


_FRAGMENTS = "b long, pack long, at long, keys binary, lo binary, above binary, sizes binary, data binary"


def _fragment_batches(buckets: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for pack, begin, p, marks, _ in _packs(batches, buckets):
            p.fragments(marks, parts)
            n = len(p.rep)
            lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
            np.minimum.at(lo, p.frag, p.doc)
            np.maximum.at(hi, p.frag, p.doc)
            at = p.a[p.rep]
            size = p.b[p.rep] + LENGTH - at
            for k, i, j in _ranges(p.frag_bucket):
                yield k, pack, begin, *(_planes(x[i:j]) for x in (p.frag_key, lo, hi - lo, size)), _pieces(p.data, at[i:j], size[i:j]).tobytes()

    return lambda batches: _lumps(run(batches), _FRAGMENTS)


_VERDICTS = "pack long, at long, b long, frag binary, start binary, stop binary, owner binary"


def _owner_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pack the runs of windows (start to stop of a fragment) that a smaller document owns.

    Equal fragments count once, with their least doc_id; some hundred KB of whole anchors
    make one suffix array.
    """
    return _lumps((v for bucket, rows in _by_bucket(batches) for v in _owners(bucket, rows)), _VERDICTS)


def _owners(bucket: int, rows: list[tuple]) -> Iterator[tuple]:
    keys, lo, hi, size = (np.concatenate([_numbers(r[c], t) for r in rows]) for c, t in ((3, np.uint64), (4, np.int64), (5, np.int64), (6, np.int64)))
    hi += lo
    data = np.frombuffer(b"".join(r[7] for r in rows), np.uint8)
    at = np.cumsum(size) - size
    number, rep = _distinct(keys, at, size, data)
    owner = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(owner, number, lo)
    windows = size[rep] - (LENGTH - 1)
    first = np.concatenate(([0], np.cumsum(windows)))
    least = np.zeros(first[-1], np.int64)
    g = keys[rep]
    ends = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))
    filled = np.cumsum(size[rep])
    a = 0
    while a < len(g):
        limit = (filled[a - 1] if a else 0) + (1 << 18)
        b = int(ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(ends, np.searchsorted(filled, limit, "right"), "right") - 1)])
        least[first[a] : first[b]] = _least_owners(_pieces(data, at[rep[a:b]], size[rep[a:b]]), size[rep[a:b]], owner[a:b])
        a = b
    done = 0
    for row in rows:
        n = len(row[3]) // 8
        some = number[done : done + n]
        count = windows[some]
        who = _pieces(least, first[some], count)
        frag = np.repeat(np.arange(n), count)
        gone = who < np.repeat(hi[done : done + n], count)
        edge = np.concatenate(([True], (who[1:] != who[:-1]) | (frag[1:] != frag[:-1]), [True]))
        cut = np.flatnonzero(edge)
        i, j = cut[:-1][gone[cut[:-1]]], cut[1:][gone[cut[:-1]]]
        base = (np.cumsum(count) - count)[frag[i]]
        done += n
        if len(i):
            yield row[1], row[2], bucket, *(_planes(x.astype(np.int32)) for x in (frag[i], i - base, j - base)), _planes(who[i])


def _least_owners(text: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The least owner of each 50-byte window of the fragments, one fragment after another."""
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    which = np.repeat(np.arange(len(sizes)), sizes)
    s = np.zeros(first[-1], np.int64)
    s[np.arange(len(text)) + which] = text.astype(np.int64) + 1  # 0 ends a fragment
    frag = np.repeat(np.arange(len(sizes)), sizes + 1)
    window = first[frag + 1] - 1 - np.arange(len(s)) >= LENGTH
    order = suffix_array(s, window, LENGTH)
    run = np.cumsum(common_prefixes(s, order, LENGTH) < LENGTH)  # suffixes of one run begin with the same 50 bytes
    hit = window[order]
    order, run = order[hit], run[hit]
    least = np.full(len(s) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run, owner[frag[order]])
    at = np.zeros(len(s), np.int64)
    at[order] = least[run]
    return at[window]


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut_batches(buckets: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, _, p, marks, verdicts in _packs(batches, buckets):
            p.fragments(marks, parts)
            edge = np.zeros(len(p.data) + 1, np.int32)
            by = np.argsort(p.frag, kind="stable")
            for bucket, *runs in verdicts:
                frag, start, stop = (_numbers(x, np.int32) for x in runs[:3])
                frag = frag + np.searchsorted(p.frag_bucket, bucket)
                lo, hi = np.searchsorted(p.frag, frag, sorter=by), np.searchsorted(p.frag, frag, "right", sorter=by)
                n = hi - lo
                at = by[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                hit = np.repeat(_numbers(runs[3], np.int64), n) < p.doc[at]
                np.add.at(edge, (p.a[at] + np.repeat(start, n))[hit], 1)
                np.add.at(edge, (p.a[at] + np.repeat(stop, n) + (LENGTH - 1))[hit], -1)
            gone = np.cumsum(edge[:-1]) > 0
            for i, doc in enumerate(p.ids):
                x, text = gone[p.offsets[i] : p.offsets[i + 1]], p.data[p.offsets[i] : p.offsets[i + 1]]
                kept = text[~x].tobytes()
                yield int(doc), len(x), len(text) - len(kept), int(x[:1].sum()) + int((x[1:] > x[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept

    return lambda batches: _lumps(run(batches), _CUT)


def _kept_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.encode() for t in batch.column(0).to_pylist()]
        yield _batch([(None, len(t), 0, 0, hashlib.sha256(t).hexdigest(), t) for t in texts], _CUT)


#: Parquet looks at the size of its pages and row groups every 100 rows at the earliest, which would be 25 MB of text.
_LARGE_ROWS = {"compression": "zstd", "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4, "parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4}


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    A byte goes if a 50-byte string covering it also starts in a document of a smaller
    doc_id; strings are judged on the input and never cross documents.

    Plan: texts are written in packs of about 4 MB. (1) Every 50-byte window has one
    anchor, a 26-byte string chosen by content. A pack sends its distinct anchors to hash
    buckets, one row a bucket; the bucket answers by a bit each, whether others have
    it. (2) A pack sends the fragments of its shared anchors, the runs of windows of one
    anchor, equal ones once. (3) A bucket sorts the suffixes of its distinct fragments
    (two-stage, windows only) and takes adjacent common prefixes: suffixes that agree
    in 50 bytes form a run, whose smallest doc_id owns the string. It answers with the
    runs of windows that a smaller document owns. (4) Packs cut these from their texts.
    The numbers of buckets grow with the bytes of text, so that a task's memory does not; the windows
    of an anchor that occurs in more than ``HEAVY`` places are dealt out one by one, by all their 50 bytes.

    Nulls: a null text is empty. A row without doc_id is compared with nothing and
    kept whole. Rows repeating a doc_id are one document: their strings do not remove
    each other, each row yields a row. Empty table: empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = scratch.save(rows.where("doc_id is not null").mapInArrow(_text_batches, _TEXTS), "texts", **_LARGE_ROWS)
    size = texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets, parts = max(16, -(-size // BUCKET)), max(16, -(-size // FRAGMENTS))
    marks = scratch.save(_dealt(texts.mapInArrow(_key_batches(buckets), _KEYS), buckets).mapInArrow(_mark_batches, _MARKS), "marks", **_LARGE_ROWS)
    none = F.lit(None).cast("binary")
    parcels = texts.selectExpr("pack", "0 kind", "at", "0L b", "ids w", "sizes x", "data y").withColumn("z", none)
    parcels = parcels.unionAll(marks.selectExpr("pack", "1 kind", "at", "b", "shared w", "heavy x").withColumns({"y": none, "z": none}))
    fragments = _together(parcels, buckets).mapInArrow(_fragment_batches(buckets, parts), _FRAGMENTS)
    verdicts = scratch.save(_dealt(fragments, parts).mapInArrow(_owner_batches, _VERDICTS), "verdicts", **_LARGE_ROWS)
    parcels = parcels.unionAll(verdicts.selectExpr("pack", "2 kind", "at", "b", "frag w", "start x", "stop y", "owner z"))
    cut = _together(parcels, buckets).mapInArrow(_cut_batches(buckets, parts), _CUT)
    return cut.union(rows.where("doc_id is null").select("text").mapInArrow(_kept_whole, _CUT))


def _together(parcels: DataFrame, partitions: int) -> DataFrame:
    """A pack's texts, then its marks, then its verdicts."""
    return parcels.repartition(partitions, "pack").sortWithinPartitions("pack", "kind", "at")


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """A partition a bucket: a hash would put several into one. Their number grows with the text."""
    return rows.repartitionById(buckets, F.col("b").cast("int")).sortWithinPartitions("b")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("kept")
