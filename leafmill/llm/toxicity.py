"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .store import Scratch, trim

#: Rows and bytes of whole texts that a shard of the labelled rows holds on average. All shards are used.
SHARD_ROWS, SHARD_BYTES = 6000, 32 << 20
#: Labelled ids, up to which they are broadcast to the texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
BUCKETS, DIMENSIONS, WIDTHS, FILTERS, EPOCHS = 1 << 15, 16, (1, 2, 3), 24, 8
#: Weight of a toxic row in the loss: toxic rows are rare, and missing one is the worse error.
TOXIC_WEIGHT = 2.0
_PAD = BUCKETS  # the embedding of this token stays zero


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words (runs of non-ASCII bytes, ASCII letters and digits; A-Z folded) and each text's first."""
    starts, ends, first = T.words(offsets, data, T.NOT_WORD)
    return (T.word_hashes(data, starts, ends) >> np.uint64(49)).astype(np.int64), first


def padded(tok: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token stream with pads after each text, so that no window spans two texts."""
    gap = max(WIDTHS)
    n = len(first) - 1
    out = np.full(len(tok) + gap * n, _PAD, dtype=np.int64)
    own = np.repeat(np.arange(n), np.diff(first))
    out[np.arange(len(tok)) + gap * own] = tok
    return out, first[:-1] + gap * np.arange(n)


class Model:
    """Embeddings, one filter bank per width with max pooling over the text, a logistic output."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.e = (rng.standard_normal((BUCKETS + 1, DIMENSIONS)) * 0.05).astype(np.float32)
        self.e[_PAD] = 0
        self.w = [(rng.standard_normal((k * DIMENSIONS, FILTERS)) * 0.15).astype(np.float32) for k in WIDTHS]
        for bank in self.w:
            bank[::DIMENSIONS, : FILTERS // 2] += 0.3  # half of the filters start on the evidence dimension
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.u = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32)
        self.c = np.float32(0)
        self.thresholds: dict[str | None, float] = {}

    def features(self, stream: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled features of each text, and the raw responses per width."""
        x = self.e[stream]
        pads = np.flatnonzero(stream == _PAD)
        pooled, raw = [], []
        for k, w, b in zip(WIDTHS, self.w, self.b, strict=True):
            n = len(stream) - k + 1
            z = x[:n] @ w[:DIMENSIONS]
            for j in range(1, k):
                z += x[j : n + j] @ w[j * DIMENSIONS : (j + 1) * DIMENSIONS]
            z += b
            z[pads[pads < n]] = b  # a window that begins between two texts sees none of them
            pooled.append(np.maximum(np.maximum.reduceat(z, begin, axis=0), 0))
            raw.append(z)
        return np.concatenate(pooled, axis=1), raw

    def scores(self, tok: np.ndarray, first: np.ndarray) -> np.ndarray:
        stream, begin = padded(tok, first)
        out = np.empty(len(begin), np.float64)
        # Texts are pooled in runs of some ten thousand tokens; a long text in overlapping pieces.
        a = 0
        for a, b in T.blocks(np.append(begin, len(stream)), 1 << 14):
            lo, hi = begin[a], begin[b] if b < len(begin) else len(stream)
            if b - a > 1 or hi - lo <= 1 << 15:
                h, _ = self.features(stream[lo:hi], begin[a:b] - lo)
            else:
                h = None
                for p in range(lo, hi - max(WIDTHS) + 1, 1 << 14):
                    g, _ = self.features(stream[p : min(hi, p + (1 << 14) + max(WIDTHS) - 1)], np.zeros(1, np.int64))
                    h = g if h is None else np.maximum(h, g)
            out[a:b] = 1 / (1 + np.exp(-np.clip(h @ self.u + self.c, -30, 30)))
        return out

    def fit(self, tok: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Model:
        """Epochs over texts held in memory: the one shard of a small table."""
        self.begin(_seen(tok, first, y), np.array([len(y) - y.sum(), y.sum()]))
        for i in range(epochs):
            self.epoch(tok, first, y, (seed, i))
        return self

    def begin(self, seen: np.ndarray, total: np.ndarray) -> None:
        """Start from the counts of all labelled rows: bucket document frequencies and rows by class."""
        self.e[:-1, 0] = _evidence(seen, total)
        self.c = np.float32(np.log((total[1] + 1) / (total[0] + 1)))
        dense = self.dense()
        self.m, self.v = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
        self.g2 = np.full(BUCKETS + 1, 1e-2, np.float32)
        self.step = 0

    def dense(self) -> list[np.ndarray]:
        return [*self.w, *self.b, self.u]

    def epoch(self, tok: np.ndarray, first: np.ndarray, y: np.ndarray, seed: tuple) -> np.ndarray:
        """Adam on the logistic loss, texts in small batches in a fixed random order; which embeddings it moved."""
        dense, m, v, g2 = self.dense(), self.m, self.v, self.g2
        moved = np.zeros(BUCKETS + 1, bool)
        order = np.random.default_rng(seed).permutation(len(y))
        for at in range(0, len(y), 32):
            rows = order[at : at + 32]
            parts = [tok[first[i] : first[i + 1]] for i in rows]
            stream, begin = padded(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))))
            h, raw = self.features(stream, begin)
            err = (1 / (1 + np.exp(-np.clip(h @ self.u + self.c, -30, 30))) - y[rows]) * np.where(y[rows] > 0, TOXIC_WEIGHT, 1.0) / len(rows)
            err = err.astype(np.float32)
            gu, gc = h.T @ err, err.sum()
            gh = np.outer(err, self.u) * (h > 0)
            gw, gb, touched, deltas = [], [], [], []
            ends = np.append(begin[1:], len(stream))
            for i, (k, w) in enumerate(zip(WIDTHS, self.w, strict=True)):
                g = gh[:, i * FILTERS : (i + 1) * FILTERS]
                best = np.stack([raw[i][a : min(b, len(raw[i]))].argmax(axis=0) + a for a, b in zip(begin, ends, strict=True)])
                dw = np.zeros_like(w)
                for j in range(k):
                    ids = np.where(stream[best] == _PAD, _PAD, stream[best + j])  # (texts, filters)
                    dw[j * DIMENSIONS : (j + 1) * DIMENSIONS] = np.einsum("tfd,tf->df", self.e[ids], g)
                    touched.append(ids.ravel())
                    deltas.append((g[:, :, None] * w[j * DIMENSIONS : (j + 1) * DIMENSIONS].T[None]).reshape(-1, DIMENSIONS))
                gw.append(dw)
                gb.append(g.sum(axis=0))
            self.step += 1
            for p, g, a, b in zip(dense, [*gw, *gb, gu], m, v, strict=True):
                g = g + 1e-4 * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.01 * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.999**self.step)) + 1e-8)
            self.c -= np.float32(0.05 * gc)
            ids, back = np.unique(np.concatenate(touched), return_inverse=True)
            ge = np.zeros((len(ids), DIMENSIONS), np.float32)
            np.add.at(ge, back, np.concatenate(deltas))
            g2[ids] += (ge * ge).mean(axis=1)
            self.e[ids] -= 0.02 * ge / np.sqrt(g2[ids])[:, None]
            self.e[_PAD] = 0
            moved[ids] = True
        return moved

    def calibrate(self, errors: dict) -> None:
        """Per language the threshold of fewest errors (the nearest to 0.5 of equals); 0.5 under 20 rows of a class.

        ``errors`` has, by language, the rows of class 0, of class 1 and the errors at each threshold of ``GRID``.
        """
        for lang, (clean, toxic, *wrong) in errors.items():
            if min(clean, toxic) >= 20:
                self.thresholds[lang] = float(min(zip(wrong, np.abs(GRID - 0.5), GRID, strict=True))[2])


GRID = np.linspace(0.2, 0.9, 71)


def _seen(tok: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Texts of each class that hold each bucket."""
    seen = np.zeros((2, BUCKETS), np.float64)
    for i in range(len(first) - 1):
        seen[int(y[i]), np.unique(tok[first[i] : first[i + 1]])] += 1
    return seen


def _evidence(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Shrunken log odds of a bucket's document frequency: the first embedding dimension's start."""
    odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    return (np.maximum(odds, 0) * seen.sum(axis=0) / (seen.sum(axis=0) + 3)).astype(np.float32)


_ROW = "shard int, _id long, y boolean, held boolean, lang string, tok binary"
_SHARD = "y binary, held binary, langs array<string>, sizes binary, tok binary"


def _token_rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        shard, ids, y, held, lang = (batch.column(i) for i in range(5))
        offsets, data = T.utf8(batch.column(5))
        for a, b in T.blocks(offsets, T.CHUNK):
            tok, first = tokens(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
            tok = tok.astype(np.uint16)
            yield pa.RecordBatch.from_arrays([c[a:b] for c in (shard, ids, y, held, lang)] + [pa.array([tok[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["shard", "_id", "y", "held", "lang", "tok"])


def _shard_rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard; a partition is a shard."""
    rows = [r for batch in source for r in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
    if rows:
        y, held, langs, tok = zip(*rows, strict=True)
        out = [np.array(y).tobytes(), np.array(held).tobytes(), list(langs), np.array([len(t) // 2 for t in tok]).tobytes(), b"".join(tok)]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, (pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary()), strict=True)], ["y", "held", "langs", "sizes", "tok"])


def _shards(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(labels, held, languages, tokens by text) of each shard."""
    for batch in source:
        for i in range(batch.num_rows):
            y, held, langs, sizes, tok = (c[i].as_py() for c in batch.columns)
            cut = np.cumsum(np.frombuffer(sizes, np.int64))[:-1]
            yield np.frombuffer(y, bool).astype(np.float64), np.frombuffer(held, bool), langs, np.split(np.frombuffer(tok, np.uint16).astype(np.int64), cut)


def _part(mask: np.ndarray, y: np.ndarray, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = [texts[i] for i in np.flatnonzero(mask)]
    return np.concatenate([np.zeros(0, np.int64), *own]), np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64), y[mask]


def _total(shards: DataFrame, work, count: int):
    """Sum of the lists of arrays that ``work`` gives of each shard: in its task, then in some tasks, then on the driver."""

    def added(lists: Iterator[list]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in lists:
            total = x if total is None else [a + b for a, b in zip(total, x, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["sum"])

    def again(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(pickle.loads(c) for c in sorted(c for batch in source for c in batch.column(0).to_pylist()))

    most = 2 * shards.sparkSession.sparkContext.defaultParallelism  # sums to move: by the cores, not by the shards
    sums = shards.coalesce(most).mapInArrow(lambda source: added(work(*s) for s in _shards(source)), "sum binary")
    sums = sums.repartition(math.isqrt(min(count, most))).mapInArrow(again, "sum binary")
    total = None
    for r in sums.collect():
        x = pickle.loads(r["sum"])
        total = x if total is None else [a + b for a, b in zip(total, x, strict=True)]
    return total


def _counts(y: np.ndarray, held: np.ndarray, langs: list, texts: list) -> list:
    every, seen = _part(np.ones(len(y), bool), y, texts), []
    for tok, first, own in (every, _part(~held, y, texts)):
        seen += [_seen(tok, first, own), np.array([len(own) - own.sum(), own.sum()])]
    return seen


def _moves(models: list[Model], i: int):
    """Of one epoch over a shard, by model: how far each parameter moved, how often each embedding did, and that it was one shard."""

    def run(y: np.ndarray, held: np.ndarray, langs: list, texts: list) -> list:
        out = []
        for old, mask in zip(models, (np.ones(len(y), bool), ~held), strict=False):
            new = pickle.loads(pickle.dumps(old))
            tok, first, own = _part(mask, y, texts)
            if not len(own):
                out += [np.zeros_like(x) for x in _state(old)] + [np.zeros(BUCKETS + 1), 0]
                continue
            moved = new.epoch(tok, first, own, (3, i))
            out += [a - b for a, b in zip(_state(new), _state(old), strict=True)] + [moved.astype(np.float64), 1]
        return out

    return run


def _state(model: Model) -> list:
    return [model.e, model.g2, *model.dense(), *model.m, *model.v, model.c, model.step]


def _move(model: Model, moves: list, moved: np.ndarray, shards: int) -> None:
    """The mean of the shards' moves; an embedding's is that of the shards that moved it."""
    e, g2, *dense, c, step = moves
    often = np.maximum(moved, 1).astype(np.float32)
    model.e += e / often[:, None]
    model.g2 += g2 / often
    for p, d in zip([*model.dense(), *model.m, *model.v], dense, strict=True):
        p += d / np.float32(shards)
    model.c = np.float32(model.c + c / shards)
    model.step += max(1, round(step / shards))


def train(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> Model:
    """Fit on all labelled rows of fold 1-4; fold 1 also sets the thresholds, by a model fitted without it.

    Rows are dealt by id into shards of some ``shard_rows`` rows and ``shard_bytes`` of text, kept as tokens. Document
    frequencies, class counts and errors at the thresholds are sums over all shards. In each epoch every shard goes on from the
    same model, and the mean of their moves makes the next one (one shard: plain Adam). The driver holds two models.
    Null ids and labels are left out; of several labels of an id the worst counts; repeated rows of an id are all used; a null
    text is empty. Without rows of both classes the model gives every text the same score. Other columns are ignored.
    """
    marked = labels.where("doc_id is not null and toxic is not null").where(T.fold(F.col("doc_id"), 5) != 0).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_y"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), lang.cast("string").alias("_lang"))
    rows = texts.join(F.broadcast(marked) if marked.count() <= BROADCAST_IDS else marked, "_id")
    n, size, toxic = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("_text")), F.sum((F.col("_y") > 0).cast("long"))).first()
    model, trial = Model(), Model()
    if not n or not 0 < toxic < n:
        return model.fit(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0), epochs=0)
    count = max(1, -(-n // shard_rows), -(-size // shard_bytes))
    scratch = Scratch(docs.sparkSession, "toxicity")
    shard = F.pmod(F.xxhash64("_id"), F.lit(count)).cast("int")
    tokenised = rows.select(shard.alias("shard"), "_id", (F.col("_y") > 0).alias("y"), (T.fold(F.col("_id"), 5) == 1).alias("held"), "_lang", "_text").mapInArrow(_token_rows, _ROW)
    shards = scratch.save(tokenised.repartitionById(count, F.col("shard")).sortWithinPartitions("_id", "tok").mapInArrow(_shard_rows, _SHARD), "shards")
    seen, total, seen_trial, total_trial = _total(shards, _counts, count)
    model.begin(seen, total)
    models = [model]
    if 0 < total_trial.sum() < n:
        trial.begin(seen_trial, total_trial)
        models.append(trial)
    for i in range(EPOCHS):
        shared = docs.sparkSession.sparkContext.broadcast(models)
        moves = _total(shards, lambda *s, shared=shared, i=i: _moves(shared.value, i)(*s), count)
        width = len(_state(model)) + 2
        for k, m in enumerate(models):
            *d, moved, by = moves[k * width : (k + 1) * width]
            if by:
                _move(m, d, moved, by)
        shared.destroy()
        trim(docs.sparkSession)
    if len(models) > 1:
        _calibrate(model, trial, shards)
    scratch.drop(shards)
    for m in models:
        m.m = m.v = m.g2 = None
    return model


def _calibrate(model: Model, trial: Model, shards: DataFrame) -> None:
    shared = shards.sparkSession.sparkContext.broadcast(trial)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, held, langs, texts in _shards(source):
            tok, first, own = _part(held, y, texts)
            if not len(own):
                continue
            scores, kinds = shared.value.scores(tok, first), np.array([langs[i] for i in np.flatnonzero(held)], object)
            for kind in set(kinds):
                t, s = own[kinds == kind], scores[kinds == kind]
                counts = [int(len(t) - t.sum()), int(t.sum()), *(int(((s >= c) != (t > 0)).sum()) for c in GRID)]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(counts), pa.string()), pa.array(range(len(counts)), pa.int32()), pa.array(counts, pa.int64())], ["lang", "at", "n"])

    errors: dict = {}
    for r in shards.mapInArrow(batches, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect():
        errors.setdefault(r["lang"], [0] * (len(GRID) + 2))[r["at"]] = r["n"]
    model.calibrate(errors)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, flagged.

    score is a function of the text alone; flagged compares it with the threshold
    calibrated for the row's language (0.5 for unknown ones). Texts are scored whole,
    long ones in overlapping pieces under one max pooling; no shuffle. A null text is
    empty and has the score of no evidence; a null id counts as held out. Repeated rows
    repeat their result; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.cast("string").alias("lang"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in source:
            offsets, data = T.utf8(batch.column(1))
            out = np.zeros(batch.num_rows)
            for a, b in T.blocks(offsets, T.CHUNK):
                out[a:b] = model.scores(*tokens(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]))
            limit = np.array([model.thresholds.get(x, 0.5) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= 0.5).astype(np.int32)), pa.array(out >= limit, pa.bool_())], ["doc_id", "score", "predicted", "flagged"])

    scored = rows.mapInArrow(batches, "doc_id long, score double, predicted int, flagged boolean")
    return scored.select("doc_id", F.coalesce(T.fold(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out"), "score", "predicted", "flagged")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not flag, unchanged, with all their columns.

    Null and empty texts have the score of no evidence; long texts are scored whole; repeated rows go or stay
    together; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    text, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in source:
            offsets, data = T.utf8(batch.column(text).cast(pa.string()))
            out = np.zeros(batch.num_rows)
            for a, b in T.blocks(offsets, T.CHUNK):
                out[a:b] = model.scores(*tokens(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]))
            langs = batch.column(lang).to_pylist() if lang is not None else [None] * batch.num_rows
            yield batch.filter(pa.array(out < np.array([model.thresholds.get(x, 0.5) for x in langs]), pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, by a model of its labelled rows outside fold 0 of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return classify(docs, train(docs, labels))
