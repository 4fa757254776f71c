"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T

ORDER = 4
#: Bounds of the labelled sample: texts per language, and bytes of a language's whole texts together.
SAMPLE_TEXTS, SAMPLE_BYTES = 1000, 16 << 20
#: Letters of a model have 16 bits; of more, the most frequent of the sample count, others are one unknown letter.
MAX_LETTERS = (1 << 16) - 2
_MASK = np.uint64((1 << 16) - 1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point its lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with single gaps (0) between their runs, and each text's first symbol.

    Every text begins with a gap; a text without a letter is a gap alone.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    low = _letters()[codes]
    gap = low == 0
    keep = ~gap
    if len(low):
        keep[1:] |= ~gap[:-1]
        edges = first[:-1][first[:-1] < len(low)]
        keep[edges] = ~gap[edges]
    count = np.concatenate(([0], np.cumsum(keep)))[first]
    out = np.zeros(int(count[-1]) + len(texts), np.uint32)
    kept = np.flatnonzero(keep)
    own = np.searchsorted(first, kept, "right") - 1
    out[np.arange(len(kept)) + own + 1] = low[kept]
    return out, count + np.arange(len(first))


class Model:
    """Kneser-Ney models of all languages; per order one sorted array of hashed n-grams.

    ``logp[m]`` holds the interpolated log probability of each n-gram of m symbols that
    any language has, a column per language; ``back[m]`` the log weight of the lower
    order after each context of m - 1 symbols. What no language has seen takes the
    weight of its context (1 for an unseen one) and the next lower order.
    """

    def __init__(self, langs: list[str], streams: list[np.ndarray], order: int = ORDER):
        self.langs, self.order = langs, order
        self.limits = np.full(len(langs), np.inf)
        used, times = np.unique(np.concatenate([np.zeros(1, np.uint32), *streams]), return_counts=True)
        if len(used) > MAX_LETTERS:
            times[0] = times.max() + 1  # the gap stays
            used = np.sort(used[np.argsort(-times, kind="stable")[:MAX_LETTERS]])
        self.alphabet = used
        grams = []  # per language and order: keys, counts
        for s in streams:
            ids = self.ids(s)
            keys, counts = np.unique(self.pack(ids, order)[order - 1 :], return_counts=True)
            own = {order: (keys, counts.astype(np.float64))}
            for m in range(order - 1, 0, -1):  # how many symbols precede: continuation counts
                shorter, counts = np.unique(own[m + 1][0] & np.uint64((1 << 16 * m) - 1), return_counts=True)
                own[m] = (shorter, counts.astype(np.float64))
            grams.append(own)
        n_langs = len(langs)
        self.keys, self.logp, self.ctx, self.back = {}, {}, {}, {}
        lower = None
        for m in range(1, order + 1):
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g[m][0] for g in grams)]))
            contexts = np.unique(keys >> np.uint64(16))
            p, back = np.empty((len(keys), n_langs)), np.ones((len(contexts), n_langs))
            base = np.full((len(keys), n_langs), 1 / (len(used) + 1)) if lower is None else lower[1][np.searchsorted(lower[0], keys & np.uint64((1 << 16 * (m - 1)) - 1))]
            where = np.searchsorted(contexts, keys >> np.uint64(16))
            for i, g in enumerate(grams):
                own, counts = g[m]
                once, twice = (counts == 1).sum(), (counts == 2).sum()
                discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
                c = np.zeros(len(keys))
                c[np.searchsorted(keys, own)] = counts
                total, kinds = np.bincount(where, c, len(contexts)), np.bincount(where, c > 0, len(contexts))
                seen = total > 0
                back[seen, i] = discount * kinds[seen] / total[seen]
                p[:, i] = np.maximum(c - discount, 0) / np.maximum(total, 1)[where] + back[where, i] * base[:, i]
            lower = (keys, p)
            self.keys[m], self.logp[m] = _sorted_by_hash(keys, np.log(p).astype(np.float32))
            self.ctx[m], self.back[m] = _sorted_by_hash(contexts, np.log(back).astype(np.float32))

    def ids(self, stream: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, stream), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == stream, at, len(self.alphabet)).astype(np.uint64)

    @staticmethod
    def pack(ids: np.ndarray, order: int) -> np.ndarray:
        """The last ``order`` symbols up to each position in 16 bits each; gaps before the first."""
        out = ids.copy()
        for j in range(1, order):
            out[j:] |= ids[:-j] << np.uint64(16 * j)
        return out

    def log_likelihoods(self, stream: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text the sum of log probabilities under each language, and how many symbols it sums."""
        ids = self.ids(stream)
        lead = np.zeros(len(ids), np.int64)  # distance from the text's first gap
        lead[first[:-1]] = 1
        own = np.cumsum(lead) - 1
        place = np.arange(len(ids)) - first[own]
        packed = np.zeros(len(ids), np.uint64)
        for j in range(self.order):
            x = np.concatenate((np.zeros(j, np.uint64), ids[: len(ids) - j])) if j else ids
            packed |= np.where(place >= j, x, np.uint64(0)) << np.uint64(16 * j)
        scored = place > 0
        packed, own = packed[scored], own[scored]
        total = np.zeros((len(packed), len(self.langs)), np.float32)
        left = np.arange(len(packed))
        for m in range(self.order, 0, -1):
            keys = packed[left] & np.uint64((1 << 16 * m) - 1) if m < 4 else packed[left]
            at, hit = _find(self.keys[m], keys)
            total[left[hit]] += self.logp[m][at[hit]]
            left, keys = left[~hit], keys[~hit]
            if not len(left):
                break
            at, hit = _find(self.ctx[m], keys >> np.uint64(16))
            total[left[hit]] += self.back[m][at[hit]]
            if m == 1:
                total[left] -= np.float32(np.log(len(self.alphabet) + 1))
        counts = np.bincount(own, minlength=len(first) - 1)
        sums = np.stack([np.bincount(own, total[:, i], len(first) - 1) for i in range(len(self.langs))], axis=1)
        return sums, counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy (bits a symbol) and rejection of each text."""
        texts = [t or "" for t in texts]
        stream, first = symbols(texts)
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        bits, reject = np.full(len(texts), np.nan), np.ones(len(texts), bool)
        if not self.langs or not len(texts):
            return pred, score, bits, reject
        sums, counts = self.log_likelihoods(stream, first)
        has = np.add.reduceat((stream != 0).astype(np.int64), first[:-1]) > 0
        mean = -sums / np.maximum(counts, 1)[:, None]
        best = mean.argmin(axis=1)
        low = mean[np.arange(len(texts)), best]
        share = 1 / np.exp(-8 * (mean - low[:, None])).sum(axis=1)
        for i in np.flatnonzero(has):
            pred[i] = self.langs[best[i]]
        score[has], bits[has] = share[has], low[has] / np.log(2)
        reject[has] = bits[has] > self.limits[best[has]]
        return pred, score, bits, reject


def _sorted_by_hash(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = T.mix(keys)
    order = np.argsort(h)
    return h[order], np.ascontiguousarray(values[order])


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = T.mix(keys)
    at = np.minimum(np.searchsorted(table, h), max(0, len(table) - 1))
    return at, table[at] == h if len(table) else np.zeros(len(keys), bool)


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on texts of known language outside fold 2 of 4, at most ``sample_texts`` a language.

    The sample has the smallest hashed ids of each language, with at most ``sample_bytes`` of whole texts (or
    one text); it is found without ranking whole languages. One text in
    ten (fold 0 of 10) sets the rejection limit of its language: the cross-entropy that
    99.5 % of them do not exceed under a model fitted without them, plus a tenth. Null ids, texts and languages
    are left out; repeated rows of an id count once a language; without any text no language is learned.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), F.col("lang").cast("string").alias("_lang"))
    rows = rows.where("_id is not null and _lang is not null and _text is not null").where(T.fold(F.col("_id"), 4) != 2)
    sizes = rows.select("_id", "_lang", F.octet_length("_text").cast("long").alias("_size"))
    chosen = T.bounded_sample(sizes, "_id", "_size", "_lang", sample_texts, sample_bytes).select("_id", "_lang").distinct()
    # At most sample_texts ids a language are broadcast.
    sample = rows.join(F.broadcast(chosen), ["_id", "_lang"]).select("_id", "_lang", "_text", (T.fold(F.col("_id"), 10) == 0).alias("_check")).dropDuplicates(["_id", "_lang", "_text"]).toPandas()
    sample = sample.sort_values(["_lang", "_id", "_text"])
    langs = sorted(sample["_lang"].unique())

    def fit(mask: np.ndarray) -> Model:
        return Model(langs, [symbols(list(sample["_text"][mask & (sample["_lang"] == x)]))[0] for x in langs])

    every = np.ones(len(sample), bool)
    model = fit(every)
    check = sample["_check"].to_numpy(bool)
    if check.any() and not check.all():
        _, _, bits, _ = fit(~check).predict(list(sample["_text"][check]))
        for i, x in enumerate(langs):
            own = bits[(sample["_lang"][check] == x).to_numpy()]
            own = own[~np.isnan(own)]
            if len(own) >= 5:
                model.limits[i] = 1.1 * np.quantile(own, 0.995)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, bits_per_symbol, rejected.

    lang_pred has the lowest length-normalised cross-entropy over the whole text's
    letters; ``und`` (score 0, rejected) for a null text or one without letters, and for
    all texts if no language could be learned. rejected marks texts less likely than
    the calibrated limit of their language. score is the share of the best language in
    a soft comparison of cross-entropies. No shuffle; memory is bounded by a piece of
    ``CHUNK`` bytes or one text. A null id counts as held out; repeated rows repeat
    their result; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            offsets, _ = T.utf8(batch.column(1))
            for a, b in T.blocks(offsets, T.CHUNK):
                pred, score, bits, reject = shared.value.predict(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pred, pa.string()), pa.array(score), pa.array(bits, from_pandas=True), pa.array(reject, pa.bool_())], ["doc_id", "lang_pred", "score", "bits_per_symbol", "rejected"])

    out = rows.mapInArrow(batches, "doc_id long, lang_pred string, score double, bits_per_symbol double, rejected boolean")
    return out.select("doc_id", F.coalesce(T.fold(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "bits_per_symbol", "rejected")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, by models of its rows outside fold 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
