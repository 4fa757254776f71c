"""Mixing sources to target weights by soft membership. Native DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, trim

#: Guard against a solver that does not end, and the miss, relative to a domain's own goal, that ends it.
STEPS, TOLERANCE = 200, 1e-3
#: The penalties on leaving rates of 1, each solved from the rates of the one before.
PENALTIES = [10.0**-i for i in range(3, 10)]
#: Hash values of words, the smoothing of their counts, and the factors tried on the log-odds.
WORD_BUCKETS, SMOOTH = 1 << 12, 0.1
SCALES = [2.0**-i for i in range(11)]
#: Up to so many domains sums are columns of one row; beyond, rows of a grouped table.
WIDE = 64


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, the categorical features of each row (language, length, word length) and its hashed words.

    Tokens are runs of non-space ASCII; all are counted and hashed, in one pass over the text. The
    source is no feature.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    hashed = F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != ""), lambda x: F.pmod(F.xxhash64(x), F.lit(WORD_BUCKETS)).cast("short"))
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("f_lang"), size.alias("size"), hashed.alias("words")).withColumn("tokens", F.size("words").cast("long"))
    return row.select(
        "doc_id", "tokens", "f_lang",
        F.floor(F.log2(F.col("tokens") + 1)).cast("int").alias("f_length"),
        F.least(F.floor(2 * F.col("size") / F.greatest("tokens", F.lit(1))), F.lit(40)).cast("int").alias("f_word"),
        "words",
    )


_CELL = ["f_lang", "f_length", "f_word"]


def _counts(labelled: DataFrame, domains: list[str]) -> DataFrame:
    """(held, kind, value, n): how many labelled rows or words of each domain have a value; n is an array over the domains.

    Kinds are the features, ``word`` and ``row`` (all rows). One pass over the labelled rows gives the
    counts of both the model that picks the scale and the last one.
    """
    held = (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held")
    at = (F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1).cast("int").alias("at")
    marks = [F.struct(F.lit(f).alias("kind"), F.col(f).cast("string").alias("value")) for f in _CELL] + [F.struct(F.lit("row").alias("kind"), F.lit("").alias("value"))]
    words = F.transform("words", lambda x: F.struct(F.lit("word").alias("kind"), x.cast("string").alias("value")))
    long = labelled.select(held, at, F.explode(F.concat(F.array(*marks), words)).alias("v")).groupBy("held", "at", "v.kind", "v.value").agg(F.count(F.lit(1)).alias("n"))
    found = long.groupBy("held", "kind", "value").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("n"))  # at most an entry a domain
    return found.withColumn("n", F.transform(F.sequence(F.lit(0), F.lit(len(domains) - 1)), lambda i: F.coalesce(F.col("n")[i], F.lit(0).cast("long"))))


def _model(counts: DataFrame, domains: list[str]) -> Callable[[DataFrame, list[str]], DataFrame]:
    """A function that gives rows (with columns to keep) their log-odds below the likeliest domain."""
    k = len(domains)
    sums = counts.where("kind IN ('row', 'word')").select("kind", F.posexplode("n").alias("i", "n")).groupBy("kind", "i").agg(F.sum("n").alias("n")).collect()  # two rows per domain
    by_kind = {"row": [0] * k, "word": [0] * k}
    for r in sums:
        by_kind[r.kind][r.i] = r.n
    total, in_words = by_kind["row"], by_kind["word"]
    every = sum(total)
    floats = lambda xs: F.expr(f"array({', '.join(f'{float(x)!r}D' for x in xs)})")
    merged = counts.groupBy("kind", "value", F.lit(0).alias("_one")).agg(F.collect_list("n").alias("n"))  # at most one of each fold
    merged = merged.select("kind", "value", F.aggregate("n", F.array_repeat(F.lit(0).cast("long"), k), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("n"))
    tables = {f: merged.where(F.col("kind") == f).select(F.col("value").alias(f"_{f}"), F.zip_with("n", floats(t + 20.0 for t in total), lambda x, t: F.log((x + 1.0) / t)).alias("v")) for f in _CELL}
    unseen = floats(math.log(1.0 / (t + 20.0)) for t in total)
    seen = merged.where("kind = 'word'").select(F.col("value").cast("short").alias("word"), "n")
    spread = counts.sparkSession.range(WORD_BUCKETS).select(F.col("id").cast("short").alias("word")).join(seen, "word", "left")
    by_word = spread.select("word", F.zip_with(F.coalesce("n", F.array_repeat(F.lit(0).cast("long"), k)), floats(n + SMOOTH * WORD_BUCKETS for n in in_words), lambda x, t: F.log((x + SMOOTH) / t)).alias("w"))
    prior = floats(math.log((t + 1) / (every + k)) for t in total)

    def scored(rows: DataFrame, keep: list[str]) -> DataFrame:
        keys = ["row", *keep, *_CELL]
        one = rows.withColumn("row", F.monotonically_increasing_id()).select(*keys, F.explode_outer("words").alias("word")).join(F.broadcast(by_word), "word", "left")
        out = one.groupBy(*keys).agg(*[F.expr(f"coalesce(sum(w[{i}]), 0.0D) AS l{i}") for i in range(k)])
        out = out.withColumn("logs", F.zip_with(F.expr(f"array({', '.join(f'l{i}' for i in range(k))})"), prior, lambda a, b: a + b))
        for f in _CELL:
            out = out.join(F.broadcast(tables[f]), F.col(f).cast("string") == F.col(f"_{f}"), "left").withColumn("logs", F.zip_with("logs", F.coalesce("v", unseen), lambda a, b: a + b)).drop("v", f"_{f}")
        top = F.array_max("logs")
        return out.select(*keep, F.transform("logs", lambda x: x - top).alias("logs"))

    return scored


def _posteriors(rows: DataFrame, labelled: DataFrame, counts: DataFrame, domains: list[str]) -> DataFrame:
    """``rows`` with p: the posterior of each domain, by naive Bayes on words and features.

    ``labelled`` has the features, words (hashes) and domain, ``counts`` what ``_counts`` makes of it:
    Laplace-smoothed per feature value and word hash, in tables bounded by the values. The
    log-odds are scaled down, as words are not independent: by the factor of the least log loss
    on one row in five, under a model of the others.
    """
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    scale = 1.0
    own = F.element_at("logs", F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int"))
    loss = [F.sum(F.log(F.aggregate(F.transform("logs", lambda x, c=c: F.exp(x * c)), F.lit(0.0), lambda a, b: a + b)) - own * c) for c in SCALES]
    losses = _model(counts.where("not held"), domains)(labelled.where(held), ["domain"]).agg(*loss).first()
    if losses[0] is not None:
        scale = min(zip(losses, SCALES, strict=True))[1]
    raw = F.transform("logs", lambda x: F.exp(x * scale))
    out = _model(counts, domains)(rows, ["doc_id", "tokens"]).withColumn("raw", raw)
    return out.withColumn("p", F.transform("raw", lambda x: x / F.aggregate("raw", F.lit(0.0), lambda a, b: a + b))).drop("logs", "raw")


def _weighted(cells: DataFrame, weights: list[float]) -> DataFrame:
    """``cells`` with t: 1 + p * weights.

    The weights come as a row, not as literals, so that each step reuses the compiled code.
    """
    one = cells.sparkSession.sql(f"SELECT w FROM VALUES (array({', '.join(f'{float(w)!r}D' for w in weights)})) AS one(w)")
    met = cells.crossJoin(F.broadcast(one))
    if len(weights) > WIDE:
        dot = F.aggregate(F.zip_with("p", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    else:
        dot = F.expr(" + ".join(f"p[{i}] * w[{i}]" for i in range(len(weights))))
    return met.withColumn("t", F.lit(1.0) + dot).drop("w")


def _rate(least: float) -> Column:
    return F.greatest(F.lit(float(least)), F.col("t"))


def _sums(cells: DataFrame, value: Column, k: int) -> np.ndarray:
    """Sum of value * p of each domain."""
    if k > WIDE:
        out = np.zeros(k)
        for r in cells.select(F.posexplode(F.transform("p", lambda x: x * value)).alias("d", "x")).groupBy("d").agg(F.sum("x").alias("x")).collect():  # a row per domain
            out[r.d] = r.x or 0.0
        return out
    row = cells.select(value.alias("m"), "p").agg(*[F.expr(f"sum(m * p[{i}])") for i in range(k)]).first()
    return np.array([float(x or 0) for x in row])


_REPORT = "domain string, tokens double, goal double, reached double, miss double, optimal boolean"


def mix(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``mix_and_misses``."""
    return mix_and_misses(docs, labels, **settings)[0]


def mix_and_misses(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total_tokens: float | None = None, steps: int = STEPS, least_rate: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """One row per input row: doc_id, tokens, domain (the likeliest), rate, copies; and the misses left.

    The second table has a row per domain: tokens before, goal, reached, miss (relative to
    the goal; null for a goal of 0) and whether the rates are optimal.

    ``labels`` is the labelled table: doc_id, domain. A naive-Bayes classifier fitted on
    the labelled documents gives every document a posterior over the domains, so that
    one without label, or of an unknown source, belongs to several in part. Rates r
    >= 0 minimise the squared misses of sum(r * tokens * p[domain]) from target share x
    total tokens, and of these rates the nearest to 1. The source column is not read here:
    words, language and lengths decide, and a step is a few aggregations over the posteriors. ``targets`` defaults to the predicted totals to
    the power 0.7; ``total_tokens`` to the least total at which no domain has to shrink;
    ``least_rate`` raises the bound of 0, with 1 no document is lost. copies is the
    rate rounded up or down with its fraction as the probability, by a hash of the id.

    Nulls: a null text has no tokens, null features are a value of their own, a null
    label is left out; a null id rounds to the nearest. Repeated rows repeat their
    result (repeated labels count once each). Without labelled documents the rate is 1.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    # Texts are split and hashed once; what follows reads two bytes a word.
    rows = scratch.save(_features(docs), "features")
    marks = labels.where("doc_id is not null and domain is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).distinct()
    labelled = scratch.save(rows.join(marks, "doc_id").select("doc_id", *_CELL, "words", "domain"), "labelled")
    domains = sorted(r.domain for r in labelled.select("domain").distinct().collect())  # a row per domain
    if not domains:
        return rows.select("doc_id", "tokens", F.lit(None).cast("string").alias("domain"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies")), spark.createDataFrame([], _REPORT)
    counts = scratch.save(_counts(labelled, domains), "counts")
    cells = scratch.save(_posteriors(rows, labelled, counts, domains).withColumn("mass", F.col("tokens").cast("double")), "cells")
    start = [float(x) for x in _sums(cells, F.col("mass"), len(domains))]
    shares = targets or {d: t**0.7 for d, t in zip(domains, start, strict=True)}
    share = [max(0.0, shares.get(d, 0.0)) for d in domains]
    share = [s / (sum(share) or 1.0) for s in share]
    budget = total_tokens or max((t / s for t, s in zip(start, share, strict=True) if s > 0), default=0.0)
    goal = [budget * s for s in share]
    weights, reached, optimal = _fit(cells, goal, steps, least_rate)
    report = spark.createDataFrame([(d, t, g, n, (g - n) / g if g > 0 else None, optimal) for d, t, g, n in zip(domains, start, goal, map(float, reached), strict=True)], _REPORT)
    name = F.element_at(F.array(*map(F.lit, domains)), F.array_position("p", F.array_max("p")).cast("int"))
    # a row without tokens moves no total and keeps its rate
    rate = F.when(F.col("tokens") > 0, _rate(least_rate)).otherwise(F.lit(max(1.0, least_rate)))
    solved = _weighted(cells, weights).select("doc_id", "tokens", name.alias("domain"), rate.alias("rate"))
    whole = F.floor("rate")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    extra = F.when(F.col("doc_id").isNull(), (F.col("rate") - whole >= 0.5).cast("int")).otherwise((chance < F.col("rate") - whole).cast("int"))
    return solved.select("doc_id", "tokens", "domain", "rate", (whole + extra).cast("long").alias("copies")), report


def _fit(cells: DataFrame, goal: list[float], steps: int, least: float) -> tuple[list[float], list[float], bool]:
    """(weights, reached totals, whether they are optimal); a rate is max(least, 1 + p * weights).

    Of the rates that minimise the squared misses this finds those nearest to 1: they
    have that form, with weights proportional to the misses for a penalty that goes to 0
    in steps of ten: far from a solution few rows are above the bound, and a Newton step goes astray.
    The weights minimise a convex function that is quadratic between the rates' cuts, by
    Newton steps halved until it falls enough. It ends when every domain is within
    TOLERANCE of its own goal, or when the gradient is gone at the last penalty, which is
    projected-gradient optimality: the goals left are out of reach. A search that gets stuck or runs
    out of steps is not optimal: of all rates seen, the start included, it gives those of the least squared misses.
    """
    k, g = len(goal), np.array(goal, float)
    mass = F.col("mass")

    def measure(w: np.ndarray) -> tuple[float, np.ndarray, Callable[[], np.ndarray]]:
        """The cost, the totals and how they bend at w: one pass over the rows; beyond WIDE domains the bend is one of its own."""
        cost = F.when(F.col("t") > least, F.col("t") * F.col("t") / 2).otherwise(least * F.col("t") - least * least / 2.0)
        at = _weighted(cells, w)
        if k > WIDE:  # the cost rides along as one more entry
            all_sums = _sums(at.select(F.lit(1.0).alias("one"), F.concat(F.transform("p", lambda x: x * mass * _rate(least)), F.array(mass * cost)).alias("p")), F.col("one"), k + 1)
            return float(all_sums[k]), all_sums[:k], lambda: bend(w)
        live = F.when(F.col("t") >= least, mass).otherwise(F.lit(0.0))
        each = at.select((mass * _rate(least)).alias("m"), (mass * cost).alias("c"), live.alias("live"), "p", F.posexplode("p").alias("i", "x"))
        got = each.groupBy("i").agg(F.expr("sum(m * x)"), F.expr("sum(c)"), *[F.expr(f"sum(live * x * p[{j}])") for j in range(k)]).collect()  # a row per domain
        total, sums, pairs = 0.0, np.zeros(k), np.zeros((k, k))
        for i, s, c, *row in got:
            total, sums[i], pairs[i] = c, s, row
        return total, sums, lambda: (pairs + pairs.T) / 2

    def bend(w: np.ndarray) -> np.ndarray:
        live = F.when(F.col("t") >= least, mass).otherwise(F.lit(0.0))
        parts = F.filter(F.transform("p", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] > 0)
        some = _weighted(cells, w).select(live.alias("m"), parts.alias("q")).where("m > 0").select("m", "q", F.explode("q").alias("a")).select("m", "a", F.explode("q").alias("b")).where("a.i <= b.i")
        met = some.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("m") * F.col("a.x") * F.col("b.x")).alias("x"))
        out = np.zeros((k, k))
        for r in met.groupBy("i").agg(F.collect_list("j"), F.collect_list("x")).collect():  # a row per domain, an entry per pair
            out[r[0], r[1]] = out[r[1], r[0]] = r[2]
        return out

    w = np.zeros(k)
    cost, now, bent = measure(w)
    start = now
    unit = max(float(start.mean()), 1e-300)
    close = lambda n: bool((np.abs(g - n) <= TOLERANCE * np.where(g > 0, g, start)).all())
    taken, settled = 0, True
    best = (float(((g - now) ** 2).sum()), w, now)
    for penalty in PENALTIES:
        settled = True
        while not close(now):
            slope = now - g + penalty * unit * w
            if np.abs(slope).max() <= 1e-6 * np.where(g > 0, g, unit).min():
                break
            if taken >= steps:
                return list(best[1]), list(best[2]), False
            taken += 1
            trim(cells.sparkSession)
            step = np.linalg.solve(bent() + penalty * unit * np.eye(k), -slope)
            value = cost - g @ w + penalty * unit * (w @ w) / 2
            size = 1.0
            while True:
                tried = w + size * step
                after, then, bends = measure(tried)
                if after - g @ tried + penalty * unit * (tried @ tried) / 2 <= value + 1e-4 * size * (slope @ step):
                    break
                if np.abs(then - g + penalty * unit * tried).max() < 0.5 * np.abs(slope).max():  # where the cost drowns in rounding
                    break
                size /= 2
                if size < 1e-6:
                    break
            if size < 1e-6:  # as near as the sums' rounding allows, or stuck
                settled = bool((np.abs(slope) <= TOLERANCE * np.where(g > 0, g, unit)).all())
                break
            w, cost, now, bent = tried, after, then, bends
            missed = float(((g - now) ** 2).sum())
            if missed < best[0]:
                best = (missed, w, now)
    if settled:
        return list(w), list(now), True
    return list(best[1]), list(best[2]), False


def mixed_corpus(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``docs`` with domain, rate and copy: each row as often as its copies say.

    Columns of ``docs`` named domain, rate or copy give way to the new ones; others stay. Rows that
    repeat a doc_id share one plan, the one of the highest rate (then the last domain). Nulls, long
    texts and empty tables are as in ``mix``.
    """
    best = mix(docs, labels, **settings).groupBy("doc_id").agg(F.max(F.struct("rate", "domain", "copies")).alias("_mix_plan"))
    kept = [c for c in docs.columns if c not in ("domain", "rate", "copy")]
    joined = docs.select(*kept).join(best.withColumnRenamed("doc_id", "_mix_id"), docs["doc_id"].cast("long").eqNullSafe(F.col("_mix_id")))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "_mix_plan.copies")).alias("copy")
    return joined.where("_mix_plan.copies > 0").select(*kept, F.col("_mix_plan.domain").alias("domain"), F.col("_mix_plan.rate").alias("rate"), copies)


def source_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the sources of the documents that the labelled table covers.

    Rows without doc_id are left out; a null source is a null domain. Other columns are ignored.
    """
    covered = labels.select(F.col("doc_id").cast("long").alias("_id")).distinct()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("domain"))
    return named.join(covered, F.col("doc_id") == F.col("_id"), "left_semi")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mix(docs, source_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
