"""URL filters: host and path rules, then a ratio of two character models."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch

#: (verdict, host, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
ORDER = 5
#: Up to so many n-grams both models are broadcast whole; beyond, they stay a table that scores by joins.
BROADCAST_TYPES = 1 << 20
#: Rows of a bucket, whose windows meet its URLs in one task, as a power of two.
BUCKET_BITS = 12


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #`` (A-Z lower-cased), path up to ``? #``; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, as one CASE; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _shape(text: str) -> str:
    """What the models read: host and path, digits as one symbol."""
    return "^" + "".join("0" if c.isdigit() else c for c in text)


class Markov:
    """A variable-order model: Witten-Bell smoothed, from the longest context seen down to uniform."""

    def __init__(self, counts: dict[str, int], order: int = ORDER, alphabet: int = 128):
        self.order, self.alphabet = order, alphabet
        self.grams, self.total, self.kinds = Counter(), Counter(), Counter()
        for gram, n in counts.items():
            self.grams[gram] += n
            self.total[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1

    def log_likelihood(self, text: str) -> float:
        return sum(math.log(self._p(text[max(0, i - self.order + 1) : i], text[i])) for i in range(1, len(text)))

    def _p(self, context: str, c: str) -> float:
        p = 1 / self.alphabet
        for k in range(len(context), -1, -1):
            h = context[k:]
            n = self.total.get(h)
            if n:
                t = self.kinds[h]
                p = (self.grams.get(h + c, 0) + t * p) / (n + t)
        return p


class Ratio:
    """Accepts a URL whose length-normalised log-likelihood difference reaches the threshold."""

    def __init__(self, accepted: Markov, rejected: Markov, threshold: float = 0.0):
        self.accepted, self.rejected, self.threshold = accepted, rejected, threshold

    def score(self, text: str) -> float:
        x = _shape(text)
        return (self.accepted.log_likelihood(x) - self.rejected.log_likelihood(x)) / max(1, len(x) - 1)

    def add_scores(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with body) and score, by the broadcast models."""
        shared = rows.sparkSession.sparkContext.broadcast(self)
        at = rows.columns.index("body")

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ratio = shared.value
            known: dict[str, float] = {}
            for batch in source:
                scores = []
                for body in batch.column(at).to_pylist():
                    key = _shape(body)
                    if key not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[key] = ratio.score(body)
                    scores.append(known[key])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

        return rows.mapInArrow(batches, _with(rows, "score double"))


class FarRatio:
    """The same ratio over a table of all n-grams, of any size: no part of it reaches the driver.

    A symbol's probability depends on the window of ``order`` symbols that it ends, so each
    distinct window is scored once. Probabilities grow from the shortest suffix by one join a
    symbol, where an n-gram meets as many rows as there are symbols before it. A window goes
    to a bucket of URLs once, however many of them hold it.
    """

    def __init__(self, grams: DataFrame, scratch: Scratch, order: int = ORDER, alphabet: int = 128):
        self.scratch, self.order, self.alphabet, self.threshold = scratch, order, alphabet, 0.0
        of = lambda v, x: F.sum(F.when(F.col("verdict") == v, x).otherwise(0))
        self.grams = scratch.save(grams.groupBy("gram").agg(of("allow", F.col("n")).alias("an"), of("block", F.col("n")).alias("bn")), "grams")
        context = F.expr("substring(gram, 1, char_length(gram) - 1)")
        self.contexts = scratch.save(
            grams.groupBy(context.alias("context")).agg(*[of(v, x).alias(v[0] + name) for v in ("allow", "block") for name, x in (("total", F.col("n")), ("kinds", F.lit(1)))]), "contexts"
        )

    def _probabilities(self, windows: DataFrame) -> DataFrame:
        """(gram, pa, pb) of each distinct window, by both models."""
        suffixes = F.expr("transform(sequence(1, char_length(window)), k -> substring(window, k))")
        grams = self.scratch.save(windows.select(F.explode(suffixes).alias("gram")).distinct(), "needed")
        done = None
        for size in range(1, self.order + 1):
            here = grams.where(F.char_length("gram") == size).withColumns({"context": F.expr("substring(gram, 1, char_length(gram) - 1)"), "shorter": F.expr("substring(gram, 2)")})
            if done is None:
                here = here.withColumns({"pa": F.lit(1 / self.alphabet), "pb": F.lit(1 / self.alphabet)})
            else:
                here = here.join(done.withColumnRenamed("gram", "shorter"), "shorter")
            here = here.join(self.grams, "gram", "left").join(self.contexts, "context", "left")
            new = [
                F.when(F.coalesce(F.col(f"{v}total"), F.lit(0)) > 0, (F.coalesce(F.col(f"{v}n"), F.lit(0)) + F.col(f"{v}kinds") * F.col(f"p{v}")) / (F.col(f"{v}total") + F.col(f"{v}kinds"))).otherwise(F.col(f"p{v}")).alias(f"p{v}")
                for v in "ab"
            ]
            done = self.scratch.save(here.select("gram", *new), f"p{size}")
            found = done if size == 1 else found.unionByName(done)
        return found

    def add_scores(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with body) and score."""
        order, bits = self.order, BUCKET_BITS
        rows = self.scratch.save(rows.withColumn("bucket", F.shiftright(F.monotonically_increasing_id(), bits)), "bodies")

        def windows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                found = set()
                for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    x = _shape(body)
                    found.update((bucket, x[max(0, i - order + 1) : i + 1]) for i in range(1, len(x)))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.string())], ["bucket", "window"])

        seen = self.scratch.save(rows.select("bucket", "body").mapInArrow(windows, "bucket long, window string").distinct(), "windows")
        met = seen.join(self._probabilities(seen.select("window")).withColumnRenamed("gram", "window"), "window").select("bucket", "window", "pa", "pb")
        names = [c for c in rows.columns if c != "bucket"]

        def scored(left: pa.Table, right: pa.Table) -> pa.Table:
            logs = {w: (math.log(a), math.log(b)) for w, a, b in zip(*(right.column(c).to_pylist() for c in ("window", "pa", "pb")), strict=True)}
            scores = []
            for body in left.column("body").to_pylist():
                x = _shape(body)
                hits = [logs[x[max(0, i - order + 1) : i + 1]] for i in range(1, len(x))]
                scores.append((sum(h[0] for h in hits) - sum(h[1] for h in hits)) / max(1, len(x) - 1))
            return left.select(names).append_column("score", pa.array(scores, pa.float64()))

        return rows.groupBy("bucket").cogroup(met.groupBy("bucket")).applyInArrow(scored, _with(rows.select(*names), "score double"))


def _with(rows: DataFrame, extra: str) -> str:
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), extra])


def _counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(verdict, gram, n): all n-grams up to the order, over all rows, with map-side counts."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found: Counter = Counter()
            for verdict, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = _shape(text)
                for i in range(1, len(x)):
                    for k in range(max(0, i - order + 1), i + 1):
                        found[verdict, x[k : i + 1]] += 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["verdict", "gram", "n"])

    return rows.mapInArrow(batches, "verdict string, gram string, n long").groupBy("verdict", "gram").agg(F.sum("n").alias("n"))


def train(judged: DataFrame, types: int = BROADCAST_TYPES) -> Ratio | FarRatio:
    """Models of the URLs that rules accept and reject, and their calibrated threshold.

    ``judged`` has verdict and body (host and path). n-grams are counted over all rows
    but one in five (by hash), and all are used: up to ``types`` of both verdicts together
    reach the driver and are broadcast, more stay a written table. The rows left out set the
    threshold: of the observed score bounds the one with the highest mean of both
    accuracies, found on a histogram of scores, so that no row reaches the driver.
    """
    scratch = Scratch(judged.sparkSession, "urls")
    held = F.pmod(F.xxhash64("body"), F.lit(5)) == 0
    grams = scratch.save(_counts(judged.where(~held)), "counts")
    if grams.count() <= types:
        models = {"allow": {}, "block": {}}
        for r in grams.toLocalIterator():
            models[r.verdict][r.gram] = r.n
        ratio = Ratio(Markov(models["allow"]), Markov(models["block"]))
    else:
        ratio = FarRatio(grams, scratch)
    step = F.greatest(F.lit(-400), F.least(F.lit(400), F.bround(F.col("score") * 100).cast("int"))).alias("step")
    seen = ratio.add_scores(judged.where(held)).groupBy(step, "verdict").count().collect()  # at most 2 x 801 rows
    both = {v: {r.step: r["count"] for r in seen if r.verdict == v} for v in ("allow", "block")}
    sums = {v: sum(x.values()) for v, x in both.items()}
    if all(sums.values()):
        def accuracy(at: int) -> float:
            return sum(n for s, n in both["allow"].items() if s >= at) / sums["allow"] + sum(n for s, n in both["block"].items() if s < at) / sums["block"]

        ratio.threshold = max(range(-400, 401), key=lambda at: (accuracy(at), -abs(at))) / 100 - 0.005
    return ratio


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, types: int = BROADCAST_TYPES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    The longest rule that fits a host (or its subdomains) and path decides; other URLs are
    allowed if the ratio of the models reaches its threshold. The models learn from
    the URLs that rules decide; without any of either kind every score is 0 and the
    verdict allow. A null url, or one without ``://``, has empty host and path and
    is judged by the models like others. Only page_id and url are read; repeated rows
    repeat their result; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "ruled": verdict, "body": F.concat("host", "path")})
    ratio = train(ruled.where("rule is not null").select(F.col("ruled").alias("verdict"), "body"), types)
    scored = ratio.add_scores(ruled.select("page_id", "host", "path", "rule", "ruled", "body"))
    judged = F.coalesce("ruled", F.when(F.col("score") >= ratio.threshold, "allow").otherwise("block")).alias("verdict")
    return scored.select("page_id", "host", "path", "rule", judged, "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
