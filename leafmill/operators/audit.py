"""The relational quality audit: joins, duplicates, missing results, grouped totals, retention."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unknown_results(results: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Results with error UNKNOWN_DOCUMENT where the manifest has no such document."""
    known = manifest.select(F.col(key).alias("_known")).distinct()
    joined = results.join(known, results[key] == F.col("_known"), "left")
    return joined.withColumn("error", F.when(F.col("_known").isNull(), "UNKNOWN_DOCUMENT")).drop("_known")


def missing_results(documents: DataFrame, operations: list[str], results: DataFrame, keys: list[str]) -> DataFrame:
    """(document, operation) pairs without a result; ``keys`` end with the operation's column."""
    expected = documents.withColumn(keys[-1], F.explode(F.array(*map(F.lit, operations))))
    return expected.join(results.select(*keys).distinct(), keys, "left_anti")


def duplicates(documents: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(digest, copies, first_id) of contents that occur in several documents."""
    return documents.groupBy(content.alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id")).where("copies > 1")


def summary(results: DataFrame, group: list[str]) -> DataFrame:
    """Per group: attempted, succeeded, expected_failure, unexpected, p95 of elapsed_ms and peak_rss_mib.

    ``results`` has state, error_code, expected_codes (array or null), elapsed_ms, peak_rss_mib. A success where
    a failure is expected is unexpected, as is a failure with another code. p95 is the nearest rank;
    null for no value.
    """
    expected = F.coalesce((F.col("state") == "failed") & F.array_contains("expected_codes", F.col("error_code")), F.lit(False))
    succeeded = F.coalesce((F.col("state") == "succeeded") & F.col("expected_codes").isNull(), F.lit(False))
    return results.groupBy(*group).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(succeeded).alias("succeeded"),
        F.count_if(expected).alias("expected_failure"),
        F.count_if(~succeeded & ~expected).alias("unexpected"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY elapsed_ms)").alias("p95_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY peak_rss_mib)").alias("p95_mib"),
    )


def normalised_text(text: str) -> str:
    """NFKC without white space."""
    return _SPACE.sub("", unicodedata.normalize("NFKC", text))


_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def text_retention(pairs: DataFrame, key: str, reference: str, actual: str) -> DataFrame:
    """One row per pair: key, matched, expected, retention (null without expected characters).

    The share of the reference's characters found in the actual text, as multisets after NFKC
    without white space. A pair is compared within its row; nothing is shuffled.
    """

    def compared(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            matched, expected, known = [], [], {}
            for ref, act in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if ref not in known:  # a reference often stands beside many texts
                    if len(known) > 1000:
                        known.clear()
                    known[ref] = Counter(normalised_text(ref or ""))
                want, text = known[ref], normalised_text(act or "")
                matched.append(sum(min(n, text.count(c)) for c, n in want.items()))
                expected.append(want.total())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(matched, pa.int64()), pa.array(expected, pa.int64())], [key, "matched", "expected"])

    rows = pairs.select(key, F.col(reference).cast("string").alias("_ref"), F.col(actual).cast("string").alias("_act"))
    out = rows.mapInArrow(compared, f"{key} {dict(rows.dtypes)[key]}, matched long, expected long")
    return out.withColumn("retention", F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")))


def latest_revision(rows: DataFrame, key: str, revision: list[str], value: str) -> DataFrame:
    """Per key the value of the newest revision: one aggregation, no window."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*revision)).alias(value))


def drop_stale(events: DataFrame, job: str, seq: str, arrival: list[str]) -> DataFrame:
    """Events whose sequence number exceeds all that arrived before in the job."""
    before = Window.partitionBy(job).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_last", F.max(seq).over(before)).where(F.col("_last").isNull() | (F.col(seq) > F.col("_last"))).drop("_last")


def gap_free_prefix(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Rows whose position (from 0) equals their rank: progress without gaps."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(position)) - 1).where(F.col(position) == F.col("_rank")).drop("_rank")


MAX_COPIES = 1000


def reserve_names(rows: DataFrame, stem: str, order: str) -> DataFrame:
    """Output names ``stem``, ``stem (1)``, ... by order; null after ``stem (1000)``.

    A stem that itself reads ``x (1)`` may be taken by a copy of ``x``, or take its name: the
    stems of such a family (equal but for the counts at the end) are named one after another. Other stems,
    nearly all, are ranked by a window. A key that holds a third of the rows is one task.
    """
    family = F.regexp_replace(F.col(stem), r"( \((?:[1-9][0-9]{0,2}|1000)\))+$", "")
    tagged = rows.withColumns({"_family": family, "_counted": family != F.col(stem)})
    mixed = tagged.where("_counted").select("_family").distinct()
    alone = tagged.join(mixed, "_family", "left_anti")
    rank = F.row_number().over(Window.partitionBy(stem).orderBy(order)) - 1
    named = F.when(F.col("_rank") == 0, F.col(stem)).when(F.col("_rank") <= MAX_COPIES, F.format_string("%s (%d)", F.col(stem), F.col("_rank")))
    names = list(rows.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", reserved string"

    def one_after_another(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        taken, nexts, out = set(), {}, []
        for s in table.column(stem).to_pylist():
            n = nexts.get(s, 0)
            while n <= MAX_COPIES and (f"{s} ({n})" if n else s) in taken:
                n += 1
            nexts[s] = n + 1
            name = (f"{s} ({n})" if n else s) if n <= MAX_COPIES else None
            taken.add(name)
            out.append(name)
        return table.select(names).append_column("reserved", pa.array(out, pa.string()))

    families = tagged.join(mixed, "_family", "left_semi").groupBy("_family").applyInArrow(one_after_another, schema)
    return alone.withColumn("_rank", rank).withColumn("reserved", named).select(*names, "reserved").unionByName(families)


def numbered_names(rows: DataFrame, stem: str, order: str, block: int = 1 << 16) -> DataFrame:
    """``rows`` with reserved: ``stem``, ``stem (1)``, ... by a numeric order, without an end; each stem by itself.

    A stem's rows are ranked in ranges of the order of about ``block`` rows of the table, and each range begins where those
    before it end: no task ranks a whole stem. A null stem gives null; null orders come last.
    """
    low, high, n = rows.agg(F.min(order).cast("double"), F.max(order).cast("double"), F.count(order)).first()
    width = max((high - low) * block / n, 1e-300) if n else 1.0
    ranged = rows.withColumn("_range", F.coalesce(F.floor((F.col(order).cast("double") - F.lit(low)) / F.lit(width)), F.lit((1 << 63) - 1)))
    before = Window.partitionBy("_stem").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(F.col(stem).alias("_stem"), F.col("_range").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges.select("_stem", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(stem, "_range").orderBy(F.col(order).asc_nulls_last())) - 1
    placed = ranged.withColumn("_own", own).join(ranges, F.col(stem).eqNullSafe(F.col("_stem")) & (F.col("_range") == F.col("_at")))
    rank = F.col("_before") + F.col("_own")
    return placed.select(*rows.columns, F.when(rank == 0, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit(" ("), rank.cast("string"), F.lit(")"))).alias("reserved"))


def output_files(stem: Column, extension: Column, count: Column) -> Column:
    """The files of one conversion: ``stem.ext``, or ``stem-001.ext`` and so on for several."""
    several = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat(stem, F.lit("-"), F.format_string("%03d", i), F.lit("."), extension))
    return F.when(count == 1, F.array(F.concat(stem, F.lit("."), extension))).when(count > 1, several)


def baseline_breaks(moves: DataFrame, page: list[str], order: str, dy: str) -> DataFrame:
    """``moves`` with y (the sum of the moves so far) and breaks: whether the baseline is another than before.

    A move of at most 0.001 is none; a baseline that differs by more than 0.5 begins a line.
    """
    upto = Window.partitionBy(*page).orderBy(order)
    moved = F.when(F.abs(dy) > 0.001, F.col(dy)).otherwise(0.0)
    placed = moves.withColumn("y", F.sum(moved).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.withColumn("breaks", F.coalesce(F.abs(F.col("y") - F.lag("y").over(upto)) > 0.5, F.lit(False)))


def running_budget(rows: DataFrame, group: str, order: str, size: str, cap: int) -> DataFrame:
    """Rows with used (running sum of sizes) and within (used <= cap)."""
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(upto)).withColumn("within", F.col("used") <= cap)


def component_inventory(components: DataFrame, position: str = "position") -> DataFrame:
    """Distinct components by purl and version in the order of purl; the first license of each counts."""
    return components.groupBy("purl", "version").agg(F.min_by("license", position).alias("license")).orderBy("purl", "version")


def unknown_licenses(components: DataFrame) -> DataFrame:
    return components.where(F.col("license") == "UNKNOWN")


def self_check(checks: DataFrame, group: str) -> DataFrame:
    """Per group ``ready`` if all its checks passed, else ``repairable``."""
    return checks.groupBy(group).agg(F.when(F.bool_and(F.col("status") == "passed"), "ready").otherwise("repairable").alias("state"))


def first_mode_per_output(modes: DataFrame, group: str, output: str, position: str) -> DataFrame:
    """Of each output of a group the first mode: one aggregation, no window."""
    rest = [c for c in modes.columns if c not in (group, output)]
    return modes.groupBy(group, output).agg(F.min_by(F.struct(*rest), position).alias("_first")).select(group, output, "_first.*")


def not_present(paths: DataFrame, listed: DataFrame, key: str = "path") -> DataFrame:
    """Dropped paths that are not in the list yet, each once."""
    return paths.dropDuplicates([key]).join(listed.select(key), key, "left_anti")
