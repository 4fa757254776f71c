"""Exact deduplication by distributed most-significant-byte radix partitioning."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch


def fold_case(text: Column) -> Column:
    """Null as empty, A-Z lower-cased; every other character stays."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = 64, growth: int = 8) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept, text_sha256.

    All texts start in one group. A round splits every open group by the next digit of
    its texts, a run of successive bytes (64, then 512, 4096, ... so that the number
    of rounds grows with the logarithm of the longest text). A group of one text is
    done; so is a group whose texts end with this digit: all their bytes were equal.
    Equality rests on the bytes alone; the sha256 is only reported.

    A round counts groups with map-side combine and joins the counts of groups of
    two or more back, so a group holding a third of all rows is one row per task in the
    aggregation and an AQE-splittable side in the join. Only texts of open groups, and
    of those only the bytes not yet compared, are written for the next round.

    Nulls: a null text is empty. A null id never wins unless all ids of the group
    are null. Rows repeating an id and its text are all marked kept
    (``keep_one_each`` removes the surplus). Empty table: empty result. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = fold_case(F.col(text_col))
    open_rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("sha"), F.monotonically_increasing_id().alias("row"), F.lit(-1).cast("long").alias("grp"), text.cast("binary").alias("rest"))
    done, width = [], first_digit
    while True:
        digits = open_rows.select(
            "doc_id", "sha", "row", "grp",
            F.expr(f"substring(rest, 1, {width})").alias("digit"),
            (F.octet_length("rest") > width).alias("more"),
            F.expr(f"substring(rest, {width + 1})").alias("rest"),
        )
        groups = digits.groupBy("grp", "digit", "more").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"), F.max("row").alias("name")).where("n > 1")
        joined = digits.join(groups.withColumnRenamed("n", "size"), ["grp", "digit", "more"], "left").select(
            "doc_id", "sha", "row", "name", F.coalesce("top", "doc_id").alias("top"), F.coalesce("size", F.lit(1)).cast("long").alias("size"),
            (F.col("size").isNotNull() & F.col("more")).alias("open"),
            F.when(F.col("size").isNotNull() & F.col("more"), F.col("rest")).alias("rest"),
        )
        written = scratch.save(joined, f"digit{width}")
        done.append(written.where("not open"))
        open_rows = written.where("open").select("doc_id", "sha", "row", F.col("name").alias("grp"), "rest")
        if open_rows.isEmpty():
            break
        width *= growth
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out.select(F.col("doc_id").alias(id_col), F.col("top").alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("top")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: of equal texts the largest id's, once.

    The radix groups decide. Ids that stand on one row (nearly all) are joined by the id alone; texts are
    hashed again only for ids that several rows share, if there are any. Nulls, long texts and empty tables are
    as in ``exact_duplicates``: a row without id stays only in a group without any id. Other columns are kept, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    found = exact_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("_keep_id"), F.col("kept").alias("_keep"), F.col("text_sha256").alias("_keep_sha"))
    ids = scratch.save(found.groupBy("_keep_id").agg(F.count(F.lit(1)).alias("_keep_rows"), F.collect_set(F.when(F.col("_keep"), F.col("_keep_sha"))).alias("_keep_shas")), "ids")
    own = docs[id_col].cast("long")
    alone = ids.where("_keep_rows = 1 and size(_keep_shas) = 1").select("_keep_id")
    out = docs.join(alone, own.eqNullSafe(alone["_keep_id"]), "left_semi")
    shared = ids.where("_keep_rows > 1 and size(_keep_shas) > 0").select("_keep_id", F.explode("_keep_shas").alias("_keep_sha"))
    if shared.isEmpty():
        return out
    digest = F.sha2(fold_case(F.col(text_col)), 256)
    more = docs.join(shared, own.eqNullSafe(shared["_keep_id"]) & (digest == shared["_keep_sha"]), "left_semi")
    once = more.groupBy(own.alias("_id"), digest.alias("_sha")).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    return out.unionByName(once.select("_row.*"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP4_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS body FROM documents),
g AS (SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
