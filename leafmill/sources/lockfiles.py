"""Packages of lock files: native reads of lines and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import package_key


def pnpm_packages(lines: DataFrame, position: str = "position", column: str = "value") -> DataFrame:
    """(name, version, purl, source) of the keys in the section ``packages``, each once, by (position, value) rows of one file.

    A line belongs to the last section that began before it; a lock file is small, one file is one window.
    """
    section = F.regexp_extract(F.trim(column), "^(packages|snapshots|importers):$", 1)
    placed = lines.withColumn("_begun", F.nullif(section, F.lit("")))
    placed = placed.withColumn("_section", F.last("_begun", ignorenulls=True).over(Window.orderBy(position)))
    key = F.regexp_extract(column, r"^  ([^\s:][^:]*):$", 1)
    found = placed.where((F.col("_section") == "packages") & F.col("_begun").isNull() & (key != "")).select(package_key(key).alias("p")).where("p is not null")
    return found.select("p.name", "p.version").distinct().select("name", "version", F.concat(F.lit("pkg:npm/"), "name", F.lit("@"), "version").alias("purl"), F.lit("pnpm-lock.yaml").alias("source"))


def cargo_packages(files: DataFrame, column: str = "content") -> DataFrame:
    """(name, version, purl, source) of the package blocks of whole lock files."""
    block = r'\[\[package\]\]\s+name = "([^"]+)"\s+version = "([^"]+)"'
    text = F.col(column).cast("string")
    names, versions = (F.regexp_extract_all(text, F.lit(block), F.lit(i)) for i in (1, 2))
    found = files.select(F.explode(F.arrays_zip(names.alias("name"), versions.alias("version"))).alias("p"))
    return found.select(F.col("p.name").alias("name"), F.col("p.version").alias("version")).select("name", "version", F.concat(F.lit("pkg:cargo/"), "name", F.lit("@"), "version").alias("purl"), F.lit("Cargo.lock").alias("source"))
