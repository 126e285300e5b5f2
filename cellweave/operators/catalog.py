"""Catalog of files: resolve copies, check metadata, group.

``files`` has the layout ``grid_files``: one row per file with its global attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from cellweave.constants import CATALOG_ATTRS, REQUIRED_ATTRS
from cellweave.functions.naming import base_filename, is_plain


def file_attributes(files: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The five catalog attributes as columns, beside ``more``; absent ones and those of unreadable files are NULL."""
    readable = F.col("error").isNull()
    return files.select(
        *more,
        "file_id",
        "name",
        *[F.when(readable, F.try_element_at("attrs", F.lit(a))).alias(a) for a in CATALOG_ATTRS],
        "error",
    )


def _preference() -> Column:
    return F.struct((~is_plain(F.col("name"))).alias("prefixed"), F.col("file_id").alias("path"))


def deduplicate(files: DataFrame) -> DataFrame:
    """One file per base name: a plain name first, else the first path.

    A minimum per base name, so copies combine before the shuffle and a base name with very many
    copies costs no more than another.
    """
    best = files.withColumn("base", base_filename(F.col("name")))
    packed = F.struct(*[F.col(c) for c in files.columns])
    return (
        best.groupBy("base")
        .agg(F.min_by(packed, _preference()).alias("kept"), F.count("*").alias("copies"))
        .select("base", "copies", "kept.*")
    )


def duplicates(files: DataFrame) -> DataFrame:
    """The files that :func:`deduplicate` leaves out, found by their unique path (no skew)."""
    kept = deduplicate(files.select("file_id", "name")).select("file_id")
    return files.join(kept, "file_id", "left_anti").withColumn("base", base_filename(F.col("name")))


def _is_blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def missing_attributes(attributes: DataFrame) -> DataFrame:
    """Add ``missing``: the required attributes a file lacks, joined by commas."""
    return attributes.withColumn(
        "missing", F.concat_ws(", ", *[F.when(_is_blank(a), F.lit(a)) for a in REQUIRED_ATTRS])
    )


def skipped(attributes: DataFrame) -> DataFrame:
    """Files that do not enter the catalog, with the reason."""
    checked = missing_attributes(attributes)
    reason = F.when(
        F.col("error").isNotNull(), F.concat(F.lit("Failed to read or extract metadata: "), F.col("error"))
    ).when(F.col("missing") != "", F.concat(F.lit("Incomplete metadata (missing: "), F.col("missing"), F.lit(")")))
    return checked.select("file_id", "name", reason.alias("reason")).where(F.col("reason").isNotNull())


def included(attributes: DataFrame) -> DataFrame:
    """Files with all required attributes, with their catalog key ``activity:source:variant``."""
    checked = missing_attributes(attributes)
    return (
        checked.where(F.col("error").isNull() & (F.col("missing") == ""))
        .withColumn("catalog_key", F.concat_ws(":", "activity_id", "source_id", "variant_label"))
        .drop("missing", "error")
    )


_KEY = ("catalog_key", "activity_id", "source_id", "variant_label")


def _counts(entries: DataFrame) -> DataFrame:
    """Files, first file and institution per catalog key and variable.

    A key's institution is that of its first file and may be NULL; it is looked up among the key's
    variables, which are few, once its files are counted.
    """
    first = F.min(F.struct("file_id", "institution_id"))
    counted = entries.groupBy(*_KEY, "variable_id").agg(F.count("*").alias("file_count"), first.alias("first"))
    head = F.min("first").over(Window.partitionBy("catalog_key"))
    return counted.select(
        *_KEY, "variable_id", "file_count", F.col("first.file_id").alias("first_file"), head["institution_id"].alias("institution_id")
    )


def catalog_flat(attributes: DataFrame) -> DataFrame:
    """One row per catalog key and variable: number of files, first file, institution of the key."""
    return _counts(included(attributes))


def catalog_entries(attributes: DataFrame) -> DataFrame:
    """The catalog in long form: one row per file, with its key's fields and its variable's number of files.

    The layout is the same for a key of one file and of a hundred million. Only counts are joined to
    the files, so a hot key is split like any skewed join.
    """
    entries = included(attributes)
    counts = _counts(entries).select("catalog_key", "variable_id", "institution_id", "file_count")
    return (
        entries.select(*_KEY, "variable_id", "file_id")
        .join(counts, ["catalog_key", "variable_id"])
        .select(*_KEY, "institution_id", "variable_id", "file_count", "file_id")
    )


def summary(files: DataFrame) -> DataFrame:
    """Files included, skipped and left out as copies, as ``(status, files)``."""
    kept = deduplicate(files)
    judged = missing_attributes(file_attributes(kept)).select(
        F.when(F.col("error").isNull() & (F.col("missing") == ""), "included").otherwise("skipped").alias("status")
    )
    copies = kept.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("files")).select(
        F.lit("duplicate").alias("status"), "files"
    )
    return judged.groupBy("status").agg(F.count("*").alias("files")).unionByName(copies)


def write_catalog_counted(files: DataFrame, path: str) -> dict[str, int]:
    """Write the flat list of included files and return the counts of the run: included, skipped, duplicate.

    The counts are taken from the rows on their way to the files, so the files are read and resolved once.
    """
    counts = Observation("catalog-run")
    judged = missing_attributes(file_attributes(deduplicate(files), more=("copies",)))
    fine = F.col("error").isNull() & (F.col("missing") == "")
    seen = judged.observe(
        counts,
        F.count_if(fine).alias("included"),
        F.count_if(~fine).alias("skipped"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate"),
    )
    seen.where(fine).drop("copies", "missing", "error").write.parquet(path)
    return counts.get
