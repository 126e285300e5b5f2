"""Expected files against listings and existing files.

The looked-up side is made distinct on the join key first, so a listing that repeats an entry very
often shrinks before the shuffle, and the join reuses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellweave.constants import USGS_CURRENT, USGS_HISTORICAL

_PREFIX = r"^([^/]+)/\d{6}/\1\.[^.]+\."


def available(expected: DataFrame, listing: DataFrame, key: str, listing_key: str = "key") -> DataFrame:
    """Expected files that the listing has."""
    return expected.join(listing.select(F.col(listing_key).alias(key)).distinct(), key, "left_semi")


def unavailable(expected: DataFrame, listing: DataFrame, key: str, listing_key: str = "key") -> DataFrame:
    """Expected files that the listing lacks."""
    return expected.join(listing.select(F.col(listing_key).alias(key)).distinct(), key, "left_anti")


def without_existing(expected: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Expected files that do not exist yet."""
    return expected.join(existing.select(key).distinct(), key, "left_anti")


def existing_of(expected: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Expected files that exist already."""
    return expected.join(existing.select(key).distinct(), key, "left_semi")


def size_matched(expected: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Expected files with ``size_bytes`` that exist with the same ``length``: those are done."""
    sized = existing.select(key, F.col("length").alias("size_bytes")).distinct()
    return expected.join(sized, [key, "size_bytes"], "left_semi")


def key_prefix(key: Column) -> Column:
    """``folder/YYYYMM/folder.code.`` of an object key; NULL for a key of another layout."""
    prefix = F.regexp_extract(key, _PREFIX, 0)
    return F.when(prefix != "", prefix)


def first_keys(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """First listed key of each expected ``prefix``; expected files without one drop out.

    An expected prefix ends at a fixed place of the key, so "starts with" becomes equality on the
    parsed prefix. The listing is reduced to its first key per prefix before the join.
    """
    first = (
        listing.select(key_prefix(F.col("key")).alias("prefix"), "key", "size")
        .where(F.col("prefix").isNotNull())
        .groupBy("prefix")
        .agg(F.min(F.struct("key", "size")).alias("hit"))
        .select("prefix", F.col("hit.key").alias("key"), F.col("hit.size").alias("size_bytes"))
    )
    return expected.join(first, "prefix").withColumn("filename", F.substring_index("key", "/", -1))


def all_keys(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Every listed key of each expected prefix, once: ``prefix, key, size_bytes, filename``.

    Requests refer to the result by their prefix. However many ask for one prefix, its keys are not
    repeated, so the rows are at most the listing's.
    """
    keyed = listing.select(
        key_prefix(F.col("key")).alias("prefix"), "key", F.col("size").alias("size_bytes")
    ).where(F.col("prefix").isNotNull())
    wanted = expected.select("prefix").distinct()
    return keyed.join(wanted, "prefix", "left_semi").withColumn("filename", F.substring_index("key", "/", -1))


def usgs_keys(tiles: DataFrame, listing: DataFrame) -> DataFrame:
    """The current key of each tile if listed, else the historical one; others drop out.

    The listing is read once: its keys are parsed into tile and edition and reduced to the better
    edition per tile.
    """
    folder = F.regexp_extract("key", rf"^({USGS_CURRENT}|{USGS_HISTORICAL})([^/]+)/USGS_13_\2\.tif$", 1)
    tile = F.regexp_extract("key", rf"^({USGS_CURRENT}|{USGS_HISTORICAL})([^/]+)/USGS_13_\2\.tif$", 2)
    ranked = F.struct(F.when(folder == USGS_CURRENT, 0).otherwise(1).alias("rank"), F.col("key"))
    best = (
        listing.where(folder != "")
        .groupBy(tile.alias("tile_id"))
        .agg(F.min(ranked).alias("best"))
        .select("tile_id", F.col("best.key").alias("key"))
    )
    return tiles.join(best, "tile_id").withColumn("size_bytes", F.lit(0).cast("long"))


def verify_checksums(manifest: DataFrame, bodies: DataFrame, key: str) -> DataFrame:
    """Manifest rows with ``ok``. Bodies are hashed where they are read: only digests are shuffled."""
    return verify_digests(manifest, bodies.select(key, F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256")), key)


def verify_digests(manifest: DataFrame, digests: DataFrame, key: str) -> DataFrame:
    """Manifest rows with ``ok``, by ``md5`` and ``sha256`` of each file (``body_digests``); an unreadable or missing file is not ok."""
    digests = digests.select(key, F.col("md5").alias("_md5"), F.col("sha256").alias("_sha256"))
    kind = F.lower(F.coalesce("checksum_type", F.lit("sha256")))
    digest = F.when(kind == "md5", F.col("_md5")).otherwise(F.col("_sha256"))
    ok = F.when(F.coalesce("checksum", F.lit("")) == "", True).otherwise(
        F.coalesce(digest == F.col("checksum"), F.lit(False))
    )
    return manifest.join(digests, key, "left").withColumn("ok", ok).drop("_md5", "_sha256")


def retry_set(manifest: DataFrame, failed: DataFrame, key: str = "title") -> DataFrame:
    """Manifest rows of the files that failed before."""
    return manifest.join(failed.select(key).distinct(), key, "left_semi")


def status_counts(status: DataFrame) -> DataFrame:
    """One row: files that succeeded, failed, and all."""
    return status.agg(
        F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("total")
    )
