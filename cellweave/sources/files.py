"""Readers: file listings, grid tables, manifests, search pages, granules, vocabularies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cellweave.functions.naming import last_segment
from cellweave.schemas import GRANULE_PAGE, MANIFEST, SEARCH_DOC


def scan_files(spark: SparkSession, root: str, pattern: str = "*.nc") -> DataFrame:
    """``name, path, length`` of every matching file below ``root``; bodies are not read.

    Spark's reader leaves out files of zero bytes.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(last_segment(F.col("path")).alias("name"), "path", "length")
    )


def read_bodies(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``name, content`` of every matching file, for checksums."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(last_segment(F.col("path")).alias("name"), "content")
    )


#: Bytes of a body that a task holds at once.
BLOCK = 8 << 20


def body_digests(spark: SparkSession, root: str, pattern: str = "*", block: int = BLOCK) -> DataFrame:
    """``name, path, length, md5, sha256, error`` of every matching file, read block by block in the tasks.

    Bodies of any size are hashed in bounded memory; one that can't be read gives a row with its error and
    does not stop the others. Only the listing is Spark's: bodies are streamed by Arrow's file systems (local
    and mounted folders, HDFS, object stores). :func:`read_bodies` reads through Spark alone, below 2 GB.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    paths = listed.select(last_segment(F.col("path")).alias("name"), "path", "length")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                md5, sha256, error = hashlib.md5(), hashlib.sha256(), None
                try:
                    # Spark writes a local path as file:/..., Arrow wants two slashes more.
                    system, at = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and path[5:7] != "//" else path)
                    with system.open_input_stream(at, compression=None) as stream:
                        while part := stream.read(block):
                            md5.update(part)
                            sha256.update(part)
                except Exception as e:  # noqa: BLE001 - one file's failure is its row
                    error = f"{type(e).__name__}: {e}"
                rows.append((None, None, error) if error else (md5.hexdigest(), sha256.hexdigest(), None))
            found = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], ["name", "path", "length", "md5", "sha256", "error"])

    return paths.mapInArrow(digests, "name string, path string, length long, md5 string, sha256 string, error string")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cell table; with a filter on ``variable`` only that variable's folders are listed."""
    return spark.read.parquet(path)


def variable_scan(cells: DataFrame, variable: str) -> DataFrame:
    """The values of one variable and nothing else."""
    return cells.where(F.col("variable") == variable).select("file_id", "time", "lat", "lon", "value")


def read_manifest(spark: SparkSession, path: str, schema: StructType = MANIFEST, multi_line: bool = False) -> DataFrame:
    """A saved manifest: JSON lines, or with ``multi_line`` files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_search_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Documents of saved search pages, one page per line or, with ``multi_line``, per file."""
    return search_docs(spark.read.text(path, wholetext=multi_line).select(F.col("value").alias("page")))


def search_docs(pages: DataFrame) -> DataFrame:
    """One row per document of each ``page`` text.

    A saved document has its facets as fields of its own, mostly lists. The fields of ``SEARCH_DOC``
    become columns, every other field an entry of ``facets``; a single value becomes a list of one.
    """
    docs = pages.select(F.explode(F.from_json("page", "response struct<docs:array<string>>")["response"]["docs"]).alias("doc"))
    fixed = [f for f in SEARCH_DOC.fields if f.name != "facets"]
    fields = F.from_json("doc", "map<string,string>")
    rest = F.map_filter(fields, lambda k, v: ~k.isin([f.name for f in fixed]) & v.isNotNull())

    def as_list(_, v: Column) -> Column:
        return F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))

    return docs.select(F.from_json("doc", StructType(fixed)).alias("d"), F.transform_values(rest, as_list).alias("facets")).select(
        "d.*", "facets"
    )


def read_granules(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return granule_features(spark.read.schema(GRANULE_PAGE).option("multiLine", multi_line).json(path))


def granule_features(pages: DataFrame) -> DataFrame:
    """Granules with an address: its file name, or the address's last segment; size 0 if unknown."""
    p = pages.select(F.explode("features.properties").alias("p"))
    url = F.col("p.url")
    return p.where(F.coalesce(url, F.lit("")) != "").select(
        F.coalesce("p.fileName", last_segment(url)).alias("title"),
        url.alias("url"),
        F.lit("ASF_DAAC").alias("source"),
        F.coalesce("p.bytes", F.lit(0).cast("long")).alias("size_bytes"),
    )


def parse_granule_page(text: Column) -> Column:
    return F.from_json(text, GRANULE_PAGE)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Terms of vocabulary files named ``<project>_<facet>.json``, each one JSON string array."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(
        last_segment(F.input_file_name()).alias("name"), F.col("value").alias("body")
    )
    stem = F.regexp_replace("name", r"\.json$", "")
    return vocab_terms(
        files.select(
            F.substring_index(stem, "_", 1).alias("project"),
            F.regexp_replace(stem, "^[^_]*_", "").alias("facet"),
            "body",
        )
    )


def vocab_terms(texts: DataFrame) -> DataFrame:
    """``project, facet, term`` from ``body`` texts that are JSON string arrays; others give no term."""
    return texts.select("project", "facet", F.explode(F.from_json("body", "array<string>")).alias("term"))


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """An object listing, ``key, size``."""
    return spark.read.parquet(path).select("key", F.col("size").cast("long").alias("size"))
