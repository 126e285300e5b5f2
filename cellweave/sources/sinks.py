"""Writers: cells, catalog, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellweave.functions.coords import normalize_lon
from cellweave.functions.naming import output_name
from cellweave.session import stage

PREFIX = "cellweave_"


def write_cells(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cells as Parquet, one folder per variable.

    Rows are sorted inside each task, so row groups cover narrow latitude and longitude ranges and a
    crop skips most of them. No shuffle: a variable with most of the rows stays spread over the tasks.
    """
    cells.sortWithinPartitions("variable", "lat", "lon").write.mode(mode).partitionBy("variable").parquet(path)


#: Bits of latitude and of longitude in the curve, and months of a step in time.
_CURVE_BITS, _CURVE_MONTHS = 8, 12


def curve(lat: Column, lon: Column) -> Column:
    """A place on a Z-order curve over the globe: bits of latitude and longitude, taken in turns; 0 off the grid."""
    cells = 1 << _CURVE_BITS
    steps = [F.least(F.greatest(F.floor(x * cells), F.lit(0)), F.lit(cells - 1)) for x in ((lat + 90) / 180, (normalize_lon(lon) + 180) / 360)]
    bits = [F.shiftleft(F.shiftright(s, b).bitwiseAND(F.lit(1)), 2 * b + k) for k, s in enumerate(reversed(steps)) for b in range(_CURVE_BITS)]
    return F.coalesce(reduce(lambda a, b: a + b, bits), F.lit(0))


def write_grids(cells: DataFrame, files: DataFrame, path: str, operation: str, keep_dirs: bool = True, mode: str = "errorifexists") -> None:
    """Cells by output file: one folder per output, named by the input's name and the operation, for later crops.

    ``files`` (file_id, name, rel_dir) gives the names; ``keep_dirs`` keeps the input's own folder in the name.
    Inside an output and variable the rows are dealt by ranges of a curve over time, latitude and longitude,
    so each written file and row group covers a small box of all three and a crop skips the others. Ranges are
    sampled by size: an output with most of the rows is many files.
    """
    named = stage(files.select("file_id", output_name(F.col("name"), F.col("rel_dir"), operation, keep_dirs).alias("output")), "output-names")
    step = F.floor((F.year("time") * 12 + F.month("time")) / _CURVE_MONTHS)
    order = ["output", "variable", "_step", "_curve"]
    placed = cells.join(named, "file_id").withColumns({"_step": step, "_curve": curve(F.col("lat"), F.col("lon"))})
    dealt = placed.repartitionByRange(*order, F.xxhash64("time", "lat", "lon")).sortWithinPartitions(*order, "time", "lat", "lon")
    dealt.drop("_step", "_curve").write.mode(mode).partitionBy("output").parquet(path)


def read_grid(spark: SparkSession, path: str, output: str) -> DataFrame:
    """The cells of one output file; only its folder is listed."""
    return spark.read.parquet(path).where(F.col("output") == output)


def write_catalog(entries: DataFrame, root: str, demo: bool = False, mode: str = "errorifexists") -> str:
    """The catalog as plain JSON lines, one per file, below ``root``; returns the path."""
    path = f"{root}/{'cmip6_catalog' if demo else 'catalog'}.json"
    entries.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def write_duplicates(duplicates: DataFrame, root: str, mode: str = "errorifexists") -> str | None:
    """The paths left out as copies; nothing is written if there are none."""
    if duplicates.isEmpty():
        return None
    path = f"{root}/duplicates.json"
    duplicates.select("file_id").write.mode(mode).json(path)
    return path


def write_query_results(manifest: DataFrame, root: str, source: str, mode: str = "errorifexists") -> str:
    """The work list of a source; the older climate archive has its own file name."""
    name = "query_results_to_download" if source == "cmip5" else "query_results"
    path = f"{root}/{PREFIX}{source}_{name}.json"
    manifest.write.mode(mode).json(path)
    return path


def write_failures(outcome: DataFrame, root: str, source: str, mode: str = "errorifexists") -> str:
    """The rows of ``outcome`` that are not ``ok``, as the input of a retry."""
    path = f"{root}/{PREFIX}{source}_failed_downloads.json"
    outcome.where(~F.col("ok")).drop("ok").write.mode(mode).json(path)
    return path
