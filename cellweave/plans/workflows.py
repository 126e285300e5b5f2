"""The chains that users run. All are lazy but the clip, which stages its mask."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellweave.operators import availability, catalog, clip, search
from cellweave.operators.aggregate import aggregate
from cellweave.operators.convert import convert_cells
from cellweave.operators.crop import crop
from cellweave.operators.expand import prism_expand


def crop_convert_aggregate(
    cells: DataFrame, box: dict, variable: str, target_unit: str, freq: str = "monthly", method: str = "mean"
) -> DataFrame:
    """Crop, convert one variable and aggregate it: one scan, one shuffle."""
    kept = crop(cells.where(F.col("variable") == variable), box)
    return aggregate(convert_cells(kept, variable, target_unit), freq, method, variable)


def clip_aggregate(
    cells: DataFrame,
    edges: DataFrame,
    variable: str,
    freq: str = "seasonal",
    method: str = "sum",
    buffer_km: float = 0.0,
    points: DataFrame | None = None,
) -> DataFrame:
    """Keep the cells of a region and aggregate one variable."""
    chosen = cells.where(F.col("variable") == variable)
    mask = clip.region_mask(chosen, edges, buffer_km, points)
    return aggregate(clip.clip_filter(chosen, mask), freq, method, variable)


def plan_downloads(
    requests: DataFrame,
    listing: DataFrame,
    existing: DataFrame,
    resolution: str = "4km",
    time_step: str = "daily",
    max_downloads: int | None = None,
) -> DataFrame:
    """Expected files, those available, minus those at hand, at most ``max_downloads`` of them."""
    expected = prism_expand(requests, resolution, time_step)
    listed = availability.available(expected, listing, "url", "url")
    todo = availability.without_existing(listed, existing, "output_path")
    return search.limit_manifest(todo, max_downloads, "output_path")


def build_catalog(files: DataFrame) -> DataFrame:
    """Resolve copies, read attributes, drop incomplete files, list by catalog key."""
    return catalog.catalog_entries(catalog.file_attributes(catalog.deduplicate(files)))
