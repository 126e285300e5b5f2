"""Cells that arrive as files: the same row-wise operators on a stream.

Crop, clip and conversion look at one row at a time (the clip mask is a static table), so they run
unchanged on a streaming DataFrame and need neither state nor watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cellweave.schemas import GRID_CELLS


def read_cells_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(GRID_CELLS).option("maxFilesPerTrigger", max_files).parquet(path)


def write_cells_stream(cells: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, processing what is there and then stopping."""
    return (
        cells.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("variable")
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
