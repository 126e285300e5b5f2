"""Table layouts shared by all operators."""

from pyspark.sql import types as T

GRID_FILES = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("rel_dir", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("error", T.StringType()),
])

GRID_VARS = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("var_pos", T.IntegerType()),
    T.StructField("var_name", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("dims", T.ArrayType(T.StringType())),
    T.StructField("fill_value", T.DoubleType()),
    T.StructField("units", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])

GRID_COORDS = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("idx", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])

GRID_CELLS = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("value", T.DoubleType()),
])

BOUNDARY_EDGES = T.StructType([
    T.StructField("region_id", T.StringType()),
    T.StructField("polygon_id", T.LongType()),
    T.StructField("ring_id", T.IntegerType()),
    T.StructField("seg", T.IntegerType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()),
    T.StructField("y2", T.DoubleType()),
])

_STRINGS = T.ArrayType(T.StringType())

# One document of a search page. In a saved page each facet is a field of the document; here they
# are the entries of ``facets``.
SEARCH_DOC = T.StructType([
    T.StructField("instance_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("data_node", T.StringType()),
    T.StructField("replica", T.BooleanType()),
    T.StructField("latest", T.BooleanType()),
    T.StructField("size", T.LongType()),
    T.StructField("url", _STRINGS),
    T.StructField("checksum", _STRINGS),
    T.StructField("checksum_type", _STRINGS),
    T.StructField("facets", T.MapType(T.StringType(), _STRINGS)),
])

GRANULE_PAGE = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.StructType([
            T.StructField("url", T.StringType()),
            T.StructField("fileName", T.StringType()),
            T.StructField("bytes", T.LongType()),
        ])),
    ]))),
])

# An entry of a work list or failure list, with all that a retry needs.
MANIFEST = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("instance_id", T.StringType()),
    T.StructField("data_node", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("urls", _STRINGS),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("checksum", T.StringType()),
    T.StructField("checksum_type", T.StringType()),
    T.StructField("output_path", T.StringType()),
    T.StructField("facets", T.MapType(T.StringType(), _STRINGS)),
    T.StructField("ok", T.BooleanType()),
])
