"""Fixed schemas of the engine. Everything is one of three types: string, bigint, double."""

from pyspark.sql import types as T

POINT = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("value", T.DoubleType(), False),
    ]
)

#: A logged write: the point, its arrival number, the generation it belongs to, its checksum.
WRITE = T.StructType(
    [*POINT.fields]
    + [
        T.StructField("seq", T.LongType(), False),
        T.StructField("gen", T.LongType(), False),
        T.StructField("checksum", T.IntegerType(), False),
    ]
)

#: One row for each published segment. ``gen`` is the newest generation in it; ``sources`` are
#: the segments that it replaces.
MANIFEST = T.StructType(
    [
        T.StructField("segment_id", T.StringType(), False),
        T.StructField("gen", T.LongType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("min_timestamp", T.LongType(), False),
        T.StructField("max_timestamp", T.LongType(), False),
        T.StructField("entry_count", T.LongType(), False),
        T.StructField("file_size_bytes", T.LongType(), False),
        T.StructField("sources", T.ArrayType(T.StringType(), False), False),
    ]
)

#: Longest id, in UTF-8 bytes, that a write may carry.
MAX_ID_BYTES = 1024
#: Bytes of an encoded entry besides its id: id length, timestamp, value.
ENTRY_OVERHEAD = 20
