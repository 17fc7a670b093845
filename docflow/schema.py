"""Record shapes shared by sources, operators and jobs."""

from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_extension", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("last_modified", T.TimestampType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("data_source_id", T.StringType()),
    T.StructField("metadata", STRING_MAP),
])

NODE = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("ref_doc_id", T.StringType()),
    T.StructField("chunk_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("start_char", T.IntegerType()),
    T.StructField("end_char", T.IntegerType()),
    T.StructField("metadata", STRING_MAP),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
])

KV = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("s", T.StringType()),
    T.StructField("h", STRING_MAP),
    T.StructField("l", T.ArrayType(T.StringType())),
    T.StructField("z", T.ArrayType(T.StructType([
        T.StructField("member", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]))),
    T.StructField("ttl_s", T.LongType()),
])

CHAT = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

TASK_LOG = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("error", T.StringType()),
])
