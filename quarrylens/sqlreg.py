"""Functions of the engine for SQL: ``register(spark)``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions import decode, pretty, urls
from .operators import api

#: Names of Arrow functions as SQL sees them.
UDFS = {
    "url_resolve": urls.url_resolve,
    "infer_json_schema": api.schema_of_sample,
    "json_key_set": api.key_set,
    "flags_on": api.flags_on,
    "decode_protobuf": decode.protobuf_json,
    "decode_msgpack": decode.msgpack_json,
    "decode_flight": decode.flight_json,
    "decode_frame": decode.frame_json,
    "decode_model_stream": decode.model_stream_json,
    "wasm_module": decode.wasm_json,
    "zip_listing": decode.zip_json,
    "hex_dump": decode.hex_dump,
    "decompress": decode.decompress,
    "beautify": pretty.pretty,
}
#: SQL functions over built-in expressions, inlined by the optimizer.
SQL = {
    "norm_text": ("s STRING", "STRING", r"translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ-_./\\:;|+~*% ', 'abcdefghijklmnopqrstuvwxyz')"),
    "url_host": ("u STRING", "STRING", r"lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"),
    "url_query": ("u STRING", "STRING", r"regexp_extract(u, '^[^?#]*\\?([^#]*)', 1)"),
    "severity_rank": ("s STRING", "INT", "CASE s WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'info' THEN 3 ELSE 4 END"),
}


def register(spark: SparkSession) -> None:
    for name, udf in UDFS.items():
        spark.udf.register(name, udf)
    for name, (args, kind, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
