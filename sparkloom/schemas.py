"""The data model's base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

FILES = _struct(("filepath", _S, False), ("mtime", _TS, False), ("file_size", _L, False), ("content_hash", _S, True))
SYMBOLS = _struct(
    ("id", _S, False), ("filepath", _S, False), ("name", _S, False), ("kind", _S, False), ("role", _S, False), ("link_name", _S, True),
    ("start_byte", _L, False), ("end_byte", _L, False), ("start_line", _L, False), ("end_line", _L, False), ("semantic_hash", _S, True), ("fault_id", _S, True),
)
EDGES = _struct(("src", _S, False), ("dst", _S, False), ("kind", _S, False), ("tier", _S, False), ("confidence", _D, False), ("source", _S, True), ("evidence", T.ArrayType(_S), False))
INDEX_RUNS = _struct(
    ("ts_unix", _L, True), ("index_mode", _S, True), ("parser_backend_requested", _S, True), ("parser_backend_effective", _S, True), ("execution_model", _S, True), ("total_files", _L, True), ("cache_hits", _L, True),
    ("cache_misses", _L, True), ("native_files", _L, True), ("wasm_files", _L, True), ("native_fallbacks", _L, True), ("parse_fail", _L, True), ("no_symbols", _L, True), ("total_ms", _L, True),
)
HISTORY = _struct(
    ("ts", _L, True), ("seq", _L, True), ("collaboration_id", _S, True), ("agent_id", _S, True), ("transaction_id", _S, True), ("operation", _S, True), ("input", _S, True), ("output", _S, True),
    ("base_hash", _S, True), ("post_hash", _S, True), ("success", _B, True), ("error", _S, True),
)
CONTRIBUTIONS = _struct(
    ("ts", _L, True), ("seq", _L, True), ("collaboration_id", _S, True), ("actor_id", _S, True), ("actor_kind", _S, True), ("actor_surface", _S, True), ("transaction_id", _S, True), ("operation", _S, True),
    ("resources", T.ArrayType(_S), True), ("success", _B, True), ("error", _S, True), ("prev_hash", _S, True), ("entry_hash", _S, True), ("local_only", _B, True),
)

#: Kinds and roles of symbols, fixed values.
KINDS = ("function", "class", "struct", "interface", "module", "variable", "method", "unknown")
ROLES = ("definition", "stub", "reference")
CONTAINER_KINDS = ("module", "class", "struct", "interface")


def decode_symbols(rows: DataFrame) -> DataFrame:
    """PF1: kinds that aren't known become ``unknown``, roles that aren't known ``definition``."""
    return rows.withColumns({"kind": F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("unknown"), "role": F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("definition")})
