"""Schemas of the tables checkup reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
D = T.DoubleType()
L = T.LongType()
B = T.BooleanType()

LOCATION = T.StructType([T.StructField("kind", S), T.StructField("identifier", S)])
SUGGESTION = T.StructType([
    T.StructField("kind", S), T.StructField("sql", S), T.StructField("note", S),
])

# One row per finding. Plan rules fill run_id/node_ord, data rules table/column.
FINDINGS = T.StructType([
    T.StructField("rule_id", S),
    T.StructField("rule_rank", T.IntegerType()),
    T.StructField("severity", S),
    T.StructField("title", S),
    T.StructField("detail", S),
    T.StructField("location", LOCATION),
    T.StructField("evidence", S),
    T.StructField("suggestion", SUGGESTION),
    T.StructField("table_name", S),
    T.StructField("column_name", S),
    T.StructField("column_ordinal", L),
    T.StructField("run_id", L),
    T.StructField("node_ord", L),
])

# Catalog listings.
CATALOG_COLUMNS = T.StructType([
    T.StructField("table_schema", S),
    T.StructField("table_name", S),
    T.StructField("column_name", S),
    T.StructField("ordinal_position", L),
    T.StructField("data_type", S),
    T.StructField("is_nullable", S),
    T.StructField("column_default", S),
])
CATALOG_INDEXES = T.StructType([
    T.StructField("table_name", S),
    T.StructField("index_name", S),
    T.StructField("column_names", T.ArrayType(S)),
    T.StructField("is_unique", B),
    T.StructField("predicate", S),
])
CATALOG_CONSTRAINTS = T.StructType([
    T.StructField("table_name", S),
    T.StructField("constraint_name", S),
    T.StructField("kind", S),
    T.StructField("column_names", T.ArrayType(S)),
    T.StructField("definition", S),
])

# Plan-run log (H2 / K4).
PLAN_RUNS = T.StructType([
    T.StructField("run_id", L),
    T.StructField("query_text", S),
    T.StructField("query_hash", S),
    T.StructField("git_ref", S),
    T.StructField("recorded_at", T.TimestampType()),
    T.StructField("execution_time_ms", D),
    T.StructField("plan_json", S),
])
