"""Catalog listings -- columns, index keys, constraint keys.

The column listing of a DataFrame is built from its schema. Parquet columns
read as nullable, so declared nullability comes from a passed listing when
there is one. Index and constraint listings are always passed in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from checkup import schemas


def pg_type_name(dtype: T.DataType) -> str:
    """A catalog type name for a Spark type, in the style of information_schema."""
    if isinstance(dtype, T.VarcharType):
        return "character varying"
    if isinstance(dtype, T.CharType):
        return "character"
    simple = {
        T.StringType: "text", T.LongType: "bigint", T.IntegerType: "integer",
        T.ShortType: "smallint", T.ByteType: "smallint", T.DoubleType: "double precision",
        T.FloatType: "real", T.DecimalType: "numeric", T.BooleanType: "boolean",
        T.DateType: "date", T.TimestampType: "timestamp with time zone",
        T.TimestampNTZType: "timestamp without time zone", T.BinaryType: "bytea",
        T.ArrayType: "ARRAY", T.MapType: "map", T.StructType: "record",
        T.VariantType: "variant",
    }
    for cls, name in simple.items():
        if isinstance(dtype, cls):
            return name
    return dtype.simpleString()


def columns_listing(spark: SparkSession, tables: dict[str, DataFrame], schema: str = "public",
                    not_null: dict[str, list[str]] | None = None) -> DataFrame:
    """Column listing from the schemas of ``tables`` (driver-side metadata only).

    ``not_null`` names columns declared NOT NULL, per table."""
    not_null = not_null or {}
    rows = []
    for tname, df in tables.items():
        declared = set(not_null.get(tname, ()))
        for i, field in enumerate(df.schema.fields, start=1):
            rows.append((schema, tname, field.name, i, pg_type_name(field.dataType),
                         "NO" if field.name in declared else "YES", None))
    return spark.createDataFrame(rows, schemas.CATALOG_COLUMNS)


def indexes_listing(spark: SparkSession, rows) -> DataFrame:
    """rows: (table_name, index_name, [columns], is_unique, predicate)."""
    return spark.createDataFrame([tuple(r) for r in rows], schemas.CATALOG_INDEXES)


def constraints_listing(spark: SparkSession, rows) -> DataFrame:
    """rows: (table_name, constraint_name, kind p/f/u/c, [columns], definition)."""
    return spark.createDataFrame([tuple(r) for r in rows], schemas.CATALOG_CONSTRAINTS)


@dataclass
class Catalog:
    """The three listings. Index and constraint listings may be None (empty)."""

    columns: DataFrame
    indexes: DataFrame | None = None
    constraints: DataFrame | None = None

    def _spark(self) -> SparkSession:
        return self.columns.sparkSession

    def index_rows(self) -> DataFrame:
        if self.indexes is None:
            return self._spark().createDataFrame([], schemas.CATALOG_INDEXES)
        return self.indexes

    def constraint_rows(self) -> DataFrame:
        if self.constraints is None:
            return self._spark().createDataFrame([], schemas.CATALOG_CONSTRAINTS)
        return self.constraints
