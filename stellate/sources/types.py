"""Column types: one map from declared SQL types to Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SQL_TYPES = {
    "BOOLEAN": T.BooleanType(),
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "VECTOR": T.ArrayType(T.FloatType()),
    "JSON": T.VariantType(),
}
WIDTHS = {"BOOLEAN": 1, "TINYINT": 1, "SMALLINT": 2, "INTEGER": 4, "BIGINT": 8, "FLOAT": 4, "DOUBLE": 8}


def width(sql_type: str, dim: int = 0) -> int:
    """Bytes of a fixed-width value; 0 for unknown and variable types."""
    return 4 * dim if sql_type == "VECTOR" else WIDTHS.get(sql_type, 0)


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    dim: int | None = None

    def field(self) -> T.StructField:
        if self.type not in SQL_TYPES:
            raise ValueError(f"unknown type {self.type!r}")
        meta = {"sql": self.type} | ({"dim": self.dim} if self.dim else {})
        return T.StructField(self.name, SQL_TYPES[self.type], True, meta)


def schema_of(columns: list[Column]) -> T.StructType:
    return T.StructType([c.field() for c in columns])
