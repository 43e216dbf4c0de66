"""Schemas written as text without a running session."""
from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def struct(text: str) -> T.StructType:
    """`name type, name type` as a StructType."""
    fields = (part.split(" ", 1) for part in text.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])
