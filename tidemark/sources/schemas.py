"""Registered schema documents as Spark schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F, types as T

_PRIMITIVES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "bytes": T.BinaryType(), "null": T.NullType(),
}
_LOGICAL = {
    "timestamp-millis": T.TimestampType(), "timestamp-micros": T.TimestampType(), "date": T.DateType(),
    "uuid": T.StringType(),
}


def _type(declared) -> tuple[T.DataType, bool]:
    """(Spark type, nullable) of a declared type."""
    if isinstance(declared, str):
        return _PRIMITIVES[declared], declared == "null"
    if isinstance(declared, list):
        branches = [b for b in declared if b != "null"]
        if len(branches) != 1:
            raise ValueError(f"only unions of null and one type are supported: {declared}")
        return _type(branches[0])[0], "null" in declared
    logical = declared.get("logicalType")
    if logical == "decimal":
        return T.DecimalType(declared["precision"], declared.get("scale", 0)), False
    if logical in _LOGICAL:
        return _LOGICAL[logical], False
    kind = declared["type"]
    if kind == "record":
        return T.StructType([_field(f) for f in declared["fields"]]), False
    if kind == "array":
        return T.ArrayType(*_type(declared["items"])), False
    if kind == "map":
        return T.MapType(T.StringType(), *_type(declared["values"])), False
    if kind in ("enum", "fixed"):
        return (T.StringType() if kind == "enum" else T.BinaryType()), False
    return _type(kind)


def _logical_name(declared) -> str | None:
    branches = declared if isinstance(declared, list) else [declared]
    return next((b["logicalType"] for b in branches if isinstance(b, dict) and "logicalType" in b), None)


def _field(declared: dict) -> T.StructField:
    kind, nullable = _type(declared["type"])
    metadata: dict = {}
    logical = _logical_name(declared["type"])
    if logical in _LOGICAL:
        metadata["wire"] = logical
    if "default" not in declared and not nullable:
        metadata["required"] = True
    if declared.get("doc") == "PII":
        metadata["pii"] = True
    if "default" in declared and declared["default"] is not None:
        metadata["default"] = json.dumps(declared["default"])
    branches = declared["type"] if isinstance(declared["type"], list) else [declared["type"]]
    for branch in branches:
        if isinstance(branch, dict) and "symbols" in branch:
            metadata["symbols"] = branch["symbols"]
    return T.StructField(declared["name"], kind, nullable, metadata)


def schema_from_avsc(text: str) -> T.StructType:
    """Spark schema of an Avro record document; PII tags, defaults and symbols go to field metadata."""
    document = json.loads(text)
    if document.get("type") != "record":
        raise ValueError("schema must be a record")
    return T.StructType([_field(f) for f in document["fields"]])


def with_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fill nulls of fields whose schema declares a default."""
    filled = {
        f.name: F.coalesce(F.col(f.name), F.lit(json.loads(f.metadata["default"])).cast(f.dataType))
        for f in schema.fields if "default" in f.metadata and f.name in df.columns
    }
    return df.withColumns(filled) if filled else df


def pii_fields(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if f.metadata.get("pii")]
