"""Nested cells: dotted columns and JSON text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import exprs as X


def flatten(df: DataFrame) -> DataFrame:
    """Structs at any depth become dotted columns; arrays and maps stay whole."""
    out: list[Column] = []

    def walk(c: Column, name: str, data_type: T.DataType) -> None:
        if isinstance(data_type, T.StructType) and data_type.fields:
            for f in data_type.fields:
                walk(c.getField(f.name), f"{name}.{f.name}", f.dataType)
        else:
            out.append(c.alias(name))

    for f in df.schema.fields:
        walk(X.ref(f.name), f.name, f.dataType)
    return df.select(*out)


def nested_to_json(df: DataFrame) -> DataFrame:
    """Struct, array and map cells as JSON text with sorted keys and spaced separators.

    A key that other records have and this one lacks is written as null: after
    Spark has merged the schemas, the two cannot be told apart.
    """
    return df.select(
        *[
            (json_text(X.ref(f.name), f.dataType) if _is_nested(f.dataType) else X.ref(f.name))
            .alias(f.name)
            for f in df.schema.fields
        ]
    )


def json_text(c: Column, data_type: T.DataType) -> Column:
    """One value as JSON text; null for a null value."""
    if isinstance(data_type, T.StructType):
        members = [
            F.concat(F.lit(f"{_quoted(f.name)}: "), _or_null(c.getField(f.name), f.dataType))
            for f in sorted(data_type.fields, key=lambda f: f.name)
        ]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
        return F.when(c.isNotNull(), body)
    if isinstance(data_type, T.ArrayType):
        elements = F.transform(c, lambda e: _or_null(e, data_type.elementType))
        return F.concat(F.lit("["), F.array_join(elements, ", "), F.lit("]"))
    if isinstance(data_type, T.MapType):
        entries = F.array_sort(F.map_entries(c), lambda a, b: _compare(a["key"], b["key"]))
        members = F.transform(
            entries,
            lambda e: F.concat(
                _string(X.text(e["key"])), F.lit(": "), _or_null(e["value"], data_type.valueType)
            ),
        )
        return F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}"))
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return X.text(c)
    return _string(X.text(c))


def _or_null(c: Column, data_type: T.DataType) -> Column:
    return F.coalesce(json_text(c, data_type), F.lit("null"))


def _string(c: Column) -> Column:
    """A JSON string: the one element of a JSON array without its brackets."""
    whole = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(whole, F.lit(2), F.char_length(whole) - 2))


def _quoted(name: str) -> str:
    return json.dumps(name, ensure_ascii=False)


def _compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def _is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StructType, T.ArrayType, T.MapType))
