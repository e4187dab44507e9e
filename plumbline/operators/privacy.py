"""Redaction of personal data in text, columns and nested cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import constants as k
from plumbline.functions import exprs as X
from plumbline.functions import names


def _replace(c: Column, pattern: str, mask: str) -> Column:
    return F.regexp_replace(c, "(?U)" + pattern, mask)


def redact_email(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), _replace(c, k.PII_EMAIL, k.MASK_EMAIL)).otherwise(c)


def redact_ssn(c: Column) -> Column:
    return _replace(c, k.PII_SSN, k.MASK_SSN)


def redact_card(c: Column) -> Column:
    return _replace(c, k.PII_CARD, k.MASK_CARD)


def redact_phone(c: Column) -> Column:
    return _replace(c, k.PII_PHONE, k.MASK_PHONE)


def redact_text(c: Column) -> Column:
    """E-mail, then SSN, card and phone; most specific first.

    All numeric patterns need four digits in a row, so text without them skips
    three scans.
    """
    c = redact_email(c)
    return F.when(c.rlike(r"(?U)\d{4}"), redact_phone(redact_card(redact_ssn(c)))).otherwise(c)


def mask_secret(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(k.MASK_SECRET))


def redact_cell(c: Column, data_type: T.DataType, name: str) -> Column:
    """One cell by value and by column name; struct fields and map keys count as names.

    Numbers and booleans stay; arrays keep their column's name; other types
    become text. Map values become text because a secret key masks its value.
    """
    if names.is_secret(name):
        return mask_secret(c)
    if isinstance(data_type, T.StringType):
        return redact_text(c)
    if isinstance(data_type, (T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType)):
        return c
    if isinstance(data_type, T.ArrayType):
        return F.transform(c, lambda e: redact_cell(e, data_type.elementType, name))
    if isinstance(data_type, T.StructType):
        fields = [
            redact_cell(c.getField(f.name), f.dataType, f.name).alias(f.name)
            for f in data_type.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(data_type, T.MapType):
        scalar = not isinstance(data_type.valueType, (T.ArrayType, T.StructType, T.MapType))

        def masked(key: Column, value: Column) -> Column:
            out = redact_cell(value, data_type.valueType, "")
            out = X.text(out) if scalar else F.to_json(out)
            secret = X.contains_any(F.lower(X.text(key)), k.SECRET_WORDS)
            return F.when(secret & value.isNotNull(), F.lit(k.MASK_SECRET)).otherwise(out)

        return F.transform_values(c, masked)
    return X.text(c)


def redact_table(df: DataFrame) -> DataFrame:
    """Every cell of the table, in one projection."""
    return df.select(
        *[redact_cell(X.ref(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields]
    )
