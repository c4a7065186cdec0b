"""Redaction and masking of personal identifiers."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is redacted, in this order, and the keys whose values are.
PATTERNS = (
    (r"\b\d{5}[-\s]?\d{7}[-\s]?\d{1}\b", "[REDACTED_CNIC]"),
    (r"(?i)\b[A-Z]{1,3}\d{6,8}\b", "[REDACTED_PASSPORT]"),
    (r"\b\d{2}[\.\/\-]\d{2}[\.\/\-]\d{4}\b", "[REDACTED_DATE]"),
)
SENSITIVE = ("cnic_number", "passport_number", "father_name", "surname", "given_names", "name", "raw_text", "raw_value", "date_of_birth")
CARD, PASSPORT = r"\b([1-7]\d{4})[-.\s]?(\d{7})[-.\s]?(\d{1})\b", r"\b([A-Z]{2})\d{7}\b"


def redact_text(c: Column, bypass: bool = False) -> Column:
    if bypass:
        return c
    for pattern, mark in PATTERNS:
        c = F.regexp_replace(c, pattern, mark.replace("$", r"\$"))
    return c


def mask_card(c: Column) -> Column:
    return F.regexp_replace(c, CARD, r"*****-*******-$3")


def mask_passport(c: Column) -> Column:
    return F.regexp_replace(c, PASSPORT, r"$1*******")


def mask(c: Column) -> Column:
    return mask_passport(mask_card(c))


def _leaf(c: Column, kind: T.DataType) -> Column:
    """A value of a group under a sensitive key: as text, redacted."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_leaf(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return redact_text(c if isinstance(kind, T.StringType) else c.cast("string"))


def _clean(c: Column, kind: T.DataType, sensitive: bool) -> Column:
    named = isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType)
    if sensitive:
        if isinstance(kind, T.StringType):
            return redact_text(c)
        if isinstance(kind, T.StructType):
            return _leaf(c, kind)
        if named:
            return F.transform_values(c, lambda _, v: _leaf(v, kind.valueType))
        return F.when(c.isNotNull(), F.lit("[REDACTED_PII]"))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_clean(c[f.name], f.dataType, f.name in SENSITIVE).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        item = kind.elementType
        if isinstance(item, (T.StructType, T.ArrayType, T.MapType)):
            return F.transform(c, lambda x: _clean(x, item, False))
        return F.transform(c, lambda x: redact_text(x.cast("string")))
    if named and isinstance(kind.valueType, T.StringType):
        return F.transform_values(c, lambda k, v: F.when(k.isin(*SENSITIVE), redact_text(v)).otherwise(v))
    if named and not isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform_values(c, lambda k, v: F.when(k.isin(*SENSITIVE) & v.isNotNull(), F.lit("[REDACTED_PII]")).otherwise(v.cast("string")))
    if named:
        return F.transform_values(c, lambda k, v: F.when(k.isin(*SENSITIVE), F.to_json(_leaf(v, kind.valueType)) if isinstance(kind.valueType, T.StructType) else F.lit("[REDACTED_PII]")).otherwise(F.to_json(_clean(v, kind.valueType, False))))
    return c


def sanitize(df: DataFrame) -> DataFrame:
    """The table as it may be logged. Under a sensitive key, at any depth, a text is redacted, a group has its values redacted
    as texts, and anything else, lists too, becomes a mark. Under other keys groups are looked into, the items of lists are
    redacted as texts, and the rest is left. Nulls stay. Values of a map that could be either are written as JSON.

    A text without an identifier, such as a name, stays readable.
    """
    return df.select(*(_clean(F.col(f"`{f.name}`"), f.dataType, f.name in SENSITIVE).alias(f.name) for f in df.schema.fields))


class MaskFilter(logging.Filter):
    """Masks card and passport numbers in the messages of a logger."""

    def filter(self, record: logging.LogRecord) -> bool:
        if isinstance(record.msg, str):
            record.msg = re.sub(PASSPORT, r"\1*******", re.sub(CARD, r"*****-*******-\3", record.msg))
        return True
