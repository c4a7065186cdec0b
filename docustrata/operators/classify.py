"""Document classification by keywords and layout signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docustrata.functions.text import rounded

# Keywords of each kind, and a card number.
PASSPORT = ("PASSPORT", "ISLAMIC REPUBLIC OF PAKISTAN", "P<PAK", "SURNAME", "GIVEN NAMES", "NATIONALITY")
FRONT = ("NATIONAL IDENTITY CARD", "ISLAMIC REPUBLIC OF PAKISTAN", "NAME", "FATHER NAME", "IDENTITY NUMBER")
BACK = ("FAMILY NUMBER", "ADDRESS", "REGISTRAR GENERAL")
NUMBER = r"\b[1-7]\d{4}[-\s]?\d{7}[-\s]?\d{1}\b"
EXPLICIT = ("cnic_front", "cnic_back", "passport")


def classified(text: Column, explicit: Column | None = None) -> Column:
    """struct(document_type, confidence, method) of a document's joined text."""
    up = F.upper(text)
    count = lambda words: sum((F.contains(up, F.lit(w)).cast("int") for w in words[1:]), F.contains(up, F.lit(words[0])).cast("int"))
    number, arabic = up.rlike(NUMBER), up.rlike(r"[\x{0600}-\x{06FF}]")
    p, f, b = count(PASSPORT), count(FRONT), count(BACK)
    row = lambda kind, conf, how: F.struct(F.lit(kind).alias("document_type"), rounded(conf, 4).alias("confidence"), F.lit(how).alias("method"))
    out = (
        F.when((p >= 2) | F.contains(up, F.lit("P<PAK")), row("passport", F.least(F.lit(0.98), p * 0.15 + 0.5), "keyword_mrz_signature"))
        .when((f >= 2) | (number & arabic), row("cnic_front", F.least(F.lit(0.98), f * 0.15 + 0.4 + F.when(number, 0.2).otherwise(0.0)), "keyword_bilingual_signature"))
        .when((b >= 1) | (F.contains(up, F.lit("FAMILY")) & arabic), row("cnic_back", F.lit(0.85), "keyword_signature"))
        .otherwise(row("unknown", F.lit(0.30), "fallback_unknown"))
    )
    if explicit is None:
        return out
    named = F.trim(explicit)
    return F.when(named.isin(*EXPLICIT), F.struct(named.alias("document_type"), F.lit(1.0).alias("confidence"), F.lit("explicit_override").alias("method"))).otherwise(out)
