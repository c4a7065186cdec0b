"""Sinks: results as JSON, tokens as tables, overlays as draw commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docustrata.functions.redact import sanitize


def result_json(fields: DataFrame, review: DataFrame, redacted: bool = False) -> DataFrame:
    """doc_id and one JSON text: fields by name, review state and reasons."""
    f = sanitize(fields) if redacted else fields
    entry = F.struct("value", "raw_value", "confidence", "validated")
    per = f.groupBy("doc_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("field_ord", "field", entry.alias("e")))), lambda x: F.struct(x["field"], x["e"]))).alias("fields"))
    return per.join(review, "doc_id").select("doc_id", F.to_json(F.struct("fields", "review_state", "review_reasons")).alias("json"))


def write_json(results: DataFrame, path: str) -> None:
    results.select("json").write.mode("overwrite").text(path)


def write_tokens(tokens: DataFrame, path: str, form: str = "parquet") -> None:
    tokens.write.mode("overwrite").format(form).save(path)


def draw_commands(tokens: DataFrame, fields: DataFrame, review: DataFrame) -> DataFrame:
    """What an overlay shows: doc_id, layer, box, colour, label. Tokens green; fields green if valid, else orange, with their
    value's first 25 characters and confidence; a banner in the colour of the review state."""
    box = lambda *c: [x.cast("double").alias(n) for x, n in zip(c, ("x1", "y1", "x2", "y2"), strict=True)]
    t = tokens.select("doc_id", F.lit("token").alias("layer"), *box(*map(F.col, ("x1", "y1", "x2", "y2"))), F.lit("green").alias("color"), F.lit(None).cast("string").alias("label"))
    percent = (F.col("confidence") * 100).cast("int").cast("string")
    label = F.concat(F.when(F.col("validated"), "[V] ").otherwise("[?] "), F.col("field"), F.lit(": "), F.substring("value", 1, 25), F.lit(" ("), percent, F.lit("%)"))
    at = [F.get("bbox", F.lit(i)) for i in range(4)]
    f = fields.where(F.element_at("bbox", 3) > 0).select("doc_id", F.lit("field").alias("layer"), *box(*at), F.when(F.col("validated"), "green").otherwise("orange").alias("color"), label.alias("label"))
    zero: Column = F.lit(0.0)
    banner = F.when(F.col("review_state") == "AUTO_ACCEPT", "green").when(F.col("review_state") == "AUTO_REJECT", "red").otherwise("orange")
    b = review.select("doc_id", F.lit("banner").alias("layer"), *box(zero, zero, zero, zero), banner.alias("color"), F.col("review_state").alias("label"))
    return t.unionByName(f).unionByName(b)
