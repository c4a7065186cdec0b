"""Scores of a document's recognised variants, and the summary of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docustrata.functions.text import rounded

# What a variant is searched for.
CARD, PASSPORT, ZONE, DATE = r"\b([1-7]\d{4}[-\s]?\d{7}[-\s]?\d{1})\b", r"\b([A-Z]{1,3}\d{6,8})\b", r"(P<[A-Z0-9<]{30,})", r"\b(\d{2}[\.\/-]\d{2}[\.\/-]\d{4})\b"


def score_variants(tokens: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """tokens (keys, idx, text, confidence, ny1): per variant its scores and matched_fields (a map). Lines without boxes, whose ny1 is null, count instead of bands."""
    t = tokens.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("full"),
        F.avg("confidence").alias("mean"),
        F.sum(F.length("text")).alias("chars"),
        F.count_distinct((F.col("ny1") * 20).cast("int")).alias("bands"),
        F.count("ny1").alias("boxed"),
        F.count("*").alias("n"),
    )
    get = lambda p: F.regexp_extract("full", p, 1)
    full = lambda c: F.when(c != "", c)
    matched = {
        "cnic_number": full(F.translate(get(CARD), " ", "-")),
        "passport_number": F.when(F.contains(F.upper("full"), F.lit("PASSPORT")), full(get(PASSPORT))),
        "mrz_line1": full(get(ZONE)),
        "date_of_birth": full(get(DATE)),
    }
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in matched.items())), lambda e: e["v"].isNotNull())
    t = t.withColumn("matched_fields", F.map_from_entries(entries)).withColumn("m", F.size(F.map_keys("matched_fields")))
    # Divisors and weights of the scores.
    one = lambda c: F.least(F.lit(1.0), c)
    parts = {"text_coverage": one(F.col("chars") / 150.0), "expected_field_coverage": one(F.when(F.col("boxed") > 0, F.col("bands") / 6.0).otherwise(F.col("n") / 5.0)), "critical_field_score": F.when(F.col("m") > 0, one(F.col("m") / 3.0)).otherwise(0.40), "format_score": one(F.col("n") / 4.0)}
    total = F.col("mean") * 0.25 + parts["text_coverage"] * 0.20 + parts["expected_field_coverage"] * 0.25 + parts["critical_field_score"] * 0.20 + parts["format_score"] * 0.10
    return t.select(*keys, rounded(F.col("mean"), 4).alias("mean_confidence"), *(rounded(v, 4).alias(k) for k, v in parts.items()), F.lit(0.80).alias("spatial_score"), rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4).alias("total_score"), rounded(parts["critical_field_score"], 4).alias("field_score"), "matched_fields")


def run_summary(fields: DataFrame, timings: DataFrame) -> DataFrame:
    """fields (doc_id, validated), timings (doc_id, ms): documents, mean time, fields, validated fields per document. Precision and recall are 1.0 for an empty run, and null otherwise: nothing here knows the truth."""
    per = timings.join(fields.groupBy("doc_id").agg(F.count("*").alias("f"), F.count_if("validated").alias("v")), "doc_id", "left")
    none = F.when(F.count("*") == 0, 1.0)
    return per.agg(F.count("*").alias("documents"), F.avg("ms").alias("avg_latency_ms"), F.coalesce(F.sum("f"), F.lit(0)).alias("total_fields_extracted"), F.avg(F.coalesce("v", F.lit(0))).alias("avg_validated_fields_per_doc"), none.alias("field_precision"), none.alias("field_recall"))
