"""Whole tasks as functions of tables: extract, classify, assess, and their configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docustrata.functions.scoring import calibrated  # noqa: F401  part of the public surface
from docustrata.operators import parse, pixels, reconcile
from docustrata.operators.classify import classified
from docustrata.sources.field_config import create, delete, field_config, read_yaml, upsert, write_yaml  # noqa: F401
from docustrata.sources.tokens import documents

# Versions of the audit trail.
VERSIONS = {"pipeline": "2.5.0", "config": "v3.0", "parser": "2.1.0"}


def classify(tokens: DataFrame, document_type: str = "auto") -> DataFrame:
    """doc_id, document_type, class_confidence, method."""
    explicit = None if document_type == "auto" else F.lit(document_type)
    d = documents(tokens).select("doc_id", classified(F.col("raw_text"), explicit).alias("c"))
    return d.select("doc_id", F.col("c.document_type").alias("document_type"), F.col("c.confidence").alias("class_confidence"), F.col("c.method").alias("method"))


def routed(document_type: F.Column) -> F.Column:
    """The parser of a type: passport, back, else front."""
    return reconcile.schema_of(document_type)


def extract(tokens: DataFrame, document_type: str = "auto", config: DataFrame | None = None, crop_tokens: DataFrame | None = None, crops: DataFrame | None = None) -> dict[str, DataFrame]:
    """fields, reconciled, result and review of documents that may be of several types at once.

    tokens are of one variant of each page. crop_tokens and crops, if given, are a second pass over the crops of single
    fields (see parse.second_pass). Back sides have their parsed fields passed through: the schema of reconciliation holds none of them.
    """
    spark = tokens.sparkSession
    config = config if config is not None else field_config(spark)
    classes = classify(tokens, document_type)
    typed = tokens.drop("doc_type").join(classes.select("doc_id", routed(F.col("document_type")).alias("doc_type")), "doc_id")
    cards = parse.parse_cards(typed.where("doc_type <> 'passport'"), config)
    passports = typed.where("doc_type = 'passport'")
    fields = cards.unionByName(parse.parse_passports(passports, config))
    if crops is not None and crop_tokens is not None:
        types = typed.select("doc_id", "doc_type").distinct()

        def parsed(moved: DataFrame) -> DataFrame:
            return parse.parse_cards(moved.where("doc_type <> 'passport'"), config).unionByName(parse.parse_passports(moved.where("doc_type = 'passport'"), config))

        fields = parse.second_pass(fields, crop_tokens.drop("doc_type").join(types, "doc_id"), crops, parsed)
    docs = typed.select("doc_id", F.col("doc_type").alias("document_type")).distinct()
    final = reconcile.reconcile(docs, fields, reconcile.zone_map(parse.zone_candidates(passports)), typed)
    result = reconcile.document_result(final)
    review = reconcile.review(fields, classes.select("doc_id", "class_confidence")).join(result.select("doc_id", "review_required"), "doc_id", "left")
    state = reconcile.demoted(F.col("review_state"), F.coalesce("review_required", F.lit(False)))
    audit = F.struct(*(F.lit(v).alias(k) for k, v in VERSIONS.items()))
    return {"fields": fields, "reconciled": final, "result": result, "review": review.select("doc_id", state.alias("review_state"), "review_reasons", audit.alias("audit"))}


def assess(px: DataFrame, mode: str = "balanced") -> DataFrame:
    """Quality and plan of images of a pixel relation."""
    q = pixels.quality(px)
    return q.join(pixels.plan(q, mode=mode).drop("contrast_step"), "img_id")
