"""Field configuration: which fields a document has, where they stand and how they are checked.

It is a small table (a row for each field), made on the driver from literals or
from YAML files, and broadcast. Changes are row operations on it.
"""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.functions.text import label_default, rounded
from docustrata.session import told

SCHEMA = (
    "doc_type string, field string, field_ord int, label string, language string, script string, strategy string, profile string, normalization string, validator string,"
    " rx1 double, ry1 double, rx2 double, ry2 double, margin double, containment string, minimum_overlap double, keyword string, direction string, max_distance double, vertical_tolerance double, critical boolean"
)
COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]

# The fields of each document type. Field, strategy, profile, normalisation, validator, region, anchor, direction.
FIELDS = {
    "cnic_front": (
        ("name_en", "hybrid", "standard", "uppercase", "text_non_empty", (0.20, 0.28, 0.85, 0.38), "Name", "right"),
        ("name_ur", "region", "urdu_safe", "none", "none", (0.20, 0.20, 0.85, 0.30), None, None),
        ("father_name_en", "hybrid", "standard", "uppercase", "text_non_empty", (0.20, 0.40, 0.85, 0.50), "Father Name", "right"),
        ("father_name_ur", "region", "urdu_safe", "none", "none", (0.20, 0.32, 0.85, 0.42), None, None),
        ("cnic_number", "hybrid", "numeric", "cnic", "cnic_number", (0.20, 0.52, 0.85, 0.65), "Identity Number", "right"),
        ("date_of_birth", "hybrid", "date", "date", "date", (0.20, 0.64, 0.55, 0.78), "Date of Birth", "right"),
        ("date_of_issue", "hybrid", "date", "date", "date", (0.20, 0.74, 0.55, 0.88), "Date of Issue", "right"),
        ("date_of_expiry", "hybrid", "date", "date", "date", (0.52, 0.74, 0.92, 0.88), "Date of Expiry", "right"),
    ),
    "cnic_back": (
        ("family_number", "hybrid", "numeric", "digits_only", "text_non_empty", (0.10, 0.10, 0.60, 0.30), "Family No", "right"),
        ("address_ur", "region", "urdu_safe", "none", "none", (0.10, 0.30, 0.95, 0.85), None, None),
    ),
    "passport": (
        ("passport_number", "hybrid", "passport_number", "passport_number", "passport_number", (0.60, 0.05, 0.95, 0.15), "Passport Number", "right"),
        ("surname", "hybrid", "standard", "uppercase", "text_non_empty", (0.30, 0.12, 0.65, 0.20), "Surname", "below"),
        ("given_names", "hybrid", "standard", "uppercase", "text_non_empty", (0.30, 0.18, 0.65, 0.27), "Given Names", "below"),
        ("father_name", "hybrid", "standard", "father_name_invert", "text_non_empty", (0.30, 0.40, 0.70, 0.50), "Father Name", "below"),
        ("date_of_birth", "hybrid", "date", "date", "date", (0.30, 0.27, 0.60, 0.36), "Date of Birth", "below"),
        ("date_of_issue", "hybrid", "date", "date", "date", (0.30, 0.45, 0.60, 0.54), "Date of Issue", "below"),
        ("date_of_expiry", "hybrid", "date", "date", "date", (0.30, 0.52, 0.60, 0.62), "Date of Expiry", "below"),
        ("cnic_number", "hybrid", "numeric", "cnic", "cnic_number", (0.60, 0.28, 0.95, 0.38), "Citizen Number", "right"),
    ),
}


def rows() -> list[tuple]:
    out = []
    for kind, fields in FIELDS.items():
        for i, (name, strategy, profile, norm, check, region, keyword, direction) in enumerate(fields):
            urdu = name.endswith("_ur")
            out.append((kind, name, i, name.replace("_", " ").title(), "ur" if urdu else "en", "urdu" if urdu else "latin", strategy, profile, norm, check, *region, 0.02, "center", 0.5, keyword, direction, 500.0, 50.0, False))
    return out


def field_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)


def from_mapping(doc_type: str, config: dict[str, Any]) -> list[tuple]:
    """Rows of one configuration, as YAML holds it; absent keys take the defaults of parsing."""
    out = []
    for i, (name, f) in enumerate((config.get("fields") or {}).items()):
        f, region, anchor = f or {}, (f or {}).get("region") or {}, (f or {}).get("anchor") or {}
        if isinstance(region, (list, tuple)):
            region = dict(zip(("x1", "y1", "x2", "y2"), region, strict=False))
        box = [float(region[k]) if k in region else None for k in ("x1", "y1", "x2", "y2")]
        out.append(
            (doc_type, name, i, f.get("label") or name.replace("_", " ").title(), f.get("language", "en"), f.get("script", "latin"), f.get("strategy", "region"), f.get("profile", "standard"), f.get("normalization", "none"), f.get("validator", "none"), *box,
             float(region.get("margin", 0.02)), region.get("containment", "center"), float(region.get("minimum_overlap", 0.5)), anchor.get("keyword") or anchor.get("text"), anchor.get("direction"), float(anchor.get("max_distance", 500)), float(anchor.get("vertical_tolerance", 50)), bool(f.get("critical", False)))
        )
    return out


def read_yaml(spark: SparkSession, folder: str, only: str | None = None) -> DataFrame:
    """The configurations in a folder's top level, on the driver; one that can't be read has no fields, an absent one neither."""
    import yaml

    found: list[tuple] = []
    for path in sorted(Path(folder).iterdir() if Path(folder).is_dir() else []):
        if path.suffix not in (".yaml", ".yml") or (only and path.stem != only.removesuffix(".yaml").removesuffix(".yml")):
            continue
        try:
            made = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
            found += from_mapping(made.get("document_type", path.stem), made)
        except (yaml.YAMLError, AttributeError, TypeError, ValueError):
            continue
    return spark.createDataFrame(found, SCHEMA)


def write_yaml(config: DataFrame, folder: str) -> None:
    """One file for each document type; all keys that a row holds are written."""
    import yaml

    Path(folder).mkdir(parents=True, exist_ok=True)
    by: dict[str, dict] = {}
    for r in config.orderBy("doc_type", "field_ord").collect():  # a row for each field
        f: dict[str, Any] = {"label": r.label, "language": r.language, "script": r.script, "strategy": r.strategy, "profile": r.profile, "normalization": r.normalization, "validator": r.validator}
        if r.rx1 is not None:
            f["region"] = {"x1": r.rx1, "y1": r.ry1, "x2": r.rx2, "y2": r.ry2, "margin": r.margin, "containment": r.containment, "minimum_overlap": r.minimum_overlap}
        if r.keyword:
            f["anchor"] = {"keyword": r.keyword, "direction": r.direction, "max_distance": r.max_distance, "vertical_tolerance": r.vertical_tolerance}
        by.setdefault(r.doc_type, {"document_type": r.doc_type, "language": "en", "fields": {}})["fields"][r.field] = f
    for kind, made in by.items():
        (Path(folder) / f"{kind}.yaml").write_text(yaml.safe_dump(made, allow_unicode=True, sort_keys=False), encoding="utf-8")


def create(config: DataFrame, doc_type: str) -> DataFrame:
    """A document type starts anew, without fields."""
    return config.where(F.col("doc_type") != doc_type)


def upsert(config: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: doc_type, field and any other columns of a configuration. What a change doesn't name stays; regions are rounded to three places."""
    extra = [c for c in changes.columns if c not in ("doc_type", "field")]
    marked = changes.select("doc_type", "field", *(F.col(c).alias(f"__{c}") for c in extra), F.lit(True).alias("__there"))
    kinds = dict(config.dtypes)
    out = config.join(told(marked), ["doc_type", "field"], "full_outer")
    last = config.groupBy("doc_type").agg((F.max("field_ord") + 1).alias("__next"))
    out = out.join(told(last), "doc_type", "left")
    default = {"field_ord": F.coalesce("__next", F.lit(0)), "label": label_default(F.col("field")), "language": F.lit("en"), "script": F.lit("latin"), "strategy": F.lit("region"), "profile": F.lit("standard"), "normalization": F.lit("none"), "validator": F.lit("none"), "margin": F.lit(0.02), "containment": F.lit("center"), "minimum_overlap": F.lit(0.5), "max_distance": F.lit(500.0), "vertical_tolerance": F.lit(50.0), "critical": F.lit(False)}

    def value(c: str) -> F.Column:
        new = F.col(f"__{c}").cast(kinds[c]) if c in extra else F.lit(None).cast(kinds[c])
        if c in ("rx1", "ry1", "rx2", "ry2"):
            new = rounded(new, 3)
        return F.coalesce(new, F.col(c), default.get(c, F.lit(None)).cast(kinds[c])).alias(c)

    return out.select("doc_type", "field", *(value(c) for c in config.columns if c not in ("doc_type", "field"))).select(*config.columns)


def delete(config: DataFrame, doc_type: str, field: str) -> DataFrame:
    return config.where(~((F.col("doc_type") == doc_type) & (F.col("field") == field)))
