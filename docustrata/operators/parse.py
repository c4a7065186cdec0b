"""Parsers: tokens to fields, for cards and passports.

Every configured field gives a row for every document, with or without tokens.
Tokens are dealt by document once, into one row for each document; all that follows
is arithmetic on that row and on the fields of one document, and moves nothing.
A passport's fields stay in that row, as its passes go from one field to another.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docustrata.functions import mrz, scoring, text, validators
from docustrata.operators import spatial
from docustrata.session import TOLD
from docustrata.sources.tokens import enriched, reprojected

PASSPORT_FIELDS = ("passport_number", "surname", "given_names", "father_name", "date_of_birth", "date_of_issue", "date_of_expiry", "cnic_number")


def provenance(tokens: Column) -> dict[str, Column]:
    """Of a field's tokens: indices, united boxes, spatial and field confidence, mean confidence of recognition."""
    n, only = F.size(tokens), F.get(tokens, F.lit(0))
    # most fields have one token, which needs no lambda
    mean = F.when(n < 2, only["confidence"]).otherwise(F.aggregate(tokens, F.lit(0.0), lambda a, t: a + t["confidence"]) / F.greatest(n, F.lit(1)))
    spatial_conf = F.least(F.lit(1.0), F.lit(0.30) / F.greatest(n, F.lit(1)) + 0.70)
    side = lambda name, pick: F.coalesce(F.when(n < 2, only[name]).otherwise(pick(F.transform(tokens, lambda t: t[name]))), F.lit(0.0))
    box = lambda a, b, c, d: F.array(side(a, F.array_min), side(b, F.array_min), side(c, F.array_max), side(d, F.array_max))
    return {
        "token_indices": F.transform(tokens, lambda t: t["idx"]),
        "bbox": box("x1", "y1", "x2", "y2"),
        "bbox_norm": box("nx1", "ny1", "nx2", "ny2"),
        "ocr_confidence": F.when(n > 0, text.rounded(mean, 4)).otherwise(0.0),
        "spatial_confidence": F.when(n > 0, text.rounded(spatial_conf, 4)).otherwise(0.0),
        "confidence": F.when(n > 0, text.rounded(mean * 0.5 + spatial_conf * 0.3 + 0.2, 4)).otherwise(0.0),
    }


def located(pages: DataFrame, config: DataFrame) -> DataFrame:
    """pages by configured field: the configuration's columns, region and anchor, the tokens in the field's region and beside its label."""
    both = spatial.labelled(pages, config)
    region = spatial.within(F.col("page"), spatial.cols(spatial.REGION), F.col("containment"), F.col("minimum_overlap"))
    return both.withColumns({"region": region, "anchor": spatial.beside(F.col("page"), F.col("label"), F.col("direction"))}).drop("label", "page")


def first_of(one: str, two: str) -> Column:
    """The first list, or the second one where that is empty."""
    return F.when(F.size(one) > 0, F.col(one)).otherwise(F.col(two))


def parsed(tokens: Column, raw: Column, value: Column, valid: Column) -> dict[str, Column]:
    """What is told of a field: texts, validation and provenance of its tokens."""
    parts = {k: F.coalesce(v, F.lit(0.0)) if k.endswith("confidence") else v for k, v in provenance(tokens).items()}
    return {"raw_value": raw, "value": value, "validated": valid, "validation_errors": F.when(valid, F.array().cast("array<string>")).otherwise(F.array(F.lit("invalid_format"))), **parts}


def fields_of(picked: DataFrame, family: str) -> DataFrame:
    """picked: doc_id, doc_type, the configuration's columns and the tokens of each field, in reading order."""
    raw = F.array_join(F.transform("tokens", lambda t: t["text"]), " ")
    out = picked.withColumn("raw_value", F.coalesce(raw, F.lit("")))
    out = out.withColumn("value", text.normalized(F.col("raw_value"), F.col("normalization"))).withColumn("validated", validators.validated(F.col("value"), F.col("validator"), family))
    every = parsed(F.col("tokens"), F.col("raw_value"), F.col("value"), F.col("validated"))
    return out.select("doc_id", "doc_type", "field", "field_ord", "strategy", "language", "script", *(c.alias(k) for k, c in every.items()))


def parse_cards(tokens: DataFrame, config: DataFrame) -> DataFrame:
    """A row for each document and configured field: tokens of its region, and of its anchor where the region is empty or the strategy says so."""
    got = located(spatial.pages(tokens), config)
    pick = F.when(F.col("strategy") == "anchor", first_of("anchor", "region")).otherwise(first_of("region", "anchor"))
    return fields_of(got.withColumn("tokens", spatial.reading_order(pick)).drop("region", "anchor"), "card")


def bilingual(fields: DataFrame) -> DataFrame:
    """doc_id, name, father_name: each a struct(en, ur), null if both are empty."""
    one = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, F.col("value"))), F.lit(""))
    falling = lambda a, b: F.when(a != "", a).otherwise(b)
    row = fields.groupBy("doc_id").agg(*(one(f).alias(f) for f in ("name", "name_en", "name_ur", "father_name", "father_name_en", "father_name_ur")))
    pair = lambda f: F.when((falling(F.col(f"{f}_en"), F.col(f)) != "") | (F.col(f"{f}_ur") != ""), F.struct(falling(F.col(f"{f}_en"), F.col(f)).alias("en"), F.col(f"{f}_ur").alias("ur")))
    return row.select("doc_id", pair("name").alias("name"), pair("father_name").alias("father_name"))


def zones(tokens: DataFrame) -> DataFrame:
    """doc_id, line1, line2: the last token with `P<`, and the last other zone token of more than 15 characters."""
    one = F.contains("text", F.lit("P<"))
    z = tokens.where(mrz.is_zone(F.col("text")))
    return z.groupBy("doc_id").agg(F.max_by(F.when(one, F.col("text")), F.when(one, F.col("idx"))).alias("line1"), F.max_by(F.when(~one & (F.length("text") > 15), F.col("text")), F.when(~one & (F.length("text") > 15), F.col("idx"))).alias("line2"))


def zone_candidates(tokens: DataFrame) -> DataFrame:
    """doc_id, line1, line2 as evidence takes them: the first token with `P<`, the first of 28 or more characters that doesn't begin with it."""
    t = F.col("text")
    z = tokens.where(F.contains(t, F.lit("<")) | (F.length(t) > 20))
    one, two = F.contains(t, F.lit("P<")), (F.length(t) >= 28) & ~t.startswith("P<")
    return z.groupBy("doc_id").agg(F.min_by(F.when(one, t), F.when(one, F.col("idx"))).alias("line1"), F.min_by(F.when(two, t), F.when(two, F.col("idx"))).alias("line2"))


def page_zones(page: Column) -> dict[str, Column]:
    """line1, line2 of a page's tokens, as zone_candidates takes them."""
    first = lambda keep: F.get(F.filter(page, lambda x: (F.contains(x["text"], F.lit("<")) | (F.length(x["text"]) > 20)) & keep(x["text"])), F.lit(0))["text"]
    return {"line1": first(lambda t: F.contains(t, F.lit("P<"))), "line2": first(lambda t: (F.length(t) >= 28) & ~F.startswith(t, F.lit("P<")))}


def dated(c: Column) -> Column:
    """The date of a token as DD.MM.YYYY, or null. A text without a digit has none."""
    found = text.let(text.date_text(c), lambda d: F.when(d.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), d))
    return F.when(c.rlike(r"\d"), found)


def ranked(dates: Column) -> Column:
    """Distinct dates of an array of structs (i, d) by year alone, equal years in token order."""
    once = text.let(F.sort_array(dates), lambda at: F.filter(at, lambda x, i: ~F.exists(F.slice(at, F.lit(1), i), lambda y: y["d"] == x["d"])))
    return F.transform(F.sort_array(F.transform(once, lambda x: F.struct(F.substring(x["d"], 7, 4).cast("int").alias("y"), x["i"].alias("i"), x["d"].alias("d")))), lambda x: x["d"])


def date_ranks(tokens: DataFrame) -> DataFrame:
    """doc_id, n, first, second, last: a document's distinct dates by year alone, equal years in token order."""
    d = tokens.select("doc_id", "idx", dated(F.col("text")).alias("d")).where("d is not null")
    d = d.groupBy("doc_id").agg(ranked(F.collect_list(F.struct(F.col("idx").alias("i"), "d"))).alias("o"))
    return d.select("doc_id", F.size("o").alias("n"), F.get("o", F.lit(0)).alias("first"), F.get("o", F.lit(1)).alias("second"), F.element_at("o", -1).alias("last"))


# Labels of the father's name, the first that is there counts.
FATHERS = ("Father Name", "Father", "Husband")


def father_text(label: Column) -> Column:
    """What stands below (else right of) a label of the father's name on a page; null without any."""

    def read(at: Column) -> Column:
        side = lambda way: spatial.beside(F.col("page"), at, F.lit(way))
        tokens = text.let(side("below"), lambda b: F.when(F.size(b) > 0, b).otherwise(side("right")))
        return text.let(tokens, lambda b: F.when(F.size(b) > 0, joined(F.when(F.size(b) < 2, b).otherwise(spatial.reading_order(b)))))

    return F.when(label.isNotNull(), text.let(label, read))


def joined(tokens: Column) -> Column:
    """The texts of tokens; one needs no lambda."""
    return F.when(F.size(tokens) == 1, F.coalesce(F.get(tokens, F.lit(0))["text"], F.lit(""))).otherwise(F.array_join(F.transform(tokens, lambda t: t["text"]), " "))


#: Of a configured field, what is told of it and what places it.
FIXED = ("field", "field_ord", "strategy", "language", "script")


def first_pass(pages: DataFrame, rows: list[Row], types: StructType, labels: dict[str, str], strict: bool = False) -> DataFrame:
    """pages of one type with what anchors and regions give for its configured fields: columns __tokens, __raw, __value and
    __valid by the place of a field in rows. The rules of a field are known when the query is made, so that each stands in
    code that is compiled and not in a lambda on an array of fields. labels: by keyword, the column of the token that is it."""
    lit = lambda r, c: F.lit(r[c]).cast(types[c].dataType)
    every = list(enumerate(rows))
    labelled = [(i, r) for i, r in every if r["keyword"] is not None]
    out = pages.withColumns({f"__beside{i}": spatial.beside(F.col("page"), F.col(labels[r["keyword"]]), lit(r, "direction")) for i, r in labelled})

    def placed(i: int, r: Row) -> Column:
        region = spatial.within(F.col("page"), [lit(r, c) for c in spatial.REGION], lit(r, "containment"), lit(r, "minimum_overlap"))
        return region if r["keyword"] is None else F.when(F.size(f"__beside{i}") > 0, F.col(f"__beside{i}")).otherwise(region)

    out = out.withColumns({f"__at{i}": placed(i, r) for i, r in every}).drop(*(f"__beside{i}" for i, _ in every))
    out = out.withColumns({f"__tokens{i}": F.when(F.size(f"__at{i}") < 2, F.col(f"__at{i}")).otherwise(spatial.reading_order(F.col(f"__at{i}"))) for i, _ in every}).drop(*(f"__at{i}" for i, _ in every))
    out = out.withColumns({f"__raw{i}": F.coalesce(joined(F.col(f"__tokens{i}")), F.lit("")) for i, _ in every})
    out = out.withColumns({f"__clean{i}": text.without_noise(F.col(f"__raw{i}")) for i, _ in every})
    out = out.withColumns({f"__value{i}": text.normalized_by(F.col(f"__clean{i}"), r["normalization"]) for i, r in every}).drop(*(f"__clean{i}" for i, _ in every))
    return out.withColumns({f"__valid{i}": validators.validated_by(F.col(f"__value{i}"), r["validator"], "passport", strict) for i, r in every})


def parse_passports(tokens: DataFrame, config: DataFrame, strict: bool = False) -> DataFrame:
    """A row for each document and configured field, after the passes in their order: anchors and regions, patterns in the
    whole text, dates by year, the father's name, and the machine-readable zone."""
    return fields_in(parsed_pages(tokens, config, strict=strict))


def fields_in(parsed: DataFrame) -> DataFrame:
    """A row for each field of rows with fields. No row is without any; of a plain explode Spark infers a filter on the
    array, which it pushes below all that makes it, so that everything would be planned and done twice."""
    return parsed.select("doc_id", F.explode_outer("fields").alias("f")).select("doc_id", "f.*")


def parsed_pages(tokens: DataFrame, config: DataFrame, *more: Column, strict: bool = False, parts: Sequence[str] | None = None) -> DataFrame:
    """doc_id, doc_type and page of the documents of configured types, further aggregates of their tokens, and fields, an
    array of the parsed fields; see parse_passports. A type is configured by few fields, whose rules become part of the query.
    parts: what of the fields is used, if not all; Spark can't see it in an array, and would make the rest for nothing."""
    rows = config.where(F.col("field").isin(*PASSPORT_FIELDS)).orderBy("doc_type", "field_ord", "field").limit(TOLD + 1).collect()
    if len(rows) > TOLD:
        raise ValueError(f"more than {TOLD} configured fields")
    by: dict[str, list[Row]] = {}
    for r in rows:
        by.setdefault(r["doc_type"], []).append(r)
    words = spatial.keys_of(tokens.sparkSession, [*FATHERS, *(r["keyword"] for r in rows if r["keyword"] is not None)])
    labels = {w: f"__label{i}" for i, w in enumerate(words)}
    pages = spatial.labelled_pages(tokens, {labels[w]: k for w, k in words.items()}, *more)
    given = [c for c in pages.columns if c not in labels.values()]
    made = [parsed_type(pages.where(F.col("doc_type") == kind), given, fields, config.schema, labels, strict, parts) for kind, fields in by.items()]
    if not made:  # no configured field: no rows, of the same columns
        some = Row(**{c: None for c in config.columns} | {"field": PASSPORT_FIELDS[0]})
        made = [parsed_type(pages.where("false"), given, [some], config.schema, labels, strict, parts)]
    return reduce(DataFrame.unionByName, made)


def parsed_type(pages: DataFrame, given: list[str], rows: list[Row], types: StructType, labels: dict[str, str], strict: bool, parts: Sequence[str] | None) -> DataFrame:
    """The rows of parsed_pages for one document type, configured by rows."""
    t = lambda x: x["text"]
    zone = F.filter("page", lambda x: mrz.is_zone(t(x)))
    last = lambda keep: F.try_element_at(F.filter(zone, keep), F.lit(-1))["text"]
    one = lambda x: F.contains(t(x), F.lit("P<"))
    of = {
        "raw_text": F.array_join(F.transform("page", t), " "),
        "line1": last(one),
        "line2": last(lambda x: ~one(x) & (F.length(t(x)) > 15)),
        "dates": ranked(F.filter(F.transform(F.filter("page", lambda x: t(x).rlike(r"\d")), lambda x: F.struct(x["idx"].alias("i"), dated(t(x)).alias("d"))), lambda x: x["d"].isNotNull())),
        "beside_father": father_text(F.coalesce(*(F.col(labels[w]) for w in FATHERS))),
    }
    wide = first_pass(pages.withColumns(of), rows, types, labels, strict).drop(*labels.values())
    at = {f: next((i for i, r in enumerate(rows) if r["field"] == f), None) for f in PASSPORT_FIELDS}
    none = F.lit(None).cast("struct<value:string,validated:boolean>")
    wide = wide.withColumns({f: none if i is None else F.struct(F.col(f"__value{i}").alias("value"), F.col(f"__valid{i}").alias("validated")) for f, i in at.items()})
    wide = wide.withColumn("m1", mrz.line1(F.coalesce("line1", F.lit("")))).withColumn("m2", mrz.line2(F.coalesce("line2", F.lit(""))))

    def put(df: DataFrame, field: str, when: Column, value: Column) -> DataFrame:
        return df.withColumn(field, F.when(F.col(field).isNotNull() & when, F.struct(value.alias("value"), F.lit(True).alias("validated"))).otherwise(F.col(field)))

    val, ok = lambda f: F.coalesce(F.col(f"{f}.value"), F.lit("")), lambda f: F.coalesce(F.col(f"{f}.validated"), F.lit(False))
    number = F.regexp_extract("raw_text", text.CARD, 0)
    wide = put(wide, "cnic_number", number != "", text.card_number(number))
    passport = F.regexp_extract("raw_text", r"\b[A-Z]{1,3}\d{6,8}\b", 0)
    wide = put(wide, "passport_number", (passport != "") & F.contains(F.lower("raw_text"), F.lit("passport")), passport)
    for f, d in (("date_of_birth", F.get("dates", F.lit(0))), ("date_of_issue", F.get("dates", F.lit(1))), ("date_of_expiry", F.try_element_at("dates", F.lit(-1)))):
        wide = put(wide, f, (F.size("dates") >= 3) & ~ok(f), d)
    father = F.coalesce(text.father_name(text.without_noise(F.col("beside_father"))), F.lit(""))
    wide = wide.withColumn("__father", father)
    comma = F.coalesce(text.comma_name(F.col("raw_text"), val("surname"), val("given_names")), F.lit(""))
    wide = wide.withColumn("__father", F.when(F.col("__father") != "", F.col("__father")).otherwise(comma))
    wide = put(wide, "father_name", F.col("__father") != "", F.col("__father"))
    for f in ("surname", "given_names"):
        bad = (val(f) == "") | F.contains(val(f), F.lit("RAWALPINDI")) | F.contains(val(f), F.lit("NATIONALITY"))
        wide = put(wide, f, F.col(f"m1.{f}").isNotNull() & bad, F.col(f"m1.{f}"))
    for f in ("passport_number", "date_of_birth", "date_of_expiry", "cnic_number"):
        wide = put(wide, f, F.col(f"m2.{f}").isNotNull() & ((val(f) == "") | ~ok(f)), F.col(f"m2.{f}"))

    def told_of(i: int, r: Row) -> Column:
        first = parsed(F.col(f"__tokens{i}"), F.col(f"__raw{i}"), F.col(f"__value{i}"), F.col(f"__valid{i}"))
        every = {c: F.lit(r[c]).cast(types[c].dataType) for c in FIXED} | {k: c for k, c in first.items() if k not in ("value", "validated")}
        every = {"doc_type": F.col("doc_type")} | every | {k: F.col(f"{r['field']}.{k}") for k in ("value", "validated")}
        return F.struct(*(c.alias(k) for k, c in every.items() if parts is None or k in parts))

    return wide.select(*given, F.array(*(told_of(i, r) for i, r in enumerate(rows))).alias("fields"))


def display_names(fields: DataFrame) -> DataFrame:
    """doc_id, name: given names and surname of passports."""
    one = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, F.col("value"))), F.lit(""))
    return fields.groupBy("doc_id").agg(text.strip(F.concat_ws(" ", one("given_names"), one("surname"))).alias("name"))


def best_candidates(candidates: DataFrame) -> DataFrame:
    """candidates: doc_id, field, variant_ord and the columns of fields. Per document and field the one of the highest layered
    score, the earliest of equals, with its scores; its confidence stays what it was."""
    scored = candidates.withColumn("scores", scoring.candidate(F.col("raw_value"), F.col("value"), F.col("ocr_confidence"), F.col("strategy"), F.col("validated"), F.lit("latin"), F.lit(False), F.lit(False)))
    w = Window.partitionBy("doc_id", "field").orderBy(F.desc("scores.field_confidence"), "variant_ord")
    return scored.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def second_pass(fields: DataFrame, crop_tokens: DataFrame, crops: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fields after the crops of single fields were recognised on their own: what a crop says of its field is a further
    candidate, if it says anything, and the better one stays; of equals the first pass's.

    crop_tokens: tokens in a crop's pixels, with doc_id, doc_type and variant; crops: doc_id, variant, field, left, top,
    page_width, page_height; parse: tokens of pages to fields.
    """
    moved = enriched(reprojected(crop_tokens, crops.drop("field"))).withColumn("doc_id", F.struct("doc_id", "variant"))
    said = parse(moved.drop("variant")).withColumns({"variant": F.col("doc_id.variant"), "doc_id": F.col("doc_id.doc_id")}).where("value <> ''")
    said = said.join(crops.select("doc_id", "variant", "field"), ["doc_id", "variant", "field"], "left_semi")
    both = fields.withColumn("variant_ord", F.lit("")).unionByName(said.withColumnRenamed("variant", "variant_ord"))
    return best_candidates(both).select(*fields.columns)
