"""Queries over derived card and passport tokens: geometry, joins, order, parsing, scoring, reconciliation and review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.functions import geometry, scoring, text, validators
from docustrata.operators import evidence, parse, reconcile, spatial, variants
from docustrata.plans import fixtures
from docustrata.plans.scalar import ISO_DATES, PARSER_DATES, card, date_sql, get, has, labels, q, strip, sub, zone1_sql, zone2_sql
from docustrata.sources import field_config as fc

Query = Callable[[SparkSession, str], DataFrame]
NUMBER_REGION = (0.20, 0.52, 0.85, 0.65)


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_cards(fixtures.card_tokens(spark, sf_dir), fc.field_config(spark))


def passports(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Pages with their parsed fields (of them parts, or all), size (w, h) and zone lines: one row for each document from its tokens to its result."""
    config = fc.field_config(spark).where("doc_type = 'passport'")
    parsed = parse.parsed_pages(fixtures.passport_pages(spark, sf_dir), config, *evidence.sizes(), parts=parts or None)
    return parsed.withColumns(parse.page_zones(F.col("page")))


def matrix(k: Column) -> list[Column]:
    """An affine map that depends on a key."""
    d = lambda c: c.cast("double")
    return [d(k % 3 + 1), F.lit(0.5), d(k % 11), F.lit(0.25), d(k % 2 + 2), d(k % 7), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def geo1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.card_tokens(spark, sf_dir)
    return t.select("doc_id", "idx", *(geometry.normalized(F.col(a), F.col(s)).alias(f"n{a}") for a, s in zip(spatial.PX, ("image_width", "image_height") * 2, strict=True)))


def geo3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.card_tokens(spark, sf_dir)
    return t.select("doc_id", "idx", geometry.center(F.col("x1"), F.col("x2")).alias("cx"), geometry.center(F.col("y1"), F.col("y2")).alias("cy"), F.abs(F.col("x2") - F.col("x1")).alias("w"), F.abs(F.col("y2") - F.col("y1")).alias("h"))


def geo6_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, r = fixtures.card_tokens(spark, sf_dir), [F.lit(v) for v in NUMBER_REGION]
    box = spatial.cols(spatial.NORM)
    return t.select("doc_id", "idx", text.rounded(geometry.overlap(box, r), 6).alias("overlap"), text.rounded(geometry.iou(box, r), 6).alias("iou"), geometry.inside(F.col("nx1"), F.col("ny1"), r).alias("corner_inside"))


def geo9(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.card_tokens(spark, sf_dir)
    box = geometry.transform_box(matrix(F.col("doc_id")), spatial.cols(spatial.PX))
    return t.select("doc_id", "idx", *(c.alias(n) for c, n in zip(box, ("tx1", "ty1", "tx2", "ty2"), strict=True)))


def geo11(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.card_tokens(spark, sf_dir).where("idx = 6")
    m = matrix(F.col("doc_id"))
    x, y = geometry.transform_point(geometry.inverse(m), *geometry.transform_point(m, F.col("x1"), F.col("y1")))
    inv = geometry.inverse(m)
    return t.select("doc_id", text.rounded(x, 4).alias("x"), text.rounded(y, 4).alias("y"), text.rounded(inv[0], 6).alias("i0"), text.rounded(inv[5], 6).alias("i5"))


def geo12(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.card_tokens(spark, sf_dir)
    s, d = F.col("x1") + F.col("y1"), F.col("y1") - F.col("x1")
    pick = lambda f, by, sign: f("idx", F.struct(by, (F.col("idx") * sign)))
    return t.groupBy("doc_id").agg(pick(F.min_by, s, 1).alias("tl"), pick(F.max_by, s, -1).alias("br"), pick(F.min_by, d, 1).alias("tr"), pick(F.max_by, d, -1).alias("bl"))


def geo13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixtures.card_tokens(spark, sf_dir).where("idx = 0").select("doc_id", "doc_type", "image_width", "image_height")
    c = fc.field_config(spark)
    px = geometry.region_pixels(spatial.cols(spatial.REGION), F.col("margin"), F.col("image_width"), F.col("image_height"))
    return pages.join(F.broadcast(c), "doc_type").select("doc_id", "field", *(v.alias(n) for v, n in zip(px, ("px1", "py1", "px2", "py2"), strict=True)))


def join1(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = fc.field_config(spark).withColumns({"containment": F.lit(mode), "minimum_overlap": F.lit(0.5 if mode != "iou" else 0.05)})
        return spatial.in_regions(fixtures.card_tokens(spark, sf_dir), c).select("doc_id", "field", "idx")

    return run


def join2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.anchors(fixtures.passport_tokens(spark, sf_dir), fc.field_config(spark)).select("doc_id", "field", F.col("anchor.idx").alias("idx"), F.col("anchor.text").alias("text"))


def join3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.card_tokens(spark, sf_dir).select("doc_id", "idx", text.rounded(spatial.similarity(F.col("text"), F.lit("Identity Number")), 6).alias("similarity"))


def join4(direction: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keywords = fc.field_config(spark)
        if direction == "left":  # the derived passports have nothing to the left of their labels, so the number's dash is the label
            keywords = keywords.where("field = 'cnic_number'").withColumn("keyword", F.lit("-"))
        found = spatial.labelled(spatial.pages(fixtures.passport_tokens(spark, sf_dir)), keywords)
        hits = spatial.beside(F.col("page"), F.col("label"), F.lit(direction))
        return found.select("doc_id", "field", F.explode(F.transform(hits, lambda t: t["idx"])).alias("idx"))

    return run


def card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).select("doc_id", "field", "raw_value", "value", "validated", "ocr_confidence", "spatial_confidence", "confidence", joined(F.col("token_indices")).alias("token_indices"))


def join5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).select("doc_id", "field", joined(F.col("token_indices")).alias("token_indices"))


def ord1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of a card in one order, with lines that the jitter of y makes uneven."""
    t = fixtures.card_tokens(spark, sf_dir).withColumn("y1", F.col("y1") + (F.col("idx") * 7 + F.col("doc_id")) % 23)
    g = t.groupBy("doc_id").agg(spatial.reading_order(F.collect_list(F.struct("idx", "text", "x1", "y1"))).alias("o"))
    return g.select("doc_id", joined(F.transform("o", lambda x: x["idx"])).alias("order"), F.array_join(F.transform("o", lambda x: x["text"]), " ").alias("text"))


def agg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cards(spark, sf_dir)
    return f.select("doc_id", "field", *(F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(spatial.PX)), *(F.get("bbox_norm", F.lit(i)).alias(n) for i, n in enumerate(spatial.NORM)))


def agg3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cards(spark, sf_dir)
    s = scoring.candidate(F.col("raw_value"), F.col("value"), F.col("ocr_confidence"), F.col("strategy"), F.col("validated"), F.lit("latin"), F.lit(False), F.lit(False))
    return f.select("doc_id", "field", s["validation_confidence"].alias("validation_confidence"), s["field_confidence"].alias("field_confidence"))


def ord3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the field as parsed and a second candidate whose recognition was worse or better by key."""
    f = cards(spark, sf_dir).withColumn("variant_ord", F.lit(0))
    other = f.withColumn("variant_ord", F.lit(1)).withColumn("ocr_confidence", text.rounded(F.lit(0.7) + (F.col("doc_id") % 5) * 0.05, 4)).withColumn("validated", F.col("doc_id") % 2 == 0)
    return parse.best_candidates(f.unionByName(other)).select("doc_id", "field", "variant_ord", F.col("scores.field_confidence").alias("field_confidence"), "confidence")


def ord4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.date_ranks(fixtures.passport_tokens(spark, sf_dir))


def ord6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.zones(fixtures.passport_tokens(spark, sf_dir))


def ord7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.zone_candidates(fixtures.passport_tokens(spark, sf_dir))


def nrm14(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = parse.bilingual(cards(spark, sf_dir))
    return b.select("doc_id", F.col("name.en").alias("name_en"), F.col("name.ur").alias("name_ur"), F.col("father_name.en").alias("father_en"), F.col("father_name.ur").alias("father_ur"))


def agg4(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants.score_variants(fixtures.passport_tokens(spark, sf_dir))
    m = F.array_join(F.array_sort(F.transform(F.map_entries("matched_fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return v.withColumn("matched_fields", m)


def agg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    ocr, place = (k % 41 + 60) / 100, (k % 29 + 70) / 100
    return c.select(k.alias("k"), scoring.calibrated(ocr, place, k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0).alias("confidence"))


def agg7(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cards(spark, sf_dir)
    classes = f.select("doc_id").distinct().withColumn("class_confidence", F.when(F.col("doc_id") % 10 == 0, 0.65).otherwise(0.98))
    return reconcile.review(f, classes).select("doc_id", "review_state", F.array_join("review_reasons", "; ").alias("review_reasons"))


def val8(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("c_custkey"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    day = lambda y: F.concat(F.lit("01.02."), y.cast("string"))
    w = validators.cross_field(day(k % 40 + 1980), day(k % 30 + 1990), day(k % 20 + 1998), F.concat(F.lit("AB"), (k % 3 + 1234567).cast("string")), F.lit("AB12345674PAK"))
    return c.select(k.alias("k"), F.array_join(w, "; ").alias("warnings"))


def val10(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("c_custkey"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    day = lambda y, m, d: F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return c.select(k.alias("k"), validators.chronology(day(k % 40 + 1980, k % 12 + 1, k % 31 + 1), day(k % 30 + 1990, k % 11 + 1, k % 28 + 1), day(k % 20 + 2000, k % 7 + 1, k % 27 + 1)).alias("in_order"))


def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cards(spark, sf_dir)
    timings = f.select("doc_id").distinct().withColumn("ms", (F.col("doc_id") % 100).cast("double"))
    return variants.run_summary(f, timings)


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciled fields."""
    return reconcile.reconcile_pages(passports(spark, sf_dir, "field", *reconcile.CANDIDATE).withColumnRenamed("doc_type", "document_type"))


def pip2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.fields_in(passports(spark, sf_dir, "field", "raw_value", "value", "validated", "confidence")).select("doc_id", "field", "raw_value", "value", "validated", "confidence")


def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled(spark, sf_dir).select("doc_id", "field", "value", "decision", "confidence", "source", "format_valid", "checksum_valid", joined(F.col("token_indices")).alias("token_indices"))


def agg8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.document_result(reconciled(spark, sf_dir)).select("doc_id", "status", "review_required", F.array_join("review_reasons", "; ").alias("review_reasons"))


def passport_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that need a person: parsed, reconciled and routed, with the reasons of both."""
    routed = reconcile.review_pages(passports(spark, sf_dir, "field", "field_ord", "validated", "confidence", *reconcile.CANDIDATE)).withColumnRenamed("doc_type", "document_type").withColumn("routed", F.struct("review_state", "review_reasons"))
    result = reconcile.document_result(reconcile.reconcile_pages(routed, "routed"), "routed")
    both = result.select("doc_id", "status", "review_required", F.col("review_reasons").alias("reconcile_reasons"), "routed.*")
    both = both.withColumn("review_state", reconcile.demoted(F.col("review_state"), F.col("review_required")))
    return both.where("review_state = 'NEEDS_REVIEW'").select("doc_id", "review_state", "status", F.array_join("review_reasons", "; ").alias("review_reasons"), F.array_join("reconcile_reasons", "; ").alias("reconcile_reasons"))


def card_number_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).where("field = 'cnic_number'").select("doc_id", "raw_value", "value", "validated", "confidence")


QUERIES: dict[str, Query] = {
    "card_number_slice": card_number_slice,
    "passport_review_queue": passport_review_queue,
    "geo1_normalize_box": geo1,
    "geo3_center_size": geo3,
    "geo6_geo7_overlap_iou": geo6_7,
    "geo9_transform_box": geo9,
    "geo11_inverse": geo11,
    "geo12_order_points": geo12,
    "geo13_region_pixels": geo13,
    "join1_region_center": join1("center"),
    "join1_region_overlap": join1("overlap"),
    "join1_region_iou": join1("iou"),
    "join2_anchor": join2,
    "join3_similarity": join3,
    "join4_anchor_right": join4("right"),
    "join4_anchor_left": join4("left"),
    "join4_anchor_below": join4("below"),
    "join4_anchor_above": join4("above"),
    "join5_card_strategy": join5,
    "ord1_reading_order": ord1,
    "ord3_best_candidate": ord3,
    "ord4_date_ranks": ord4,
    "ord6_zone_lines": ord6,
    "ord7_zone_candidates": ord7,
    "nrm14_bilingual": nrm14,
    "agg1_provenance": agg1,
    "agg3_candidate_score": agg3,
    "agg4_variant_score": agg4,
    "agg5_calibrated_confidence": agg5,
    "agg7_review_routing": agg7,
    "agg8_document_result": agg8,
    "agg10_run_summary": agg10,
    "agg11_reconcile": agg11,
    "val8_cross_field": val8,
    "val10_chronology": val10,
    "pip1_card_parse": card_fields,
    "pip2_passport_parse": pip2,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


# SQL for DuckDB.
def r6(e: str, n: int) -> str:
    return f"cast(round(cast({e} AS decimal(18, 6)), {n}) AS double)"


def config_values() -> str:
    lit = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in fc.rows()) + ") AS cfg(" + ", ".join(fc.COLUMNS) + ")"


def words(e: str) -> str:
    return sub(f"lower({e})", r"[^\w]")


def chars(e: str) -> str:
    return f"list_distinct(string_split({e}, ''))"


def sim_sql(a: str, b: str) -> str:
    x, y = words(a), words(b)
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0.0 WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 1.0 ELSE len(list_intersect({chars(x)}, {chars(y)})) / greatest(len({chars(x)}), len({chars(y)})) END"


def parse_ctes(tokens: str, anchor_first: bool, fields: bool = True) -> str:
    """t, cfg, anchors, beside, and if wanted hits, fold and fields (doc_id, field, ..., raw_value and what provenance needs)."""
    dist = "sqrt(((t.x1 + t.x2) / 2 - (a.ax1 + a.ax2) / 2) ** 2 + ((t.y1 + t.y2) / 2 - (a.ay1 + a.ay2) / 2) ** 2) <= 500"
    row, col = "abs((t.y1 + t.y2) / 2 - (a.ay1 + a.ay2) / 2) <= 50", "abs((t.x1 + t.x2) / 2 - (a.ax1 + a.ax2) / 2) <= 250"
    first = "'anchor'" if anchor_first else "CASE WHEN c.strategy = 'anchor' THEN 'anchor' ELSE 'region' END"
    return f"""{"WITH RECURSIVE" if fields else "WITH"} t AS ({tokens}), cfg AS (SELECT * FROM {config_values()}),
tw AS MATERIALIZED (SELECT *, lower({strip('text')}) AS tl, {words('text')} AS tws, {chars(words('text'))} AS tcs FROM t), kw AS MATERIALIZED (SELECT *, lower(keyword) AS kl, {words('keyword')} AS kws, {chars(words('keyword'))} AS kcs FROM cfg WHERE keyword IS NOT NULL),
cand AS (SELECT t.*, c.field, c.direction AS dir, contains(tl, kl) OR contains(kl, tl) AS ex, CASE WHEN tws = '' OR kws = '' THEN 0.0 WHEN contains(tws, kws) OR contains(kws, tws) THEN 1.0 WHEN least(len(tcs), len(kcs)) < 0.65 * greatest(len(tcs), len(kcs)) THEN 0.0 ELSE len(list_intersect(tcs, kcs)) / greatest(len(tcs), len(kcs)) END AS sim FROM tw t JOIN kw c ON t.doc_type = c.doc_type),
anchors AS (SELECT doc_id, field, dir, idx AS aidx, text AS atext, x1 AS ax1, y1 AS ay1, x2 AS ax2, y2 AS ay2 FROM cand WHERE ex OR sim >= 0.65 QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY CASE WHEN ex THEN 0 ELSE 1 END, CASE WHEN ex THEN 0 ELSE -sim END, idx) = 1),
beside AS (SELECT t.doc_id, a.field, t.idx, d.way FROM anchors a JOIN t ON t.doc_id = a.doc_id AND t.idx <> a.aidx JOIN (VALUES ('right'), ('left'), ('below'), ('above')) AS d(way) ON CASE d.way WHEN 'right' THEN t.x1 >= a.ax2 - 10 AND {row} WHEN 'left' THEN t.x2 <= a.ax1 + 10 AND {row} WHEN 'below' THEN t.y1 >= a.ay2 - 5 AND t.y1 - a.ay2 <= 50 AND {col} ELSE t.y2 <= a.ay1 + 5 AND a.ay1 - t.y2 <= 50 AND {col} END WHERE {dist})""" + ("" if not fields else f""",
hits AS (SELECT t.doc_id, c.field, t.idx, 'region' AS how FROM t JOIN cfg c ON t.doc_type = c.doc_type AND (t.nx1 + t.nx2) / 2 BETWEEN c.rx1 AND c.rx2 AND (t.ny1 + t.ny2) / 2 BETWEEN c.ry1 AND c.ry2
 UNION ALL SELECT b.doc_id, b.field, b.idx, 'anchor' FROM beside b JOIN anchors a ON a.doc_id = b.doc_id AND a.field = b.field AND a.dir = b.way),
best AS (SELECT h.* FROM hits h JOIN (SELECT DISTINCT doc_type, field, strategy FROM cfg) c ON c.field = h.field AND c.doc_type = (SELECT min(doc_type) FROM t) QUALIFY dense_rank() OVER (PARTITION BY h.doc_id, h.field ORDER BY CASE WHEN h.how = {first} THEN 0 ELSE 1 END) = 1),
seq AS (SELECT b.doc_id, b.field, t.idx, t.text, t.confidence, t.x1, t.y1, t.x2, t.y2, t.nx1, t.ny1, t.nx2, t.ny2, row_number() OVER (PARTITION BY b.doc_id, b.field ORDER BY t.y1, t.idx) AS rn FROM best b JOIN t ON t.doc_id = b.doc_id AND t.idx = b.idx),
fold AS (SELECT *, y1 AS line_y, 0 AS line FROM seq WHERE rn = 1 UNION ALL SELECT s.*, CASE WHEN abs(s.y1 - f.line_y) > 15 THEN s.y1 ELSE f.line_y END, CASE WHEN abs(s.y1 - f.line_y) > 15 THEN f.line + 1 ELSE f.line END FROM fold f JOIN seq s ON s.doc_id = f.doc_id AND s.field = f.field AND s.rn = f.rn + 1),
got AS (SELECT doc_id, field, string_agg(text, ' ' ORDER BY line, x1, rn) AS raw, string_agg(idx::VARCHAR, ',' ORDER BY line, x1, rn) AS indices, avg(confidence) AS mean, count(*) AS n, min(x1) AS bx1, min(y1) AS by1, max(x2) AS bx2, max(y2) AS by2, min(nx1) AS bnx1, min(ny1) AS bny1, max(nx2) AS bnx2, max(ny2) AS bny2 FROM fold GROUP BY ALL),
fields AS (SELECT d.doc_id, c.field, c.field_ord, c.strategy, c.normalization, c.validator, coalesce(g.raw, '') AS raw_value, coalesce(g.indices, '') AS token_indices, coalesce({r6('g.mean', 4)}, 0.0) AS ocr_confidence, coalesce({r6('least(1.0, 0.7 + 0.3 / g.n)', 4)}, 0.0) AS spatial_confidence, coalesce({r6('0.5 * g.mean + 0.3 * least(1.0, 0.7 + 0.3 / g.n) + 0.2', 4)}, 0.0) AS confidence, g.* EXCLUDE (doc_id, field, raw, indices) FROM (SELECT DISTINCT doc_id, doc_type FROM t) d JOIN cfg c ON c.doc_type = d.doc_type LEFT JOIN got g ON g.doc_id = d.doc_id AND g.field = c.field)""")


def valued(source: str = "fields") -> str:
    """CTEs that give the values of card fields and whether they are valid."""
    digits, found = sub("raw_value", r"\D"), get("raw_value", text.CARD)
    number = f"CASE WHEN {has('raw_value', text.CARD)} THEN {card(sub(found, '[^0-9]'))} WHEN length({digits}) = 13 THEN {card(digits)} ELSE {strip('raw_value')} END"
    valid_date = f"coalesce({has('value', validators.DATE)} AND try_cast(substr(value, 1, 2) AS int) BETWEEN 1 AND 31 AND try_cast(substr(value, 4, 2) AS int) BETWEEN 1 AND 12 AND try_cast(substr(value, 7, 4) AS int) BETWEEN 1900 AND 2100, false)"
    return f"""named AS (SELECT *, {labels('raw_value')} AS t0 FROM {source}),
v0 AS (SELECT *, CASE WHEN raw_value = '' THEN '' WHEN normalization = 'cnic' THEN {number} WHEN normalization = 'date' THEN {date_sql('t0', *PARSER_DATES, 'dmy', '.', 'ELSE t0')} WHEN normalization = 'uppercase' THEN {strip('upper(t0)')} ELSE {strip('raw_value')} END AS value FROM named),
v AS (SELECT *, CASE validator WHEN 'cnic_number' THEN {has(strip('value'), validators.CARD)} WHEN 'date' THEN {valid_date} WHEN 'text_non_empty' THEN length({strip('value')}) > 0 ELSE true END AS validated FROM v0)"""


def noise_sql(e: str) -> str:
    return strip(sub(strip(sub(e, r"(?i)\b(" + "|".join(text.NOISE_WORDS) + r")\b")), r"\s+", " "))


def passport_ctes() -> str:
    """CTEs up to last (doc_id, field, raw_value, value, validated, ...): the passes of passport parsing."""
    p = fixtures.DUCK_PASSPORTS
    fields = parse.PASSPORT_FIELDS
    digits, found = sub("cleaned", r"\D"), get("cleaned", text.CARD)
    number = f"CASE WHEN {has('cleaned', text.CARD)} THEN {card(sub(found, '[^0-9]'))} WHEN length({digits}) = 13 THEN {card(digits)} ELSE {strip('cleaned')} END"
    pn = r"\b[A-Z]{1,3}\d{6,8}\b"
    father = lambda t: f"CASE WHEN contains({t}, ',') AND len(list_filter(list_transform(string_split({t}, ','), lambda x: {strip('x')}), lambda x: x <> '')) >= 2 THEN upper(list_filter(list_transform(string_split({t}, ','), lambda x: {strip('x')}), lambda x: x <> '')[2] || ' ' || list_filter(list_transform(string_split({t}, ','), lambda x: {strip('x')}), lambda x: x <> '')[1]) ELSE upper({t}) END"
    value = f"CASE WHEN cleaned = '' THEN '' WHEN normalization = 'passport_number' THEN CASE WHEN {has('upper(cleaned)', pn)} THEN {get('upper(cleaned)', pn)} ELSE {sub('upper(cleaned)', r'[^\w]')} END WHEN normalization = 'uppercase' THEN {strip('upper(t0)')} WHEN normalization = 'father_name_invert' THEN {father('t0')} WHEN normalization = 'date' THEN {date_sql('t0', *PARSER_DATES, 'dmy', '.', 'ELSE t0')} ELSE {number} END"
    date_ok = f"coalesce({has('value', validators.DATE)} AND try_cast(substr(value, 1, 2) AS int) BETWEEN 1 AND 31 AND try_cast(substr(value, 4, 2) AS int) BETWEEN 1 AND 12 AND try_cast(substr(value, 7, 4) AS int) BETWEEN 1900 AND 2100, false)"
    valid = f"CASE validator WHEN 'passport_number' THEN {has(strip('value'), validators.PASSPORT)} WHEN 'date' THEN {date_ok} WHEN 'text_non_empty' THEN length({strip('value')}) > 0 ELSE true END"
    wide = ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {f}, bool_or(validated) FILTER (WHERE field = '{f}') AS {f}_ok" for f in fields)
    comma = r"\b([A-Z]{3,})\s*,\s*([A-Z]{3,})\b"

    def step(name: str, source: str, changes: dict[str, tuple[str, str]]) -> str:
        """Fields that take a value where a condition holds."""
        put = ", ".join(f"CASE WHEN {c} THEN {v} ELSE {f} END AS {f}, CASE WHEN {c} THEN true ELSE {f}_ok END AS {f}_ok" for f, (c, v) in changes.items())
        return f"{name} AS (SELECT * REPLACE ({put}) FROM {source})"

    one, two = zone1_sql("l1"), zone2_sql("l2")
    bad = lambda f: f"m_{f} IS NOT NULL AND ({f} = '' OR contains({f}, 'RAWALPINDI') OR contains({f}, 'NATIONALITY'))"
    dated = f"SELECT doc_id, idx, {date_sql('t', *PARSER_DATES, 'dmy', '.', 'ELSE t')} AS d FROM (SELECT doc_id, idx, {labels('text')} AS t FROM t)"
    order = "list(d ORDER BY substr(d, 7, 4), i)"
    side = lambda w: {"below": "t.y1 >= a.y2 - 5 AND t.y1 - a.y2 <= 50 AND abs((t.x1 + t.x2) / 2 - (a.x1 + a.x2) / 2) <= 250", "right": "t.x1 >= a.x2 - 10 AND abs((t.y1 + t.y2) / 2 - (a.y1 + a.y2) / 2) <= 50"}[w] + " AND sqrt(((t.x1 + t.x2) / 2 - (a.x1 + a.x2) / 2) ** 2 + ((t.y1 + t.y2) / 2 - (a.y1 + a.y2) / 2) ** 2) <= 500"
    kw = f"contains(lower({strip('t.text')}), lower(w.word)) OR contains(lower(w.word), lower({strip('t.text')}))"
    return f"""{parse_ctes(p, True)},
c0 AS (SELECT *, {noise_sql('raw_value')} AS cleaned FROM fields), c1 AS (SELECT *, {labels('cleaned')} AS t0 FROM c0), c2 AS (SELECT *, {value} AS value FROM c1), c3 AS (SELECT *, {valid} AS validated FROM c2),
whole AS (SELECT doc_id, string_agg(text, ' ' ORDER BY idx) AS raw_text FROM t GROUP BY doc_id),
zl AS (SELECT doc_id, max_by(text, idx) FILTER (WHERE contains(text, 'P<')) AS line1, max_by(text, idx) FILTER (WHERE NOT contains(text, 'P<') AND length(text) > 15) AS line2 FROM t WHERE contains(text, '<') GROUP BY doc_id),
dr AS (SELECT doc_id, count(*) AS nd, ({order})[1] AS d1, ({order})[2] AS d2, ({order})[-1] AS d3 FROM (SELECT doc_id, d, min(idx) AS i FROM ({dated}) WHERE {has('d', validators.DATE)} GROUP BY ALL) GROUP BY doc_id),
fa AS (SELECT * FROM (SELECT t.*, w.ord, {kw} AS ex, {sim_sql('t.text', 'w.word')} AS sim FROM t JOIN (VALUES (0, 'Father Name'), (1, 'Father'), (2, 'Husband')) AS w(ord, word) ON true) WHERE ex OR sim >= 0.65 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord, CASE WHEN ex THEN 0 ELSE 1 END, CASE WHEN ex THEN 0 ELSE -sim END, idx) = 1),
fb AS (SELECT a.doc_id, string_agg(t.text, ' ' ORDER BY t.y1, t.x1) AS ft FROM fa a JOIN t ON t.doc_id = a.doc_id AND t.idx <> a.idx AND {side('below')} GROUP BY a.doc_id),
fr AS (SELECT a.doc_id, string_agg(t.text, ' ' ORDER BY t.y1, t.x1) AS ft FROM fa a JOIN t ON t.doc_id = a.doc_id AND t.idx <> a.idx AND {side('right')} GROUP BY a.doc_id),
fn AS (SELECT doc_id, {father('ft')} AS fv FROM (SELECT fa.doc_id, {labels(noise_sql('coalesce(fb.ft, fr.ft)'))} AS ft FROM fa LEFT JOIN fb USING (doc_id) LEFT JOIN fr USING (doc_id)) WHERE ft IS NOT NULL),
w0 AS (SELECT doc_id, {wide} FROM c3 GROUP BY doc_id),
w1 AS (SELECT w0.*, raw_text, nd, d1, d2, d3, coalesce(fv, '') AS fv, upper(replace(coalesce(line1, ''), ' ', '')) AS l1, {sub("upper(coalesce(line2, ''))", r'[^\w<]')} AS l2 FROM w0 JOIN whole USING (doc_id) LEFT JOIN zl USING (doc_id) LEFT JOIN dr USING (doc_id) LEFT JOIN fn USING (doc_id)),
w2 AS (SELECT *, {', '.join(f'{e} AS m_{k}' for k, e in {**one, **two}.items())} FROM w1),
{step('w3', 'w2', {'cnic_number': (has('raw_text', text.CARD), card(sub(get('raw_text', text.CARD), '[^0-9]'))), 'passport_number': (has('raw_text', pn) + " AND contains(lower(raw_text), 'passport')", get('raw_text', pn)), 'date_of_birth': ('nd >= 3 AND NOT date_of_birth_ok', 'd1'), 'date_of_issue': ('nd >= 3 AND NOT date_of_issue_ok', 'd2'), 'date_of_expiry': ('nd >= 3 AND NOT date_of_expiry_ok', 'd3')})},
w4 AS (SELECT * REPLACE (CASE WHEN fv <> '' THEN fv WHEN {has('raw_text', comma)} AND {get('raw_text', comma, 1)} NOT IN (surname, given_names) AND {get('raw_text', comma, 2)} NOT IN (surname, given_names) THEN {get('raw_text', comma, 2)} || ' ' || {get('raw_text', comma, 1)} ELSE '' END AS fv) FROM w3),
{step('w5', 'w4', {'father_name': ("fv <> ''", 'fv'), 'surname': (bad('surname'), 'm_surname'), 'given_names': (bad('given_names'), 'm_given_names'), **{f: (f"m_{f} IS NOT NULL AND ({f} = '' OR NOT {f}_ok)", f'm_{f}') for f in two}})},
lasts AS (SELECT doc_id, unnest([{', '.join(f"{{'field': '{f}', 'value': {f}, 'validated': {f}_ok}}" for f in fields)}], recursive := true) FROM w5),
last AS (SELECT c3.* EXCLUDE (value, validated), l.value, l.validated FROM c3 JOIN lasts l ON l.doc_id = c3.doc_id AND l.field = c3.field)"""


def iso_sql(e: str) -> str:
    rest = rf"WHEN regexp_matches({e}, '^\d{{6}}$') THEN CASE WHEN cast(substr({e}, 1, 2) AS int) > 30 THEN '19' ELSE '20' END || substr({e}, 1, 2) || '-' || substr({e}, 3, 2) || '-' || substr({e}, 5, 2)"
    return date_sql(e, *ISO_DATES, "ymd", "-", rest)


def reconcile_ctes() -> str:
    """CTEs up to final (doc_id, field, value, decision, ...) of derived passports."""
    schema = ", ".join(f"('{f}', {i}, '{t}', {str(c).lower()})" for i, (f, t, c) in enumerate(reconcile.SCHEMAS["passport"]))
    one, two = zone1_sql("l1"), zone2_sql("l2")
    up = lambda e: f"upper({strip(e)})"
    fmt = lambda e: f"CASE WHEN length({sub(e, chr(92) + 'D')}) = 13 THEN {card(sub(e, chr(92) + 'D'))} WHEN {has(e, r'^\d{5}-\d{7}-\d$')} THEN {e} END"
    return f"""{passport_ctes()}, sch AS (SELECT * FROM (VALUES {schema}) AS s(field, ord, kind, critical)),
zc AS (SELECT doc_id, upper(replace(coalesce(min_by(text, idx) FILTER (WHERE contains(text, 'P<')), ''), ' ', '')) AS l1, {sub("upper(coalesce(min_by(text, idx) FILTER (WHERE length(text) >= 28 AND NOT starts_with(text, 'P<')), ''))", r'[^\w<]')} AS l2 FROM t WHERE contains(text, '<') OR length(text) > 20 GROUP BY doc_id),
zw AS (SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in {**one, **two}.items())} FROM zc),
zm AS (SELECT doc_id, unnest([{', '.join(f"{{'field': '{k}', 'z': {k}}}" for k in (*one, *two))}], recursive := true) FROM zw),
e0 AS (SELECT l.doc_id, s.field, s.ord, s.kind, s.critical, nullif(m.z, '') AS z, nullif(l.value, '') AS v, l.ocr_confidence, l.spatial_confidence, l.token_indices FROM last l JOIN sch s ON s.field = l.field LEFT JOIN zm m ON m.doc_id = l.doc_id AND m.field = l.field),
e1 AS (SELECT *, {iso_sql(up('z'))} AS zi, {iso_sql(up('v'))} AS vi FROM e0),
known AS (SELECT doc_id, max(coalesce(zi, vi)) FILTER (WHERE field = 'date_of_birth') AS birth, max(coalesce(zi, vi)) FILTER (WHERE field = 'date_of_expiry') AS expiry FROM e1 GROUP BY doc_id),
rest AS (SELECT d.* FROM (SELECT doc_id, idx, confidence, {iso_sql('u')} AS iso FROM (SELECT doc_id, idx, confidence, {up('text')} AS u FROM t)) d JOIN known k ON k.doc_id = d.doc_id WHERE iso IS NOT NULL AND iso IS DISTINCT FROM birth AND iso IS DISTINCT FROM expiry QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY idx) = 1),
e2 AS (SELECT e1.*, r.iso AS ri, r.confidence AS rc, r.idx AS rx, birth, e1.field = 'date_of_issue' AND r.iso IS NOT NULL AS took FROM e1 LEFT JOIN known k USING (doc_id) LEFT JOIN rest r ON r.doc_id = e1.doc_id),
e3 AS (SELECT *, nullif(CASE kind WHEN 'date' THEN CASE WHEN took THEN ri WHEN field = 'date_of_issue' THEN CASE WHEN vi <> coalesce(birth, '') THEN vi END ELSE coalesce(zi, vi) END WHEN 'passport_number' THEN upper(coalesce(z, v)) WHEN 'cnic_number' THEN coalesce({fmt('z')}, {fmt('v')}) ELSE {up('coalesce(z, v)')} END, '') AS value,
 coalesce(CASE kind WHEN 'date' THEN field <> 'date_of_issue' AND zi IS NOT NULL WHEN 'passport_number' THEN upper(z) = upper(v) WHEN 'cnic_number' THEN {fmt('z')} IS NOT NULL ELSE {up('z')} = {up('v')} END, false) AS checksum_valid FROM e2),
e4 AS (SELECT *, coalesce(CASE kind WHEN 'date' THEN {has('value', r'^\d{4}-\d{2}-\d{2}$')} WHEN 'passport_number' THEN {has('value', '^[A-Z0-9]{7,9}$')} WHEN 'cnic_number' THEN {has('value', r'^\d{5}-\d{7}-\d$')} ELSE length(value) >= 2 END, false) AS format_valid FROM e3),
e5 AS (SELECT *, CASE WHEN took THEN rc ELSE ocr_confidence END * 0.25 + CASE WHEN took THEN 0.9 ELSE spatial_confidence END * 0.15 + CASE WHEN format_valid THEN 0.35 ELSE 0 END + CASE WHEN checksum_valid THEN 0.25 ELSE 0 END AS raw_score FROM e4),
e6 AS (SELECT *, {r6('least(1.0, greatest(0.0, CASE WHEN critical AND NOT format_valid AND NOT checksum_valid THEN least(raw_score, 0.4) ELSE raw_score END))', 2)} AS score FROM e5),
final AS (SELECT doc_id, field, ord, critical, value, CASE WHEN format_valid AND score >= 0.7 THEN 'ACCEPT' WHEN value IS NOT NULL THEN 'REVIEW' ELSE 'UNKNOWN' END AS decision, score AS confidence, CASE WHEN checksum_valid THEN 'mrz+visual_ocr' WHEN kind IN ('passport_number', 'person_name') AND z IS NOT NULL THEN 'mrz' ELSE 'visual_ocr' END AS source, format_valid, checksum_valid, CASE WHEN took THEN rx::VARCHAR ELSE token_indices END AS token_indices FROM e6),
dates AS (SELECT doc_id, max(try_strptime(value, '%Y-%m-%d')) FILTER (WHERE field = 'date_of_birth') AS b, max(try_strptime(value, '%Y-%m-%d')) FILTER (WHERE field = 'date_of_issue') AS i, max(try_strptime(value, '%Y-%m-%d')) FILTER (WHERE field = 'date_of_expiry') AS e FROM final GROUP BY doc_id),
why AS (SELECT doc_id, list_concat(coalesce(list('critical_field_uncertain_' || field ORDER BY ord) FILTER (WHERE critical AND decision <> 'ACCEPT'), []), CASE WHEN NOT coalesce(any_value(b) <= any_value(i) AND any_value(i) <= any_value(e), true) THEN ['invalid_date_chronology'] ELSE [] END) AS reasons, bool_or(decision = 'REVIEW') AS rev FROM final JOIN dates USING (doc_id) GROUP BY doc_id),
result AS (SELECT doc_id, CASE WHEN len(reasons) > 0 OR rev THEN 'review' ELSE 'success' END AS status, len(reasons) > 0 OR rev AS review_required, array_to_string(reasons, '; ') AS review_reasons FROM why)"""


def oracle_sql() -> dict[str, str]:
    c, p = fixtures.DUCK_CARDS, fixtures.DUCK_PASSPORTS
    ctes = parse_ctes(c, False)
    parsed = f"{ctes}, {valued()}"
    m = ["(doc_id % 3 + 1)::DOUBLE", "0.5::DOUBLE", "(doc_id % 11)::DOUBLE", "0.25::DOUBLE", "(doc_id % 2 + 2)::DOUBLE", "(doc_id % 7)::DOUBLE"]
    px, py = (lambda x, y: f"{m[0]} * {x} + {m[1]} * {y} + {m[2]}"), (lambda x, y: f"{m[3]} * {x} + {m[4]} * {y} + {m[5]}")
    corners = (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))
    xs, ys = ", ".join(px(*k) for k in corners), ", ".join(py(*k) for k in corners)
    det = f"({m[0]} * {m[4]} - {m[1]} * {m[3]})"
    rx1, ry1, rx2, ry2 = NUMBER_REGION
    inter = f"greatest(0.0, least(nx2, {rx2}) - greatest(nx1, {rx1})) * greatest(0.0, least(ny2, {ry2}) - greatest(ny1, {ry1}))"
    area, region = "(greatest(0.0, nx2 - nx1) * greatest(0.0, ny2 - ny1))", (rx2 - rx1) * (ry2 - ry1)
    low = lambda r, s: f"greatest(0, trunc((c.{r} - c.margin) * {s})::INT)"
    high = lambda r, s: f"least({s}, trunc((c.{r} + c.margin) * {s})::INT)"
    tc = "(greatest(0.0, least(nx2, rx2) - greatest(nx1, rx1)) * greatest(0.0, least(ny2, ry2) - greatest(ny1, ry1)))"
    ta, ra = "((nx2 - nx1) * (ny2 - ny1))", "((rx2 - rx1) * (ry2 - ry1))"
    score = "least(1.0, greatest(0.0, {o})) * 0.35 + CASE WHEN strategy IN ('region', 'hybrid') AND " + strip("raw_value") + " <> '' THEN 0.9 ELSE 0.6 END * 0.2 + CASE WHEN strategy = 'hybrid' THEN 0.7 ELSE 0.5 END * 0.15 + {val} * 0.3 + 0.1"
    val_conf = "CASE WHEN {ok} AND " + strip("value") + " <> '' THEN 1.0 WHEN " + strip("value") + " <> '' THEN 0.3 ELSE 0.0 END"
    total = lambda o, ok: f"least(1.0, greatest(0.0, {r6(score.format(o=o, val=val_conf.format(ok=ok)), 4)}))"
    other = r6("0.7 + (doc_id % 5) * 0.05", 4)
    dated = f"SELECT doc_id, idx, {date_sql('t', *PARSER_DATES, 'dmy', '.', 'ELSE t')} AS d FROM (SELECT doc_id, idx, {labels('text')} AS t FROM ({p}))"
    ordered_y = "((idx * 7 + doc_id) % 23)"
    zone = "CASE WHEN contains(text, 'P<') THEN 1 ELSE 0 END"
    gx = lambda pat: f"regexp_extract(full_, {q(pat)}, 1)"
    found = [("cnic_number", f"CASE WHEN {gx(variants.CARD)} <> '' THEN translate({gx(variants.CARD)}, ' ', '-') END"), ("date_of_birth", f"nullif({gx(variants.DATE)}, '')"), ("mrz_line1", f"nullif({gx(variants.ZONE)}, '')"), ("passport_number", f"CASE WHEN contains(upper(full_), 'PASSPORT') THEN nullif({gx(variants.PASSPORT)}, '') END")]
    entries = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {e} IS NOT NULL THEN '{k}=' || {e} END" for k, e in found) + "], lambda x: x IS NOT NULL))"
    reasons = "list_filter([CASE WHEN NOT validated THEN 'Field ''' || field || ''' failed format validation' END, CASE WHEN confidence < 0.6 THEN 'Field ''' || field || ''' has low OCR confidence (' || round_even(confidence * 100, 0)::INT::VARCHAR || '%)' END], lambda x: x IS NOT NULL)"
    iso_day = lambda y, mth, d: f"try_strptime(({y})::VARCHAR || '-' || lpad(({mth})::VARCHAR, 2, '0') || '-' || lpad(({d})::VARCHAR, 2, '0'), '%Y-%m-%d')"
    k = "c_custkey"
    return {
        "card_number_slice": f"{parsed} SELECT doc_id, raw_value, value, validated, confidence FROM v WHERE field = 'cnic_number'",
        "geo1_normalize_box": f"SELECT doc_id, idx, nx1, ny1, nx2, ny2 FROM ({c})",
        "geo3_center_size": f"SELECT doc_id, idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, abs(x2 - x1) AS w, abs(y2 - y1) AS h FROM ({c})",
        "geo6_geo7_overlap_iou": f"SELECT doc_id, idx, {r6(f'CASE WHEN {area} <= 0 THEN 0.0 ELSE {inter} / {area} END', 6)} AS overlap, {r6(f'CASE WHEN {area} + {region} - {inter} <= 0 THEN 0.0 ELSE {inter} / ({area} + {region} - {inter}) END', 6)} AS iou, nx1 BETWEEN {rx1} AND {rx2} AND ny1 BETWEEN {ry1} AND {ry2} AS corner_inside FROM ({c})",
        "geo9_transform_box": f"SELECT doc_id, idx, least({xs}) AS tx1, least({ys}) AS ty1, greatest({xs}) AS tx2, greatest({ys}) AS ty2 FROM ({c})",
        "geo11_inverse": f"SELECT doc_id, {r6('x1', 4)} AS x, {r6('y1', 4)} AS y, {r6(f'{m[4]} / {det}', 6)} AS i0, {r6(f'({m[2]} * {m[3]} - {m[0]} * {m[5]}) / {det}', 6)} AS i5 FROM ({c}) WHERE idx = 6",
        "geo12_order_points": f"SELECT doc_id, arg_min(idx, (x1 + y1) * 1000 + idx) AS tl, arg_max(idx, (x1 + y1) * 1000 - idx) AS br, arg_min(idx, (y1 - x1) * 1000 + idx) AS tr, arg_max(idx, (y1 - x1) * 1000 - idx) AS bl FROM ({c}) GROUP BY doc_id",
        "geo13_region_pixels": f"SELECT doc_id, c.field, {low('rx1', 'image_width')} AS px1, {low('ry1', 'image_height')} AS py1, {high('rx2', 'image_width')} AS px2, {high('ry2', 'image_height')} AS py2 FROM ({c}) t JOIN (SELECT * FROM {config_values()}) c ON t.doc_type = c.doc_type WHERE idx = 0",
        "join1_region_center": f"SELECT doc_id, field, idx FROM ({c}) t JOIN (SELECT * FROM {config_values()}) c ON t.doc_type = c.doc_type WHERE (nx1 + nx2) / 2 BETWEEN rx1 AND rx2 AND (ny1 + ny2) / 2 BETWEEN ry1 AND ry2",
        "join1_region_overlap": f"SELECT doc_id, field, idx FROM ({c}) t JOIN (SELECT * FROM {config_values()}) c ON t.doc_type = c.doc_type WHERE {ta} > 0 AND {tc} / {ta} >= 0.5",
        "join1_region_iou": f"SELECT doc_id, field, idx FROM ({c}) t JOIN (SELECT * FROM {config_values()}) c ON t.doc_type = c.doc_type WHERE {tc} / ({ta} + {ra} - {tc}) >= 0.05",
        "join2_anchor": f"{parse_ctes(p, True, False)} SELECT doc_id, field, aidx AS idx, atext AS text FROM anchors",
        "join3_similarity": f"SELECT doc_id, idx, {r6(sim_sql('text', q('Identity Number')), 6)} AS similarity FROM ({c})",
        **{f"join4_anchor_{w}": parse_ctes(p, True, False).replace("FROM cfg WHERE keyword", "FROM (SELECT * REPLACE ('-' AS keyword) FROM cfg WHERE field = 'cnic_number') WHERE keyword" if w == "left" else "FROM cfg WHERE keyword") + f" SELECT doc_id, field, idx FROM beside WHERE way = '{w}'" for w in ("right", "left", "below", "above")},
        "join5_card_strategy": f"{ctes} SELECT doc_id, field, token_indices FROM fields",
        "ord1_reading_order": f"""WITH RECURSIVE seq AS (SELECT doc_id, idx, text, x1, y1 + {ordered_y} AS y1, row_number() OVER (PARTITION BY doc_id ORDER BY y1 + {ordered_y}, idx) AS rn FROM ({c})),
fold AS (SELECT *, y1 AS line_y, 0 AS line FROM seq WHERE rn = 1 UNION ALL SELECT s.*, CASE WHEN abs(s.y1 - f.line_y) > 15 THEN s.y1 ELSE f.line_y END, CASE WHEN abs(s.y1 - f.line_y) > 15 THEN f.line + 1 ELSE f.line END FROM fold f JOIN seq s ON s.doc_id = f.doc_id AND s.rn = f.rn + 1)
SELECT doc_id, string_agg(idx::VARCHAR, ',' ORDER BY line, x1, rn) AS "order", string_agg(text, ' ' ORDER BY line, x1, rn) AS text FROM fold GROUP BY doc_id""",
        "ord3_best_candidate": f"{parsed}, two AS (SELECT doc_id, field, 0 AS variant_ord, {total('ocr_confidence', 'validated')} AS s, confidence FROM v UNION ALL SELECT doc_id, field, 1, {total(other, '(doc_id % 2 = 0)')}, confidence FROM v) SELECT doc_id, field, variant_ord, s AS field_confidence, confidence FROM two QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY s DESC, variant_ord) = 1",
        "ord4_date_ranks": f"SELECT doc_id, count(*)::INT AS n, (list(d ORDER BY substr(d, 7, 4), i))[1] AS first, (list(d ORDER BY substr(d, 7, 4), i))[2] AS second, (list(d ORDER BY substr(d, 7, 4), i))[-1] AS last FROM (SELECT doc_id, d, min(idx) AS i FROM ({dated}) WHERE {has('d', validators.DATE)} GROUP BY ALL) GROUP BY doc_id",
        "ord6_zone_lines": f"SELECT doc_id, max_by(text, idx) FILTER (WHERE {zone} = 1) AS line1, max_by(text, idx) FILTER (WHERE {zone} = 0 AND length(text) > 15) AS line2 FROM ({p}) WHERE contains(text, '<') GROUP BY doc_id",
        "ord7_zone_candidates": f"SELECT doc_id, min_by(text, idx) FILTER (WHERE {zone} = 1) AS line1, min_by(text, idx) FILTER (WHERE length(text) >= 28 AND NOT starts_with(text, 'P<')) AS line2 FROM ({p}) WHERE contains(text, '<') OR length(text) > 20 GROUP BY doc_id",
        "nrm14_bilingual": f"{parsed}, w AS (SELECT doc_id, coalesce(max(value) FILTER (WHERE field = 'name_en'), '') AS ne, coalesce(max(value) FILTER (WHERE field = 'name_ur'), '') AS nu, coalesce(max(value) FILTER (WHERE field = 'father_name_en'), '') AS fe, coalesce(max(value) FILTER (WHERE field = 'father_name_ur'), '') AS fu FROM v GROUP BY doc_id) SELECT doc_id, CASE WHEN ne <> '' OR nu <> '' THEN ne END AS name_en, CASE WHEN ne <> '' OR nu <> '' THEN nu END AS name_ur, CASE WHEN fe <> '' OR fu <> '' THEN fe END AS father_en, CASE WHEN fe <> '' OR fu <> '' THEN fu END AS father_ur FROM w",
        "agg1_provenance": f"{ctes} SELECT doc_id, field, {', '.join(f'coalesce(b{n}, 0.0) AS {n}' for n in (*spatial.PX, *spatial.NORM))} FROM fields",
        "agg3_candidate_score": f"{parsed} SELECT doc_id, field, ({val_conf.format(ok='validated')})::DOUBLE AS validation_confidence, {total('ocr_confidence', 'validated')} AS field_confidence FROM v",
        "agg4_variant_score": f"""WITH g AS (SELECT doc_id, string_agg(text, ' ' ORDER BY idx) AS full_, avg(confidence) AS mean, sum(length(text)) AS chars, count(DISTINCT trunc(ny1 * 20)) AS bands, count(*) AS n FROM ({p}) GROUP BY doc_id), e AS (SELECT *, {entries} AS m FROM g),
s AS (SELECT *, least(1.0, chars / 150.0) AS tc, least(1.0, bands / 6.0) AS fcv, CASE WHEN len(m) > 0 THEN least(1.0, len(m) / 3.0) ELSE 0.4 END AS cs, least(1.0, n / 4.0) AS fs FROM e)
SELECT doc_id, {r6('mean', 4)} AS mean_confidence, {r6('tc', 4)} AS text_coverage, {r6('fcv', 4)} AS expected_field_coverage, {r6('cs', 4)} AS critical_field_score, {r6('fs', 4)} AS format_score, 0.8::DOUBLE AS spatial_score, {r6('greatest(0.0, least(1.0, mean * 0.25 + tc * 0.2 + fcv * 0.25 + cs * 0.2 + fs * 0.1))', 4)} AS total_score, {r6('cs', 4)} AS field_score, array_to_string(m, ';') AS matched_fields FROM s""",
        "agg5_calibrated_confidence": f"SELECT k, {r6('least(1.0, greatest(0.0, CASE WHEN k % 5 = 0 AND k % 2 <> 0 AND k % 3 <> 0 THEN least(raw, 0.4) ELSE raw END))', 2)} AS confidence FROM (SELECT {k} AS k, (({k} % 41 + 60) / 100) * 0.25 + (({k} % 29 + 70) / 100) * 0.15 + CASE WHEN {k} % 2 = 0 THEN 0.35 ELSE 0 END + CASE WHEN {k} % 3 = 0 THEN 0.25 ELSE 0 END - CASE WHEN {k} % 7 = 0 THEN 0.15 ELSE 0 END AS raw FROM customer)",
        "agg7_review_routing": f"""{parsed}, g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE NOT validated) AS bad, {r6('avg(confidence)', 6)} AS mean, flatten(list({reasons} ORDER BY field_ord)) AS why FROM v GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'NEEDS_REVIEW' WHEN bad = 0 AND mean >= 0.9 THEN 'AUTO_ACCEPT' WHEN mean < 0.6 OR bad >= 3 THEN 'AUTO_REJECT' ELSE 'NEEDS_REVIEW' END AS review_state, CASE WHEN doc_id % 10 = 0 THEN 'Low document classification confidence (65%)' WHEN bad = 0 AND mean >= 0.9 THEN 'All critical fields validated with high confidence' ELSE array_to_string(why, '; ') END AS review_reasons FROM g""",
        "agg10_run_summary": f"{parsed}, g AS (SELECT doc_id, count(*) AS f, count(*) FILTER (WHERE validated) AS ok FROM v GROUP BY doc_id) SELECT count(*) AS documents, avg((doc_id % 100)::DOUBLE) AS avg_latency_ms, sum(f)::BIGINT AS total_fields_extracted, avg(ok) AS avg_validated_fields_per_doc, CASE WHEN count(*) = 0 THEN 1.0 END::DOUBLE AS field_precision, CASE WHEN count(*) = 0 THEN 1.0 END::DOUBLE AS field_recall FROM g",
        "val8_cross_field": f"SELECT k, array_to_string(list_filter([CASE WHEN b >= i THEN 'Cross-field warning: Date of birth year (' || b || ') must be before date of issue year (' || i || ')' END, CASE WHEN i >= e THEN 'Cross-field warning: Date of issue year (' || i || ') must be before date of expiry year (' || e || ')' END, CASE WHEN NOT contains('AB1234567', substr(n, 1, 7)) THEN 'Cross-field warning: Visible passport number ''' || n || ''' does not match MRZ line 2 passport segment ''AB1234567''' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM (SELECT {k} AS k, {k} % 40 + 1980 AS b, {k} % 30 + 1990 AS i, {k} % 20 + 1998 AS e, 'AB' || ({k} % 3 + 1234567)::VARCHAR AS n FROM customer)",
        "val10_chronology": f"SELECT {k} AS k, coalesce({iso_day(f'{k} % 40 + 1980', f'{k} % 12 + 1', f'{k} % 31 + 1')} <= {iso_day(f'{k} % 30 + 1990', f'{k} % 11 + 1', f'{k} % 28 + 1')} AND {iso_day(f'{k} % 30 + 1990', f'{k} % 11 + 1', f'{k} % 28 + 1')} <= {iso_day(f'{k} % 20 + 2000', f'{k} % 7 + 1', f'{k} % 27 + 1')}, true) AS in_order FROM customer",
        "pip2_passport_parse": f"{passport_ctes()} SELECT doc_id, field, raw_value, value, validated, confidence FROM last",
        "agg11_reconcile": f"{reconcile_ctes()} SELECT doc_id, field, value, decision, confidence, source, format_valid, checksum_valid, token_indices FROM final",
        "agg8_document_result": f"{reconcile_ctes()} SELECT * FROM result",
        "passport_review_queue": f"""{reconcile_ctes()}, g AS (SELECT doc_id, count(*) FILTER (WHERE NOT validated) AS bad, {r6('avg(confidence)', 6)} AS mean, flatten(list({reasons} ORDER BY field_ord)) AS why_ FROM last GROUP BY doc_id),
st AS (SELECT doc_id, CASE WHEN bad = 0 AND mean >= 0.9 THEN CASE WHEN review_required THEN 'NEEDS_REVIEW' ELSE 'AUTO_ACCEPT' END WHEN mean < 0.6 OR bad >= 3 THEN 'AUTO_REJECT' ELSE 'NEEDS_REVIEW' END AS review_state, status, CASE WHEN bad = 0 AND mean >= 0.9 THEN 'All critical fields validated with high confidence' ELSE array_to_string(why_, '; ') END AS review_reasons, r.review_reasons AS reconcile_reasons FROM g JOIN result r USING (doc_id)) SELECT * FROM st WHERE review_state = 'NEEDS_REVIEW'""",
        "pip1_card_parse": f"{parsed} SELECT doc_id, field, raw_value, value, validated, ocr_confidence, spatial_confidence, confidence, token_indices FROM v",
    }


