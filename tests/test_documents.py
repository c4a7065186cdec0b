"""Small documents with known results, from tokens to the review."""

from pyspark.sql import functions as F

from docustrata import api
from docustrata.operators import parse, reconcile, spatial, variants
from docustrata.plans.fixtures import PLACED
from docustrata.sources import field_config as fc

SCHEMA = "doc_id long, doc_type string, idx int, text string, confidence double, x1 double, y1 double, x2 double, y2 double, image_width int, image_height int"


def tokens(spark, kind, rows, size=(1000, 1000)):
    made = spark.createDataFrame([(1, kind, i, t, c, *map(float, b), *size) for i, (t, c, b) in enumerate(rows)], SCHEMA)
    return spark.sql(PLACED.replace("{tokens}", "SELECT * FROM {t}"), t=made)


CARD = [("محمد احمد", 0.92, (200, 210, 500, 240)), ("MUHAMMAD AHMAD", 0.96, (200, 290, 600, 320)), ("Identity Number:", 0.90, (200, 520, 350, 550)), ("42101-1234567-1", 0.98, (360, 520, 650, 550)), ("15.08.1990", 0.94, (200, 650, 400, 680))]
PASSPORT = [
    ("Passport No:", 0.90, (600, 60, 750, 90)), ("AB1234567", 0.98, (760, 60, 920, 90)), ("Surname", 0.90, (300, 120, 450, 145)), ("KHAN", 0.95, (300, 150, 450, 180)), ("Given Names", 0.90, (300, 185, 450, 210)),
    ("MUHAMMAD ALI", 0.94, (300, 215, 550, 245)), ("P<PAKKHAN<<MUHAMMAD<ALI<<<<<<<<<<<<<<<<<<<<<", 0.99, (50, 800, 950, 840)), ("AB12345674PAK9008154M3001018<<<<<<<<<<<<<<02", 0.98, (50, 880, 950, 920)),
]


def by_field(df):
    return {r.field: r for r in df.collect()}


def test_card(spark):
    f = by_field(parse.parse_cards(tokens(spark, "cnic_front", CARD), fc.field_config(spark)))
    assert len(f) == 8
    number = f["cnic_number"]
    assert (number.raw_value, number.value, number.validated, number.ocr_confidence, number.confidence) == ("Identity Number: 42101-1234567-1", "42101-1234567-1", True, 0.94, 0.925)
    names = parse.bilingual(parse.parse_cards(tokens(spark, "cnic_front", CARD), fc.field_config(spark))).first().name
    assert (names.en, names.ur) == ("MUHAMMAD AHMAD", "محمد احمد")


def test_passport(spark):
    f = by_field(parse.parse_passports(tokens(spark, "passport", PASSPORT), fc.field_config(spark)))
    assert {k: (f[k].value, f[k].validated) for k in ("passport_number", "surname", "given_names")} == {"passport_number": ("AB1234567", True), "surname": ("KHAN", True), "given_names": ("MUHAMMAD ALI", True)}


def test_anchor_directions(spark):
    t = tokens(spark, "passport", [("Identity Number:", 0.9, (100, 200, 300, 230)), ("42101-1234567-1", 0.9, (320, 200, 600, 230)), ("Unrelated", 0.9, (100, 500, 250, 530)), ("15.08.1990", 0.9, (100, 240, 300, 270))])
    words = spark.createDataFrame([("passport", "n", "Identity Number", "right"), ("passport", "b", "Identity Number", "below"), ("passport", "l", "42101", "left"), ("passport", "a", "15.08", "above")], "doc_type string, field string, keyword string, direction string")
    hits = spatial.around_anchors(t, spatial.anchors(t, words)).select("field", "idx").collect()
    assert sorted((r.field, r.idx) for r in hits) == [("a", 0), ("b", 3), ("l", 0), ("l", 3), ("n", 1)]


def test_reading_order(spark):
    rows = [("e", 0.9, (10, 200, 20, 210)), ("b", 0.9, (200, 100, 300, 130)), ("a", 0.9, (50, 100, 150, 130)), ("d", 0.9, (50, 124, 60, 130)), ("c", 0.9, (300, 112, 400, 130))]
    order = tokens(spark, "passport", rows).agg(spatial.reading_order(F.collect_list(F.struct("idx", "text", "x1", "y1"))).alias("o")).first().o
    assert [x.text for x in order] == ["a", "b", "c", "d", "e"]


def test_regression_document(spark):
    """A spatial candidate that took the birth date for the date of issue gives way to the date that is left."""
    t = tokens(
        spark,
        "passport",
        [("PASSPORT", 0.99, (100, 50, 300, 90)), ("JAVED", 0.96, (300, 120, 500, 160)), ("AKHTER", 0.97, (300, 180, 500, 220)), ("07APR1966", 0.88, (300, 270, 550, 310)), ("23JUL2019", 0.92, (300, 450, 550, 490)), ("22JUL2029", 0.95, (300, 520, 550, 560)),
         ("P<PAKJAVED<<AKHTER<<<<<<<<<<<<<<<<<<<<<<<<<<", 0.99, (50, 800, 950, 840)), ("AG86775647PAK6604071M29072243740616247565<18", 0.99, (50, 850, 950, 890))],
        (2000, 1407),
    )
    c = [("surname", "JAVED", "JAVED", 0.96, 0.90, 1), ("given_names", "AKHTER", "AKHTER", 0.97, 0.90, 2), ("date_of_birth", "07.04.1966", "07APR1966", 0.88, 0.85, 3), ("date_of_issue", "07.04.1966", "07APR1966", 0.70, 0.60, 3), ("date_of_expiry", "22.07.2029", "22JUL2029", 0.95, 0.90, 5), ("passport_number", "AG8677564", "AG8677564", 0.98, 0.95, 7)]
    cands = spark.createDataFrame([(1, f, v, r, o, s, [i]) for f, v, r, o, s, i in c], "doc_id long, field string, value string, raw_value string, ocr_confidence double, spatial_confidence double, token_indices array<int>")
    zone = spark.createDataFrame([(1, {"passport_number": "AG8677564", "surname": "JAVED", "given_names": "AKHTER", "date_of_birth": "660407", "date_of_expiry": "290722"})], "doc_id long, zone map<string,string>")
    docs = spark.createDataFrame([(1, "passport")], "doc_id long, document_type string")
    final = reconcile.reconcile(docs, cands, zone, t)
    got = {r.field: (r.value, r.decision, r.confidence) for r in final.collect()}
    assert got == {
        "surname": ("JAVED", "ACCEPT", 0.98), "given_names": ("AKHTER", "ACCEPT", 0.98), "date_of_birth": ("1966-04-07", "ACCEPT", 0.95), "date_of_issue": ("2019-07-23", "ACCEPT", 0.72),
        "date_of_expiry": ("2029-07-22", "ACCEPT", 0.97), "passport_number": ("AG8677564", "ACCEPT", 0.99), "father_name": (None, "UNKNOWN", 0.30), "cnic_number": (None, "UNKNOWN", 0.30),
    }
    assert reconcile.document_result(final).first().status == "success"


def test_variant_score(spark):
    v = variants.score_variants(tokens(spark, "passport", PASSPORT)).first()
    assert "mrz_line1" in v.matched_fields and v.matched_fields["passport_number"] == "AB1234567" and v.total_score > 0.7


def test_extract_mixes_types(spark):
    both = tokens(spark, "x", CARD + [("Name", 0.9, (10, 10, 20, 20)), ("IDENTITY NUMBER", 0.9, (10, 30, 20, 40))]).unionByName(tokens(spark, "x", PASSPORT).withColumn("doc_id", F.lit(2).cast("long")))
    got = api.extract(both)
    assert {(r.doc_id, r.document_type) for r in got["result"].collect()} == {(1, "cnic_front"), (2, "passport")}
    assert got["review"].count() == 2


def test_second_pass(spark):
    """A crop of the number reads what the page blurred; a crop that says nothing, or of another field, changes nothing."""
    c = fc.field_config(spark)
    page = tokens(spark, "cnic_front", [("4210l-1234567-1", 0.61, (360, 520, 650, 550)), ("15.08.1990", 0.94, (200, 650, 400, 680))])
    first = parse.parse_cards(page, c)
    assert not by_field(first)["cnic_number"].validated
    crops = spark.createDataFrame([(1, "roi_a", "cnic_number", 200.0, 500.0, 1000, 1000), (1, "roi_b", "date_of_birth", 190.0, 640.0, 1000, 1000)], "doc_id long, variant string, field string, left double, top double, page_width int, page_height int")
    shape = "doc_id long, doc_type string, variant string, idx int, text string, confidence double, x1 double, y1 double, x2 double, y2 double, image_width int, image_height int"
    read = spark.createDataFrame([(1, "cnic_front", "roi_a", 0, "42101-1234567-1", 0.97, 160.0, 20.0, 450.0, 50.0, 650, 130)], shape)
    got = by_field(parse.second_pass(first, read, crops, lambda t: parse.parse_cards(t, c)))
    assert (got["cnic_number"].value, got["cnic_number"].validated, got["cnic_number"].ocr_confidence, got["cnic_number"].bbox) == ("42101-1234567-1", True, 0.97, [360.0, 520.0, 650.0, 550.0])
    assert got["date_of_birth"].value == "15.08.1990" and len(got) == 8
    both = tokens(spark, "x", CARD + [("Name", 0.9, (10, 10, 20, 20)), ("IDENTITY NUMBER", 0.9, (10, 30, 20, 40))])
    assert {r.field: r.value for r in api.extract(both, crop_tokens=read, crops=crops)["fields"].collect()}["cnic_number"] == "42101-1234567-1"


def test_evidence_and_prompt(spark):
    import json

    from docustrata.operators import evidence

    t = tokens(spark, "passport", [("PASSPORT", 0.98, (10, 10, 100, 30)), ("07APR1966", 0.88, (200, 300, 400, 350)), ("23JUL2019", 0.91, (200, 400, 400, 450)), ("22JUL2029", 0.95, (200, 500, 400, 550)),
                               ("P<PAKJAVED<<AKHTER<<<<<<<<<<<<<<<<<<<<<<<<<<", 0.9, (10, 600, 900, 620)), ("AG86775647PAK6604071M29072243740616247565<18", 0.9, (10, 640, 900, 660))], (2000, 1407))
    c = parse.parse_passports(t, fc.field_config(spark))
    seen = spark.createDataFrame([(1, 0.91234, 123.456)], "doc_id long, overall_score double, blur_score double")
    made = evidence.evidence(t, c, parse.zone_candidates(t), seen, spark.createDataFrame([(1, False)], "doc_id long, detected boolean"))
    e = made.first().evidence
    assert e.document_type == "passport" and [x.text for x in e.ocr_tokens][:2] == ["PASSPORT", "07APR1966"] and e.mrz.parsed["passport_number"] == "AG8677564"
    assert e.document_geometry.asDict() == {"canonical_width": 2000, "canonical_height": 1407, "perspective_corrected": False, "deskewed": True}
    assert (e.quality.overall_score, e.quality.blur_score, e.quality.contrast_score) == (0.9123, 123.46, 0.6) and all(e.mrz.checks)
    p = evidence.prompts(made).first()
    payload = json.loads(p.user_prompt.split("```json\n")[1].split("\n```")[0])
    assert payload["document_schema"]["critical_fields"] == ["passport_number", "surname", "given_names", "date_of_birth", "date_of_expiry"] and payload["document_schema"]["fields"]["father_name"]["authoritative_sources"] == ["visual_ocr"]
    assert payload["candidate_fields"]["passport_number"]["candidate_value"] == "AG8677564" and "JSON" in p.system_prompt
    assert [evidence.Reasoner(x).temperature for x in (-1, 0.1, 2)] == [0.0, 0.1, 0.2]
    asked = []
    rules = spark.range(1)
    assert evidence.Reasoner().reconcile(made, rules) is rules and evidence.Reasoner(0.9, lambda q, x: asked.append((q.count(), x)) or rules).reconcile(made, rules) is rules and asked == [(1, 0.2)]


def test_variant_without_boxes(spark):
    lines = tokens(spark, "passport", PASSPORT).withColumn("ny1", F.lit(None).cast("double"))
    assert variants.score_variants(lines.where("idx < 2")).first().expected_field_coverage == 0.4 and variants.score_variants(lines).first().field_score == 0.6667  # two of three matches


def test_no_tokens_no_rows(spark):
    empty = tokens(spark, "passport", PASSPORT).where("false")
    assert parse.parse_passports(empty, fc.field_config(spark)).count() == 0


def test_tokens_of_passports_are_not_moved(spark):
    """Keys are dealt before their tokens are derived, and what follows stays in a document's row."""
    from docustrata.plans import queries

    plan = queries.queries()["agg11_reconcile"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(o_orderkey" in plan and "hashpartitioning(doc_id" not in plan


def largest_method(df):
    """Bytes of the largest method among the code of a query's whole stages, which adaptive execution makes as it runs."""
    df.collect()
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length()))


def test_code_of_label_keys_is_compiled(spark):
    """The JIT compiler leaves methods over 8,000 bytes to the interpreter, which is many times slower."""
    from docustrata.plans import fixtures

    assert largest_method(spatial.with_keys(fixtures.passport_pages(spark, "/root/testdata/sf0.001"), "text")) < 8000


def test_dates_are_checked(spark):
    """Only what is a date is cast; 31.02. passes."""
    from docustrata.functions import validators

    given = [" 31.02.1999\n", "01.13.1999", "32.01.1999", "01.01.1899", "01.01.2101", "1.1.1999", "", "Name", None]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", validators.date(F.col("t")).alias("ok"))
    assert [r.ok for r in made.orderBy("i").collect()] == [True] + [False] * 8


def optimized(spark, name):
    from docustrata.plans import queries

    return queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_labels_and_rules_are_compiled(spark):
    """Labels are found while tokens are grouped, rules of fields are literals, and boxes that reconciliation doesn't use aren't made."""
    plan = optimized(spark, "agg11_reconcile")
    assert "min(CASE WHEN" in plan and "below =" not in plan and "bbox" not in plan


def test_labels_found_in_groups(spark):
    """The same tokens as the search on a page: contained before similar, more similar before less, then by index; none."""
    t = tokens(spark, "passport", [("Surnme", 0.9, (0, 0, 1, 1)), ("Given Nanes", 0.9, (0, 2, 1, 3)), ("  surname: ", 0.9, (0, 4, 1, 5)), ("Given Names", 0.9, (0, 6, 1, 7)), ("Surname", 0.9, (0, 8, 1, 9)), ("Dats of Birht", 0.9, (0, 9, 1, 10)), (None, 0.9, (0, 11, 1, 12))])
    keys = spatial.keys_of(spark, ["Surname", "Given Names", "Date of Birth", "XQZ"])
    found = spatial.labelled_pages(t, {f"l{i}": k for i, k in enumerate(keys.values())}).first()
    page = spatial.pages(t)
    old = page.select(*(spatial.anchor_in(F.col("page"), k["low"], k["word"], k["set"])["idx"].alias(f"l{i}") for i, k in enumerate(keys.values()))).first()
    assert [found[f"l{i}"] and found[f"l{i}"].idx for i in range(4)] == list(old) == [2, 3, 5, None]


def test_config_of_several_types(spark):
    """Each type is parsed by its own fields; documents of a type without any have no row."""
    c = fc.field_config(spark).where("doc_type = 'passport'")
    two = c.unionByName(c.where("field in ('surname', 'given_names')").withColumn("doc_type", F.lit("visa")))
    t = tokens(spark, "passport", PASSPORT)
    every = t.unionByName(t.withColumns({"doc_id": F.lit(2).cast("long"), "doc_type": F.lit("visa")})).unionByName(t.withColumns({"doc_id": F.lit(3).cast("long"), "doc_type": F.lit("other")}))
    got = {(r.doc_id, r.field): r.value for r in parse.parse_passports(every, two).collect()}
    assert len(got) == 10 and got[2, "surname"] == got[1, "surname"] == "KHAN" and {d for d, _ in got} == {1, 2}
    assert parse.parse_passports(t, two.where("field = 'none'")).count() == 0


def test_prompt_is_read_once(spark):
    """agg13 takes what it tells from one pass over the payload, not from one for each column."""
    plan = optimized(spark, "agg13_prompt")
    assert "json_tuple(payload" in plan and "get_json_object(payload" not in plan


def test_strip_ends_at_the_end(spark):
    """White space before a last line separator isn't at the end: `$` of Java matches there, that of the SQL doesn't."""
    from docustrata.functions import text

    given = [" a \u0085", "\t\n\x0b\f\r a b\r\n ", "   ", "", None]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", text.strip(F.col("t")).alias("s"))
    assert [r.s for r in made.orderBy("i").collect()] == ["a \u0085", "a b", "", "", None]
