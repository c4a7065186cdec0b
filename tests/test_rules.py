"""Known values of scalar rules, and properties that hold for all texts."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docustrata.functions import geometry, mrz, redact, scoring, text, validators

ONCE = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "s string").select(build(F.col("s")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("rule", "given_", "want"),
    [
        (text.card_number, "12345 1234567 1", "12345-1234567-1"),
        (text.date_text, "15/08/1990", "15.08.1990"),
        (text.date_text, "ssteafBirt 07APR1966", "07.04.1966"),
        (text.date_text, "23 JUL 2019", "23.07.2019"),
        (text.passport_number, "ab1234567", "AB1234567"),
        (text.father_name, "SAFDER, GHULAM", "GHULAM SAFDER"),
        (text.father_name, "SAFDER , GHULAM", "GHULAM SAFDER"),
        (text.father_name, "Father Name SAFDER, GHULAM", "GHULAM SAFDER"),
        (text.father_name, "SAFDER GHULAM", "SAFDER GHULAM"),
        (text.strip_label_noise, "NAMEER", "ER"),
        (text.iso_date, "07APR1966", "1966-04-07"),
        (text.iso_date, "07.04.1966", "1966-04-07"),
        (text.iso_date, "660407", "1966-04-07"),
        (text.iso_date, "290722", "2029-07-22"),
        (text.format_card, "3740616247565", "37406-1624756-5"),
        (text.script, "محمد", "urdu"),
        (text.script, "", "unknown"),
        (validators.card, "42101-1234567-1", True),
        (validators.card, "invalid", False),
        (validators.date, "99.99.9999", False),
        (validators.date, "31.02.2000", True),
        (validators.zone_line, "P<PAKKHAN<<MUHAMMAD<ALI<<<<<<<<<<<<<<<<<<<<<", True),
        (mrz.check_digit, "AB1234567", 1),
        (mrz.check_digit, "900815", 7),
        (mrz.check_digit, "300101", 9),
        (mrz.check_digit, "AG8677564", 3),
    ],
)
def test_known(spark, rule, given_, want):
    assert one(spark, given_, rule) == want


def test_zone(spark):
    got = one(spark, "AG86775647PAK6604071M29072243740616247565<18", mrz.line2)
    assert got.asDict() == {"passport_number": "AG8677564", "date_of_birth": "07.04.1966", "date_of_expiry": "22.07.2029", "cnic_number": "37406-1624756-5"}


def test_redaction(spark):
    got = one(spark, "Customer CNIC is 37406-1624756-5 and DOB is 07.04.1966 with Passport AG8677564.", redact.redact_text)
    assert got == "Customer CNIC is [REDACTED_CNIC] and DOB is [REDACTED_DATE] with Passport [REDACTED_PASSPORT]."


def test_confidences(spark):
    rows = [(0.96, 0.90, True, True, True, 0.98), (0.97, 0.90, True, True, True, 0.98), (0.88, 0.85, True, True, True, 0.95), (0.92, 0.90, True, False, False, 0.72), (0.70, 0.80, False, False, False, 0.30)]
    df = spark.createDataFrame(rows, "o double, s double, v boolean, m boolean, c boolean, want double")
    assert df.where(scoring.calibrated(F.col("o"), F.col("s"), F.col("v"), F.col("m"), F.col("c")) != F.col("want")).count() == 0


def test_homography(spark):
    m = [F.lit(float(x)) for x in (2, 0, 10, 0, 2, 20, 0, 0, 1)]
    there = geometry.transform_point(m, F.lit(100.0), F.lit(100.0))
    back = geometry.transform_point(geometry.inverse(m), *there)
    assert tuple(spark.range(1).select(*there, *back).first()) == (210.0, 220.0, 100.0, 100.0)


def test_overlap(spark):
    a, b = [F.lit(x) for x in (0.2, 0.2, 0.4, 0.4)], [F.lit(x) for x in (0.0, 0.0, 0.5, 0.5)]
    assert spark.range(1).select(geometry.overlap(a, b)).first()[0] == pytest.approx(1.0)


@ONCE
@given(st.lists(st.text(max_size=40), min_size=20, max_size=40))
def test_rules_settle_and_hide(spark, texts):
    """Normalising twice is normalising once, and nothing redacted is found again."""
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for rule in (text.card_number, text.passport_number, text.digits_only, text.mrz_text):
        assert df.where(rule(rule(F.col("s"))) != rule(F.col("s"))).count() == 0
    hidden = redact.redact_text(F.col("s"))
    assert df.where(F.array_contains(F.array(*(hidden.rlike(p) for p, _ in redact.PATTERNS)), True)).count() == 0


def test_nulls_stay(spark):
    df = spark.createDataFrame([(None,)], "s string")
    for rule in (text.card_number, text.date_text, text.father_name, text.passport_number, text.iso_date, redact.mask, redact.redact_text):
        assert df.select(rule(F.col("s"))).first()[0] is None


def test_sanitize_lists_and_groups(spark):
    from pyspark.sql import Row

    made = spark.createDataFrame([Row(k=1, tags=["card 37406-1624756-5", "plain"], numbers=[5, 6], raw_value=["Jane Doe"], name=Row(en="Jane AB1234567", age=7), rows=[Row(surname="DOE AB1234567", note="AB1234567")], passport_number=9, notes={"name": "AB1234567", "other": "AB1234567"})])
    r = redact.sanitize(made).first()
    assert r.tags == ["card [REDACTED_CNIC]", "plain"] and r.numbers == ["5", "6"] and r.raw_value == "[REDACTED_PII]" and r.passport_number == "[REDACTED_PII]"
    assert r.name == Row(en="Jane [REDACTED_PASSPORT]", age="7") and r.rows == [Row(surname="DOE [REDACTED_PASSPORT]", note="AB1234567")]
    assert r.notes == {"name": "[REDACTED_PASSPORT]", "other": "AB1234567"} and r.k == 1


def test_mask_filter(caplog):
    import logging

    log = logging.getLogger("docustrata.test")
    log.addFilter(redact.MaskFilter())
    log.warning("card 37406-1624756-5 of AG8677564")
    assert caplog.messages == ["card *****-*******-5 of AG*******"]
