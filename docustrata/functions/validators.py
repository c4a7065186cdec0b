"""Validators of single fields, of fields together, and of a document's expected patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docustrata.functions.text import let, strip

# Formats of identifiers, lines and dates.
CARD, PASSPORT, PASSPORT_STRICT, ZONE = r"^[1-7]\d{4}-\d{7}-\d$", r"^[A-Z]{2}\d{7}$|^[A-Z0-9]{8,9}$", r"^[A-Z]{1,3}\d{6,8}$", r"^[A-Z0-9<]{30,}$"
DATE = r"^(\d{2})\.(\d{2})\.(\d{4})$"


def card(c: Column) -> Column:
    return strip(c).rlike(CARD)


def date(c: Column) -> Column:
    """DD.MM.YYYY with day to 31, month to 12 and a year from 1900 to 2100; 31.02. passes. Other texts are not cast: each failing cast costs an exception."""

    def passes(t: Column) -> Column:
        part = lambda at, n: F.substring(t, at, n).cast("int")
        return F.when(t.rlike(DATE), part(1, 2).between(1, 31) & part(4, 2).between(1, 12) & part(7, 4).between(1900, 2100)).otherwise(False)

    return let(strip(c), passes)


def non_empty(c: Column) -> Column:
    return F.length(strip(c)) > 0


def passport(c: Column) -> Column:
    return strip(c).rlike(PASSPORT)


def passport_strict(c: Column) -> Column:
    return strip(c).rlike(PASSPORT_STRICT)


def zone_line(c: Column) -> Column:
    return strip(c).rlike(ZONE)


VALIDATORS = {
    "card": {"cnic_number": card, "cnic": card, "date": date, "text_non_empty": non_empty},
    # a passport's card number is not checked unless strict is asked for
    "passport": {"passport_number": passport, "mrz_line": zone_line, "date": date, "text_non_empty": non_empty},
}


def validated(c: Column, rule: Column, family: str, strict: bool = False) -> Column:
    """By the rule that a column names; an unknown one passes."""
    rules = VALIDATORS[family] | ({"cnic_number": card} if strict else {})
    out = F.when(F.lit(False), F.lit(False))
    for name, build in rules.items():
        out = out.when(rule == name, build(c))
    return out.otherwise(F.lit(True))


def validated_by(c: Column, rule: str | None, family: str, strict: bool = False) -> Column:
    """validated() by a rule that is known when the query is made."""
    rules = VALIDATORS[family] | ({"cnic_number": card} if strict else {})
    return rules[rule](c) if rule in rules else F.lit(True)


def cross_field(birth: Column, issue: Column, expiry: Column, number: Column | None = None, zone2: Column | None = None) -> Column:
    """Warnings of fields that contradict one another, as an array."""
    year = lambda c: F.when(c.rlike(DATE), F.substring(c, 7, 4))
    later = lambda a, b: year(a).try_cast("int") >= year(b).try_cast("int")
    # The warnings' texts.
    found = [
        F.when(later(birth, issue), F.concat(F.lit("Cross-field warning: Date of birth year ("), year(birth), F.lit(") must be before date of issue year ("), year(issue), F.lit(")"))),
        F.when(later(issue, expiry), F.concat(F.lit("Cross-field warning: Date of issue year ("), year(issue), F.lit(") must be before date of expiry year ("), year(expiry), F.lit(")"))),
    ]
    if number is not None and zone2 is not None:
        head = F.substring(zone2, 1, 9)
        off = (F.length(number) >= 7) & (F.length(zone2) >= 9) & ~F.contains(head, F.substring(number, 1, 7))
        found.append(F.when(off, F.concat(F.lit("Cross-field warning: Visible passport number '"), number, F.lit("' does not match MRZ line 2 passport segment '"), head, F.lit("'"))))
    return F.array_compact(F.array(*found))


def chronology(birth: Column, issue: Column, expiry: Column) -> Column:
    """False if three real ISO dates are out of order; true otherwise, also where one isn't a date."""
    b, i, e = (F.try_to_timestamp(c, F.lit("yyyy-MM-dd")) for c in (birth, issue, expiry))
    return F.coalesce((b <= i) & (i <= e), F.lit(True))


# Patterns that a document of each kind is expected to show.
PROFILES = {
    "cnic_front": {
        "cnic_number": r"\b\d{5}[-\s]?\d{7}[-\s]?\d{1}\b",
        "date_of_birth": r"\b\d{2}[\./-]\d{2}[\./-]\d{4}\b",
        "date_of_issue": r"\b\d{2}[\./-]\d{2}[\./-]\d{4}\b",
        "date_of_expiry": r"\b\d{2}[\./-]\d{2}[\./-]\d{4}\b",
    },
    "cnic_back": {"family_number": r"\b\d{6,10}\b", "date_of_issue": r"\b\d{2}[\./-]\d{2}[\./-]\d{4}\b"},
    "passport": {
        "passport_number": r"\b[A-Z]{2}\d{7}\b|\b[A-Z0-9]{8,9}\b",
        "mrz_line1": r"P<PAK[A-Z<]+",
        "mrz_line2": r"[A-Z0-9<]{30,44}",
        "date_of_birth": r"\b\d{2}[\./-]\d{2}[\./-]\d{4}\b|\b\d{6}\b",
        "date_of_expiry": r"\b\d{2}[\./-]\d{2}[\./-]\d{4}\b|\b\d{6}\b",
    },
}


def profile_matches(text: Column, profile: str) -> Column:
    """map of the profile's fields to what matches."""
    entries = [F.struct(F.lit(k), F.nullif(F.regexp_extract(text, p, 0), F.lit(""))) for k, p in PROFILES[profile].items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["col2"].isNotNull()))


def profile_coverage(text: Column, profile: str) -> Column:
    return F.size(F.map_keys(profile_matches(text, profile))) / len(PROFILES[profile])
