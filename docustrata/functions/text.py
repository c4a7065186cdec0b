"""Normalisation of recognised text: labels, identifiers, dates, names, scripts.

Rules are Column -> Column and stay inside code generation. An empty string is a
value at this stage and stays one; null stays null. Regular expressions are
ASCII unless a rule says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes that labels leave before a value, in the order they are removed.
LABEL_PREFIXES = (
    r"date\s*of\s*birth",
    r"date\s*of\s*issue",
    r"date\s*of\s*expiry",
    r"ssteafbirt",
    r"surname",
    r"given\s*names",
    r"given\s*name",
    r"passport\s*no",
    r"nationality",
    r"type",
    r"country\s*code",
    r"identity\s*no",
    r"father\s*name",
    r"name",
)

# Words that are noise in a passport's fields.
NOISE_WORDS = (
    "RAWALPINDI", "ISLAMABAD", "LAHORE", "KARACHI", "PESHAWAR", "QUETTA", "PAK", "PAKISTANI", "PASSPORT", "ISSI", "AUTHORITY", "NATIONALITY", "NATICNALLY", "NATICKALLY", "NATICNALITY",
    "TYPE", "COUNTRY", "CODE", "NAME", "SURNAME", "GIVEN", "NAMES", "FATHER", "HUSBAND", "DATE", "BIRTH",
)

# Month abbreviations.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

CARD = r"\b\d{5}[-\s]?\d{7}[-\s]?\d\b"


def strip(c: Column) -> Column:
    """Drops all white space at the ends, not spaces alone; without a regular expression, which would search the whole text."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def rounded(c: Column, digits: int) -> Column:
    """Half up on six decimals: the same in every engine."""
    return F.round(c.cast("decimal(18,6)"), digits).cast("double")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often and in however many branches body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_label_noise(c: Column) -> Column:
    """A text that begins with none of the prefixes has none to remove, and is trimmed alone."""

    def removed(t: Column) -> Column:
        out = t
        for p in LABEL_PREFIXES:
            out = strip(F.regexp_replace(out, f"(?i)^{p}", ""))
        return F.when(t.rlike(f"(?i)^({'|'.join(LABEL_PREFIXES)})"), out).otherwise(t)

    return let(strip(c), removed)


def card_form(digits: Column) -> Column:
    """5-7-1 of thirteen digits."""
    return F.concat_ws("-", F.substring(digits, 1, 5), F.substring(digits, 6, 7), F.substring(digits, 13, 1))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def card_number(c: Column) -> Column:
    found = F.regexp_extract(c, CARD, 0)
    every = digits_only(c)
    return F.when(found != "", card_form(digits_only(found))).when(F.length(every) == 13, card_form(every)).otherwise(strip(c))


def month_number(c: Column) -> Column:
    """01..12, or null for another word, which is evaluated once."""
    return F.try_element_at(F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}"))), F.upper(c))


def date_text(c: Column) -> Column:
    """DD.MM.YYYY where a date is found, else the text without labels; no calendar is asked."""
    return let(strip_label_noise(c), _dotted)


def _dotted(t: Column) -> Column:
    # Dates with a month's name, day first, year first.
    alpha, dmy, ymd = r"\b(\d{1,2})[\s./-]*([A-Za-z]{3})[\s./-]*(\d{4})\b", r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b", r"\b(\d{4})[./-](\d{1,2})[./-](\d{1,2})\b"
    g = lambda p, i: F.regexp_extract(t, p, i)
    two = lambda x: F.lpad(x, 2, "0")
    month = month_number(g(alpha, 2))
    return (
        F.when(month.isNotNull(), F.concat_ws(".", two(g(alpha, 1)), month, g(alpha, 3)))
        .when(g(dmy, 0) != "", F.concat_ws(".", two(g(dmy, 1)), two(g(dmy, 2)), g(dmy, 3)))
        .when(g(ymd, 0) != "", F.concat_ws(".", two(g(ymd, 3)), two(g(ymd, 2)), g(ymd, 1)))
        .otherwise(t)
    )


def father_name(c: Column) -> Column:
    """`SURNAME, GIVEN` becomes `GIVEN SURNAME`; further parts are dropped."""
    return let(strip_label_noise(c), _inverted)


def _inverted(t: Column) -> Column:
    parts = F.filter(F.transform(F.split(t, ","), strip), lambda p: p != "")
    return F.when(t.contains(",") & (F.size(parts) >= 2), F.upper(F.concat_ws(" ", F.get(parts, 1), F.get(parts, 0)))).otherwise(F.upper(t))


def passport_number(c: Column) -> Column:
    up = F.upper(c)
    found = F.regexp_extract(up, r"\b[A-Z]{1,3}\d{6,8}\b", 0)
    return F.when(found != "", found).otherwise(F.regexp_replace(up, r"[^\w]", ""))


def mrz_text(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"[^A-Z0-9<]", "")


NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "cnic": card_number,
    "date": date_text,
    "passport_number": passport_number,
    "father_name": father_name,
    "father_name_invert": father_name,
    "digits_only": digits_only,
    "uppercase": lambda c: strip(F.upper(strip_label_noise(c))),
    "uppercase_mrz": mrz_text,
    "uppercase_alphanumeric": lambda c: strip(F.upper(F.regexp_replace(strip_label_noise(c), r"[^\w\s]", ""))),
}


def normalized(c: Column, rule: Column, rules: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The rule that a column names; an unknown one trims. Adding a rule is adding a builder to the dict."""
    out = F.when(c == "", F.lit(""))
    for name, build in (rules or NORMALIZERS).items():
        out = out.when(rule == name, build(c))
    return out.otherwise(strip(c))


def normalized_by(c: Column, rule: str | None) -> Column:
    """normalized() by a rule that is known when the query is made."""
    return F.when(c == "", F.lit("")).otherwise(NORMALIZERS.get(rule, strip)(c))


def without_noise(c: Column) -> Column:
    """Noise words are whole words and none is part of another's boundary, so one alternation removes what removing each in turn does."""
    words = "|".join(NOISE_WORDS)
    return strip(F.regexp_replace(strip(F.regexp_replace(c, rf"(?i)\b({words})\b", "")), r"\s+", " "))


def century(yy: Column) -> Column:
    """The year of two digits, over 30 in the last century."""
    return F.concat(F.when(yy.try_cast("int") > 30, "19").otherwise("20"), yy)


def iso_date(c: Column) -> Column:
    """YYYY-MM-DD, or null if no date is found anywhere in the text."""
    return let(F.upper(strip(c)), _iso)


def _iso(t: Column) -> Column:
    # Dates with a month's name, day first, year first.
    alpha, dmy, ymd = r"(\d{1,2})[-\s]?([A-Z]{3})[-\s]?(\d{4})", r"(\d{1,2})[\.\/\-](\d{1,2})[\.\/\-](\d{4})", r"(\d{4})[\.\/\-](\d{1,2})[\.\/\-](\d{1,2})"
    g = lambda p, i: F.regexp_extract(t, p, i)
    two = lambda x: F.lpad(x, 2, "0")
    month = month_number(g(alpha, 2))
    return (
        F.when(month.isNotNull(), F.concat_ws("-", g(alpha, 3), month, two(g(alpha, 1))))
        .when(g(dmy, 0) != "", F.concat_ws("-", g(dmy, 3), two(g(dmy, 2)), two(g(dmy, 1))))
        .when(g(ymd, 0) != "", F.concat_ws("-", g(ymd, 1), two(g(ymd, 2)), two(g(ymd, 3))))
        .when(t.rlike(r"^\d{6}$"), F.concat_ws("-", century(F.substring(t, 1, 2)), F.substring(t, 3, 2), F.substring(t, 5, 2)))
    )


def format_card(c: Column) -> Column:
    every = digits_only(c)
    return F.when(F.length(every) == 13, card_form(every)).when(c.rlike(r"^\d{5}-\d{7}-\d$"), c)


def script(c: Column) -> Column:
    urdu, latin, digit = c.rlike(r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{8A00}-\x{8D03}]"), c.rlike(r"[A-Za-z]"), c.rlike(r"\d")
    return F.when(urdu & latin, "mixed").when(urdu, "urdu").when(latin, "latin").when(digit, "numeric").otherwise("unknown")


def repair_digits(c: Column) -> Column:
    """Letters that OCR-B digits are taken for."""
    # The letters and their digits.
    return F.translate(c, "OQILZSBG", "00112586")


def comma_name(c: Column, surname: Column, given: Column) -> Column:
    """`W1, W2` as `W2 W1` unless one of them is the surname or given name; null without."""
    p = r"\b([A-Z]{3,})\s*,\s*([A-Z]{3,})\b"
    a, b = F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2)
    known = lambda w: (w == F.coalesce(surname, F.lit(""))) | (w == F.coalesce(given, F.lit("")))
    return F.when((a != "") & ~known(a) & ~known(b), F.concat_ws(" ", b, a))


def label_default(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
