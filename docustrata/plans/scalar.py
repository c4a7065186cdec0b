"""Queries of the scalar rules, each over every derived text, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.functions import mrz, redact, text, validators
from docustrata.operators import classify
from docustrata.plans import fixtures

#: Name to the columns it adds to (k, s).
RULES: dict[str, Callable[[Column], dict[str, Column]]] = {
    "nrm1_strip_label": lambda s: {"v": text.strip_label_noise(s)},
    "nrm2_card_number": lambda s: {"v": text.card_number(s)},
    "nrm3_date": lambda s: {"v": text.date_text(s)},
    "nrm4_father_name": lambda s: {"v": text.father_name(s)},
    "nrm5_passport_number": lambda s: {"v": text.passport_number(s)},
    "nrm6_digits_only": lambda s: {"v": text.digits_only(s)},
    "nrm7_mrz_upper": lambda s: {"v": text.mrz_text(s)},
    "nrm8_dispatch": lambda s: {"v": text.normalized(s, F.element_at(F.array(*map(F.lit, ("cnic", "digits_only", "uppercase", "none"))), (F.col("k") % 4 + 1).cast("int")))},
    "nrm9_noise_words": lambda s: {"v": text.without_noise(s)},
    "nrm10_iso_date": lambda s: {"v": text.iso_date(s)},
    "nrm11_format_card": lambda s: {"v": text.format_card(s)},
    "nrm12_script": lambda s: {"v": text.script(s)},
    "nrm13_repair_digits": lambda s: {"v": text.repair_digits(s)},
    "nrm15_comma_name": lambda s: {"v": text.comma_name(s, F.lit("X"), F.lit("Y"))},
    "nrm16_label_default": lambda s: {"v": text.label_default(F.concat(F.lit("date_of_birth_"), F.lower(F.regexp_replace(s, "[^A-Za-z]", ""))))},
    "mrz1_line1": lambda s: {"surname": mrz.line1(s)["surname"], "given_names": mrz.line1(s)["given_names"]},
    "mrz2_line2": lambda s: {n: mrz.line2(s)[n] for n in ("passport_number", "date_of_birth", "date_of_expiry", "cnic_number")},
    "mrz3_zone_token": lambda s: {"v": mrz.is_zone(s)},
    "mrz4_check_digit": lambda s: {"v": mrz.check_digit(s)},
    "mrz5_checks": lambda s: {n: mrz.checks(s)[n] for n in ("valid", "number_ok", "birth_ok", "expiry_ok")},
    "val1_card": lambda s: {"v": validators.card(s)},
    "val2_date": lambda s: {"v": validators.date(text.date_text(s))},
    "val3_non_empty": lambda s: {"v": validators.non_empty(s)},
    "val4_passport": lambda s: {"v": validators.passport(s)},
    "val5_passport_strict": lambda s: {"v": validators.passport_strict(s)},
    "val6_zone_line": lambda s: {"v": validators.zone_line(s)},
    "val7_dispatch": lambda s: {"v": validators.validated(s, F.element_at(F.array(*map(F.lit, ("cnic", "date", "text_non_empty", "other"))), (F.col("k") % 4 + 1).cast("int")), "card")},
    "val9_profile": lambda s: {"matched": F.array_join(F.array_sort(F.map_keys(validators.profile_matches(s, "passport"))), ","), "coverage": text.rounded(validators.profile_coverage(s, "passport"), 4)},
    "prv1_redact": lambda s: {"v": redact.redact_text(s)},
    "prv3_mask_card": lambda s: {"v": redact.mask_card(s)},
    "prv4_mask_passport": lambda s: {"v": redact.mask_passport(s)},
    "prv5_mask": lambda s: {"v": redact.mask(s)},
    "agg6_classify": lambda s: {n: classify.classified(s)[n] for n in ("document_type", "confidence", "method")},
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def one(build: Callable[[Column], dict[str, Column]]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fixtures.samples(spark, sf_dir).select("k", *(c.alias(n) for n, c in build(F.col("s")).items()))

    return {name: one(build) for name, build in RULES.items()}


# SQL, written against DuckDB's functions.
def q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def sub(e: str, p: str, to: str = "") -> str:
    return f"regexp_replace({e}, {q(p)}, {q(to)}, 'g')"


def get(e: str, p: str, i: int = 0) -> str:
    return f"regexp_extract({e}, {q(p)}, {i})"


def has(e: str, p: str) -> str:
    return f"regexp_matches({e}, {q(p)})"


def card(e: str) -> str:
    return f"(substr({e}, 1, 5) || '-' || substr({e}, 6, 7) || '-' || substr({e}, 13, 1))"


def labels(e: str) -> str:
    out = strip(e)
    for p in text.LABEL_PREFIXES:
        out = strip(f"regexp_replace({out}, '(?i)^{p}', '')")
    return out


def month(e: str) -> str:
    return "CASE upper(" + e + ") " + " ".join(f"WHEN '{m}' THEN '{i:02d}'" for i, m in enumerate(text.MONTHS, 1)) + " END"


def date_sql(t: str, alpha: str, dmy: str, ymd: str, order: str, sep: str, rest: str) -> str:
    """order: the places of year, month and day in the result."""

    def put(y: str, m: str, d: str) -> str:
        parts = {"y": y, "m": m, "d": d}
        return f" || '{sep}' || ".join(parts[x] for x in order)

    two = lambda x: f"lpad({x}, 2, '0')"
    return (
        f"CASE WHEN {month(get(t, alpha, 2))} IS NOT NULL THEN {put(get(t, alpha, 3), month(get(t, alpha, 2)), two(get(t, alpha, 1)))}"
        f" WHEN {has(t, dmy)} THEN {put(get(t, dmy, 3), two(get(t, dmy, 2)), two(get(t, dmy, 1)))}"
        f" WHEN {has(t, ymd)} THEN {put(get(t, ymd, 1), two(get(t, ymd, 2)), two(get(t, ymd, 3)))} {rest} END"
    )


PARSER_DATES = (r"\b(\d{1,2})[\s./-]*([A-Za-z]{3})[\s./-]*(\d{4})\b", r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b", r"\b(\d{4})[./-](\d{1,2})[./-](\d{1,2})\b")
ISO_DATES = (r"(\d{1,2})[-\s]?([A-Z]{3})[-\s]?(\d{4})", r"(\d{1,2})[\.\/\-](\d{1,2})[\.\/\-](\d{4})", r"(\d{4})[\.\/\-](\d{1,2})[\.\/\-](\d{1,2})")


def zone1_sql(t: str) -> dict[str, str]:
    """Of a first line t, in upper case and without spaces."""
    body = f"regexp_replace(regexp_replace({t}, '^P<[A-Z]{{3}}', ''), '^P<', '')"
    name = lambda i: f"CASE WHEN contains({t}, 'P<') AND len(string_split({body}, '<<')) >= 2 THEN nullif(trim(translate(string_split({body}, '<<')[{i}], '<', ' ')), '') END"
    return {"surname": name(1), "given_names": name(2)}


def zone2_sql(t: str) -> dict[str, str]:
    """Of a second line t, in upper case and with word characters and fillers alone."""
    repair = lambda e: f"translate({e}, 'OQILZSBG', '00112586')"
    birth, expiry, personal, number = repair(f"substr({t}, 14, 6)"), repair(f"substr({t}, 22, 6)"), sub(repair(f"substr({t}, 29)"), r"\D"), sub(f"substr({t}, 1, 9)", "<")
    return {
        "passport_number": f"CASE WHEN length({t}) >= 28 AND {has(number, '^[A-Z0-9]{7,9}$')} THEN {number} END",
        "date_of_birth": f"CASE WHEN length({t}) >= 28 AND {has(birth, r'^\d{6}$')} THEN substr({birth}, 5, 2) || '.' || substr({birth}, 3, 2) || '.' || CASE WHEN try_cast(substr({birth}, 1, 2) AS int) > 30 THEN '19' ELSE '20' END || substr({birth}, 1, 2) END",
        "date_of_expiry": f"CASE WHEN length({t}) >= 28 AND {has(expiry, r'^\d{6}$')} THEN substr({expiry}, 5, 2) || '.' || substr({expiry}, 3, 2) || '.20' || substr({expiry}, 1, 2) END",
        "cnic_number": f"CASE WHEN length({t}) >= 28 AND length({personal}) >= 13 THEN {card(personal)} END",
    }


def oracle_sql() -> dict[str, str]:
    digits = sub("s", r"\D")
    found = get("s", text.CARD)
    card_number = f"CASE WHEN {has('s', text.CARD)} THEN {card(sub(found, '[^0-9]'))} WHEN length({digits}) = 13 THEN {card(digits)} ELSE {strip('s')} END"
    date_text = date_sql("t", *PARSER_DATES, "dmy", ".", "ELSE t")
    parts = "list_filter(list_transform(string_split(t, ','), lambda x: " + strip("x") + "), lambda x: x <> '')"
    iso = date_sql("t", *ISO_DATES, "ymd", "-", r"WHEN regexp_matches(t, '^\d{6}$') THEN CASE WHEN cast(substr(t, 1, 2) AS int) > 30 THEN '19' ELSE '20' END || substr(t, 1, 2) || '-' || substr(t, 3, 2) || '-' || substr(t, 5, 2)")
    upper_labels = strip(f"upper({labels('s')})")
    repair = lambda e: f"translate({e}, 'OQILZSBG', '00112586')"
    value = lambda ch: f"CASE WHEN {ch} BETWEEN '0' AND '9' AND ascii({ch}) < 58 THEN ascii({ch}) - 48 WHEN ascii({ch}) BETWEEN 65 AND 90 THEN ascii({ch}) - 55 ELSE 0 END"
    digit = lambda e: f"coalesce(list_sum(list_transform(range(1, length({e}) + 1), lambda i: ({value(f'substr({e}, i, 1)')}) * [7, 3, 1][(i - 1) % 3 + 1])), 0)::BIGINT % 10"
    ok = lambda e, at: f"(NOT regexp_matches(substr(t, {at}, 1), '^\\d$') OR {digit(e)} = try_cast(substr(t, {at}, 1) AS int))"
    okn, okb, oke = ok("substr(t, 1, 9)", 10), ok("substr(t, 14, 6)", 20), ok("substr(t, 22, 6)", 28)
    valid_date = lambda e: f"({has(e, validators.DATE)} AND try_cast(substr({e}, 1, 2) AS int) BETWEEN 1 AND 31 AND try_cast(substr({e}, 4, 2) AS int) BETWEEN 1 AND 12 AND try_cast(substr({e}, 7, 4) AS int) BETWEEN 1900 AND 2100)"
    noise = strip(sub(strip(sub("s", r"(?i)\b(" + "|".join(text.NOISE_WORDS) + r")\b")), r"\s+", " "))
    redacted = "s"
    for p, m in redact.PATTERNS:
        redacted = sub(redacted, p, m)
    masked_card, masked_pass = sub("s", redact.CARD, r"*****-*******-\3"), sub("s", redact.PASSPORT, r"\1*******")
    comma = r"\b([A-Z]{3,})\s*,\s*([A-Z]{3,})\b"
    profile = validators.PROFILES["passport"]
    matched = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {has('s', p)} THEN '{k}' END" for k, p in profile.items()) + "], lambda x: x IS NOT NULL))"
    urdu, latin = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{8A00}-\x{8D03}]", "[A-Za-z]"
    count = lambda words: "(" + " + ".join(f"(contains(t, {q(w)}))::int" for w in words) + ")"
    pk, fk, bk = count(classify.PASSPORT), count(classify.FRONT), count(classify.BACK)
    number, arabic = has("t", classify.NUMBER), has("t", r"[\x{0600}-\x{06FF}]")
    is_p, is_f, is_b = f"({pk} >= 2 OR contains(t, 'P<PAK'))", f"({fk} >= 2 OR ({number} AND {arabic}))", f"({bk} >= 1 OR (contains(t, 'FAMILY') AND {arabic}))"
    cols = {
        "nrm1_strip_label": (None, {"v": labels("s")}),
        "nrm2_card_number": (None, {"v": card_number}),
        "nrm3_date": (labels("s"), {"v": date_text}),
        "nrm4_father_name": (labels("s"), {"v": f"CASE WHEN contains(t, ',') AND len({parts}) >= 2 THEN upper({parts}[2] || ' ' || {parts}[1]) ELSE upper(t) END"}),
        "nrm5_passport_number": ("upper(s)", {"v": f"CASE WHEN {has('t', r'\b[A-Z]{1,3}\d{6,8}\b')} THEN {get('t', r'\b[A-Z]{1,3}\d{6,8}\b')} ELSE {sub('t', r'[^\w]')} END"}),
        "nrm6_digits_only": (None, {"v": digits}),
        "nrm7_mrz_upper": (None, {"v": sub("upper(s)", "[^A-Z0-9<]")}),
        "nrm8_dispatch": (None, {"v": f"CASE k % 4 WHEN 0 THEN {card_number} WHEN 1 THEN {digits} WHEN 2 THEN {upper_labels} ELSE {strip('s')} END"}),
        "nrm9_noise_words": (None, {"v": noise}),
        "nrm10_iso_date": (f"upper({strip('s')})", {"v": iso}),
        "nrm11_format_card": (None, {"v": f"CASE WHEN length({digits}) = 13 THEN {card(digits)} WHEN {has('s', r'^\d{5}-\d{7}-\d$')} THEN s END"}),
        "nrm12_script": (None, {"v": f"CASE WHEN {has('s', urdu)} AND {has('s', latin)} THEN 'mixed' WHEN {has('s', urdu)} THEN 'urdu' WHEN {has('s', latin)} THEN 'latin' WHEN {has('s', '[0-9]')} THEN 'numeric' ELSE 'unknown' END"}),
        "nrm13_repair_digits": (None, {"v": repair("s")}),
        "nrm15_comma_name": (None, {"v": f"CASE WHEN {has('s', comma)} THEN {get('s', comma, 2)} || ' ' || {get('s', comma, 1)} END"}),
        "nrm16_label_default": (None, {"v": f"'Date Of Birth ' || upper(substr(lower({sub('s', '[^A-Za-z]')}), 1, 1)) || substr(lower({sub('s', '[^A-Za-z]')}), 2)"}),
        "mrz1_line1": ("upper(replace(s, ' ', ''))", zone1_sql("t")),
        "mrz2_line2": (sub("upper(s)", r"[^\w<]"), zone2_sql("t")),
        "mrz3_zone_token": (None, {"v": "contains(s, '<')"}),
        "mrz4_check_digit": ("upper(s)", {"v": f"({digit('t')})::INTEGER"}),
        "mrz5_checks": (f"upper({strip('s')})", {"valid": f"length(t) >= 28 AND {okn} AND {okb}", "number_ok": f"length(t) >= 28 AND {okn}", "birth_ok": f"length(t) >= 28 AND {okb}", "expiry_ok": f"length(t) >= 28 AND {oke}"}),
        "val1_card": (None, {"v": has(strip("s"), validators.CARD)}),
        "val2_date": (labels("s"), {"v": f"coalesce({valid_date(strip('(' + date_text + ')'))}, false)"}),
        "val3_non_empty": (None, {"v": f"length({strip('s')}) > 0"}),
        "val4_passport": (None, {"v": has(strip("s"), validators.PASSPORT)}),
        "val5_passport_strict": (None, {"v": has(strip("s"), validators.PASSPORT_STRICT)}),
        "val6_zone_line": (None, {"v": has(strip("s"), validators.ZONE)}),
        "val7_dispatch": (None, {"v": f"CASE k % 4 WHEN 0 THEN {has(strip('s'), validators.CARD)} WHEN 1 THEN coalesce({valid_date(strip('s'))}, false) WHEN 2 THEN length({strip('s')}) > 0 ELSE true END"}),
        "val9_profile": (None, {"matched": f"array_to_string({matched}, ',')", "coverage": f"cast(round(cast(len({matched}) / {len(profile)} AS decimal(18, 6)), 4) AS double)"}),
        "prv1_redact": (None, {"v": redacted}),
        "prv3_mask_card": (None, {"v": masked_card}),
        "prv4_mask_passport": (None, {"v": masked_pass}),
        "prv5_mask": (None, {"v": sub(masked_card, redact.PASSPORT, r"\1*******")}),
        "agg6_classify": (
            "upper(s)",
            {
                "document_type": f"CASE WHEN {is_p} THEN 'passport' WHEN {is_f} THEN 'cnic_front' WHEN {is_b} THEN 'cnic_back' ELSE 'unknown' END",
                "confidence": f"CASE WHEN {is_p} THEN least(0.98, 0.5 + {pk} * 0.15)::DOUBLE WHEN {is_f} THEN least(0.98, 0.4 + {fk} * 0.15 + CASE WHEN {number} THEN 0.2 ELSE 0 END)::DOUBLE WHEN {is_b} THEN 0.85::DOUBLE ELSE 0.3::DOUBLE END",
                "method": f"CASE WHEN {is_p} THEN 'keyword_mrz_signature' WHEN {is_f} THEN 'keyword_bilingual_signature' WHEN {is_b} THEN 'keyword_signature' ELSE 'fallback_unknown' END",
            },
        ),
    }
    base = fixtures.DUCK_SAMPLES
    return {n: f"SELECT k, {', '.join(f'{e} AS {c}' for c, e in out.items())} FROM (SELECT k, s, {t or 'NULL'} AS t FROM ({base}) AS b)" for n, (t, out) in cols.items()}
