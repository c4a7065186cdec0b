"""License scans by canonical digest.

A whole text is made canonical, and the SHA-256 of what is left names it; a hash
join with the digests of known license texts names the license.

1. Lower case. Lines are what stands between line feeds and carriage returns; what
   opens a line before a letter, digit, ( or the copyright sign doesn't count.
2. Lines that state a copyright and nothing else go: those that begin with
   `copyright`, unless nothing or a word of the license's own prose follows (NOT_STATED), or
   with (c) or the sign before a year or `copyright`, and lines that say all rights
   reserved. List marks (1. 2) (a)) that open other lines go.
3. Words, runs of letters, digits and characters beyond ASCII, are mapped to one of
   their equivalent spellings, each by its own lookup, then pairs of words; they
   are joined by single spaces. Punctuation and white space are gone by then.

Known texts are the files of a folder (`known` by default, those beside this
module), named by license; each counts with and without its usual titles. Up to
TOLD digests are broadcast; more meet the documents' digests by a shuffled join.

Null and empty texts, and texts whose canonical form is empty, have no digest and
no license. Repeated rows give repeated results; empty tables empty ones. Columns
of the table that are named as the results are refused with an error.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.llm.common import fresh_names, let

KNOWN = Path(__file__).with_name("known")
#: Known digests that are broadcast (some 10 MB).
TOLD = 100_000

# Words that license matching treats as equal, and pairs of words.
WORDS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
PAIRS = (
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owners", "copyright holders"),
)

# Words after `copyright` that are not a statement of one; titles that stand above license texts.
NOT_STATED = ("notice", "notices", "holder", "holders", "owner", "owners", "law", "laws", "license", "licenses", "statement", "statements", "interest", "interests", "and", "or", "in", "to", "on", "as", "is", "are", "that", "of")
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution",),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense",),
}

#: What goes at the start of a line, in one pass: statements of a copyright to their end, then list marks.
OPENING = r"(^|[\r\n])[^a-z0-9(\r\n\x{80}-\x{10FFFF}]*(?:copyright(?![a-z]|[ \t]*(?:[\r\n]|\z)|[ \t]+(?:" + "|".join(NOT_STATED) + r")(?![a-z]))[^\r\n]*|(?:\(c\)|©)[ \t]*(?:copyright|[0-9]{4})[^\r\n]*|all rights reserved[. \t]*(?=[\r\n]|\z)|\(?(?:[0-9]{1,2}[.)]|[a-z]\))[ \t]+)"
APART = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """The canonical form; null if nothing is left."""
    other = F.create_map(*(F.lit(x) for pair in WORDS for x in pair))
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), OPENING, "\n"), APART, -1)
    words = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.when(w.isin([a for a, _ in WORDS]), F.try_element_at(other, w)).otherwise(w))

    def paired(form: Column) -> Column:
        has, out = F.lit(False), form
        for a, b in PAIRS:
            has, out = has | F.contains(form, F.lit(a)), F.regexp_replace(out, f"(^| ){a}(?= |$)", f"$1{b}")
        return F.when(has, out).otherwise(form)

    return F.nullif(let(F.array_join(words, " "), paired), F.lit(""))


def known_texts(known: dict[str, str] | str | Path = KNOWN) -> list[tuple[str, str]]:
    """(license, text): of a folder's *.txt files or a dictionary, with and without titles."""
    texts = known if isinstance(known, dict) else {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(known).glob("*.txt"))}
    return [(k, v) for k, v in texts.items()] + [(k, f"{t}\n\n{v}") for k, v in texts.items() for t in TITLES.get(k, ())]


def known_digests(spark: SparkSession, known: dict[str, str] | str | Path = KNOWN) -> DataFrame:
    """digest, license: one row for each canonical form; of licenses with the same form the smallest name."""
    rows = spark.createDataFrame(known_texts(known), "license string, body string")
    return rows.select("license", F.sha2(canonical(F.col("body")), 256).alias("digest")).where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def find_licenses(docs: DataFrame, text: str = "text", known: dict[str, str] | str | Path = KNOWN, digest: str = "digest", license: str = "license") -> DataFrame:
    """docs with the columns digest and license (null where the text isn't a known license)."""
    fresh_names(docs, digest, license)
    names = known_digests(docs.sparkSession, known).select(F.col("digest").alias(digest), F.col("license").alias(license))
    named = docs.withColumn(digest, F.sha2(canonical(F.col(text)), 256))
    if len(known_texts(known)) <= TOLD:
        names = F.broadcast(names)
    return named.join(names, digest, "left").select(*docs.columns, digest, license)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_licenses(docs).select("doc_id", "digest", "license", F.col("license").isNotNull().alias("is_license"))


def op8_sql() -> str:
    """Line by line and word by word, with doubled spaces where pairs are replaced; the lists of equivalents are data, the steps are written anew."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    prose = ", ".join(map(quote, NOT_STATED))
    after = "regexp_extract(l, '^copyright[ \\t]+([a-z]+)', 1)"
    line = f"""CASE WHEN regexp_matches(l, '^copyright[^a-z]') AND NOT regexp_matches(l, '^copyright[ \\t]*$') AND {after} NOT IN ({prose}) THEN ''
 WHEN regexp_matches(l, '^(\\(c\\)|©)[ \\t]*(copyright|[0-9][0-9][0-9][0-9])') THEN '' WHEN regexp_full_match(l, 'all rights reserved[. \\t]*') THEN ''
 WHEN regexp_matches(l, '^[(]?([0-9][0-9]?[.)]|[a-z][)])[ \\t]') THEN regexp_replace(l, '^[(]?[0-9a-z]+[.)]', '') ELSE l END"""
    word = "CASE w " + " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in WORDS) + " ELSE w END"
    pairs = "wide"
    for a, b in PAIRS:
        pairs = f"replace({pairs}, {quote(' ' + a.replace(' ', '  ') + ' ')}, {quote(' ' + b.replace(' ', '  ') + ' ')})"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known_texts())
    # a space on either side of each word, so that no two matches share one
    steps = f"""{{0}}_lines AS (SELECT id, list_transform(string_split_regex(lower(coalesce(body, '')), '[\\r\\n]'), lambda x: regexp_replace(x, '^[^a-z0-9(\\x{{{{80}}}}-\\x{{{{10FFFF}}}}]+', '')) AS ls FROM {{1}}),
{{0}}_kept AS (SELECT id, array_to_string(list_transform(ls, lambda l: {line}), chr(10)) AS t FROM {{0}}_lines),
{{0}}_words AS (SELECT id, list_transform(regexp_extract_all(t, '[a-z0-9\\x{{{{80}}}}-\\x{{{{10FFFF}}}}]+'), lambda w: {word}) AS ws FROM {{0}}_kept),
{{0}}_wide AS (SELECT id, ' ' || array_to_string(ws, '  ') || ' ' AS wide FROM {{0}}_words WHERE len(ws) > 0),
{{0}}_form AS (SELECT id, sha256(trim(replace({pairs}, '  ', ' '))) AS digest FROM {{0}}_wide)"""
    return f"""WITH texts AS (SELECT row_number() OVER () AS id, license, body FROM (VALUES {known}) AS k(license, body)), {steps.format('k', 'texts')},
known AS (SELECT digest, min(license) AS license FROM k_form JOIN texts ON texts.id = k_form.id GROUP BY 1),
docs AS (SELECT row_number() OVER () AS id, doc_id, text AS body FROM documents), {steps.format('d', 'docs')}
SELECT docs.doc_id, f.digest, known.license, known.license IS NOT NULL AS is_license FROM docs LEFT JOIN d_form f ON f.id = docs.id LEFT JOIN known ON known.digest = f.digest"""
