"""Relations derived from the star schema by SQL that Spark and DuckDB read alike.

None of the given tables holds recognised tokens or images, so cards are derived
from customer, passports from orders and pixels from part, by integer arithmetic
on keys. The small VALUES lists are layouts of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docustrata.session import materialized

#: Per key: thirteen digits d, date parts, two names, a passport number pp with its check digit, a date yymmdd with its check digit.
KEYS = """SELECT k, cast(1 + k % 9 AS string) || lpad(cast((k * 7919 + 13) % 1000000000000 AS string), 12, '0') AS d,
 lpad(cast(1 + k % 28 AS string), 2, '0') AS dd, lpad(cast(1 + k % 12 AS string), 2, '0') AS mm, substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', cast(1 + 3 * (k % 12) AS int), 3) AS mon,
 cast(1950 + k % 50 AS string) AS yyyy, cast(2011 + k % 8 AS string) AS yyyy2, cast(2021 + k % 8 AS string) AS yyyy3,
 translate(lpad(cast(k % 1000000 AS string), 6, '0'), '0123456789', 'ABCDEFGHIJ') AS nm, translate(lpad(cast((k * 31 + 7) % 100000 AS string), 5, '0'), '0123456789', 'KLMNOPQRST') AS nm2,
 substr('ABCDEFGHIJ', cast(1 + k % 10 AS int), 1) || substr('ABCDEFGHIJ', cast(1 + k % 7 AS int), 1) || lpad(cast((k * 37 + 5) % 10000000 AS string), 7, '0') AS pp FROM ({source}) AS s"""

#: One text for each customer, of sixteen kinds.
SAMPLES = (
    "SELECT k, CASE k % 16 WHEN 0 THEN substr(d, 1, 5) || '-' || substr(d, 6, 7) || '-' || substr(d, 13, 1) WHEN 1 THEN substr(d, 1, 5) || ' ' || substr(d, 6, 7) || ' ' || substr(d, 13, 1)"
    " WHEN 2 THEN d WHEN 3 THEN 'Identity No ' || substr(d, 1, 5) || '-' || substr(d, 6, 7) || '-' || substr(d, 13, 1) WHEN 4 THEN 'Date of Birth ' || dd || '.' || mm || '.' || yyyy"
    " WHEN 5 THEN dd || mon || yyyy WHEN 6 THEN 'ssteafBirt ' || dd || ' ' || lower(mon) || ' ' || yyyy WHEN 7 THEN yyyy || '-' || mm || '-' || dd WHEN 8 THEN dd || '/' || mm || '/' || yyyy"
    " WHEN 9 THEN 'Father Name ' || nm || ', ' || nm2 WHEN 10 THEN '  ' || lower(nm) || ' ' || nm2 || ' ' WHEN 11 THEN 'passport no ' || lower(pp) WHEN 12 THEN pp"
    " WHEN 13 THEN 'P<PAK' || nm || '<<' || nm2 || '<' || nm || '<<<<<<<<<<<<<<<<<<<<<' WHEN 14 THEN pp || cast(k % 10 AS string) || 'PAK' || substr(yyyy, 3, 2) || mm || dd || cast(k % 7 AS string) || 'M' || substr(yyyy3, 3, 2) || mm || dd || cast(k % 9 AS string) || d || '<' || cast(k % 10 AS string) || '8'"
    " ELSE 'Name ' || nm || ' PAKISTANI  Rawalpindi SURNAME ' || dd || '.' || mm || '.' || yyyy || ' ' || pp || ' محمد' END AS s FROM ("
    + KEYS.format(source="SELECT c_custkey AS k FROM {customer}")
    + ") AS q"
)

#: idx, what it is, left, top, width on a 2000 x 1261 card.
CARD_LAYOUT = "(0, 'name_ur', 500, 280, 300), (1, 'l_name', 420, 400, 110), (2, 'name', 560, 400, 320), (3, 'l_father', 420, 545, 200), (4, 'father', 650, 545, 320), (5, 'l_number', 420, 715, 220), (6, 'number', 660, 715, 330), (7, 'l_birth', 420, 830, 200), (8, 'birth', 640, 830, 200), (9, 'l_issue', 420, 1040, 200), (10, 'issue', 640, 1040, 200), (11, 'l_expiry', 1150, 1040, 220), (12, 'expiry', 1400, 1040, 200), (13, 'father_ur', 1300, 470, 200)"

CARD_TOKENS = (
    "SELECT k AS doc_id, 'cnic_front' AS doc_type, cast(idx AS int) AS idx, CASE what WHEN 'name_ur' THEN 'محمد احمد' WHEN 'father_ur' THEN 'احمد علی' WHEN 'l_name' THEN CASE WHEN k % 11 = 0 THEN 'Nane' ELSE 'Name' END WHEN 'name' THEN nm || ' ' || nm2"
    " WHEN 'l_father' THEN 'Father Name' WHEN 'father' THEN nm2 WHEN 'l_number' THEN CASE WHEN k % 11 = 0 THEN 'Identty Numbr' ELSE 'Identity Number' END"
    " WHEN 'number' THEN CASE k % 4 WHEN 0 THEN substr(d, 1, 5) || '-' || substr(d, 6, 7) || '-' || substr(d, 13, 1) WHEN 1 THEN substr(d, 1, 5) || ' ' || substr(d, 6, 7) || ' ' || substr(d, 13, 1) WHEN 2 THEN d ELSE substr(d, 1, 12) END"
    " WHEN 'l_birth' THEN 'Date of Birth' WHEN 'birth' THEN CASE k % 3 WHEN 0 THEN dd || '.' || mm || '.' || yyyy WHEN 1 THEN dd || mon || yyyy ELSE dd || '/' || mm || '/' || yyyy END"
    " WHEN 'l_issue' THEN 'Date of Issue' WHEN 'issue' THEN dd || '.' || mm || '.' || yyyy2 WHEN 'l_expiry' THEN 'Date of Expiry' ELSE dd || '.' || mm || '.' || yyyy3 END AS text,"
    " cast(60 + (k * 37 + idx * 11) % 40 AS double) / 100 AS confidence,"
    " cast(CASE WHEN k % 7 = 0 AND idx = 5 THEN 1705 WHEN k % 7 = 0 AND idx = 6 THEN 1815 ELSE x END + k % 13 AS double) AS x1, cast(y + k % 5 AS double) AS y1,"
    " cast(CASE WHEN k % 7 = 0 AND idx = 5 THEN 1805 WHEN k % 7 = 0 AND idx = 6 THEN 1985 ELSE x + w END + k % 13 AS double) AS x2, cast(y + 40 + k % 5 AS double) AS y2, 2000 AS image_width, 1261 AS image_height"
    " FROM (" + KEYS.format(source="SELECT c_custkey AS k FROM {customer}") + ") AS q JOIN (VALUES " + CARD_LAYOUT + ") AS t(idx, what, x, y, w) ON NOT (k % 6 = 0 AND what = 'issue')"
)

PASSPORT_LAYOUT = "(0, 'title', 500, 60, 200), (1, 'l_number', 1250, 80, 200), (2, 'number', 1480, 80, 200), (3, 'l_surname', 620, 180, 150), (4, 'surname', 620, 225, 200), (5, 'l_given', 620, 290, 200), (6, 'given', 620, 330, 200), (7, 'l_birth', 620, 400, 200), (8, 'birth', 620, 440, 200), (9, 'l_father', 620, 570, 200), (10, 'father', 620, 615, 300), (11, 'l_issue', 620, 692, 200), (12, 'issue', 620, 727, 200), (13, 'l_expiry', 620, 775, 200), (14, 'expiry', 620, 812, 200), (15, 'l_citizen', 1250, 420, 200), (16, 'citizen', 1480, 420, 300), (17, 'zone1', 100, 1150, 1500), (18, 'zone2', 100, 1220, 1500)"

PASSPORT_TOKENS = (
    "SELECT k AS doc_id, 'passport' AS doc_type, cast(idx AS int) AS idx, CASE what WHEN 'title' THEN 'PASSPORT' WHEN 'l_number' THEN CASE WHEN k % 5 = 0 THEN 'Passport No:' ELSE 'Passport Number' END WHEN 'number' THEN pp WHEN 'l_surname' THEN 'Surname' WHEN 'surname' THEN CASE WHEN k % 9 = 0 THEN 'RAWALPINDI' ELSE nm END"
    " WHEN 'l_given' THEN 'Given Names' WHEN 'given' THEN nm2 WHEN 'l_birth' THEN 'Date of Birth' WHEN 'birth' THEN CASE k % 3 WHEN 0 THEN dd || '.' || mm || '.' || yyyy WHEN 1 THEN dd || mon || yyyy ELSE dd || '??' || yyyy END"
    " WHEN 'l_father' THEN 'Father Name' WHEN 'father' THEN nm2 || ', ' || nm WHEN 'l_issue' THEN 'Date of Issue' WHEN 'issue' THEN dd || mon || yyyy2 WHEN 'l_expiry' THEN 'Date of Expiry' WHEN 'expiry' THEN dd || mon || yyyy3 WHEN 'l_citizen' THEN 'Citizen Number'"
    " WHEN 'citizen' THEN substr(d, 1, 5) || '-' || substr(d, 6, 7) || '-' || substr(d, 13, 1) WHEN 'zone1' THEN 'P<PAK' || nm || '<<' || nm2 || '<<<<<<<<<<<<<<<<<<<<<<<<<<<<'"
    " ELSE pp || cast(k % 10 AS string) || 'PAK' || substr(yyyy, 3, 2) || mm || dd || '8M' || substr(yyyy3, 3, 2) || mm || dd || '4' || d || '<18' END AS text,"
    " cast(60 + (k * 37 + idx * 11) % 40 AS double) / 100 AS confidence, cast(x + k % 7 AS double) AS x1, cast(y + k % 3 AS double) AS y1, cast(x + w + k % 7 AS double) AS x2, cast(y + 30 + k % 3 AS double) AS y2, 2000 AS image_width, 1407 AS image_height"
    " FROM (" + KEYS.format(source="SELECT o_orderkey AS k FROM {orders}") + ") AS q JOIN (VALUES " + PASSPORT_LAYOUT + ") AS t(idx, what, x, y, w) ON NOT (k % 6 = 0 AND what = 'issue') AND NOT (k % 8 = 0 AND what IN ('zone1', 'zone2'))"
)

#: A 12 x 16 grayscale image for each part.
PIXELS = (
    "SELECT p_partkey AS img_id, cast(r AS int) AS r, cast(c AS int) AS c, cast((r * 7 + c * 13 + p_partkey * 31 + CASE WHEN p_partkey % 3 = 0 THEN r * c ELSE 0 END) % 256 AS int) AS gray FROM {part}"
    " JOIN (VALUES " + ", ".join(f"({i})" for i in range(12)) + ") AS a(r) ON 1 = 1 JOIN (VALUES " + ", ".join(f"({i})" for i in range(16)) + ") AS b(c) ON 1 = 1"
)

#: Positions relative to the page, rounded to four places.
PLACED = (
    "SELECT *, cast(round(cast(x1 / image_width AS decimal(18, 6)), 4) AS double) AS nx1, cast(round(cast(y1 / image_height AS decimal(18, 6)), 4) AS double) AS ny1,"
    " cast(round(cast(x2 / image_width AS decimal(18, 6)), 4) AS double) AS nx2, cast(round(cast(y2 / image_height AS decimal(18, 6)), 4) AS double) AS ny2 FROM ({tokens}) AS placed_"
)


def _read(spark: SparkSession, sf_dir: str, text: str, table: str) -> DataFrame:
    return spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, SAMPLES, "customer")


def card_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As stored tokens are: a table."""
    return materialized(spark, ("cards", sf_dir), _read(spark, sf_dir, PLACED.replace("{tokens}", CARD_TOKENS), "customer"))


def passport_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized(spark, ("passports", sf_dir), _read(spark, sf_dir, PLACED.replace("{tokens}", PASSPORT_TOKENS), "orders"))


#: Documents whose tokens a task derives and groups at a time.
DEALT = 20_000


def passport_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of passports, derived where they are read once. Keys are dealt before their tokens are derived, so that
    all tokens of a document, those of repeated keys too, stand in one task and needn't be stored or moved."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // DEALT))
    return spark.sql(PLACED.replace("{tokens}", PASSPORT_TOKENS), orders=keys.repartition(parts, "o_orderkey"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, PIXELS, "part")


def duck(text: str) -> str:
    """The relation's text with table names in place."""
    for name in ("customer", "orders", "part"):
        text = text.replace("{" + name + "}", name)
    return text


DUCK_SAMPLES, DUCK_PIXELS = duck(SAMPLES), duck(PIXELS)
DUCK_CARDS, DUCK_PASSPORTS = duck(PLACED.replace("{tokens}", CARD_TOKENS)), duck(PLACED.replace("{tokens}", PASSPORT_TOKENS))
