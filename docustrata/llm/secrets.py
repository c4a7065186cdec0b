"""Secret scans through an incremental, content-addressed blob ledger.

Every historical version of a path is a row (path, text). Its text is a blob,
named by its SHA-256. The ledger holds, for each blob and rule version that was
ever scanned, the spans found. A scan hashes the versions, keeps the blobs whose
(blob, rule, version) pairs the ledger lacks, reads each such blob once whatever
the number of its paths, appends what it found, and joins findings back to all
paths. A new rule version makes only its own pairs unseen; a new commit only its
new blobs.

All of it is DataFrame operations. Spans are places in code points, end
exclusive: the pieces between matches (split) and the matches themselves
(regexp_extract_all) are walked together, which gives each match its place.

Null texts count as empty. Empty tables give empty results. Repeated rows give
repeated results; equal texts are scanned once. Columns of any name are left alone:
scan() refuses a table that has a column named as the blob's.
Findings meet the rows of a blob in several parts, so that a text with a great
share of all rows is no single task's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docustrata.llm.common import checkpointed, fresh_names, salted, scratch_path


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and do not overlap; one counts if group `part` has `least` characters."""

    kind: str
    version: int
    pattern: str
    part: int
    least: int


#: The base rules, in the order that breaks ties of spans.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    # runs of + that are too short are dropped anyway, and a run is never cut: {16,} finds the same spans, and skips texts without any
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
SPANS = "array<struct<start:bigint,end:bigint>>"
LEDGER = f"blob string, kind string, version int, spans {SPANS}"


def spans(text: Column, rule: Rule) -> Column:
    """Places of the matches of a rule that count."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.part)).alias("part"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        kept = F.when(F.length(x["part"]) >= rule.least, F.array_append(acc["kept"], span)).otherwise(acc["kept"])
        return F.struct(end.cast("long").alias("at"), kept.alias("kept"))

    walked = F.aggregate(found, start, step, lambda acc: acc["kept"])
    return F.when(text.rlike(rule.pattern), walked).otherwise(F.array().cast(SPANS))


class BlobLedger:
    """Findings by blob and rule version, as a Parquet table in a shared folder that only grows."""

    #: Up to so many names of unseen blobs (7 MB) are broadcast.
    FEW = 100_000

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.rules = spark, rules
        self.path = path or scratch_path(spark, "ledger")
        if path is None:
            spark.createDataFrame([], LEDGER).write.parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def current(self) -> DataFrame:
        """Findings of the present rule versions."""
        now = F.lit(False)
        for r in self.rules:
            now = now | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
        return self.table().where(now)

    def scan(self, versions: DataFrame, text: str = "text", name: str = "blob") -> DataFrame:
        """Scans what is unseen of the versions. Returns them with a column `name`, the blob's."""
        fresh_names(versions, name)
        body = F.coalesce(F.col(text), F.lit(""))
        result = versions.withColumn(name, F.sha2(body, 256))
        named = versions.select(F.col(text), F.sha2(body, 256).alias("__blob")).select(F.col("__blob").alias("blob"), F.col(text).alias("__body"))
        body = F.coalesce("__body", F.lit(""))
        pairs = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in self.rules))
        blobs = named.select("blob").distinct()
        todo = blobs.select("blob", F.explode(pairs).alias("p")).select("blob", "p.kind", "p.version")
        todo = todo.join(self.current().select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
        todo = checkpointed(todo.groupBy("blob").agg(F.collect_set("kind").alias("kinds")))
        unseen = todo.count()
        if not unseen:
            return result
        held = named
        if unseen <= self.FEW:  # a late commit on a large history: the few unseen names go to every task, and only their texts are shuffled
            held = named.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
        # one text for each unseen blob: first() keeps one of the copies within every task before the shuffle
        texts = held.select("blob", body.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
        fresh = texts.join(todo, "blob")
        none = F.lit(None).cast(SPANS)
        found = fresh.select(
            "blob",
            F.array(
                *(
                    F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("kinds", r.kind), spans(F.col("body"), r)).otherwise(none).alias("spans"))
                    for r in self.rules
                )
            ).alias("found"),
        )
        rows = found.select("blob", F.explode("found").alias("f")).where("f.spans is not null").select("blob", "f.kind", "f.version", "f.spans")
        rows.write.mode("append").parquet(self.path)
        return result

    def digest(self) -> DataFrame:
        """blob, counts n_<kind>, marks (array of order, kind and span) of blobs with findings."""
        rows = self.current().where(F.size("spans") > 0)
        order = F.element_at(F.create_map(*(x for i, r in enumerate(self.rules) for x in (F.lit(r.kind), F.lit(i)))), F.col("kind"))
        marks = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order.alias("ord"), s["end"].alias("end"), F.col("kind").alias("kind")))
        per = rows.select("blob", "kind", F.size("spans").cast("long").alias("n"), marks.alias("marks"))
        counts = [F.sum(F.when(F.col("kind") == r.kind, F.col("n")).otherwise(0)).alias(f"n_{r.kind}") for r in self.rules]
        return per.groupBy("blob").agg(*counts, F.array_sort(F.flatten(F.collect_list("marks"))).alias("marks"))


def joined(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", ledger: BlobLedger | None = None) -> DataFrame:
    """Per row of docs: key, n_<kind>, marks, blob, over the present rule versions."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    paths = ledger.scan(rows, "__text").select("__key", "blob")
    digest = checkpointed(ledger.digest())
    names = [f"n_{r.kind}" for r in ledger.rules]
    out = salted(paths, digest, "blob", ["__key"])
    return out.select(F.col("__key").alias(key), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names), F.coalesce("marks", F.array().cast(digest.schema["marks"].dataType)).alias("marks"), "blob")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", ledger: BlobLedger | None = None) -> DataFrame:
    """docs, their columns unchanged, with every span of a secret replaced by mark.

    Overlapping spans become one mark. Texts without a secret, and nulls, are kept as they are.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    names = list(docs.columns)
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # their names can clash with no other here
    text = docs.columns[names.index(text)]
    named = ledger.scan(docs, text)
    digest = checkpointed(ledger.digest().select("blob", "marks"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        fresh = m["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.col(text).substr((acc["at"] + 1).cast("int"), (m["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("marks", begin, step, lambda acc: F.concat(acc["out"], F.col(text).substr((acc["at"] + 1).cast("int"), F.length(text))))
    hashable = [f.name for f in docs.schema.fields if f.name != text and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    out = salted(named, digest, "blob", hashable or ["blob"]).withColumn(text, F.when(F.col("marks").isNotNull(), clean).otherwise(F.col(text)))
    return out.select(*docs.columns).toDF(*names)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_secrets(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("marks")), 256).alias("base_sha256"), joined(F.col("marks")).alias("spans"))


def op7_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    one = "SELECT doc_id, '{r.kind}' AS kind, {i} AS ord, {r.least} AS least, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {r.part}) AS parts FROM d WHERE regexp_matches(t, {p})"
    found = " UNION ALL ".join(one.format(r=r, i=i, p=quote(r.pattern)) for i, r in enumerate(RULES))
    length = lambda e: f"coalesce(list_sum(list_transform({e}, lambda x: length(x))), 0)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({found}),
e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (SELECT doc_id, kind, ord, ({length('gaps[1:i]')} + {length('hits[1:i - 1]')})::BIGINT AS start, length(hits[i]) AS n FROM e WHERE length(parts[i]) >= least),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in RULES)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""
