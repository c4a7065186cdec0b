"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's shingles are its runs of WORDS lower-cased words; with fewer words the
whole sequence is the only one, and without any there is none. A sketch holds
the K smallest distinct 64-bit hashes in ascending order, or all if there are
fewer. Sketches of parts merge into the sketch of the whole, and give estimates
of resemblance, containment and the number of distinct shingles; they are exact
while a sketch holds every hash. The fingerprint is the sketch as base64.

Everything is column expressions and joins. The neighbour of a document in
ascending doc_id is found on narrow rows (a key, a hash of the text, a length)
that are range-partitioned; the texts are shuffled once, and that exchange
serves both joins: one takes each neighbour's opening characters and sketch to
its document, the other meets them there.

Null texts count as empty. Rows are named by hashes of key and text, 128 bits.
Rows with the same doc_id follow one another by a hash of the text; repeated
rows each have their own neighbour. Null doc_ids come first. An empty table
gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docustrata.llm.common import WORD, checkpointed, let

WORDS, K = 5, 96


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the shingles, in order and with repeats."""
    hashes = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    last = lambda h: F.greatest(F.size(h) - words, F.lit(0))
    return let(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), last(h) + 1), lambda i: F.xxhash64(F.slice(h, i, words)))))


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles in all of both; 1 for two empty ones."""
    both = let(merged(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    seen = F.when(F.size(b) < k, a).otherwise(F.filter(a, lambda x: x <= F.element_at(b, -1)))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(let(seen, lambda s: F.coalesce(F.try_divide(F.size(F.array_intersect(s, b)), F.size(s)), F.lit(0.0))))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def fingerprint(a: Column) -> Column:
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))), "\r\n", "")  # some settings of Spark break lines


def neighbours(docs: DataFrame, key: str, body: Column) -> DataFrame:
    """Per row: key, k and th (hashes of key and text), n (code points), next_k and next_th of the next row; the first follows the last."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(key).alias("k"), F.xxhash64(body).alias("th"), F.length(body).cast("long").alias("n"))
    rows = checkpointed(rows.repartitionByRange("id", "th").withColumn("part", F.spark_partition_id()))
    row = F.struct("id", "th", "k")
    inside = rows.withColumn("next", F.lead(row).over(Window.partitionBy("part").orderBy("id", "th")))
    firsts = rows.groupBy("part").agg(F.min(row).alias("first"))  # a row for each partition
    wrap = firsts.agg(F.min(F.struct("part", "first")).alias("w")).select("w.first")
    after = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after")).join(F.broadcast(wrap))
    after = after.select("part", F.coalesce("after", "first").alias("after"))
    found = inside.join(F.broadcast(after), "part").withColumn("next", F.coalesce("next", "after"))
    return found.select(F.col("id").alias(key), "k", "th", "n", F.col("next.k").alias("next_k"), F.col("next.th").alias("next_th"))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Per row: key, n_chars, edited, sketch, edited_sketch, next_sketch."""
    body = F.coalesce(F.col(text), F.lit(""))
    pairs = checkpointed(neighbours(docs.select(key, text), key, body).groupBy(key, "k", "th", "n", "next_k", "next_th").agg(F.count("*").alias("times")))
    texts = docs.select(F.xxhash64(key).alias("k"), F.xxhash64(body).alias("th"), body.alias("body"))
    repeated = pairs.groupBy("k", "th").agg(F.sum("times").alias("times")).where("times > 1").limit(1).count() > 0
    if repeated:
        texts = texts.dropDuplicates(["k", "th"])
    texts = texts.select("k", "th", "body", sketch(F.col("body"), k, words).alias("sketch"))
    openings = texts.join(pairs.withColumnsRenamed({"k": "own_k", "th": "own_th", "next_k": "k", "next_th": "th"}), ["k", "th"])
    openings = openings.select(F.col("own_k").alias("k"), F.col("own_th").alias("th"), key, "n", "times", F.col("body").substr(F.lit(1), F.floor(F.col("n") / 4).cast("int")).alias("opening"), F.col("sketch").alias("next_sketch"))
    both = texts.join(openings, ["k", "th"])
    kept = F.col("body").substr(F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int"))
    out = both.select(key, F.col("n").alias("n_chars"), "times", F.concat(kept, F.col("opening")).alias("edited"), "sketch", "next_sketch")
    out = out.select(key, "n_chars", "times", "edited", "sketch", sketch(F.col("edited"), k, words).alias("edited_sketch"), "next_sketch")
    if repeated:
        out = out.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("__time")
    return out.drop("times")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    a, e, n = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return compare_with_next(docs).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(a).alias("fingerprint"),
        fingerprint(e).alias("edited_fingerprint"),
        resemblance(a, e).alias("near_edited"),
        resemblance(a, n).alias("near_next"),
        distinct_shingles(a).alias("distinct_shingles"),
    )
