"""Mixing sources to target weights by blocks.

The words of each source, its documents in ascending doc_id, form one stream that
is cut into blocks of equal length: BLOCK words, fewer for a source that would
have less than LEAST blocks (the last block may be shorter). Output shards
have SHARD slots. A shard's source counts are a multinomial draw given what every
source gets in all, so that each ends at its target to within half a block: the
range of shards is halved again and again, and the counts of a half are drawn
without replacement from those of the whole. Draws are keyed by their place in that
tree, so any executor finds the counts of its own shards by a path from the root,
and no shard's row passes the driver. The k-th slot of a
source reads block permutation(k mod n) of its n blocks in epoch k div n; the
permutation is a keyed Feistel network that walks cycles, so it needs no state
and any executor can compute any slot. Slots meet blocks by an equi-join on
(source, block).

The driver holds a row for each source, MOST_SOURCES at most; a corpus with more
fails with an error. Everything a document or a shard has is distributed. Word
offsets are prefix sums over range partitions, so that a source with a third of all
documents is spread over partitions like any other.

Targets: a source's weight is 3, 1, 2, repeating, by code point order of its
name, null last. The mix has SHARE of all words. A target above LIMIT times its
source's words stops there and the excess is shared again by weight.

Null or empty texts have size 0 and are never taken. Repeated rows are documents
of their own. An empty table, or one without words, gives no slots. Sources are
compared exactly; null is a source. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.llm.common import checkpointed, free_name, let, ordered, word_count

WEIGHTS, SHARE, LIMIT = (3.0, 1.0, 2.0), 1.5, 2.0
#: Words in a block, blocks of a source at least (of a word each at least), slots in an output shard, shards of a task's group, seed of draws and permutations.
BLOCK, LEAST, SHARD, GROUP, SEED = 128, 64, 8192, 16, 42
#: Below so many slots a draw without replacement is exact; above, binomial within what is possible.
EXACT = 10**9
#: Sources that the driver's plan may hold; a corpus with more fails with a clear error.
MOST_SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Words wanted of each source: share of the sum, by weight, none above limit times its size."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s]
    while free:
        each = left / sum(weights[i] for i in free)
        full = [i for i in free if each * weights[i] > limit * sizes[i]]
        if not full:
            for i in free:
                out[i] = each * weights[i]
            break
        for i in full:
            out[i] = limit * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def half(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n of all slots, drawn without replacement: how many of each source."""
    if (total := int(counts.sum())) < EXACT:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out, want, rest = np.zeros_like(counts), n, total
    for i in np.argsort(-counts, kind="stable").tolist():
        rest -= int(counts[i])
        got = int(rng.binomial(int(counts[i]), want / max(1, rest + int(counts[i]))))
        out[i] = min(max(got, want - rest, 0), int(counts[i]), want)
        want -= int(out[i])
    return out


def shard_counts(quota: np.ndarray, shard: int, seed: int, begin: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source before it, its own slots of each) of the shards from begin to end."""
    total, none = int(quota.sum()), np.zeros(len(quota), dtype="int64")
    slots = lambda k: min(k * shard, total)

    def walk(low: int, high: int, before: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if high <= begin or low >= end:
            return
        if high - low == 1:
            yield low, before, counts
            return
        mid = (low + high) // 2
        left = half(counts, slots(mid) - slots(low), np.random.default_rng((seed, low, high)))
        yield from walk(low, mid, before, left)
        yield from walk(mid, high, before + left, counts - left)

    if total:
        yield from walk(0, -(-total // shard), none, quota.astype("int64"))


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n), by element: four Feistel rounds on the next even power of two, again until below n."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype("uint64")
    mask, out, todo = (np.uint64(1) << bits) - np.uint64(1), k.astype("uint64").copy(), np.arange(len(k))
    with np.errstate(over="ignore"):
        while len(todo):
            x, b, m, s = out[todo], bits[todo], mask[todo], key[todo].astype("uint64")
            left, right = x >> b, x & m
            for r in range(1, 5):
                h = (right + s + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((h >> np.uint64(32)) & m)
            out[todo] = (left << b) | right
            todo = todo[out[todo] >= n[todo].astype("uint64")]
    return out.astype("int64")


class Mix:
    """docs: one row per document with its stream place. slots: one row per output slot. taken: segments of documents in slots."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, carry: tuple[str, ...] = ()):
        """carry: further columns, narrow ones, that docs keeps."""
        spark = docs.sparkSession
        sid, size = free_name(docs, "sid"), free_name(docs, "size")
        self.sid, self.size = sid, size
        sized = docs.withColumn(size, word_count(F.col(text)))
        sized = checkpointed(sized.select(key, source, size, *carry))
        sums = sized.groupBy(source).agg(F.sum(size).alias("__total"), F.count("*").alias("__n")).limit(MOST_SOURCES + 1).collect()
        if len(sums) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        sums.sort(key=lambda r: (r[0] is None, str(r[0]) if r[0] is not None else ""))
        total = [int(r["__total"] or 0) for r in sums]
        want = targets(total, [weights[i % len(weights)] for i in range(len(sums))], share, limit)
        length = [max(1, min(block, t // LEAST)) for t in total]
        blocks = [-(-t // n) for t, n in zip(total, length, strict=True)]
        quota = np.array([min(int(limit * n), round(w * n / t)) if t else 0 for w, n, t in zip(want, blocks, total, strict=True)], dtype="int64")
        kind = docs.schema[source].dataType.simpleString()
        self.sources = spark.createDataFrame([(i, r[0], t, float(w), n) for i, (r, t, w, n) in enumerate(zip(sums, total, want, length, strict=True))], f"{sid} int, __source {kind}, source_size long, target double, __length long")
        named = F.broadcast(self.sources.select(sid, "__source"))
        placed = sized.join(named, sized[source].eqNullSafe(named["__source"])).drop("__source")
        self.docs = ordered(placed, [sid, key, *carry, size], size, sid)
        shards, each = -(-int(quota.sum()) // shard), np.array(blocks, dtype="int64")

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for group in pdf["id"].tolist():
                    for number, before, counts in shard_counts(quota, shard, seed, group * GROUP, (group + 1) * GROUP):
                        s = np.repeat(np.arange(len(counts)), counts)
                        k = np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts) + before[s]
                        yield pd.DataFrame({"shard": np.int32(number), sid: s.astype("int32"), "k": k, "epoch": (k // each[s]).astype("int32"), "block": permuted(k % each[s], each[s], (s + 1) * 1_000_003 + seed)})

        groups = -(-shards // GROUP)
        self.slots = spark.range(0, groups, 1, max(1, min(groups, 10_000))).mapInPandas(place, f"shard int, {sid} int, k long, epoch int, block long")

    def segments(self, *more: str) -> DataFrame:
        """Per document and block that it touches: the document's row, places in the document [from_word, to_word)."""
        b = F.col("__length")
        d = self.docs.where(F.col(self.size) > 0).join(F.broadcast(self.sources.select(self.sid, "__length")), self.sid)
        spread = d.select("row", self.sid, "start", self.size, "__length", *more, F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col(self.size) - 1) / b))).alias("block"))
        return spread.select("row", self.sid, "block", *more, F.greatest(F.lit(0), F.col("block") * b - F.col("start")).alias("from_word"), F.least(F.col(self.size), (F.col("block") + 1) * b - F.col("start")).alias("to_word"))

    def mixed(self) -> DataFrame:
        """The mix: shard, k (its source's slot), epoch, block and the documents' segments in it."""
        return self.slots.hint("merge").join(self.segments(), [self.sid, "block"])  # what slots grow to is in no statistics

    def taken(self) -> DataFrame:
        """Per document row: words that the mix takes of it."""
        return self.mixed().groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))


def apply_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixed corpus with the columns of docs: for each epoch that reads any of a document, one row whose text is the words it reads.

    A document read whole in an epoch keeps its text as it is; otherwise its
    text is the words of the blocks drawn, in order, joined by spaces.
    Documents without words are never drawn, so they go.
    """
    names = list(docs.columns)
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # their names can clash with no other here
    key, source, text = (docs.columns[names.index(c)] for c in (key, source, text))
    # a row is named by 128 bits over all its columns; the texts meet what is read of them by that name, in one shuffle
    every = docs.withColumns({"h1": F.xxhash64(*docs.columns), "h2": F.xxhash64(F.lit(1), *docs.columns)})
    mix = Mix(every, key, source, text, carry=("h1", "h2"), **options)
    read = mix.mixed().groupBy("row", "epoch").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("__n"), F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("__at"))
    picked = checkpointed(read.join(mix.docs.select("row", "h1", "h2", F.col(mix.size).alias("__size")), "row").drop("row"))
    if not mix.docs.groupBy("h1", "h2").count().where("count > 1").isEmpty():
        every = every.dropDuplicates(["h1", "h2"])  # equal rows: each has its own share in picked
    whole = every.join(picked, ["h1", "h2"])
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    part = let(words, lambda w: F.array_join(F.flatten(F.transform(F.col("__at"), lambda s: F.slice(w, (s["from_word"] + 1).cast("int"), (s["to_word"] - s["from_word"]).cast("int")))), " "))
    whole = whole.withColumn(text, F.when(F.col("__n") == F.col("__size"), F.col(text)).otherwise(part))
    if "n_chars" in names:
        c = docs.columns[names.index("n_chars")]
        whole = whole.withColumn(c, F.length(text).cast(docs.schema[c].dataType))
    return whole.select(*docs.columns).toDF(*names)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mix = Mix(docs)
    out = mix.docs.join(mix.taken(), "row", "left").join(F.broadcast(mix.sources.select(mix.sid, "source_size", "target")), mix.sid)
    return out.select("doc_id", F.col(mix.size).alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
