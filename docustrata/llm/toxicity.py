"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its lower-cased words (runs of letters) and their first four
and five characters, hashed to BUCKETS numbers; a text has or lacks a term. The
score is the logistic of

    bias + sum_i w_i + sum_{i<j} <v_i, v_j>

over the terms it has, so that pairs of terms, as an insult with the mention of
a group, weigh more or less than their sum.

The machine is fitted by Adam in numpy on SAMPLE rows of each label at most. Terms
of the sample that LEAST texts have are counted over executors. Half of the TERMS
features are those of the largest chi-square against the label. The other half are
those of the largest chi-square among the texts that have one of the PARTNERS
strongest of them: terms that say little alone but much beside another one. Fitting
takes labels from rows that are not held out only; scores use the text alone.
Labels are thinned at different rates; the log of their ratio is taken from the
bias after fitting, so that scores are at the rate of label 1 in the whole table.

Scoring is one pass over the table without a shuffle: words are made distinct
within a batch, looked up once, and only features go on to the sums.

Null and empty texts have no terms and score the bias. Without labels of both
kinds the score is the share of label 1 (0 without any). Where a key has several
labels the larger holds. Extra columns and repeated rows are kept as they are; a
column named as the score is refused with an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docustrata.llm.common import checkpointed, discard, free_name, fresh_names, held_out
from docustrata.llm.sampling import labelled_sample, sampling_rates
from docustrata.llm.tokens import chunks, release

BUCKETS, TERMS, PARTNERS, LEAST, RANK, SAMPLE = 1 << 20, 1024, 16, 3, 8, 5000
#: Score from which a document is rejected; words a worker remembers.
THRESHOLD, REMEMBERED = 0.3, 100_000
LETTERS = re.compile(r"[^\W\d_]+")


def terms(token: str) -> list[int]:
    """Hashed terms of what stands between white space."""
    out = []
    for w in LETTERS.findall(token.lower()):
        forms = [f"={w}"] + [f"{n}{w[:n]}" for n in (4, 5) if len(w) > n]
        out += [zlib.crc32(f.encode()) % BUCKETS for f in forms]
    return out


@dataclass
class Machine:
    bias: float
    buckets: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Of n texts; doc and term: distinct pairs of a text and a feature that it has."""
        out = self.bias + np.bincount(doc, self.w[term], n)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out

    def score(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(doc, term, n), -30, 30)))


class Finder:
    """Pairs of a text and a feature that it has."""

    def __init__(self, buckets: np.ndarray):
        self.feature = {int(b): i for i, b in enumerate(buckets)}
        self.known: dict[str, tuple[int, ...]] = {}

    def features(self, token: str) -> tuple[int, ...]:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            got = self.known[token] = tuple({self.feature[t] for t in terms(token) if t in self.feature})
        return got

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        found = [self.features(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)]
        codes, has = coded.indices.to_numpy(), np.array([bool(f) for f in found], dtype=bool)
        at = np.flatnonzero(has[codes]) if len(found) else np.empty(0, dtype="int64")
        doc = np.searchsorted(bounds, at, "right") - 1
        each = np.unique(doc * len(found) + codes[at]) if len(at) else np.empty(0, dtype="int64")
        rows = [(d, t) for d, c in zip(*np.divmod(each, max(1, len(found))), strict=True) for t in found[c]]
        both = np.unique(np.array(rows, dtype="int64").reshape(-1, 2), axis=0)
        return both[:, 0], both[:, 1]


def count_terms(sample: DataFrame, partners: list[int] | None = None) -> DataFrame:
    """partner, term, n1, n0: texts of label 1 and 0 that have both; without partners (then -1) all that have the term."""
    wanted = None if partners is None else np.array(sorted(partners), dtype="int64")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in chunks(batches, 0):
            by, known = ([], []), {}
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set(text.split())
                for w in words - known.keys():
                    known[w] = terms(w)
                has = np.fromiter({t for w in words for t in known[w]}, dtype="int64")
                beside = np.array([-1]) if wanted is None else has[np.isin(has, wanted)]
                by[label].append((beside[:, None] * BUCKETS + has[None, :]).ravel())
            found = [np.unique(np.concatenate([np.empty(0, dtype="int64"), *x]), return_counts=True) for x in by]
            keys = np.union1d(found[0][0], found[1][0])
            counts = np.zeros((2, len(keys)), dtype="int64")
            for y, (k, n) in enumerate(found):
                counts[y, np.searchsorted(keys, k)] = n
            partner, term = np.divmod(keys, BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array(partner), pa.array(term), pa.array(counts[1]), pa.array(counts[0])], names=["partner", "term", "n1", "n0"])

    counted = sample.select("text", F.col("label").cast("int")).mapInArrow(count, "partner long, term long, n1 long, n0 long")
    return counted.groupBy("partner", "term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") + F.col("n0") >= LEAST)


def chi_square(a: Column, b: Column, n1: Column, n0: Column) -> Column:
    """Of having a term against the label: a and b of n1 and n0 texts have it."""
    return F.when((n1 > 0) & (n0 > 0), F.pow(a * n0 - b * n1, F.lit(2)) * (n1 + n0) / (n1 * n0 * (a + b) * (n1 + n0 - a - b + 1))).otherwise(0.0)


def chosen_terms(rows: DataFrame, n1: int, n0: int, features: int) -> list[int]:
    """The terms that become features: the strongest alone, then the strongest beside one of those."""
    a, b, d = F.col("n1").cast("double"), F.col("n0").cast("double"), lambda x: F.lit(float(x))
    alone = count_terms(rows).withColumn("chi", chi_square(a, b, d(n1), d(n0))).orderBy(F.desc("chi"), "term").limit(features - features // 2).collect()
    first = [r["term"] for r in alone]
    if not features // 2 or not first:
        return first
    partners = first[:PARTNERS]
    both = checkpointed(count_terms(rows, partners))
    size = both.where("partner = term").select("partner", F.col("n1").cast("double").alias("m1"), F.col("n0").cast("double").alias("m0"))  # PARTNERS rows
    beside = both.where("partner <> term").join(F.broadcast(size), "partner").where(~F.col("term").isin(first))
    beside = beside.groupBy("term").agg(F.max(chi_square(a, b, F.col("m1"), F.col("m0"))).alias("chi")).orderBy(F.desc("chi"), "term").limit(features // 2).collect()
    return first + [r["term"] for r in beside]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, features: int = TERMS, rank: int = RANK, seed: int = 1) -> Machine:
    """labels: rows (key, label 0 or 1) to learn from; the caller leaves out what is held out."""
    one = labels.groupBy(key).agg(F.max(label).cast("int").alias("y")).where("y in (0, 1)")
    rates = sampling_rates(one, key, "y", sample, 2)
    rows = labelled_sample(docs, one, key, text, "y", sample, rates)
    n1, n0 = (int(x or 0) for x in rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first())
    none = np.empty(0, dtype="int64")
    if not n1 or not n0:
        return Machine(30.0 if n1 else -30.0, none, np.empty(0), np.empty((0, rank)))
    buckets = np.array(chosen_terms(rows, n1, n0, features), dtype="int64")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        finder = Finder(buckets)
        for batch in chunks(batches, 1):
            doc, term = finder.pairs(batch.column(1))
            has = np.split(term.astype("int32"), np.searchsorted(doc, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([h.tolist() for h in has], pa.list_(pa.int32()))], names=["key", "label", "has"])

    kind = rows.schema["key"].dataType.simpleString()
    data = rows.select("key", "text", F.col("label").cast("int")).mapInArrow(encode, f"key {kind}, label int, has array<int>").orderBy("key").collect()
    discard(rows)
    y = np.array([r["label"] for r in data], dtype=float)
    doc = np.repeat(np.arange(len(data)), [len(r["has"]) for r in data])
    term = np.array([t for r in data for t in r["has"]], dtype="int64")
    machine = train(Machine(float(np.log(n1 / n0)), buckets, np.zeros(len(buckets)), np.random.default_rng(seed).normal(0, 0.01, (len(buckets), rank))), doc, term, y)
    machine.bias -= float(np.log(rates[1] / rates[0]))
    return machine


def train(m: Machine, doc: np.ndarray, term: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-3) -> Machine:
    """Adam on the logistic loss over all rows, with squared weights added."""
    n, f = len(y), len(m.buckets)
    params = [np.array([m.bias]), m.w, m.v]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        m.bias, m.w, m.v = float(params[0][0]), params[1], params[2]
        g = (m.score(doc, term, n) - y) / n
        sums = np.stack([np.bincount(doc, m.v[term, k], n) for k in range(m.v.shape[1])], axis=1)
        gd = g[doc]
        part = gd[:, None] * (sums[doc] - m.v[term])
        grads = [np.array([g.sum()]), np.bincount(term, gd, f) + decay / n * m.w, np.stack([np.bincount(term, part[:, k], f) for k in range(m.v.shape[1])], axis=1) + decay / n * m.v]
        for p, d, a, b in zip(params, grads, means, squares, strict=True):
            a *= 0.9
            a += 0.1 * d
            b *= 0.999
            b += 0.001 * d * d
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    m.bias, m.w, m.v = float(params[0][0]), params[1], params[2]
    return m


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column name (0 to 1)."""
    fresh_names(docs, name)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # TERMS * (RANK + 2) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = sent.value
        finder = Finder(m.buckets)
        for b in chunks(batches, at):
            scores = m.score(*finder.pairs(b.column(at)), b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def training_labels(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    return labels.where(~held_out(F.col(key))).select(key, label)


def reject_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more."""
    name = free_name(docs, "toxicity")
    machine = fit(docs, training_labels(labels, key, label), key, text, label)
    return score(docs, machine, text, name).where(F.col(name) < threshold).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, training_labels(labels)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
