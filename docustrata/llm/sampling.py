"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docustrata.llm.common import written


def sampling_rates(labels: DataFrame, key: str, label: str, per_label: int, most_labels: int) -> dict:
    """The share of its rows that labelled_sample takes of each label. More labels than most_labels are an error: none is left out silently."""
    labels = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = labels.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels; raise most_labels to learn them all")
    return {r[0]: min(1.0, per_label / r["n"]) for r in counts}


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int, rates: dict) -> DataFrame:
    """About per_label rows (key, text, label) at most of each label, chosen by a hash of the key alone.

    labels: (key, label), one row per key; rates: what sampling_rates gave. Labels
    are thinned before they meet the texts: the chosen keys, labels * per_label at
    most but for the spread of hashing, are broadcast. Rarer labels are taken whole.
    Of rows that repeat a key one is taken. The sample is written to the shared folder.
    """
    shares = labels.sparkSession.createDataFrame(list(rates.items()), f"__value {labels.schema[label].dataType.simpleString()}, __share double")
    labels = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).join(F.broadcast(shares), F.col(label) == F.col("__value"))
    unit = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labels.where(unit < F.col("__share")).groupBy(key).agg(F.max(label).alias("__label"))
    rows = docs.where(F.col(text).isNotNull()).select(key, text).join(F.broadcast(chosen), key)
    rows = rows.groupBy(key).agg(F.min(F.struct(F.col(text).alias("text"), F.col("__label").alias("label"))).alias("r"))
    return written(rows.select(F.col(key).alias("key"), "r.text", "r.label"), "sample")
