"""Exact top-k by inner product through a pivot-distance index.

Largest inner product becomes nearest neighbour by one more coordinate: with M
the largest norm, v' = (v, sqrt(M^2 - |v|^2)) and q' = (q, 0) have
|q' - v'|^2 = |q|^2 + M^2 - 2 q.v. Rows are keyed by their nearest pivot and
their distance to it and sorted by that key; ANNULUS consecutive rows of one
pivot form an annulus with known bounds of distance, ANNULI consecutive ones a
part. By the triangle inequality no row of an annulus is nearer to q' than
max(0, low - d, d - high), d the distance of q' to the pivot.

A query first searches the part that its own row lies in, which gives a score
that it is sure to reach, and so a radius. Queries are put in blocks of QUERIES by
their place in the index. Of a block and a pivot the annuli that any of its radii
reaches are one range of distances; ranges meet the table of annulus bounds, a row
for each annulus, by pivot and bucket of distance, and only the rows of annuli in
reach go to the block. Within a part a block expands its annuli by ascending bound,
and stops at the first whose bound is beyond what every query of it still needs.
Scores are integer sums in float64, exact below 2^53, and bounds are widened by
more than their rounding error; results are exact whatever the pivots. Pivots
are a bounded sample (PIVOTS rows); every row is indexed.

The driver holds the pivots and counts only. Parts and query blocks have a fixed
size, so that memory is bounded; their number grows with the data. What is shuffled
follows the number of (block, annulus) pairs in reach, which search() leaves in
`examined`, of `possible`. A query set against all rows is quadratic where bounds
prune nothing: vectors without clusters in many dimensions, as embeddings of random
text, are such a case, and a row then goes to each block.

Vectors that are null, or hold a null, NaN or infinite component, take no part,
as do vectors that are empty or shorter or longer than most (the length that
most rows have; of equally frequent ones the largest). Ties go to the smaller
id. Rows with the same id are all candidates of other queries, none of their
own; each is a query once per distinct id and vector. Fewer than k candidates
give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docustrata.llm.common import counted, ordered, written

#: Pivots; rows of an annulus; annuli of a part; queries of a block; buckets of distance.
PIVOTS, ANNULUS, ANNULI, QUERIES, BUCKETS = 64, 256, 8, 2048, 256


def quantized(vector: Column) -> Column:
    """floor(256 * x), x as double, as array<double>; null if the vector takes no part."""
    ok = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(ok & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of array<double> as a matrix, without a copy for each row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of rows (v, extra) to pivots, which have the extra coordinate last."""
    dots = v @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1][None, :]
    return np.sqrt(np.maximum(((v * v).sum(1) + extra * extra)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * dots, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query: scores down, ids up."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        scores, ids = scores[near], ids[near]
    o = np.lexsort((ids, -scores))[:k]
    return scores[o], ids[o]


class PivotIndex:
    def __init__(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, annulus: int = ANNULUS, annuli: int = ANNULI):
        self.spark, self.annulus = rows.sparkSession, annulus
        v = rows.select(F.col(key).cast("long").alias("id"), quantized(F.col(vector)).alias("v")).where("v is not null and id is not null")
        most = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
        self.empty = not most
        if self.empty:
            return
        self.dim = dim = int(most[0]["dim"])
        v = v.where(F.size("v") == dim).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        self.top = top = float(v.agg(F.max("norm2")).first()[0])
        sample = v.orderBy(F.xxhash64("id", F.lit(7)), "id", "v").limit(pivots).collect()
        self.pivots = np.array([[*r["v"], np.sqrt(max(0.0, top - r["norm2"]))] for r in sample])
        p = self.pivots

        def key_by_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    m = matrix(b.column(1), dim)
                    d = distances(m, np.sqrt(np.maximum(top - (m * m).sum(1), 0)), p)
                    near = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype("int32")), pa.array(d[np.arange(len(d)), near]), pa.array([1] * b.num_rows, pa.int64())], names=["id", "v", "pivot", "dist", "one"])

        keyed = written(v.select("id", "v").mapInArrow(key_by_pivot, "id long, v array<double>, pivot int, dist double, one long"), "pivots")
        placed = ordered(keyed, ["pivot", "dist", "id"], "one", "pivot")
        # start is the row's place within its pivot; an annulus never spans pivots, a part may
        placed = placed.select("id", "v", "pivot", "dist", F.floor(F.col("start") / annulus).cast("long").alias("ring"), F.floor(F.col("row") / (annulus * annuli)).cast("long").alias("part"))
        self.rows = written(placed, "annuli")
        self.examined = self.possible = 0

    def bucket(self, dist: Column) -> Column:
        """0 to BUCKETS - 1; no two rows are farther from each other than the diameter of the ball of norm sqrt(top)."""
        width = 2 * float(np.sqrt(self.top)) / BUCKETS or 1.0
        return F.least(F.greatest(F.floor(dist / width), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")

    def in_reach(self, queries: DataFrame) -> DataFrame:
        """block, part, pivot, ring: the annuli that a query of the block may need. queries: block, v, sure."""
        top, p, dim = self.top, self.pivots, self.dim

        def ranges(t: pa.Table) -> pa.Table:
            q, sure = matrix(t.column("v").combine_chunks(), dim), t.column("sure").to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                radius = np.sqrt(np.maximum((q * q).sum(1) + top - 2 * sure, 0)) + 1e-6 * (1 + np.sqrt(top))
            d = distances(q, np.zeros(len(q)), p)
            return pa.table({"block": [t.column("block")[0].as_py()] * len(p), "pivot": pa.array(range(len(p)), pa.int32()), "low": (d - radius[:, None]).min(0), "high": (d + radius[:, None]).max(0)})

        span = lambda low, high: F.explode(F.sequence(self.bucket(F.col(low)), self.bucket(F.col(high)))).alias("at")
        wanted = queries.select("block", "v", "sure").groupBy("block").applyInArrow(ranges, "block long, pivot int, low double, high double")
        wanted = wanted.select("block", "pivot", F.col("low").alias("from"), F.col("high").alias("to"), span("low", "high"))
        bounds = self.rows.groupBy("part", "pivot", "ring").agg(F.min("dist").alias("low"), F.max("dist").alias("high"))
        bounds, rings = counted(bounds)
        meet = wanted.join(bounds.select("*", span("low", "high")), ["pivot", "at"])
        once = F.col("at") == F.greatest(self.bucket(F.col("from")), self.bucket(F.col("low")))  # of the buckets that both touch
        found, self.examined = counted(meet.where((F.col("high") >= F.col("from")) & (F.col("low") <= F.col("to")) & once).select("block", "part", "pivot", "ring"))
        self.possible = rings * queries.select("block").distinct().count()
        return found

    def search(self, is_query: Column, k: int, block: int = QUERIES) -> DataFrame:
        """query_id, rank, id, score of the k best of every row whose id fulfils is_query."""
        schema = "query_id long, q long, id long, score long"
        if self.empty:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, score long")
        top, p = self.top, self.pivots
        asked = self.rows.withColumn("asks", is_query).withColumn("q", F.xxhash64("v"))

        def rings(pdf: pd.DataFrame) -> list[tuple[float, float, int, np.ndarray, np.ndarray]]:
            return [(g["dist"].min(), g["dist"].max(), int(pivot), g["id"].to_numpy("int64"), np.stack(g["v"].to_numpy())) for (pivot, _), g in pdf.groupby(["pivot", "ring"], sort=True)]

        def expand(qid: np.ndarray, q: np.ndarray, sure: np.ndarray, parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Place of the query, id and score of its k best. sure: a score that each query is known to reach."""
            q2, d = (q * q).sum(1), distances(q, np.zeros(len(q)), p)
            lows, highs, at = np.array([r[0] for r in parts]), np.array([r[1] for r in parts]), [r[2] for r in parts]
            near = np.maximum(0, np.maximum(lows[None, :] - d[:, at], d[:, at] - highs[None, :]) - 1e-6 * (1 + np.sqrt(top)))
            reach = (q2[:, None] + top - near * near) / 2 + 1e-6 * (1 + top)  # no row of the annulus scores more
            score, ids = np.full((len(q), k), -np.inf), np.zeros((len(q), k), dtype="int64")
            order = np.argsort(-reach.max(0), kind="stable")
            for n, r in enumerate(order):
                need = np.maximum(sure, score[:, -1])
                if not (reach[:, order[n:]] >= need[:, None]).any():
                    break
                who = np.flatnonzero(reach[:, r] >= need)
                s = q[who] @ parts[r][4].T
                ok = (parts[r][3][None, :] != qid[who][:, None]) & (s >= need[who][:, None])
                for row in np.flatnonzero(ok.any(1)):
                    i, other = who[row], ok[row]
                    a, b = best(np.concatenate([score[i], s[row][other]]), np.concatenate([ids[i], parts[r][3][other]]), k)
                    score[i, : len(a)], ids[i, : len(b)] = a, b
            i, j = np.nonzero(score > -np.inf)
            return i, ids[i, j], score[i, j].astype("int64")

        def own(pdf: pd.DataFrame) -> pd.DataFrame:
            asks = pdf[pdf["asks"].fillna(False).astype(bool)]
            if not len(asks):
                return pd.DataFrame({"query_id": [], "q": [], "v": np.empty(0, dtype=object), "pivot": [], "dist": [], "sure": []})
            i, _, score = expand(asks["id"].to_numpy("int64"), np.stack(asks["v"].to_numpy()), np.full(len(asks), -np.inf), rings(pdf))
            sure = [float(np.sort(score[i == n])[-k]) if (i == n).sum() >= k else -np.inf for n in range(len(asks))]
            return pd.DataFrame({"query_id": asks["id"], "q": asks["q"], "v": asks["v"], "pivot": asks["pivot"], "dist": asks["dist"], "sure": sure}).drop_duplicates(["query_id", "q"])

        queries = asked.groupBy("part").applyInPandas(own, "query_id long, q long, v array<double>, pivot int, dist double, sure double")
        queries = queries.groupBy("query_id", "q").agg(*(F.first(c).alias(c) for c in ("v", "pivot", "dist")), F.max("sure").alias("sure"))
        queries = ordered(written(queries.withColumn("one", F.lit(1).cast("long")), "queries"), ["pivot", "dist", "query_id", "q"], "one")
        queries = written(queries.select("query_id", "q", "v", "sure", F.floor(F.col("row") / block).alias("block")), "blocks")
        pairs = self.in_reach(queries)

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "q": [], "id": [], "score": []})
            i, ids, score = expand(left["query_id"].to_numpy("int64"), np.stack(left["v"].to_numpy()), left["sure"].to_numpy(float), rings(right))
            return pd.DataFrame({"query_id": left["query_id"].to_numpy()[i], "q": left["q"].to_numpy()[i], "id": ids, "score": score})

        left = queries.join(pairs.select("block", "part").distinct(), "block").groupBy("part", "block")
        right = self.rows.join(pairs, ["part", "pivot", "ring"]).groupBy("part", "block")
        found = left.cogroup(right).applyInPandas(meet, schema)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return PivotIndex(rows).search(F.col("id") % 50 == 0, 5).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_sql() -> str:
    return """WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
