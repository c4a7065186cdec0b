"""Near-duplicate documents by an LSH forest of MinHash signatures.

1. Words are lower-cased (A-Z); a document's set is its distinct runs of WORDS
   words (the whole sequence if it has fewer), each as a 64-bit hash. Documents
   with equal sets, told by 128 bits over the whole set, form a class; from here
   on a class has one row, so that thousands of copies cost no more than one.
2. A class has TREES labels of DEPTH minima each. Each tree is a sorted order of
   all classes by their label in it; classes that share a prefix of d minima are
   a region of depth d, and two sets of similarity s share it with chance s^d.
   A pair at 0.8 shares no region of depth START in any tree with a chance of
   about one in two million (at 0.85 one in 200 million).
3. First candidates are the longest-common-prefix neighbours: classes next to each
   other in some order that share START minima. The orders are range-partitioned by
   the label itself, so that no region, however large, lies in one task. Each class
   is confirmed against its closest one (by prefixes summed over trees), then all
   neighbours that are still in different components.
4. Regions of depth START that still hold several components are searched wholly,
   but for pairs that have been compared. A region of up to SMALL classes gives its
   pairs. A larger one grows deeper, class by class, until it has SMALL at most, and
   gives its pairs there; pairs that part on the way down come from an exact join:
   the classes of larger regions, rarest shingles first, are linked only if they
   share one of their first n - ceil(t n) + 1 of n shingles (prefix filter), and
   every pair that does is compared. A shingle that more than SHARED classes have
   among their first is dealt into blocks, and every block meets every other one.

Confirming compares full sets, which are read again for candidates only. Nothing
else rejects a pair but sizes that can't reach the threshold. Links inside a
component are not looked for: they change no component.

Documents, links and components stay distributed; rounds are checkpointed.
Components come from label propagation with pointer jumping; a class has at most
two neighbours in each tree, so no task gets the links of a hub. Joins on a label,
which all members of a component share, are salted.

Null and empty texts and texts without words have an empty set, are linked with
nothing and are their own component. Rows that share an id stand for one document
in component_id, which is the smallest id that a row's links reach. Rows without
an id get a size; they can be linked, and have the smallest id of their component
(none if no row of it has one) and count as kept. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docustrata.llm.common import WORD, checkpointed, counted, discard, salted, written
from docustrata.llm.tokens import chunks, release

WORDS, THRESHOLD = 5, (80, 100)
TREES, DEPTH, START, SMALL, SEED = 20, 8, 3, 16, 20240229
#: Classes that share a shingle among their first before they are compared in blocks.
SHARED = 64
#: Classes and shingles of a block; a shingle of FEW classes or more is counted by a matrix product.
BLOCK_ROWS, BLOCK_SHINGLES, FEW = 2048, 1 << 19, 64
#: A class of copies with more than one in MOST rows is joined by broadcast; there are MOST such classes at most.
MOST = 1000
#: Shingles whose minima are taken at a time; they and their hashes fit a core's cache.
AT_ONCE = 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Lower case for A-Z, a space for what parts words. Bytes of other characters are none of these.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")


def plain_words(texts: pa.Array) -> pa.Array:
    """The texts, null as empty, in lower case (A-Z) and with spaces between words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer((data or pa.py_buffer(b"")).to_pybytes().translate(PLAIN))], 0, texts.offset)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The set of each text, ascending."""
    split = pc.split_pattern(plain_words(texts), " ")
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names], dtype="uint64")
    codes = coded.indices.to_numpy()
    real = np.array([bool(w) for w in names], dtype=bool)[codes] if len(names) else np.empty(0, dtype=bool)
    ends = np.concatenate([[0], np.cumsum(real)])[bounds]
    h = hashes[codes[real]] if len(names) else np.empty(0, dtype="uint64")
    step = np.uint64(0x9E3779B97F4A7C15)

    def run(parts: list[np.ndarray]) -> np.ndarray:
        acc = np.full_like(parts[0], len(parts))
        for x in parts:
            acc = acc * step + x
            acc ^= acc >> np.uint64(29)
        return mixed(acc)

    rolled = run([h[i : len(h) - words + 1 + i] for i in range(words)]) if len(h) >= words else h[:0]
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(rolled[a : b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(run([h[i : i + 1] for i in range(a, b)]) if b > a else h[:0])
    return out


def constants(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, trees * depth, dtype="uint32") | np.uint32(1), rng.integers(0, 1 << 32, trees * depth, dtype="uint32")


def signatures(sets: list[np.ndarray], trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """Minima (rows: sets, which must not be empty) of trees * depth permutations of 32 bits of the hashes."""
    mul, add = constants(trees, depth)
    out = np.full((len(sets), len(mul)), 0xFFFFFFFF, dtype="uint32")
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= AT_ONCE):
            total += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        x = (x ^ (x >> np.uint64(32))).astype("uint32")
        starts = np.cumsum([0, *(len(s) for s in sets[i : j - 1])])
        tmp = np.empty_like(x)
        for k in range(len(mul)):
            np.multiply(x, mul[k], out=tmp)
            tmp += add[k]
            tmp ^= tmp >> np.uint32(15)
            out[i:j, k] = np.minimum.reduceat(tmp, starts)
        i = j
    return out


def set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits over each whole set."""
    both = [xxhash.xxh3_128_intdigest(s.astype("<u8").tobytes()) for s in sets]
    return np.array([(b >> 64) - (1 << 63) for b in both], dtype="int64"), np.array([(b & ((1 << 64) - 1)) - (1 << 63) for b in both], dtype="int64")


def signed_rows(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, n, h1, h2, sig: a row for each document; names and signature are null for empty sets."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in chunks(batches, 1):
            sets = shingle_sets(b.column(1), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                sig[i] = row.astype(">u4").tobytes()  # big-endian: bytes sort as the minima do
            h1, h2 = set_names(sets)
            empty = np.array([not len(s) for s in sets], dtype=bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, mask=empty), pa.array(h2, mask=empty), pa.array(sig, pa.binary())], names=[key, "n", "h1", "h2", "sig"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n long, h1 long, h2 long, sig binary")


class Forest:
    """classes: c, id (smallest of its documents), copies, n, h1, h2, sig."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD):
        self.docs, self.key, self.text, self.words, self.threshold = docs.select(key, text), key, text, words, threshold
        made = written(signed_rows(docs, key, text, words), "signed")
        groups = made.where("h1 is not null").groupBy("h1", "h2").agg(F.min(key).alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        self.classes = written(groups.withColumn("c", F.monotonically_increasing_id()), "classes")
        self.rows, self.count = counted(made.select(F.col(key), "n", "h1", "h2"))
        discard(made)

    def entries(self) -> DataFrame:
        """tree, label, c, n: a row for each class and tree."""
        w = 4 * DEPTH
        trees = F.explode(F.array(*(F.struct(F.lit(t).cast("byte").alias("tree"), F.substring("sig", t * w + 1, w).alias("label")) for t in range(TREES))))
        return self.classes.select("c", "n", trees.alias("e")).select("e.tree", "e.label", "c", "n")

    def fits(self, one: Column, two: Column) -> Column:
        """Whether sets of these sizes can reach the threshold."""
        num, den = self.threshold
        return F.least(one, two) * den >= F.greatest(one, two) * num

    def neighbours(self) -> DataFrame:
        """a, b (a < b), near, fits: summed common prefixes of classes that stand next to each other in some order, and whether their sizes allow a link."""
        order = self.entries().repartitionByRange("tree", "label", "c").sortWithinPartitions("tree", "label", "c")
        num, den = self.threshold
        names = ["a", "b", "near", "fits", "tree", "label", "n"]

        def common(one: list[bytes], two: list[bytes]) -> np.ndarray:
            x, y = (np.frombuffer(b"".join(v), dtype="uint32").reshape(-1, DEPTH) for v in (one, two))
            same = x == y
            return np.where(same.all(1), DEPTH, same.argmin(1))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Pairs of a partition, and its first and last row (near: -1), which may have a neighbour in another one."""

            def edge(tree: int, label: bytes, c: int, n: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([c]), pa.array([c]), pa.array([-1], pa.int32()), pa.array([False]), pa.array([tree], pa.int8()), pa.array([label], pa.binary()), pa.array([n])], names=names)

            last = None
            for b in batches:
                if not b.num_rows:
                    continue
                tree, label, c, n = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy(), b.column(3).to_numpy()
                if last is None:
                    yield edge(int(tree[0]), label[0], int(c[0]), int(n[0]))
                else:
                    tree, label, c, n = np.concatenate([[last[0]], tree]), [last[1], *label], np.concatenate([[last[2]], c]), np.concatenate([[last[3]], n])
                if len(c) > 1:
                    near = np.where(tree[1:] == tree[:-1], common(label[:-1], label[1:]), 0)
                    k = np.flatnonzero(near >= START)
                    one, two, small, large = c[:-1][k], c[1:][k], np.minimum(n[:-1], n[1:])[k], np.maximum(n[:-1], n[1:])[k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(near[k].astype("int32")), pa.array(small * den >= large * num), pa.nulls(len(k), pa.int8()), pa.nulls(len(k), pa.binary()), pa.nulls(len(k), pa.int64())], names=names)
                last = (int(tree[-1]), label[-1], int(c[-1]), int(n[-1]))
            if last is not None:
                yield edge(*last)

        found = checkpointed(order.mapInArrow(walk, "a long, b long, near int, fits boolean, tree byte, label binary, n long"))
        at = Window.partitionBy("tree").orderBy("label", "a")  # two rows of each partition
        edges = found.where("near < 0").select("tree", "label", "a", "n", *(F.lead(c).over(at).alias(to) for c, to in (("label", "after"), ("a", "b"), ("n", "m"))))
        shared = F.lit(0)
        for d in range(START, DEPTH + 1):
            shared = F.when(F.substring("label", 1, 4 * d) == F.substring("after", 1, 4 * d), d).otherwise(shared)
        edges = edges.where("b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), shared.alias("near"), self.fits(F.col("n"), F.col("m")).alias("fits")).where(F.col("near") >= START)
        return checkpointed(found.where("near >= 0").select("a", "b", "near", "fits").unionByName(edges).groupBy("a", "b").agg(F.sum("near").alias("near"), F.first("fits").alias("fits")))

    def sets_of(self, candidates: DataFrame) -> DataFrame:
        """c, set (hashes, ascending, as bytes) of the classes in candidates, from the text of a document that has the smallest id."""
        names = self.classes.select("c", "id", "h1", "h2").join(candidates, "c")
        with_id = self.docs.withColumnRenamed(self.key, "id").join(names.where("id is not null").select("id").distinct(), "id", "left_semi")
        texts = with_id.unionByName(self.docs.where(F.col(self.key).isNull()).select(F.col(self.key).alias("id"), self.text)).select("id", self.text)
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for b in chunks(batches, 1):
                sets = shingle_sets(b.column(1), words)
                h1, h2 = set_names(sets)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["h1", "h2", "set"])

        made = texts.mapInArrow(run, "h1 long, h2 long, set binary")
        return written(made.join(names.select("c", "h1", "h2"), ["h1", "h2"]).groupBy("c").agg(F.first("set").alias("set")), "sets")

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that the threshold links."""
        num, den = self.threshold

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                linked = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(common * den >= num * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

        one, two = (sets.select(F.col("c").alias(c), F.col("set").alias(x)) for c, x in (("a", "x"), ("b", "y")))
        return checkpointed(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))

    def components(self) -> DataFrame:
        """c, l: the component of each class that has a link; l is the smallest c in it."""
        pairs = self.neighbours()
        ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        sets = self.sets_of(ends)
        fit = pairs.where("fits")
        # the closest candidate of each class
        each = fit.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))).alias("e"), "near")
        best = each.groupBy("e.c").agg(F.max(F.struct("near", "e.o")).alias("m")).select(F.least("c", "m.o").alias("a"), F.greatest("c", "m.o").alias("b")).distinct()
        first = self.confirmed(best, sets)
        # classes of one label are linked, those of one component needn't have the same label yet
        rest = self.confirmed(between(fit, connected(first, 1)), sets)
        labels = connected(first.unionByName(rest))
        open_, left = self.regions(ends, labels)
        if left:
            labels = self.searched(open_, labels, fit, sets)
        discard(sets)
        return labels

    def regions(self, ends: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
        """region, size, tree, label, c, n, l of regions of depth START that hold several components and more than the two classes of a compared pair; number of rows."""
        rows = self.entries().join(ends, "c").join(labels, "c", "left")
        rows = rows.select(F.xxhash64("tree", F.substring("label", 1, 4 * START)).alias("region"), "tree", "label", "c", "n", F.coalesce("l", "c").alias("l"))
        return counted(several(rows, 3))

    def searched(self, open_: DataFrame, labels: DataFrame, compared: DataFrame, sets: DataFrame) -> DataFrame:
        """labels after all pairs of these regions."""
        narrow = ("region", "size", "c", "n", "l")
        crowded = open_.where(F.col("size") > SMALL)
        # adaptive depth: the first one at which a class has SMALL beside it at most
        deep = crowded.select("c", "n", "l", "tree", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.xxhash64("tree", F.substring("label", 1, 4 * d)).alias("region")) for d in range(START + 1, DEPTH + 1)))).alias("e"))
        deep = several(deep.select("c", "n", "l", "tree", "e.d", "e.region"), 2, "d").where(F.col("size") <= SMALL)
        deep = deep.groupBy("tree", "c", "n", "l").agg(F.min(F.struct("d", "region", "size")).alias("m")).select("m.region", "m.size", "c", "n", "l")
        found = open_.where(F.col("size") <= SMALL).select(*narrow).unionByName(deep)
        prefixes, left = self.prefixes(crowded.select("c", "n", "l").distinct(), sets)
        found = self.pairs_of(found.unionByName(prefixes.where(F.col("size") <= SHARED).select(*narrow)))
        links = self.confirmed(found.join(compared.select("a", "b"), ["a", "b"], "left_anti"), sets)
        if left:
            links = links.unionByName(self.blocks(prefixes.where(F.col("size") > SHARED).select("region", "c", "n", "l"), sets))
        return linked(labels, links)

    def pairs_of(self, rows: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) of different components within a region whose sizes allow a link."""
        one, two = (rows.select("region", F.col("c").alias(x), F.col("l").alias(f"l{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
        return one.join(two, "region").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & self.fits(F.col("na"), F.col("nb"))).select("a", "b").distinct()

    def prefixes(self, classes: DataFrame, sets: DataFrame) -> tuple[DataFrame, int]:
        """region (a shingle), size, c, n, l: the first shingles of each class, rarest first, that classes of several components have among theirs; number of rows."""
        num, den = self.threshold

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                every = [np.frombuffer(x.as_buffer(), dtype="<i8") for x in b.column(3)]
                ends, i = np.cumsum([len(x) for x in every]), 0
                while i < len(every):  # about BLOCK_SHINGLES at a time; a longer set alone
                    j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_SHINGLES, "right")))
                    row = pa.array(np.repeat(np.arange(i, j), [len(x) for x in every[i:j]]))
                    yield pa.RecordBatch.from_arrays([b.column(k).take(row) for k in range(3)] + [pa.array(np.concatenate(every[i:j]))], names=["c", "n", "l", "region"])
                    i = j

        every = classes.join(sets, "c").select("c", "n", "l", "set").mapInArrow(spread, "c long, n long, l long, region long")
        held = every.groupBy("region").agg(F.count("*").alias("held")).where("held > 1")
        each = Window.partitionBy("c")
        ranked = every.join(held, "region").select("region", "c", "n", "l", F.row_number().over(each.orderBy("held", "region")).alias("k"), F.count("*").over(each).alias("common"))
        first = F.col("n") - F.ceil(F.col("n") * num / den) + 1
        return counted(several(ranked.where((F.col("n") - F.col("common")) + F.col("k") <= first).select("region", "c", "n", "l"), 2))

    def blocks(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) that join all classes of a region that are linked in it. Blocks of its largest component
        are numbered from -1 down, those of the others from 0 up; each of the latter meets all blocks."""
        each = rows.groupBy("region", "l").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
        of = each.groupBy("region").agg(F.max(F.struct("size", "l", "n")).alias("m"), F.sum("size").alias("size"), F.sum("n").alias("n"))
        many = lambda size, n: F.ceil(F.greatest(size / BLOCK_ROWS, n / BLOCK_SHINGLES)).cast("int")
        of = of.select("region", F.col("m.l").alias("main"), many(F.col("m.size"), F.col("m.n")).alias("mains"), many(F.col("size") - F.col("m.size"), F.col("n") - F.col("m.n")).alias("others"))
        within = lambda k: F.pmod(F.xxhash64("c", F.lit(SEED)), F.col(k)).cast("int")
        dealt = rows.join(of, "region").withColumn("block", F.when(F.col("l") == F.col("main"), -1 - within("mains")).otherwise(within("others")))
        others = F.sequence(F.lit(0), F.col("others") - 1)
        meet = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
        mine = F.concat(F.transform(others, lambda k: meet(F.least("block", k), F.greatest("block", k))), F.transform(F.sequence(F.lit(1), F.col("mains")), lambda k: meet(F.col("block"), -k)))
        theirs = F.transform(others, lambda k: meet(k, F.col("block")))
        dealt = dealt.select("region", "c", "l", "block", F.explode(F.when(F.col("block") < 0, theirs).otherwise(mine)).alias("p")).select("region", "p.i", "p.j", "block", "c", "l")
        num, den = self.threshold

        def compare(t: pa.Table) -> pa.Table:
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            t = t.take(pa.array(np.argsort(t.column("block").to_numpy() != i, kind="stable")))  # i's rows first
            c, l = t.column("c").to_numpy(), t.column("l").to_numpy().copy()  # noqa: E741
            first = int((t.column("block").to_numpy() == i).sum())
            got = links_between([np.frombuffer(x.as_buffer(), dtype="<u8") for x in t.column("set")], l, first, 0 if i == j else first, num, den)
            one, two = (c[np.array([g[k] for g in got], dtype="int64")] for k in (0, 1))
            return pa.table({"a": np.minimum(one, two), "b": np.maximum(one, two)})

        return checkpointed(dealt.join(sets, "c").select("region", "i", "j", "block", "c", "l", "set").groupBy("region", "i", "j").applyInArrow(compare, "a long, b long").distinct())

    def result(self) -> DataFrame:
        """key, n_shingles, component_id, kept of every document."""
        labels = self.components()
        smallest = self.classes.select("c", "id").join(labels, "c").groupBy("l").agg(F.min("id").alias("least"))
        of = by_label(labels, smallest).select("c", "least")
        named = checkpointed(self.classes.select("c", "id", "copies", "h1", "h2").join(of, "c", "left").select("h1", "h2", "copies", F.coalesce("least", "id").alias("component_id")))
        discard(self.classes)
        key, many = F.col(self.key), F.col("copies") * MOST > self.count
        hot = named.where(many).select("h1", "h2", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
        # a class of copies with a great share of all rows is told to every task; there are few such classes, whatever the input
        rows = self.rows.join(F.broadcast(hot), ["h1", "h2"], "left")
        out = lambda df, component: df.select(self.key, F.col("n").alias("n_shingles"), component.alias("component_id"))
        lone, told = rows.where("h1 is null"), rows.where("hot")
        others = rows.where("h1 is not null and hot is null").join(named.where(~many), ["h1", "h2"], "left")
        every = out(lone, key).unionByName(out(told, F.col("hot_id"))).unionByName(out(others, F.col("component_id")))
        return every.withColumn("kept", F.coalesce(key == F.col("component_id"), F.lit(True)))


def links_between(sets: list[np.ndarray], l: np.ndarray, first: int, off: int, num: int, den: int) -> list[tuple[int, int]]:  # noqa: E741
    """Pairs (p, q), p < first, q >= off, p < q, that link what the threshold links of different components l, without those that close a ring. l is changed."""
    n = np.array([len(s) for s in sets], dtype="int64")
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    held = np.bincount(code, minlength=len(names))
    common = np.zeros((first, len(sets) - off), dtype="float32")
    at = np.flatnonzero((held[code] >= 2) & (held[code] < FEW))
    at = at[np.argsort(code[at], kind="stable")]  # rows of a shingle ascend
    k, r = code[at], row[at]
    for d in range(1, FEW - 1):
        p = np.flatnonzero(k[d:] == k[:-d])
        if not len(p):
            break
        p, q = r[p], r[p + d]
        ok = (p < first) & (q >= off)
        np.add.at(common, (p[ok], q[ok] - off), 1)
    heavy = np.flatnonzero(held >= FEW)
    place = np.full(len(names), -1)
    place[heavy] = np.arange(len(heavy))
    at = np.flatnonzero(place[code] >= 0)
    at = at[np.argsort(place[code[at]], kind="stable")]
    column, r = place[code[at]], row[at]
    for start in range(0, len(heavy), 1024):
        a, b = np.searchsorted(column, [start, start + 1024])
        has = np.zeros((len(sets), 1024), dtype="float32")
        has[r[a:b], column[a:b] - start] = 1
        common += has[:first] @ has[off:].T
    out = []
    for a in range(0, first, 256):
        b = min(first, a + 256)
        ok = common[a:b].astype("int64") * (den + num) >= num * (n[a:b, None] + n[None, off:])
        ok &= np.arange(a, b)[:, None] < np.arange(off, len(sets))[None, :]
        while True:
            ok &= l[a:b, None] != l[None, off:]
            hit = np.flatnonzero(ok.any(1))
            if not len(hit):
                break
            for p, q in zip((hit + a).tolist(), (ok[hit].argmax(1) + off).tolist(), strict=True):
                if l[p] != l[q]:
                    out.append((p, q))
                    l[l == l[p]] = l[q]
    return out


def several(rows: DataFrame, least: int, *more: str) -> DataFrame:
    """rows (region, c, n, l and others) of regions that hold several components and `least` classes or more, with the region's size."""
    sizes = rows.groupBy("region").agg(F.count("*").alias("size"), F.min("l").alias("l0"), F.max("l").alias("l1")).where((F.col("l0") != F.col("l1")) & (F.col("size") >= least))
    return rows.join(sizes.select("region", "size"), "region")


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends have different labels."""
    one, two = labels.withColumnsRenamed({"c": "a", "l": "la"}), labels.withColumnsRenamed({"c": "b", "l": "lb"})
    return pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def by_label(labels: DataFrame, of: DataFrame) -> DataFrame:
    """labels (c, l) with the columns of `of` (a row for each l at most), null where it has none."""
    return salted(labels, of, "l", ["c"])


def linked(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (c, l) after links (a, b) between classes are added to them."""
    one, two = labels.withColumnsRenamed({"c": "a", "l": "la"}), labels.withColumnsRenamed({"c": "b", "l": "lb"})
    links, left = counted(links.join(one, "a", "left").join(two, "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")))
    if not left:
        return labels
    fresh = connected(links.select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct())
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("la").alias("l")), F.struct(F.col("b").alias("c"), F.col("lb").alias("l")))).alias("e")).select("e.c", "e.l")
    every = labels.unionByName(ends.join(labels.select("c"), "c", "left_anti").distinct())
    return checkpointed(by_label(every, fresh.select(F.col("c").alias("l"), F.col("l").alias("to"))).select("c", F.coalesce("to", "l").alias("l")))


def connected(links: DataFrame, rounds: int = 0) -> DataFrame:
    """c, l: for each end of a link the smallest end of its component. Each round takes the smallest label
    of the neighbours and then follows labels of labels, so that chains shrink to less than half. With a
    number of rounds it stops after them; labels are then ends of the same component, not yet the smallest."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("c"), F.least("a", "l").alias("l"))
    while True:
        heard = both.join(labels, F.col("b") == F.col("c")).groupBy("a").agg(F.min("l").alias("m"))
        nearer = labels.join(heard, F.col("c") == F.col("a")).select("c", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jump = nearer.select(F.col("c").alias("l"), F.col("l").alias("to"))
        again, changed = counted(nearer.join(jump, "l", "left").select("c", "was", F.least("l", F.coalesce("to", "l")).alias("l")), F.col("l") != F.col("was"))
        labels, rounds = again.select("c", "l"), rounds - 1
        if not changed or not rounds:
            return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    return Forest(docs, key, text, words, threshold).result()


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each group: that of the smallest id; rows without words all stay. A row is told by its
    id and text, so that rows that share an id go only if their own text is in a group of a smaller id. Of rows that
    repeat both one stays."""
    names = list(docs.columns)
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key, text = (docs.columns[names.index(c)] for c in (key, text))
    row = F.struct(F.col(key).isNull().alias("without"), F.col(key).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    marked = docs.withColumn("row", row)
    found = checkpointed(near_duplicates(marked, "row", text, **options))
    gone = found.where(~F.col("kept")).select("row").distinct()
    out = marked.join(gone, "row", "left_anti")
    if not found.where("kept and n_shingles > 0").groupBy("row").count().where("count > 1").isEmpty():
        worded = F.col(text).isNotNull() & F.col(text).rlike(WORD)
        out = out.where(worded).dropDuplicates(["row"]).unionByName(out.where(~worded))
    return out.select(*docs.columns).toDF(*names)


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, threshold=(85, 100))
