"""Tokens in regions, tokens around anchors, and reading order.

tokens: doc_id, doc_type, idx, text, confidence, x1..y2 (pixels), nx1..ny2
(relative). Configurations are small and broadcast, so a region join is one pass
over tokens without a shuffle; anchors and what stands around them meet on doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.functions import geometry
from docustrata.functions.text import let, strip
from docustrata.session import told

PX = ("x1", "y1", "x2", "y2")
NORM = ("nx1", "ny1", "nx2", "ny2")
REGION = ("rx1", "ry1", "rx2", "ry2")
#: Least similarity of an anchor that isn't contained in its label; pixels around an anchor.
SIMILAR, DISTANCE, LINE, COLUMN = 0.65, 500.0, 50.0, 250.0


def cols(names: tuple[str, ...], prefix: str = "") -> list[Column]:
    return [F.col(prefix + n) for n in names]


def in_regions(tokens: DataFrame, config: DataFrame) -> DataFrame:
    """tokens with the field (and field_ord) of every region of their document type that holds them. Margins are not applied."""
    regions = config.where("rx1 is not null").select(F.col("doc_type").alias("__type"), "field", "field_ord", *REGION, "containment", "minimum_overlap")
    hit = geometry.contained(F.col("containment"), cols(NORM), cols(REGION), F.col("minimum_overlap"))
    return tokens.join(told(regions), (F.col("doc_type") == F.col("__type")) & hit).drop("__type", *REGION, "containment", "minimum_overlap")


def word_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\w]", "")


#: Word characters (ASCII), each with a bit of its own.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_"


def characters(c: Column) -> Column:
    """The set of word characters of a text, as bits of a long."""
    bits = [F.when(F.contains(c, F.lit(x)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, x in enumerate(LETTERS)]
    while len(bits) > 1:
        bits = [bits[i].bitwiseOR(bits[i + 1]) if i + 1 < len(bits) else bits[i] for i in range(0, len(bits), 2)]
    return bits[0]


def similar(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Of two texts of word characters and their sets: 1 if one contains the other, 0 if one is empty, else the share of common characters in the larger set."""
    most = F.greatest(F.bit_count(xs), F.bit_count(ys), F.lit(1))
    return F.when((x == "") | (y == ""), 0.0).when(F.contains(x, y) | F.contains(y, x), 1.0).otherwise(F.bit_count(xs.bitwiseAND(ys)) / most)


def similarity(a: Column, b: Column) -> Column:
    x, y = word_text(a), word_text(b)
    return similar(x, y, characters(x), characters(y))


def with_keys(df: DataFrame, text: str) -> DataFrame:
    """What labels are compared by: lower-cased text, word characters and their set, made on either side before the two meet.
    The lambda keeps the set's many branches out of the code of a whole stage, where they would make a method too large for
    the JIT compiler; beside it they are compiled in small methods, in it they would be interpreted."""
    return df.withColumns({"low": let(strip(F.col(text)), F.lower), "word": word_text(F.col(text))}).withColumn("set", characters(F.col("word")))


def likeness(token: Callable[[str], Column], key: Callable[[str], Column]) -> tuple[Column, Column]:
    """Whether one text contains the other, and how similar they are."""
    exact = F.contains(token("low"), key("low")) | F.contains(key("low"), token("low"))
    return exact, similar(token("word"), key("word"), token("set"), key("set"))


def anchors(tokens: DataFrame, keywords: DataFrame) -> DataFrame:
    """keywords: doc_type, field, keyword. Per document and field the token that is its label: the first that contains
    the keyword or is contained in it (an empty one is), else the most similar one of SIMILAR or more, the first of equals."""
    more = [c for c in ("direction",) if c in keywords.columns]
    words = with_keys(keywords.where("keyword is not null").select(F.col("doc_type").alias("__type"), "field", "keyword", *more), "keyword").withColumnsRenamed({c: f"k_{c}" for c in ("low", "word", "set")})
    exact, near = likeness(F.col, lambda c: F.col(f"k_{c}"))
    fit = with_keys(tokens, "text").join(told(words), (F.col("doc_type") == F.col("__type")) & (exact | (near >= SIMILAR)))
    rank = F.struct((~exact).alias("a"), F.when(exact, 0.0).otherwise(-near).alias("b"), F.col("idx").alias("c"))
    return fit.groupBy("doc_id", "doc_type", "field").agg(F.min_by(F.struct("idx", "text", *PX, "keyword", *more), rank).alias("anchor"))


def pages(tokens: DataFrame, *more: Column) -> DataFrame:
    """doc_id, doc_type and the document's tokens in their order, with what labels are compared by, and further aggregates.
    A document has tens of tokens. Tokens that are dealt by document already are not moved."""
    t = F.struct("idx", "text", "confidence", *PX, *NORM, "low", "word", "set")
    return with_keys(tokens, "text").groupBy("doc_id", "doc_type").agg(F.sort_array(F.collect_list(t)).alias("page"), *more)


def keys_of(spark: SparkSession, words: Sequence[str]) -> dict[str, dict[str, Column]]:
    """What few words (labels of a configuration) are compared by, as literals."""
    made = with_keys(spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "w string"), "w").collect()
    return {r["w"]: {c: F.lit(r[c]) for c in ("low", "word", "set")} for r in made}


def labelled_pages(tokens: DataFrame, labels: dict[str, dict[str, Column]], *more: Column) -> DataFrame:
    """pages() without what labels are compared by, and for each of few labels (by column, as keys_of gives them) the token
    that is it, as anchor_in() chooses it: found in compiled code while tokens are grouped, not by lambdas on the page."""
    keyed = with_keys(tokens, "text").withColumn("__t", F.struct("idx", "text", "confidence", *PX, *NORM))

    def found(label: dict[str, Column]) -> Column:
        exact, near = likeness(F.col, lambda c: label[c])
        return F.min(F.when(exact | (near >= SIMILAR), F.struct((~exact).alias("a"), F.when(exact, 0.0).otherwise(-near).alias("b"), F.col("__t").alias("t"))))["t"]

    return keyed.groupBy("doc_id", "doc_type").agg(F.sort_array(F.collect_list("__t")).alias("page"), *more, *(found(k).alias(c) for c, k in labels.items()))


def anchor_in(page: Column, low: Column, word: Column, letters: Column) -> Column:
    """The token of a page that is a keyword's label, as anchors() chooses it; null without one. The keyword's keys as with_keys makes them."""
    key = lambda c: {"low": low, "word": word, "set": letters}[c]

    def fits(t: Column) -> Column:
        exact, near = likeness(lambda c: t[c], key)
        return exact | (near >= SIMILAR)

    def ranked(t: Column) -> Column:
        exact, near = likeness(lambda c: t[c], key)
        return F.struct((~exact).alias("a"), F.when(exact, 0.0).otherwise(-near).alias("b"), t.alias("t"))

    return F.array_min(F.transform(F.filter(page, fits), ranked))["t"]


def labelled(of: DataFrame, keywords: DataFrame) -> DataFrame:
    """pages by keyword row of their document type, with its columns and label, the token that is the keyword's label on the page."""
    keyed = with_keys(keywords.withColumn("__key", F.col("keyword")), "__key").withColumnsRenamed({c: f"k_{c}" for c in ("low", "word", "set")}).drop("__key")
    both = of.join(told(keyed), "doc_type")
    label = anchor_in(F.col("page"), F.col("k_low"), F.col("k_word"), F.col("k_set"))
    return both.withColumn("label", F.when(F.col("keyword").isNotNull(), label)).drop("k_low", "k_word", "k_set")


def beside(page: Column, anchor: Column, direction: Column) -> Column:
    """The tokens of a page that stand in a direction of an anchor; none without one."""
    at = lambda t: [t[c] for c in PX]
    return F.filter(page, lambda t: (t["idx"] != anchor["idx"]) & relative(direction, at(t), at(anchor)))


def within(page: Column, region: Sequence[Column], containment: Column, least: Column) -> Column:
    """The tokens of a page in a region; none without one."""
    return F.filter(page, lambda t: geometry.contained(containment, [t[c] for c in NORM], region, least))


def relative(direction: Column, token: list[Column], anchor: list[Column], distance: Column | float = DISTANCE, line: Column | float = LINE, column: Column | float = COLUMN) -> Column:
    """Whether a token's box stands in a direction of an anchor's."""
    tx, ty, ax, ay = geometry.center(token[0], token[2]), geometry.center(token[1], token[3]), geometry.center(anchor[0], anchor[2]), geometry.center(anchor[1], anchor[3])
    near = F.sqrt((tx - ax) * (tx - ax) + (ty - ay) * (ty - ay)) <= distance
    row, col = F.abs(ty - ay) <= line, F.abs(tx - ax) <= column
    side = (
        F.when(direction == "right", (token[0] >= anchor[2] - 10) & row)
        .when(direction == "left", (token[2] <= anchor[0] + 10) & row)
        .when(direction == "below", (token[1] >= anchor[3] - 5) & (token[1] - anchor[3] <= line) & col)
        .when(direction == "above", (token[3] <= anchor[1] + 5) & (anchor[1] - token[3] <= line) & col)
        .otherwise(False)
    )
    return side & near


def around_anchors(tokens: DataFrame, found: DataFrame, direction: Column | None = None) -> DataFrame:
    """tokens with the field whose anchor they stand beside, in the anchor's direction or the one given."""
    box = [F.col(f"anchor.{n}") for n in PX]
    at = found.withColumnRenamed("doc_id", "__doc").drop("doc_type")
    hit = (F.col("doc_id") == F.col("__doc")) & (F.col("idx") != F.col("anchor.idx")) & relative(F.col("anchor.direction") if direction is None else direction, cols(PX), box)
    return tokens.join(at, hit).drop("__doc", "anchor")


def reading_order(tokens: Column, line: float = 15.0) -> Column:
    """An array of structs with y1, x1 and idx, by lines and then from left to right. A line begins where a token is more
    than `line` pixels below the first one of the line before."""
    at = F.sort_array(F.transform(tokens, lambda t: F.struct(t["y1"].alias("y"), t["idx"].alias("i"), t.alias("t"))))
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(-1).alias("line"), F.transform(F.slice(at, 1, 0), lambda x: F.struct(F.lit(0).alias("line"), x["t"]["x1"].alias("x"), x["y"].alias("y"), x["i"].alias("i"), x["t"].alias("t"))).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["first"].isNull() | (F.abs(x["y"] - acc["first"]) > line)
        n = F.when(new, acc["line"] + 1).otherwise(acc["line"])
        row = F.struct(n.alias("line"), x["t"]["x1"].alias("x"), x["y"].alias("y"), x["i"].alias("i"), x["t"].alias("t"))
        return F.struct(F.when(new, x["y"]).otherwise(acc["first"]).alias("first"), n.alias("line"), F.array_append(acc["out"], row).alias("out"))

    return F.aggregate(at, start, step, lambda acc: F.transform(F.sort_array(acc["out"]), lambda r: r["t"]))
