"""Image metrics and transforms as algebra over a pixel relation (img_id, r, c, gray).

A pixel relation suits thumbnails and crops, where aggregates and windows over
many images run as one plan; operators/images.py has the same formulas over
whole image arrays, a kernel per image.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docustrata.functions.text import rounded


def along_row() -> WindowSpec:
    return Window.partitionBy("img_id", "r").orderBy("c")


def along_column() -> WindowSpec:
    return Window.partitionBy("img_id", "c").orderBy("r")


def shape(px: DataFrame) -> DataFrame:
    return px.groupBy("img_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))


def laplacian(px: DataFrame) -> DataFrame:
    """px with lap, the 3 x 3 Laplacian; borders mirror without repeating the edge."""
    side = lambda w, a, b: F.coalesce(a("gray").over(w), b("gray").over(w), F.col("gray"))
    around = side(along_row(), F.lag, F.lead) + side(along_row(), F.lead, F.lag) + side(along_column(), F.lag, F.lead) + side(along_column(), F.lead, F.lag)
    return px.withColumn("lap", around - F.col("gray") * 4)


def blur(px: DataFrame) -> DataFrame:
    out = laplacian(px).groupBy("img_id").agg(rounded(F.var_pop(F.col("lap").cast("double")), 4).alias("laplacian_var"))
    return out.withColumn("blurry", F.col("laplacian_var") < 80).withColumn("blur_norm", rounded(F.least(F.lit(1.0), F.col("laplacian_var") / 200), 4))


def light(px: DataFrame) -> DataFrame:
    """Brightness, contrast and glare with their flags."""
    g = F.col("gray").cast("double")
    out = px.groupBy("img_id").agg(rounded(F.avg(g) / 255, 6).alias("brightness"), rounded(F.least(F.lit(1.0), F.stddev_pop(g) / 64), 6).alias("contrast"), rounded(F.avg((F.col("gray") > 245).cast("double")), 6).alias("glare"))
    return out.select("*", (F.col("brightness") < 0.25).alias("underexposed"), (F.col("brightness") > 0.85).alias("overexposed"), (F.col("contrast") < 0.25).alias("low_contrast"), (F.col("glare") > 0.08).alias("severe_glare"))


def shadow(px: DataFrame) -> DataFrame:
    """Spread of the means of blocks a fourth as high and wide; what remains at the ends makes blocks of its own."""
    s = shape(px)
    both = px.join(s, "img_id")
    cell = lambda at, size: F.floor(F.col(at) / F.greatest(F.lit(1), F.floor(F.col(size) / 4)))
    means = both.groupBy("img_id", cell("r", "height").alias("br"), cell("c", "width").alias("bc")).agg(F.avg(F.col("gray").cast("double")).alias("m"))
    return means.groupBy("img_id").agg(rounded(F.least(F.lit(1.0), F.stddev_pop("m") / 50), 6).alias("shadow"))


def resolution(s: DataFrame) -> DataFrame:
    least = F.least("height", "width")
    return s.select("img_id", F.when(least < 600, rounded(least / 600, 4)).otherwise(1.0).alias("resolution"), (least < 600).alias("low_resolution"))


def quality(px: DataFrame, perspective: float = 0.5, noise: DataFrame | None = None) -> DataFrame:
    """The report: all scores, overall and warnings. noise: img_id, noise (else 0)."""
    q = blur(px).join(light(px), "img_id").join(shadow(px), "img_id").join(resolution(shape(px)), "img_id")
    q = q.join(noise, "img_id", "left").withColumn("noise", F.coalesce("noise", F.lit(0.0))) if noise is not None else q.withColumn("noise", F.lit(0.0))
    overall = F.least(F.lit(1.0), F.col("laplacian_var") / 200) * 0.30 + F.col("contrast") * 0.20 + (F.lit(1.0) - F.abs(F.col("brightness") - 0.5) * 2) * 0.20 + F.col("resolution") * 0.15 + F.lit(perspective) * 0.15
    fixed = lambda c, n: F.format_number(c, n)
    warnings = F.array_compact(
        F.array(
            F.when(F.col("blurry"), F.concat(F.lit("Image appears blurry (Laplacian var: "), F.translate(fixed(F.col("laplacian_var"), 1), ",", ""), F.lit(")"))),
            F.when(F.col("underexposed"), "Image is under-exposed / dark"),
            F.when(F.col("overexposed"), "Image is over-exposed / bright"),
            F.when(F.col("low_contrast"), "Image has low contrast"),
            F.when(F.col("severe_glare"), F.concat(F.lit("High glare detected ("), fixed(F.col("glare") * 100, 1), F.lit("%)"))),
            F.when(F.col("low_resolution"), "Low resolution scan"),
        )
    )
    out = q.withColumn("overall", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), overall)), 4)).withColumn("warnings", warnings)
    return out.withColumn("status", F.when(F.col("overall") >= 0.5, "usable").otherwise("poor"))


def plan(q: DataFrame, perspective: Column | float = 0.5, mode: str = "balanced") -> DataFrame:
    """Which steps an image gets, and why, from its report."""
    p = F.lit(perspective) if isinstance(perspective, float) else perspective
    two, one = (lambda c: F.format_number(c, 2)), (lambda c: F.translate(F.format_number(c, 1), ",", ""))
    warp = p >= 0.60
    lit = (F.col("shadow") >= 0.15) | (F.col("brightness") < 0.35) | (F.col("brightness") > 0.75)
    noisy, flat, soft = F.col("noise") > 0.35, (F.col("contrast") < 0.40) | (F.col("brightness") < 0.35), F.col("laplacian_var") < 140
    say = lambda when, yes, no: F.when(when, yes).otherwise(no)
    # The texts of reasons.
    reasons = [
        say(warp, F.lit("Enabled perspective warp: high boundary confidence"), F.lit("Bypassed perspective correction: low boundary confidence (< 0.60)")),
        say(lit, F.concat(F.lit("Enabled illumination correction: shadow score "), two(F.col("shadow"))), F.lit("Bypassed illumination correction: lighting is uniform")),
        say(noisy, F.concat(F.lit("Enabled bilateral denoise: noise score "), two(F.col("noise"))), F.lit("Bypassed denoise: noise is low")),
        say(flat, F.concat(F.lit("Enabled CLAHE contrast: low contrast score "), two(F.col("contrast"))), F.lit("Bypassed contrast enhancement: contrast is sufficient")),
        say(soft, F.concat(F.lit("Enabled USM sharpening: blur score "), one(F.col("laplacian_var"))), F.concat(F.lit("Bypassed sharpening: image is sharp (blur score "), one(F.col("laplacian_var")), F.lit(")"))),
    ]
    if mode == "fast":
        reasons.append(F.lit("Performance mode 'fast': disabled variant generation"))
    return q.select("img_id", warp.alias("perspective_correction"), F.lit(True).alias("deskew"), lit.alias("illumination_correction"), F.when(noisy, "bilateral").alias("denoise"), F.when(flat, "clahe").alias("contrast_step"), F.when(soft, "usm").alias("sharpening"), F.lit(mode != "fast").alias("generate_variants"), F.array(*reasons).alias("reasons"))


def linear_contrast(px: DataFrame, alpha: float, beta: float) -> DataFrame:
    return px.withColumn("gray", F.least(F.lit(255), F.round(F.abs(F.col("gray") * alpha + beta)).cast("int")))


def percentile_stretch(px: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """To 0..255 between two percentiles; a flat image stays."""
    p = px.groupBy("img_id").agg(F.percentile("gray", F.array(F.lit(low), F.lit(high))).alias("p")).select("img_id", F.get("p", F.lit(0)).alias("p0"), F.get("p", F.lit(1)).alias("p1"))
    at = (F.col("gray") - F.col("p0")) * 255 / F.nullif(F.col("p1") - F.col("p0"), F.lit(0.0))
    return px.join(p, "img_id").withColumn("gray", F.when(F.col("p1") > F.col("p0"), F.greatest(F.lit(0.0), F.least(F.lit(255.0), at)).cast("int")).otherwise(F.col("gray"))).drop("p0", "p1")


def otsu(px: DataFrame) -> DataFrame:
    """img_id, threshold: the gray level that parts its histogram with the largest variance between the parts, the lowest of equals."""
    h = px.groupBy("img_id", "gray").agg(F.count("*").alias("n"))
    w, every = Window.partitionBy("img_id").orderBy("gray"), Window.partitionBy("img_id")
    h = h.select("img_id", "gray", F.sum("n").over(w).cast("double").alias("w0"), F.sum(F.col("n") * F.col("gray")).over(w).cast("double").alias("s0"), F.sum("n").over(every).cast("double").alias("w"), F.sum(F.col("n") * F.col("gray")).over(every).cast("double").alias("s"))
    between = F.when(F.col("w0") < F.col("w"), F.pow(F.col("s") * F.col("w0") - F.col("s0") * F.col("w"), F.lit(2)) / (F.col("w0") * F.nullif(F.col("w") - F.col("w0"), F.lit(0.0)))).otherwise(0.0)
    return h.withColumn("b", rounded(between / F.pow("w", F.lit(3)), 6)).groupBy("img_id").agg(F.max_by("gray", F.struct("b", -F.col("gray"))).alias("threshold"))


def binarize(px: DataFrame) -> DataFrame:
    return px.join(otsu(px), "img_id").withColumn("gray", F.when(F.col("gray") > F.col("threshold"), 255).otherwise(0)).drop("threshold")


def adaptive_mean(px: DataFrame, block: int = 11, c: float = 2.0) -> DataFrame:
    """255 where a pixel is above the mean of its block less c; blocks end at the border."""
    n = (block | 1) // 2
    sums = px.withColumn("__s", F.sum("gray").over(along_row().rowsBetween(-n, n))).withColumn("__n", F.count("*").over(along_row().rowsBetween(-n, n)))
    mean = F.sum("__s").over(along_column().rowsBetween(-n, n)) / F.sum("__n").over(along_column().rowsBetween(-n, n))
    return sums.withColumn("gray", F.when(F.col("gray") > mean - c, 255).otherwise(0)).drop("__s", "__n")


def morphology(px: DataFrame, how: str = "open", size: int = 3) -> DataFrame:
    """erode, dilate, open or close with a square; another name opens."""
    n = size // 2

    def pass_(df: DataFrame, f: Callable[[str], Column]) -> DataFrame:
        df = df.withColumn("gray", f("gray").over(along_row().rowsBetween(-n, n)))
        return df.withColumn("gray", f("gray").over(along_column().rowsBetween(-n, n)))

    steps = {"erode": (F.min,), "dilate": (F.max,), "close": (F.max, F.min)}.get(how, (F.min, F.max))
    for f in steps:
        px = pass_(px, f)
    return px


def border_box(px: DataFrame, above: int = 25, margin: float = 0.0) -> DataFrame:
    """The box of what is brighter, with a margin (a share of the page), cut to the page; the whole page if nothing is."""
    s = shape(px)
    lit = px.where(F.col("gray") > above).groupBy("img_id").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    dy, dx = (F.col("height") * margin).cast("int"), (F.col("width") * margin).cast("int")
    return s.join(lit, "img_id", "left").select(
        "img_id",
        F.coalesce(F.greatest(F.lit(0), F.col("r0") - dy), F.lit(0)).alias("top"),
        F.coalesce(F.greatest(F.lit(0), F.col("c0") - dx), F.lit(0)).alias("left"),
        F.coalesce(F.least(F.col("height"), F.col("r1") + 1 + dy), F.col("height")).alias("bottom"),
        F.coalesce(F.least(F.col("width"), F.col("c1") + 1 + dx), F.col("width")).alias("right"),
    )


def zone_crop(px: DataFrame, top: float = 0.68, bottom: float = 1.0) -> DataFrame:
    """Rows of the machine-readable zone, counted from its top."""
    s = shape(px).select("img_id", F.round(F.col("height") * top).cast("int").alias("t"), F.round(F.col("height") * bottom).cast("int").alias("b"))
    return px.join(s, "img_id").where((F.col("r") >= F.col("t")) & (F.col("r") < F.col("b"))).withColumn("r", F.col("r") - F.col("t")).drop("t", "b")


def oriented(px: DataFrame, orientation: Column) -> DataFrame:
    """EXIF orientations 1 to 8 as a new place for each pixel; another number leaves it."""
    both = px.withColumn("__o", orientation).join(shape(px), "img_id")
    r, c, h, w = F.col("r"), F.col("c"), F.col("height") - 1, F.col("width") - 1
    places = {2: (r, w - c), 3: (h - r, w - c), 4: (h - r, c), 5: (c, r), 6: (c, h - r), 7: (w - c, h - r), 8: (w - c, r)}
    pick = lambda i: _chain([(F.col("__o") == k, v[i]) for k, v in places.items()], (r, c)[i])
    return both.select("img_id", pick(0).alias("r"), pick(1).alias("c"), "gray")


def _chain(cases: list[tuple[Column, Column]], rest: Column) -> Column:
    out = F.when(*cases[0])
    for a, b in cases[1:]:
        out = out.when(a, b)
    return out.otherwise(rest)


def upright(px: DataFrame) -> DataFrame:
    """Images over 1.15 times as high as wide are turned clockwise."""
    tall = shape(px).select("img_id", F.when(F.col("height") > F.col("width") * 1.15, 6).otherwise(1).alias("o"))
    return oriented(px.join(tall, "img_id"), F.col("o"))
