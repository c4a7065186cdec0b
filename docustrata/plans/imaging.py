"""Queries over the derived pixel relation, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.functions.text import rounded
from docustrata.operators import images, pixels
from docustrata.plans import fixtures
from docustrata.plans.documents import r6

Query = Callable[[SparkSession, str], DataFrame]


def over(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(fixtures.pixels(spark, sf_dir))


def report(px: DataFrame) -> DataFrame:
    q = pixels.quality(px)
    return q.select("img_id", "laplacian_var", "brightness", "contrast", "glare", "shadow", "resolution", "overall", "status", F.array_join("warnings", "; ").alias("warnings"))


def planned(px: DataFrame) -> DataFrame:
    p = pixels.plan(pixels.quality(px), 0.5, "fast")
    return p.select("img_id", "perspective_correction", "illumination_correction", "denoise", "contrast_step", "sharpening", F.element_at("reasons", 4).alias("fourth_reason"))


def kernels(px: DataFrame) -> DataFrame:
    m = images.metrics(images.packed(px))
    return m.select("img_id", rounded(F.col("laplacian_var"), 4).alias("laplacian_var"), rounded(F.col("noise"), 6).alias("noise"), rounded(F.col("white"), 6).alias("white"))


QUERIES: dict[str, Query] = {
    "qlt1_blur": over(pixels.blur),
    "qlt2_qlt4_light": over(pixels.light),
    "qlt5_shadow": over(pixels.shadow),
    "qlt7_resolution": over(lambda px: pixels.resolution(pixels.shape(px))),
    "qlt8_report": over(report),
    "qlt9_plan": over(planned),
    "img1_orientation": over(lambda px: pixels.oriented(px, (F.col("img_id") % 9).cast("int"))),
    "img2_upright": over(pixels.upright),
    "img13_linear_contrast": over(lambda px: pixels.linear_contrast(px, 1.5, -40.0)),
    "img14_percentile_stretch": over(pixels.percentile_stretch),
    "img19_otsu": over(pixels.otsu),
    "img20_adaptive_mean": over(pixels.adaptive_mean),
    "img21_morphology_open": over(lambda px: pixels.morphology(px, "open")),
    "img21_morphology_close": over(lambda px: pixels.morphology(px, "close")),
    "img22_border_box": over(lambda px: pixels.border_box(px, 200, 0.1)),
    "img23_zone_crop": over(pixels.zone_crop),
    "img_kernels": over(kernels),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    p = f"WITH p AS ({fixtures.DUCK_PIXELS}), s AS (SELECT img_id, max(r) + 1 AS h, max(c) + 1 AS w FROM p GROUP BY img_id)"
    side = lambda a, b, w: f"coalesce({a}(gray) OVER {w}, {b}(gray) OVER {w}, gray)"
    lap = f"{side('lag', 'lead', 'ro')} + {side('lead', 'lag', 'ro')} + {side('lag', 'lead', 'co')} + {side('lead', 'lag', 'co')} - 4 * gray"
    win = "WINDOW ro AS (PARTITION BY img_id, r ORDER BY c), co AS (PARTITION BY img_id, c ORDER BY r)"
    blur = f"b AS (SELECT img_id, {r6('var_pop(lap::DOUBLE)', 4)} AS laplacian_var FROM (SELECT img_id, {lap} AS lap FROM p {win}) GROUP BY img_id)"
    light = f"l AS (SELECT img_id, {r6('avg(gray) / 255', 6)} AS brightness, {r6('least(1.0, stddev_pop(gray) / 64)', 6)} AS contrast, {r6('avg(CASE WHEN gray > 245 THEN 1.0::DOUBLE ELSE 0 END)', 6)} AS glare FROM p GROUP BY img_id)"
    shadow = f"d AS (SELECT img_id, {r6('least(1.0, stddev_pop(m) / 50)', 6)} AS shadow FROM (SELECT p.img_id, avg(gray) AS m FROM p JOIN s ON p.img_id = s.img_id GROUP BY p.img_id, r // greatest(1, h // 4), c // greatest(1, w // 4)) GROUP BY img_id)"
    res = f"z AS (SELECT img_id, CASE WHEN least(h, w) < 600 THEN {r6('least(h, w) / 600', 4)} ELSE 1.0 END::DOUBLE AS resolution FROM s)"
    every = f"{p}, {blur}, {light}, {shadow}, {res}, q AS (SELECT * FROM b JOIN l USING (img_id) JOIN d USING (img_id) JOIN z USING (img_id))"
    overall = r6("greatest(0.0, least(1.0, least(1.0, laplacian_var / 200) * 0.3 + contrast * 0.2 + (1 - abs(brightness - 0.5) * 2) * 0.2 + resolution * 0.15 + 0.5 * 0.15))", 4)
    warnings = "array_to_string(list_filter([CASE WHEN laplacian_var < 80 THEN 'Image appears blurry (Laplacian var: ' || format('{:.1f}', laplacian_var) || ')' END, CASE WHEN brightness < 0.25 THEN 'Image is under-exposed / dark' END, CASE WHEN brightness > 0.85 THEN 'Image is over-exposed / bright' END, CASE WHEN contrast < 0.25 THEN 'Image has low contrast' END, CASE WHEN glare > 0.08 THEN 'High glare detected (' || format('{:.1f}', glare * 100) || '%)' END, CASE WHEN resolution < 1 THEN 'Low resolution scan' END], lambda x: x IS NOT NULL), '; ')"
    frame = "ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING"
    rows_, cols_ = (lambda n: f"(PARTITION BY img_id, r ORDER BY c {frame.format(n=n)})"), (lambda n: f"(PARTITION BY img_id, c ORDER BY r {frame.format(n=n)})")

    def morph(*steps: str) -> str:
        sql = "p"
        for f in steps:
            sql = f"(SELECT img_id, r, c, {f}(gray) OVER {rows_(1)} AS gray FROM {sql})"
            sql = f"(SELECT img_id, r, c, {f}(gray) OVER {cols_(1)} AS gray FROM {sql})"
        return f"{p} SELECT * FROM {sql}"

    # noise: the weights 1 4 6 4 1 across and down, borders mirrored
    mirrored = lambda x, n: f"CASE WHEN {x} < 0 THEN -({x}) WHEN {x} >= {n} THEN 2 * {n} - 2 - ({x}) ELSE {x} END"
    taps = "(VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))"
    soft = f"SELECT p.img_id, p.r, p.c, any_value(p.gray) AS gray, round_even(sum(a.w * b.w * q.gray) / 256.0::DOUBLE, 0) AS soft FROM p JOIN s ON s.img_id = p.img_id JOIN {taps} a(d, w) ON true JOIN {taps} b(d, w) ON true JOIN p q ON q.img_id = p.img_id AND q.r = {mirrored('p.r + a.d', 'h')} AND q.c = {mirrored('p.c + b.d', 'w')} GROUP BY p.img_id, p.r, p.c"
    soft = soft.replace("b.d >= w ", "b.d >= s.w ").replace("2 * w -", "2 * s.w -")
    o = "p.img_id % 9"
    nr = f"CASE {o} WHEN 3 THEN h - 1 - r WHEN 4 THEN h - 1 - r WHEN 5 THEN c WHEN 6 THEN c WHEN 7 THEN w - 1 - c WHEN 8 THEN w - 1 - c ELSE r END"
    nc = f"CASE {o} WHEN 2 THEN w - 1 - c WHEN 3 THEN w - 1 - c WHEN 5 THEN r WHEN 6 THEN h - 1 - r WHEN 7 THEN h - 1 - r WHEN 8 THEN r ELSE c END"
    return {
        "qlt1_blur": f"{p}, {blur} SELECT *, laplacian_var < 80 AS blurry, {r6('least(1.0, laplacian_var / 200)', 4)} AS blur_norm FROM b",
        "qlt2_qlt4_light": f"{p}, {light} SELECT *, brightness < 0.25 AS underexposed, brightness > 0.85 AS overexposed, contrast < 0.25 AS low_contrast, glare > 0.08 AS severe_glare FROM l",
        "qlt5_shadow": f"{p}, {shadow} SELECT * FROM d",
        "qlt7_resolution": f"{p}, {res} SELECT img_id, resolution, resolution < 1 AS low_resolution FROM z",
        "qlt8_report": f"{every} SELECT img_id, laplacian_var, brightness, contrast, glare, shadow, resolution, {overall} AS overall, CASE WHEN {overall} >= 0.5 THEN 'usable' ELSE 'poor' END AS status, {warnings} AS warnings FROM q",
        "qlt9_plan": f"{every} SELECT img_id, false AS perspective_correction, shadow >= 0.15 OR brightness < 0.35 OR brightness > 0.75 AS illumination_correction, NULL::VARCHAR AS denoise, CASE WHEN contrast < 0.4 OR brightness < 0.35 THEN 'clahe' END AS contrast_step, CASE WHEN laplacian_var < 140 THEN 'usm' END AS sharpening, CASE WHEN contrast < 0.4 OR brightness < 0.35 THEN 'Enabled CLAHE contrast: low contrast score ' || format('{{:.2f}}', contrast) ELSE 'Bypassed contrast enhancement: contrast is sufficient' END AS fourth_reason FROM q",
        "img1_orientation": f"{p} SELECT p.img_id, ({nr})::INT AS r, ({nc})::INT AS c, gray FROM p JOIN s ON p.img_id = s.img_id",
        "img2_upright": f"{p} SELECT p.img_id, CASE WHEN h > w * 1.15 THEN c ELSE r END AS r, CASE WHEN h > w * 1.15 THEN h - 1 - r ELSE c END AS c, gray FROM p JOIN s ON p.img_id = s.img_id",
        "img13_linear_contrast": f"{p} SELECT img_id, r, c, least(255, round(abs(gray * 1.5 - 40)))::INT AS gray FROM p",
        "img14_percentile_stretch": f"{p}, k AS (SELECT img_id, quantile_cont(gray, 0.05) AS a, quantile_cont(gray, 0.95) AS b FROM p GROUP BY img_id) SELECT p.img_id, r, c, CASE WHEN b > a THEN trunc(greatest(0.0, least(255.0, (gray - a) * 255 / (b - a))))::INT ELSE gray END AS gray FROM p JOIN k ON p.img_id = k.img_id",
        "img19_otsu": f"{p}, h AS (SELECT img_id, gray, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT img_id, gray, sum(n) OVER a::DOUBLE AS w0, sum(n * gray) OVER a::DOUBLE AS s0, sum(n) OVER e::DOUBLE AS w, sum(n * gray) OVER e::DOUBLE AS s FROM h WINDOW a AS (PARTITION BY img_id ORDER BY gray), e AS (PARTITION BY img_id)), v AS (SELECT img_id, gray, {r6('CASE WHEN w0 < w THEN (s * w0 - s0 * w) ** 2 / (w0 * (w - w0)) ELSE 0.0 END / w ** 3', 6)} AS b FROM c) SELECT img_id, gray AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY b DESC, gray) = 1",
        "img_kernels": f"""{p}, {blur}, soft AS ({soft}), n AS (SELECT img_id, {r6('least(1.0, avg(abs(gray - soft)) / 25)', 6)} AS noise FROM soft GROUP BY img_id),
g AS (SELECT img_id, gray, count(*) AS k FROM p GROUP BY ALL), c AS (SELECT img_id, gray, sum(k) OVER a::DOUBLE AS w0, sum(k * gray) OVER a::DOUBLE AS s0, sum(k) OVER e::DOUBLE AS w, sum(k * gray) OVER e::DOUBLE AS t FROM g WINDOW a AS (PARTITION BY img_id ORDER BY gray), e AS (PARTITION BY img_id)),
v AS (SELECT img_id, CASE WHEN w0 < w THEN gray ELSE 0 END AS gray, CASE WHEN w0 < w THEN (t * w0 - s0 * w) ** 2 / (w0 * (w - w0)) ELSE 0.0 END AS apart FROM c), o AS (SELECT img_id, gray AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY apart DESC, gray) = 1)
SELECT b.img_id, laplacian_var, noise, (SELECT {r6('avg(CASE WHEN p.gray > o.threshold THEN 1.0::DOUBLE ELSE 0 END)', 6)} FROM p JOIN o ON o.img_id = p.img_id WHERE p.img_id = b.img_id) AS white FROM b JOIN n ON n.img_id = b.img_id""",
        "img20_adaptive_mean": f"{p}, a AS (SELECT *, sum(gray) OVER {rows_(5)} AS t, count(*) OVER {rows_(5)} AS n FROM p) SELECT img_id, r, c, CASE WHEN gray > sum(t) OVER {cols_(5)} / sum(n) OVER {cols_(5)} - 2 THEN 255 ELSE 0 END AS gray FROM a",
        "img21_morphology_open": morph("min", "max"),
        "img21_morphology_close": morph("max", "min"),
        "img22_border_box": f"{p}, b AS (SELECT img_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM p WHERE gray > 200 GROUP BY img_id) SELECT s.img_id, coalesce(greatest(0, r0 - trunc(h * 0.1)::INT), 0) AS top, coalesce(greatest(0, c0 - trunc(w * 0.1)::INT), 0) AS \"left\", coalesce(least(h, r1 + 1 + trunc(h * 0.1)::INT), h) AS bottom, coalesce(least(w, c1 + 1 + trunc(w * 0.1)::INT), w) AS \"right\" FROM s LEFT JOIN b ON s.img_id = b.img_id",
        "img23_zone_crop": f"{p} SELECT p.img_id, r - round(h * 0.68)::INT AS r, c, gray FROM p JOIN s ON p.img_id = s.img_id WHERE r >= round(h * 0.68) AND r < round(h * 1.0)",
    }
