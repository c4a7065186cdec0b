"""Token and image sources, and the boundary to recognition engines.

Tokens are stored once and parsed as often as rules change; the engine is
whatever turns an image into tokens. None is bundled: `recognize` takes one.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.functions import text
from docustrata.functions.geometry import normalized
from docustrata.operators import images

SCHEMA = "doc_id string, variant string, page int, idx int, text string, confidence double, x1 double, y1 double, x2 double, y2 double, image_width int, image_height int, source string, error string"
SUFFIXES = ("jpg", "jpeg", "png", "webp")
logger = logging.getLogger(__name__)


class Engine(Protocol):
    """Recognises an image (H x W x 3, blue, green, red): (text, confidence, quadrangle of four points) for each token."""

    name: str

    def tokens(self, image: np.ndarray, document_type: str) -> Iterable[tuple[str, float, list[tuple[float, float]]]]: ...


class Preferred:
    """The first of several engines that can be made. Without any, and for an image on which it fails, there are no tokens."""

    def __init__(self, *makers: Callable[[], Engine]):
        self.engine: Engine | None = None
        for make in makers:
            try:
                self.engine = make()
                break
            except Exception as e:  # an engine that isn't installed, or lacks its model
                logger.warning("%s can't be used: %s", getattr(make, "__name__", make), e)

    @property
    def name(self) -> str:
        return self.engine.name if self.engine else "none"

    def tokens(self, image: np.ndarray, document_type: str) -> Iterable[tuple[str, float, list[tuple[float, float]]]]:
        try:
            return list(self.engine.tokens(image, document_type)) if self.engine else []
        except Exception as e:
            logger.error("%s failed: %s", self.name, e)
            return []


def decoded(files: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """img_id (the path), height, width, channels, data of a table (path, content). decode gives an array or raises; what it can't read is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in pdf[["path", "content"]].itertuples(index=False):
                try:
                    a = np.ascontiguousarray(decode(bytes(content)))
                except Exception as e:
                    logger.warning("%s can't be read: %s", path, e)
                    continue
                out.append((path, a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2], a.tobytes()))
            yield pd.DataFrame(out, columns=["path", "height", "width", "channels", "data"])

    return files.select("path", "content").mapInPandas(run, "path string, height int, width int, channels int, data binary")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """img_id (the path), height, width, channels, data of the images that can be decoded."""
    rows = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(path)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def orientations(spark: SparkSession, path: str) -> DataFrame:
    """path and EXIF orientation (null without one) of image files; only their first 64 KB are looked at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "orientation": pd.array([images.exif_orientation(bytes(c)) for c in pdf["head"]], dtype="Int32")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(path)
    return files.select("path", F.expr("substring(content, 1, 65536)").alias("head")).mapInPandas(run, "path string, orientation int")


def recognize(docs: DataFrame, engine: Callable[[], Engine], document_type: str = "auto", variant: str = "global") -> DataFrame:
    """docs: doc_id, height, width, channels, data. One engine for each worker; a document whose image fails has a single row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = engine()
        for pdf in batches:
            out = []
            for doc, h, w, c, data in pdf[["doc_id", "height", "width", "channels", "data"]].itertuples(index=False):
                try:
                    for i, (t, conf, quad) in enumerate(made.tokens(images.to_bgr(images.array(h, w, c, data)), document_type)):
                        xs, ys = [p[0] for p in quad], [p[1] for p in quad]
                        out.append((str(doc), variant, 1, i, t.strip(), float(conf), min(xs), min(ys), max(xs), max(ys), w, h, made.name, None))
                except Exception as e:  # one bad image must not end the job; the row says what happened
                    out.append((str(doc), variant, 1, None, None, None, None, None, None, None, w, h, made.name, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[x.strip().split(" ")[0] for x in SCHEMA.split(",")])

    return docs.mapInPandas(run, SCHEMA)


def enriched(tokens: DataFrame) -> DataFrame:
    """tokens with relative boxes and script."""
    size = {"x": F.col("image_width"), "y": F.col("image_height")}
    return tokens.where("text is not null").withColumns({f"n{c}": normalized(F.col(c), size[c[0]]) for c in ("x1", "y1", "x2", "y2")}).withColumn("script", text.script(F.col("text")))


def documents(tokens: DataFrame) -> DataFrame:
    """doc_id, raw_text (token texts in their order) and size."""
    order = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return tokens.groupBy("doc_id").agg(F.array_join(F.transform(order, lambda t: t["text"]), " ").alias("raw_text"), F.max("image_width").alias("image_width"), F.max("image_height").alias("image_height"))


def reprojected(tokens: DataFrame, crops: DataFrame) -> DataFrame:
    """Tokens of crops in the page's pixels. crops: doc_id, variant, left, top, page_width, page_height."""
    both = tokens.join(crops, ["doc_id", "variant"])
    moved = {c: F.col(c) + F.col("left" if c[0] == "x" else "top") for c in ("x1", "y1", "x2", "y2")}
    return both.withColumns(moved).withColumns({"image_width": F.col("page_width"), "image_height": F.col("page_height")}).drop("left", "top", "page_width", "page_height")
