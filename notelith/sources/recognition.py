"""Recognition of page images: preparing them, running an engine, and a cache of what engines have read.

Images are arrays of grey values; the engine is a program that may be missing, so it is a parameter.
"""

from __future__ import annotations

import math
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_SCHEMA = "path string, page int, stage int, text string"


def autocontrast(grey: np.ndarray) -> np.ndarray:
    low, high = int(grey.min(initial=255)), int(grey.max(initial=0))
    if high <= low:
        return grey.astype(np.uint8)
    return ((grey.astype(float) - low) * (255 / (high - low))).round().astype(np.uint8)


def otsu(grey: np.ndarray) -> int:
    """The threshold that parts the grey values into two classes as far apart as can be."""
    weight = np.bincount(grey.ravel().astype(np.uint8), minlength=256).astype(float)
    if not weight.sum():
        return 0
    below = np.cumsum(weight)
    above = weight.sum() - below
    mass = np.cumsum(weight * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(between, nan=-1.0).argmax())


def binarise(grey: np.ndarray) -> np.ndarray:
    return np.where(grey > otsu(grey), 255, 0).astype(np.uint8)


def skew_angle(binary: np.ndarray) -> float:
    """Degrees by which the dark points' main axis leaves the horizontal."""
    y, x = np.nonzero(binary < 128)
    if x.size < 2:
        return 0.0
    spread = np.cov(np.stack([x, y]).astype(float))
    values, vectors = np.linalg.eigh(spread)
    vx, vy = vectors[:, values.argmax()]
    angle = math.degrees(math.atan2(vy, vx))
    return (angle + 90) % 180 - 90


def deskew(binary: np.ndarray, least: float = 0.1) -> np.ndarray:
    """Turned back by nearest points; angles under ``least`` stay."""
    angle = skew_angle(binary)
    if abs(angle) < least:
        return binary
    h, w = binary.shape
    t, cy, cx = math.radians(angle), (h - 1) / 2, (w - 1) / 2
    yy, xx = np.mgrid[0:h, 0:w]
    sx = np.rint(cx + (xx - cx) * math.cos(t) - (yy - cy) * math.sin(t)).astype(int)
    sy = np.rint(cy + (xx - cx) * math.sin(t) + (yy - cy) * math.cos(t)).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(binary, 255)
    out[inside] = binary[sy[inside], sx[inside]]
    return out


def prepare(grey: np.ndarray, threshold: bool = True, straighten: bool = True) -> np.ndarray:
    image = autocontrast(grey)
    image = binarise(image) if threshold else image
    return deskew(image) if straighten else image


def command_engine(program: str, *options: str) -> Callable[[bytes], str]:
    """An engine that reads an image from its input and writes text; '' if the program fails or is missing."""

    def read(image: bytes) -> str:
        try:
            return subprocess.run([program, "stdin", "stdout", *options], input=image, capture_output=True, check=True, timeout=120).stdout.decode("utf-8", "replace")
        except (OSError, subprocess.SubprocessError):
            return ""

    return read


def recognise(images: DataFrame, engine: Callable[[bytes], str], stage: int) -> DataFrame:
    """(path, page, stage, text) of images (path, page, image)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [engine(bytes(x)) if x is not None else "" for x in frame["image"]]
            yield pd.DataFrame({"path": frame["path"], "page": frame["page"], "stage": stage, "text": texts})

    return images.select("path", "page", "image").mapInPandas(run, TEXT_SCHEMA)


def cached(pages: DataFrame, cache: DataFrame, parameters: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): a cached text counts if it was made with equal parameters and not before the file's last change."""
    keys = ["path", "page", *parameters]
    newest = cache.groupBy(*keys).agg(F.max(F.struct("cached_at", "text")).alias("c"))
    joined = pages.join(newest, keys, "left").withColumn("hit", F.coalesce(F.col("c.cached_at") >= F.col("modified"), F.lit(False)))
    hits = joined.where("hit").select(*pages.columns, F.col("c.text").alias("text"))
    return hits, joined.where("not hit").select(*pages.columns)


def only_missing(rows: DataFrame, field: str, key: list[str], read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A second pass over the rows whose field is still empty; ``read`` gives (key..., value) for them."""
    empty = F.coalesce(F.trim(F.col(field)) == "", F.lit(True))
    found = read(rows.where(empty)).select(*key, F.col("value").alias("_v"))
    joined = rows.join(found.groupBy(*key).agg(F.max("_v").alias("_v")), key, "left")
    return joined.withColumn(field, F.when(empty, F.coalesce("_v", field)).otherwise(F.col(field))).drop("_v")


def searchable_pdf(program: str = "ocrmypdf", *options: str) -> Callable[[bytes], bytes]:
    """An engine that gives a PDF a text layer; tried again without cleaning, the PDF itself if the program fails or is missing."""

    def run(pdf: bytes) -> bytes:
        for more in (options, tuple(o for o in options if o != "--clean")):
            try:
                return subprocess.run([program, *more, "-", "-"], input=pdf, capture_output=True, check=True, timeout=600).stdout
            except (OSError, subprocess.SubprocessError):
                continue
        return pdf

    return run


def neural_engine(**options) -> Callable[[bytes], str]:
    """docTR, if a worker has it; '' where it is missing."""

    def read(image: bytes) -> str:
        try:
            from doctr.io import DocumentFile
            from doctr.models import ocr_predictor
        except ImportError:
            return ""
        return ocr_predictor(pretrained=True, **options)(DocumentFile.from_images([image])).render()

    return read


def union_engine(*engines: Callable[[bytes], str]) -> Callable[[bytes], str]:
    """The lines of several passes over one image, each once, in order."""

    def read(image: bytes) -> str:
        lines = (x.strip() for engine in engines for x in engine(image).splitlines())
        return "\n".join(dict.fromkeys(x for x in lines if x))

    return read


def regions(pages: DataFrame, x0: float, top: float, x1: float, bottom: float, resolution: int = 300) -> DataFrame:
    """(path, page, image): a box of each page of (path, page, content), cut out and drawn as PNG; null where that fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for frame in frames:
            images = []
            for row in frame.itertuples():
                try:
                    import pdfplumber

                    with pdfplumber.open(io.BytesIO(row.content)) as doc:
                        out = io.BytesIO()
                        doc.pages[row.page - 1].within_bbox((x0, top, x1, bottom)).to_image(resolution=resolution).original.save(out, "PNG")
                        images.append(out.getvalue())
                except Exception:  # a broken page must not end the run
                    images.append(None)
            yield pd.DataFrame({"path": frame["path"], "page": frame["page"], "image": images})

    return pages.select("path", "page", "content").mapInPandas(run, "path string, page int, image binary")
