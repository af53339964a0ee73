"""Images as rows: features, types, boxes and crops, in Arrow batches of one image at a time.

Images are (image_id, height, width, channels, data), data row by row, 8 bits a
channel. A row that can't be read gives no result, or an ``error`` where the
operator has such a column; it never ends the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.functions import raster
from taxaflow.operators.records import classified
from taxaflow.runtime import spread

FEATURES = "image_id long, width int, height int, sat_mean double, white_bg_ratio double, edge_density double, hist_entropy double, blue_dominance double"
BOX = "image_id long, box int, x int, y int, w int, h int"


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    return a.reshape((height, width) if channels == 1 else (height, width, channels))


def _each(images: DataFrame, schema: str, of: Callable[[int, np.ndarray], list[tuple]]) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, h, w, c, d in zip(b["image_id"], b["height"], b["width"], b["channels"], b["data"], strict=True):
                try:
                    img = pixels(d, int(h), int(w), int(c))
                except (ValueError, TypeError):
                    continue
                rows += of(int(i), img)
            yield pd.DataFrame(rows, columns=names)

    return spread(images.select("image_id", "height", "width", "channels", "data")).mapInPandas(run, schema)


def features(images: DataFrame) -> DataFrame:
    """The seven scalar features of each image (columns of FEATURES)."""

    def of(i: int, img: np.ndarray) -> list[tuple]:
        f = raster.features(img)
        return [(i, *(f[c] for c in ("width", "height", "sat_mean", "white_bg_ratio", "edge_density", "hist_entropy", "blue_dominance")))]

    return _each(images, FEATURES, of)


def image_types(images: DataFrame) -> DataFrame:
    """``features`` with rule, image_type and confidence."""
    return classified(features(images))


def specimens(images: DataFrame, least: float = 500, most: float = 200_000, solidity: float = 0.15, aspect: float = 15.0, pad: float = 0.15, size: tuple[int, int] | None = (224, 224), enhanced: bool = False) -> DataFrame:
    """(image_id, box, x, y, w, h, area, solidity, aspect, crop_h, crop_w, crop): single specimens of each image.

    Grey values are stretched between percentiles 5 and 95 (or, ``enhanced``,
    equalised locally and blurred), cut by Otsu, cleaned, and taken apart into
    components; those in range are cropped with padding.
    """
    schema = BOX + ", area double, solidity double, aspect double, crop_h int, crop_w int, crop binary"

    def of(i: int, img: np.ndarray) -> list[tuple]:
        g = raster.grey(img)
        base = raster.blur3(raster.clahe(g)) if enhanced else raster.stretch(g)
        out = []
        for c in raster.contours(raster.clean(raster.ink(base))):
            if least <= c["area"] <= most and c["solidity"] >= solidity and c["aspect"] <= aspect:
                cut = raster.crop(base if enhanced else g, (c["x"], c["y"], c["w"], c["h"]), pad, size)
                out.append((i, len(out), c["x"], c["y"], c["w"], c["h"], c["area"], c["solidity"], float(c["aspect"]), cut.shape[0], cut.shape[1], cut.tobytes()))
        return out

    return _each(images, schema, of)


def drawings(images: DataFrame) -> DataFrame:
    """``specimens`` with the limits for line drawings."""
    return specimens(images, 100, 50_000, 0.1, 20.0, 0.12, None, True)


def plates(images: DataFrame) -> DataFrame:
    """(image_id, box, x, y, w, h): the single figures on each plate; a plate without any is one figure."""

    def of(i: int, img: np.ndarray) -> list[tuple]:
        boxes = raster.figures(img) or [(0, 0, img.shape[1], img.shape[0])]
        return [(i, k, *map(int, b)) for k, b in enumerate(boxes)]

    return _each(images, BOX, of)


def merged_boxes(boxes: DataFrame, by: list[str], near: int = 40) -> DataFrame:
    """(by..., x, y, w, h): boxes (by..., seq, x, y, w, h) merged to a fix point within each group.

    Merging isn't associative, as hulls capture further boxes in order, so a
    group is one unit: the distinct boxes of one page, in order of ``seq``.
    Equal boxes are reduced to one before they are shuffled.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema.fields if f.name in by) + ", x int, y int, w int, h int"
    one = boxes.groupBy(*by, "x", "y", "w", "h").agg(F.min("seq").alias("seq"))
    per = one.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "w", "h"))).alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, bs in zip(zip(*(b[c] for c in by), strict=True), b["b"], strict=True):
                rows += [(*key, *r) for r in raster.merge_boxes([(int(q["x"]), int(q["y"]), int(q["w"]), int(q["h"])) for q in bs], near)]
            yield pd.DataFrame(rows, columns=[*by, "x", "y", "w", "h"])

    order = [f.name for f in boxes.schema.fields if f.name in by]
    by = order
    return per.select(*by, "b").mapInPandas(run, schema)
