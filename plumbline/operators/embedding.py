"""Embeddings of decoded images: flattened pixels, or a bag of visual words.

A visual word is a kind of small texture. Local descriptors are histograms of gradient directions in 4 x 4 cells of patches
on a regular grid; a vocabulary of them is clustered by Spark's k-means over the descriptors of all images; an image's
embedding is how often each word is the nearest of its patches. The vocabulary (words x 128 numbers) is all that workers
are sent.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.sources.transforms import apply_steps, checked

#: Pixels of a cell, cells of a patch's side, cells between patches, directions.
CELL, SIDE, STRIDE, DIRECTIONS = 4, 4, 2, 8
WIDTH = SIDE * SIDE * DIRECTIONS
#: No part of a descriptor counts for more than this before it is normalised again (light that clips).
CLIP = 0.2


def pixels_of(frame: pd.DataFrame) -> list[np.ndarray | None]:
    """Arrays (height, width, channels; red, green, blue) of a column of image structs. What Spark's source decoded is blue,
    green, red and has no ``dtype``; what a step has written has one."""
    out: list[np.ndarray | None] = []
    kinds = frame["dtype"] if "dtype" in frame else [None] * len(frame)
    for h, w, c, data, kind in zip(frame["height"], frame["width"], frame["nChannels"], frame["data"], kinds):
        if data is None:
            out.append(None)
            continue
        x = np.frombuffer(data, kind or np.uint8).reshape(int(h), int(w), int(c))
        out.append(x[:, :, [2, 1, 0, *range(3, int(c))]] if kind is None and c >= 3 else x)
    return out


PIXELS = "height int, width int, nChannels int, data binary, dtype string"


def transformed(df: DataFrame, steps: Sequence[dict], image: str = "image") -> DataFrame:
    """The pixels of every row after ``[{type, params}]`` in order; other columns stay, null pixels too."""
    from pyspark.sql.functions import pandas_udf

    if image not in df.columns:
        raise ValueError(f"{', '.join(str(s.get('type', s.get('step'))) for s in steps)} needs decoded items (dataset option decode)")
    todo = [{"type": s.get("type", s.get("step")), "params": s.get("params")} for s in steps]
    checked(todo)

    @pandas_udf(PIXELS)
    def apply(frame: pd.DataFrame) -> pd.DataFrame:
        done = apply_steps(pixels_of(frame), checked(todo))
        rows = [(None,) * 5 if x is None else (*x.shape, np.ascontiguousarray(x).tobytes(), x.dtype.name) for x in done]
        return pd.DataFrame(rows, columns=["height", "width", "nChannels", "data", "dtype"])

    return df.withColumn(image, apply(_struct(df, image)))


def _struct(df: DataFrame, image: str):
    kind = df.schema[image].dataType
    names = [f for f in ("height", "width", "nChannels", "data", "dtype") if isinstance(kind, StructType) and f in kind.names]
    return F.struct(*(F.col(f"{image}.{f}").alias(f) for f in names))


def box_crops():
    """The table function of crops: for an item's pixels and boxes, a row a box with its place, label and pixels, in order.
    Boxes without any area inside the image give none; items without pixels give boxes without."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="target_index bigint, x0 double, y0 double, x1 double, y1 double, class_label int, height int, width int, nChannels int, data binary, dtype string")
    class Crops:
        def eval(self, image, boxes):
            x = None
            if image is not None and image["data"] is not None:
                frame = pd.DataFrame([image.asDict()])
                x = pixels_of(frame)[0]
            for b in boxes or ():
                x0, y0, x1, y1 = b["x0"], b["y0"], b["x1"], b["y1"]
                if None in (x0, y0, x1, y1) or not (x1 > x0 and y1 > y0):
                    continue
                found = (None,) * 5
                if x is not None:
                    part = x[max(0, round(y0)) : max(0, round(y1)), max(0, round(x0)) : max(0, round(x1))]
                    if not part.size:
                        continue
                    found = (*part.shape, np.ascontiguousarray(part).tobytes(), part.dtype.name)
                yield b["target_index"], x0, y0, x1, y1, b["class_label"], *found

    return Crops


def detection_crops(items: DataFrame, targets: DataFrame, item: str = "item_index", label: str = "class_label") -> DataFrame:
    """Each box of ``targets`` as a row: its item's columns, with the box, its label and, of decoded items, its pixels. A
    lateral join: an item's boxes meet its pixels in one row, and leave as rows."""
    marks = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    box = F.struct(F.col("target_index").cast("long").alias("target_index"), *marks, F.col(label).cast("int").alias("class_label"))
    held = targets.groupBy(item).agg(F.sort_array(F.collect_list(box)).alias("__boxes"))
    pixels = "image" in items.columns
    rest = [c for c in items.columns if c not in ("image", label, "target_index", "x0", "y0", "x1", "y1")]
    rows = items.join(held, item).select(*rest, "__boxes", (_struct(items, "image") if pixels else F.lit(None).cast(f"struct<{PIXELS.replace(' ', ':').replace(',:', ',')}>")).alias("__image"))
    found = rows.lateralJoin(box_crops()(F.col("__image").outer(), F.col("__boxes").outer()))
    image = [F.struct("height", "width", "nChannels", "data", "dtype").alias("image")] if pixels else []
    return found.select(*rest, "target_index", "x0", "y0", "x1", "y1", F.col("class_label").alias(label), *image)


def flattened(df: DataFrame, image: str = "image", into: str = "embedding") -> DataFrame:
    """Pixels row by row, channels innermost, as they are."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def flat(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([None if x is None else x.astype(np.float32).ravel() for x in pixels_of(frame)])

    return df.withColumn(into, flat(_struct(df, image)))


def descriptors(x: np.ndarray) -> np.ndarray:
    """Of an image, a row a patch. Patches without any gradient are zero; images smaller than a patch are continued by their
    border."""
    grey = x.astype(np.float64).mean(2)
    least = CELL * SIDE
    grey = np.pad(grey, ((0, max(0, least - grey.shape[0])), (0, max(0, least - grey.shape[1]))), "edge")
    dy, dx = np.gradient(grey)
    size = np.hypot(dx, dy)
    # straight and diagonal directions are in the middle of theirs
    turn = np.floor((np.arctan2(dy, dx) + np.pi) / (2 * np.pi) * DIRECTIONS + 0.5).astype(int) % DIRECTIONS
    h, w = grey.shape[0] // CELL, grey.shape[1] // CELL
    by = np.where(turn[..., None] == np.arange(DIRECTIONS), size[..., None], 0.0)[: h * CELL, : w * CELL]
    cells = by.reshape(h, CELL, w, CELL, DIRECTIONS).sum((1, 3))
    patches = np.lib.stride_tricks.sliding_window_view(cells, (SIDE, SIDE), (0, 1))[::STRIDE, ::STRIDE]
    out = patches.transpose(0, 1, 3, 4, 2).reshape(-1, WIDTH)
    for _ in range(2):  # clipped in between
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), 0.0)
        out = np.minimum(out, CLIP) if _ == 0 else out
    return out


def vocabulary(df: DataFrame, size: int = 2048, image: str = "image", seed: int = 0) -> np.ndarray:
    """The visual words (a row each) of all images: at most ``size``, fewer if there are not so many kinds of patches."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for x in pixels_of(part):
                if x is not None:
                    yield pd.DataFrame({"x": list(descriptors(x))})

    patches = df.filter(F.col(f"{image}.data").isNotNull()).select(_struct(df, image).alias("i")).select("i.*").mapInPandas(run, "x array<double>")
    ready = patches.withColumn("features", array_to_vector("x")).select("features").checkpoint()
    if ready.isEmpty():
        return np.zeros((0, WIDTH))
    centres = np.array(KMeans(k=size, seed=seed, maxIter=20).fit(ready).clusterCenters()) if size > 1 else np.zeros((1, WIDTH))
    return np.unique(centres, axis=0)


def words_of(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How often each word is the nearest to a patch of the image, as shares."""
    found = descriptors(x)
    near = ((found * found).sum(1)[:, None] - 2 * found @ words.T + (words * words).sum(1)[None, :]).argmin(1)
    return np.bincount(near, minlength=len(words)) / len(found)


def bag_of_words(df: DataFrame, words: np.ndarray, size: int | None = None, image: str = "image", into: str = "embedding") -> DataFrame:
    """The embedding of every row: shares of the ``words``, then zeros up to ``size``."""
    from pyspark.sql.functions import pandas_udf

    if not len(words):
        raise ValueError("a vocabulary without words")
    width = max(size or 0, len(words))

    @pandas_udf("array<float>")
    def embed(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([None if x is None else np.pad(words_of(x, words), (0, width - len(words))).astype(np.float32) for x in pixels_of(frame)])

    return df.withColumn(into, embed(_struct(df, image)))
