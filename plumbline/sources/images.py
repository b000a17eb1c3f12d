"""Image metrics from decoded pixels: one pass in Python workers, a row an image; moments, visual measures, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of metrics are the documented public surface: fixed values.
PLACES = ("offset_x", "offset_y", "depth", "distance_center", "distance_edge", "invalid_box")
METRICS = ("mean", "std", "var", "skew", "kurtosis", "entropy", "missing", "zeros", "brightness", "contrast", "darkness", "sharpness", "width", "height", "channels", "size", "aspect_ratio")
HASHES = ("xxhash", "phash", "dhash", "phash_d4", "dhash_d4")
SCHEMA = "path string, target_index long, " + ", ".join(f"{m} double" for m in (*METRICS, *PLACES)) + ", center array<double>, percentiles array<double>, histogram array<long>, " + ", ".join(f"{h} string" for h in HASHES)


def pixel_metrics(x: np.ndarray) -> dict[str, float]:
    """x: height, width, channels."""
    v = x.astype(np.float64).ravel()
    mean, std = v.mean(), v.std()
    z = (v - mean) / std if std else np.zeros_like(v)
    p = np.bincount(x.astype(np.uint8).ravel(), minlength=256) / max(1, v.size)
    grey = x.mean(2)
    light = np.percentile(grey, [1, 50, 99])
    edges = np.abs(np.diff(grey, axis=0)).mean() + np.abs(np.diff(grey, axis=1)).mean() if min(grey.shape) > 1 else 0.0
    h, w, c = x.shape
    return {
        "mean": mean, "std": std, "var": std**2, "skew": (z**3).mean(), "kurtosis": (z**4).mean() - 3 if std else 0.0, "entropy": float(-(p[p > 0] * np.log2(p[p > 0])).sum()),
        "missing": float(np.isnan(v).mean()), "zeros": float((v == 0).mean()), "brightness": light[2], "contrast": light[2] - light[0], "darkness": light[0], "sharpness": edges,
        "width": w, "height": h, "channels": c, "size": w * h, "aspect_ratio": w / h,
    }


def _shrunk(grey: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means of an h x w grid of cells."""
    rows = [a.mean(0) for a in np.array_split(grey, h)] if grey.shape[0] >= h else list(grey[np.linspace(0, grey.shape[0] - 1, h).round().astype(int)])
    out = np.stack(rows).T
    cols = [a.mean(0) for a in np.array_split(out, w)] if out.shape[0] >= w else list(out[np.linspace(0, out.shape[0] - 1, w).round().astype(int)])
    return np.stack(cols).T


def _bits(flags: np.ndarray) -> str:
    return np.packbits(flags.ravel()).tobytes().hex()


def difference_hash(x: np.ndarray) -> str:
    small = _shrunk(x.mean(2), 8, 9)
    return _bits(small[:, 1:] > small[:, :-1])


def perceptual_hash(x: np.ndarray) -> str:
    small = _shrunk(x.mean(2), 32, 32)
    k = np.arange(32)
    basis = np.cos(np.pi / 32 * (k[None, :] + 0.5) * k[:, None])
    low = (basis @ small @ basis.T)[:8, :8]
    return _bits(low > np.median(low.ravel()[1:]))


def oriented(x: np.ndarray, hashed: Callable[[np.ndarray], str]) -> str:
    """The least hash over the eight turns and mirrors of an image: equal for all of them."""
    return min(hashed(np.rot90(y, k)) for y in (x, x[:, ::-1]) for k in range(4))


def place_metrics(box: tuple[float, ...] | None, height: int, width: int) -> dict:
    """Where a box (x0, y0, x1, y1; None: the whole image) lies in its image."""
    x0, y0, x1, y1 = box or (0.0, 0.0, float(width), float(height))
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    return {
        "offset_x": x0, "offset_y": y0, "depth": 8.0, "distance_center": float(np.hypot(cx - width / 2, cy - height / 2)), "distance_edge": min(x0, y0, width - x1, height - y1),
        "invalid_box": float(not (0 <= x0 < x1 <= width and 0 <= y0 < y1 <= height)), "center": [cx, cy],
    }


def image_stats(images: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Metrics and hashes of the rows of Spark's image source (struct ``image``; pixels are blue, green, red), a row an image
    (``target_index`` null). With ``boxes`` (path, target_index, x0, y0, x1, y1 in pixels) also a row a box: of the pixels
    inside, which for a box that is invalid are none (its pixel metrics are null)."""
    if boxes is not None:
        held = boxes.groupBy("path").agg(F.collect_list(F.struct(F.col("target_index").cast("long").alias("target_index"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))).alias("boxes"))
        rows = images.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data").join(held, "path", "left")
    else:
        rows = images.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data", F.lit(None).cast("array<struct<target_index:bigint,x0:double,y0:double,x1:double,y1:double>>").alias("boxes"))
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def measured(path: str, target: int | None, x: np.ndarray, place: dict) -> dict:
        row = dict.fromkeys(names) | {"path": path, "target_index": target, **place}
        if not x.size or place["invalid_box"]:
            return row
        grey = x.mean(2)
        row |= pixel_metrics(x) | {"percentiles": np.percentile(grey, [0, 25, 50, 75, 100]).tolist(), "histogram": np.bincount(x.astype(np.uint8).ravel(), minlength=256).tolist()}
        return row | {"xxhash": xxh64(np.ascontiguousarray(x).tobytes()), "phash": perceptual_hash(x), "dhash": difference_hash(x), "phash_d4": oriented(x, perceptual_hash), "dhash_d4": oriented(x, difference_hash)}

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, h, w, c, data, held in part.itertuples(index=False):
                x = np.frombuffer(data, np.uint8).reshape(h, w, c)
                out.append(measured(path, None, x, place_metrics(None, h, w)))
                for b in held if held is not None else ():
                    box = tuple(b[k] for k in ("x0", "y0", "x1", "y1"))
                    at = [max(0, int(round(v))) for v in box]
                    out.append(measured(path, b["target_index"], x[at[1] : at[3], at[0] : at[2]], place_metrics(box, h, w)))
            frame = pd.DataFrame(out, columns=names)
            frame["target_index"] = frame["target_index"].astype("Int64")
            yield frame

    return rows.mapInPandas(run, SCHEMA)


def xxh64(data: bytes) -> str:
    """A 64-bit hash of the bytes (XXH64), as hex."""
    import xxhash

    return xxhash.xxh64_hexdigest(data)
