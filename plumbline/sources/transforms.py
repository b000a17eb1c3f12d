"""Image transforms by name, on stacks of equally large images (images, height, width, channels; red, green, blue).

Resampling is separable: a matrix of weights for the rows and one for the columns, products of which resize a whole stack.
Names and parameters of the steps are those of the usual vision transforms; a step that draws at random isn't there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

MODES = ("NEAREST", "NEAREST_EXACT", "BILINEAR", "BICUBIC")
#: Element types that pixels may have.
DTYPES = ("uint8", "int16", "int32", "int64", "float16", "float32", "float64")


def _triangle(x: np.ndarray, _: float) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(x))


def _cubic(x: np.ndarray, a: float) -> np.ndarray:
    """Keys's kernel."""
    x = np.abs(x)
    near, far = ((a + 2) * x - (a + 3)) * x * x + 1, ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


@lru_cache(maxsize=256)
def weights(n: int, m: int, mode: str, antialias: bool) -> np.ndarray:
    """The m x n matrix that takes n pixels to m. Pixels are where their middles are. With ``antialias`` a kernel is as wide
    as what it shrinks, and what it has outside is left out; without, the border pixel stands for all beyond it."""
    scale, at = n / m, np.arange(m)
    if mode in ("NEAREST", "NEAREST_EXACT"):
        found = np.floor(at * scale if mode == "NEAREST" else (at + 0.5) * scale).astype(int)
        return np.eye(n)[np.minimum(found, n - 1)]
    kernel, reach = (_triangle, 1) if mode == "BILINEAR" else (_cubic, 2)
    stretch = max(scale, 1.0) if antialias else 1.0
    middle = (at + 0.5) * scale - 0.5
    index = (np.floor(middle - reach * stretch) + 1)[:, None] + np.arange(math.ceil(2 * reach * stretch) + 1)
    w = kernel((index - middle[:, None]) / stretch, -0.5 if antialias else -0.75)
    if antialias:
        w = np.where((index < 0) | (index >= n), 0.0, w)
    out = np.zeros((m, n))
    np.add.at(out, (np.broadcast_to(at[:, None], index.shape), np.clip(index, 0, n - 1).astype(int)), w)
    return out / out.sum(1, keepdims=True)


def like(x: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """Computed values as the type they came from: integers are rounded and stay in range."""
    if np.issubdtype(dtype, np.integer):
        held = np.iinfo(dtype)
        return np.clip(np.rint(x), held.min, held.max).astype(dtype)
    return x.astype(dtype)


def _size(x: np.ndarray, size: int | Sequence[int], most: int | None) -> tuple[int, int]:
    if not isinstance(size, int) and len(size) == 2:
        return int(size[0]), int(size[1])
    short = size if isinstance(size, int) else size[0]
    h, w = x.shape[1:3]
    long = int(short * max(h, w) / min(h, w))
    if most is not None and long > most:
        short, long = int(most * short / long), most
    return (short, long) if h <= w else (long, short)


def resize(x: np.ndarray, size: int | Sequence[int] | None = None, interpolation: str = "BILINEAR", max_size: int | None = None, antialias: bool = True, height: int | None = None, width: int | None = None) -> np.ndarray:
    """To ``size``: (height, width), or the shorter side, the longer one in proportion and ``max_size`` at most. With
    ``height`` and ``width`` instead: the nearest pixels, unless a resized ``size`` asks for more."""
    if size is None:
        if not height or not width:
            raise ValueError("Resize needs a size")
        size, interpolation = (height, width), "NEAREST_EXACT"
    if interpolation not in MODES:
        raise ValueError(f"unknown interpolation {interpolation!r}; one of {list(MODES)}")
    h, w = _size(x, size, max_size)
    if (h, w) == x.shape[1:3]:
        return x
    rows, cols = weights(x.shape[1], h, interpolation, antialias), weights(x.shape[2], w, interpolation, antialias)
    half = np.tensordot(rows, x.astype(np.float64), (1, 1))  # rows, images, columns, channels
    return like(np.tensordot(cols, half, (1, 2)).transpose(2, 1, 0, 3), x.dtype)


def crop(x: np.ndarray, top: int, left: int, height: int, width: int) -> np.ndarray:
    return x[:, top : top + height, left : left + width]


def pad(x: np.ndarray, padding: int | Sequence[int], fill: float = 0, padding_mode: str = "constant") -> np.ndarray:
    """``padding``: of all sides, of left/right and top/bottom, or of left, top, right and bottom."""
    p = [padding] if isinstance(padding, int) else list(padding)
    left, top, right, bottom = p * 4 if len(p) == 1 else p * 2 if len(p) == 2 else p
    if padding_mode not in ("constant", "edge", "reflect", "symmetric"):
        raise ValueError(f"unknown padding_mode {padding_mode!r}")
    more = {"constant_values": fill} if padding_mode == "constant" else {}
    return np.pad(x, ((0, 0), (top, bottom), (left, right), (0, 0)), padding_mode, **more)


def center_crop(x: np.ndarray, size: int | Sequence[int]) -> np.ndarray:
    """The middle; smaller images are padded with zeros first."""
    h, w = (size, size) if isinstance(size, int) else (size[0], size[-1])
    tall, wide = max(0, h - x.shape[1]), max(0, w - x.shape[2])
    x = pad(x, [wide // 2, tall // 2, (wide + 1) // 2, (tall + 1) // 2]) if tall or wide else x
    return crop(x, int(round((x.shape[1] - h) / 2)), int(round((x.shape[2] - w) / 2)), h, w)


def grayscale(x: np.ndarray, num_output_channels: int = 1) -> np.ndarray:
    light = x[..., :3].astype(np.float64) @ np.array([0.2989, 0.587, 0.114]) if x.shape[3] >= 3 else x[..., 0].astype(np.float64)
    return np.repeat(light.astype(x.dtype)[..., None], num_output_channels, axis=3)


def to_rgb(x: np.ndarray) -> np.ndarray:
    """One channel (or one with alpha) is repeated, what is more than three is dropped."""
    return x[..., :3] if x.shape[3] >= 3 else np.repeat(x[..., :1], 3, axis=3)


def select_channels(x: np.ndarray, channels: Sequence[int]) -> np.ndarray:
    return x[..., list(channels)]


def to_dtype(x: np.ndarray, dtype: str = "float32", scale: bool = False) -> np.ndarray:
    """``scale``: the range goes along, that of floating point being 0 to 1."""
    if dtype not in DTYPES:
        raise ValueError(f"unknown dtype {dtype!r}; one of {list(DTYPES)}")
    new = np.dtype(dtype)
    if not scale or new == x.dtype:
        return x.astype(new)
    whole, whole_new = (np.issubdtype(d, np.integer) for d in (x.dtype, new))
    if whole and not whole_new:
        return (x.astype(np.float64) / np.iinfo(x.dtype).max).astype(new)
    if whole_new and not whole:
        return np.floor(x.astype(np.float64) * (np.iinfo(new).max + 1.0 - 1e-3)).astype(new)
    if whole:
        return np.floor(x.astype(np.float64) * ((np.iinfo(new).max + 1) / (np.iinfo(x.dtype).max + 1))).astype(new)
    return x.astype(new)


def normalize(x: np.ndarray, mean: Sequence[float], std: Sequence[float]) -> np.ndarray:
    if np.issubdtype(x.dtype, np.integer):
        raise ValueError("Normalize needs floating point; put ToDtype before it")
    if not all(std):
        raise ValueError("Normalize can't divide by a std of 0")
    return ((x - np.array(mean)) / np.array(std)).astype(x.dtype)


def same(x: np.ndarray) -> np.ndarray:
    return x


STEPS: dict[str, Callable] = {
    "Resize": resize, "Crop": crop, "CenterCrop": center_crop, "Pad": pad, "Grayscale": grayscale, "RGB": to_rgb, "ToRGB": to_rgb, "SelectChannels": select_channels,
    "ToDtype": to_dtype, "ConvertImageDtype": lambda x, dtype="float32": to_dtype(x, dtype, True), "Normalize": normalize, "ToImage": same, "ToPureTensor": same, "Identity": same,
}


def checked(steps: Sequence[dict]) -> list[tuple[Callable, dict]]:
    """Steps ``{type or step, params}``; an unknown one is an error that lists the known."""
    out = []
    for s in steps:
        name = s.get("type", s.get("step"))
        if name not in STEPS:
            raise ValueError(f"unknown transform {name!r}; one of {sorted(STEPS)}")
        out.append((STEPS[name], dict(s.get("params") or {})))
    return out


def apply_steps(images: Sequence[np.ndarray | None], steps: Sequence[tuple[Callable, dict]]) -> list[np.ndarray | None]:
    """Images (height, width, channels; None stays) after the steps, those of one size and type together."""
    out: list[np.ndarray | None] = [None] * len(images)
    stacks: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        if x is not None:
            stacks.setdefault((x.shape, x.dtype.str), []).append(i)
    for at in stacks.values():
        x = np.stack([images[i] for i in at])
        for step, params in steps:
            x = step(x, **params)
        for i, y in zip(at, x):
            out[i] = y
    return out
