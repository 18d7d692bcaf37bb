"""Resizing, aligning and laying pictures over each other, on 8-bit pixel arrays and as Arrow-batched functions.

Kernels are separable: one pass along rows, one along columns, with weights of 22 bits after the point and results
rounded to 8 bits after each pass. Where a picture shrinks, a kernel widens by as much.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .png import PICTURE, array_of, picture_frame, picture_row

#: Bits after the point of a weight.
BITS = 22


def cubic(x: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel with slope -1/2 at 1."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


#: Kernel and how far it reaches.
KERNELS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {"bicubic": (cubic, 2.0), "lanczos": (lanczos, 3.0)}


def taps(size: int, start: float, stop: float, out: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights), each of shape (out, n): what goes into each of `out` pixels that share the stretch from start to stop of `size` pixels."""
    kernel, reach = KERNELS[kind]
    scale = (stop - start) / out
    wide = max(scale, 1.0)
    centre = start + (np.arange(out) + 0.5) * scale
    first = np.maximum(0, (centre - reach * wide + 0.5).astype(int))
    last = np.minimum(size, (centre + reach * wide + 0.5).astype(int))
    place = first[:, None] + np.arange(int((last - first).max()))
    weight = np.where(place < last[:, None], kernel((place - centre[:, None] + 0.5) / wide), 0.0)
    weight /= weight.sum(axis=1, keepdims=True)
    return np.minimum(place, size - 1), np.trunc(weight * (1 << BITS) + np.where(weight < 0, -0.5, 0.5)).astype(np.int64)


def along_rows(pixels: np.ndarray, start: float, stop: float, out: int, kind: str) -> np.ndarray:
    place, weight = taps(pixels.shape[1], start, stop, out, kind)
    total = np.full((pixels.shape[0], out, pixels.shape[2]), 1 << (BITS - 1), np.int64)
    for t in range(place.shape[1]):
        total += pixels[:, place[:, t]].astype(np.int64) * weight[:, t][None, :, None]
    return np.clip(total >> BITS, 0, 255).astype(np.uint8)


def resize(pixels: np.ndarray, width: int, height: int, kind: str = "bicubic", box: tuple[float, float, float, float] | None = None) -> np.ndarray:
    """The part of a picture within box (x1, y1, x2, y2), all of it by default, at another size. Colours of pictures with opacity are weighted by it."""
    h, w, each = pixels.shape
    x1, y1, x2, y2 = box or (0, 0, w, h)
    if kind == "nearest":
        xs, ys = x1 + (np.arange(width) + 0.5) * ((x2 - x1) / width), y1 + (np.arange(height) + 0.5) * ((y2 - y1) / height)
        return pixels[np.minimum(ys.astype(int), h - 1)[:, None], np.minimum(xs.astype(int), w - 1)[None]]
    if each == 4:
        alpha = pixels[:, :, 3:].astype(int)
        flat = np.dstack([over_255(pixels[:, :, :3].astype(int) * alpha), alpha]).astype(np.uint8)
    else:
        flat = pixels
    out = along_rows(flat, x1, x2, width, kind)
    out = along_rows(out.transpose(1, 0, 2), y1, y2, height, kind).transpose(1, 0, 2)
    if each == 4:
        alpha = out[:, :, 3:].astype(int)
        colour = np.minimum(255, 255 * out[:, :, :3].astype(int) // np.maximum(alpha, 1))
        out = np.dstack([np.where(alpha > 0, colour, out[:, :, :3]), alpha]).astype(np.uint8)
    return out


def over_255(v: np.ndarray) -> np.ndarray:
    """v / 255, rounded, for products of two 8-bit values."""
    v = v + 128
    return ((v >> 8) + v) >> 8


def inner_size(width: int, height: int, to_width: int, to_height: int) -> tuple[int, int]:
    """The largest size of a picture's aspect that fits; sides are rounded half to even."""
    own, want = width / height, to_width / to_height
    if own > want:
        return to_width, max(1, round(height / width * to_width))
    return (max(1, round(width / height * to_height)), to_height) if own < want else (to_width, to_height)


def middle(width: int, height: int, to_width: int, to_height: int) -> tuple[float, float, float, float]:
    """The largest box of another aspect in the middle of a picture."""
    own, want = width / height, to_width / to_height
    w, h = (want * height, height) if own >= want else (width, width / want)
    x, y = (width - w) / 2, (height - h) / 2
    return x, y, x + w, y + h


def align(pixels: np.ndarray, width: int, height: int, how: str, kind: str = "bicubic") -> np.ndarray:
    """A picture brought to a size: cover cuts what is too long, contain puts all of it in the middle of black, any other word stretches."""
    h, w, each = pixels.shape
    if how == "cover":
        return resize(pixels, width, height, kind, middle(w, h, width, height))
    if how != "contain":
        return resize(pixels, width, height, kind)
    inner = resize(pixels, *inner_size(w, h, width, height), kind)
    out = np.zeros((height, width, each), np.uint8)
    x, y = (width - inner.shape[1]) // 2, (height - inner.shape[0]) // 2
    out[y : y + inner.shape[0], x : x + inner.shape[1]] = inner
    return out


def over(top: np.ndarray, alpha: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Colours `top` of opacity alpha (8 bits) over opaque colours, rounded."""
    a = alpha.astype(int)[..., None]
    return over_255(top.astype(int) * a + base.astype(int) * (255 - a)).astype(np.uint8)


def over_white(pixels: np.ndarray) -> np.ndarray:
    return over(pixels[:, :, :3], pixels[:, :, 3], np.full((*pixels.shape[:2], 3), 255, np.uint8)) if pixels.shape[2] == 4 else pixels


def _each(fn: Callable[..., np.ndarray], mode: str | None = None):
    """A function of a picture's pixels and further values as one of Arrow batches; a picture with an error, or a null one, stays as it is."""

    def run(shown: pd.DataFrame, *more: pd.Series) -> pd.DataFrame:
        rows = []
        for i, (w, h, m, p, e) in enumerate(zip(*(shown[c] for c in ("width", "height", "mode", "pixels", "error")), strict=True)):
            if p is None:
                rows.append(picture_row(None, None, e))
            elif any(pd.isna(v.iloc[i]) for v in more):
                rows.append(picture_row(None, None, "no size"))
            else:
                rows.append(picture_row(fn(array_of(int(w), int(h), m, p), *[v.iloc[i] for v in more]), mode or m))
        return picture_frame(rows)

    return run


def resized(picture: Column, width: Column, height: Column, kind: str = "bicubic") -> Column:
    return F.pandas_udf(_each(lambda p, w, h: resize(p, int(w), int(h), kind)), PICTURE)(picture, width, height)


def aligned(picture: Column, width: Column, height: Column, how: Column, kind: str = "bicubic") -> Column:
    """Pictures brought to a size, each by its own way: cover, contain, or stretched."""
    return F.pandas_udf(_each(lambda p, w, h, way: align(p, int(w), int(h), way, kind)), PICTURE)(picture, width, height, how)


def on_white(picture: Column) -> Column:
    """Pictures with opacity over white, as RGB; RGB ones unchanged."""
    return F.pandas_udf(_each(over_white, "RGB"), PICTURE)(picture)


def in_view(picture: Column, most: int) -> Column:
    """Pictures of more than `most` pixels scaled down to about that many, by Lanczos."""

    def run(p: np.ndarray) -> np.ndarray:
        h, w, _ = p.shape
        scale = min(1.0, (most / (w * h)) ** 0.5)
        return resize(p, max(1, round(w * scale)), max(1, round(h * scale)), "lanczos") if scale < 1 else p

    return F.pandas_udf(_each(run), PICTURE)(picture)
