"""Operations on RGBA images as numpy arrays (height x width x 4, uint8), and the preparation of crops for reading models as an operator."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A short side below SMALL is scaled up to about SCALED, and sides may differ by ASPECT at most.
SMALL, SCALED, ASPECT = 56, 112, 50


def rounded(values: np.ndarray) -> np.ndarray:
    """Clamped bytes, halves to the even neighbour."""
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples at points inside the image."""
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    wx, wy = (x - x0)[..., None], (y - y0)[..., None]
    source = image.astype(np.float64)
    top = source[y0, x0] * (1 - wx) + source[y0, x1] * wx
    return top * (1 - wy) + (source[y1, x0] * (1 - wx) + source[y1, x1] * wx) * wy


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with the centers of pixels aligned."""
    h, w = image.shape[:2]
    x = np.clip((np.arange(width) + 0.5) * (w / width) - 0.5, 0, w - 1)
    y = np.clip((np.arange(height) + 0.5) * (h / height) - 0.5, 0, h - 1)
    return rounded(sampled(image, *np.meshgrid(x, y)))


def warped(image: np.ndarray, quad: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """The quadrilateral (corners from the top left, clockwise) as an upright image; what lies outside is black."""
    rows, right = [], []
    for (x, y), (tx, ty) in zip(((0, 0), (width, 0), (width, height), (0, height)), quad, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -x * tx, -y * tx], [0, 0, 0, x, y, 1, -x * ty, -y * ty]]
        right += [tx, ty]
    matrix = np.append(np.linalg.solve(np.array(rows, dtype=float), np.array(right, dtype=float)), 1.0).reshape(3, 3)
    at = np.stack([*np.meshgrid(np.arange(width), np.arange(height)), np.ones((height, width))], axis=-1) @ matrix.T
    x, y = at[..., 0] / at[..., 2], at[..., 1] / at[..., 2]
    h, w = image.shape[:2]
    out = rounded(sampled(image, np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)))
    out[(x < -1) | (y < -1) | (x > w) | (y > h)] = (0, 0, 0, 255)
    return out


def turned(image: np.ndarray) -> np.ndarray:
    """A quarter turn against the clock."""
    return np.rot90(image).copy()


def planes(image: np.ndarray, mean: tuple[float, ...], std: tuple[float, ...], scale: float = 1 / 255, bgr: bool = False) -> np.ndarray:
    """Normalized channels x height x width, float32; mean and std are in the order of the result's channels."""
    channels = image[..., [2, 1, 0] if bgr else [0, 1, 2]].astype(np.float64).transpose(2, 0, 1)
    return ((channels * scale - np.reshape(mean, (3, 1, 1))) / np.reshape(std, (3, 1, 1))).astype(np.float32)


def cropped(image: np.ndarray, box: tuple[float, float, float, float]) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """What a box covers, in whole pixels inside the image, one at least, and that box."""
    x0, y0 = max(0, int(np.floor(box[0]))), max(0, int(np.floor(box[1])))
    x1, y1 = max(x0 + 1, min(image.shape[1], ceil(box[2]))), max(y0 + 1, min(image.shape[0], ceil(box[3])))
    return image[y0:y1, x0:x1].copy(), (x0, y0, x1, y1)


def prepared(image: np.ndarray) -> tuple[np.ndarray, bool]:
    """A crop on white, small ones scaled up by a whole number, very long ones padded with white; and whether anything changed."""
    changed = False
    if (image[..., 3] != 255).any():
        alpha = image[..., 3:] / 255
        image = np.concatenate([rounded(image[..., :3] * alpha + 255 * (1 - alpha)), np.full_like(image[..., 3:], 255)], axis=-1)
        changed = True
    h, w = image.shape[:2]
    if 0 < min(h, w) < SMALL:
        times = ceil(SCALED / min(h, w))
        image, changed = resized(image, w * times, h * times), True
        h, w = image.shape[:2]
    if min(h, w) and max(h, w) / min(h, w) > ASPECT:
        least = ceil(max(h, w) / ASPECT)
        page = np.full((max(h, least), max(w, least), 4), 255, dtype=np.uint8)
        page[:h, :w] = image
        image, changed = page, True
    return image, changed


def prepared_crops(crops: DataFrame) -> DataFrame:
    """(crop_id, width, height, pixels, changed) of crops(crop_id, width, height, pixels binary of RGBA rows), each through `prepared`. Crops
    whose pixels don't fit their size fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                crop, w, h, raw = (batch.column(i)[row].as_py() for i in range(4))
                image, changed = prepared(np.frombuffer(raw, dtype=np.uint8).reshape(h, w, 4))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
                values = (crop, image.shape[1], image.shape[0], image.tobytes(), changed)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["crop_id", "width", "height", "pixels", "changed"])

    return crops.select("crop_id", "width", "height", "pixels").mapInArrow(run, "crop_id long, width int, height int, pixels binary, changed boolean")
