"""Visual comparison of images held as raw RGB bytes: SSIM, pixel differences, difference images.

Images are rows (width, height, rgb); each pair is compared within its row by numpy in Arrow batches.
:func:`pixel_diff_long` does the pixel count over exploded pixels with a join, for images too large for a row.
Sides are joined by a shuffle: what is made from a few rows (pixels of a list of images) is planned as small however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SSIM_LEAST = 0.95
DIFF_MOST = 0.01  # per cent
_WINDOW = 7


def _window_means(x: np.ndarray) -> np.ndarray:
    """Mean of every full 7 by 7 window, by an integral image."""
    s = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    s[1:, 1:] = x.cumsum(0).cumsum(1)
    w = _WINDOW
    return (s[w:, w:] - s[:-w, w:] - s[w:, :-w] + s[:-w, :-w]) / (w * w)


def ssim(a: np.ndarray, b: np.ndarray, data_range: float = 255.0) -> float:
    """Mean structural similarity of two grey images: uniform 7 by 7 windows, sample covariance, K1 .01, K2 .03 (Wang et al. 2004)."""
    if min(a.shape) < _WINDOW:
        raise ValueError("images must be at least 7 by 7")
    a, b = a.astype(np.float64), b.astype(np.float64)
    norm = _WINDOW**2 / (_WINDOW**2 - 1)
    ma, mb = _window_means(a), _window_means(b)
    va, vb, cov = (norm * (_window_means(p) - q) for p, q in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    return float(np.mean((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))))


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb.mean(axis=2).astype(np.uint8)


def _lanczos(n_in: int, n_out: int) -> np.ndarray:
    """Weights of a Lanczos-3 resampling as a matrix; the kernel widens when shrinking."""
    scale = n_in / n_out
    reach = 3.0 * max(scale, 1.0)
    out = np.zeros((n_out, n_in))
    for i in range(n_out):
        centre = (i + 0.5) * scale
        lo, hi = max(0, int(centre - reach + 0.5)), min(n_in, int(centre + reach + 0.5))
        x = (np.arange(lo, hi) + 0.5 - centre) / max(scale, 1.0)
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        out[i, lo:hi] = w / w.sum()
    return out


def resized(rgb: np.ndarray, height: int, width: int) -> np.ndarray:
    across = np.einsum("oj,ijc->ioc", _lanczos(rgb.shape[1], width), rgb.astype(np.float64)).round().clip(0, 255)
    return np.einsum("oi,ijc->ojc", _lanczos(rgb.shape[0], height), across).round().clip(0, 255).astype(np.uint8)


def masked(rgb: np.ndarray, ignore: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Rectangles (x, y, width, height) set to middle grey."""
    out = rgb.copy()
    for x, y, w, h in ignore:
        out[y : y + h, x : x + w] = 128
    return out


def diff_image(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``b`` with red where it differs: by more than 10 of 255 once the largest difference is scaled to 255."""
    d = np.abs(a.astype(np.int16) - b.astype(np.int16))
    scaled = (d / d.max() * 255).astype(np.uint8) if d.max() else d.astype(np.uint8)
    out = b.copy()
    out[(scaled > 10).any(axis=2)] = (255, 0, 0)
    return out


def compare(a: np.ndarray, b: np.ndarray, ignore: list[tuple[int, int, int, int]] = [], ssim_least: float = SSIM_LEAST, diff_most: float = DIFF_MOST) -> dict:
    """All measures of a pair; ``b`` is resized to ``a`` first if they differ in size."""
    if a.shape != b.shape:
        b = resized(b, *a.shape[:2])
    if ignore:
        a, b = masked(a, ignore), masked(b, ignore)
    score = ssim(grey(a), grey(b))
    count, total = int((a != b).any(axis=2).sum()), a.shape[0] * a.shape[1]
    percent = count / total * 100
    return {"similarity_score": score, "pixel_diff_count": count, "total_pixels": total, "diff_percentage": percent, "passed": score >= ssim_least and percent <= diff_most, "diff_image": diff_image(a, b).tobytes()}


_FIELDS = (("similarity_score", "double", pa.float64()), ("pixel_diff_count", "long", pa.int64()), ("total_pixels", "long", pa.int64()), ("diff_percentage", "double", pa.float64()), ("passed", "boolean", pa.bool_()), ("diff_image", "binary", pa.binary()))


def compare_images(baseline: DataFrame, current: DataFrame, ignore: list[tuple[int, int, int, int]] | None = None, ssim_least: float = SSIM_LEAST, diff_most: float = DIFF_MOST, with_diff: bool = True) -> DataFrame:
    """Pairs by ``img_id`` (img_id, width, height, rgb): the measures, and the difference image unless it is not wanted."""
    side = lambda d, s: d.select("img_id", *[F.col(c).alias(f"{c}_{s}") for c in ("width", "height", "rgb")])
    pairs = side(baseline, "a").join(side(current, "b").hint("merge"), "img_id")
    kind = dict(pairs.dtypes)["img_id"]
    fields = _FIELDS if with_diff else _FIELDS[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                a, b = (np.frombuffer(one[f"rgb_{s}"], np.uint8).reshape(one[f"height_{s}"], one[f"width_{s}"], 3) for s in "ab")
                found = compare(a, b, ignore or [], ssim_least, diff_most)
                yield pa.RecordBatch.from_arrays([batch.column("img_id").slice(row, 1), *[pa.array([found[n]], t) for n, _, t in fields]], ["img_id", *[n for n, _, _ in fields]])

    return pairs.mapInArrow(run, ", ".join([f"img_id {kind}", *[f"{n} {t}" for n, t, _ in fields]]))


def pixel_diff_long(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differing pixels of each image from exploded pixels (img_id, y, x, r, g, b)."""
    on = ["img_id", "y", "x"]
    other = b.select(*on, *[F.col(c).alias(f"__dp_{c}") for c in "rgb"])
    differs = (F.col("r") != F.col("__dp_r")) | (F.col("g") != F.col("__dp_g")) | (F.col("b") != F.col("__dp_b"))
    out = a.join(other.hint("merge"), on).groupBy("img_id").agg(F.count_if(differs).alias("pixel_diff_count"), F.count("*").alias("total_pixels"))
    return out.withColumn("diff_percentage", F.col("pixel_diff_count") / F.col("total_pixels") * 100)
