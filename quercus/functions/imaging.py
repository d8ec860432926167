"""What can be said of pictures as columns: limits, geometry, quality, weights of words, descriptors of decoded pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A scene wider than this share of its height is cut to its middle; the cut's width as a share of the height.
WIDE, COLUMN = 0.85, 0.26


def decode_issue(n_bytes: Column, width: Column, height: Column, max_pixels: int, min_side: int) -> Column:
    """empty_image, invalid_image (not decoded: null sizes), image_too_large, image_too_small, or null."""
    return (
        F.when(F.coalesce(n_bytes, F.lit(0)) == 0, "empty_image")
        .when(width.isNull() | height.isNull(), "invalid_image")
        .when(width.cast("bigint") * height > max_pixels, "image_too_large")
        .when(F.least(width, height) < min_side, "image_too_small")
    )


def centre_view(width: Column, height: Column) -> Column:
    """left, top, right, bottom of the part of a picture that is looked at."""
    cut = F.greatest(F.lit(1), F.bround(height * COLUMN, 0).cast("int"))
    left = F.floor((width - cut) / 2).cast("int")
    wide = width / height > WIDE
    return F.struct(F.when(wide, left).otherwise(0).alias("left"), F.lit(0).alias("top"), F.when(wide, left + cut).otherwise(width).alias("right"), height.alias("bottom"))


def quality(contrast: Column, sharpness: Column) -> tuple[Column, Column]:
    """Score to 1, and what is wrong (too_dark before blurred; null: nothing)."""
    return F.least(F.lit(1.0), contrast / 38 * 0.55 + sharpness / 15 * 0.45), F.when(contrast < 8, "too_dark").when(sharpness < 3, "blurred")


def word_weight(score: Column, centre: Column, height: Column) -> Column:
    """Detector score, less at the edges of the frame, more for large letters."""
    return score * (0.2 + 0.8 * F.exp(-F.pow((centre - 0.5) / 0.2, F.lit(2.0)))) * F.least(F.lit(1.0), 0.4 + 12 * height)


def root_normalised(descriptor: Column) -> Column:
    """Square roots of a descriptor's shares of its sum."""
    total = F.aggregate(descriptor, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.transform(descriptor, lambda x: F.sqrt(x / F.greatest(total, F.lit(1e-8))))


def descriptor(pixels: np.ndarray) -> np.ndarray:
    """208 values of a 64 x 64 x 3 picture in 0 to 1: colour histograms, means and deviations of a 4 x 4 grid, edges of an 8 x 8 grid; unit length."""
    histograms = [np.histogram(pixels[:, :, c], bins=16, range=(0.0, 1.0))[0] / 4096 for c in range(3)]
    cells = pixels.reshape(4, 16, 4, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16, 256, 3)
    grid = np.stack([cells.mean(axis=1), cells.std(axis=1)], axis=1).ravel()
    grey = np.round(255 * (pixels @ np.array([0.299, 0.587, 0.114])))
    inner = sum(grey[1 + dy : 63 + dy, 1 + dx : 63 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    edges = grey.copy()  # a 3 x 3 kernel of -1 about 8; the border stays as it is
    edges[1:63, 1:63] = np.clip(9 * grey[1:63, 1:63] - inner, 0, 255)
    edge_grid = (edges / 255).reshape(8, 8, 8, 8).mean(axis=(1, 3)).ravel()
    out = np.concatenate([*histograms, grid, edge_grid]).astype(np.float32)
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out


def described(pictures: DataFrame, pixels: str = "pixels") -> DataFrame:
    """pictures (pixels: 64 x 64 x 3 bytes of a decoded picture) with embedding; null where the size is another."""
    place = pictures.columns.index(pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column(place):
                data = p.as_py()
                out.append(descriptor(np.frombuffer(data, np.uint8).reshape(64, 64, 3) / 255.0).tolist() if data and len(data) == 64 * 64 * 3 else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    return pictures.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pictures.schema.fields), "embedding array<float>"]))


def central_words(words: DataFrame) -> DataFrame:
    """Words (left, width, frame_width, conf) whose middle lies in the central two fifths of the frame and that were read with any confidence."""
    middle = (F.col("left") + F.col("width") / 2) / F.col("frame_width")
    return words.where(middle.between(0.3, 0.7) & (F.col("conf") >= 0))
