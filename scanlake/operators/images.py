"""Image operators on a pixel table (id, y, x, c, v): visible to the optimizer, one row a sample; and the same kernels on whole images.

Images of one table may differ in size, channels and depth: what an operator needs of these it takes from the image's own rows. Resizing and
denoising need an image as a whole: its pixels meet in one exchange, as one row, and come out as pixels again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights in thousandths, in channel order blue, green, red.
GRAY = (114, 587, 299)
#: Added before rounding, so that the order in which parts of a cell are summed cannot turn a half down.
SLACK = 1e-9


def whole(v: Column) -> Column:
    """The nearest integer of a resized value, halves up."""
    return F.floor(v + (0.5 + SLACK)).cast("int")


def to_gray(pixels: DataFrame, key: str = "vec_id") -> DataFrame:
    """One channel: floor((114 B + 587 G + 299 R + 500) / 1000), in integers; a single channel passes through."""
    weight = F.element_at(F.array(*[F.lit(w) for w in GRAY]), F.col("c") + 1)
    sums = pixels.groupBy(key, "y", "x").agg(F.sum(F.col("v") * weight).alias("s"), F.count("*").alias("n"), F.max("v").alias("one"))
    return sums.select(key, "y", "x", F.lit(0).alias("c"), F.when(F.col("n") == 1, F.col("one")).otherwise(F.floor((F.col("s") + 500) / 1000)).cast("int").alias("v"))


def sized(pixels: DataFrame, key: str = "vec_id") -> DataFrame:
    """pixels with height, width and channels of each image, taken from its rows unless the table has them."""
    if {"height", "width", "channels"} <= set(pixels.columns):
        return pixels
    sizes = pixels.groupBy(key).agg(*[(F.max(c) + 1).cast("int").alias(name) for c, name in (("y", "height"), ("x", "width"), ("c", "channels"))])
    return pixels.drop("height", "width", "channels").join(sizes, key)


def to_color(pixels: DataFrame, key: str = "vec_id") -> DataFrame:
    """Three equal channels of a single one; images with more pass through."""
    to = F.when(F.col("channels") == 1, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array("c"))
    return sized(pixels, key).select(key, "y", "x", F.explode(to).alias("c"), "v")


def normalize_depth(pixels: DataFrame, key: str = "vec_id") -> DataFrame:
    """16-bit values stretched to the whole range: truncated (v - min) / (max - min + 1e-6) * 65535 per image.

    A column dtype tells the depth of each image; what is not uint16 passes through. Without the column all images are of 16 bits.
    """
    deep = F.col("dtype") == "uint16" if "dtype" in pixels.columns else F.lit(True)
    ends = pixels.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    value = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6) * 65535)
    return pixels.join(ends, key).select(key, "y", "x", "c", F.when(deep, value).otherwise(F.col("v")).cast("int").alias("v"))


def area_weights(source: int, target: int) -> tuple[np.ndarray, int]:
    """[target, source] and a divisor: the share of a target cell that each source cell covers. Both are whole numbers, so sums are exact."""
    t, cells = np.arange(target)[:, None], np.arange(source)[None]
    return np.clip(np.minimum((t + 1) * source, (cells + 1) * target) - np.maximum(t * source, cells * target), 0, None), source


def bilinear_weights(source: int, target: int) -> tuple[np.ndarray, int]:
    """The same for what each source cell weighs in a target cell by half-pixel centres, which are clamped at the borders."""
    unit = 2 * target
    centre = np.clip((2 * np.arange(target)[:, None] + 1) * source - target, 0, (source - 1) * unit)
    return np.clip(unit - np.abs(centre - np.arange(source)[None] * unit), 0, None), unit


def _resized(pixels: DataFrame, target: tuple[int, int], key: str, weights) -> DataFrame:
    """An image's pixels meet once; images of one shape are resized together, by a matrix for each side. One that lacks pixels raises.

    weights(source, target) is a side's matrix and divisor. What leaves the task is pixels of the target size.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            parts, ends = lists.flatten(), np.cumsum(np.r_[0, np.diff(lists.offsets.to_numpy())])
            place, v = np.stack([parts.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]), parts.field(3).to_numpy(zero_copy_only=False)
            shapes = np.maximum.reduceat(place, ends[:-1], axis=1).T + 1
            if (shapes.prod(axis=1) != np.diff(ends)).any():
                raise ValueError("an image lacks pixels")
            for shape in np.unique(shapes, axis=0):
                at = np.flatnonzero((shapes == shape).all(axis=1))
                own = (ends[at][:, None] + np.arange(shape.prod())).ravel()
                images = np.empty((len(at), *shape))
                images[(np.repeat(np.arange(len(at)), shape.prod()), *place[:, own])] = v[own]
                (rows, by), (columns, times) = (weights(a, b) for a, b in zip(shape[1:].tolist(), target, strict=True))
                out = rows @ images @ columns.T / (by * times)
                cells = [pa.array(np.tile(i.ravel(), len(at)), pa.int32()) for i in np.indices(out.shape[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(at, out[0].size))), cells[1], cells[2], cells[0], pa.array(out.ravel())], names=[key, "y", "x", "c", "v"])

    images = pixels.groupBy(key).agg(F.collect_list(F.struct("c", "y", "x", "v")).alias("p"))
    return images.select(key, "p").mapInArrow(run, f"{key} {pixels.schema[key].dataType.simpleString()}, y int, x int, c int, v double")


def resize_area(pixels: DataFrame, target: tuple[int, int], key: str = "vec_id") -> DataFrame:
    """Area averaging of images to (height, width); v is a double."""
    return _resized(pixels, target, key, area_weights)


def resize_bilinear(pixels: DataFrame, target: tuple[int, int], key: str = "vec_id") -> DataFrame:
    return _resized(pixels, target, key, bilinear_weights)


def resize_area_by_pixel(pixels: DataFrame, target: tuple[int, int], key: str = "vec_id") -> DataFrame:
    """Area averaging for images that are too large to be one row: pixels find the target cells that they count in, and are summed there; partial sums are shuffled."""
    rows = sized(pixels, key)
    for c, size, to in (("y", "height", target[0]), ("x", "width", target[1])):
        rows = rows.withColumn(f"_{c}", F.explode(area_cells(F.col(c), F.col(size).cast("double"), float(to)))).withColumns({f"t{c}": F.col(f"_{c}.t"), f"w{c}": F.col(f"_{c}.w")}).drop(f"_{c}")
    return rows.groupBy(key, "ty", "tx", "c").agg(F.sum(F.col("v") * F.col("wy") * F.col("wx")).alias("v")).select(key, F.col("ty").alias("y"), F.col("tx").alias("x"), "c", "v")


def _cells(low: Column, high: Column, target: float, weight) -> Column:
    """(t, w) of target cells from low to high, within the target, that weigh anything."""
    places = F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(target - 1)).cast("int"))
    return F.filter(F.transform(places, lambda t: F.struct(t.alias("t"), weight(t).alias("w"))), lambda c: c["w"] > 1e-12)


def area_cells(at: Column, source: Column, target: float) -> Column:
    """The share of each target cell that a source cell covers."""
    edge = source / target
    weight = lambda t: (F.least((t + 1) * edge, at + 1) - F.greatest(t * edge, at)) / edge
    return _cells(F.floor(at / edge) - 1, F.ceil((at + 1) / edge), target, weight)


def median3(pixels: DataFrame, key: str = "vec_id") -> DataFrame:
    """3 x 3 median per channel with the border repeated. An image's pixels meet once, and it is filtered whole; one that lacks pixels raises."""
    fields = pixels.select(key, "y", "x", "c", "v").schema

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            parts, ends = lists.flatten(), np.cumsum(np.r_[0, np.diff(lists.offsets.to_numpy())])
            c, y, x, v = (parts.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            out = np.empty_like(v)
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                shape = (c[a:b].max() + 1, y[a:b].max() + 1, x[a:b].max() + 1)
                if np.prod(shape) != b - a:
                    raise ValueError(f"an image of {shape} has {b - a} pixels")
                out[a:b] = median(v[a:b].reshape(shape).transpose(1, 2, 0)).transpose(2, 0, 1).ravel()
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(lists)), np.diff(ends))))
            yield pa.RecordBatch.from_arrays([keys, parts.field(1), parts.field(2), parts.field(0), pa.array(out, parts.field(3).type)], names=[key, "y", "x", "c", "v"])

    images = pixels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("c", "y", "x", "v"))).alias("p"))
    return images.select(key, "p").mapInArrow(run, fields)


def median(image: np.ndarray) -> np.ndarray:
    """The 3 x 3 median of an [H, W, C] array, the border repeated."""
    padded = np.pad(image, ((1, 1), (1, 1), (0, 0)), mode="edge")
    near = [padded[i : i + image.shape[0], j : j + image.shape[1]] for i in range(3) for j in range(3)]
    return np.partition(np.stack(near), 4, axis=0)[4]


def kernel(image: np.ndarray, target: tuple[int, int] | None = None, channels: str = "gray", denoise: bool = True) -> np.ndarray:
    """The same steps on one [H, W, C] array: channels, bit depth, area resize, median."""
    x = image.astype(np.int64)
    if channels == "gray" and x.shape[2] == 3:
        x = ((x * np.array(GRAY)).sum(axis=2, keepdims=True) + 500) // 1000
    elif channels == "color" and x.shape[2] == 1:
        x = np.repeat(x, 3, axis=2)
    if image.dtype == np.uint16:
        lo, hi = x.min(), x.max()
        x = np.floor((x - lo) / (hi - lo + 1e-6) * 65535).astype(np.int64)
    if target and target != x.shape[:2]:
        (rows, by), (columns, times) = (area_weights(a, b) for a, b in zip(x.shape[:2], target, strict=True))
        x = np.einsum("ty,sx,yxc->tsc", rows, columns, x.astype(np.float64), optimize=True) / (by * times)
        x = np.floor(x + (0.5 + SLACK)).astype(np.int64)
    return median(x) if denoise else x


def preprocess(images: DataFrame, target: tuple[int, int] | None = (512, 512), channels: str = "gray", denoise: bool = True, transform=None) -> DataFrame:
    """decoded images (path, height, width, channels, dtype, data), each through the kernels in its own task; no shuffle.

    transform: a function of an [H, W, C] array to such an array, applied last.
    """
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())

    def run(batches):
        for batch in batches:
            lists, dtypes = batch.column(5), batch.column(4).to_pylist()
            ends, data = lists.offsets.to_numpy(), lists.values.to_numpy()
            shapes, out = [], []
            for i, (h, w, c) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                x = kernel(data[ends[i] : ends[i + 1]].reshape(h, w, c).astype(dtypes[i]), target, channels, denoise)
                x = transform(x) if transform else x
                shapes.append(x.shape)
                out.append(x.reshape(-1).astype(np.int32))
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))
            columns = [batch.column(0), *([s[k] for s in shapes] for k in range(3)), dtypes]
            yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), flat], names=["path", "height", "width", "channels", "dtype", "data"])

    schema = "path string, height int, width int, channels int, dtype string, data array<int>"
    return images.select("path", "height", "width", "channels", "dtype", "data").mapInArrow(run, schema)
