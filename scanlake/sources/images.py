"""Image files: scans that read no bytes they do not need, headers, pixels, and a sink for files by name.

Files of 8 bits (PNG, JPEG, BMP) are decoded by Spark's own image source. PNG files of 16 bits, which it cuts to 8 without a word, have the small
decoder here; 16-bit palettes, interlaced files and TIFF are not read and raise, or give rows of nulls if asked to. Spark's file sources keep an entry
of each file on the driver, several times a job. So folders are listed by tasks, plain PNG files of few pixels, which can be very many, are opened and decoded
here as well, and the image source is given the others a slice at a time.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import chain, islice
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.functions import names
from scanlake.sources.headers import FILES, SIGNATURE, Prefix, attributes, filesystem
from scanlake.sources.versions import delete, exists, qualified
from scanlake.sources.work import new_folder, written

CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Pixels up to which a plain PNG of 8 bits is decoded here, files of a slice for the image source, and samples and images of a batch at most (one image may be more).
SMALL, SLICE, SAMPLES, IMAGES = 1 << 12, 1 << 13, 1 << 20, 1 << 10
DECODED = "path string, height int, width int, channels int, dtype string, data array<int>"


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...], recursive: bool = True, content: bool = False) -> DataFrame:
    """path, length of files by lowercased suffix; contents are read if asked for. Raises where there is no such file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    found = rows.select("path", "length", *(["content"] if content else [])).filter(names.has_extension(F.col("path"), extensions))
    if found.select("path").isEmpty():
        raise ValueError(f"no files with {', '.join(extensions)} in {root}")
    return found


def is_hidden(name: str) -> bool:
    """Names that Spark's scans pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def entries(store, folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of what lies in a folder, hidden names apart; one at a time where the store is the local one."""
    from pyarrow import fs

    if store.type_name == "local":
        with os.scandir(folder) as found:
            for entry in found:
                if not is_hidden(entry.name) and (entry.is_dir() or entry.is_file()):
                    yield entry.path, entry.is_dir()
    else:
        for info in store.get_file_info(fs.FileSelector(folder)):
            if not is_hidden(info.base_name):
                yield info.path, info.type == fs.FileType.Directory


def listed(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """path of a folder's files by lowercased suffix, at any depth, as a table that tasks have written. Raises where there is no such file.

    Tasks list a level of folders at a time, one folder each, and pass names on as they find them; the driver sees none of them.
    """
    root = qualified(spark, root)

    def run(batches):
        store, folder = filesystem(root)
        shown = "file:" if store.type_name == "local" else root.removesuffix(folder)
        for batch in batches:
            for start in batch.column(0).to_pylist():
                found = entries(store, start.removeprefix(shown))
                while part := list(islice(found, IMAGES)):
                    yield pa.RecordBatch.from_arrays([pa.array([shown + p for p, _ in part]), pa.array([f for _, f in part])], names=["path", "folder"])

    folders, files = spark.range(1).select(F.lit(root).alias("path")), []
    while not files or not folders.isEmpty():
        level = written(folders.mapInArrow(run, "path string, folder boolean"), "listed")
        files.append(level.filter(~F.col("folder") & names.has_extension(F.col("path"), extensions)).select("path"))
        folders = level.filter("folder").select("path").repartition(_tasks(spark), "path")
    found = reduce(DataFrame.unionByName, files)
    if found.isEmpty():
        raise ValueError(f"no files with {', '.join(extensions)} in {root}")
    return found


def _tasks(spark: SparkSession, files: int = 0) -> int:
    """Tasks for so many files: Spark itself makes one for every 32 small files, each of which starts a worker for every Python step that follows."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-files // FILES))


def is_plain(read) -> bool:
    """Whether a PNG has 8 bits, one or three channels, rows in order, few pixels, and nothing that could change its samples: its data follow its header."""
    width, height, depth, color, *rest = struct.unpack(">IIBBBBB", read(16, 13))
    return 0 < width * height <= SMALL and depth == 8 and color in (0, 2) and not any(rest) and read(12, 4) == b"IHDR" and read(37, 4) == b"IDAT"


def headed(files: DataFrame, root: str) -> DataFrame:
    """path, and whether the file is decoded here, of files(path) in the folder root: of 16 bits, or plain and small. What has no known header is not."""
    root = qualified(files.sparkSession, root)

    def here(file) -> bool:
        read = Prefix(file)
        try:
            found = attributes(read)
            return found is not None and (found[4] == "uint16" or (found[0] == "png" and is_plain(read)))
        except (ValueError, KeyError, struct.error):
            return False

    def run(batches):
        store, folder = filesystem(root)
        shown = len("file:" if store.type_name == "local" else root.removesuffix(folder))
        for batch in batches:
            told = []
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path[shown:]) as file:
                    told.append(here(file))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.bool_())], names=["path", "here"])

    return files.select("path").mapInArrow(run, "path string, here boolean")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, int]):
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def pixels_of_8_bits(spark: SparkSession, root: str | list[str], extensions: tuple[str, ...] = names.FINALIZE_EXTENSIONS, on_bad: str = "raise", tasks: int | None = None) -> DataFrame:
    """Images by Spark's image source: path, height, width, channels (blue, green, red), dtype, data as unsigned bytes.

    root: a folder, or paths of files. on_bad: what a file that is no image does: "raise" with its path, or "null" for a row without data. tasks: at most so many
    (see `_tasks`). The bytes of a batch become its samples in one step, so the cost is in proportion to the pixels.
    """
    source = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true")
    if isinstance(root, str):
        rows = source.load(root)
    else:  # looked up by few tasks, not by one for each file, and not kept for later scans; names are no patterns
        with _settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": tasks or _tasks(spark), "spark.sql.hive.filesourcePartitionFileCacheSize": 0}):
            rows = source.load([re.sub(r"([\\{}\[\]*?])", r"\\\1", path) for path in root])
    rows = rows.select("image.*")
    rows = rows.coalesce(tasks) if tasks else rows
    # The image source writes file:/// where the other sources have file:/, and a URL's %20 where they have a blank.
    rows = rows.withColumn("origin", F.regexp_replace("origin", "^file:/+", "file:/")).filter(names.has_extension(F.col("origin"), extensions))

    def run(batches):
        for batch in batches:
            paths, height = [unquote(p) for p in batch.column(0).to_pylist()], batch.column(1).to_numpy()
            good = height >= 0
            if on_bad == "raise" and not good.all():
                raise ValueError(f"cannot read {paths[int(np.argmin(good))]}")
            data, lost = batch.column(4), pa.array(~good)
            ends = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1]
            samples = np.frombuffer(data.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if data.buffers()[2] is not None else np.zeros(0, np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(samples, pa.int32()), mask=lost)
            sizes = [pa.array(batch.column(i).to_numpy(), pa.int32(), mask=~good) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *sizes, pa.array(["uint8"] * len(data), pa.string(), mask=~good), lists], names=["path", "height", "width", "channels", "dtype", "data"])

    return rows.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, DECODED)


def image_parts(spark: SparkSession, root: str, extensions: tuple[str, ...] = names.FINALIZE_EXTENSIONS, on_bad: str = "raise", files: DataFrame | None = None) -> Iterator[DataFrame]:
    """The images of a folder in parts, each a table as `decoded_images` has it; with a part after the other, the driver never knows more than SLICE or so files.

    Headers are read first, once, which tell the files that are decoded here, all of them one part. The others, by the hash of their paths, are slices for Spark's image
    source, which looks up each file that it reads. Nothing is shuffled but paths. files(path): what `listed` has found, if that is there already.
    """
    files = listed(spark, root, extensions) if files is None else files
    heads = written(headed(files.repartition(_tasks(spark, files.count()), "path"), root), "headers")
    n = {r["here"]: r["count"] for r in heads.groupBy("here").count().collect()}
    if True in n:
        yield decoded(heads.filter("here").select("path").repartition(_tasks(spark, n[True]), "path"), on_bad, root)
    if False in n:
        parts, place = -(-n[False] // SLICE), new_folder(spark, "slices")
        slices = heads.filter("not here").select("path", F.pmod(F.xxhash64("path"), F.lit(parts)).alias("slice"))
        slices.repartition("slice").write.partitionBy("slice").parquet(place)
        for i in range(parts):
            if not exists(spark, f"{place}/slice={i}"):  # by chance without files
                continue
            gc.collect()  # Python's handles of the slices before, which keep their files on the driver, are in cycles
            paths = [r["path"] for r in spark.read.schema("path string").parquet(f"{place}/slice={i}").collect()]
            yield pixels_of_8_bits(spark, paths, extensions, on_bad, tasks=_tasks(spark, len(paths)))


def decoded_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = names.FINALIZE_EXTENSIONS, on_bad: str = "raise") -> DataFrame:
    """All images of a folder, of 8 and of 16 bits, as one table: path, height, width, channels, dtype, data.

    Of 16 bits only PNG is decoded. on_bad as for `pixels_of_8_bits`; see `quarantined`. The driver keeps an entry of each file that Spark's image source
    reads (see `image_parts`, by which that can be done a slice at a time), and of no other.
    """
    return reduce(DataFrame.unionByName, image_parts(spark, root, extensions, on_bad))


def quarantined(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images that could be read, paths of files that could not) of images that were decoded with on_bad="null"."""
    return images.filter("data is not null"), images.filter("data is null").select("path")


def write_files(files: DataFrame | Iterable[DataFrame], root: str) -> DataFrame:
    """Write files(path, content), each under its path in root, a folder that all executors share; returns their paths. files: a table, or parts of it, one after the other.

    Tasks write to a hidden folder, under names of their own attempt. What the attempts that won have written is a table, committed by Spark;
    only then are the files in it renamed into place, by tasks as well, which may run again. So no half file and none of a
    failed or speculative attempt is ever under its name; if the job fails, nothing is. Of equal paths one wins.
    """
    parts = iter([files] if isinstance(files, DataFrame) else files)
    first = next(parts)
    spark, staging = first.sparkSession, f"_staging-{uuid.uuid4().hex}"
    root = root.rstrip("/")

    def stage(batches):
        store, folder = filesystem(root)
        context, n = TaskContext.get(), 0
        own = f"{staging}/{context.partitionId()}-{context.taskAttemptId()}"  # attempts of all parts have different ids
        store.create_dir(f"{folder}/{own}", recursive=True)
        for batch in batches:
            staged = []
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                if not path.is_valid or not content.is_valid:
                    raise ValueError(f"no path or no content: {path}")
                staged.append(f"{own}/{n}")
                n += 1
                with store.open_output_stream(f"{folder}/{staged[-1]}") as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(staged, pa.string())], names=["path", "staged"])

    def rename(batches):
        from pyarrow import fs

        (store, folder), made = filesystem(root), None
        for batch in batches:
            for path, staged in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = f"{folder}/{path.lstrip('/')}"
                if made != (made := to.rsplit("/", 1)[0]):
                    store.create_dir(made, recursive=True)
                if store.get_file_info(f"{folder}/{staged}").type != fs.FileType.NotFound:  # else an earlier attempt has renamed it
                    store.move(f"{folder}/{staged}", to)
                elif store.get_file_info(to).type == fs.FileType.NotFound:
                    raise ValueError(f"lost {path}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    won, done = new_folder(spark, "staged"), new_folder(spark, "renamed")
    try:
        for part in chain([first], parts):
            part.select("path", "content").mapInArrow(stage, "path string, staged string").write.mode("append").parquet(won)
        winners = spark.read.parquet(won).groupBy("path").agg(F.max("staged").alias("staged"))
        winners.mapInArrow(rename, "path string").write.parquet(done)
    finally:
        delete(spark, f"{root}/{staging}")
    return spark.read.parquet(done)


def header(content: Column) -> list[Column]:
    """width, height, channels, dtype from a PNG's header, without decoding; nulls where the signature is not that of a PNG."""
    is_png = F.substring(content, 1, 8) == F.lit(SIGNATURE)
    number = lambda at, n: F.when(is_png, F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int"))
    kind = number(26, 1)
    channels = F.when(kind == 0, 1).when(kind == 2, 3).when(kind == 4, 2).when(kind == 6, 4)
    dtype = F.when(number(25, 1) == 16, "uint16").when(is_png, "uint8")
    return [number(17, 4).alias("width"), number(21, 4).alias("height"), channels.alias("channels"), dtype.alias("dtype")]


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of an [H, W] or [H, W, 3] array of uint8 or uint16."""
    deep = pixels.dtype.itemsize == 2
    rows = pixels.astype(">u2" if deep else "u1").reshape(len(pixels), -1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 16 if deep else 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(content: bytes) -> np.ndarray:
    """[H, W, C] of uint8 or uint16, channels as stored; raises on anything that is not a plain PNG."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, head = 8, b"", None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        part = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            data += part
        elif data:  # all of the data stand together
            break
        at += 12 + size
    if head is None or head[3] not in CHANNELS or head[2] not in (8, 16) or head[6]:
        raise ValueError("unsupported PNG")
    width, height, depth, channels = head[0], head[1], head[2], CHANNELS[head[3]]
    step = channels * depth // 8
    size = height * (1 + width * step)
    raw = np.frombuffer(zlib.decompressobj().decompress(data, size), dtype=np.uint8).reshape(height, 1 + width * step)
    if (raw[:, 0] > 4).any():
        raise ValueError("unknown filter")
    out = unfiltered(raw[:, 0], raw[:, 1:].reshape(height, width, step)).reshape(height, width * step)
    return out.view(">u2" if depth == 16 else np.uint8).reshape(height, width, channels).astype(np.uint16 if depth == 16 else np.uint8)


def unfiltered(kinds: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """The bytes [H, W, bytes of a pixel] of rows that were coded as differences from their neighbours, by the kind of each row.

    Rows that look left alone, or up alone, are done at once each. If some look at both, all pixels on an ascending diagonal are done together: their
    neighbours on the left, above, and between these lie on the two diagonals before.
    """
    height, width, step = coded.shape
    if not np.isin(kinds, (3, 4)).any():
        out = coded.copy()
        for y in range(height):
            if kinds[y] == 1:
                out[y] = np.cumsum(coded[y], axis=0, dtype=np.uint8)
            elif kinds[y] == 2 and y:
                out[y] += out[y - 1]
        return out
    out = np.zeros((height + 1, width + 1, step), dtype=np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]  # left, above, and above left
        to_a, to_b, to_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))
        guess = np.choose(kinds[y, None], (0, a, b, (a + b) >> 1, nearest))
        out[y + 1, x + 1] = (coded[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def decoded(files: DataFrame, on_bad: str = "raise", root: str | None = None) -> DataFrame:
    """Images of files(path, content), channels as stored; or of files(path) in the folder root, which tasks open, of three channels blue first. on_bad: "raise", or "null" for a row without data."""
    root = root and qualified(files.sparkSession, root)

    def batch_of(rows):
        columns = [pa.array(c, k) for c, k in zip(zip(*(r[:5] for r in rows), strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]
        data = [np.zeros(0, np.int32) if r[5] is None else r[5] for r in rows]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, data)]), pa.int32()), pa.array(np.concatenate(data), pa.int32()), mask=pa.array([r[5] is None for r in rows]))
        return pa.RecordBatch.from_arrays([*columns, lists], names=["path", "height", "width", "channels", "dtype", "data"])

    def run(batches):
        store, folder = filesystem(root) if root else (None, "")
        shown = len("file:" if root and store.type_name == "local" else (root or "").removesuffix(folder))
        for batch in batches:
            rows, n = [], 0
            for i, path in enumerate(batch.column(0).to_pylist()):
                if root:
                    with store.open_input_file(path[shown:]) as file:
                        content = file.read()
                else:
                    content = batch.column(1)[i].as_py()
                try:
                    p = decode_png(content)
                    p = p[:, :, ::-1] if root and p.shape[2] == 3 else p
                    rows.append([path, *p.shape, str(p.dtype), p.reshape(-1).astype(np.int32)])
                    n += p.size
                except (ValueError, zlib.error, struct.error) as error:
                    if on_bad == "raise":
                        raise ValueError(f"cannot read {path}: {error}") from error
                    rows.append([path, None, None, None, None, None])
                if n >= SAMPLES or len(rows) == IMAGES:
                    yield batch_of(rows)
                    rows, n = [], 0
            if rows:
                yield batch_of(rows)

    return files.select("path", *([] if root else ["content"])).mapInArrow(run, DECODED)


def encoded(images: DataFrame) -> DataFrame:
    """files(path, content, length), as PNG, from images(path, height, width, channels, dtype, data) of one channel, or of three with blue first."""

    def run(batches):
        for batch in batches:
            lists, out = batch.column(5), []
            ends, data = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, (h, w, c, dtype) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                pixels = data[ends[i] : ends[i + 1]].astype(dtype).reshape(h, w, c)
                out.append(encode_png(pixels[:, :, ::-1] if c == 3 else pixels[:, :, 0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array([len(o) for o in out], pa.int64())], names=["path", "content", "length"])

    return images.select("path", "height", "width", "channels", "dtype", "data").mapInArrow(run, "path string, content binary, length long")


def preprocess_folder(spark: SparkSession, source: str, target: str, size: tuple[int, int] | None = (512, 512), channels: str = "gray", denoise: bool = True, transform=None, on_bad: str = "raise") -> DataFrame:
    """Each image of a folder through the kernels (see operators.images.preprocess), written as PNG in another under its relative path.

    Paths that differ in their suffix alone would be one file, and raise. Returns the paths that were written, relative to target. on_bad: "raise",
    or "skip" for files that cannot be read. Nothing is shuffled but paths. Images come in parts, so that the driver's memory does not grow with their number.
    """
    from scanlake.operators.images import preprocess

    files = listed(spark, source, names.PREPROCESS_EXTENSIONS)
    root = qualified(spark, source)
    renamed = names.with_suffix(names.relative(F.col("path"), root), ".png")
    twice = files.groupBy(renamed.alias("path")).agg(F.count("*").alias("n"), F.min("path").alias("first")).filter("n > 1").head()
    if twice:
        raise ValueError(f"{twice['n']} files would be written as {twice['path']}, {twice['first']} among them")
    parts = image_parts(spark, source, names.PREPROCESS_EXTENSIONS, "raise" if on_bad == "raise" else "null", files)
    made = (encoded(preprocess(p.filter("data is not null"), size, channels, denoise, transform)).withColumn("path", renamed) for p in parts)
    return write_files(made, target)
