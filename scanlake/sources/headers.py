"""A data source of image attributes: it reads the first bytes of each file, not its pixels.

    spark.dataSource.register(ImageHeaders)
    spark.read.format("image_headers").option("unknown", "list").load("/data/images")
"""

from __future__ import annotations

import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scanlake.functions import names

#: Bytes that may be read of a file, files of a partition, and bytes that are read at once at least.
MOST, FILES, BLOCK = 1 << 16, 1024, 4096
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by the color type of a PNG.
PNG_CHANNELS = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}
#: Markers of JPEG frames, which hold the size.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}


class Prefix:
    """Random reads of an open file within a budget; a small read takes a block, which serves the ones near it."""

    def __init__(self, file):
        self.file, self.left, self.start, self.block = file, MOST, 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.block):
            size = min(max(n, BLOCK), self.left)
            self.file.seek(at)
            self.start, self.block = at, self.file.read(size)
            self.left -= size
        found = self.block[at - self.start : at - self.start + n]
        if len(found) < n:
            raise ValueError("the header is cut off" if self.left else f"no size in {MOST} bytes")
        return found


def png(read) -> tuple:
    width, height, depth, color = struct.unpack(">IIBB", read(16, 10))
    channels, at, kind = PNG_CHANNELS[color], 8, b""
    while color == 3 and kind not in (b"tRNS", b"IDAT"):  # a palette with transparent colors has a fourth channel
        size, kind = struct.unpack(">I4s", read(at, 8))
        channels, at = channels + (kind == b"tRNS"), at + 12 + size
    return "png", width, height, channels, "uint16" if depth == 16 else "uint8"


def jpeg(read) -> tuple:
    at = 2
    while True:
        mark, kind = read(at, 2)
        if mark != 0xFF:
            raise ValueError("no marker where one must be")
        if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 1:  # fill bytes, and markers that stand alone
            at += 1 if kind == 0xFF else 2
            continue
        if kind in FRAMES:
            depth, height, width, channels = struct.unpack(">BHHB", read(at + 4, 6))
            return "jpeg", width, height, channels, "uint8" if depth <= 8 else "uint16"
        if kind in (0xD9, 0xDA):
            raise ValueError("no frame before the data")
        at += 2 + struct.unpack(">H", read(at + 2, 2))[0]


def bmp(read) -> tuple:
    size = struct.unpack("<I", read(14, 4))[0]
    old = size == 12
    width, height = struct.unpack("<HH", read(18, 4)) if old else struct.unpack("<ii", read(18, 8))
    bits = struct.unpack("<H", read(24 if old else 28, 2))[0]
    channels = 4 if bits == 32 else 3
    if bits <= 8:
        colors = (0 if old else struct.unpack("<I", read(46, 4))[0]) or 1 << bits
        step = 3 if old else 4
        palette = read(14 + size, colors * step)
        channels = 1 if all(len(set(palette[i : i + 3])) == 1 for i in range(0, len(palette), step)) else 3
    return "bmp", width, abs(height), channels, "uint8"


def tiff(read) -> tuple:
    order = "<" if read(0, 2) == b"II" else ">"
    at = struct.unpack(order + "I", read(4, 4))[0]
    found = {277: 1, 258: 1, 339: 1}
    for i in range(struct.unpack(order + "H", read(at, 2))[0]):
        tag, kind, count = struct.unpack(order + "HHI", read(at + 2 + 12 * i, 8))
        if tag in (256, 257, 258, 277, 339):
            size = {3: 2, 4: 4}[kind]
            place = at + 10 + 12 * i
            if size * count > 4:
                place = struct.unpack(order + "I", read(place, 4))[0]
            found[tag] = struct.unpack(order + ("H" if size == 2 else "I"), read(place, size))[0]
    bits, sample = found[258], {1: "uint", 2: "int", 3: "float"}[found[339]]
    return "tiff", found[256], found[257], found[277], "uint8" if bits < 8 else f"{sample}{bits}"


def attributes(read) -> tuple | None:
    """(kind, width, height, channels, dtype) by the first bytes of a file; None if it is no kind of image that is known here."""
    try:
        start = read(0, 4)
    except ValueError:
        return None
    for begins, kind in ((SIGNATURE[:4], png), (b"\xff\xd8\xff", jpeg), (b"BM", bmp), (b"II*\0", tiff), (b"MM\0*", tiff)):
        if start.startswith(begins):
            return kind(read)
    return None


def filesystem(root: str):
    """The Arrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    root = root.rstrip("/")
    if root.startswith(("/", "file:/")):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root if ":/" in root else f"file://{root}")


class Paths(InputPartition):
    pass


class HeaderReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.unknown = options["path"].rstrip("/"), options.get("unknown", "raise")
        self.extensions = tuple(filter(None, options.get("extensions", ",".join(names.FINALIZE_EXTENSIONS)).split(",")))

    def partitions(self):
        from pyarrow import fs

        store, root = filesystem(self.root)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.lower().endswith(self.extensions))
        if not found:
            raise ValueError(f"no files with {', '.join(self.extensions)} in {self.root}")
        return [Paths(found[i : i + FILES]) for i in range(0, len(found), FILES)]

    def read(self, partition):
        store, root = filesystem(self.root)
        scheme = "file:" if store.type_name == "local" else self.root.removesuffix(root)
        for path in partition.value:
            shown = scheme + path
            with store.open_input_file(path) as file:
                try:
                    found = attributes(Prefix(file))
                except (ValueError, KeyError, struct.error) as error:
                    if self.unknown == "raise":
                        raise ValueError(f"cannot read {shown}: {error}") from error
                    found = None
                if found is None and self.unknown == "raise":
                    raise ValueError(f"cannot read {shown}: no known kind of image")
                yield (shown, file.size(), *(found or (None,) * 5))


class ImageHeaders(DataSource):
    """path, length, kind, width, height, channels, dtype of image files: PNG, JPEG, BMP and TIFF; at most MOST bytes are read of each.

    Options: path; extensions, a list with commas; unknown: "raise" (with the path) or "list" for rows of nulls.
    """

    @classmethod
    def name(cls):
        return "image_headers"

    def schema(self):
        return "path string, length long, kind string, width int, height int, channels int, dtype string"

    def reader(self, schema):
        return HeaderReader(self.options)


def image_headers(spark, root: str, unknown: str = "raise", extensions: tuple[str, ...] = names.FINALIZE_EXTENSIONS):
    spark.dataSource.register(ImageHeaders)
    return spark.read.format("image_headers").option("unknown", unknown).option("extensions", ",".join(extensions)).load(root)
