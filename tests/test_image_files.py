"""Reading and writing of image files: headers of four kinds, both depths, broken files, and a sink that is all or nothing."""

import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.sources import headers as H
from scanlake.sources import images as S

EXTENSIONS = (".png", ".jpg", ".bmp", ".tif", ".txt")


def png(width, height, depth, color, *chunks):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"crc!"
    return S.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + b"".join(chunk(k, d) for k, d in chunks) + chunk(b"IDAT", b"x")


def jpeg(width, height, channels, frame=0xC0, before=b""):
    return b"\xff\xd8" + before + b"\xff" + bytes([frame]) + struct.pack(">HBHHB", 8 + 3 * channels, 8, height, width, channels) + bytes(3 * channels) + b"\xff\xd9"


def segment(kind, size):
    return bytes([0xFF, kind]) + struct.pack(">H", size + 2) + b"\xff" * size


def bmp(width, height, bits, palette=b""):
    return b"BM" + bytes(12) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, 0, 0, 0, len(palette) // 4, 0) + palette + bytes(16)


def tiff(order, width, height, channels, bits, sample=1, far=0):
    """The directory stands `far` bytes behind the header; more than one value of bits stands behind it."""
    o = "<" if order == b"II" else ">"
    values, at = struct.pack(o + f"{channels}H", *[bits] * channels), 8 + far
    entry = lambda tag, kind, n, v: struct.pack(o + "HHI", tag, kind, n) + v.ljust(4, b"\0")
    entries = [entry(256, 4, 1, struct.pack(o + "I", width)), entry(257, 3, 1, struct.pack(o + "H", height)), entry(277, 3, 1, struct.pack(o + "H", channels)), entry(339, 3, 1, struct.pack(o + "H", sample))]
    behind = at + 2 + 12 * (len(entries) + 1) + 4
    entries.append(entry(258, 3, channels, struct.pack(o + "I", behind) if len(values) > 4 else values))
    return order + struct.pack(o + "HI", 42, at) + bytes(far) + struct.pack(o + "H", len(entries)) + b"".join(entries) + bytes(4) + values


KNOWN = {
    "gray.png": (png(7, 5, 8, 0), ("png", 7, 5, 1, "uint8")),
    "deep.PNG": (png(7, 5, 16, 2), ("png", 7, 5, 3, "uint16")),
    "palette.png": (png(3, 4, 4, 3, (b"PLTE", bytes(12))), ("png", 3, 4, 3, "uint8")),
    "clear.png": (png(3, 4, 8, 3, (b"PLTE", bytes(9)), (b"tRNS", b"\0")), ("png", 3, 4, 4, "uint8")),
    "a.jpg": (jpeg(640, 480, 3), ("jpeg", 640, 480, 3, "uint8")),
    "progressive.jpg": (jpeg(64, 48, 1, 0xC2, segment(0xE0, 14) + b"\xff\xff" + segment(0xE1, 60_000) + segment(0xC4, 30)), ("jpeg", 64, 48, 1, "uint8")),
    "many.jpg": (jpeg(9, 8, 3, 0xC1, segment(0xE1, 65_000) * 9), ("jpeg", 9, 8, 3, "uint8")),
    "color.bmp": (bmp(20, -10, 24), ("bmp", 20, 10, 3, "uint8")),
    "alpha.bmp": (bmp(20, 10, 32), ("bmp", 20, 10, 4, "uint8")),
    "gray.bmp": (bmp(20, 10, 8, b"".join(bytes([i, i, i, 0]) for i in range(256))), ("bmp", 20, 10, 1, "uint8")),
    "palette.bmp": (bmp(20, 10, 8, bytes([1, 2, 3, 0]) * 256), ("bmp", 20, 10, 3, "uint8")),
    "a.tif": (tiff(b"II", 100, 90, 1, 16), ("tiff", 100, 90, 1, "uint16")),
    "b.tif": (tiff(b"MM", 100, 90, 3, 8, far=9_000_000), ("tiff", 100, 90, 3, "uint8")),
    "c.tif": (tiff(b"II", 10, 9, 1, 32, 3), ("tiff", 10, 9, 1, "float32")),
}


def test_headers_of_four_kinds(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, (content, _) in KNOWN.items():
        (tmp_path / "sub" / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in H.image_headers(spark, str(tmp_path)).collect()}
    assert {n: tuple(r)[2:] for n, r in got.items()} == {n: want for n, (_, want) in KNOWN.items()}
    assert all(r.path.startswith("file:/") and r.length == len(KNOWN[n][0]) for n, r in got.items())
    assert {r.path for r in S.scan_files(spark, str(tmp_path), EXTENSIONS).collect()} == {r.path for r in got.values()}


def test_unknown_and_cut_headers(spark, tmp_path):
    bad = {"short.png": b"\x89P", "cut.png": png(7, 5, 8, 0)[:20], "text.png": b"not an image", "empty.png": b"", "endless.jpg": b"\xff\xd8" + b"\xff" * 200_000, "cut.tif": b"II*\0\xff\xff\xff\x7f", "nosize.jpg": b"\xff\xd8\xff\xd9"}
    for name, content in bad.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "good.png").write_bytes(KNOWN["gray.png"][0])
    got = {r.path.rsplit("/", 1)[1]: r.width for r in H.image_headers(spark, str(tmp_path), "list").collect()}
    assert got == {**dict.fromkeys(bad), "good.png": 7}
    with pytest.raises(Exception, match="cannot read file:.*(cut|short|text|empty|endless|nosize)"):
        H.image_headers(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no files with"):
        H.image_headers(spark, str(tmp_path), extensions=(".bmp",)).collect()


def test_at_most_a_prefix_is_read():
    class Counted:
        def __init__(self, content):
            self.content, self.at, self.total = content, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.total += n
            return self.content[self.at : self.at + n]

    for content in [c for c, _ in KNOWN.values()] + [b"\xff\xd8" + b"\xff" * 500_000, jpeg(1, 1, 1, before=segment(0xE1, 10) * 20_000)]:
        file = Counted(content)
        try:
            H.attributes(H.Prefix(file))
        except ValueError:
            pass
        assert file.total <= H.MOST


def pictures():
    rnd = np.random.default_rng(9)
    return {"a.png": rnd.integers(0, 255, (512, 512), dtype=np.uint8), "b.png": rnd.integers(0, 255, (40, 30, 3), dtype=np.uint8), "c.png": rnd.integers(0, 65535, (33, 21), dtype=np.uint16)}


def test_both_depths_are_decoded(spark, tmp_path):
    for name, pixels in pictures().items():
        (tmp_path / name).write_bytes(S.encode_png(pixels))
    (tmp_path / "note.txt").write_text("no image")
    rows = S.decoded_images(spark, str(tmp_path)).collect()
    got = {r.path.rsplit("/", 1)[1]: r for r in rows}
    assert set(got) == set(pictures()) and len(rows) == len(got)
    assert {r.path for r in rows} == {r.path for r in S.scan_files(spark, str(tmp_path), (".png",)).collect()}
    for name, pixels in pictures().items():
        want = pixels[:, :, ::-1] if pixels.ndim == 3 else pixels  # the image source has blue first
        assert got[name].data == want.ravel().tolist() and (got[name].height, got[name].width, got[name].dtype) == (*pixels.shape[:2], str(pixels.dtype))


def test_unreadable_files_raise_or_are_set_aside(spark, tmp_path):
    for name, pixels in pictures().items():
        (tmp_path / name).write_bytes(S.encode_png(pixels))
    (tmp_path / "broken.png").write_bytes(S.encode_png(pictures()["a.png"])[:40])
    (tmp_path / "deep.png").write_bytes(S.encode_png(pictures()["c.png"])[:60])
    (tmp_path / "words.jpg").write_text("no image at all")
    with pytest.raises(Exception, match="cannot read file:.*(broken|deep|words)"):
        S.decoded_images(spark, str(tmp_path)).collect()
    good, bad = S.quarantined(S.decoded_images(spark, str(tmp_path), on_bad="null"))
    assert {r.path.rsplit("/", 1)[1] for r in good.select("path").collect()} == set(pictures())
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad.collect()) == ["broken.png", "deep.png", "words.jpg"]


def test_decoding_is_linear(spark, tmp_path):
    took = {}
    for side in (256, 1024):
        (tmp_path / str(side)).mkdir()
        (tmp_path / str(side) / "x.png").write_bytes(S.encode_png(np.zeros((side, side), dtype=np.uint8)))
        rows = S.pixels_of_8_bits(spark, str(tmp_path / str(side))).select(F.size("data").alias("n"))
        assert rows.first().n == side * side
        start = time.time()
        rows.collect()
        took[side] = time.time() - start
    assert took[1024] < 3


def test_a_large_image_with_all_filters():
    pixels = np.random.default_rng(1).integers(0, 255, (512, 512), dtype=np.uint8)
    kinds = np.arange(512, dtype=np.uint8) % 5
    padded = np.pad(pixels.astype(int), ((1, 0), (1, 0)))
    a, b, c = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
    p = np.stack([np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)]).argmin(axis=0)
    guess = np.choose(kinds[:, None], (np.zeros_like(a), a, b, (a + b) // 2, np.choose(p, (a, b, c))))
    rows = np.c_[kinds[:, None], ((pixels - guess) % 256).astype(np.uint8)]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + bytes(4)
    content = S.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 512, 512, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes()))
    start = time.time()
    assert (S.decode_png(content)[:, :, 0] == pixels).all() and time.time() - start < 1


def test_files_appear_only_when_their_job_has_won(spark, tmp_path):
    """A task that fails after its first file leaves nothing under a name; another run then writes all."""
    root = tmp_path / "out"
    rows = [(f"/s/{i}.bin", bytes([i]) * i) for i in range(20)]
    df = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    with pytest.raises(Exception, match="no content"):
        S.write_files(df.unionByName(spark.createDataFrame([("/s/99.bin", None)], "path string, content binary")).coalesce(1), str(root))
    assert not [p for p in root.rglob("*") if p.is_file()]
    assert sorted(r.path for r in S.write_files(df, str(root)).collect()) == sorted(p for p, _ in rows)
    assert {f"/{p.relative_to(root)}": p.read_bytes() for p in root.rglob("*") if p.is_file()} == dict(rows)
    S.write_files(spark.createDataFrame([("/s/3.bin", b"new")], "path string, content binary"), str(root))
    assert (root / "s" / "3.bin").read_bytes() == b"new" and len(list(root.iterdir())) == 1


def test_a_folder_is_preprocessed_into_another(spark, tmp_path):
    from scanlake.operators.images import kernel

    made = pictures()
    (tmp_path / "in" / "s1").mkdir(parents=True)
    for name, pixels in made.items():
        (tmp_path / "in" / "s1" / name.replace("a.png", "A.PNG")).write_bytes(S.encode_png(pixels))
    (tmp_path / "in" / "note.txt").write_text("x")
    done = S.preprocess_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), (10, 12))
    assert sorted(r.path for r in done.collect()) == ["s1/A.png", "s1/b.png", "s1/c.png"]
    for name, pixels in made.items():
        got = S.decode_png((tmp_path / "out" / "s1" / name.replace("a.png", "A.png")).read_bytes())
        stored = pixels[:, :, ::-1] if pixels.ndim == 3 else pixels[:, :, None]
        assert got.dtype == pixels.dtype and (got == kernel(stored, (10, 12))).all()
    (tmp_path / "in" / "s1" / "b.jpg").write_text("no image")
    with pytest.raises(ValueError, match="written as s1/b.png"):
        S.preprocess_folder(spark, str(tmp_path / "in"), str(tmp_path / "out2"))
    (tmp_path / "in" / "s1" / "b.png").unlink()
    with pytest.raises(Exception, match="cannot read .*b.jpg"):
        S.preprocess_folder(spark, str(tmp_path / "in"), str(tmp_path / "out2"))
    assert not [p for p in (tmp_path / "out2").rglob("*") if p.is_file()]
    S.preprocess_folder(spark, str(tmp_path / "in"), str(tmp_path / "out2"), None, channels="color", on_bad="skip")
    assert sorted(p.name for p in (tmp_path / "out2").rglob("*") if p.is_file()) == ["A.png", "c.png"]
    assert S.decode_png((tmp_path / "out2" / "s1" / "A.png").read_bytes()).shape == (512, 512, 3)


def test_many_small_files_are_few_tasks(spark, tmp_path):
    """Not one for every 32 files: each task starts a worker for every Python step that follows."""
    content = S.encode_png(np.zeros((2, 2), dtype=np.uint8))
    for i in range(400):
        (tmp_path / f"{i}.png").write_bytes(content)
    images = S.decoded_images(spark, str(tmp_path))
    assert images.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism and images.count() == 400


def odd_folder(root, large=5):
    """Small PNGs, gray and of three channels, with all row filters, and files that are left to the image source; names that a URL or a pattern would change."""
    from tests.test_operators import coded_rows

    rnd, made = np.random.default_rng(4), {}
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    for name, shape, extra in (("s 1/a+b%20[1].png", (9, 12, 1), b""), ("s 1/{x}.png", (7, 5, 3), b""), ("text?.png", (4, 6, 1), chunk(b"tEXt", b"a\0b")), ("s 1/t u/gray.PNG", (1, 1, 1), b"")):
        pixels, kinds = rnd.integers(0, 256, shape, dtype=np.uint8), np.arange(shape[0], dtype=np.uint8) % 5
        rows = np.c_[kinds, coded_rows(pixels, kinds).reshape(shape[0], -1)].tobytes()
        head = struct.pack(">IIBBBBB", shape[1], shape[0], 8, 2 if shape[2] == 3 else 0, 0, 0, 0)
        made[name] = pixels, S.SIGNATURE + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    for i in range(large):
        pixels = rnd.integers(0, 256, (70, 65, 3) if i % 2 else (70, 65, 1), dtype=np.uint8)
        made[f"s 1/large {i} [a]%41.png"] = pixels, S.encode_png(pixels if i % 2 else pixels[:, :, 0])
    deep = rnd.integers(0, 65536, (6, 5, 3), dtype=np.uint16)
    made["deep #1.png"] = deep, S.encode_png(deep)
    for name, (_, content) in made.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    for name in ("_hidden.png", ".hidden.png", "_h/a.png"):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text("no image")
    return {name: pixels for name, (pixels, _) in made.items()}


def test_the_driver_lists_no_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "IMAGES", 3)
    for i in range(40):
        (tmp_path / f"{i}.png").write_bytes(S.encode_png(np.full((2, 2), i, dtype=np.uint8)))
    images = S.decoded_images(spark, str(tmp_path))
    assert not [f for f in images.inputFiles() if f.endswith(".png")]  # what a scan has listed
    assert sorted(r.data[3] for r in images.collect()) == list(range(40))


def test_parts_hold_every_image_once_and_few_files_at_a_time(spark, tmp_path, monkeypatch):
    """Decoded here or by the image source, an image is the same, under its own name."""
    monkeypatch.setattr(S, "SLICE", 3)
    made = odd_folder(tmp_path / "in dir")
    settings = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.hive.filesourcePartitionFileCacheSize")
    before = [spark.conf.get(k) for k in settings]
    parts = list(S.image_parts(spark, str(tmp_path / "in dir"), (".png",)))
    assert len(parts) == 3 and sum(len([f for f in p.inputFiles() if f.lower().endswith(".png")]) for p in parts) == 6
    assert [spark.conf.get(k) for k in settings] == before
    rows = [r for p in parts for r in p.collect()]
    got = {r.path.split("/in dir/")[1]: r for r in rows}
    assert len(rows) == len(got) and set(got) == set(made)
    for name, pixels in made.items():
        assert got[name].data == (pixels[:, :, ::-1] if pixels.shape[2] == 3 else pixels).ravel().tolist() and (got[name].height, got[name].width, got[name].channels, got[name].dtype) == (*pixels.shape, str(pixels.dtype))
    by_source = {r.path.split("/in dir/")[1]: r for r in S.pixels_of_8_bits(spark, str(tmp_path / "in dir"), (".png",)).collect()}
    assert all(by_source[n] == r for n, r in got.items() if not n.startswith("deep"))


def test_a_folder_is_preprocessed_in_parts(spark, tmp_path, monkeypatch):
    """All parts, under names as they were; a file of the last part that is no image leaves nothing."""
    from scanlake.operators.images import kernel

    monkeypatch.setattr(S, "SLICE", 2)
    made = odd_folder(tmp_path / "in")
    for channels in ("gray", "color"):
        S.preprocess_folder(spark, str(tmp_path / "in"), str(tmp_path / channels), (10, 12), channels=channels)
        assert {str(p.relative_to(tmp_path / channels)) for p in (tmp_path / channels).rglob("*") if p.is_file()} == {n.replace(".PNG", ".png") for n in made}
        for name, pixels in made.items():
            want = kernel(pixels[:, :, ::-1] if pixels.shape[2] == 3 else pixels, (10, 12), channels)
            got = S.decode_png((tmp_path / channels / name.replace(".PNG", ".png")).read_bytes())
            assert (got == want[:, :, ::-1]).all() if want.shape[2] == 3 else (got == want).all()
    (tmp_path / "in" / "z.jpg").write_text("no image")
    with pytest.raises(Exception, match="cannot read file:.*z.jpg"):
        S.preprocess_folder(spark, str(tmp_path / "in"), str(tmp_path / "none"))
    assert not [p for p in (tmp_path / "none").rglob("*") if p.is_file()]
    with pytest.raises(ValueError, match="no files with"):
        S.decoded_images(spark, str(tmp_path / "in"), (".bmp",))
