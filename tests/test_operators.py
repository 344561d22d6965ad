"""Edge rows and invariants of single operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanlake.functions import labels, names, scores
from scanlake.operators import annotations, images, merges, models, ranks
from scanlake.sources import images as files
from scanlake.sources import tables
from scanlake.streaming import names as streams


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "name, group, safe",
    [("a_orig.png", "a", "a"), ("a_aug02.png", "a", "a"), ("a_aug002.png", "a_aug002", "a"), ("a_aug2.png", "a_aug2", "a"), ("a.b_orig.PNG", "a.b", "a.b"), ("orig.png", "orig", "orig"), (".png", ".png", ".png"), ("", "", "")],
)
def test_group_id(spark, name, group, safe):
    assert (one(spark, names.group_id(F.col("n")), n=name), one(spark, names.group_id(F.col("n"), "any"), n=name)) == (group, safe)


def test_path_functions(spark):
    p = F.col("p")
    assert one(spark, names.stage(p), p="/x/STAGE7b/stage1/f.png") == "STAGE7b"
    assert one(spark, names.stage(p), p="f.png") == "unknown"
    assert one(spark, names.session(p, "/r"), p="/r/s1/a/f.png") == "s1"
    assert one(spark, names.session(p, "/r/"), p="/r/f.png") == "unknown"
    assert one(spark, names.scan_timestamp(p), p="x2026-99-21_10-32-05-130y_2026-01-21_10-32-05-131") == "2026-99-21T10:32:05.130"
    assert one(spark, names.scan_timestamp(p), p="2026-01-21_10-32-05.png") == ""
    assert one(spark, names.clean_annotation_name(p), p="/u/2026-01-21_x.png") == "01-21_x.png"
    assert one(spark, names.clean_annotation_name(p, "^[0-9a-f]{6}-"), p="/u/2026-01-21_x.png") == "2026-01-21_x.png"
    assert one(spark, names.suffix(p), p="a.TAR.GZ") == ".gz"


def test_label_rules(spark):
    rows = [(1, 0, 1), (1, 1, 0), (1, 1, 1), (0, 0, 1), (None, None, None)]
    df = spark.createDataFrame(rows, "no_contraband int, isolated_items int, empty int")
    got = df.select(labels.rule_combo(), labels.rule_empty(), labels.rule_contraband()).collect()
    assert [tuple(r) for r in got] == [(0, 1, 0), (1, 0, 0), (None, 1, 0), (None, 1, 1), (None, 0, 1)]


def test_split_sizes_are_exact_and_order_free(spark):
    for n in (0, 1, 2, 7, 250):
        df = spark.range(n).select(F.concat(F.lit("k"), "id").alias("k"))
        out = ranks.split_rows(df, "k", (0.8, 0.1, 0.1), "round")
        sizes = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
        assert sum(sizes.values()) == n and sizes.get("train", 0) == round(n * 0.8)
        again = ranks.split_rows(df.orderBy(F.desc("k")).repartition(3), "k", (0.8, 0.1, 0.1), "round")
        assert sorted(out.select("k", "split").collect()) == sorted(again.select("k", "split").collect())
    with pytest.raises(ValueError):
        ranks.cut(0.5, 0.1, 0.1, "floor")


def test_rank_is_a_permutation_without_one_task(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    out = ranks.seeded_rank(df, "k")
    assert out.agg(F.countDistinct("rank"), F.min("rank"), F.max("rank")).first() == (5000, 1, 5000)


def test_groups_stay_whole(spark):
    df = spark.range(300).select("id", F.concat(F.lit("g"), F.floor(F.col("id") / 7)).alias("g"))
    out = ranks.split_groups(df, "g", (0.85, 0.1, 0.05))
    assert out.count() == 300 and out.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_last_wins_and_merge(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("b", 1, "y")], "k string, o int, v string")
    assert sorted(map(tuple, merges.last_wins(df, ["k"], "o").collect())) == [("a", 3, None), ("b", 1, "y")]
    merged, skipped = merges.merge_skipping(df.filter("k = 'a'"), df, ["k"])
    assert merged.count() == 4 and skipped.count() == 3


def test_no_nested_loop_in_matching(spark):
    a = spark.createDataFrame([(1, "/x/f.png"), (2, "/y/f.png")], "image_id int, filepath string")
    t = spark.createDataFrame([("/x/f.png", "f.png"), ("/z/f.png", "f.png"), ("/z/g.png", "g.png")], "p string, name string")
    out = merges.matched(t, a, F.col("p"), F.col("name"))
    assert sorted((r.p, r.image_id) for r in out.collect()) == [("/x/f.png", 1), ("/z/f.png", 2), ("/z/g.png", None)]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("value, label", [('[["a","b"],["c"]]', ["b"]), ('["x","y"]', ["y"]), ("[]", []), ("[[]]", []), ("[1]", []), (None, [])])
def test_taxonomy(spark, value, label):
    text = '{"other": 1}' if value is None else f'{{"taxonomy": {value}}}'
    assert one(spark, annotations.taxonomy_label(F.col("j")), j=text) == label


def test_first_sighting_keeps_its_null(spark):
    rows = [(1, 0, 0, 0, "b", None), (1, 0, 1, 0, "a", 0.5), (1, 0, 2, 0, "b", 0.9)]
    df = spark.createDataFrame(rows, "task int, a int, r int, i int, label string, confidence double")
    assert sorted((r.first, r.label, r.confidence) for r in annotations.ordered_distinct(df).collect()) == [((0, 0, 0), "b", None), ((0, 1, 0), "a", 0.5)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=2, max_size=6))
def test_softmax_sums_to_one(spark, z):
    p = spark.createDataFrame([(z,)], "z array<double>").select(scores.softmax(F.col("z")).alias("p"), scores.cross_entropy(F.col("z"), F.lit(0)).alias("ce")).first()
    assert abs(sum(p.p) - 1) < 1e-9 and abs(p.ce + np.log(max(p.p[0], 1e-300))) < 1e-6


def picture(seed, shape, kind):
    return np.random.default_rng(seed).integers(0, np.iinfo(kind).max, shape, dtype=kind)


def test_png_round_trip(spark, tmp_path):
    made = {"a.png": picture(1, (5, 7), np.uint8), "b.PNG": picture(2, (4, 3, 3), np.uint8), "c.png": picture(3, (6, 6), np.uint16)}
    (tmp_path / "sub").mkdir()
    for name, pixels in made.items():
        (tmp_path / "sub" / name).write_bytes(files.encode_png(pixels))
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "bad.png").write_bytes(b"not an image")
    found = files.scan_files(spark, str(tmp_path), names.FINALIZE_EXTENSIONS)
    assert found.count() == 4 and files.scan_files(spark, str(tmp_path), names.FINALIZE_EXTENSIONS, recursive=False).count() == 1
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).filter(names.has_extension(F.col("path"), (".png",)))
    with pytest.raises(Exception, match="bad.png"):
        files.decoded(content).collect()
    got = {r.path.rsplit("/", 1)[1]: r for r in files.decoded(content, on_bad="null").collect()}
    assert got["bad.png"].data is None
    for name, pixels in made.items():
        assert got[name].data == pixels.reshape(-1).astype(int).tolist() and got[name].dtype == str(pixels.dtype)
    heads = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.channels, r.dtype) for r in content.select("path", *files.header(F.col("content"))).collect()}
    assert heads["a.png"] == (7, 5, 1, "uint8") and heads["b.PNG"] == (3, 4, 3, "uint8") and heads["c.png"] == (6, 6, 1, "uint16")


def coded_rows(pixels, kinds):
    """PNG filters applied byte by byte, as their definition has it."""
    h, w, step = pixels.shape
    out = np.zeros_like(pixels)
    for y in range(h):
        for x in range(w):
            for i in range(step):
                a, b, c = (int(pixels[y, x - 1, i]) if x else 0), (int(pixels[y - 1, x, i]) if y else 0), (int(pixels[y - 1, x - 1, i]) if x and y else 0)
                guess = [0, a, b, (a + b) // 2, min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]][kinds[y]]
                out[y, x, i] = (int(pixels[y, x, i]) - guess) % 256
    return out


@pytest.mark.parametrize("kinds", [[0, 1, 2, 1, 2, 2, 0], [4, 3, 2, 1, 0, 4, 3], [3, 3, 4, 4, 4, 1, 2], [2] * 7])
def test_filtered_png_rows(kinds):
    for shape in ((7, 5, 3), (7, 1, 1), (7, 12, 2)):
        pixels = picture(sum(kinds), shape, np.uint8)
        assert (files.unfiltered(np.array(kinds), coded_rows(pixels, kinds)) == pixels).all()


def test_pixel_table_equals_kernel(spark):
    """Images of several sizes in one table, each as the kernel has it."""
    pictures = {1: picture(4, (6, 9), np.uint8), 2: picture(5, (3, 4), np.uint8), 3: picture(6, (7, 5), np.uint8), 4: picture(7, (1, 1), np.uint8)}
    rows = [(k, y, x, 0, int(v)) for k, p in pictures.items() for (y, x), v in np.ndenumerate(p)]
    df = spark.createDataFrame(rows, "vec_id int, y int, x int, c int, v int").repartition(3)
    small = images.resize_area(df, (3, 4)).withColumn("v", images.whole(F.col("v")))
    got = {(r.vec_id, r.y, r.x): r.v for r in images.median3(small).collect()}
    want = {k: images.kernel(p[:, :, None], (3, 4)) for k, p in pictures.items()}
    assert got == {(k, y, x): int(w[y, x, 0]) for k, w in want.items() for y in range(3) for x in range(4)}
    alone = {(r.vec_id, r.y, r.x): r.v for r in images.median3(df).collect()}
    assert alone == {(k, y, x): int(v) for k, p in pictures.items() for (y, x, _), v in np.ndenumerate(images.median(p[:, :, None]))}
    with pytest.raises(Exception, match="pixels"):
        images.median3(df.filter("not (vec_id = 1 and y = 2 and x = 2)")).collect()


def test_bilinear_cells_of_any_size(spark):
    for source, target in ((8, 5), (4, 8), (1, 3), (7, 7), (3, 11), (9, 2)):
        line = np.arange(source) ** 2 + 1.0
        df = spark.createDataFrame([(1, 0, x, 0, float(v)) for x, v in enumerate(line)], "vec_id int, y int, x int, c int, v double")
        got = {r.x: r.v for r in images.resize_bilinear(df, (1, target)).collect()}
        at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
        assert np.allclose([got[t] for t in range(target)], np.interp(at, np.arange(source), line))


def test_resizing_at_unequal_ratios(spark):
    """Every cell by its definition, for images of several shapes and channels in one table."""
    pictures = {"a": picture(1, (6, 9, 1), np.uint8), "b": picture(2, (3, 4, 3), np.uint8), "c": picture(3, (2, 11, 1), np.uint8)}
    rows = [(k, y, x, c, int(v)) for k, p in pictures.items() for (y, x, c), v in np.ndenumerate(p)]
    df = spark.createDataFrame(rows, "name string, y int, x int, c int, v int").repartition(5)
    share = lambda t, s, n, m: max(0.0, min((t + 1) * n / m, s + 1) - max(t * n / m, s)) * m / n
    near = lambda t, s, n, m: max(0.0, 1 - abs(min(max((t + 0.5) * n / m - 0.5, 0), n - 1) - s))
    for resize, weight in ((images.resize_area, share), (images.resize_area_by_pixel, share), (images.resize_bilinear, near)):
        for ty, tx in ((4, 5), (7, 2)):
            got = {(r.name, r.y, r.x, r.c): r.v for r in resize(df, (ty, tx), "name").collect()}
            assert len(got) == ty * tx * 5
            for (k, y, x, c), v in got.items():
                h, w, _ = pictures[k].shape
                assert abs(v - sum(weight(y, a, h, ty) * weight(x, b, w, tx) * int(pictures[k][a, b, c]) for a in range(h) for b in range(w))) < 1e-9
    with pytest.raises(Exception, match="lacks pixels"):
        images.resize_area(df.filter("not (name = 'a' and y = 2 and x = 2)"), (2, 2), "name").collect()


def test_color_and_depth_pass_through(spark):
    rows = [(1, 0, 0, 0, 5), *[(2, 0, 0, c, 10 + c) for c in range(3)]]
    df = spark.createDataFrame(rows, "vec_id int, y int, x int, c int, v int")
    assert sorted((r.vec_id, r.c, r.v) for r in images.to_color(df).collect()) == [(1, 0, 5), (1, 1, 5), (1, 2, 5), (2, 0, 10), (2, 1, 11), (2, 2, 12)]
    depth = spark.createDataFrame([(1, 0, 0, 0, 7, "uint8"), (2, 0, 0, 0, 0, "uint16"), (2, 0, 1, 0, 9, "uint16")], "vec_id int, y int, x int, c int, v int, dtype string")
    assert sorted((r.vec_id, r.x, r.v) for r in images.normalize_depth(depth).collect()) == [(1, 0, 7), (2, 0, 0), (2, 1, 65534)]


def test_preprocess_applies_a_transform(spark):
    df = spark.createDataFrame([("a", 2, 2, 1, "uint8", [1, 2, 3, 4]), ("b", 1, 3, 1, "uint8", [5, 6, 7])], "path string, height int, width int, channels int, dtype string, data array<int>")
    got = {r.path: (r.height, r.width, r.data) for r in images.preprocess(df, None, denoise=False, transform=lambda x: x[:, ::-1] * 2).collect()}
    assert got == {"a": (2, 2, [4, 2, 8, 6]), "b": (1, 3, [14, 12, 10])}


def test_files_are_written_and_scanned(spark, tmp_path):
    root = str(tmp_path / "png")
    eight, sixteen = picture(1, (4, 6), np.uint8), picture(2, (5, 3), np.uint16)
    df = spark.createDataFrame([("/in/a.png", files.encode_png(eight)), ("/in/b.png", files.encode_png(sixteen)), ("/c.txt", b"text")], "path string, content binary")
    assert files.write_files(df, root).count() == 3
    with pytest.raises(ValueError, match="no files"):
        files.scan_files(spark, root, (".bmp",))
    found = files.scan_files(spark, root, (".png", ".txt"), content=True)
    heads = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.channels, r.dtype) for r in found.select("path", *files.header(F.col("content"))).collect()}
    assert heads == {"a.png": (6, 4, 1, "uint8"), "b.png": (3, 5, 1, "uint16"), "c.txt": (None, None, None, None)}
    by_source = {r.path.rsplit("/", 1)[1]: r for r in files.pixels_of_8_bits(spark, root).collect()}
    assert by_source["a.png"].data == eight.ravel().tolist() and by_source["a.png"].height == 4
    decoded = {r.path.rsplit("/", 1)[1]: r.data for r in files.decoded(found, on_bad="null").collect()}
    assert decoded["b.png"] == sixteen.ravel().tolist() and decoded["c.txt"] is None


INDENTED = """[
    {
        "image": "a.png",
        "no_contraband": 1,
        "isolated_items": 0,
        "empty": 1
    },
    {
        "image": "b.png",
        "no_contraband": 1,
        "isolated_items": 1,
        "overlapping_items": 0,
        "empty": 0
    }
]
"""


def test_indented_documents(spark, tmp_path):
    (tmp_path / "val.json").write_text(INDENTED)
    (tmp_path / "cut.json").write_text(INDENTED[:180])
    got = tables.label_list(spark, str(tmp_path / "val.json")).collect()
    assert [(r.image, r.isolated_items, r.overlapping_items) for r in got] == [("a.png", 0, None), ("b.png", 1, 0)]
    assert [(r.image, r.class_id) for r in tables.label_json(spark, str(tmp_path / "val.json"), labels.rule_combo).collect()] == [("a.png", 0), ("b.png", 1)]
    for read in (lambda p: tables.label_list(spark, p), lambda p: tables.label_json(spark, p, labels.rule_empty)):
        with pytest.raises(Exception, match="(?i)malformed|broken labels in .*cut.json"):
            read(str(tmp_path / "cut.json")).collect()
    (tmp_path / "tasks.json").write_text('[\n {"id": 1, "data": {"image": "/x/a.png"},\n "annotations": [{"result": []}]},\n {"id": 2, "data": {}}\n]')
    assert tables.annotation_tasks(spark, str(tmp_path / "tasks.json"), "id long").count() == 1
    (tmp_path / "manifest.json").write_text('{\n "labels": ["x", "y"],\n "samples": ["1"]\n}')
    assert tables.manifest(spark, str(tmp_path / "manifest.json")).first().labels == ["x", "y"]
    (tmp_path / "coco.json").write_text('{\n "images": [{"id": 1, "file_name": "a"}],\n "categories": [],\n "annotations": [\n {"id": 5, "image_id": 1, "category_id": 2}]\n}')
    assert tables.coco_documents(spark, str(tmp_path / "coco.json")).first().annotations[0].category_id == 2
    (tmp_path / "lines.json").write_text('{"image": "a.png", "empty": 1}\n{"image": "b.png"}\n')
    assert tables.label_list(spark, str(tmp_path / "lines.json"), lines=True).count() == 2


def test_the_last_document_wins(spark, tmp_path):
    """An id that a later document has at a smaller place."""
    (tmp_path / "a.json").write_text('{"images": [{"id": 9, "file_name": "x"}, {"id": 1, "file_name": "old"}], "categories": [{"id": 3, "name": "c"}], "annotations": []}')
    (tmp_path / "b.json").write_text('{"images": [{"id": 1, "file_name": "new"}], "categories": [], "annotations": [{"id": 5, "image_id": 1, "category_id": 3}]}')
    documents = tables.coco_documents(spark, str(tmp_path))
    found, categories, marks = annotations.coco_relations(documents)
    assert {r.id: r.file_name for r in found.collect()} == {9: "x", 1: "new"} and categories.count() == marks.count() == 1
    assert marks.columns == ["pos", "id", "image_id", "category_id"]
    with pytest.raises(ValueError, match="several detection documents"):
        annotations.coco_relations(documents.drop("document"))
    (tmp_path / "c.json").write_text("\n".join('{"images": [{"id": 1, "file_name": "%d"}], "categories": [], "annotations": []}' % i for i in range(50)))
    assert annotations.coco_relations(tables.coco_documents(spark, str(tmp_path / "c.json"), lines=True))[0].first().file_name == "49"


def test_contradicting_labels(spark):
    rows = spark.createDataFrame([("a", 1, 0, 1), ("b", 1, 1, 1)], "image string, no_contraband int, isolated_items int, empty int")
    good, bad = labels.consistent(rows, labels.rule_combo, "quarantine")
    assert [r.image for r in good.collect()] == ["a"] and [r.image for r in bad.collect()] == ["b"]
    with pytest.raises(Exception, match="inconsistent labels"):
        labels.consistent(rows, labels.rule_combo)[0].collect()


def test_empty_split_raises(spark):
    index = spark.createDataFrame([("images/val/a.png", "val")], "filepath string, split string")
    assert merges.in_split(index, "val").count() == 1 and merges.in_split(index, "test", empty="allow").count() == 0
    with pytest.raises(ValueError, match="split test"):
        merges.in_split(index, "test")


def test_exact_median_and_ranks_within(spark):
    rnd = np.random.default_rng(8)
    for values in ([3.0], [1.0, 2.0], [5.0] * 9, list(rnd.random(2001)), [*rnd.random(3000), 1e9, -1e9], [1.0] * 50 + [2.0] * 50, [10.0**k for k in range(-300, 300)], [*rnd.random(900), *[np.inf] * 80], [*[-np.inf] * 700, *rnd.random(699)],
                   [-1.7e308, *rnd.random(800) * 1e308, 1.7e308], [np.inf] * 90, [*[np.nan] * 50, *range(40)]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        want = np.sort([v for v in values if not np.isnan(v)])
        assert ranks.exact_median(df, "v", most=16, accuracy=50) == (want[(len(want) - 1) // 2] + want[len(want) // 2]) / 2
    assert ranks.exact_median(spark.createDataFrame([(float(v),) for v in [*rnd.random(5000), np.inf]], "v double"), "v") < 1
    assert ranks.exact_median(spark.createDataFrame([], "v double"), "v") is None
    rows = [(int(u), int(t)) for u, t in zip([7] * 500 + list(rnd.integers(0, 5, 100)), rnd.permutation(600), strict=True)]
    got = ranks.ranked_within(spark.createDataFrame(rows, "u int, t int"), "u", F.floor(F.col("t") / 50), "t").collect()
    order = {}
    for u, t in sorted(rows):
        order.setdefault(u, []).append(t)
    assert all(order[r.u][r.i - 1] == r.t and r.n == len(order[r.u]) for r in got) and len(got) == 600


def test_rank_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET", 1)
    df = spark.range(700).withColumnRenamed("id", "k")
    many = {r.k: r["rank"] for r in ranks.seeded_rank(df, "k").collect()}
    monkeypatch.setattr(ranks, "BUCKET", 1 << 20)
    assert many == {r.k: r["rank"] for r in ranks.seeded_rank(df, "k").collect()} and sorted(many.values()) == list(range(1, 701))


def test_readers_guard(spark, tmp_path):
    (tmp_path / "m.csv").write_text("filename,other\na.png,1\n")
    (tmp_path / "e.csv").write_text("filepath\n")
    (tmp_path / "l.json").write_text('"text"')
    with pytest.raises(ValueError, match="has_contraband"):
        tables.metadata_csv(spark, str(tmp_path / "m.csv"))
    with pytest.raises(ValueError, match="index"):
        tables.index_csv(spark, str(tmp_path / "e.csv"))
    with pytest.raises(Exception, match="list or object"):
        tables.label_json(spark, str(tmp_path / "l.json"), labels.rule_empty).collect()
    assert tables.label_list(spark, str(tmp_path / "none.json"), missing="empty").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.label_list(spark, str(tmp_path / "none.json"))


def test_warm_start_keeps_layers(spark):
    df = spark.createDataFrame([([0.0, 1.0], 0.0), ([1.0, 0.0], 1.0)] * 20, "values array<double>, label double")
    first = models.fit_perceptron(df, [2, 3, 2], iterations=5)
    second = models.fit_perceptron(df, [2, 3, 2], previous=first, iterations=5)
    assert len(second.weights) == len(first.weights)
    assert models.score(models.fit_classifier(df), df, "label").filter("pred <> label").count() == 0


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in" / "Stage1"
    folder.mkdir(parents=True)
    for n in ("2026-01-21_10-32-05-130_aug01.png", "x.txt"):
        (folder / n).write_bytes(b"1")
    rows = streams.indexed(streams.new_files(spark, str(tmp_path / "in")), F.lit("train"))
    q = rows.writeStream.format("memory").queryName("indexed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    got = spark.table("indexed").collect()
    assert [(r.filename, r.group_id, r.stage, r.scan_timestamp) for r in got] == [("2026-01-21_10-32-05-130_aug01.png", "2026-01-21_10-32-05-130", "Stage1", "2026-01-21T10:32:05.130")]


def test_null_keys_are_ranked_last_and_spread(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET", 1)
    rows = [(i if i % 3 else None, f"v{i}") for i in range(300)]
    df = spark.createDataFrame([*rows, (None, "v0")], "k long, v string")
    out = ranks.seeded_rank(df.repartition(5), "k", ties=("v",))
    got = [(r["rank"], r.k, r.v, r.total) for r in out.collect()]
    assert sorted(x[0] for x in got) == list(range(1, 302)) and {x[3] for x in got} == {301}
    assert {x[0] for x in got if x[1] is None} == set(range(201, 302))
    again = {(r["rank"], r.k, r.v) for r in ranks.seeded_rank(df.coalesce(1), "k", ties=("v",)).collect()}
    assert again == {x[:3] for x in got}
    plain = ranks.seeded_rank(df, "k").collect()
    assert sorted(r["rank"] for r in plain) == list(range(1, 302)) and {r["rank"] for r in plain if r.k is None} == set(range(201, 302))
