"""Photo files written by the test, read, decoded, resized, embedded."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from estatespark.config import RunConfig
from estatespark.operators import pixels, projections, sequences
from estatespark.plans import image_features
from estatespark.plans.network_inputs import photo_file_inputs, photo_pixel_inputs
from estatespark.sources import photos, sinks
from estatespark.verification.photos import drawn_photos


def png(array: np.ndarray) -> bytes:
    """(h, w, 3) red-green-blue or (h, w) grey."""
    height, width = array.shape[:2]
    kind = 2 if array.ndim == 3 else 0

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    lines = b"".join(b"\x00" + row.tobytes() for row in array.astype(np.uint8))
    header = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("photos")
    rng = np.random.default_rng(1)
    made = {}
    shapes = {("train", 7): [(10, 20), (20, 10), (9, 9)], ("train", 12): [(5, 33)], ("test", 12): [(8, 8)], ("test", 30): [(40, 8)]}
    for (split, listing), sizes in shapes.items():
        folder = root / split / f"ann_{listing}"
        folder.mkdir(parents=True)
        for i, (h, w) in enumerate(sizes):
            made[split, listing, f"{i}.jpg"] = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
            (folder / f"{i}.jpg").write_bytes(png(made[split, listing, f"{i}.jpg"]))
    grey = rng.integers(0, 256, (6, 6), dtype=np.uint8)
    (root / "test" / "ann_30" / "grey.jpg").write_bytes(png(grey))
    made["test", 30, "grey.jpg"] = np.repeat(grey[:, :, None], 3, axis=2)
    (root / "train" / "ann_7" / "broken.jpg").write_bytes(b"not a photo")
    (root / "train" / "ann_7" / "notes.txt").write_text("no photo")
    (root / "train" / "ann_99").mkdir()
    (root / "train" / "stray.jpg").write_bytes(png(grey))
    return str(root), made


def keyed(rows):
    return {(r["split"], r["listing_id"], r["name"]): r for r in rows}


def test_listing_files(spark, tree):
    root, made = tree
    found = keyed(photos.read_photos(spark, root).collect())
    assert set(found) == set(made) | {("train", 7, "broken.jpg")}
    with_bytes = photos.read_photos(spark, root, content=True)
    assert "content" in with_bytes.columns and "content" not in photos.read_photos(spark, root).columns


def test_sizes(spark, tree):
    root, made = tree
    found = keyed(photos.photo_dims(photos.decode_photos(spark, root)).collect())
    assert {k: (r["height"], r["width"]) for k, r in found.items()} == {k: a.shape[:2] for k, a in made.items()}
    assert found["test", 30, "grey.jpg"]["n_channels"] == 1
    wide = projections.width_filter(photos.photo_dims(photos.decode_photos(spark, root)), 33)
    assert [r["listing_id"] for r in wide.collect()] == [12]


def expected_cut(pixel, target):
    """Brings the shorter side to the target, keeps the middle: one output pixel at a time."""
    h, w = pixel.shape[:2]
    ratio = w / h
    nw, nh = (int(target * ratio), target) if ratio > 1 else (target, int(target / ratio))
    left, top = (target - nw) // 2, (target - nh) // 2
    out = np.zeros((target, target, 3))
    for y in range(target):
        for x in range(target):
            sy = min(max((y - top + 0.5) * h / nh - 0.5, 0), h - 1)
            sx = min(max((x - left + 0.5) * w / nw - 0.5, 0), w - 1)
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
            upper = pixel[y0, x0] * (1 - sx + x0) + pixel[y0, x1] * (sx - x0)
            lower = pixel[y1, x0] * (1 - sx + x0) + pixel[y1, x1] * (sx - x0)
            out[y, x] = upper * (1 - sy + y0) + lower * (sy - y0)
    return out


def test_resize_and_normalise(spark, tree, tmp_path):
    root, made = tree
    images = photos.decode_photos(spark, root)
    resized = pixels.resize_photos(images, 8)
    found = keyed(resized.collect())
    assert set(found) == set(made)
    for key, row in found.items():
        cut = np.array(row["pixels"]).reshape(8, 8, 3)
        assert np.abs(cut - expected_cut(made[key].astype(float), 8)).max() <= 0.5 + 1e-9
    scaled = keyed(pixels.resize_photos(images, 8, norm_image=True).collect())
    for key, row in scaled.items():
        plain = np.array(found[key]["pixels"]).reshape(8, 8, 3)
        expected = (plain / 255 - [0.485, 0.456, 0.406]) / [0.229, 0.224, 0.225]
        np.testing.assert_allclose(np.array(row["pixels"]).reshape(8, 8, 3), expected, atol=1e-6)
    sinks.write_resized_photos(resized.drop("path"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(made)


@pytest.mark.parametrize("at_once", [3, 1000])
def test_chosen_files_are_decoded_once(spark, tmp_path, at_once):
    rng, made = np.random.default_rng(3), {}
    names = ["00.jpg", "0 1.jpg", "0+2.jpg", "0%203.jpg", "x[1].jpg", "{y}.jpg", "é.jpg", "z.jpg", "zz.jpg"]
    for split, listing, count in (("train", 1, 9), ("train", 2, 2), ("test", 2, 3), ("test", 3, 7), ("train", 4, 3), ("test", 4, 2)):
        folder = tmp_path / split / f"ann_{listing}"
        folder.mkdir(parents=True)
        for name in names[:count]:
            # Listing 4 has nothing but broken files in its own split.
            broken = (listing == 1 and name in ("00.jpg", "x[1].jpg")) or (split, listing) == ("train", 4)
            (folder / name).write_bytes(b"no photo" if broken else png(rng.integers(0, 256, (6, 5, 3), dtype=np.uint8)))
            made[split, listing, name] = broken
    config = RunConfig(target_size=4, norm_image=False)
    expected = photo_pixel_inputs(photos.decode_photos(spark, str(tmp_path)).drop("path"), "train", config)
    found, counts = photo_file_inputs(spark, str(tmp_path), "train", config, at_once)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    good = {s + str(i): sum(1 for (t, j, _), b in made.items() if (t, j) == (s, i) and not b) for s, i, _ in made}
    chosen = min(6, good["train1"]) + good["train2"] + min(6, good["test3"]) + good["test4"]
    # Broken files are decoded too, as only that tells; the rest of the tree is left alone.
    assert counts["n_photos"] - counts["n_undecoded"] == chosen and counts["n_undecoded"] == 5
    assert chosen == 16 and sum(not b for b in made.values()) == 21


def test_no_photos_at_all(spark, tmp_path):
    (tmp_path / "train" / "ann_1").mkdir(parents=True)
    (tmp_path / "train" / "stray.jpg").write_bytes(b"x")
    found, counts = photo_file_inputs(spark, str(tmp_path), "train", RunConfig(target_size=4))
    assert found.count() == 0 and counts == {"n_photos": 0, "n_undecoded": 0}


@pytest.mark.parametrize("target", [None, 0, -1])
def test_stretch_without_target(spark, tree, target):
    root, _ = tree
    rows = pixels.resize_photos(photos.decode_photos(spark, root), target, (4, 6)).collect()
    assert {(r["height"], r["width"], len(r["pixels"])) for r in rows} == {(4, 6, 72)}


def test_pixel_inputs_from_files(spark, tree):
    root, made = tree
    images = photos.decode_photos(spark, root).select("listing_id", "split", "name", "height", "width", "n_channels", "data")
    rows = {r["listing_id"]: r for r in photo_pixel_inputs(images, "train", RunConfig(target_size=8)).collect()}
    train, test = ({i for s, i, _ in made if s == split} for split in ("train", "test"))
    assert set(rows) == train | test
    for listing, row in rows.items():
        split = "train" if listing in train else "test"
        count = min(6, sum(1 for s, i, _ in made if (s, i) == (split, listing)))
        assert row["mask"] == [1] * count + [0] * (6 - count)
        assert len(row["sequence"]) == 6 and all(len(p) == 8 * 8 * 3 for p in row["sequence"])
        assert all(set(p) == {0.0} for p in row["sequence"][count:]) and all(len(set(p)) > 1 for p in row["sequence"][:count])
    stretched = photo_pixel_inputs(images, "train", RunConfig(target_size=0, im_size=(4, 6), norm_image=False)).first()
    assert {len(p) for p in stretched["sequence"]} == {72}


def test_broken_photos_are_counted(spark, tree, tmp_path):
    root, made = tree
    broken = tmp_path / "photos" / "train" / "ann_99"
    broken.mkdir(parents=True)
    (broken / "x.jpg").write_bytes(b"no image")
    counted = Observation("broken")
    assert photos.decode_photos(spark, str(tmp_path / "photos"), counted).count() == 0
    assert counted.get == {"n_photos": 1, "n_undecoded": 1}


def test_geometry_of_odd_margins(spark):
    df = spark.createDataFrame([(300, 100), (100, 300), (171, 128), (50, 50)], "width int, height int")
    rows = pixels.with_geometry(df, 128).collect()
    assert [(r["new_width"], r["new_height"]) for r in rows] == [(384, 128), (128, 384), (171, 128), (128, 128)]
    # 128 - 171 = -43 is split into -22 and -21.
    assert (rows[2]["pad_left"], rows[2]["pad_right"]) == (-22, -21)
    assert all(r["pad_left"] <= 0 and r["pad_top"] <= 0 for r in rows)


def test_features_per_listing(spark, tree, tmp_path):
    root, made = tree
    path = str(tmp_path / "features")

    def loader():
        return lambda p: [p[:, :, 0].mean(), p[:, :, 2].max()]

    counts = image_features.extract_features(spark, root, path, loader)
    # The tree holds one file that is no image.
    assert counts == {"n_features": 2, "n_photos": len(made) + 1, "n_undecoded": 1}
    rows = {(r["split"], r["listing_id"]): r for r in spark.read.parquet(path).collect()}
    assert set(rows) == {(s, i) for s, i, _ in made}
    mine = [a for (s, i, _), a in made.items() if (s, i) == ("train", 7)]
    assert rows["train", 7]["image_feature_0"] == pytest.approx(np.mean([a[:, :, 0].mean() for a in mine]))
    assert rows["train", 7]["image_feature_1"] == pytest.approx(np.mean([a[:, :, 2].max() for a in mine]))
    assert len(pixels.colour_summary()(np.zeros((2, 2, 3), dtype=np.uint8))) == 30


def test_fallback_cap_and_padding(spark, tree):
    rows = [("train", 1, f"{i:02d}", float(i)) for i in range(9)] + [("test", 1, "x", 99.0), ("test", 2, "b", 5.0), ("test", 2, "a", 4.0)]
    df = spark.createDataFrame(rows, "split string, listing_id bigint, name string, v double")
    chosen = sequences.photo_fallback(df, "train")
    assert chosen.count() == 11
    first = sequences.first_photos(chosen, "name")
    padded = {r["listing_id"]: r for r in sequences.pad_sequences(first, "v", F.lit(0.0)).collect()}
    assert padded[1]["sequence"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and padded[1]["mask"] == [1] * 6
    assert padded[2]["sequence"] == [4.0, 5.0, 0.0, 0.0, 0.0, 0.0] and padded[2]["mask"] == [1, 1, 0, 0, 0, 0]


def test_a_hot_listing_is_capped_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("listing_id"), F.col("id").alias("name"))
    plan = sequences.first_photos(df, "name")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_photos_drawn_from_one_file_are_resized_in_many_tasks(spark, tmp_path):
    rows = [(i, i % 23) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey bigint, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    drawn = drawn_photos(spark, str(tmp_path))
    resized = pixels.resize_photos(drawn, 6)
    tasks = resized.select("photo_no", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.photo_no for r in tasks) == [i for i, _ in rows] and len({r.task for r in tasks}) > 1
    # Photos of one shape are resized together, with the same result as alone.
    together = {r.photo_no: r.pixels for r in resized.unionByName(resized).collect()}
    for row in drawn.collect():
        width, height = row.width, row.height
        pixel = np.array([[[(row.photo_no * 7 + x * 3 + y * 5 + (2 - c) * 11) % 256 for c in range(3)] for x in range(width)] for y in range(height)])
        assert np.abs(np.array(together[row.photo_no]).reshape(6, 6, 3) - expected_cut(pixel.astype(float), 6)).max() <= 0.5 + 1e-9
