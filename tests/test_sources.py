"""Trees, images that a table names, and published tables."""

import json
import os
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.paths import CLASSES, EXTENSIONS
from cairn.sources import images, publication, split_images, trees


def filtered(kind, line, above, step):
    left, corner = np.zeros_like(line), np.zeros_like(line)
    left[step:], corner[step:] = line[:-step], above[:-step]
    guess = {0: 0, 1: left, 2: above, 3: ((left.astype(int) + above) // 2).astype(np.uint8)}.get(kind)
    if kind == 4:
        p = left.astype(int) + above - corner
        far = [np.abs(p - x) for x in (left, above, corner)]
        guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
    return bytes([kind]) + (line - guess).astype(np.uint8).tobytes()


def png(path, block, color=None, palette=None, depth=8):
    """Writes a PNG whose lines use all five filters in turn."""
    h, w, c = block.shape
    color = {1: 0, 2: 4, 3: 2, 4: 6}[c] if color is None else color
    rows = block.reshape(h, -1).astype(np.uint8)
    if depth < 8:
        bits = np.unpackbits(rows[..., None], axis=2)[..., 8 - depth :].reshape(h, -1)
        rows = np.packbits(bits, axis=1)
    step, above, raw = max(1, c * depth // 8), np.zeros(rows.shape[1], np.uint8), b""
    for y in range(h):
        raw += filtered(y % 5, rows[y], above, step)
        above = rows[y]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(raw)
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0))
    body += chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + body + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b""))


@pytest.fixture
def tree(tmp_path):
    rng = np.random.default_rng(2)
    root = tmp_path / "raw"
    shapes = {"Normal/P 1/a/A.PNG": (7, 5, 1), "Normal/P2/_e.png": (6, 9, 3), "Sick/P3/.d.png": (11, 4, 4), "Sick/P3/_hid/.deep/c.png": (5, 5, 2), "Sick/P4/é,\"x.png": (8, 3, 1)}
    for name, shape in shapes.items():
        png(root / name, rng.integers(0, 256, shape))
    for name in ("Sick/top.png", "Other/P9/d.png", "Normal/P 1/note.txt", "Normal/P 1/.jpg"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    (root / "Sick/P3/linked").symlink_to(root / "Normal")
    (root / "Sick/P4/file.png").symlink_to(root / "Normal/P2/_e.png")
    return root


def test_scan_equals_a_recursive_search(spark, tree):
    expected = set()
    for name in CLASSES:
        for patient in (tree / name).iterdir():
            if patient.is_dir():
                found = [Path(d) / n for d, _, names in os.walk(patient) for n in names]
                expected |= {(f"{name}/{patient.name}", name, str(p)) for p in found if p.is_file() and p.suffix.lower() in EXTENSIONS}
    scan = images.scan_images(spark, f"file://{tree}/")
    assert {tuple(r) for r in scan.collect()} == expected and len(expected) == 6 and scan.count() == 6
    assert "FileScan" not in scan._jdf.queryExecution().toString()
    assert images.scan_images(spark, str(tree / "none")).isEmpty()
    sizes = trees.files_below(spark, [str(tree / "Normal")], spread=3)
    assert {r.path: r.size for r in sizes.collect()} == {str(p): p.stat().st_size for p in (tree / "Normal").rglob("*") if p.is_file()}
    wide = tree / "Normal/P5"
    wide.mkdir()
    for i in range(25):
        (wide / f"{i}.txt").write_text("x" * i)
    assert trees.files_below(spark, [str(wide)]).agg(F.count("*"), F.sum("size")).first()[:] == (25, 300)


def test_images_of_a_split_alone(spark, tree, tmp_path):
    rows = images.scan_images(spark, str(tree)).withColumn("split", F.when(F.col("patient_id") == "Normal/P 1", "test").otherwise("train"))
    images.write_splits(rows, str(tmp_path / "splits"))
    (tree / "Normal/P 1/a/A.PNG").write_bytes(b"not read")
    train = images.read_split(spark, f"{tmp_path}/splits/split=train")
    for size in (1 << 18, 40):  # lines longer than a range belong to the range they begin in
        found = split_images.read_split_images(spark, f"{tmp_path}/splits/split=train", bytes_a_partition=size)
        got = {r.image_path: r for r in found.collect()}
        assert len(got) == found.count() == train.count() == 5
    seen = [str(p) for p in tree.rglob("*.png") if p.name != "top.png" and p.read_bytes()[:4] == b"\x89PNG" and not p.is_symlink()]
    whole = {r.image_path: r for r in images.decode_images(spark, str(tree / "Normal/P2")).union(images.decode_images(spark, str(tree / "Sick/P4"))).collect()}
    plain = {p: split_images.decoded_png(Path(p).read_bytes()) for p in seen}
    for path, r in got.items():
        assert (r["class"], r.patient_id) == tuple(Path(path).relative_to(tree).parts[:1]) + ("/".join(Path(path).relative_to(tree).parts[:2]),)
        if path in plain:
            assert (r.h, r.w, r.c, r.pixels) == (*plain[path][:3], plain[path][3].tolist())
        if path in whole:
            assert (r.h, r.w, r.c, r.pixels) == tuple(whole[path])[1:]
    with pytest.raises(Exception, match=r"A\.PNG can't be decoded"):
        split_images.read_split_images(spark, f"{tmp_path}/splits/split=test").collect()
    os.remove(tree / "Sick/P3/.d.png")
    with pytest.raises(Exception, match=r"\.d\.png, named in"):
        split_images.read_split_images(spark, f"{tmp_path}/splits/split=train").collect()


def test_split_images_need_a_table(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFound|none"):
        split_images.read_split_images(spark, str(tmp_path / "none")).collect()
    (tmp_path / "bad.csv").write_text("patient_id,image_path\na,b\n")
    with pytest.raises(Exception, match="missing columns"):
        split_images.read_split_images(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "empty.csv").write_text("patient_id,class,image_path\n")
    assert split_images.read_split_images(spark, str(tmp_path / "empty.csv")).count() == 0
    png(tmp_path / "pictures/x.png", np.full((2, 2, 1), 9))
    (tmp_path / "one.csv").write_text("class,patient_id,image_path\nSick,Sick/P,pictures/x.png\n")
    assert split_images.read_split_images(spark, str(tmp_path / "one.csv"), root=str(tmp_path)).first().pixels == [9] * 4


@pytest.mark.parametrize("kind", ["gray", "rgb", "rgba", "gray alpha", "palette", "one bit", "four bits"])
def test_png_equals_spark_s_decoder(spark, tmp_path, kind):
    rng = np.random.default_rng(len(kind))
    block = {"gray": (9, 6, 1), "rgb": (9, 6, 3), "rgba": (9, 6, 4), "gray alpha": (9, 6, 2)}.get(kind, (9, 7, 1))
    options, top = {}, 256
    if kind == "palette":
        options, top = {"color": 3, "palette": rng.integers(0, 256, (16, 3))}, 16
    elif kind in ("one bit", "four bits"):
        options = {"depth": 1 if kind == "one bit" else 4}
        top = 1 << options["depth"]
    data = rng.integers(0, top, block)
    png(tmp_path / "x/p.png", data, **options)
    h, w, c, pixels = split_images.decoded_png((tmp_path / "x/p.png").read_bytes())
    if kind not in ("gray alpha", "one bit", "four bits"):  # whose samples the JVM's decoder doesn't scale or converts
        r = images.decode_images(spark, str(tmp_path / "x")).first()
        assert (r.h, r.w, r.c, r.pixels) == (h, w, c, pixels.tolist())
    elif kind == "gray alpha":
        assert pixels.tolist() == data[..., 0].ravel().tolist()
    else:
        assert pixels.tolist() == (data * (255 // (top - 1))).ravel().tolist()


# Published tables


def fold_rows(spark):
    rows = [(f"fold_{f:02d}", s, f"P/{i}", f'a "b",{i}\\n.png' if i % 3 else None, i, [1.5, float(i)], "") for f in (1, 2) for s in ("train", "test") for i in range(20)]
    return spark.createDataFrame(rows, "fold string, split string, patient_id string, image_path string, n int, x array<double>, empty string")


def same(a, b):
    assert a.columns == b.columns or set(a.columns) == set(b.columns)
    assert sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(a.columns)).collect()))


def test_published_tables_come_back_whole(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/out", fold_rows(spark)
    tables = {"csv": publication.Table(rows.drop("x"), "csv", ("fold", "split"), ("image_path",)), "json": publication.Table(rows, "json", ("fold",)), "parquet": publication.Table(rows, "parquet")}
    assert publication.publish(spark, folder, tables | {"none": publication.Table(rows.limit(0), "parquet")}) == 1
    for name, t in tables.items():
        same(publication.published(spark, folder, name, check=True), t.rows)
    assert publication.published(spark, folder, "none").count() == 0
    names = {p.parent.relative_to(tmp_path).as_posix().split("/csv/")[1] for p in tmp_path.rglob("csv/**/part-*.csv")}
    assert names == {f"fold=fold_{f:02d}/split={s}" for f in (1, 2) for s in ("train", "test")}
    one = spark.read.option("header", True).option("escape", '"').csv(next(iter({str(p) for p in tmp_path.rglob("csv/fold=fold_01/split=test/part-*")})))
    listed = [r.image_path for r in one.collect()]
    assert listed == sorted(listed, key=lambda p: (p is not None, p or ""))
    with pytest.raises(FileNotFoundError, match="no published other"):
        publication.published(spark, folder, "other")
    with pytest.raises(FileNotFoundError):
        publication.published(spark, f"file://{tmp_path}/nothing", "csv")


def test_a_publication_cut_short_shows_nothing(spark, tmp_path, monkeypatch):
    folder, rows = f"file://{tmp_path}/out", fold_rows(spark).drop("x")
    first = rows.where("n < 5")
    publication.publish(spark, folder, {"t": publication.Table(first)})
    real = publication.counted
    monkeypatch.setattr(publication, "counted", lambda table: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        publication.publish(spark, folder, {"t": publication.Table(rows)})
    monkeypatch.setattr(publication, "counted", real)
    same(publication.published(spark, folder, "t"), first)
    assert publication.publish(spark, folder, {"t": publication.Table(rows)}) == 2
    same(publication.published(spark, folder, "t", check=True), rows)
    same(publication.published(spark, folder, "t", version=1, check=True), first)
    file = next(p for p in tmp_path.rglob("data/000002*/t/part-*.csv"))
    file.write_text(file.read_text().replace("P/7", "P/8"))
    (file.parent / f".{file.name}.crc").unlink()
    with pytest.raises(ValueError, match="as published"):
        publication.published(spark, folder, "t", check=True)


def test_folds_summary_is_a_json_list(spark, tmp_path):
    summary = spark.createDataFrame([("fold_02", 3, None), ("fold_01", 5, 1)], "fold string, n_train_patients int, n_val_images int")
    publication.publish_folds(spark, str(tmp_path), fold_rows(spark).drop("x"), summary)
    value = publication.published(spark, str(tmp_path), "folds_summary").first().value
    assert json.loads(value) == [{"fold": "fold_01", "n_train_patients": 5, "n_val_images": 1}, {"fold": "fold_02", "n_train_patients": 3, "n_val_images": None}]


def test_folds_move_each_image_once(spark, tmp_path):
    images = spark.createDataFrame([(f"P/{i % 7}", "Sick", f"P/{i % 7}/{i}.png") for i in range(50)] + [("P/none", "Sick", "x.png")], "patient_id string, class string, image_path string")
    deal = [(f"fold_{f:02d}", f"P/{p}", "test" if p == f else "train") for f in (1, 2, 3) for p in range(7)]
    assigned = spark.createDataFrame(deal, "fold string, patient_id string, split string")
    summary = spark.createDataFrame([("fold_01", 1)], "fold string, n int")
    publication.publish_folds(spark, f"file://{tmp_path}", images, summary, assigned)
    found = publication.published(spark, f"file://{tmp_path}", "folds", check=True)
    assert found.columns == ["patient_id", "class", "image_path", "fold", "split"]
    same(found, images.join(assigned, "patient_id").select(*found.columns))
    files = sorted(tmp_path.rglob("folds/fold=*/split=*/part-*"))
    assert {p.suffix for p in files} == {".gz"}
    for folder in {p.parent for p in files}:
        reader = split_images.SplitImagesReader({"path": str(folder), "bytes": "100"})
        rows = [r for part in reader.partitions() for r in reader.lines(*part.value)]
        _, fold, split = (x.split("=")[-1] for x in folder.parts[-3:])
        assert sorted(r["image_path"] for r in rows) == sorted(r.image_path for r in found.where(f"fold = '{fold}' and split = '{split}'").collect())
    listed = [r["image_path"] for r in split_images.SplitImagesReader.lines(str(files[0]), 0, 10**6)]
    assert listed == sorted(listed)
