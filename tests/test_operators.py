import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.functions import probability as pr
from cairn.operators import balance, head, history, losses, metrics, pixels, positions, scoring, splits, threshold
from cairn.sources import images


def patients(spark, counts):
    return spark.createDataFrame([(f"{c}/{i}", c) for c, n in counts.items() for i in range(n)], "patient_id string, class string")


@pytest.mark.parametrize(("counts", "seed"), [({"Normal": 40, "Sick": 17}, 1), ({"Normal": 7, "Sick": 13}, 2), ({"A": 33, "B": 11, "C": 12}, 42)])
def test_split_is_exact_disjoint_and_independent_of_partitions(spark, counts, seed):
    table = patients(spark, counts)
    found = [{r.patient_id: r.split for r in splits.stratified_split(table.repartition(n), 0.6, 0.2, 0.2, seed=seed).collect()} for n in (1, 4, 17)]
    assert found[0] == found[1] == found[2]
    total = sum(counts.values())
    held = math.ceil(0.4 * total)
    sizes = [sum(s == name for s in found[0].values()) for name in ("train", "val", "test")]
    assert sizes[0] == total - held and sizes[2] == math.ceil(0.5 * held) and sum(sizes) == total
    for c, n in counts.items():
        assert abs(sum(s == "train" for p, s in found[0].items() if p.startswith(c + "/")) - n * (total - held) / total) < 1
    splits.verify_no_leakage(splits.stratified_split(table, 0.6, 0.2, 0.2, seed=seed))


def test_split_errors(spark):
    with pytest.raises(ValueError, match="fewer than 2"):
        splits.stratified_split(patients(spark, {"A": 20, "B": 1}))
    with pytest.raises(ValueError, match="fewer places"):
        splits.stratified_split(patients(spark, {"A": 3, "B": 2}))
    with pytest.raises(ValueError, match="sum to 1"):
        splits.stratified_split(patients(spark, {"A": 4}), 0.5, 0.1, 0.1)
    with pytest.raises(ValueError, match="folds"):
        splits.kfold(patients(spark, {"A": 4, "B": 3}), 5)
    with pytest.raises(AssertionError):
        splits.verify_no_leakage(spark.createDataFrame([("a", "train"), ("a", "test")], "patient_id string, split string"))


def test_folds_cover_each_patient_once(spark):
    table = patients(spark, {"A": 17, "B": 23})
    rows = splits.kfold(table, 4, 0.2, 7).collect()
    test = [r.patient_id for r in rows if r.split == "test"]
    assert sorted(test) == sorted(r.patient_id for r in table.collect())
    for fold in range(1, 5):
        own = [r for r in rows if r.fold == fold]
        assert len(own) == 40 and len({r.patient_id for r in own}) == 40
        for c, n in (("A", 17), ("B", 23)):
            assert abs(sum(r.split == "test" and r["class"] == c for r in own) - n / 4) < 1


def test_number_rows_is_gapless(spark):
    rows = spark.range(500).withColumn("g", F.col("id") % 2)
    found = positions.number_rows(rows, F.md5(F.col("id").cast("string")), ["id"], ["g"], digits=1).orderBy("g", "position").collect()
    assert [r.position for r in found] == [*range(250), *range(250)]
    assert positions.number_rows(rows.limit(0), F.md5(F.col("id").cast("string")), ["id"]).count() == 0


def test_weighted_sample_follows_weights(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    found = balance.weighted_sample(rows, "key").groupBy("label").count().collect()
    counts = {r.label: r["count"] for r in found}
    assert sum(counts.values()) == 4000 and abs(counts[0] - 2000) < 150
    with pytest.raises(ValueError, match="strategy"):
        balance.training_order(rows, "key", "other")
    assert balance.training_order(rows, "key", "none").count() == 4000
    weights = {r.label: r.weight for r in balance.class_weights(rows, 3).collect()}
    assert sum(weights.values()) == pytest.approx(3) and weights[2] > weights[1]


def score_frame(spark, y, prob):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, prob)], "y int, prob float")


def auc_by_pairs(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def choose_by_loop(y, p, metric):
    best_t, best_s = 0.5, -np.inf
    for t in pr.grid(0.05, 0.95, 181):
        hit = p >= np.float32(t)
        tp, fp, fn, tn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum(), (~hit & (y == 0)).sum()
        tpr, tnr = tp / (tp + fn) if tp + fn else 0.0, tn / (tn + fp) if tn + fp else 0.0
        present = [r for r, n in ((tpr, tp + fn), (tnr, tn + fp)) if n]
        s = {"youden_j": tpr + tnr - 1, "f1": 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0, "balanced_accuracy": np.mean(present)}[metric]
        if s > best_s or (np.isclose(s, best_s) and abs(t - 0.5) < abs(best_t - 0.5)):
            best_t, best_s = t, s
    return best_t, best_s


@pytest.mark.parametrize("case", ["plain", "ties", "one class", "on the threshold"])
def test_metrics_and_thresholds_against_numpy(spark, case):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 400), rng.random(400).astype(np.float32)
    if case == "ties":
        p = np.round(p, 1).astype(np.float32)
    elif case == "one class":
        y[:] = 1
    elif case == "on the threshold":
        p = np.float32(rng.choice([0.35, 0.05, 0.95, 0.5], 400))
    frame = score_frame(spark, y, p)
    got = metrics.binary_metrics(frame, 0.35).first()
    hit = p >= np.float32(0.35)
    assert (got.tp, got.fp, got.fn, got.tn) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum(), (~hit & (y == 0)).sum())
    assert math.isnan(got.auc) if case == "one class" else got.auc == pytest.approx(auc_by_pairs(y, p))
    for metric in threshold.METRICS:
        chosen = threshold.optimize(frame, metric).first()
        assert (chosen.threshold, chosen.score) == pytest.approx(choose_by_loop(y, p, metric), rel=1e-12)


def test_score_edges(spark):
    empty = score_frame(spark, [], [])
    got = metrics.binary_metrics(empty).first()
    assert (got.tp, got.recall) == (0, 0.0) and math.isnan(got.auc)
    with pytest.raises(Exception, match="NaN score"):
        metrics.binary_metrics(score_frame(spark, [1, 0], [float("nan"), 0.5])).collect()
    with pytest.raises(ValueError, match="metric"):
        threshold.optimize(empty, "other")
    nothing = spark.createDataFrame([(0, 0.2), (1, 0.7), (0, None)], "y int, prob float")
    calls = (metrics.binary_metrics, metrics.auroc, threshold.curve, lambda t: t.agg(*metrics.confusion(0.5)), lambda t: metrics.predictions(t.withColumn("k", F.lit(1)), 0.5, "k"))
    for call in calls:
        with pytest.raises(Exception, match="null score"):
            call(nothing).collect()
    rows = metrics.evaluation(score_frame(spark, [1, 0, 1], [0.9, 0.2, 0.3]), 0.25).orderBy("at").collect()
    assert [r.matrix for r in rows] == [[[1, 0], [1, 1]], [[1, 0], [0, 2]]]
    assert pr.grid(0.05, 0.95, 181) == np.linspace(0.05, 0.95, 181).tolist()


def logit_frame(spark, logits, y):
    rows = [(i, [float(v) for v in row], int(t)) for i, (row, t) in enumerate(zip(logits, y))]
    return spark.createDataFrame(rows, "id long, logits array<double>, y int")


def log_probs(x):
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def test_losses_against_numpy(spark):
    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=(50, 3)) * 3, rng.integers(0, 3, 50), np.array([0.5, 1.0, 2.0])
    y[:5] = -100
    frame, live, logp = logit_frame(spark, x, y), y != -100, log_probs(x)
    nll, wy = -logp[np.arange(50), np.maximum(y, 0)], np.where(live, w[np.maximum(y, 0)], 0)
    expected = (wy * nll).sum() / wy.sum()
    smooth = (-(logp * w).sum(axis=1) * live).sum() / wy.sum()
    assert losses.cross_entropy(frame, w.tolist()).first().loss == pytest.approx(expected)
    assert losses.cross_entropy(frame, w.tolist(), 0.2).first().loss == pytest.approx(0.8 * expected + 0.2 / 3 * smooth)
    ce = wy * nll
    focal = (1 - np.exp(-ce)) ** 2 * ce
    assert losses.focal(frame, 2.0, w.tolist()).first().loss == pytest.approx(focal.mean())
    assert losses.focal(frame, 2.0, w.tolist(), "sum").first().loss == pytest.approx(focal.sum())
    probs, hot = np.exp(logp[5:]), np.eye(3)[y[5:]]
    score = (2 * (probs * hot).sum(0) + 1e-5) / (probs.sum(0) + hot.sum(0) + 1e-5)
    kept = logit_frame(spark, x[5:], y[5:])
    assert losses.dice(kept, 3).first().loss == pytest.approx(1 - score[1:].mean())
    assert losses.dice(kept, 1).first().loss == 0.0
    both = losses.segmentation_loss("focal_dice", 3)(kept).first().loss
    assert both == pytest.approx(1 - score[1:].mean() + nll[5:].mean())
    batch = [((wy * nll)[i : i + 16].sum() / wy[i : i + 16].sum()) for i in range(0, 48, 16)]
    assert losses.epoch_loss(frame, "id", 16, True, weights=w.tolist()).first().loss == pytest.approx(np.mean(batch))
    assert losses.epoch_loss(frame.limit(0), "id").first().loss == 0.0
    assert math.isnan(losses.cross_entropy(frame.where("y = -100")).first().loss)
    for bad in (lambda: losses.classification_loss("x"), lambda: losses.segmentation_loss("x", 2), lambda: losses.focal(frame, reduction="x")):
        with pytest.raises(ValueError):
            bad()


def test_history_rules(spark):
    nan = float("nan")
    rows = [(1, 0.5, 1.0), (2, nan, 0.2), (3, 0.6, 1.0), (4, 0.6, 1.0), (5, 0.1, 1.0), (6, 0.9, 1.0)]
    table = spark.createDataFrame(rows, "epoch int, val_recall double, val_loss double")
    assert history.best_epoch(table).first().epoch == 6
    assert history.best_epoch(table, patience=2).first().epoch == 3
    assert [r.epoch for r in history.early_stop(table, patience=2).orderBy("epoch").collect()] == [1, 2, 3, 4, 5]
    assert history.best_epoch(table, "unknown").first().epoch == 2
    with pytest.raises(Exception, match="no epoch improves"):
        history.best_epoch(spark.createDataFrame([(1, nan, nan)], "epoch int, val_recall double, val_loss double")).collect()


def png(path, rows, color=False):
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for x in row for v in (x if color else [x])) for row in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head_ = struct.pack(">IIBBBBB", w, h, 8, 2 if color else 0, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head_) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_scan_decode_and_sinks(spark, tmp_path):
    root = tmp_path / "raw"
    png(root / "Normal/P 1/a/A.PNG", [[0, 128], [255, 7]])
    png(root / "Sick/P2/b.png", [[(10, 20, 30), (200, 100, 50)]], True)
    png(root / "Sick/c.png", [[1]])
    png(root / "Other/P3/d.png", [[1]])
    (root / "Normal/P 1/note.txt").write_text("x")
    (root / "Normal/P 1/.jpg").write_text("x")
    found = images.ordered_scan(images.scan_images(spark, str(root))).collect()
    assert [(r.patient_id, r["class"]) for r in found] == [("Normal/P 1", "Normal"), ("Sick/P2", "Sick")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none/x.txt").write_text("x")
    assert images.scan_images(spark, str(tmp_path / "none")).columns == list(images.IMAGE_COLUMNS)
    assert images.scan_images(spark, str(tmp_path / "none")).isEmpty()
    decoded = {r.image_path.rsplit("/", 1)[1]: r for r in images.decode_images(spark, f"{root}/*/*").collect()}
    assert decoded["b.png"].pixels == [30, 20, 10, 50, 100, 200]
    table = pixels.gray(spark.createDataFrame([(1, 1, 2, 3, decoded["b.png"].pixels)], "image_id int, h int, w int, c int, pixels array<int>"))
    assert table.first().pixels == [(19595 * r + 38470 * g + 7471 * b + 32768) >> 16 for r, g, b in ((10, 20, 30), (200, 100, 50))]
    assigned = images.scan_images(spark, str(root)).withColumn("split", F.lit("train"))
    images.write_splits(assigned, str(tmp_path / "splits"))
    assert images.read_split(spark, str(tmp_path / "splits")).count() == 2
    spark.createDataFrame([("a",)], "x string").write.option("header", True).csv(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="missing columns"):
        images.read_split(spark, str(tmp_path / "bad"))
    model = {"coef": [[1.0], [2.0]], "intercept": [0.0, 1.0], "epoch": 3, "best_score": 0.5}
    images.save_model(spark, model, str(tmp_path / "model"))
    assert images.load_model(spark, str(tmp_path / "model")) == model | {"input_channels": 1, "use_rgb": False}


def test_labels_and_paths(spark):
    rows = spark.createDataFrame([("a/.jpg",), ("a/b.JPG",), ("x.tar.png",), ("noext",)], "path string")
    assert [r[0] for r in rows.select(paths.extension(F.col("path"))).collect()] == ["", ".jpg", ".png", ""]
    with pytest.raises(Exception, match="unknown class"):
        spark.createDataFrame([("Odd",)], "c string").select(paths.encode_label(F.col("c"))).collect()


def frame(spark, block, image_id=1):
    h, w, c = block.shape
    return spark.createDataFrame([(image_id, h, w, c, [int(x) for x in block.ravel()])], "image_id int, h int, w int, c int, pixels array<int>")


def test_pixels_against_numpy(spark):
    block = np.random.default_rng(1).integers(0, 256, (5, 7, 1))
    table = frame(spark, block)
    small = pixels.resize(table, 3).first()
    expected = np.einsum("ij,jk->ik", pixels.weights(5, 3), np.einsum("ij,kj->ki", pixels.weights(7, 3), block[..., 0]))
    assert np.abs(np.array(small.pixels) - expected.ravel()).max() <= 0.5 + 1e-9 and (small.h, small.w) == (3, 3)
    ready = pixels.prepare(table, None, channels=3).first()
    chw = np.repeat((block.transpose(2, 0, 1) / 255).astype(np.float32), 3, 0)
    mean, std = (np.array(v)[:, None, None] for v in pixels.RGB)
    assert np.allclose(ready.pixels, ((chw - mean) / std).ravel(), atol=1e-6)
    assert pixels.flip(table, 1.0).first().pixels == block[:, ::-1].ravel().tolist()
    assert pixels.flip(table, 0.0).first().pixels == block.ravel().tolist()
    assert pixels.rotate(table, 0).first().pixels == block.ravel().tolist()
    assert pixels.sharpen(table, 1.0, 1.1).first().pixels == block.ravel().tolist()
    tensor = pixels.to_tensor(table)
    noisy = np.array(pixels.noise(tensor, 0.05, 1.0).first().pixels)
    assert noisy.min() >= 0 and noisy.max() <= 1 and 0 < np.abs(noisy - block.ravel() / 255).mean() < 0.1
    assert pixels.prepare(table, 4, train=True).first().pixels == pixels.prepare(table, 4, train=True).first().pixels
    with pytest.raises(Exception, match="channels: 2"):
        pixels.repeat_channels(pixels.to_tensor(frame(spark, np.ones((2, 2, 2), int))), 3).collect()
    assert pixels.input_channels(True, True) == 3 and pixels.input_channels(True, False) == 1
    shifted = np.array(pixels.translate(table, 0.5).first().pixels).reshape(5, 7)
    assert any(np.array_equal(shifted, np.roll(np.pad(block[..., 0], 7), (a, b), (0, 1))[7:12, 7:14]) for a in range(-5, 6) for b in range(-5, 6))


@pytest.mark.parametrize("kind", ["ce", "weighted_ce", "focal"])
def test_gradient_by_differences(kind):
    rng = np.random.default_rng(2)
    logits, y, w = rng.normal(size=(6, 2)), rng.integers(0, 2, 6), np.array([0.6, 1.0]) if kind != "ce" else np.ones(2)
    _, _, step = head.row_losses(logits, y, kind, w, 2.0)
    for i in range(6):
        for c in range(2):
            moved = [logits.copy(), logits.copy()]
            moved[0][i, c] += 1e-6
            moved[1][i, c] -= 1e-6
            up, down = (head.row_losses(m, y, kind, w, 2.0)[0].sum() for m in moved)
            assert step[i, c] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_head_learns(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, 4)) + y[:, None] * 2
    rows = spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, features array<double>, y int")
    train, val = rows.where("id < 150"), rows.where("id >= 150")
    log, model = head.fit_head(train, val, epochs=12, lr=0.1, metric="val_auc", patience=4, dropout=0.1)
    assert log[-1]["train_loss"] < log[0]["train_loss"] and log[-1]["val_auc"] > 0.9 and len(log[0]) == 11
    report = head.report(val, val, model).collect()
    assert len(report) == 2 and all(r.auc > 0.9 for r in report)
    with pytest.raises(ValueError, match="loss"):
        head.fit_head(train, val, loss="other")
    assert scoring.predict(logit_frame(spark, [[0.0, 0.0]], [0]), "id").first().predicted_class == "Sick"


def test_steps_on_pixels_keep_nulls_and_other_channels(spark):
    block = np.arange(2 * 3 * 3) % 251
    rows = spark.createDataFrame([(1, 2, 3, 3, block.tolist()), (2, 4, 4, 1, list(range(16))), (3, 2, 2, 1, None)], "image_id int, h int, w int, c int, pixels array<int>")
    small = {r.image_id: r for r in pixels.resize(rows, 2).collect()}
    assert small[3].pixels is None and [len(small[i].pixels) for i in (1, 2)] == [12, 4]
    turned = {r.image_id: r.pixels for r in pixels.flip(rows, 1.0).collect()}
    assert turned[1] == block.reshape(2, 3, 3)[:, ::-1].ravel().tolist() and turned[3] is None
    assert {r.image_id: r.pixels for r in pixels.sharpen(rows, 1.0, 1.1).collect()}[2] == list(range(16))


@pytest.mark.parametrize("far", [10**12, 2**62])
def test_batches_of_unevenly_spread_numbers(spark, far):
    """An outlying number doesn't put all others into one range."""
    rows = spark.createDataFrame([(i, i % 7) for i in [*range(999), far]] + [(None, 1)], "id long, x int")
    cells = losses.bucketed(rows, "id", 64).groupBy("bucket_").count().collect()
    assert sum(r["count"] for r in cells) == 1000 and max(r["count"] for r in cells) <= 2 * -(-1000 // 64)
    found = {r.id: r.batch for r in losses.batches(rows, "id", 64).collect()}
    assert found == {i: n // 64 for n, i in enumerate([*range(999), far])}
    assert losses.batches(rows, "id", 64, True).count() == 960 and losses.batches(rows.limit(0), "id").count() == 0


def test_moves_are_one_lookup_a_pixel(spark):
    """Turn, mirror and shift together give what they give one after another."""
    block = np.random.default_rng(7).integers(1, 256, (9, 7, 3))
    rows = frame(spark, block, 5).union(frame(spark, block[:4, :6, :1], 6)).union(frame(spark, block, 8))
    moves = [pixels.turning(40), pixels.mirroring(0.7), pixels.shifting(0.3)]
    one = rows
    for m in moves:
        one = pixels.gathered(one, m)
    together = pixels.gathered(rows, *moves)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, together.collect())) and together.columns == rows.columns
    lambdas = lambda *ms: pixels.gathered(frame(spark, block), *ms)._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction")
    assert lambdas(*moves) == lambdas(moves[0])
    tensors = pixels.gathered(pixels.to_tensor(rows), *moves)
    back = {r.image_id: np.round(np.array(r.pixels) * 255).reshape(r.c, r.h, r.w).transpose(1, 2, 0).ravel().tolist() for r in tensors.collect()}
    assert back == {r.image_id: r.pixels for r in together.collect()}


def test_enlarging_holds_few_images_at_once(spark, monkeypatch):
    monkeypatch.setattr(pixels, "STACK", 8 * 40 * 40 * 3)
    rows = spark.range(50).select(F.col("id").alias("image_id"), F.lit(2).alias("h"), F.lit(3).alias("w"), F.lit(1).alias("c"), F.array(*[(F.col("id") + i).cast("int") for i in range(6)]).alias("pixels"))
    grown = pixels.resize(rows, 40)
    assert grown.where("h = 40 and w = 40 and size(pixels) = 1600").count() == 50
    assert {r.image_id: r.pixels[0] for r in grown.collect()} == {i: i for i in range(50)}
