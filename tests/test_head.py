"""Fitting heads by whole-table steps, by batches, by folds, and from checkpoints."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import balance, head, metrics, scoring, threshold
from cairn.sources import checkpoints, images


def table(spark, n=150, dim=3, seed=8):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    x = rng.normal(size=(n, dim)) + 2 * y[:, None]
    rows = [(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*rows, (9000, None, 1), (9001, [0.0] * dim, None)], "id long, features array<double>, y int"), x, y


def plain_epochs(spark, rows, x, y, s, epochs):
    """Mini-batch AdamW in a loop: the weights after each epoch, the losses, and the scores before each step."""
    theta = np.zeros(2 * x.shape[1] + 2)
    first, second, taken, out = np.zeros_like(theta), np.zeros_like(theta), 0, []
    for epoch in range(1, epochs + 1):
        ids = rows.where("features is not null and y is not null").select("id", F.col("y").alias("label"))
        order = [r["id"] for r in balance.training_order(ids, "id", s.strategy, list(s.class_weights), s.seed, epoch).orderBy("draw").collect()]
        lost, scores = [], []
        for lo in range(0, len(order) - s.batch_size + 1, s.batch_size):
            own = np.array(order[lo : lo + s.batch_size])
            sums, prob = head.sums_of(head.dropped(x[own], own, 1 - s.dropout, s.seed + epoch), y[own], theta, s)
            scores += list(zip(y[own].tolist(), prob.tolist(), strict=True))
            slope, taken = sums[2:] / sums[1], taken + 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            theta = theta * (1 - s.lr * s.weight_decay) - s.lr * (first / (1 - 0.9**taken)) / (np.sqrt(second / (1 - 0.999**taken)) + 1e-8)
            lost.append(sums[0] / sums[1])
        out.append((theta, np.mean(lost), scores))
    return out


def flat(model):
    return np.append(np.ravel(model["coef"]), model["intercept"])


@pytest.mark.parametrize(("slots", "lane_rows", "strategy", "parts"), [(1, 4096, "sampler", 1), (3, 4096, "sampler", 4), (3, 16, "loss_weights", 4)])
def test_batches_equal_a_plain_loop(spark, monkeypatch, strategy, slots, lane_rows, parts):
    """One task, a relay of three, and three lanes take the same steps, on any partitioning of the rows."""
    monkeypatch.setattr(head, "slots", lambda rows: slots)
    monkeypatch.setattr(head, "LANE_ROWS", lane_rows)
    monkeypatch.setattr(head, "TURN_ROWS", 40)
    rows, x, y = table(spark)
    s = head.Settings(lr=0.1, metric="val_auc", batch_size=64, strategy=strategy, dropout=0.2, epochs=2)
    expected = plain_epochs(spark, rows, x, y, s, 2)
    heads = head.fit(split_once(rows.repartition(parts)), 1, s)
    assert np.allclose(heads[0].theta, expected[-1][0], rtol=1e-9, atol=1e-12) and heads[0].taken == 4
    for row, (_, lost, scores) in zip(heads[0].history, expected, strict=True):
        assert row["train_loss"] == pytest.approx(lost)
        frame = spark.createDataFrame(scores, "y int, prob float")
        assert row["train_auc"] == pytest.approx(metrics.auroc(frame).first().auc)


def split_once(rows):
    """Every row trains and, once more, tests."""
    both = head.complete(rows)
    role = lambda k: both.withColumn("splits", F.array(F.lit(k).cast("tinyint")))
    return role(head.TRAIN).union(role(head.VAL))


def test_many_steps_are_one_job_an_epoch(spark):
    rows, _, _ = table(spark, 2100)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("steps"))
    spark.sparkContext.setJobGroup("steps", "steps")
    try:
        history, _ = head.fit_head(rows, rows, epochs=1, batch_size=2, metric="val_auc", lr=0.01)
        few = jobs()
        head.fit_head(rows, rows, epochs=1, batch_size=700, metric="val_auc", lr=0.01)
        assert jobs() - few >= few - 3  # 1,050 steps took no more jobs than three
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert history[0]["val_auc"] > 0.9


def test_batches_of_too_few_rows_take_no_step(spark):
    rows, _, _ = table(spark, 40)
    history, model = head.fit_head(rows, rows, epochs=1, batch_size=64, metric="val_loss")
    assert history[0]["train_loss"] == 0.0 and not np.any(flat(model)) and math.isnan(history[0]["train_auc"])


def test_features_of_other_sizes_are_an_error(spark):
    rows, _, _ = table(spark, 40)
    mixed = rows.union(spark.createDataFrame([(77, [1.0], 0)], rows.schema))
    with pytest.raises(Exception, match="3 numbers|features"):
        head.fit_head(mixed.orderBy("id"), mixed, epochs=1)
    with pytest.raises(ValueError, match="no rows"):
        head.fit_head(rows.limit(0), rows.limit(0), epochs=1)
    with pytest.raises(ValueError, match="strategy"):
        head.fit_head(rows, rows, strategy="other")


def folds_of(rows, k=3):
    own = F.pmod(F.col("id"), F.lit(k)).cast("int")
    fold = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    spread = rows.where("id < 9000").select("id", fold, own.alias("own"))
    split = F.when(F.col("fold") == F.col("own"), "test").when(F.pmod(F.col("own") - F.col("fold"), F.lit(k)) == 1, "val").otherwise("train")
    return spread.select("id", (F.col("fold") * 10 + 5).alias("fold"), split.alias("split"))


@pytest.mark.parametrize("options", [{}, {"batch_size": 16, "strategy": "sampler", "dropout": 0.3, "loss": "focal"}])
def test_stacked_folds_equal_single_fits(spark, options):
    rows, _, _ = table(spark, 120)
    assigned = folds_of(rows)
    settings = {"epochs": 3, "lr": 0.2, "patience": 1, "metric": "val_f1"} | options
    fitted = head.fit_folds(rows, assigned, **settings)
    assert list(fitted) == [5, 15, 25]
    for fold, (history, model) in fitted.items():
        part = lambda split: rows.join(assigned.where(f"fold = {fold} and split = '{split}'"), "id").select("id", "features", "y")  # noqa: B023, E731
        own, alone = head.fit_head(part("train"), part("val"), **settings)
        assert len(own) == len(history) and all(a[c] == pytest.approx(b[c], nan_ok=True) for a, b in zip(own, history, strict=True) for c in a)
        assert np.allclose(flat(model), flat(alone), rtol=1e-9) and model["epoch"] == alone["epoch"]
    measured = head.fold_metrics(rows, assigned, {f: m for f, (_, m) in fitted.items()})
    for r in measured.collect():
        test = rows.join(assigned.where(f"fold = {r.fold} and split = 'test'"), "id")
        plain = metrics.binary_metrics(head.scored(test, fitted[r.fold][1])).first()
        assert (r.tp, r.fp, r.fn, r.tn) == (plain.tp, plain.fp, plain.fn, plain.tn) and r.auc == pytest.approx(plain.auc)
    assert metrics.fold_spread(measured, ["auc"]).first()["mean"] > 0.8


@pytest.mark.parametrize("options", [{}, {"batch_size": 32, "strategy": "sampler"}])
def test_a_fit_that_was_cut_short_goes_on(spark, monkeypatch, tmp_path, options):
    rows, _, _ = table(spark, 120)
    assigned = folds_of(rows, 3)
    settings = {"epochs": 4, "lr": 0.05, "patience": 3, "metric": "val_auc", "input_channels": 3, "use_rgb": True} | options
    unbroken = head.fit_folds(rows, assigned, **settings)
    real, folder = checkpoints.append, str(tmp_path / "epochs")

    def dies(spark, folder, epochs):
        if epochs[0].epoch == 3:
            raise KeyboardInterrupt
        real(spark, folder, epochs)

    monkeypatch.setattr(checkpoints, "append", dies)
    with pytest.raises(KeyboardInterrupt):
        head.fit_folds(rows, assigned, checkpoint=folder, **settings)
    monkeypatch.setattr(checkpoints, "append", real)
    held = checkpoints.table(spark, folder)
    assert held.agg(F.max("epoch")).first()[0] == 2 and {(r.input_channels, r.use_rgb) for r in held.collect()} == {(3, True)}
    again = head.fit_folds(rows, assigned, checkpoint=folder, **settings)
    for fold, (history, model) in unbroken.items():
        assert len(again[fold][0]) == len(history)
        assert all(a[c] == pytest.approx(b[c], nan_ok=True) for a, b in zip(again[fold][0], history, strict=True) for c in a)
        assert np.allclose(flat(again[fold][1]), flat(model), rtol=1e-9) and again[fold][1]["epoch"] == model["epoch"]
    rows_before = checkpoints.table(spark, folder).count()
    done = head.fit_folds(rows, assigned, checkpoint=folder, **settings)
    assert {f: m for f, (_, m) in done.items()} == {f: m for f, (_, m) in again.items()} and checkpoints.table(spark, folder).count() == rows_before
    best = checkpoints.best_model(spark, folder, 1)
    assert best == again[15][1]
    with pytest.raises(ValueError, match="other settings"):
        head.fit_folds(rows, assigned, checkpoint=folder, **settings | {"lr": 0.06})
    with pytest.raises(ValueError, match="no epoch"):
        checkpoints.best_model(spark, str(tmp_path / "none"))


def test_a_colour_model_predicts_alike_after_reload(spark, tmp_path):
    block = list(range(0, 48, 1))
    shots = spark.createDataFrame([(i, 4, 4, 3, [(v * (i + 1)) % 256 for v in block]) for i in range(6)], "image_id int, h int, w int, c int, pixels array<int>")
    coef = [[math.sin(i) for i in range(48)], [math.cos(i) for i in range(48)]]
    model = {"coef": coef, "intercept": [0.1, -0.1], "epoch": 1, "best_score": 0.5, "input_channels": 3, "use_rgb": True}
    images.save_model(spark, model, str(tmp_path / "model"))
    loaded = images.load_model(spark, str(tmp_path / "model"))
    assert loaded == model
    rows = [sorted(scoring.predict_images(shots, m, size=None).collect()) for m in (model, loaded)]
    assert rows[0] == rows[1] and all(0 < r.prob_sick < 1 for r in rows[0])
    with pytest.raises(Exception, match="48 features, not 16"):
        scoring.predict_images(shots, model | {"input_channels": 1}, size=None).collect()
    lone = spark.createDataFrame([(1, None)], "id int, features array<double>")
    assert scoring.score(lone, coef, [0.0, 0.0]).first().prob_sick is None


def test_histograms_add_up_and_answer_by_group(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), int(rng.random() < 0.4), float(np.float32(round(rng.random(), 2)))) for g in rng.integers(0, 3, 900)]
    scores = spark.createDataFrame([*rows, (None, 1, 0.5), (None, 0, 0.25), (1, None, 0.3)], "g int, y int, prob float")
    whole = metrics.histogram(scores, ("g",))
    parts = metrics.merged([metrics.histogram(scores.where(c), ("g",)) for c in ("prob < 0.3", "prob >= 0.3")], ("g",))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    found = {r.g: r for r in metrics.binary_metrics(scores, 0.35, ("g",)).collect()}
    best = {r.g: r for r in threshold.optimize(scores, "f1", by=("g",)).collect()}
    assert set(found) == set(best) == {0, 1, 2, None}
    for g in found:
        own = scores.where(F.col("g").eqNullSafe(F.lit(g))).drop("g")
        alone, chosen = metrics.binary_metrics(own, 0.35).first(), threshold.optimize(own, "f1").first()
        assert tuple(found[g][1:]) == pytest.approx(tuple(alone)) and (best[g].threshold, best[g].score) == (chosen.threshold, chosen.score)
    plan = metrics.evaluation(scores.where("y is not null"), 0.4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1  # the scores are scanned once
