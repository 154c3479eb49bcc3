"""Patient-grouped, class-stratified splits and folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.keys import order_key
from cairn.operators.positions import number_rows


def patient_table(images: DataFrame) -> DataFrame:
    """One row for each patient, with the class of its first image by path."""
    return images.groupBy("patient_id").agg(F.min_by("class", "image_path").alias("class"))


def quotas(counts: dict[str, int], ratio: float) -> dict[str, int]:
    """Places of each class in the first part, when ceil(ratio * n) of all n rows go to the second.

    Shares are rounded down and the places left go to the largest remainders, ties to the class first by name.
    """
    n = sum(counts.values())
    held = math.ceil(ratio * n)
    first = n - held
    if min(counts.values(), default=0) < 2:
        raise ValueError("a class has fewer than 2 patients")
    if first < len(counts) or held < len(counts):
        raise ValueError("fewer places than classes")
    places = {c: counts[c] * first // n for c in counts}
    by_rest = sorted(counts, key=lambda c: (-(counts[c] * first % n), c))
    for c in by_rest[: first - sum(places.values())]:
        places[c] += 1
    return places


def class_totals(patients: DataFrame) -> dict[str, int]:
    return {r["class"]: r["count"] for r in patients.groupBy("class").count().collect()}


def lookup(values: dict[str, int]):
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv]), F.col("class"))


def stratified_split(patients: DataFrame, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """patient_id, class, split with exact sizes in each class; membership follows md5(seed:patient_id)."""
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError("the ratios must sum to 1")
    patients = patients.select("patient_id", "class")
    counts = class_totals(patients)
    first = quotas(counts, val + test)
    second = quotas({c: counts[c] - first[c] for c in counts}, test / (val + test))
    placed = number_rows(patients, order_key(seed, F.col("patient_id")), ["patient_id"], ["class"])
    split = F.when(F.col("position") < lookup(first), "train").when(F.col("position") < lookup({c: first[c] + second[c] for c in counts}), "val")
    return placed.select("patient_id", "class", split.otherwise("test").alias("split"))


def split_images(images: DataFrame, assigned: DataFrame) -> DataFrame:
    """The images with the split (and fold) of their patient, all splits in one pass."""
    keys = [c for c in ("fold", "split") if c in assigned.columns]
    return images.join(assigned.select("patient_id", *keys), "patient_id").select(*images.columns, *keys)


def with_folds(images: DataFrame, assigned: DataFrame) -> DataFrame:
    """The images with folds_: the folds (their names) and splits of their patient, as one text; `spread_folds` takes it apart."""
    own = assigned.groupBy("patient_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("/", "fold", "split"))), ",").alias("folds_"))
    return images.join(own, "patient_id").select(*images.columns, "folds_")


def spread_folds(images: DataFrame, columns: list[str]) -> DataFrame:
    """A row of `columns`, fold and split for each fold of an image of `with_folds`."""
    spread = images.select(*columns, F.explode(F.split("folds_", ",")).alias("own_"))
    return spread.select(*columns, *[F.split_part("own_", F.lit("/"), F.lit(k)).alias(c) for k, c in ((1, "fold"), (2, "split"))])


def leaks(assigned: DataFrame) -> DataFrame:
    """Patients that stand in more than one split (of a fold)."""
    by = [c for c in ("fold",) if c in assigned.columns]
    return assigned.groupBy(*by, "patient_id").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def verify_no_leakage(assigned: DataFrame) -> None:
    if not leaks(assigned).isEmpty():
        raise AssertionError("a patient stands in more than one split")


def coverage(patients: DataFrame, assigned: DataFrame) -> DataFrame:
    """n_missing and n_extra patients of the splits together."""
    a, b = patients.select("patient_id"), assigned.select("patient_id")
    missing = a.exceptAll(b).agg(F.count("*").alias("n_missing"))
    return missing.crossJoin(b.exceptAll(a).agg(F.count("*").alias("n_extra")))  # one row each


def kfold(patients: DataFrame, k: int = 10, val_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """fold (1..k), patient_id, class, split: each patient is in test once; the rest of each fold is split again.

    Patients are dealt to folds in turn, class after class (classes by name). Each fold's rest is ordered by
    md5(seed + fold:patient_id). All folds are made in one pass.
    """
    patients = patients.select("patient_id", "class")
    counts = class_totals(patients)
    if not counts or max(counts.values()) < k:
        raise ValueError("every class has fewer patients than folds")
    order = sorted(counts)
    offset = {c: sum(counts[x] for x in order[:i]) for i, c in enumerate(order)}
    placed = number_rows(patients, order_key(seed, F.col("patient_id")), ["patient_id"], ["class"])
    dealt = placed.withColumn("own", ((F.col("position") + lookup(offset)) % k + 1).cast("int")).drop("position")
    in_test = {f: {c: len(range((f - 1 - offset[c]) % k, counts[c], k)) for c in order} for f in range(1, k + 1)}
    first = {f: quotas({c: counts[c] - in_test[f][c] for c in order}, val_ratio) for f in in_test}
    folds = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold")
    spread = dealt.select(folds, "patient_id", "class", "own")
    test = spread.where("fold = own").select("fold", "patient_id", "class", F.lit("test").alias("split"))
    rest = spread.where("fold <> own").drop("own")
    rest = number_rows(rest, order_key(F.col("fold") + seed, F.col("patient_id")), ["patient_id"], ["fold", "class"], digits=2)
    limits = F.create_map(*[x for f in first for c in order for x in (F.lit(f"{f}/{c}"), F.lit(first[f][c]))])
    train = F.col("position") < F.element_at(limits, F.concat_ws("/", "fold", "class"))
    return test.union(rest.select("fold", "patient_id", "class", F.when(train, "train").otherwise("val")))


def fold_name(fold):
    return F.format_string("fold_%02d", fold)


def split_summary(images: DataFrame) -> DataFrame:
    """split, n_patients, n_images, n_normal, n_sick."""
    return images.groupBy("split").agg(
        F.count_distinct("patient_id").alias("n_patients"), F.count("*").alias("n_images"),
        F.count_if(F.col("class") == "Normal").alias("n_normal"), F.count_if(F.col("class") == "Sick").alias("n_sick"),
    )


def fold_summary(images: DataFrame, assigned: DataFrame) -> DataFrame:
    """For each fold the patients and images of each split, on one row. Images are counted by patient before they meet the folds."""
    counts = images.groupBy("patient_id").agg(F.count("*").alias("n"))
    patients = assigned.select("fold", "split", "patient_id").join(counts, "patient_id")
    own = lambda s: F.col("split") == s
    return patients.groupBy(fold_name(F.col("fold")).alias("fold")).agg(
        *[F.count_if(own(s)).alias(f"n_{s}_patients") for s in ("train", "val", "test")],
        *[F.coalesce(F.sum(F.when(own(s), F.col("n"))), F.lit(0)).alias(f"n_{s}_images") for s in ("train", "val", "test")],
    )


def cohort_summary(images: DataFrame) -> DataFrame:
    """class (null: all), n_patients, n_images."""
    return images.rollup("class").agg(F.count_distinct("patient_id").alias("n_patients"), F.count("*").alias("n_images"))


def sample_counts(images: DataFrame) -> DataFrame:
    """class, patient_id, n_images, with totals of each class and of all (nulls)."""
    return images.rollup("class", "patient_id").agg(F.count("*").alias("n_images"))
