"""Registered queries of the reference's operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import probability as pr
from cairn.functions.paths import decode_label, encode_label
from cairn.operators import balance, head, history, losses, metrics, pixels, scoring, splits, threshold
from cairn.plans import standins as v
from cairn.sources import publication
from cairn.sources.images import parse_paths
from cairn.sources.scratch import scratch_folder

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Splits


@query(f"""WITH {v.PATHS}, p AS (
  SELECT path, regexp_extract(path, '^data/raw/([^/]+)/([^/]+)/(.*/)?[^/]+$', 1) AS class,
    regexp_extract(path, '^data/raw/([^/]+)/([^/]+)/(.*/)?[^/]+$', 2) AS patient, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext
  FROM v_paths)
SELECT class || '/' || patient AS patient_id, class, path AS image_path FROM p
WHERE class IN ('Normal', 'Sick') AND ext IN ('.png', '.jpg', '.jpeg', '.bmp', '.tif', '.tiff')""")
def parse_image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_paths(v.paths(spark, sf_dir), "data/raw")


@query(f"WITH {v.IMAGES} SELECT patient_id, class FROM patients")
def patient_table(spark, sf_dir):
    return splits.patient_table(v.images(spark, sf_dir))


@query(f"WITH {v.IMAGES} SELECT class, count(DISTINCT patient_id) AS n_patients, count(*) AS n_images FROM v_images GROUP BY ROLLUP (class)")
def cohort_summary(spark, sf_dir):
    return splits.cohort_summary(v.images(spark, sf_dir))


@query(f"WITH {v.IMAGES} SELECT class, patient_id, count(*) AS n_images FROM v_images GROUP BY ROLLUP (class, patient_id)")
def sample_counts(spark, sf_dir):
    return splits.sample_counts(v.images(spark, sf_dir))


def places(name: str, source: str, held: str, by: str = "") -> str:
    """SQL of exact quotas: columns class, q of each group `by`, from (by, class, n) and the number held out of all n."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    order = f"PARTITION BY {by} ORDER BY" if by else "ORDER BY"
    return f"""{name}_a AS (
  SELECT {key}class, n, n * (CAST(sum(n) OVER ({part}) AS BIGINT) - {held}) AS share, CAST(sum(n) OVER ({part}) AS BIGINT) AS whole,
    CAST(sum(n) OVER ({part}) AS BIGINT) - {held} AS kept FROM {source}
), {name} AS (
  SELECT {key}class, share // whole + CASE WHEN row_number() OVER ({order} share % whole DESC, class)
    <= kept - CAST(sum(share // whole) OVER ({part}) AS BIGINT) THEN 1 ELSE 0 END AS q, n FROM {name}_a
)"""


SPLIT = f"""{v.IMAGES}, c1 AS (SELECT class, count(*) AS n FROM patients GROUP BY class),
{places("q1", "c1", "CAST(ceil((0.1::DOUBLE + 0.1::DOUBLE) * (SELECT sum(n) FROM c1)) AS BIGINT)")},
c2 AS (SELECT class, n - q AS n FROM q1),
{places("q2", "c2", "CAST(ceil(0.1::DOUBLE / (0.1::DOUBLE + 0.1::DOUBLE) * (SELECT sum(n) FROM c2)) AS BIGINT)")},
assigned AS (
  SELECT patient_id, p.class, CASE WHEN r <= q1.q THEN 'train' WHEN r <= q1.q + q2.q THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('42:' || patient_id), patient_id) AS r FROM patients) p
  JOIN q1 ON p.class = q1.class JOIN q2 ON p.class = q2.class
)"""


@query(f"WITH {SPLIT} SELECT patient_id, class, split FROM assigned")
def stratified_split(spark, sf_dir):
    return splits.stratified_split(splits.patient_table(v.images(spark, sf_dir)))


@query(f"WITH {SPLIT} SELECT i.patient_id, i.class, image_path, split FROM v_images i JOIN assigned a ON i.patient_id = a.patient_id")
def split_images(spark, sf_dir):
    return splits.split_images(v.images(spark, sf_dir), stratified_split(spark, sf_dir))


@query(f"""WITH {SPLIT} SELECT split, count(DISTINCT i.patient_id) AS n_patients, count(*) AS n_images, count(*) FILTER (i.class = 'Normal') AS n_normal,
  count(*) FILTER (i.class = 'Sick') AS n_sick FROM v_images i JOIN assigned a ON i.patient_id = a.patient_id GROUP BY split""")
def split_summary(spark, sf_dir):
    return splits.split_summary(split_images(spark, sf_dir))


@query(f"WITH {SPLIT} SELECT count(*) AS n_violations FROM (SELECT patient_id FROM assigned GROUP BY patient_id HAVING count(DISTINCT split) > 1)")
def leakage_check(spark, sf_dir):
    return splits.leaks(stratified_split(spark, sf_dir)).agg(F.count("*").alias("n_violations"))


@query(f"""WITH {SPLIT} SELECT (SELECT count(*) FROM (SELECT patient_id FROM patients EXCEPT ALL SELECT patient_id FROM assigned)) AS n_missing,
  (SELECT count(*) FROM (SELECT patient_id FROM assigned EXCEPT ALL SELECT patient_id FROM patients)) AS n_extra""")
def split_coverage(spark, sf_dir):
    return splits.coverage(patient_table(spark, sf_dir), stratified_split(spark, sf_dir))


KFOLD = f"""{v.IMAGES}, dealt AS (
  SELECT patient_id, class, (row_number() OVER (ORDER BY class, md5('42:' || patient_id), patient_id) - 1) % 10 + 1 AS own FROM patients
), rest AS (
  SELECT fold, patient_id, class FROM dealt, (SELECT unnest(range(1, 11)) AS fold) WHERE own <> fold
), held AS (SELECT fold, class, count(*) AS n FROM rest GROUP BY ALL),
{places("q1", "held", "CAST(ceil(0.1::DOUBLE * sum(n) OVER (PARTITION BY fold)) AS BIGINT)", "fold")},
assigned AS (
  SELECT r.fold, patient_id, r.class, CASE WHEN r <= q THEN 'train' ELSE 'val' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY fold, class ORDER BY md5((42 + fold) || ':' || patient_id), patient_id) AS r FROM rest) r
  JOIN q1 ON r.fold = q1.fold AND r.class = q1.class
  UNION ALL SELECT own, patient_id, class, 'test' FROM dealt
)"""


@query(f"WITH {KFOLD} SELECT CAST(fold AS INTEGER) AS fold, patient_id, class, split FROM assigned")
def kfold_assign(spark, sf_dir):
    return splits.kfold(patient_table(spark, sf_dir))


@query(f"""WITH {KFOLD} SELECT format('fold_{{:02d}}', CAST(fold AS INTEGER)) AS fold,
  {", ".join(f"count(DISTINCT i.patient_id) FILTER (split = '{s}') AS n_{s}_patients, count(*) FILTER (split = '{s}') AS n_{s}_images" for s in ("train", "val", "test"))}
  FROM v_images i JOIN assigned a ON i.patient_id = a.patient_id GROUP BY fold""")
def kfold_summary(spark, sf_dir):
    return splits.fold_summary(v.images(spark, sf_dir), kfold_assign(spark, sf_dir))


@query(f"WITH {v.IMAGES} SELECT image_path, CASE class WHEN 'Normal' THEN 0 ELSE 1 END AS label, class AS decoded FROM v_images")
def label_encode(spark, sf_dir):
    rows = v.images(spark, sf_dir).select("image_path", encode_label(F.col("class")).alias("label"))
    return rows.withColumn("decoded", decode_label(F.col("label")))


# Published files, read back


@query(f"WITH {SPLIT} SELECT i.patient_id, i.class, image_path, split FROM v_images i JOIN assigned a ON i.patient_id = a.patient_id")
def split_roundtrip(spark, sf_dir):
    folder = scratch_folder(spark, "splits")
    publication.publish(spark, folder, {"splits": publication.Table(split_images(spark, sf_dir), "csv", ("split",), ("image_path",))})
    return publication.published(spark, folder, "splits", check=True)


@query(f"""WITH {KFOLD} SELECT format('fold_{{:02d}}', CAST(fold AS INTEGER)) AS fold, split, i.patient_id, i.class, image_path
FROM v_images i JOIN assigned a ON i.patient_id = a.patient_id""")
def fold_files(spark, sf_dir):
    folder, assigned, images = scratch_folder(spark, "folds"), kfold_assign(spark, sf_dir), v.images(spark, sf_dir)
    named = assigned.withColumn("fold", splits.fold_name(F.col("fold")))
    publication.publish_folds(spark, folder, images, splits.fold_summary(images, assigned), named)
    return publication.published(spark, folder, "folds", check=True)


FOLD_COUNTS = [f"n_{s}_{x}" for x in ("patients", "images") for s in ("train", "val", "test")]


@query(f"""WITH {KFOLD}, s AS (SELECT format('fold_{{:02d}}', CAST(fold AS INTEGER)) AS fold,
  {", ".join(f"count(DISTINCT i.patient_id) FILTER (split = '{s}') AS n_{s}_patients, count(*) FILTER (split = '{s}') AS n_{s}_images" for s in ("train", "val", "test"))}
  FROM v_images i JOIN assigned a ON i.patient_id = a.patient_id GROUP BY fold)
SELECT '[' || string_agg('{{"fold":"' || fold || '"' || {" || ".join(f"""',"{c}":' || {c}""" for c in FOLD_COUNTS)} || '}}', ',' ORDER BY fold) || ']' AS value FROM s""")
def folds_summary_json(spark, sf_dir):
    folder = scratch_folder(spark, "folds")
    publication.publish(spark, folder, {"folds_summary": publication.Table(publication.json_list(kfold_summary(spark, sf_dir), "fold"), "text")})
    return publication.published(spark, folder, "folds_summary", check=True)


# Balance

LABELS = f"{v.IMAGES}, l AS (SELECT image_path, CASE class WHEN 'Normal' THEN 0 ELSE 1 END AS label FROM v_images)"


def labels(spark, sf_dir):
    return label_encode(spark, sf_dir).select("image_path", "label")


@query(f"WITH {LABELS} SELECT CAST(c AS INTEGER) AS label, count(label) AS n FROM (SELECT unnest([0, 1, 2]) AS c) LEFT JOIN l ON c = label GROUP BY c")
def class_counts(spark, sf_dir):
    return balance.class_counts(labels(spark, sf_dir), 3)


@query(f"""WITH {LABELS}, n AS (SELECT label, 1.0::DOUBLE / greatest(count(*), 1) AS i FROM l GROUP BY label)
SELECT label, round(CAST(CAST(i / sum(i) OVER () * 2 AS FLOAT) AS DOUBLE), 6) AS weight FROM n""")
def class_weights(spark, sf_dir):
    weights = balance.class_weights(labels(spark, sf_dir), 2)
    return rounded(weights.withColumn("weight", F.col("weight").cast("double")), "weight")


@query(f"""WITH {LABELS}, n AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) AS n FROM l), d AS (
  SELECT draw, CASE WHEN uc * (n0 * 0.6::DOUBLE + n1 * 1.0::DOUBLE) < n0 * 0.6::DOUBLE THEN 0 ELSE 1 END AS label, ur, n0, n1 FROM (
    SELECT draw, n0, n1, CAST(concat('0x', substr(md5('42:class:' || draw), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS uc,
      CAST(concat('0x', substr(md5('42:row:' || draw), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS ur
    FROM n, (SELECT unnest(range((SELECT n FROM n))) AS draw))
), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || image_path), image_path) - 1 AS pos FROM l)
SELECT draw, d.label, image_path FROM d JOIN r ON d.label = r.label AND pos = floor(ur * CASE d.label WHEN 0 THEN n0 ELSE n1 END)""")
def weighted_sample(spark, sf_dir):
    return balance.weighted_sample(labels(spark, sf_dir), "image_path", [0.6, 1.0])


@query(f"WITH {LABELS} SELECT image_path, label, row_number() OVER (ORDER BY md5('42:0:' || image_path), image_path) - 1 AS draw FROM l")
def shuffle_plain(spark, sf_dir):
    return balance.shuffled(labels(spark, sf_dir), "image_path")


# Metrics


def confusion_sql(level: str) -> str:
    hit = f"prob >= CAST({level} AS FLOAT)"
    cells = {"tn": f"y = 0 AND NOT {hit}", "fp": f"y = 0 AND {hit}", "fn": f"y = 1 AND NOT {hit}", "tp": f"y = 1 AND {hit}"}
    return ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in cells.items())


RATES = """CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1"""


def auc_sql(source: str, by: str = "") -> str:
    key, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""SELECT {key}CAST(sum(p * (2 * coalesce(b, 0) + n)) AS DOUBLE) / (2 * CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS auc FROM (
    SELECT *, sum(n) OVER ({part} ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (
      SELECT {key}prob, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM {source} GROUP BY {key}prob)){f" GROUP BY {by}" if by else ""}"""


@query(f"WITH {v.SCORES} SELECT {confusion_sql('0.5')} FROM v_scores")
def confusion_05(spark, sf_dir):
    return v.scores(spark, sf_dir).agg(*metrics.confusion(0.5))


@query(f"""WITH {v.SCORES}, c AS (SELECT {confusion_sql("0.5")} FROM v_scores), a AS ({auc_sql("v_scores")}), r AS (SELECT *, {RATES} FROM c, a)
SELECT round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1, round(auc, 6) AS auc, tn, fp, fn, tp FROM r""")
def binary_metrics(spark, sf_dir):
    return rounded(metrics.binary_metrics(v.scores(spark, sf_dir)), "recall", "specificity", "f1", "auc")


@query(f"WITH {v.SCORES} SELECT round(auc, 9) AS auc FROM ({auc_sql('v_scores')})")
def auroc(spark, sf_dir):
    return rounded(metrics.auroc(v.scores(spark, sf_dir)), "auc", digits=9)


def curve_sql(source: str) -> str:
    """CTEs g (the grid) and curve."""
    return f"""g AS (
  SELECT i + 1 AS step, CASE WHEN i = 180 THEN 0.95::DOUBLE ELSE i * ((0.95::DOUBLE - 0.05::DOUBLE) / 180) + 0.05::DOUBLE END AS threshold
  FROM (SELECT unnest(range(181)) AS i)
), e AS (SELECT prob, y, count(*) AS m FROM {source} GROUP BY prob, y), n AS (
  SELECT step, threshold, CAST(sum(CASE WHEN y = 0 AND prob < CAST(threshold AS FLOAT) THEN m ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN y = 0 AND prob >= CAST(threshold AS FLOAT) THEN m ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN y = 1 AND prob < CAST(threshold AS FLOAT) THEN m ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN y = 1 AND prob >= CAST(threshold AS FLOAT) THEN m ELSE 0 END) AS BIGINT) AS tp
  FROM g, e GROUP BY step, threshold
), curve AS (
  SELECT step, threshold, tn, fp, fn, tp, recall + specificity - 1 AS youden_j, f1,
    (recall + specificity) / (CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END + CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END) AS balanced_accuracy
  FROM (SELECT *, {RATES} FROM n)
)"""


@query(f"""WITH {v.SCORES}, {curve_sql("v_scores")} SELECT CAST(step AS INTEGER) AS step, round(threshold, 6) AS threshold, tn, fp, fn, tp,
  round(youden_j, 6) AS youden_j, round(f1, 6) AS f1, round(balanced_accuracy, 6) AS balanced_accuracy FROM curve""")
def threshold_curve(spark, sf_dir):
    return rounded(threshold.curve(v.scores(spark, sf_dir)), "threshold", "youden_j", "f1", "balanced_accuracy")


def choose_sql(metric: str) -> str:
    """The recursive CTE `best`, whose last row holds the choice."""
    better = f"{metric} > s OR (abs({metric} - s) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(s) AND abs(threshold - 0.5) < abs(t - 0.5))"
    return f"""best AS (
  SELECT CAST(0 AS BIGINT) AS step, 0.5::DOUBLE AS t, '-inf'::DOUBLE AS s
  UNION ALL SELECT c.step, CASE WHEN {better} THEN threshold ELSE t END, CASE WHEN {better} THEN {metric} ELSE s END FROM best b JOIN curve c ON c.step = b.step + 1
)"""


def chosen(metric: str) -> str:
    return f"WITH RECURSIVE {v.SCORES}, {curve_sql('v_scores')}, {choose_sql(metric)} SELECT round(t, 6) AS threshold, round(s, 6) AS score FROM best WHERE step = 181"


def choice(spark, sf_dir, metric):
    return rounded(threshold.optimize(v.scores(spark, sf_dir), metric), "threshold", "score")


@query(chosen("youden_j"))
def threshold_youden(spark, sf_dir):
    return choice(spark, sf_dir, "youden_j")


@query(chosen("f1"))
def threshold_f1(spark, sf_dir):
    return choice(spark, sf_dir, "f1")


@query(chosen("balanced_accuracy"))
def threshold_bacc(spark, sf_dir):
    return choice(spark, sf_dir, "balanced_accuracy")


TUNED = f"""{v.SCORES}, v_val AS (SELECT * FROM v_scores WHERE k % 2 = 0), v_test AS (SELECT * FROM v_scores WHERE k % 2 = 1),
{curve_sql("v_val")}, {choose_sql("youden_j")}, tuned AS (SELECT t FROM best WHERE step = 181)"""


def tuned(scores: DataFrame) -> tuple[DataFrame, float]:
    """The odd half, and the threshold tuned on the even half."""
    return scores.where("k % 2 = 1"), threshold.optimize(scores.where("k % 2 = 0")).first()["threshold"]


@query(f"""WITH RECURSIVE {TUNED}, c AS (
  SELECT '0_5' AS at_, 0.5::DOUBLE AS threshold, {confusion_sql("0.5")} FROM v_test
  UNION ALL SELECT 'optimized', any_value(t), {confusion_sql("t")} FROM v_test, tuned
), a AS ({auc_sql("v_test")}), r AS (SELECT *, {RATES} FROM c, a)
SELECT at_ AS "at", round(threshold, 6) AS threshold, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1,
  round(auc, 6) AS auc, concat('[[', tn, ', ', fp, '], [', fn, ', ', tp, ']]') AS matrix FROM r""")
def evaluation_report(spark, sf_dir):
    report = rounded(metrics.evaluation(*tuned(v.scores(spark, sf_dir))), "threshold", "recall", "specificity", "f1", "auc")
    cells = [F.col("matrix")[i][j].cast("string") for i in (0, 1) for j in (0, 1)]
    text = F.concat(F.lit("[["), cells[0], F.lit(", "), cells[1], F.lit("], ["), cells[2], F.lit(", "), cells[3], F.lit("]]"))
    return report.withColumn("matrix", text)


@query(f"""WITH RECURSIVE {TUNED} SELECT k || '/' || line AS image_path, y AS true_label, round(CAST(prob AS DOUBLE), 6) AS prob_sick,
  CASE WHEN prob >= 0.5::FLOAT THEN 1 ELSE 0 END AS pred_label_thr_0_5, CASE WHEN prob >= CAST(t AS FLOAT) THEN 1 ELSE 0 END AS pred_label_thr_opt FROM v_test, tuned""")
def test_predictions(spark, sf_dir):
    rows, level = tuned(v.scores(spark, sf_dir))
    named = rows.withColumn("image_path", F.concat_ws("/", F.col("k").cast("string"), F.col("line").cast("string")))
    return rounded(metrics.predictions(named, level, "image_path"), "prob_sick")


LOG_LOSS = """avg(-ln(CASE WHEN y = 1 THEN greatest(least(CAST(prob AS DOUBLE), 1 - 1e-7::DOUBLE), 1e-7::DOUBLE)
  ELSE 1 - greatest(least(CAST(prob AS DOUBLE), 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) END))"""
EPOCH_COLUMNS = [f"{p}_{m}" for p in ("train", "val") for m in ("loss", "recall", "specificity", "f1", "auc")]


@query(f"""WITH {v.SCORES}, s AS (SELECT CAST(month(day) AS INTEGER) AS epoch, CASE WHEN k % 2 = 1 THEN 'train' ELSE 'val' END AS phase, y, prob FROM v_scores),
c AS (SELECT epoch, phase, {confusion_sql("0.5")}, {LOG_LOSS} AS loss FROM s GROUP BY epoch, phase), a AS ({auc_sql("s", "epoch, phase")}),
r AS (SELECT c.epoch, c.phase, loss, {RATES}, auc FROM c JOIN a ON c.epoch = a.epoch AND c.phase = a.phase)
SELECT epoch, {", ".join(f"round(max({c.split('_', 1)[1]}) FILTER (phase = '{c.split('_', 1)[0]}'), 6) AS {c}" for c in EPOCH_COLUMNS)} FROM r GROUP BY epoch""")
def epoch_metrics(spark, sf_dir):
    rows = v.scores(spark, sf_dir)
    phase = F.when(F.col("k") % 2 == 1, "train").otherwise("val")
    return rounded(metrics.epoch_metrics(rows.select(F.month("day").alias("epoch"), phase.alias("phase"), "y", "prob")), *EPOCH_COLUMNS)


@query(f"""WITH {v.SCORES}, c AS (SELECT k % 10 AS fold, {confusion_sql("0.5")} FROM v_scores GROUP BY fold), r AS (SELECT *, {RATES} FROM c)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
FROM (UNPIVOT r ON recall, specificity, f1 INTO NAME metric VALUE value) GROUP BY metric""")
def fold_mean_std(spark, sf_dir):
    folds = v.scores(spark, sf_dir).groupBy((F.col("k") % 10).alias("fold")).agg(*metrics.confusion(0.5)).withColumns(metrics.rates())
    return rounded(metrics.fold_spread(folds, ["recall", "specificity", "f1"]), "mean", "std")


def fold_choice_sql(metric: str) -> str:
    """The choice of each fold of v_folds: the walk of choose_sql, all folds abreast."""
    better = f"{metric} > s OR (abs({metric} - s) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(s) AND abs(threshold - 0.5) < abs(t - 0.5))"
    return f"""e AS (SELECT fold, prob, y, count(*) AS m FROM v_folds GROUP BY ALL), n AS (
  SELECT fold, step, threshold, {", ".join(f"CAST(sum(CASE WHEN y = {y} AND prob {op} CAST(threshold AS FLOAT) THEN m ELSE 0 END) AS BIGINT) AS {c}" for c, y, op in (("tn", 0, "<"), ("fp", 0, ">="), ("fn", 1, "<"), ("tp", 1, ">=")))}
  FROM g, e GROUP BY fold, step, threshold
), curve AS (SELECT fold, step, threshold, recall + specificity - 1 AS youden_j FROM (SELECT *, {RATES} FROM n)), best AS (
  SELECT DISTINCT fold, CAST(0 AS BIGINT) AS step, 0.5::DOUBLE AS t, '-inf'::DOUBLE AS s FROM e
  UNION ALL SELECT c.fold, c.step, CASE WHEN {better} THEN threshold ELSE t END, CASE WHEN {better} THEN {metric} ELSE s END
    FROM best b JOIN curve c ON c.fold = b.fold AND c.step = b.step + 1
)"""


GRID = curve_sql("v_scores").split("), e AS")[0] + ")"


@query(f"""WITH RECURSIVE {v.SCORES}, v_folds AS (SELECT k % 10 AS fold, y, prob FROM v_scores), {GRID}, {fold_choice_sql("youden_j")}
SELECT fold, round(t, 6) AS threshold, round(s, 6) AS score FROM best WHERE step = 181""")
def fold_thresholds(spark, sf_dir):
    rows = v.scores(spark, sf_dir).withColumn("fold", F.col("k") % 10)
    return rounded(threshold.optimize(rows, "youden_j", by=("fold",)), "threshold", "score")


# Losses

SOFT = "list_transform({l}, lambda x: exp(x - list_max({l})) / list_sum(list_transform({l}, lambda z: exp(z - list_max({l})))))"
LOGP = "list_transform({l}, lambda x: x - list_max({l}) - ln(list_sum(list_transform({l}, lambda z: exp(z - list_max({l}))))))"


@query(f"WITH {v.LOGITS} SELECT id, i - 1 AS class_id, round(p[i], 6) AS p FROM (SELECT id, {SOFT.format(l='logits')} AS p FROM v_logits), (SELECT unnest(range(1, 11)) AS i)")
def softmax_rows(spark, sf_dir):
    rows = v.logits(spark, sf_dir).select("id", F.posexplode(pr.softmax(F.col("logits"))).alias("class_id", "p"))
    return rounded(rows.withColumn("class_id", F.col("class_id").cast("long")), "p")


@query(f"""WITH {v.LOGITS}, p AS (SELECT id, {SOFT.format(l="logits")} AS p FROM v_binary)
SELECT id, CASE WHEN p[2] >= 0.5 THEN 1 ELSE 0 END AS predicted_label, CASE WHEN p[2] >= 0.5 THEN 'Sick' ELSE 'Normal' END AS predicted_class,
  round(p[1], 6) AS prob_normal, round(p[2], 6) AS prob_sick, round(greatest(p[1], p[2]), 6) AS confidence, 0.5::DOUBLE AS threshold FROM p""")
def batch_predict(spark, sf_dir):
    return rounded(scoring.predict(v.logits(spark, sf_dir, True), "id"), "prob_normal", "prob_sick", "confidence")


def terms(source: str, weights: str) -> str:
    return f"SELECT id, y, p, {weights} AS w, -p[y + 1] * {weights}[y + 1] AS nll, {weights}[y + 1] AS wy FROM (SELECT id, y, {LOGP.format(l='logits')} AS p FROM {source})"


ONES, PAIR = "list_transform(range(10), lambda x: 1.0::DOUBLE)", "[0.6::DOUBLE, 1.0::DOUBLE]"


@query(f"WITH {v.LOGITS} SELECT round(sum(nll) / sum(wy), 6) AS loss FROM ({terms('v_logits', ONES)})")
def ce_loss(spark, sf_dir):
    return rounded(losses.cross_entropy(v.logits(spark, sf_dir)), "loss")


@query(f"WITH {v.LOGITS} SELECT round(sum(nll) / sum(wy), 6) AS loss FROM ({terms('v_binary', PAIR)})")
def weighted_ce_loss(spark, sf_dir):
    return rounded(losses.cross_entropy(v.logits(spark, sf_dir, True), [0.6, 1.0]), "loss")


@query(f"""WITH {v.LOGITS} SELECT round((0.9::DOUBLE * sum(nll) + 0.1::DOUBLE / 2 * sum(-(p[1] * w[1] + p[2] * w[2]))) / sum(wy), 6) AS loss
FROM ({terms("v_binary", PAIR)})""")
def smoothed_ce_loss(spark, sf_dir):
    return rounded(losses.cross_entropy(v.logits(spark, sf_dir, True), [0.6, 1.0], smoothing=0.1), "loss")


@query(f"WITH {v.LOGITS} SELECT round(avg((1 - exp(-nll)) * (1 - exp(-nll)) * nll), 6) AS loss FROM ({terms('v_binary', PAIR)})")
def focal_loss(spark, sf_dir):
    return rounded(losses.focal(v.logits(spark, sf_dir, True), 2.0, [0.6, 1.0]), "loss")


@query(f"""WITH {v.LOGITS}, b AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 64 AS batch FROM ({terms("v_logits", ONES)}))
SELECT round(avg(l), 6) AS loss FROM (SELECT sum(nll) / sum(wy) AS l FROM b GROUP BY batch)""")
def epoch_loss(spark, sf_dir):
    return rounded(losses.epoch_loss(v.logits(spark, sf_dir), "id"), "loss")


DICE = f"""{v.VOXELS}, s AS (SELECT y, {SOFT.format(l="logits")} AS p FROM v_voxels), d AS (
  SELECT c, (2 * sum(CASE WHEN y = c THEN p[c + 1] ELSE 0 END) + 1e-5::DOUBLE) / (sum(p[c + 1]) + sum(CASE WHEN y = c THEN 1 ELSE 0 END) + 1e-5::DOUBLE) AS dice
  FROM s, (SELECT unnest([1, 2]) AS c) GROUP BY c)"""


@query(f"WITH {DICE} SELECT round(1 - avg(dice), 6) AS loss FROM d")
def dice_loss(spark, sf_dir):
    return rounded(losses.dice(v.voxels(spark, sf_dir), 3), "loss")


@query(f"WITH {DICE} SELECT round((SELECT 1 - avg(dice) FROM d) + (SELECT avg(-ln(p[y + 1])) FROM s), 6) AS loss")
def dice_ce_loss(spark, sf_dir):
    return rounded(losses.dice_ce(v.voxels(spark, sf_dir), 3), "loss")


# History

IMPROVED = f"""{v.HISTORY}, i AS (
  SELECT epoch, val_recall AS value,
    val_recall > coalesce(max(val_recall) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS improved FROM v_history)"""


@query(f"WITH {IMPROVED} SELECT epoch, round(value, 6) AS value FROM i WHERE improved ORDER BY epoch DESC LIMIT 1")
def best_epoch(spark, sf_dir):
    return rounded(history.best_epoch(v.history(spark, sf_dir)), "value")


@query(f"""WITH {IMPROVED}, n AS (SELECT *, row_number() OVER (ORDER BY epoch) AS nth FROM i), w AS (
  SELECT *, nth - coalesce(max(CASE WHEN improved THEN nth END) OVER (ORDER BY epoch), 0) AS waited FROM n
), o AS (SELECT *, coalesce(max(waited) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 8 AS over_ FROM w)
SELECT epoch, round(value, 6) AS value, improved, CAST(waited AS INTEGER) AS waited, waited >= 8 AS stops FROM o WHERE NOT over_""")
def early_stop(spark, sf_dir):
    return rounded(history.early_stop(v.history(spark, sf_dir)), "value")


# Pixels: one row for each pixel, so that values compare as numbers


def spread(images: DataFrame, digits: int | None = None) -> DataFrame:
    # outer: else a filter on the pixels is pushed down through all steps that make them
    rows = images.select("image_id", F.posexplode_outer("pixels").alias("at_", "value"))
    value = F.col("value") if digits is None else F.round(F.col("value").cast("double"), digits)
    return rows.select("image_id", F.col("at_").cast("long").alias("place"), value.alias("value"))


def unspread(pixel: str, size: str = "64") -> str:
    return f"SELECT image_id, i AS place, {pixel} AS value FROM v_pixels, (SELECT unnest(range({size})) AS i)"


@query(f"""WITH {v.PIXELS} {unspread("round(CAST(CAST((CAST(CAST(pixels[i % 64 + 1] AS DOUBLE) / 255 AS FLOAT) - CAST([0.485, 0.456, 0.406][i // 64 + 1] AS DOUBLE)) / CAST([0.229, 0.224, 0.225][i // 64 + 1] AS DOUBLE) AS FLOAT) AS DOUBLE), 4)", "192")}""")
def pixels_prepare(spark, sf_dir):
    return spread(pixels.prepare(v.pixels(spark, sf_dir), size=None, channels=3), 4)


@query(f"WITH {v.PIXELS} {unspread('(19595 * (255 - pixels[i + 1]) + 38470 * pixels[64 - i] + 7471 * pixels[i + 1] + 32768) >> 16')}")
def pixels_gray(spark, sf_dir):
    return spread(pixels.gray(v.pixels(spark, sf_dir, True)))


TRIANGLE = """t AS (SELECT o, x, greatest(0, 1 - abs((x + 0.5::DOUBLE - (o + 0.5::DOUBLE) * 1.6::DOUBLE) / 1.6::DOUBLE)) AS w FROM
  (SELECT unnest(range(5)) AS o), (SELECT unnest(range(8)) AS x)
  WHERE x >= floor(greatest(0, (o + 0.5::DOUBLE) * 1.6::DOUBLE - 1.6::DOUBLE + 0.5)) AND x < floor((o + 0.5::DOUBLE) * 1.6::DOUBLE + 1.6::DOUBLE + 0.5)
), n AS (SELECT o, x, w / sum(w) OVER (PARTITION BY o) AS w FROM t)"""


@query(f"""WITH {v.PIXELS}, {TRIANGLE} SELECT image_id, a.o * 5 + b.o AS place, CAST(floor(round(sum(a.w * b.w * pixels[a.x * 8 + b.x + 1]), 9) + 0.5) AS INTEGER) AS value
FROM v_pixels, n a, n b GROUP BY image_id, a.o, b.o""")
def pixels_resize(spark, sf_dir):
    return spread(pixels.resize(v.pixels(spark, sf_dir), 5))


def coin_sql(name: str) -> str:
    return f"(CAST(concat('0x', substr(md5('42:0:{name}:' || image_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


@query(f"WITH {v.PIXELS} {unspread(f'CASE WHEN {coin_sql("flip")} < 0.5 THEN pixels[i // 8 * 8 + 8 - i % 8] ELSE pixels[i + 1] END')}")
def pixels_flip(spark, sf_dir):
    return spread(pixels.flip(v.pixels(spark, sf_dir)))


@query(f"""WITH {v.PIXELS}, m AS (SELECT *, CAST(round((2 * {coin_sql("dy")} - 1) * 0.2::DOUBLE * 8) AS INTEGER) AS dy,
  CAST(round((2 * {coin_sql("dx")} - 1) * 0.2::DOUBLE * 8) AS INTEGER) AS dx FROM v_pixels)
SELECT image_id, i AS place, CASE WHEN i // 8 - dy BETWEEN 0 AND 7 AND i % 8 - dx BETWEEN 0 AND 7 THEN pixels[(i // 8 - dy) * 8 + i % 8 - dx + 1] ELSE 0 END AS value
FROM m, (SELECT unnest(range(64)) AS i)""")
def pixels_translate(spark, sf_dir):
    return spread(pixels.translate(v.pixels(spark, sf_dir), 0.2))


def grain(at: int) -> str:
    return f"CAST(CAST(concat('0x', substr(md5('42:0:grain:' || image_id || ':' || i), {at}, 13)) AS BIGINT) AS DOUBLE)"


NEAR = " + ".join(f"pixels[i + {a * 8 + b} + 1]" for a in (-1, 0, 1) for b in (-1, 0, 1))
SMOOTH = f"((CAST({NEAR} AS DOUBLE) + 4 * pixels[i + 1]) / 13)"
AUGMENTED = f"""turned AS (
  SELECT image_id, list_transform(range(64), lambda i: CASE WHEN sy(i, a) BETWEEN 0 AND 7 AND sx(i, a) BETWEEN 0 AND 7 THEN pixels[sy(i, a) * 8 + sx(i, a) + 1] ELSE 0 END) AS pixels
  FROM (SELECT *, radians((2 * {coin_sql("rotate")} - 1) * 15) AS a FROM v_pixels)
), flipped AS (
  SELECT image_id, list_transform(range(64), lambda i: CASE WHEN coin < 0.5 THEN pixels[i // 8 * 8 + 8 - i % 8] ELSE pixels[i + 1] END) AS pixels
  FROM (SELECT *, {coin_sql("flip")} AS coin FROM turned)
), shifted AS (
  SELECT image_id, list_transform(range(64), lambda i: CASE WHEN i // 8 - dy BETWEEN 0 AND 7 AND i % 8 - dx BETWEEN 0 AND 7 THEN pixels[(i // 8 - dy) * 8 + i % 8 - dx + 1] ELSE 0 END) AS pixels
  FROM (SELECT *, CAST(round((2 * {coin_sql("dy")} - 1) * 0.1::DOUBLE * 8) AS INTEGER) AS dy, CAST(round((2 * {coin_sql("dx")} - 1) * 0.1::DOUBLE * 8) AS INTEGER) AS dx FROM flipped)
), sharp AS (
  SELECT image_id, list_transform(range(64), lambda i: CASE WHEN coin < 0.3 AND i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6
    THEN CAST(floor(greatest(0, least(255, {SMOOTH} + 1.2::DOUBLE * (pixels[i + 1] - {SMOOTH}))) + 0.5::DOUBLE) AS INTEGER) ELSE pixels[i + 1] END) AS pixels
  FROM (SELECT *, {coin_sql("sharpen")} AS coin FROM shifted)
), pixel AS (
  SELECT image_id, i, CAST(CAST(CAST(pixels[i + 1] AS DOUBLE) / 255 AS FLOAT) AS DOUBLE) AS value, {coin_sql("noise")} AS coin FROM sharp, (SELECT unnest(range(64)) AS i)
), noisy AS (
  SELECT image_id, i, CASE WHEN coin < 0.3 THEN CAST(CAST(greatest(0, least(1, value + 0.01::DOUBLE * sqrt(-2 * ln(({grain(1)} + 1) / 4503599627370496.0::DOUBLE))
    * cos(2 * pi() * {grain(14)} / 4503599627370496.0::DOUBLE))) AS FLOAT) AS DOUBLE) ELSE value END AS value FROM pixel
)"""
TURN = "CAST(floor({0}(a) * (i % 8 - 3.5::DOUBLE) {1} {2}(a) * (i // 8 - 3.5::DOUBLE) + 3.5::DOUBLE + 0.5::DOUBLE) AS INTEGER)"
AUGMENTED = AUGMENTED.replace("sx(i, a)", TURN.format("cos", "-", "sin")).replace("sy(i, a)", TURN.format("sin", "+", "cos"))


@query(f"WITH {v.PIXELS}, {AUGMENTED} SELECT image_id, i AS place, round(CAST(CAST((value - 0.5) / 0.5 AS FLOAT) AS DOUBLE), 4) AS value FROM noisy")
def pixels_augment(spark, sf_dir):
    return spread(pixels.prepare(v.pixels(spark, sf_dir), size=8, train=True), 4)


# Head

COEF, INTERCEPT = [[((i * 7) % 11 - 5) / 5 for i in range(64)], [((i * 5) % 13 - 6) / 6 for i in range(64)]], [0.1, -0.1]


@query(f"""WITH l AS (SELECT vec_id AS id, {", ".join(f"list_sum([{', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) * {w!r}::DOUBLE' for i, w in enumerate(ws))}]) + {b}::DOUBLE AS l{k}" for k, (ws, b) in enumerate(zip(COEF, INTERCEPT, strict=True)))} FROM embeddings)
SELECT id, round(l0, 6) AS logit_normal, round(l1, 6) AS logit_sick, round(CAST(CAST(1 / (1 + exp(l0 - l1)) AS FLOAT) AS DOUBLE), 5) AS prob_sick FROM l""")
def score_table(spark, sf_dir):
    rows = scoring.score(v.features(spark, sf_dir), COEF, INTERCEPT)
    rows = rows.select("id", F.col("logits")[0].alias("logit_normal"), F.col("logits")[1].alias("logit_sick"), F.col("prob_sick").cast("double").alias("prob_sick"))
    return rounded(rounded(rows, "logit_normal", "logit_sick"), "prob_sick", digits=5)


#: A luma with the byte's place, a tensor of one channel around 0, and the two logits of the head.
PREDICTED = f"""luma AS (
  SELECT image_id, list_transform(range(64), lambda i: (CAST(CAST(CAST((19595 * (255 - pixels[i + 1]) + 38470 * pixels[64 - i] + 7471 * pixels[i + 1] + 32768) >> 16 AS DOUBLE) / 255 AS FLOAT) AS DOUBLE) - 0.5) / 0.5) AS x
  FROM v_pixels
), l AS (SELECT image_id, {", ".join(f"list_sum([{', '.join(f'CAST(CAST(x[{i + 1}] AS FLOAT) AS DOUBLE) * {w!r}::DOUBLE' for i, w in enumerate(ws))}]) + {b}::DOUBLE AS l{k}" for k, (ws, b) in enumerate(zip(COEF, INTERCEPT, strict=True)))} FROM luma
), p AS (SELECT image_id, 1 / (1 + exp(l1 - l0)) AS n, 1 / (1 + exp(l0 - l1)) AS s FROM l)"""


@query(f"""WITH {v.PIXELS}, {PREDICTED} SELECT image_id, CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS predicted_label, CASE WHEN s >= 0.5 THEN 'Sick' ELSE 'Normal' END AS predicted_class,
  round(n, 5) AS prob_normal, round(s, 5) AS prob_sick, round(greatest(n, s), 5) AS confidence, 0.5::DOUBLE AS threshold FROM p""")
def image_predict(spark, sf_dir):
    model = {"coef": COEF, "intercept": INTERCEPT}
    return rounded(scoring.predict_images(v.pixels(spark, sf_dir, True), model, size=None), "prob_normal", "prob_sick", "confidence", digits=5)


def logits_sql(models: list[tuple[list, list]], name: str = "l") -> str:
    """CTE of vec_id, y and both logits of each model, by its place m."""
    line = lambda ws, b: f"list_sum([{', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) * {w!r}::DOUBLE' for i, w in enumerate(ws))}]) + {b!r}::DOUBLE"
    each = [f"SELECT {m} AS m, vec_id AS id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, {line(c[0], b[0])} AS l0, {line(c[1], b[1])} AS l1 FROM embeddings" for m, (c, b) in enumerate(models)]
    return f"{name} AS ({' UNION ALL '.join(each)})"


#: The sums of one gradient step under fixed weights: of weighted cross-entropy and of focal loss.
STEP_SQL = f"""WITH {logits_sql([(COEF, INTERCEPT)])}, p AS (
  SELECT id, y, 1 / (1 + exp(l1 - l0)) AS p0, 1 / (1 + exp(l0 - l1)) AS p1, CASE y WHEN 0 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS w FROM l
), c AS (SELECT *, -ln(CASE y WHEN 0 THEN p0 ELSE p1 END) * w AS ce FROM p), k AS (
  SELECT 'weighted_ce' AS loss_name, id, y, p0, p1, w, ce AS loss, w AS weight, 1.0::DOUBLE AS slope FROM c
  UNION ALL SELECT 'focal', id, y, p0, p1, w, (1 - exp(-ce)) * (1 - exp(-ce)) * ce, 1.0::DOUBLE, 2 * (1 - exp(-ce)) * exp(-ce) * ce + (1 - exp(-ce)) * (1 - exp(-ce)) FROM c
), s AS (SELECT loss_name, id, loss, weight, [slope * w * (p0 - CASE y WHEN 0 THEN 1 ELSE 0 END), slope * w * (p1 - CASE y WHEN 1 THEN 1 ELSE 0 END)] AS step FROM k)
SELECT loss_name, 0 AS at_place, round(sum(loss), 6) AS value FROM s GROUP BY loss_name
UNION ALL SELECT loss_name, 1, round(sum(weight), 6) FROM s GROUP BY loss_name
UNION ALL SELECT loss_name, CAST(2 + c * 64 + i AS INTEGER), round(sum(step[c + 1] * CAST(embedding[i + 1] AS DOUBLE)), 6)
  FROM s JOIN embeddings ON vec_id = id, (SELECT unnest([0, 1]) AS c), (SELECT unnest(range(64)) AS i) GROUP BY loss_name, c, i
UNION ALL SELECT loss_name, CAST(130 + c AS INTEGER), round(sum(step[c + 1]), 6) FROM s, (SELECT unnest([0, 1]) AS c) GROUP BY loss_name, c"""


@query(STEP_SQL)
def head_step(spark, sf_dir):
    rows, model = v.features(spark, sf_dir), {"coef": COEF, "intercept": INTERCEPT}
    found = [(k, i, float(x)) for k in ("weighted_ce", "focal") for i, x in enumerate(head.gradient(rows, model, loss=k))]
    return rounded(spark.createDataFrame(found, "loss_name string, at_place int, value double"), "value")


HEAD_SCORES = f"""{logits_sql([(COEF, INTERCEPT)])}, v_scores AS (SELECT id AS k, y, CAST(1 / (1 + exp(l0 - l1)) AS FLOAT) AS prob FROM l),
v_val AS (SELECT * FROM v_scores WHERE k % 10 = 8), v_test AS (SELECT * FROM v_scores WHERE k % 10 = 9), {curve_sql("v_val")}, {choose_sql("youden_j")},
tuned AS (SELECT t FROM best WHERE step = 181)"""


@query(f"""WITH RECURSIVE {HEAD_SCORES}, c AS (
  SELECT '0_5' AS at_, 0.5::DOUBLE AS threshold, {confusion_sql("0.5")} FROM v_test
  UNION ALL SELECT 'optimized', any_value(t), {confusion_sql("t")} FROM v_test, tuned
), a AS ({auc_sql("v_test")}), r AS (SELECT *, {RATES} FROM c, a)
SELECT at_ AS "at", round(threshold, 6) AS threshold, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1, round(auc, 6) AS auc, tn, fp, fn, tp FROM r""")
def head_report_fixed(spark, sf_dir):
    _, val, test = parts(spark, sf_dir)
    rows = rounded(head.report(val, test, {"coef": COEF, "intercept": INTERCEPT}), "threshold", "recall", "specificity", "f1", "auc")
    cells = {c: F.col("matrix")[i][j] for c, (i, j) in zip(metrics.COUNTS, ((0, 0), (0, 1), (1, 0), (1, 1)), strict=True)}
    return rows.withColumns(cells).drop("matrix")


@query(f"""WITH RECURSIVE {HEAD_SCORES}, b AS (
  SELECT y, -ln(CASE y WHEN 0 THEN 1 / (1 + exp(l1 - l0)) ELSE 1 / (1 + exp(l0 - l1)) END) AS nll, CASE y WHEN 0 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS w,
    (row_number() OVER (ORDER BY id) - 1) // 64 AS batch FROM l WHERE id % 10 = 9
), o AS (SELECT avg(loss) AS test_loss FROM (SELECT sum(nll * w) / sum(w) AS loss FROM b GROUP BY batch)), c AS (
  SELECT '0_5' AS at_, {confusion_sql("0.5")} FROM v_test UNION ALL SELECT 'optimized', {confusion_sql("t")} FROM v_test, tuned
), a AS ({auc_sql("v_test")}), r AS (SELECT *, {RATES} FROM c, a), f AS (
  SELECT {", ".join(f"max({m}) FILTER (at_ = '{k}') AS {m}_{k}" for k in ("0_5", "optimized") for m in ("recall", "specificity", "f1", "auc", "tn", "fp", "fn", "tp"))} FROM r
)
SELECT 'fixed' AS run_name, 3 AS best_epoch, 0.5::DOUBLE AS best_score, 'val_recall' AS save_best_metric, round(t, 6) AS val_optimized_threshold,
  'youden_j' AS val_optimized_threshold_metric, round(s, 6) AS val_optimized_threshold_score, round(test_loss, 6) AS test_loss,
  {", ".join(f"{f'round({m}_{k}, 6)' if m in ('recall', 'specificity', 'f1', 'auc') else f'{m}_{k}'} AS {m}_{k}" for k in ("0_5", "optimized") for m in ("recall", "specificity", "f1", "auc", "tn", "fp", "fn", "tp"))},
  {", ".join(f"concat('[[', tn_{k}, ',', fp_{k}, '],[', fn_{k}, ',', tp_{k}, ']]') AS matrix_{k}" for k in ("0_5", "optimized"))}
FROM f, o, best WHERE step = 181""")
def report_json(spark, sf_dir):
    """The test report of a fixed head, written as one nested JSON record and read back."""
    _, val, test = parts(spark, sf_dir)
    model = {"coef": COEF, "intercept": INTERCEPT, "epoch": 3, "best_score": 0.5}
    chosen = threshold.optimize(head.scored(val, model)).first()
    rows = head.scored(test, model)
    loss = losses.epoch_loss(rows, "id", weights=[0.6, 1.0]).first()["loss"]
    record = metrics.report_record(metrics.histogram(rows), (chosen["threshold"], chosen["score"]), model, loss, "fixed")
    folder = scratch_folder(spark, "report")
    publication.publish(spark, folder, {"test_metrics": publication.Table(record, "json")})
    held = publication.published(spark, folder, "test_metrics", check=True)
    flat = []
    for k in ("0_5", "optimized"):
        own = F.col(f"test_metrics_threshold_{k}")
        flat += [F.round(own[m], 6).alias(f"{m}_{k}") for m in head.MEASURES] + [own[c].alias(f"{c}_{k}") for c in metrics.COUNTS]
        flat.append(F.to_json(F.col(f"confusion_matrix_threshold_{k}")).alias(f"matrix_{k}"))
    plain = [c for c in held.columns if not c.endswith(("_0_5", "_optimized"))]
    return rounded(held.select(*plain, *flat), "val_optimized_threshold", "val_optimized_threshold_score", "test_loss")


#: Fixed heads of ten folds: the weights of the first, turned by a place a fold.
FOLD_MODELS = [([ws[f:] + ws[:f] for ws in COEF], [b + f / 50 for b in INTERCEPT]) for f in range(10)]


@query(f"""WITH {logits_sql(FOLD_MODELS)}, v_folds AS (SELECT m AS fold, y, CAST(1 / (1 + exp(l0 - l1)) AS FLOAT) AS prob FROM l WHERE id % 10 = m),
c AS (SELECT fold, {confusion_sql("0.5")} FROM v_folds GROUP BY fold), a AS ({auc_sql("v_folds", "fold")}), r AS (SELECT recall, specificity, f1, auc FROM (SELECT *, {RATES} FROM c) x JOIN a ON x.fold = a.fold)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM (UNPIVOT r ON recall, specificity, f1, auc INTO NAME metric VALUE value) GROUP BY metric""")
def cv_mean_std(spark, sf_dir):
    """Ten fixed heads, each tested on its own fold, in one pass over the features."""
    rows = v.features(spark, sf_dir)
    assigned = rows.select("id", (F.col("id") % 10).cast("int").alias("fold"), F.lit("test").alias("split"))
    models = {f: {"coef": c, "intercept": b} for f, (c, b) in enumerate(FOLD_MODELS)}
    return rounded(metrics.fold_spread(head.fold_metrics(rows, assigned, models), ["recall", "specificity", "f1", "auc"]), "mean", "std")


def parts(spark, sf_dir):
    rows = v.features(spark, sf_dir)
    return rows.where("id % 10 < 8"), rows.where("id % 10 = 8"), rows.where("id % 10 = 9")


@query()
def head_history(spark, sf_dir):
    train, val, _ = parts(spark, sf_dir)
    rows, _ = head.fit_head(train, val)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "epoch int, " + ", ".join(f"{c} double" for c in list(rows[0])[1:]))


@query()
def head_history_batches(spark, sf_dir):
    """As the defaults train: batches of 64 rows, drawn by class weights, a short last one left out."""
    train, val, _ = parts(spark, sf_dir)
    rows, _ = head.fit_head(train, val, batch_size=64, strategy="sampler")
    return spark.createDataFrame([tuple(r.values()) for r in rows], "epoch int, " + ", ".join(f"{c} double" for c in list(rows[0])[1:]))


@query()
def head_folds(spark, sf_dir):
    """Ten heads fitted at once; the history of each. A fold tests on a tenth, validates on the next and trains on the rest."""
    rows = v.features(spark, sf_dir)
    away = F.pmod(F.col("id") - F.col("fold"), F.lit(10))
    folds = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("fold"))
    assigned = folds.withColumn("split", F.when(away == 0, "test").when(away == 1, "val").otherwise("train"))
    found = [(f, *r.values()) for f, (history_, _) in head.fit_folds(rows, assigned).items() for r in history_]
    names = ("train_loss", "val_loss", *(f"{p}_{m}" for p in ("train", "val") for m in head.MEASURES))
    return spark.createDataFrame(found, "fold int, epoch int, " + ", ".join(f"{c} double" for c in names))


@query()
def head_report(spark, sf_dir):
    train, val, test = parts(spark, sf_dir)
    _, model = head.fit_head(train, val)
    return head.report(val, test, model)
