"""Tables of the shapes the operators take, made from the given tables; the DuckDB text of each beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.select("o_orderkey", "o_custkey").join(customers.select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    named = joined.withColumn("class", F.when(F.col("c_acctbal") < 0, "Sick").otherwise("Normal"))
    named = named.withColumn("patient_id", F.concat("class", F.lit("/Directory_"), F.col("c_custkey").cast("string")))
    path = F.concat(F.lit("data/raw/"), "patient_id", F.lit("/img"), F.col("o_orderkey").cast("string"), F.lit(".png"))
    return named.select("patient_id", "class", path.alias("image_path"))


IMAGES = """v_images AS (
  SELECT patient_id, class, 'data/raw/' || patient_id || '/img' || o_orderkey || '.png' AS image_path FROM (
    SELECT o_orderkey, class, class || '/Directory_' || c_custkey AS patient_id FROM (
      SELECT o_orderkey, c_custkey, CASE WHEN c_acctbal < 0 THEN 'Sick' ELSE 'Normal' END AS class
      FROM orders JOIN customer ON o_custkey = c_custkey))
), patients AS (
  SELECT patient_id, arg_min(class, image_path) AS class FROM v_images GROUP BY patient_id
)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kind = F.when(F.col("lang") == "en", "Normal").when(F.col("lang") == "fr", "Sick").otherwise("Other")
    place = F.when(d % 17 == 0, "").otherwise(F.concat(F.lit("/Directory_"), (d % 50).cast("string"), F.lit("/series"), (d % 3).cast("string")))
    end = F.element_at(F.array(*map(F.lit, (".png", ".JPG", ".tiff", ".txt", ""))), (d % 5 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("data/raw/"), kind, place, F.lit("/img"), d.cast("string"), end).alias("path"))


PATHS = """v_paths AS (
  SELECT concat('data/raw/', CASE lang WHEN 'en' THEN 'Normal' WHEN 'fr' THEN 'Sick' ELSE 'Other' END,
    CASE WHEN doc_id % 17 = 0 THEN '' ELSE concat('/Directory_', doc_id % 50, '/series', doc_id % 3) END, '/img', doc_id,
    CASE doc_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.tiff' WHEN 3 THEN '.txt' ELSE '' END) AS path
  FROM documents
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    prob = (F.col("l_discount") * 10 * F.lit(0.6).cast("double") + F.col("l_quantity") / 50 * F.lit(0.4).cast("double")).cast("float")
    return rows.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "R").cast("int").alias("y"), prob.alias("prob"),
        F.col("l_shipdate").cast("date").alias("day"),
    )


SCORES = """v_scores AS (
  SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
    CAST(l_discount * 10 * 0.6::DOUBLE + l_quantity / 50 * 0.4::DOUBLE AS FLOAT) AS prob, CAST(l_shipdate AS DATE) AS day
  FROM lineitem
)"""


def logits(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    """All 64 elements folded into 10 (or 2) logits: number k is the sum of the elements k, k + 10, ..."""
    n = 2 if binary else 10
    values = F.array(*[sum((F.col("embedding")[i].cast("double") for i in range(k + n, 64, n)), F.col("embedding")[k].cast("double")) for k in range(n)])
    label = F.col("label") % 2 if binary else F.col("label")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), values.alias("logits"), label.cast("int").alias("y"))


def folded(n: int) -> str:
    return "[" + ", ".join(" + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(k, 64, n)) for k in range(n)) + "]"


LOGITS = f"""v_logits AS (
  SELECT vec_id AS id, {folded(10)} AS logits, label AS y FROM embeddings
), v_binary AS (
  SELECT vec_id AS id, {folded(2)} AS logits, label % 2 AS y FROM embeddings
)"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("pos"))
    values = F.transform(F.slice("embedding", F.col("pos"), F.lit(3)), lambda x: x.cast("double"))
    return rows.select(F.col("vec_id").alias("id"), "pos", values.alias("logits"), ((F.col("label") + F.col("pos")) % 3).cast("int").alias("y"))


VOXELS = """v_voxels AS (
  SELECT vec_id AS id, pos, list_transform(embedding[pos:pos + 2], lambda x: CAST(x AS DOUBLE)) AS logits, (label + pos) % 3 AS y
  FROM embeddings, (SELECT unnest(range(1, 61)) AS pos)
)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.dayofmonth("ts").alias("epoch")).agg(
        F.avg((F.col("event_type") == "purchase").cast("double")).alias("val_recall"), F.avg("value").alias("val_loss")
    )


HISTORY = """v_history AS (
  SELECT CAST(day(ts) AS INTEGER) AS epoch, avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0 END) AS val_recall, avg(value) AS val_loss
  FROM events GROUP BY 1
)"""


def pixels(spark: SparkSession, sf_dir: str, color: bool = False) -> DataFrame:
    byte = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5).cast("int")))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", byte).alias("pixels"))
    if color:
        three = F.transform(F.arrays_zip(F.col("pixels").alias("b"), F.reverse("pixels").alias("g")), lambda x: F.array(x["b"], x["g"], 255 - x["b"]))
        rows = rows.withColumn("pixels", F.flatten(three))
    return rows.select("image_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(3 if color else 1).alias("c"), "pixels")


PIXELS = """v_pixels AS (
  SELECT vec_id AS image_id,
    list_transform(embedding, lambda e: least(255, greatest(0, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INTEGER)))) AS pixels
  FROM embeddings
)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), (F.col("label") >= 5).cast("int").alias("y"))
