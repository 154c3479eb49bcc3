"""The op<N>_ queries over the given tables, and their DuckDB SQL where SQL can say them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import embeddings, fim, language, merkle, mixing, ngram_join, ordering, packing, substring_dedup, suffix_dedup, topk, toxicity, warc
from cairn.llm._io import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_model(docs: DataFrame) -> language.LanguageModel | None:
    """Learned from the documents that have a text and a lang and aren't held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    return language.train(labelled, public_tokenizers.path("piece_bpe_32k.model"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    read = docs.select("doc_id", "text", held_out().alias("held_out"))
    return language.identify_languages(read, language_model(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return rows.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "n_links", "component_id")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def captures(pages: DataFrame) -> DataFrame:
    """Capture records made from the pages: each page is fetched at its id's hour, and asked for again three times.

    The first is a full response with both validators. Of the later ones, the second bears the ETag as a weak one, the
    third the date alone, and the fourth another ETag. Pages of one canonical URL share its history.
    """
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string"))
    k = F.col("k")
    header = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    given = [
        F.when(k == 0, header("ETag", tag)).when(k == 1, header("etag", F.concat(F.lit("W/"), tag))).when(k == 3, header("ETag", F.lit('"other"'))),
        F.when(k.isin(0, 2), header("Last-Modified", day)),
        F.when(k == 0, header("Content-Type", F.lit("text/html"))),
        header("Date", F.concat(F.lit("fetch "), k.cast("string"))),
        F.when(k > 0, header("Content-Length", F.lit("0"))),
    ]
    rows = pages.select("page_id", "url", "html", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    return rows.select(
        (F.col("page_id") * 4 + k).alias("record_id"), "url", (F.col("page_id") * 3600 + k * 100_000).alias("at"), (k > 0).alias("revisit"),
        F.map_from_entries(F.filter(F.array(*given), lambda x: x.isNotNull())).alias("headers"),
    )


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return rows.withColumn("headers", F.array_join(lines, "\n"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 20 = 0"), vectors, k=20, scale=64.0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_pieces(pieces)


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences in training order, written as shards in the shared folder, with the digest of each as read from there."""
    sequences = ordering.token_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    ordered, folder = ordering.training_order(sequences, waves=8), f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    manifest = ordering.write_shards(ordered, folder, waves=8)
    held = ordering.read_shards(spark, folder).select(F.col("slot").alias("held"), F.sha2("ids", 256).alias("ids_sha256"))
    rows = ordered.select("doc_id", "piece", "n_ids", "slot", "shard", (F.col("slot") % manifest["per_shard"] * manifest["stride"]).alias("place"))
    # The digests are as many as the sequences, which Spark can't see.
    rows = rows.join(held.hint("merge"), F.col("slot") == F.col("held"), "left").drop("held")
    return rows.repartitionByRange("slot").sortWithinPartitions("slot")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=13)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows; those whose id's crc32 is divisible by 7 are folded from a row with n_chars + 1."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf(*fields[:3], F.col("n_chars") + 1, fields[4]))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", merkle.leaf(*fields).alias("digest"), tampered.alias("tampered"))
    proven = merkle.proofs(merkle.manifest(rows, group="lang", order="doc_id"))
    proven = proven.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "digest"), F.col("proof")))
    return proven.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs.withColumn("held_out", held), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


OP5_SQL = r"""
WITH c AS (
  SELECT page_id * 4 + k AS record_id, page_id * 3600 + k * 100000 AS ts, k > 0 AS revisit, k,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare,
    CASE k WHEN 0 THEN '"' || md5(html) || '"' WHEN 1 THEN 'W/"' || md5(html) || '"' WHEN 3 THEN '"other"' END AS etag,
    CASE WHEN k IN (0, 2) THEN 'day ' || CAST(page_id % 97 AS VARCHAR) END AS modified
  FROM pages, (SELECT unnest([0, 1, 2, 3]) AS k)
), u AS (
  SELECT *, regexp_extract(bare, '^([^?]*)', 1) AS whole,
    list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)='))) AS asked
  FROM c
), n AS (
  SELECT *, regexp_replace(lower(regexp_extract(whole, '^([^/]*)', 1)), '^www\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(whole, '^[^/]*(.*)$', 1), '/+$', '')
    || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS url_key
  FROM u
), latest AS (
  SELECT url_key, ts, max(record_id) AS record_id FROM n WHERE NOT revisit GROUP BY url_key, ts
), f AS (
  SELECT l.url_key, l.ts, l.record_id, n.etag, n.modified FROM latest l JOIN n ON n.record_id = l.record_id
), j AS (
  SELECT n.*, f.record_id AS old_id, f.etag AS old_etag, f.modified AS old_modified
  FROM n ASOF LEFT JOIN f ON n.url_key = f.url_key AND n.ts > f.ts
), o AS (
  SELECT *, CASE WHEN NOT revisit THEN 'response' WHEN old_id IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = old_etag THEN 'confirmed' ELSE 'changed' END
    WHEN modified = old_modified THEN 'confirmed' ELSE 'changed' END AS outcome
  FROM j
)
SELECT record_id, url_key, outcome, CASE outcome WHEN 'response' THEN record_id WHEN 'confirmed' THEN old_id END AS response_id,
  CASE WHEN outcome = 'confirmed'
    THEN 'content-type: text/html' || chr(10) || 'date: fetch ' || k || chr(10) || 'etag: ' || coalesce(etag, old_etag) || chr(10) || 'last-modified: ' || old_modified
    ELSE concat_ws(chr(10), CASE WHEN k > 0 THEN 'content-length: 0' END, CASE WHEN k = 0 THEN 'content-type: text/html' END, 'date: fetch ' || k,
      'etag: ' || etag, 'last-modified: ' || modified) END AS headers
FROM o
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), r AS (
  SELECT *, row_number() OVER o AS rank,
    3 * CAST(sum(source_size) OVER () AS BIGINT)
      - 4 * coalesce(CAST(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS left_over,
    2 * CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_weight
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), t AS (
  SELECT *, CAST(weight * left_over AS DOUBLE) / left_weight > 2 * source_size AS stops FROM r
), g AS (
  SELECT left_over AS lo, left_weight AS lw FROM t WHERE NOT stops ORDER BY rank LIMIT 1
), u AS (
  SELECT source, source_size, CASE WHEN stops THEN 2.0::DOUBLE * source_size ELSE CAST(weight * lo AS DOUBLE) / lw END AS target FROM t, g
), m AS (
  SELECT doc_id, text, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    CAST(concat('0x', substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents
), c AS (
  SELECT *, len(units) AS n, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) % (len(units) + 1) AS a,
    CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) % (len(units) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, coalesce(array_to_string(units[1:least(a, b)], ''), '') AS prefix,
    coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
    coalesce(array_to_string(units[greatest(a, b) + 1:], ''), '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def sized(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def leaf_sql(chars: str) -> str:
    return f"sha256({' || '.join(map(sized, ('doc_id', 'source', 'lang', chars, 'text')))})"


def tree_sql(name: str, leaves: str) -> str:
    """All nodes of the trees of `leaves` (tree, i, n, h), level by level."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, i, n, h FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 2, n
)"""


OP12_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS sum FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), bits
), d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf_sql("n_chars")} AS h, {leaf_sql("n_chars + 1")} AS other FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d
), {tree_sql("nodes", "l")}, tops AS (
  SELECT tree AS name, h FROM nodes WHERE n = 1
), f AS (
  SELECT '' AS tree, name, h, row_number() OVER (ORDER BY name) - 1 AS i, count(*) OVER () AS n FROM tops
), {tree_sql("forest", "f")}, root AS (
  SELECT h AS root FROM forest WHERE n = 1
), whole AS (
  SELECT tree, level, i, n, h FROM nodes UNION ALL SELECT '/', level, i, n, h FROM forest
), starts AS (
  SELECT l.tree, l.i, l.h, l.doc_id, CASE WHEN crc.sum % 7 = 0 THEN l.other ELSE l.h END AS start, f.i AS top, f.h AS subroot,
    (SELECT max(level) FROM nodes) AS most
  FROM l JOIN f ON l.tree = f.name LEFT JOIN crc ON crc.doc_id = l.doc_id
), steps AS (
  SELECT s.tree, s.i, w.level AS step, (s.i >> w.level) % 2 = 1 AS is_right, b.h FROM starts s JOIN whole w ON w.tree = s.tree AND w.i = s.i >> w.level AND w.n > 1
    LEFT JOIN whole b ON b.tree = s.tree AND b.level = w.level AND b.i = xor(w.i, 1)
  UNION ALL
  SELECT s.tree, s.i, most + 1 + w.level, (s.top >> w.level) % 2 = 1, b.h FROM starts s JOIN whole w ON w.tree = '/' AND w.i = s.top >> w.level AND w.n > 1
    LEFT JOIN whole b ON b.tree = '/' AND b.level = w.level AND b.i = xor(w.i, 1)
), paths AS (
  SELECT tree, i, coalesce(string_agg(h, '' ORDER BY step), '') AS siblings, list({{'r': is_right, 'd': h}} ORDER BY step) AS path FROM steps GROUP BY tree, i
), folds AS (
  SELECT s.tree, s.i, s.start AS acc, 1 AS k, p.path FROM starts s LEFT JOIN paths p ON s.tree = p.tree AND s.i = p.i
  UNION ALL
  SELECT tree, i, sha256(CASE WHEN path[k].d IS NULL THEN acc WHEN path[k].r THEN path[k].d || acc ELSE acc || path[k].d END), k + 1, path FROM folds WHERE k <= len(path)
)
SELECT s.doc_id, s.h AS leaf, s.subroot, root, sha256(coalesce(p.siblings, '')) AS proof_sha256, g.acc AS folded_root, g.acc = root AS verified
FROM starts s LEFT JOIN paths p ON s.tree = p.tree AND s.i = p.i JOIN folds g ON g.tree = s.tree AND g.i = s.i AND g.k = coalesce(len(p.path), 0) + 1, root
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_suffix_dedup, op3_ngram_jaccard, op4_embedding_near_dedup, op5_warc_revisits, op6_topk_search,
        op7_packing, op8_training_order, op9_substring_dedup, op10_source_mixing, op11_fill_in_middle, op12_merkle_manifest, op13_toxicity,
    )
}
SQL = {"op5_warc_revisits": OP5_SQL, "op6_topk_search": OP6_SQL, "op10_source_mixing": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
