"""WARC revisits: not-modified captures resolved to the response they confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header fields that a 304 answer may carry to update a stored response (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Query parameters that name the visit, not the page.
TRACKING = r"^(utm_[a-z]+|ref)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without closing slash, parameters sorted without tracking.

    Scheme and fragment are dropped; null stays null, and text that isn't a URL is treated as a path.
    """
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    whole = F.regexp_extract(bare, r"^([^?]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(whole, "^([^/]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(whole, "^[^/]*(.*)$", 1), "/+$", "")
    asked = F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&")
    asked = F.array_sort(F.filter(asked, lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then agree the last by code point stays; null is empty."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def resolve_revisits(records: DataFrame, span: int = 86_400) -> DataFrame:
    """record_id, url_key, outcome, response_id, headers of every row of `records`.

    `records`: record_id long, url string, at long (seconds), revisit boolean, headers map<string,string>; other
    columns are not read. A revisit is compared with the latest full response of its canonical URL that is strictly
    earlier (of several at one time, that of the largest id). Its ETag decides (weakly compared: W/ is ignored), else
    its Last-Modified. Outcomes: `response` (a full response, resolved to itself); `confirmed` (headers: the
    response's, with those of the revisit that a 304 may change); `changed` (validators differ); `unverified` (no
    validator to compare); `orphan` (no earlier response, or url or time null). Only `response` and `confirmed` have a
    response_id; other revisits keep their own headers. A null `revisit` counts as a response. Rows that repeat give
    equal rows. Empty tables give none.

    The as-of join has two levels, so that a URL with a very large share of the captures spreads over tasks: inside
    a span of time by a window, and before it by the last response of each span.
    """
    rows = records.select(
        F.col("record_id").cast("long"), canonical_url(F.col("url")).alias("url_key"), F.col("at").cast("long"),
        F.coalesce("revisit", F.lit(False)).alias("revisit"), _lowered(F.col("headers")).alias("headers"),
    ).withColumn("span", F.floor(F.col("at") / span))
    keyed = F.col("url_key").isNotNull() & F.col("at").isNotNull()
    full = F.struct("at", F.col("record_id").alias("id"))
    # Of responses, validators and headers travel; payloads stay where they are.
    response = F.when(~F.col("revisit"), F.struct(F.col("record_id").alias("id"), "headers"))
    order = F.when(~F.col("revisit"), full)
    inside = Window.partitionBy("url_key", "span").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    live = rows.where(keyed).withColumn("near", F.max_by(response, order).over(inside))
    ends = rows.where(keyed & ~F.col("revisit")).groupBy("url_key", "span").agg(F.max_by(response, order).alias("last"))
    spans = rows.where(keyed).select("url_key", "span").distinct().join(ends, ["url_key", "span"], "left")
    before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("far", F.last("last", ignorenulls=True).over(before)).select(
        F.col("url_key").alias("k"), F.col("span").alias("s"), "far"
    )
    found = live.join(spans, (F.col("url_key") == F.col("k")) & (F.col("span") == F.col("s"))).withColumn("of", F.coalesce("near", "far"))
    columns = ["record_id", "url_key", "revisit", "headers", "of"]
    found = found.select(columns).unionByName(rows.where(~keyed).select(*columns[:4]), allowMissingColumns=True)
    strong = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    own, old = F.col("headers"), F.col("of.headers")
    same = F.when(own["etag"].isNotNull() & old["etag"].isNotNull(), strong(own) == strong(old)).when(
        own["last-modified"].isNotNull() & old["last-modified"].isNotNull(), own["last-modified"] == old["last-modified"]
    )
    outcome = (
        F.when(~F.col("revisit"), "response").when(F.col("of").isNull(), "orphan").when(same.isNull(), "unverified").when(same, "confirmed").otherwise("changed")
    )
    allowed = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)
    found = found.withColumn("outcome", outcome)
    return found.select(
        "record_id", "url_key", "outcome",
        F.when(F.col("outcome") == "response", F.col("record_id")).when(F.col("outcome") == "confirmed", F.col("of.id")).alias("response_id"),
        F.when(F.col("outcome") == "confirmed", merged).otherwise(own).alias("headers"),
    )
