"""Operator 4: not-modified revisits in WARC records, resolved to the latest earlier full response.

Records are rows: record_id, url, ts (long), type ("response" or "revisit"), etag, last_modified (both as in HTTP
headers, or null), headers (array of struct<name, value>). A revisit is joined as of its time to the
response with its canonical URL and the greatest smaller ts (ties: the greatest record_id). It resolves if the
validators agree: the entity tags, compared weakly, if the revisit has one, else the dates, if it has one. Headers
of a resolved revisit are the response's, but for those that a 304 answer may update.

A URL may hold a third of all rows, so the join is a scan in two levels: rows are dealt by range of (URL, time) to as many
slices as there are shuffle partitions, whose bounds Spark takes from a sample of the rows, so that slices are even
however times are spread; the last response of each (URL, slice) is carried into the later slices as one row, and a
running maximum within (URL, slice) does the rest. Bodies do not move at all.

Defined results: header names are compared and returned in lower case; revisits without any validator resolve by URL and time alone ("unchecked"); a null URL or time never
matches ("no_url"); no earlier response gives "missing", disagreeing validators give "mismatch", both without an
original's headers. Repeated rows each get a row. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: What a 304 answer may update (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
LONG_AGO = -(2**62)


def canonical_url(url: Column) -> Column:
    """Scheme, user, default port, leading www., fragment and trailing slashes go; the host is lower case; parameters are sorted."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    head = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(head, r"^.*@", "")), r":(80|443)$", ""), r"^www\.", "")
    rest = bare.substr(F.length(head) + 1, F.length(bare))
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))))


def resolve(records: DataFrame) -> DataFrame:
    """A row per revisit: record_id, url_key, ts, status, origin_id, origin_ts, headers."""
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "type", "etag", "last_modified", F.transform("headers", lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value"))).alias("headers"))
    lost = rows.where("type = 'revisit' and (url_key is null or ts is null)")
    rows = rows.where("url_key is not null and ts is not null")
    spark = records.sparkSession
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "url_key", "ts")
    rows = written(spark, rows.withColumn("slice", F.spark_partition_id().cast("long")))  # so that a row's slice stays
    response = F.struct("ts", "record_id", "etag", "last_modified", "headers")
    rows = rows.withColumn("r", F.when(F.col("type") == "response", response))
    last = rows.where("r is not null").groupBy("url_key", "slice").agg(F.max_by("r", F.struct("ts", "record_id")).alias("r"))
    # The slices that hold revisits take the last response of the slices before them.
    marks = last.unionByName(rows.where("type = 'revisit'").select("url_key", "slice").distinct().withColumn("r", F.lit(None).cast(last.schema["r"].dataType)))
    marks = marks.groupBy("url_key", "slice").agg(F.max_by("r", F.when(F.col("r").isNotNull(), 1)).alias("r"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("url_key", "slice", F.last("r", ignorenulls=True).over(before).alias("r")).where("r is not null")
    carried = carried.select(F.lit(None).cast(dict(rows.dtypes)["record_id"]).alias("record_id"), "url_key", F.lit(LONG_AGO).alias("ts"), F.lit("carried").alias("type"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast(rows.schema["headers"].dataType).alias("headers"), "slice", "r")
    earlier = Window.partitionBy("url_key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    joined = rows.unionByName(carried).withColumn("o", F.max("r").over(earlier)).where("type = 'revisit'")
    weak = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    origin = F.col("o")
    status = (
        F.when(origin.isNull(), "missing")
        .when(F.col("etag").isNotNull(), F.when(weak("etag") == weak(origin["etag"]), "resolved").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull(), F.when(F.col("last_modified") == origin["last_modified"], "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    good = F.col("status").isin("resolved", "unchecked")
    own = F.filter(F.coalesce("headers", F.expr("cast(array() as array<struct<name:string,value:string>>)")), lambda h: h["name"].isin(PERMITTED))
    names = F.transform(own, lambda h: h["name"])
    kept = F.filter(F.coalesce(origin["headers"], F.expr("cast(array() as array<struct<name:string,value:string>>)")), lambda h: ~F.array_contains(names, h["name"]))
    merged = F.when(good, F.array_sort(F.concat(kept, own)))
    out = joined.withColumn("status", status).select("record_id", "url_key", "ts", "status", F.when(good, origin["record_id"]).alias("origin_id"), F.when(good, origin["ts"]).alias("origin_ts"), merged.alias("headers"))
    none = lost.select("record_id", "url_key", "ts", F.lit("no_url").alias("status"), F.lit(None).cast("long").alias("origin_id"), F.lit(None).cast("long").alias("origin_ts"), F.lit(None).cast(out.schema["headers"].dataType).alias("headers"))
    return out.unionByName(none)


def captures(pages: DataFrame) -> DataFrame:
    """WARC records made from ``pages``: a capture each, of the site and first folder of the URL, at time page_id.

    Every third is a full response, the others are revisits. Entity tags change every 16 captures and dates every 32, so
    a revisit agrees with some earlier responses of its URL only; some have another tag, some only a date, some neither.
    """
    site = F.regexp_extract("url", r"^([a-z]+://[^/]+/[^/]*)", 1)
    k = F.col("page_id")
    tag = F.concat(F.lit('"'), F.floor(k / 16).cast("string"), F.lit('"'))
    full = k % 3 == 0
    etag = F.when(full, tag).when(k % 7 < 2, None).when(k % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    dated = F.when(full | (k % 7 == 1), F.concat(F.lit("day "), F.floor(k / 32).cast("string")))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    headers = F.when(full, F.array(header("content-length", F.length(F.coalesce("html", F.lit(""))).cast("string")), header("content-type", F.lit("text/html")), header("date", k.cast("string")), header("etag", tag))).otherwise(F.array(header("content-length", F.lit("0")), header("date", k.cast("string")), header("expires", (k + 60).cast("string"))))
    return pages.select(k.alias("record_id"), site.alias("url"), k.alias("ts"), F.when(full, "response").otherwise("revisit").alias("type"), etag.alias("etag"), dated.alias("last_modified"), headers.alias("headers"))


def query(spark, sf_dir: str) -> DataFrame:
    out = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select("record_id", "url_key", "status", "origin_id", F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit("="), h["value"])), ";").alias("headers"))


ORACLE = r"""
WITH u AS (SELECT page_id AS k, html, regexp_extract(url, '^([a-z]+://[^/]+/[^/]*)', 1) AS site FROM pages),
c AS (SELECT k, html, regexp_replace(regexp_replace(lower(regexp_extract(site, '://([^/]*)', 1)), ':(80|443)$', ''), '^www\.', '') || regexp_replace(regexp_extract(site, '://[^/]*(/[^/]*)', 1), '/+$', '') AS url_key FROM u),
f AS (SELECT url_key, k AS origin_id, length(coalesce(html, '')) AS n FROM c WHERE k % 3 = 0),
v AS (SELECT url_key, k, CASE WHEN k % 7 < 2 THEN NULL WHEN k % 5 = 0 THEN 'other' ELSE 'tag' END AS tag FROM c WHERE k % 3 <> 0),
j AS (SELECT v.url_key, k, tag, f.origin_id, f.n FROM v ASOF LEFT JOIN f ON v.url_key = f.url_key AND v.k > f.origin_id),
s AS (SELECT *, CASE WHEN origin_id IS NULL THEN 'missing' WHEN tag = 'other' THEN 'mismatch'
  WHEN tag = 'tag' THEN CASE WHEN k // 16 = origin_id // 16 THEN 'resolved' ELSE 'mismatch' END
  WHEN k % 7 = 1 THEN CASE WHEN k // 32 = origin_id // 32 THEN 'resolved' ELSE 'mismatch' END ELSE 'unchecked' END AS status FROM j)
SELECT k AS record_id, url_key, status, CASE WHEN status IN ('resolved', 'unchecked') THEN origin_id END AS origin_id,
  CASE WHEN status IN ('resolved', 'unchecked') THEN 'content-length=' || n || ';content-type=text/html;date=' || k || ';etag="' || (origin_id // 16) || '";expires=' || (k + 60) END AS headers
FROM s"""
