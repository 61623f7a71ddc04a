"""Not-modified revisits: each is joined as of its time to the latest earlier full response of its URL.

A record has record_id, url, ts (long), kind ('response' or 'revisit'), etag, last_modified, digest and headers
(map). URLs are compared in canonical form. A revisit is `resolved` if a response exists before it and no
validator contradicts: payload digest, ETag (weakly compared) and Last-Modified, each where both have
it. The merged headers are the response's, overlaid with those that a 304 may update.

Null or empty url: never matched (`no_response`). Null ts or kind: the record is left out. Ties: of
responses at one time the greatest record_id counts; a response at the revisit's own time is not earlier.
Repeated revisits are resolved one by one. Header names are compared and returned in lower case; of names in one record that differ
in case only the last counts. An empty table gives no rows. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Headers of a 304 that replace the stored ones; the others describe the stored body and stay.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: A URL's records are dealt by time spans of this many ticks, so a hot URL is many groups.
SPAN = 4096


def canonical(url: Column) -> Column:
    """Scheme, `www.`, default port, fragment, tracking parameters, index pages and a last slash do not tell URLs apart; the host is lower-cased."""
    bare = F.regexp_replace(F.trim(url), r"(?i)^https?://(?:www\.)?", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(?:80|443)$", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    rest = F.regexp_replace(rest, r"(?<=[?&])(?:utm_[a-z]+|ref|sessionid)=[^&]*(?:&|$)", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[?&]+$", ""), r"/(?:index\.html?)?$", "")
    return F.nullif(F.concat(host, rest), F.lit(""))


def _differs(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def _lowered(headers: Column) -> Column:
    """The map with lower-case names; a name that comes again later is left out before."""
    entries = F.map_entries(F.coalesce(headers, F.expr("map()").cast("map<string,string>")))

    def is_last(e: Column, i: Column) -> Column:
        return ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: F.lower(x["key"]) == F.lower(e["key"]))

    return F.map_from_entries(F.transform(F.filter(entries, is_last), lambda e: F.struct(F.lower(e["key"]), e["value"])))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit: record_id, url_key, ts, matched_id, matched_ts, status, digest, headers.

    A hot URL is dealt by spans of time: within a span a window finds the last response; what a
    span inherits comes from one row for each span, so no task sorts all records of a URL.
    """
    r = records.select("record_id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers").where("ts is not null and kind in ('response', 'revisit')").withColumn("url_key", canonical(F.col("url"))).withColumn("span", F.floor(F.col("ts") / SPAN))
    r = r.withColumn("is_revisit", F.col("kind") == "revisit")
    full = F.when(~F.col("is_revisit"), F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    # A URL that is null is no key: its revisits are spread and match nothing.
    r = r.withColumn("part", F.when(F.col("url_key").isNull(), F.col("record_id")))
    order = W.partitionBy("url_key", "part", "span").orderBy("ts", F.col("is_revisit").desc(), "record_id")
    seen = r.withColumn("near", F.last(full, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = r.where("not is_revisit and url_key is not null").groupBy("url_key", "span").agg(F.max_by(full, F.struct("ts", "record_id")).alias("own"))
    spans = r.where("is_revisit and url_key is not null").select("url_key", "span").distinct().join(last, ["url_key", "span"], "full")
    before = W.partitionBy("url_key").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.withColumn("carried", F.last("own", ignorenulls=True).over(before)).select("url_key", "span", "carried").where("carried is not null")
    found = seen.where("is_revisit").join(carried, ["url_key", "span"], "left")
    hit = F.when(F.col("url_key").isNotNull(), F.coalesce("near", "carried"))
    found = found.withColumn("hit", hit)
    weak = lambda c: F.regexp_replace(c, r"^W/", "")
    conflict = _differs(F.col("digest"), F.col("hit.digest")) | _differs(weak(F.col("etag")), weak(F.col("hit.etag"))) | _differs(F.col("last_modified"), F.col("hit.last_modified"))
    status = F.when(F.col("hit").isNull(), "no_response").when(conflict, "conflict").otherwise("resolved")
    found = found.withColumn("allowed", F.map_filter(_lowered(F.col("headers")), lambda k, v: k.isin(*PERMITTED)))
    allowed, kept = F.col("allowed"), F.map_filter(_lowered(F.col("hit.headers")), lambda k, v: ~F.array_contains(F.map_keys("allowed"), k))
    return found.select(
        "record_id", "url_key", "ts", F.col("hit.record_id").alias("matched_id"), F.col("hit.ts").alias("matched_ts"), status.alias("status"),
        F.when(status == "resolved", F.col("hit.digest")).alias("digest"), F.when(status == "resolved", F.map_concat(kept, allowed)).alias("headers"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """The crawl that pages stand for: a full response for each page at time 10 * page_id, and a revisit of its URL, spelled
    differently: five ticks later or many spans later, and a few before any response. A tenth of revisits brings a new ETag; a third has a digest."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", F.md5(html).alias("md5"), F.length(html).alias("n"))
    etag = F.concat(F.lit('"'), F.substring("md5", 1, 16), F.lit('"'))
    response = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.col("md5").alias("digest"),
        F.create_map(F.lit("content-length"), F.col("n").cast("string"), F.lit("etag"), etag, F.lit("date"), (F.col("page_id") * 10).cast("string")).alias("headers"),
    )
    new = F.when(F.col("page_id") % 10 == 7, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), etag))
    later = F.col("page_id") * 10 + F.when(F.col("page_id") % 11 == 3, -5).otherwise(5 + 50_000 * (F.col("page_id") % 3))
    spelled = F.concat(F.regexp_replace("url", "^https?://(?:www\\.)?", "HTTP://www."), F.lit("#again"))
    revisit = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), spelled.alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"), new.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.when(F.col("page_id") % 3 == 0, F.col("md5")).alias("digest"), F.create_map(F.lit("Date"), later.cast("string"), F.lit("content-length"), F.lit("0")).alias("headers"),
    )
    return response.unionByName(revisit)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select("record_id", "url_key", "matched_id", "status", "digest", F.element_at("headers", "date").alias("date"), F.element_at("headers", "content-length").alias("content_length"))


OP5_SQL = r"""
WITH base AS (SELECT page_id, url, md5(coalesce(html, '')) AS m, length(coalesce(html, '')) AS n FROM pages),
k AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '^[hH][tT][tT][pP][sS]?://([wW][wW][wW]\.)?', ''), '#.*$', '') AS bare FROM base
), c AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', '') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '([?&])(utm_[a-z]+|ref|sessionid)=[^&]*(&|$)', '\1', 'g'), '[?&]+$', ''), '/(index\.html?)?$', '') AS rest FROM k
), u AS (SELECT *, nullif(host || rest, '') AS url_key, '"' || substr(m, 1, 16) || '"' AS etag FROM c),
r AS (SELECT page_id * 2 + 1 AS record_id, url_key, page_id * 10 + CASE WHEN page_id % 11 = 3 THEN -5 ELSE 5 + 50000 * (page_id % 3) END AS ts, CASE WHEN page_id % 10 = 7 THEN '"changed"' ELSE etag END AS etag, CASE WHEN page_id % 3 = 0 THEN m END AS digest FROM u),
f AS (SELECT page_id * 2 AS record_id, url_key, page_id * 10 AS ts, etag, m, n FROM u),
j AS (SELECT r.*, f.record_id AS matched_id, f.m, f.n, CASE WHEN f.record_id IS NULL THEN 'no_response' WHEN coalesce(r.digest <> f.m, false) OR r.etag <> f.etag THEN 'conflict' ELSE 'resolved' END AS status
  FROM r ASOF LEFT JOIN f ON r.url_key = f.url_key AND r.ts > f.ts)
SELECT record_id, url_key, matched_id, status, CASE WHEN status = 'resolved' THEN m END AS digest,
  CASE WHEN status = 'resolved' THEN CAST(ts AS VARCHAR) END AS date, CASE WHEN status = 'resolved' THEN CAST(n AS VARCHAR) END AS content_length FROM j
"""
