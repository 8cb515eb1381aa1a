"""Resolution of not-modified (revisit) records against the latest earlier full response.

Records are keyed by canonical URL. A revisit is joined as of its time with the latest full response of its
URL that is strictly earlier (ties: the larger record id). If the validators agree (same entity tag under
weak comparison or, where one side has none, same Last-Modified) the revisit takes the response's payload
and its headers, with those headers replaced that a 304 response may update.

The as-of join works on two levels, so a URL with very many captures is never one group: records are
grouped by (URL, time slice); within a slice the latest response is carried along, and what a slice
inherits comes from a running maximum over the slices of a URL (a row for each slice).

Defined results: a revisit without an earlier response, or whose validators differ, stays unresolved
(``status`` says which); null URLs and times resolve nothing; repeated rows are records of their own; an
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_SLICES = 4096  # time slices over the span of the data, at least
SLICE_ROWS = 100_000  # and more, so that a slice of an evenly crawled table has at most so many rows
# Headers that a 304 response updates in the stored response
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host in lower case without "www." and default port, no fragment, tracking parameters or
    trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^[Ww]{3}\.|:(80|443)$", ""))
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?<=[?&])(utm_[a-z]+|ref)=[^&]*&?", ""), r"[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/+$", ""))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, with the permitted ones of the revisit in their place."""
    allowed = F.map_filter(fresh, lambda k, v: F.lower(k).isin(*PERMITTED) & v.isNotNull())
    named = F.transform(F.map_keys(allowed), lambda k: F.lower(k))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(named, F.lower(k))), allowed)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """``records``: record_id, url, ts, kind ('response' or 'revisit'), etag, last_modified, digest, headers
    (map of strings). Returns a row for each revisit: record_id, url_key, status ('resolved', 'mismatch' or
    'no_response'), response_id, response_ts, digest, headers."""
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "etag", "last_modified", "digest", "headers")
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n")).first()
    first, last = span["a"] or 0, span["b"] or 0
    width = (last - first) // max(LEAST_SLICES, span["n"] // SLICE_ROWS) + 1
    revisit, response = F.col("kind") == "revisit", F.col("kind") == "response"
    events = rows.select(
        "url_key", F.floor((F.col("ts") - F.lit(first)) / width).alias("slice"), "ts", "kind", "record_id", "etag", "last_modified",
        F.when(response, F.struct("ts", "record_id", "etag", "last_modified", "digest")).alias("r"),
        F.when(revisit, F.col("headers")).alias("fresh"))  # a response's headers follow once it is known which are wanted
    placed = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    lost = events.where(revisit & ~placed).select("url_key", "ts", "record_id", "etag", "last_modified", "fresh",
                                                  F.lit(None).cast(events.schema["r"].dataType).alias("r"))
    events = events.where(placed)
    earlier = Window.partitionBy("url_key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inside = events.withColumn("near", F.max("r").over(earlier)).where(revisit)
    slices = events.groupBy("url_key", "slice").agg(F.max("r").alias("r"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    inherited = slices.select("url_key", "slice", F.max("r").over(before).alias("far"))
    found = (inside.join(inherited, ["url_key", "slice"], "left")
             .select("url_key", "ts", "record_id", "etag", "last_modified", "fresh", F.coalesce("near", "far").alias("r")).union(lost))
    by_tag = _weak(F.col("etag")) == _weak(F.col("r.etag"))
    agrees = F.coalesce(by_tag, F.col("last_modified") == F.col("r.last_modified"), F.lit(False))
    status = F.when(F.col("r").isNull(), "no_response").when(agrees, "resolved").otherwise("mismatch")
    found = found.select("record_id", "url_key", status.alias("status"), F.col("r.record_id").alias("response_id"),
                         F.col("r.ts").alias("response_ts"), F.when(status == "resolved", F.col("r.digest")).alias("digest"), "fresh")
    stored = (rows.where(response & F.col("record_id").isNotNull()).groupBy(F.col("record_id").alias("response_id"))
              .agg(F.first("headers").alias("stored")))
    return found.join(stored, "response_id", "left").select(
        "record_id", "url_key", "status", "response_id", "response_ts", "digest",
        F.when(F.col("status") == "resolved", merged_headers(F.coalesce("stored", F.create_map().cast("map<string,string>")),
                                                             F.coalesce("fresh", F.create_map().cast("map<string,string>")))).alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """WARC-like records of a crawl table (page_id, url, html): each page is a full response at a time
    given by its id, and was asked for again twice: two days on, when the server sent 304 with the
    page's validators (a weak tag on some, only Last-Modified on others), and, for every seventh page, an
    hour before its own capture, with validators that no earlier capture has."""
    ts = F.col("page_id") * 3600
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.substring(digest, 1, 16)
    page = pages.select("page_id", "url", ts.alias("t"), digest.alias("digest"), tag.alias("tag"))
    kinds = F.array(
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("late"), F.lit("response").alias("kind")),
        F.struct(F.lit(1).alias("n"), F.lit(172800).alias("late"), F.lit("revisit").alias("kind")),
        F.struct(F.lit(2).alias("n"), F.lit(-3599).alias("late"), F.lit("revisit").alias("kind")))
    rows = page.withColumn("k", F.explode(kinds)).where((F.col("k.n") < 2) | (F.col("page_id") % 7 == 0))
    when = F.col("t") + F.col("k.late")
    etag = (F.when(F.col("k.n") == 2, F.concat(F.lit("old-"), F.col("tag")))
            .when((F.col("k.n") == 1) & (F.col("page_id") % 5 == 0), F.lit(None))
            .when((F.col("k.n") == 1) & (F.col("page_id") % 3 == 0), F.concat(F.lit("W/"), F.col("tag"))).otherwise(F.col("tag")))
    modified = (F.col("t") - 86400).cast("string")
    response = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), when.cast("string"), F.lit("etag"), F.col("tag"), F.lit("last-modified"), modified)
    revisit = F.create_map(F.lit("date"), when.cast("string"), F.lit("content-length"), F.lit("0"), F.lit("expires"), (when + 60).cast("string"))
    return rows.select((F.col("page_id") * 4 + F.col("k.n")).alias("record_id"), "url", when.alias("ts"), "k.kind", etag.alias("etag"),
                       modified.alias("last_modified"), "digest", F.when(F.col("k.kind") == "response", response).otherwise(revisit).alias("headers"))
