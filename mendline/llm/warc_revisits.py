"""Not-modified revisits of a web archive, resolved by an as-of join.

A revisit says that a page had not changed since an earlier capture. For every revisit the latest earlier full response of the same
canonical URL is found, its validators are compared, and the headers that a not-modified answer may update are merged into
those of the response. Payloads never move; records are ids, times, validators and headers.

The join needs no window over a whole URL: records are range-partitioned by (URL, time), each range carries its last full response on,
and what a range lacks at its start comes from the ranges before it, of which a URL has few. A URL with a third of all records is
thus spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendline.llm.common import cut

#: Header fields that a 304 answer may bring up to date (RFC 9110, 15.4.5), in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")


def canonical_url(url: Column) -> Column:
    """Host and path in one form: no scheme, "www." or "m.", port 80 or 443, fragment, tracking parameters or closing slash.

    Host in lower case; other parameters stay, in their order. Null and blank URLs give null.
    """
    u = F.trim(url)
    u = F.regexp_replace(u, "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, "([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    u = F.regexp_replace(u, "[?&]+$", "")
    u = F.regexp_replace(u, "[?]&+", "?")
    u = F.regexp_replace(u, "&&+", "&")
    host = F.regexp_extract(u, "^[^/?]*", 0)
    rest = F.substr(u, F.length(host) + 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(host), "^(www|m)[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, "/+$", ""), "/+[?]", "?")
    return F.nullif(F.concat(host, rest), F.lit(""))


def strong(tag: Column) -> Column:
    """An entity tag without the mark of weakness, for the weak comparison that revisits need."""
    return F.nullif(F.regexp_replace(F.trim(tag), "^W/", ""), F.lit(""))


def _latest_earlier(records: DataFrame, fact: Column) -> DataFrame:
    """``records`` (url_key, ts, kind, record_id, ...) and ``base``: ``fact`` of the latest full response with a smaller time.

    Of full responses at one time the one with the largest record_id counts; a response at the revisit's own time is not earlier.
    """
    # At equal times revisits come first, so that only earlier responses stand before them.
    order = ["ts", "turn", "record_id"]
    rows = records.withColumn("turn", (F.col("kind") == "response").cast("int")).withColumn(
        "own", F.when(F.col("kind") == "response", fact)
    )
    ranged = cut(cut(rows).repartitionByRange("url_key", *order).withColumn("part", F.spark_partition_id()))
    upto = Window.partitionBy("url_key", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("near", F.last("own", ignorenulls=True).over(upto))
    # The last response of each range of a URL; a URL that lies in one range needs nothing from elsewhere.
    ends = ranged.groupBy("url_key", "part").agg(
        F.max_by("own", F.when(F.col("own").isNotNull(), F.struct(*order))).alias("end")
    )
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("far", F.last("end", ignorenulls=True).over(before)).filter("far is not null")
    met = within.join(carried.select("url_key", "part", "far"), ["url_key", "part"], "left")
    return met.withColumn("base", F.coalesce("near", "far")).drop("turn", "own", "part", "near", "far")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: revisit_id, url_key, ts, status, response_id, response_ts, digest, headers.

    ``records`` has record_id (long), kind ("response" or "revisit"), url, ts, etag, last_modified, digest and headers (map of string to
    string). status is "resolved"; "changed" if a validator that both carry differs; "unvalidated" if they have none in common; or
    "orphan" without an earlier response. The entity tag decides where both have one, else the time of the last change. headers: those of
    the response, with permitted ones of the revisit in their place, for resolved ones only; names in lower case. Null kinds, URLs
    and times give orphans, or responses that nothing refers to. Repeated rows are answered each.
    """
    c = F.col
    clean = records.select(
        c("record_id").cast("long").alias("record_id"),
        F.when(c("kind") == "response", "response").when(c("kind") == "revisit", "revisit").alias("kind"),
        canonical_url(c("url").cast("string")).alias("url_key"),
        c("ts"),
        strong(c("etag")).alias("etag"),
        c("last_modified"),
        c("digest"),
        F.transform_keys(F.coalesce(_last_of_name(c("headers")), F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k)).alias("headers"),
    ).filter("kind is not null")
    known = clean.filter("url_key is not null and ts is not null")
    fact = F.struct("record_id", "ts", "etag", "last_modified", "digest", "headers")
    found = _latest_earlier(known, fact).filter("kind = 'revisit'")
    b = c("base")
    tags = c("etag").isNotNull() & b["etag"].isNotNull()
    times = c("last_modified").isNotNull() & b["last_modified"].isNotNull()
    status = (
        F.when(b.isNull(), "orphan")
        .when(tags, F.when(c("etag") == b["etag"], "resolved").otherwise("changed"))
        .when(times, F.when(c("last_modified") == b["last_modified"], "resolved").otherwise("changed"))
        .otherwise("unvalidated")
    )
    update = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(b["headers"], lambda k, _: ~F.array_contains(F.map_keys(update), k))
    out = found.withColumn("status", status)
    answered = out.select(
        c("record_id").alias("revisit_id"),
        "url_key",
        "ts",
        "status",
        b["record_id"].alias("response_id"),
        b["ts"].alias("response_ts"),
        F.when(c("status") == "resolved", b["digest"]).alias("digest"),
        F.when(c("status") == "resolved", F.map_concat(kept, update)).alias("headers"),
    )
    lost = clean.filter("kind = 'revisit' and (url_key is null or ts is null)").select(
        c("record_id").alias("revisit_id"),
        "url_key",
        "ts",
        F.lit("orphan").alias("status"),
        F.lit(None).cast("long").alias("response_id"),
        F.lit(None).cast(records.schema["ts"].dataType).alias("response_ts"),
        F.lit(None).cast("string").alias("digest"),
        F.lit(None).cast("map<string,string>").alias("headers"),
    )
    return answered.unionByName(lost)


def _last_of_name(headers: Column) -> Column:
    """One entry per name whatever its case: of several, the one whose name sorts last."""
    entries = F.array_sort(F.map_entries(headers))
    later = lambda e: F.exists(entries, lambda o: (F.lower(o["key"]) == F.lower(e["key"])) & (o["key"] > e["key"]))
    return F.map_from_entries(F.filter(entries, lambda e: ~later(e)))


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl in which every page was fetched in full and later asked for again.

    All values come from the rows: the time of a fetch from the page's id, its entity tag and digest from the markup. Of the second
    visits, by the remainder of the id: one in four names another tag, one in four has only the time of the last change, one
    in eight came before any fetch of its page.
    """
    c = F.col
    id_ = c("page_id").cast("long")
    digest = F.sha1(F.coalesce(c("html"), F.lit("")))
    url = c("url").cast("string")
    at = F.pmod(id_, F.lit(1_000_000)) * 60
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    stamp = lambda x: start + F.make_dt_interval(secs=x)
    changed = F.date_format(stamp(at - 86400), "yyyy-MM-dd HH:mm:ss")
    rest = F.pmod(id_, F.lit(8))
    first = pages.select(
        (id_ * 2).alias("record_id"),
        F.lit("response").alias("kind"),
        url.alias("url"),
        stamp(at).alias("ts"),
        digest.alias("etag"),
        changed.alias("last_modified"),
        digest.alias("digest"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length(F.coalesce(c("html"), F.lit(""))).cast("string"),
            F.lit("Date"), F.date_format(stamp(at), "yyyy-MM-dd HH:mm:ss"), F.lit("ETag"), digest,
        ).alias("headers"),
    )
    again = F.when(rest == 7, at - 30).otherwise(at + 30)
    second = pages.select(
        (id_ * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        F.concat(url, F.when(url.contains("#"), "").when(url.contains("?"), "&utm_source=again").otherwise("?utm_source=again")).alias("url"),
        stamp(again).alias("ts"),
        F.when(rest.isin(1, 5), F.concat(F.lit("x"), digest)).when(rest.isin(2, 6), F.lit(None)).otherwise(F.concat(F.lit("W/"), digest)).alias("etag"),
        changed.alias("last_modified"),
        digest.alias("digest"),
        F.create_map(
            F.lit("Date"), F.date_format(stamp(again), "yyyy-MM-dd HH:mm:ss"), F.lit("Content-Length"), F.lit("0"),
            F.lit("Cache-Control"), F.lit("max-age=60"),
        ).alias("headers"),
    )
    return first.unionByName(second)
