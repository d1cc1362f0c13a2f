"""WARC: resolve not-modified revisits to the latest earlier full response."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut_lineage

#: Headers that describe the stored body; a revisit's values of them are not taken over.
BODY_HEADERS = ("content-encoding", "content-length", "content-md5", "content-range", "content-type", "digest", "etag", "transfer-encoding")
#: Query parameters that do not name a resource.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
#: Records that a stretch of time holds on average; a URL's records of one stretch are one group.
BLOCK_ROWS = 8192
#: Most stretches; their borders are what reaches the driver.
MOST_BLOCKS = 10_000

RECORD = "record_id, url, captured_at, status, etag, last_modified, headers, payload_digest, payload_length"


def canonical_url(url: str | Column) -> Column:
    """Scheme dropped, host in lower case without ``www.`` and default port, no fragment, tracking parameters or
    closing slashes; the other parameters in order.  Null for null."""
    url = F.col(url) if isinstance(url, str) else url
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#[\s\S]*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?([\s\S]*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(host, F.when(path == "", "/").otherwise(path), tail)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, overlaid by those of the revisit that may change; names in lower case."""

    def entries(m: Column) -> Column:
        return F.transform(
            F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))),
            lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
        )

    new = F.filter(entries(fresh), lambda e: ~e["key"].isin(*BODY_HEADERS))
    names = F.transform(new, lambda e: e["key"])
    old = F.filter(entries(stored), lambda e: ~F.array_contains(names, e["key"]))
    return F.array_sort(F.concat(old, new))


def header_text(merged: Column) -> Column:
    return F.array_join(F.transform(merged, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def time_blocks(records: DataFrame) -> DataFrame:
    """``records`` with ``_block``: the stretch of time they belong to, of about ``BLOCK_ROWS`` rows each."""
    n = records.count()
    blocks = min(MOST_BLOCKS, max(1, -(-n // BLOCK_ROWS)))
    at = F.col("captured_at").cast("double")
    shares = [k / blocks for k in range(1, blocks)]
    borders = records.agg(F.percentile_approx(at, shares, 100 * blocks)).first()[0] if shares else None
    splits = [-float("inf"), *sorted({b for b in borders or ()}), float("inf")]
    if len(splits) == 2:
        return records.withColumn("_block", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol="_at", outputCol="_block").transform(records.withColumn("_at", at)).drop("_at")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """What every revisit (status 304) stands for.

    ``records`` has ``record_id, url, captured_at (bigint), status, etag,
    last_modified, headers (map), payload_digest, payload_length``.  Returned
    per revisit: ``record_id, canonical_url, captured_at, refers_to,
    refers_at, validator, resolved, headers, payload_digest, payload_length``.

    A revisit refers to the full response (status 200) of the same canonical
    URL with the latest ``captured_at`` before its own; of several at that
    time, the one with the largest ``record_id``.  If both have an ETag it
    must agree without its weakness mark (validator ``etag``); otherwise both
    must have the same Last-Modified (``last-modified``); with neither pair,
    validator is null.  Only a validator that agrees resolves the revisit: it
    then has the response's payload and headers, overlaid by its own that
    ``BODY_HEADERS`` does not list.

    The as-of join is a window over (URL, stretch of time) plus the last
    response of each earlier stretch, so records of one hot URL are many
    groups of bounded size.  Payloads stay where they are; only references
    move.

    A revisit with a null URL or time is not resolved.  Nulls in validators or
    headers count as absent.  Repeated records are resolved each.  Other
    columns are ignored.
    """
    named = records.select(*RECORD.split(", ")).withColumn("canonical_url", canonical_url("url"))
    used = cut_lineage(named.drop("url").filter(F.col("status").isin(200, 304)))
    full = F.col("status") == 200
    dated = F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull()
    rows = time_blocks(used.filter(dated))
    # a full response as what a later revisit needs of it; null for a revisit
    reference = F.struct("captured_at", "record_id", "etag", "last_modified", F.map_entries("headers").alias("headers"), "payload_digest", "payload_length")
    rows = rows.withColumn("_ref", F.when(full, reference))
    ends = rows.filter(full).groupBy("canonical_url", "_block").agg(F.max_by("_ref", F.struct("captured_at", "record_id")).alias("_end"))
    # revisits before responses of the same time: these are not earlier
    inside = Window.partitionBy("canonical_url", "_block").orderBy("captured_at", full.cast("int"), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.last("_ref", ignorenulls=True).over(inside)).filter(~full).drop("_ref")
    # the last response of an earlier stretch, for stretches that have revisits
    marks = near.filter(F.col("_near").isNull()).select("canonical_url", "_block").distinct()
    lined = marks.withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)).withColumn("_kind", F.lit(0)).unionByName(ends.withColumn("_kind", F.lit(1)))
    before = Window.partitionBy("canonical_url").orderBy("_block", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = lined.withColumn("_far", F.last("_end", ignorenulls=True).over(before)).filter("_kind = 0").select("canonical_url", "_block", "_far")
    asof = near.join(carried, ["canonical_url", "_block"], "left").withColumn("_r", F.coalesce("_near", "_far")).drop("_near", "_far", "_block")
    lost = used.filter(~dated & ~full).withColumn("_r", F.lit(None).cast(asof.schema["_r"].dataType))
    return judged(asof.unionByName(lost))


def judged(asof: DataFrame) -> DataFrame:
    def tag(c: str) -> Column:
        return F.regexp_replace(F.col(c), "^W/", "")

    tags, dates = F.col("etag").isNotNull() & F.col("_r.etag").isNotNull(), F.col("last_modified").isNotNull() & F.col("_r.last_modified").isNotNull()
    validator = F.when(tags, "etag").when(dates, "last-modified")
    agrees = F.when(tags, tag("etag") == tag("_r.etag")).when(dates, F.col("last_modified") == F.col("_r.last_modified")).otherwise(False)
    return asof.withColumn("resolved", agrees).select(
        "record_id",
        "canonical_url",
        "captured_at",
        F.col("_r.record_id").alias("refers_to"),
        F.col("_r.captured_at").alias("refers_at"),
        validator.alias("validator"),
        "resolved",
        F.when(F.col("resolved"), merged_headers(F.map_from_entries("_r.headers"), F.col("headers"))).alias("headers"),
        F.when(F.col("resolved"), F.col("_r.payload_digest")).alias("payload_digest"),
        F.when(F.col("resolved"), F.col("_r.payload_length")).alias("payload_length"),
    )
