"""WARC revisits: each not-modified capture is resolved to the latest earlier full response of its address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, rank_among, table

#: Spans of time into which the captures of an address are dealt.
SPANS = 256
#: Length of the made-up crawl.
MINUTES = 1_000_000_000
#: Headers that a not-modified answer may not change in the stored response (fixed values).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that don't change what an address names (fixed values).
_TRACKING = r"(?i)(^|&)(utm_[a-z]+|fbclid|gclid|ref|sessionid|phpsessid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Scheme and default port dropped, host in lower case without www. or m., no fragment or tracking, no closing slash or .html."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^(www|m)\.|:(80|443)$", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"\?.*$", ""), r"(\.html?|/)+$", "")
    query = F.when(F.instr(rest, "?") > 0, F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"^[^?]*\?", ""), _TRACKING, ""), r"^&", "")).otherwise("")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then are alike the last counts."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def _strong(tag: Column) -> Column:
    """An entity tag without its weakness mark, as not-modified answers compare weakly."""
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def resolve_revisits(records: DataFrame, spans: int = SPANS) -> DataFrame:
    """The not-modified captures of ``records`` with what they stand for.

    ``records``: record_id bigint, url string, captured timestamp, status int, headers map<string,string>, digest
    string (of the payload). A row comes back for each record of status 304: record_id, canonical, captured,
    response_id (the latest full response, status 200, of the same canonical address captured earlier; of several
    at one time the largest record_id; null if there is none), validator (``etag`` or ``last-modified`` if that
    decides, ``digest``, or ``none``), valid (whether validators allow the substitution: null if a response was found
    but no validator of both can be compared), and headers (the stored response's, with those of the revisit that may
    replace them; the revisit's own unless valid is true). Records without address or time resolve to nothing; repeated records each get a row; null headers count
    as none; an empty table gives no rows; other columns are ignored.

    The join is one pass over records ordered by address and time. Captures of an address are dealt into spans
    between quantiles of all capture times, and the last response of each span is carried into later ones, so an address that has a third of all
    captures is sorted in ``spans`` parts. Payloads aren't moved.
    """
    empty = F.create_map().cast("map<string,string>")
    kept = records.where("status in (200, 304)").select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "captured", "status", _lowered(F.coalesce("headers", empty)).alias("headers"), "digest"
    )
    placed = kept.where("canonical is not null and captured is not null")
    micros = F.unix_micros("captured")
    marks = placed.agg(F.percentile_approx(micros, [k / spans for k in range(1, spans)], 100 * spans)).first()[0] if spans > 1 else None
    span = rank_among(sorted(set(marks or [])), micros)
    placed = placed.withColumn("span", span)
    response = F.when(
        F.col("status") == 200,
        F.struct("captured", "record_id", "headers", "digest"),
    )
    # Maps can't be compared, so the latest response is found by its time and id first.
    latest = placed.where("status = 200").groupBy("canonical", "span").agg(F.max_by(F.struct("captured", "record_id", "headers", "digest"), F.struct("captured", "record_id")).alias("last"))
    waiting = placed.where("status = 304").select("canonical", "span").distinct()
    by_span = Window.partitionBy("canonical").orderBy("span", "asked")
    carried = (
        latest.select("canonical", "span", "last", F.lit(1).alias("asked"))
        .unionByName(waiting.select("canonical", "span", F.lit(None).cast(latest.schema["last"].dataType).alias("last"), F.lit(0).alias("asked")))
        .withColumn("earlier", F.last("last", ignorenulls=True).over(by_span.rowsBetween(Window.unboundedPreceding, -1)))
        .where("asked = 0 and earlier is not null")
    )
    none = F.lit(None)
    seeds = carried.select("canonical", "span", F.lit(None).cast("timestamp").alias("captured"), none.cast("bigint").alias("record_id"), none.cast("int").alias("status"), F.col("earlier").alias("response"))
    lines = placed.select("canonical", "span", "captured", "record_id", "status", "headers", "digest", response.alias("response"))
    lines = lines.unionByName(seeds, allowMissingColumns=True)
    # At one time, revisits come before responses: an earlier response is asked for.
    order = Window.partitionBy("canonical", "span").orderBy(F.col("captured").asc_nulls_first(), F.desc("status"), "record_id")
    found = lines.withColumn("stored", F.last("response", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("status = 304")
    unplaced = kept.where("status = 304 and (canonical is null or captured is null)").withColumn("stored", F.lit(None).cast(found.schema["stored"].dataType))
    joined = found.select("record_id", "canonical", "captured", "headers", "digest", "stored").unionByName(unplaced.select("record_id", "canonical", "captured", "headers", "digest", "stored"))

    def header(of: str, name: str) -> Column:
        return F.element_at(F.col(of), name)

    tags = header("headers", "etag").isNotNull() & header("stored.headers", "etag").isNotNull()
    dates = header("headers", "last-modified").isNotNull() & header("stored.headers", "last-modified").isNotNull()
    digests = F.col("digest").isNotNull() & F.col("stored.digest").isNotNull()
    validator = F.when(F.col("stored").isNull(), "none").when(tags, "etag").when(dates, "last-modified").when(digests, "digest").otherwise("none")
    valid = (
        F.when(F.col("stored").isNull(), False)
        .when(tags, _strong(header("headers", "etag")) == _strong(header("stored.headers", "etag")))
        .when(dates, header("headers", "last-modified") == header("stored.headers", "last-modified"))
        .when(digests, F.col("digest") == F.col("stored.digest"))
        .otherwise(F.lit(None).cast("boolean"))
    )
    decided = joined.select("*", validator.alias("validator"), valid.alias("valid"))
    fixed = F.array(*[F.lit(x) for x in KEPT_HEADERS])
    fresh = F.map_filter("headers", lambda k, v: ~F.array_contains(fixed, k))
    old = F.map_filter("stored.headers", lambda k, v: ~F.map_contains_key(fresh, k))
    return decided.select(
        "record_id", "canonical", "captured", F.col("stored.record_id").alias("response_id"), "validator", "valid", F.when(F.col("valid"), F.map_concat(old, fresh)).otherwise(F.col("headers")).alias("headers")
    )


def page_records(pages: DataFrame) -> DataFrame:
    """A crawl made of ``pages``: every page was captured in full, and revisited later with its own entity tag.

    The page ``p`` is captured ``p`` minutes, and revisited ``3 * p + 7`` minutes into the crawl (``p`` modulo MINUTES), so other captures of
    its canonical address can come between. Every fifth page has no tag but a date, and every seventh revisit
    carries an outdated tag. (The tables hold pages only, not the records around them.)
    """
    start, minute = F.lit(1_700_000_000), F.pmod(F.col("page_id"), F.lit(MINUTES))
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), F.floor(F.col("page_id") / 1440).cast("string"))
    base = pages.where("page_id is not null").select("page_id", "url", digest.alias("digest"), tag.alias("tag"), date.alias("date"), F.length("html").cast("string").alias("size"))
    dated = F.col("page_id") % 5 == 0
    full = base.select(
        (2 * F.col("page_id")).alias("record_id"), "url", F.timestamp_seconds(start + 60 * minute).alias("captured"), F.lit(200).alias("status"),
        F.when(dated, F.create_map(F.lit("Last-Modified"), F.col("date"), F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.coalesce("size", F.lit("0")), F.lit("Age"), F.lit("0")))
        .otherwise(F.create_map(F.lit("ETag"), F.col("tag"), F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.coalesce("size", F.lit("0")), F.lit("Age"), F.lit("0"))).alias("headers"),
        "digest",
    )
    sent = F.when(F.col("page_id") % 7 == 0, F.lit('"outdated"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    again = base.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", F.timestamp_seconds(start + 60 * (3 * minute + 7)).alias("captured"), F.lit(304).alias("status"),
        F.when(dated, F.create_map(F.lit("last-modified"), F.col("date"), F.lit("content-length"), F.lit("0"), F.lit("age"), (F.col("page_id") % 60).cast("string")))
        .otherwise(F.create_map(F.lit("etag"), sent, F.lit("content-length"), F.lit("0"), F.lit("age"), (F.col("page_id") % 60).cast("string"))).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return full.unionByName(again)


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``resolve_revisits`` of the crawl made of all pages; a page without id has no captures, equal pages equal ones."""
    records = materialize(page_records(table(spark, sf_dir, "pages")), "records")
    found = resolve_revisits(records)
    listed = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.select(
        F.floor(F.col("record_id") / 2).cast("bigint").alias("page_id"), "record_id", "canonical", F.unix_seconds("captured").alias("captured_s"), "response_id", "validator", "valid", F.array_join(listed, "; ").alias("headers")
    )


ORACLE_SQL = r"""
with base as (select page_id, md5(coalesce(html, '')) as digest, coalesce(cast(length(html) as varchar), '0') as size,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from pages where page_id is not null),
cut as (select *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^(www|m)\.|:(80|443)$', '', 'g') as host, regexp_replace(bare, '^[^/?]*', '') as rest from base),
parted as (select *, regexp_replace(regexp_replace(rest, '\?.*$', ''), '(\.html?|/)+$', '') as path,
    case when contains(rest, '?') then regexp_replace(regexp_replace(regexp_replace(rest, '^[^?]*\?', ''), '(?i)(^|&)(utm_[a-z]+|fbclid|gclid|ref|sessionid|phpsessid)=[^&]*', '', 'g'), '^&', '') else '' end as query from cut),
page as (select page_id, host || path || case when query <> '' then '?' || query else '' end as canonical, size, page_id % 5 = 0 as dated, 'day ' || (page_id // 1440) as day, '"' || substr(digest, 1, 16) || '"' as tag from parted),
responses as (select *, 2 * page_id as record_id, 1700000000 + 60 * (page_id % 1000000000) as t from page),
revisits as (select *, 2 * page_id + 1 as record_id, 1700000000 + 60 * (3 * (page_id % 1000000000) + 7) as t, case when page_id % 7 = 0 then '"outdated"' else 'W/' || tag end as sent from page),
met as (select r.page_id, r.record_id, r.canonical, r.t, r.dated, r.day, r.sent, f.record_id as response_id, f.dated as was_dated, f.day as was_day, f.tag as was_tag, f.size as was_size
    from revisits r asof left join responses f on r.canonical = f.canonical and r.t > f.t),
judged as (select *, case when response_id is null then 'none' when not dated and not was_dated then 'etag' when dated and was_dated then 'last-modified' else 'none' end as validator,
    case when response_id is null then false when not dated and not was_dated then regexp_replace(sent, '^W/', '') = was_tag when dated and was_dated then day = was_day end as valid from met)
select page_id, record_id, canonical, t as captured_s, response_id, validator, valid,
    'age: ' || (page_id % 60) || case when valid then '; content-length: ' || was_size || '; content-type: text/html' else '; content-length: 0' end
    || case when not dated then '; etag: ' || sent when valid and not was_dated then '; etag: ' || was_tag else '' end
    || case when dated then '; last-modified: ' || day when valid and was_dated then '; last-modified: ' || was_day else '' end as headers
from judged
"""
