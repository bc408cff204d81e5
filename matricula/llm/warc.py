"""WARC: resolve not-modified revisits against the latest earlier full response of the same URL.

Records: (record_id, warc_type, target_uri, warc_date, status, payload_digest, headers). The as-of
join sorts responses and revisits together by (canonical URL, time) into range partitions, takes
the running last response inside each partition and hands over the last one of the partitions
before. A hot URL then spans as many partitions as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matricula.llm.base import cut

#: Query parameters that do not name a resource (fixed values).
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"

#: Header fields that a not-modified answer may update (fixed values, from the HTTP specifications).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

RECORD = (
    "record_id string, warc_type string, target_uri string, warc_date timestamp, status int, "
    "payload_digest string, headers map<string,string>"
)


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path without closing slashes, the other query
    parameters in order; scheme and fragment dropped. Null if there is no ``scheme://host``."""
    u = F.btrim(url)
    host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(host, ":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(u, "^[^?#]*[?]([^#]*)", 1)
    kept = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _lower_names(headers: Column) -> Column:
    """Headers with names in lower case; of names that differ only in case, the first in order stays."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    def first(all_: Column) -> Column:
        return F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, 1, i), lambda x: x["key"] == e["key"]))

    once = F.transform(F.array(entries), first)[0]
    return F.coalesce(F.map_from_entries(once), F.create_map().cast("map<string,string>"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit record: (record_id, url, verdict, base_id, base_date, status, payload_digest, headers).

    The base is the latest full response (type ``response``, status 200) of the canonical URL that is
    strictly earlier; of equally late ones the one with the largest record id. Validators: the entity tags,
    compared weakly, if both have one; else the modification dates; else the payload digests. Verdicts:
    ``resolved`` (status and digest are the base's, headers the base's updated by the permitted ones
    of the revisit), ``mismatch``, ``no_validator``, ``no_base``, ``no_key`` (null or unusable URL, or null time).
    Repeated records give a row each.
    """
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    base = records.select(
        canonical_url(F.col("target_uri")).alias("url"), F.col("warc_date").alias("at"), "record_id",
        F.when(full, 1).when(F.col("warc_type") == "revisit", 0).alias("kind"), "payload_digest", _lower_names(F.col("headers")).alias("headers"),
    ).where("kind is not null")
    keyed = F.col("url").isNotNull() & F.col("at").isNotNull()
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal times: revisits come first, so a response of the same time is not earlier than they are.
    order = ["url", "at", "kind", "record_id", "payload_digest"]
    rows = cut(
        base.where(keyed).repartitionByRange(n, *order).withColumn("block", F.spark_partition_id())
    )
    own = F.when(F.col("kind") == 1, F.struct("url", "at", "record_id", "payload_digest", "headers"))
    ends = rows.where("kind = 1").groupBy("block").agg(F.max_by(own, F.struct(*order)).alias("last"))
    # One row per block: the last response of the blocks before, in the same order.
    blocks = ends.select("block", "last").unionByName(
        rows.select("block").distinct().select("block", F.lit(None).cast(ends.schema["last"].dataType).alias("last"))
    ).groupBy("block").agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("near", F.last(own, ignorenulls=True).over(inside)).where("kind = 0")
    found = seen.join(carried, "block", "left").withColumn("b", F.coalesce("near", "carried")).withColumn(
        "b", F.when((F.col("b.url") == F.col("url")) & (F.col("b.at") < F.col("at")), F.col("b"))
    ).drop("near", "carried", "block")
    lost = base.where(~keyed & (F.col("kind") == 0)).withColumn("b", F.lit(None).cast(found.schema["b"].dataType))

    def tag(headers: str) -> Column:
        return F.regexp_replace(F.try_element_at(F.col(headers), F.lit("etag")), "^[Ww]/", "")

    def pair(a: Column, b: Column, then: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "resolved").otherwise("mismatch")).otherwise(then)

    def modified(headers: str) -> Column:
        return F.try_element_at(F.col(headers), F.lit("last-modified"))

    checked = pair(
        tag("headers"), tag("b.headers"),
        pair(modified("headers"), modified("b.headers"), pair(F.col("payload_digest"), F.col("b.payload_digest"), F.lit("no_validator"))),
    )
    verdict = F.when(F.col("url").isNull() | F.col("at").isNull(), "no_key").when(F.col("b").isNull(), "no_base").otherwise(checked)
    merged = F.map_concat(
        F.map_filter("b.headers", lambda k, _: ~(k.isin(*PERMITTED) & F.map_contains_key(F.col("headers"), k))),
        F.map_filter("headers", lambda k, _: k.isin(*PERMITTED)),
    )
    ok = F.col("verdict") == "resolved"
    return found.unionByName(lost).withColumn("verdict", verdict).select(
        "record_id", "url", "verdict", F.col("b.record_id").alias("base_id"), F.col("b.at").alias("base_date"),
        F.when(ok, 200).alias("status"), F.when(ok, F.col("b.payload_digest")).alias("payload_digest"), F.when(ok, merged).alias("headers"),
    )


#: Stand-in archive: rows of the record schema from ``pages`` (plain SQL of Spark and DuckDB). Every page has a response
#: and a later revisit under another spelling of its URL; some have a second response and revisit, or an early revisit.
_PAGES = """
  select page_id, url, 1704067200 + (page_id * 7919) % 86400 * 10 as t, md5(html) as body, md5(url) as other,
         regexp_replace(url, '^(https?)://([^/]*)', '\\1://\\2:443') as respelt
  from pages
"""
_RECORDS = """
  select 'r' || cast(page_id as string) || '-0' as record_id, 'response' as warc_type, url as target_uri, t as at, 200 as status, body as payload_digest,
         case when page_id % 6 = 0 then null else '"' || body || '"' end as etag, 'day ' || cast(page_id % 365 as string) as modified,
         'max-age=60' as cache, '512' as length from p
  union all select 'r' || cast(page_id as string) || '-1', 'revisit', respelt || '#again', t + 90000 + page_id % 1000, 304, body,
         case when page_id % 6 = 0 then null when page_id % 5 = 1 then '"' || other || '"' else 'W/"' || body || '"' end,
         'day ' || cast(page_id % 365 as string), 'no-cache', '0' from p
  union all select 'r' || cast(page_id as string) || '-2', 'response', url, t + 200000, 200, other, '"' || other || '"', null, 'private', '77' from p where page_id % 4 = 0
  union all select 'r' || cast(page_id as string) || '-3', 'revisit', respelt, t + 300000, 304, null, '"' || other || '"', null, 'public', '0' from p where page_id % 4 = 0
  union all select 'r' || cast(page_id as string) || '-4', 'revisit', url, t - 50, 304, body, '"' || body || '"', null, 'public', '0' from p where page_id % 9 = 0
"""


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Stand-in archive records (see ``RECORD``) from (page_id, url, html)."""
    spark = pages.sparkSession
    name = "warc_pages"
    pages.select("page_id", "url", "html").createOrReplaceTempView(name)
    sql = f"with p as ({_PAGES.replace('from pages', 'from ' + name).replace(chr(92) + '1', '$1').replace(chr(92) + '2', '$2')}) {_RECORDS}"
    r = spark.sql(sql)
    named = {"ETag": "etag", "Last-Modified": "modified", "Cache-Control": "cache", "Content-Length": "length"}
    headers = F.map_filter(F.create_map(*[x for k, c in named.items() for x in (F.lit(k), F.col(c))]), lambda _, v: v.isNotNull())
    return r.select(
        "record_id", "warc_type", "target_uri", F.timestamp_seconds("at").alias("warc_date"), "status", "payload_digest", headers.alias("headers")
    )


def resolved_text(found: DataFrame) -> DataFrame:
    """The resolved revisits with headers as sorted lines and the base's time in seconds."""
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.select(
        "record_id", "url", "verdict", "base_id", F.unix_seconds("base_date").alias("base_at"), "status", "payload_digest",
        F.array_join(lines, "\n").alias("header_lines"),
    )


ORACLE_SQL = f"""
with p as ({_PAGES}), r as ({_RECORDS}), parts as (
  select *, regexp_replace(lower(regexp_extract(trim(target_uri), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)?$', '') as host,
    regexp_replace(regexp_extract(trim(target_uri), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') as path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(trim(target_uri), '^[^?#]*[?]([^#]*)', 1), '&'),
      lambda x: x <> '' and not regexp_matches(x, '{TRACKING}'))), '&') as args
  from r
), c as (
  select *, host || path || case when args <> '' then '?' || args else '' end as u, regexp_replace(etag, '^[Ww]/', '') as tag from parts
), pairs as (
  select v.*, b.record_id as b_id, b.at as b_at, b.tag as b_tag, b.etag as b_etag, b.modified as b_modified, b.payload_digest as b_digest, b.length as b_length,
    row_number() over (partition by v.record_id order by b.at desc, b.record_id desc) as k
  from (select * from c where warc_type = 'revisit') v left join (select * from c where warc_type = 'response') b on v.u = b.u and b.at < v.at
), judged as (
  select *, case when b_id is null then 'no_base'
      when tag is not null and b_tag is not null then case when tag = b_tag then 'resolved' else 'mismatch' end
      when modified is not null and b_modified is not null then case when modified = b_modified then 'resolved' else 'mismatch' end
      when payload_digest is not null and b_digest is not null then case when payload_digest = b_digest then 'resolved' else 'mismatch' end
      else 'no_validator' end as verdict
  from pairs where k = 1
)
select record_id, u as url, verdict, b_id as base_id, cast(b_at as bigint) as base_at, case when verdict = 'resolved' then 200 end as status,
  case when verdict = 'resolved' then b_digest end as payload_digest,
  case when verdict = 'resolved' then array_to_string(list_sort(list_filter([
    'cache-control: ' || cache, 'content-length: ' || b_length, 'etag: ' || coalesce(etag, b_etag), 'last-modified: ' || coalesce(modified, b_modified)
  ], lambda x: x is not null)), chr(10)) end as header_lines
from judged
"""
