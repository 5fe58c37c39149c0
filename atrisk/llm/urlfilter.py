"""Temporal list join: which list entries covered a URL when it was fetched.

Dated entries (list, key, time, action) become a state per list and key over time. A
capture looks up every key it falls under (host, each parent domain, host with its
first path segment) and takes, by an as-of join, the last entry at or before its fetch.

The join is one sort over the union of captures and entries per (list, key), split
into time buckets so that a host with a third of all captures is many groups. Validity
intervals carry the state into the buckets: an entry is repeated at the start of each
later bucket that its interval covers. There are no pairs of captures and entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The lower-cased host without user, port and trailing dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def keys_of(url: Column) -> Column:
    """The list keys of a URL: the host, its parent domains of two labels or more, and the
    host with the first path segment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    first = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]+)", 1)
    both = F.when(first != "", F.concat(parents, F.array(F.concat(host, first)))).otherwise(parents)
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(both))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, key, listed, valid_from, valid_to``: entries as validity intervals, half open,
    the last without an end. Of entries at one time the one that lists wins."""
    one = entries.filter("list is not null and key is not null and at is not null").groupBy("list", "key", "at").agg(F.max(F.col("action") == "add").alias("listed"))
    w = Window.partitionBy("list", "key").orderBy("at")
    return one.select("list", "key", F.coalesce("listed", F.lit(False)).alias("listed"), F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to"))


def filter_captures(captures: DataFrame, entries: DataFrame, *, bucket_seconds: int = 7 * 86400, captures_a_task: int = 50_000) -> DataFrame:
    """``page_id, url, fetched_at, blocked, lists`` of every capture.

    ``captures`` has page_id, url and fetched_at; ``entries`` list, key, at and action ('add'
    or anything else, which removes). A capture with a null url or time matches nothing;
    rows that repeat (page_id, url, fetched_at) give one row. ``lists`` is sorted.

    Entries are carried only to the time buckets in which their key has captures. Captures of
    one key and bucket beyond ``captures_a_task`` are dealt by a hash over several groups,
    each of which gets the few entries.
    """
    rows = captures.select("page_id", "url", "fetched_at").distinct()
    wanted = rows.filter("fetched_at is not null").select("page_id", "url", "fetched_at", F.explode(keys_of(F.col("url"))).alias("key"))
    bucket = lambda c: F.floor(F.unix_seconds(c) / bucket_seconds)
    spans = intervals(entries)
    # listed states only: what is removed leaves nothing to carry
    last = F.lit(wanted.agg(F.max("fetched_at")).first()[0]).cast(entries.schema["at"].dataType)
    listed = spans.filter("listed").withColumn("last", last).filter("valid_from <= last")
    ends = F.coalesce(F.col("valid_to"), F.col("last"))
    asked = wanted.groupBy("key", bucket(F.col("fetched_at")).alias("bucket")).agg(F.ceil(F.count("*") / captures_a_task).alias("groups"))
    carried = listed.join(asked, "key").filter(F.col("bucket").between(bucket(F.col("valid_from")), bucket(F.least(ends, "last"))))
    # the state at a bucket's start, or the entry itself within its first bucket
    state = carried.select("key", "bucket", "list", "groups", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"), F.greatest(F.col("valid_from"), F.timestamp_seconds(F.col("bucket") * bucket_seconds).cast(entries.schema["at"].dataType)).alias("time"), "valid_to", F.lit(True).alias("entry"))
    lists = state.groupBy("key", "bucket").agg(F.collect_set("list").alias("lists"), F.first("groups").alias("groups"))
    group = F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.col("groups"))
    # a capture asks only for the lists that have an entry in its bucket
    asks = wanted.withColumn("bucket", bucket(F.col("fetched_at"))).join(lists, ["key", "bucket"]).select("key", "bucket", group.alias("group"), F.explode("lists").alias("list"), F.col("fetched_at").alias("time"), "page_id", "url")
    w = Window.partitionBy("list", "key", "bucket", "group").orderBy("time", F.col("entry").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = state.drop("groups").withColumns({"page_id": F.lit(None).cast("long"), "url": F.lit(None).cast("string")}).unionByName(asks.withColumns({"entry": F.lit(False), "valid_to": F.lit(None).cast(entries.schema["at"].dataType)}))
    asof = both.withColumns({"since": F.last(F.when(F.col("entry"), F.col("time")), ignorenulls=True).over(w), "until": F.max(F.when(F.col("entry"), F.struct("time", F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp")).alias("to")))).over(w)})
    hits = asof.filter("not entry and since is not null and time < until.to").groupBy("page_id", "url", F.col("time").alias("fetched_at")).agg(F.array_sort(F.collect_set("list")).alias("lists"))
    found = rows.join(hits, (rows.page_id.eqNullSafe(hits.page_id)) & (rows.url == hits.url) & (rows.fetched_at == hits.fetched_at), "left")
    return found.select(rows.page_id, rows.url, rows.fetched_at, hits.lists.isNotNull().alias("blocked"), F.coalesce(hits.lists, F.array().cast("array<string>")).alias("lists"))


def derived_captures(pages: DataFrame) -> DataFrame:
    """Fetch times for pages that carry none: eleven minutes apart from 2024 on, in a year."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 660, F.lit(31536000))).alias("fetched_at"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list history from the hosts of the pages: by a digest of its name a host is
    listed, removed and listed again over the year on two lists; parent domains as well."""
    hosts = pages.select(host_of(F.col("url")).alias("key")).filter("key is not null")
    keys = hosts.unionByName(hosts.select(F.regexp_replace("key", r"^[^.]+\.", "").alias("key")).filter("key like '%.%.%'")).distinct()
    digit = lambda i: F.conv(F.substring(F.md5(F.col("key").cast("binary")), i, 2), 16, 10).cast("long")
    day = 86400
    return keys.select(
        "key",
        F.explode(
            F.array(
                F.struct(F.lit("abuse").alias("list"), (digit(1) * day).alias("s"), F.lit("add").alias("action"), (digit(7) < 128).alias("kept")),
                F.struct(F.lit("abuse").alias("list"), ((digit(1) + digit(3) % 60 + 1) * day).alias("s"), F.lit("remove").alias("action"), (digit(7) < 128).alias("kept")),
                F.struct(F.lit("abuse").alias("list"), ((digit(1) + digit(3) % 60 + 30 + digit(5) % 40) * day).alias("s"), F.lit("add").alias("action"), (digit(7) < 64).alias("kept")),
                F.struct(F.lit("spam").alias("list"), (digit(9) * day + 3600).alias("s"), F.lit("add").alias("action"), (digit(11) < 80).alias("kept")),
            )
        ).alias("e"),
    ).filter("e.kept").select(F.col("e.list").alias("list"), "key", F.timestamp_seconds(F.lit(1704067200) + F.col("e.s")).alias("at"), F.col("e.action").alias("action"))


ORACLE = r"""
with pages_h as (select page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]+)', 1) as seg,
    to_timestamp(1704067200 + (page_id * 660) % 31536000)::timestamp as fetched_at from pages),
hosts as (select distinct host as key from pages_h where host is not null union select distinct regexp_replace(host, '^[^.]+\.', '') from pages_h where regexp_replace(host, '^[^.]+\.', '') like '%.%.%'),
d as (select key, ('0x' || md5(key)[1:2])::bigint d1, ('0x' || md5(key)[3:4])::bigint d3, ('0x' || md5(key)[5:6])::bigint d5, ('0x' || md5(key)[7:8])::bigint d7, ('0x' || md5(key)[9:10])::bigint d9, ('0x' || md5(key)[11:12])::bigint d11 from hosts),
e as (select key, 'abuse' as list, d1 * 86400 as s, true as listed from d where d7 < 128
    union all select key, 'abuse', (d1 + d3 % 60 + 1) * 86400, false from d where d7 < 128
    union all select key, 'abuse', (d1 + d3 % 60 + 30 + d5 % 40) * 86400, true from d where d7 < 64
    union all select key, 'spam', d9 * 86400 + 3600, true from d where d11 < 80),
e1 as (select key, list, to_timestamp(1704067200 + s)::timestamp as valid_from, bool_or(listed) as listed from e group by all),
iv as (select *, lead(valid_from) over (partition by key, list order by valid_from) as valid_to from e1),
lab as (select *, string_split(host, '.') as l from pages_h where host is not null),
ks as (select page_id, url, fetched_at, unnest(list_distinct(list_concat(list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: array_to_string(l[i:], '.')), case when seg <> '' then [host || seg] else [] end))) as key from lab),
hit as (select page_id, url, fetched_at, list_sort(list(distinct list)) as lists from ks join iv using (key) where listed and valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to) group by all)
select distinct p.page_id, p.url, p.fetched_at, hit.lists is not null as blocked, array_to_string(coalesce(hit.lists, []), ',') as lists
from pages_h p left join hit on p.page_id is not distinct from hit.page_id and p.url = hit.url and p.fetched_at = hit.fetched_at
"""
