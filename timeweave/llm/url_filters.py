"""URL filters: a temporal join of captures with dated list entries.

A list entry says that from a date on a domain is added to or removed from a list. Entries of one list and domain become
validity intervals [start, end), open-ended after the last addition. A capture is held against the entries for its host and
every parent domain that were active when it was fetched: the latest entry at that time, as of it. The most specific domain
decides; of lists at one domain an allow list wins, then the list first by name.

Intervals and captures meet by domain and time bucket, so a hot host with many dated entries meets only those near in time.
A numeric address (also one in brackets) is its own domain only. Of the captures' columns id, url and fetched are read; others,
whatever their names, are not. A capture without host or time is allowed, with no match; no captures give no rows. Entries without list, domain or date are ignored; of equal
entries one counts, and of an addition and a removal at one instant the removal. Repeated captures give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time bucket.
BUCKET_DAYS = 30
#: A host's labels beyond so many are never a list's domain.
MOST_LABELS = 127


def host(url: Column) -> Column:
    """The host of an absolute URL: lower case, without user, port and a final dot; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#@:\[\]]+)", 1))
    return F.nullif(F.regexp_replace(h, r"\.$", ""), F.lit(""))


def bucket(ts: Column, days: int = BUCKET_DAYS) -> Column:
    return F.floor(F.unix_timestamp(ts) / F.lit(days * 86400)).cast("long")


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, domain, start, end (null: still active) from list, kind, domain, action (add or remove), at."""
    ok = entries.where("list is not null and domain is not null and at is not null and action in ('add', 'remove')")
    one = ok.groupBy("list", "kind", "domain", "at").agg(F.max("action").alias("action"))
    by = Window.partitionBy("list", "kind", "domain").orderBy("at")
    changes = one.withColumn("was", F.lag("action").over(by)).where("was is null or was <> action")
    return changes.withColumn("end", F.lead("at").over(by)).where("action = 'add'").select("list", "kind", "domain", F.col("at").alias("start"), "end")


def filter_captures(captures: DataFrame, entries: DataFrame, until: Column, days: int = BUCKET_DAYS) -> DataFrame:
    """The captures' columns (id, url, fetched) with host, verdict (block, allow or none), list, domain and start of the entry that decides.

    until: a time after every capture, at which open intervals are cut into buckets.
    """
    h = captures.select("id", "url", "fetched", host(F.col("url")).alias("host"))
    # a numeric or bracketed address has no parent domains
    labels = F.when(F.col("host").rlike(r"^([0-9.]+|\[.*)$"), F.array("host")).otherwise(F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - MOST_LABELS), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    # distinct captures are judged once; what repeats is joined back by value
    asked = h.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    looked = asked.select("host", "fetched", F.explode(suffixes).alias("domain"), bucket(F.col("fetched"), days).alias("b"))
    spans = intervals(entries).withColumn("b", F.explode(F.sequence(bucket(F.col("start"), days), bucket(F.greatest(F.coalesce("end", until), F.col("start")), days))))
    hits = looked.join(spans, ["domain", "b"]).where("fetched >= start and (end is null or fetched < end)")
    best = F.min_by(F.struct("list", "kind", "domain", "start"), F.struct(-F.length("domain"), (F.col("kind") != "allow").cast("int"), "list")).alias("hit")
    judged = hits.groupBy("host", "fetched").agg(best)
    out = h.join(judged, ["host", "fetched"], "left")
    return out.select("id", "url", "fetched", "host", F.coalesce("hit.kind", F.lit("none")).alias("verdict"), F.col("hit.list").alias("list"), F.col("hit.domain").alias("domain"), F.col("hit.start").alias("entry_start"))


# ---------------------------------------------------------------- the query's captures and entries, from the table of pages


def captures_of(pages: DataFrame) -> DataFrame:
    """A page's fetch time is a rule of its id: spread over 2024, minute by minute."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(366 * 1440))
    return pages.select(F.col("page_id").alias("id"), "url", F.timestamp_seconds(F.lit(1704067200) + minute * 60).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries by rules of the hosts' checksums: some hosts and parent domains are added, removed and added again."""
    hosts = pages.select(host(F.col("url")).alias("domain")).where("domain is not null").distinct()
    names = hosts.union(hosts.select(F.regexp_extract("domain", r"^[^.]+\.(.+)$", 1))).where("domain <> '' and domain like '%.%'").distinct().withColumn("c", F.crc32(F.col("domain").cast("binary")))
    day = lambda d: F.timestamp_seconds(F.lit(1704067200) + (d % 366) * 86400)
    row = lambda lst, kind, action, at: F.struct(F.lit(lst).alias("list"), F.lit(kind).alias("kind"), F.lit(action).alias("action"), at.alias("at"))
    x = F.col("c")
    spam = F.when(x % 3 == 0, F.array(row("spam", "block", "add", day(x % 200)), row("spam", "block", "remove", day(x % 200 + 60)), row("spam", "block", "add", day(x % 200 + 120))))
    adult = F.when(x % 5 == 1, F.array(row("adult", "block", "add", day(x % 300))))
    good = F.when(x % 7 == 2, F.array(row("good", "allow", "add", day(x % 100)), row("good", "allow", "remove", day(x % 100 + 200))))
    none = F.array().cast("array<struct<list:string,kind:string,action:string,at:timestamp>>")
    return names.select("domain", F.explode(F.concat(*(F.coalesce(e, none) for e in (spam, adult, good)))).alias("e")).select("e.list", "e.kind", "domain", "e.action", "e.at")


ORACLE_SQL = r"""
with cap as (select page_id, url, to_timestamp(1704067200 + ((page_id * 7919) % (366 * 1440)) * 60) at time zone 'UTC' as fetched,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#@:\[\]]+)', 1)), '\.$', ''), '') as host from pages),
hosts as (select distinct host as domain from cap where host is not null),
names as (select distinct domain from (select domain from hosts union all select regexp_extract(domain, '^[^.]+\.(.+)$', 1) from hosts) where domain like '%.%'),
tab as (select i, list_reduce(list_prepend(i::bigint, range(8)), lambda a, k: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(256) t(i)),
tabs as (select list(v order by i) as t from tab),
sums as (select domain, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(domain) + 1), lambda k: ascii(domain[k])::bigint)), lambda a, b: xor(a >> 8, t[(xor(a & 255, b) + 1)::int])), 4294967295) as x from names, tabs),
entries as (
  select 'spam' as list, 'block' as kind, domain, 'add' as action, x % 200 as d from sums where x % 3 = 0
  union all select 'spam', 'block', domain, 'remove', x % 200 + 60 from sums where x % 3 = 0
  union all select 'spam', 'block', domain, 'add', x % 200 + 120 from sums where x % 3 = 0
  union all select 'adult', 'block', domain, 'add', x % 300 from sums where x % 5 = 1
  union all select 'good', 'allow', domain, 'add', x % 100 from sums where x % 7 = 2
  union all select 'good', 'allow', domain, 'remove', x % 100 + 200 from sums where x % 7 = 2),
dated as (select list, kind, domain, action, to_timestamp(1704067200 + (d % 366) * 86400) at time zone 'UTC' as since from entries),
latest as (select c.page_id, e.list, e.kind, e.domain, arg_max(e.action, e.since) as action, max(e.since) as entry_start
    from cap c join dated e on (c.host = e.domain or c.host like '%.' || e.domain and not regexp_matches(c.host, '^([0-9.]+|\[.*)$')) and e.since <= c.fetched group by all),
ranked as (select *, row_number() over (partition by page_id order by length(domain) desc, kind, list) as k from latest where action = 'add')
select c.page_id, c.url, c.fetched, c.host, coalesce(r.kind, 'none') as verdict, r.list, r.domain, r.entry_start
from cap c left join ranked r on c.page_id = r.page_id and r.k = 1
"""
