"""Temporal URL filters: every capture is judged by the list as it stood when it was fetched.

A list is a log of dated changes. Per entry (scope and key), a change holds from
its time until the next change of that entry: the log becomes validity
intervals, disjoint per entry. A capture asks for all keys of its URL (path
prefixes, host, its domain and each parent domain), and an as-of join (equality of
scope and key, fetch time inside the interval) finds the entries active at that
time. The most specific active entry decides: prefix before host before domain, a
longer prefix or domain before a shorter one; "allow" entries shield what a wider
entry blocks. A domain entry covers the host of that name and all below it.

URLs and entries are compared in one form: host in lower case without user, port
and final dot, path without empty segments. A path is asked for only at the depths
that entries of the list have, so a URL's keys do not grow with the square of its length.

Only DataFrame functions: Spark broadcasts the intervals where their size is
known to be small and otherwise shuffles both sides by key, where AQE splits a
hot host. Exact repeats of a capture are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlens.llm.common import shuffle_partitions

SCOPES = {"domain": 1, "host": 2, "prefix": 3}


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*+://(?:[^/?#@]*+@)?([^/?#:@]++)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*+://[^/?#]++/([^?#]*+)"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without a final dot (null without one)."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")
    return F.when(host != "", host)


def segments_of(url: Column) -> Column:
    """The path segments of a URL, empty ones left out."""
    return F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda x: x != "")


def prefix_of(url: Column) -> Column:
    """Host and first path segment, as ``host/segment`` (null without one)."""
    return F.concat(host_of(url), F.lit("/"), F.get(segments_of(url), F.lit(0)))


def depth_of(key: Column) -> Column:
    """The number of path segments of a prefix entry."""
    return F.size(F.split(key, "/")) - 1


def domains_of(host: Column) -> Column:
    """The host and all its proper suffixes, of at least two labels each, the longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(
        F.slice(labels, i, n - i + 1), "."))).otherwise(F.array().cast("array<string>"))


def keys_of(url: Column, depths: list[int]) -> Column:
    """Array of (scope, key, rank) under which a URL may be listed, its path cut at ``depths``."""
    key = "array<struct<scope:string,key:string,rank:int>>"
    none = F.array().cast("array<string>")
    host, segments = host_of(url), segments_of(url)

    def entry(scope: str, value: Column, more: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), value.alias("key"), (F.lit(SCOPES[scope] * 1_000_000) + more).alias("rank"))

    domains = F.transform(F.coalesce(domains_of(host), none), lambda d: entry("domain", d, F.size(F.split(d, r"\."))))
    own = F.when(host.isNotNull(), F.array(entry("host", host, F.lit(0)))).otherwise(F.array().cast(key))
    cuts = F.filter(F.array(*[F.lit(d) for d in sorted(depths)]).cast("array<int>"), lambda d: d <= F.size(segments))
    prefixes = F.transform(F.when(host.isNotNull(), cuts).otherwise(F.array().cast("array<int>")), lambda d: entry(
        "prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), d), "/")), d))
    return F.concat(prefixes.cast(key), own.cast(key), domains.cast(key))


def entry_key(scope: Column, key: Column) -> Column:
    """An entry's key in the form that URLs are asked for."""
    parts = F.filter(F.split(key, "/"), lambda x: x != "")
    host = F.regexp_replace(F.lower(F.get(parts, F.lit(0))), r"\.$", "")
    path = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(scope == "prefix", F.array_join(F.concat(F.array(host), path), "/")).otherwise(
        F.regexp_replace(F.lower(key), r"\.$", ""))


def intervals(changes: DataFrame) -> DataFrame:
    """``changes(scope, key, changed_on, action)`` -> ``(scope, key, action, valid_from, valid_to)``.

    ``action`` is block, allow or remove; an entry's last change stays valid
    (``valid_to`` null). Of several changes of one entry at one time the
    smallest action counts (allow, then block, then remove). Rows with a null
    scope, key, time or action are no changes.
    """
    good = changes.dropna(subset=["scope", "key", "changed_on", "action"]).withColumn(
        "key", entry_key(F.col("scope"), F.col("key")))
    one = good.groupBy("scope", "key", "changed_on").agg(F.min("action").alias("action"))
    until = F.lead("changed_on").over(Window.partitionBy("scope", "key").orderBy("changed_on"))
    return (one.withColumn("valid_to", until).filter("action <> 'remove'")
            .select("scope", "key", "action", F.col("changed_on").alias("valid_from"), "valid_to"))


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """One row ``(page_id, url, fetched_on, n_active, blocked, rule)`` per capture.

    ``n_active`` counts the entries active at fetch time, ``rule`` is the deciding
    one as ``action scope key``. A null or malformed URL and a null time match no
    entry: 0, false, null. Repeated captures give repeated rows; further
    columns are ignored.
    """
    asked = captures.groupBy("page_id", "url", "fetched_on").agg(F.count(F.lit(1)).alias("copies"))
    listed = intervals(changes)
    depths = [r["d"] for r in listed.filter("scope = 'prefix'").select(  # a number per depth of an entry
        depth_of(F.col("key")).alias("d")).distinct().collect() if r["d"] > 0]
    each = asked.select("url", "fetched_on").distinct().repartition(
        shuffle_partitions(captures.sparkSession), "url", "fetched_on")
    keys = each.withColumn("k", F.explode(keys_of(F.col("url"), depths))).select(
        "url", "fetched_on", "k.scope", "k.key", "k.rank")
    active = keys.join(listed, (keys.scope == listed.scope) & (keys.key == listed.key)
                       & (keys.fetched_on >= listed.valid_from)
                       & (listed.valid_to.isNull() | (keys.fetched_on < listed.valid_to)))
    verdict = active.groupBy("url", "fetched_on").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("rank", "valid_from", listed.action, listed.scope, listed.key)).alias("top"))
    v = verdict.select(F.col("url").alias("v_url"), F.col("fetched_on").alias("v_on"), "n", "top")
    return (asked.join(v, (F.col("url") == F.col("v_url")) & (F.col("fetched_on") == F.col("v_on")), "left")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("page_id", "url", "fetched_on", F.coalesce("n", F.lit(0).cast("long")).alias("n_active"),
                    F.coalesce(F.col("top.action") == "block", F.lit(False)).alias("blocked"),
                    F.concat_ws(" ", "top.action", "top.scope", "top.key").alias("_rule"), "top")
            .withColumn("rule", F.when(F.col("top").isNotNull(), F.col("_rule"))).drop("top", "_rule"))


# ---- the query's dated list: derived from the hosts of the pages themselves --


def _number(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("int")


def list_changes(pages: DataFrame) -> DataFrame:
    """A change log over a year, derived from the pages' own hosts, domains and prefixes."""
    start = F.lit("2024-01-01").cast("date")
    m = F.col("m")

    def log(keys: Column, scope: str, every: int, dates: list[tuple]) -> DataFrame:
        own = pages.select(F.explode(keys).alias("key")).filter("key is not null").distinct().withColumn(
            "m", _number(F.col("key"))).filter(m % every == 0)
        each = F.explode(F.array(*[F.struct(F.date_add(start, day).alias("on"), F.lit(action).alias("action"))
                                   for day, action in dates]))
        return own.select(F.lit(scope).alias("scope"), "key", each.alias("c")).select(
            "scope", "key", F.col("c.on").alias("changed_on"), F.col("c.action").alias("action"))

    host = log(F.array(host_of(F.col("url"))), "host", 3,
               [(m % 120, "block"), (m % 120 + 30 + m % 60, "remove"), (m % 120 + 200, "block")])
    domain = log(domains_of(host_of(F.col("url"))), "domain", 7, [(m % 90, "block"), (m % 90 + 180, "remove")])
    prefix = log(F.array(prefix_of(F.col("url"))), "prefix", 5, [(m % 200, "allow")])
    return host.unionByName(domain).unionByName(prefix)


def dated_captures(pages: DataFrame) -> DataFrame:
    """``(page_id, url, fetched_on)``: the pages, dated over the year by their id."""
    day = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_on"))


SQL = r"""
WITH p AS (
  SELECT page_id, url, CAST('2024-01-01' AS DATE) + CAST((page_id * 37) % 366 AS INTEGER) AS fetched_on,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)),
      '\.$', ''), '') AS host,
    nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/+([^/?#]+)', 1), '') AS segment,
    row_number() OVER () AS r
  FROM pages
), k AS (
  SELECT r, fetched_on, 'host' AS scope, host AS key, 2000 AS rank FROM p WHERE host IS NOT NULL
  UNION ALL SELECT r, fetched_on, 'prefix', host || '/' || segment, 3000 FROM p WHERE segment IS NOT NULL
  UNION ALL SELECT r, fetched_on, 'domain', array_to_string(l[i:], '.'), 1000 + len(l) - i + 1
  FROM (SELECT r, fetched_on, string_split(host, '.') AS l FROM p WHERE host IS NOT NULL), unnest(range(1, len(l))) u(i)
), keys AS (
  SELECT DISTINCT scope, key, ('0x' || substr(md5(key), 1, 6))::INT AS m FROM k
), log AS (
  SELECT scope, key, m % 120 AS day, 'block' AS action FROM keys WHERE scope = 'host' AND m % 3 = 0
  UNION ALL SELECT scope, key, m % 120 + 30 + m % 60, 'remove' FROM keys WHERE scope = 'host' AND m % 3 = 0
  UNION ALL SELECT scope, key, m % 120 + 200, 'block' FROM keys WHERE scope = 'host' AND m % 3 = 0
  UNION ALL SELECT scope, key, m % 90, 'block' FROM keys WHERE scope = 'domain' AND m % 7 = 0
  UNION ALL SELECT scope, key, m % 90 + 180, 'remove' FROM keys WHERE scope = 'domain' AND m % 7 = 0
  UNION ALL SELECT scope, key, m % 200, 'allow' FROM keys WHERE scope = 'prefix' AND m % 5 = 0
), valid AS (
  SELECT scope, key, action, CAST('2024-01-01' AS DATE) + CAST(day AS INTEGER) AS valid_from,
    CAST('2024-01-01' AS DATE) + CAST(lead(day) OVER (PARTITION BY scope, key ORDER BY day) AS INTEGER) AS valid_to
  FROM log
), active AS (
  SELECT r, action, scope, key, row_number() OVER (PARTITION BY r ORDER BY rank DESC) AS nth,
    count(*) OVER (PARTITION BY r) AS n
  FROM k JOIN valid USING (scope, key)
  WHERE action <> 'remove' AND fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to)
)
SELECT page_id, url, CAST(fetched_on AS VARCHAR) AS fetched_on, coalesce(n, 0) AS n_active,
  coalesce(action = 'block', false) AS blocked, action || ' ' || scope || ' ' || key AS rule
FROM p LEFT JOIN (SELECT * FROM active WHERE nth = 1) USING (r)
"""
