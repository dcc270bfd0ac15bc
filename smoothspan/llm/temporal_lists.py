"""URL filters by a temporal list join.

A list is a log of dated entries: at a time, a list blocks (``action`` 1) or clears (0) a pattern, which is a host or a parent
domain. The entries of one list and pattern become validity intervals: an entry holds from its time until the next one. Every
capture is evaluated against the entries active at its fetch time, found by an as-of join under its host and all parent
domains. The most specific pattern decides: if any list blocks it then, the capture is blocked (the first such list by name is
reported), and it is cleared only if no list does.

The as-of join is an equi-join: intervals are cut into periods of ``period_s`` seconds, and captures carry their period, so a
host with a third of all captures and a long history meets, in each period, only the entries of that period. Open intervals
end after the last capture. A join on (pattern, period) can be split by adaptive execution, as no aggregate needs its rows
together before; the decision is aggregated by capture.

All steps are DataFrame expressions. Defined results: captures with a null or unreadable URL or no fetch time match nothing;
entries with a null pattern, list or time are ignored; entries of one list, pattern and time count as one, blocking if one of
them blocks; an entry holds from its own second on; repeated captures get repeated results (rows without id stay apart by their URL and
time); very long URLs are read whole; no entries or no captures give unmatched or no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smoothspan.llm.scratch import cut


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user, port and a trailing dot; empty if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(host, r"\.+$", "")


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more, the host first."""
    parts = F.split(host, r"\.")
    count = F.greatest(F.size(parts) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, action, start, end) of (list, pattern, action, at): end is null for the last entry."""
    known = entries.where("list IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL")
    single = known.groupBy("list", "pattern", "at").agg(F.max("action").alias("action"))
    later = Window.partitionBy("list", "pattern").orderBy("at")
    return single.select("list", "pattern", "action", F.col("at").alias("start"), F.lead("at").over(later).alias("end"))


def temporal_join(captures: DataFrame, entries: DataFrame, period_s: int = 30 * 86_400) -> DataFrame:
    """(id, url, fetched_at, host, pattern, list, listed_at, blocked) of captures (id, url, at); times are in whole seconds."""
    period = lambda c: F.floor(c / period_s)
    held = captures.select("id", "url", "at", host_of(F.col("url")).alias("host"))
    held = cut(held, "lists-captures")
    span = held.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    low, high = (0, -1) if span["low"] is None else (int(span["low"]), int(span["high"]))
    spans = intervals(entries).withColumn("end", F.coalesce("end", F.greatest("start", F.lit(high)) + 1))
    spans = spans.where((F.col("start") <= high) & (F.col("end") > low))
    spans = spans.withColumn("period", F.explode(F.sequence(period(F.greatest("start", F.lit(low))), period(F.least(F.col("end") - 1, F.lit(high))))))
    asked = held.where("host <> '' AND at IS NOT NULL").select("id", "url", "at", period(F.col("at")).alias("period"), F.posexplode(domains_of(F.col("host"))).alias("depth", "pattern"))
    met = asked.join(spans, ["pattern", "period"]).where("at >= start AND at < end")
    best = met.groupBy("id", "url", "at").agg(F.min(F.struct("depth", (F.lit(0) - F.col("action")).alias("clears"), "list", "pattern", "start", "action")).alias("b"))
    best = best.select(F.col("id").alias("id_"), F.col("url").alias("url_"), F.col("at").alias("at_"), F.col("b.pattern").alias("pattern"), F.col("b.list").alias("list"), F.col("b.start").alias("listed_at"), (F.col("b.action") == 1).alias("blocked"))
    on = held["id"].eqNullSafe(best["id_"]) & (held["url"] == best["url_"]) & (held["at"] == best["at_"])
    out = held.join(best, on, "left")
    return out.select("id", "url", F.col("at").alias("fetched_at"), "host", "pattern", "list", "listed_at", F.coalesce("blocked", F.lit(False)).alias("blocked"))


# The test tables hold no lists and no fetch times: both are derived from ids and hosts, in the same way here and in the SQL.
FIRST_FETCH = 1_704_067_200
LIST_NAMES = ("ads", "malware", "spam")


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def demo_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: one fetch each 97 seconds by id, over about a year."""
    return pages.select(F.col("page_id").alias("id"), "url", (F.lit(FIRST_FETCH) + F.pmod(F.col("page_id") * 97_003, F.lit(31_536_000))).alias("at"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """For each domain and list some entries, at times and with actions drawn from a hash."""
    domains = pages.select(F.explode(domains_of(host_of(F.col("url")))).alias("pattern")).where("pattern <> ''").distinct()
    each = domains.crossJoin(F.broadcast(domains.sparkSession.range(len(LIST_NAMES) * 4).toDF("k")))  # 12 rows for each domain
    name = F.element_at(F.array(*[F.lit(x) for x in LIST_NAMES]), (F.col("k") % len(LIST_NAMES) + 1).cast("int"))
    seed = F.concat_ws("|", "pattern", F.col("k").cast("string"))
    return each.where(_number(seed) % 3 == 0).select(
        name.alias("list"), "pattern", (_number(F.concat(seed, F.lit("a"))) % 2).cast("int").alias("action"), (F.lit(FIRST_FETCH) + _number(F.concat(seed, F.lit("t"))) % 31_536_000).alias("at")
    )


ORACLE_SQL = r"""
WITH captures AS (
  SELECT page_id AS id, url, 1704067200 + (page_id * 97003) % 31536000 AS fetched_at,
         regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.+$', '') AS host
  FROM pages
), parts AS (SELECT *, string_split(host, '.') AS p FROM captures WHERE host <> ''),
asked AS (
  SELECT id, url, fetched_at, k - 1 AS depth, array_to_string(p[k:], '.') AS pattern
  FROM (SELECT *, unnest(range(1, greatest(len(p) - 1, 1) + 1)) AS k FROM parts)
), seeds AS (
  SELECT pattern, k, pattern || '|' || k AS s, ['ads', 'malware', 'spam'][k % 3 + 1] AS list
  FROM (SELECT DISTINCT pattern FROM asked), range(12) r(k)
), numbers AS (
  SELECT *, CAST('0x' || md5(s)[1:8] AS BIGINT) AS n, CAST('0x' || md5(s || 'a')[1:8] AS BIGINT) AS a, CAST('0x' || md5(s || 't')[1:8] AS BIGINT) AS t FROM seeds
), entries AS (
  SELECT list, pattern, 1704067200 + t % 31536000 AS listed_at, max(a % 2) AS action FROM numbers WHERE n % 3 = 0 GROUP BY 1, 2, 3
), spans AS (SELECT *, lead(listed_at) OVER (PARTITION BY list, pattern ORDER BY listed_at) AS until FROM entries),
met AS (
  SELECT a.id, a.url, a.fetched_at, s.pattern, s.list, s.listed_at, s.action = 1 AS blocked,
         row_number() OVER (PARTITION BY a.id, a.url, a.fetched_at ORDER BY a.depth, s.action DESC, s.list) AS r
  FROM asked a JOIN spans s ON a.pattern = s.pattern AND a.fetched_at >= s.listed_at AND (s.until IS NULL OR a.fetched_at < s.until)
)
SELECT c.id, c.url, c.fetched_at, c.host, m.pattern, m.list, m.listed_at, coalesce(m.blocked, false) AS blocked
FROM captures c LEFT JOIN met m ON c.id = m.id AND c.url = m.url AND c.fetched_at = m.fetched_at AND m.r = 1
"""
