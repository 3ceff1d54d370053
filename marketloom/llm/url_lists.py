"""URL filtering with dated lists: an as-of join of captures and list entries.

Entries (rule, action, at) become disjoint validity intervals of each rule. A capture looks up its
host and every parent domain of two labels or more in the month of its fetch time; of the
intervals that hold that time the most specific rule decides. A month of a rule has the intervals
that begin in it, and the one that holds as it begins: that comes from a running last state over
the months in which the rule is asked for or changes, so no interval is spread over time and an
odd fetch time costs a row. Only DataFrame functions are used. Each (host, time) is looked up
once, and keys of the join are (rule, month), so a hot host spreads over time and adaptive
execution can split it further; the list is broadcast only where Spark knows it to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 30 * 86_400
#: Scheme, what names a user (up to the last @), and the host, which may be an address in brackets;
#: a backslash separates like a slash.
HOST = r"^[a-z][a-z0-9+.-]*:[/\\]{2}(?:[^/?#\\]*@)?(\[[^\]/?#\\]*\]|[^/?#\\:@]*)"
#: What is no part of a URL: blanks and control characters around it, tabs and line breaks in it.
STRAY = r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]"

#: Characters of a host name, at most (longer ones aren't names).
LONGEST = 253


def bucket_of(at):
    """The month-long bucket of a time; whole numbers only."""
    return F.call_function("floor", F.call_function("div", at, F.lit(BUCKET)))


def host_of(url):
    """Lower-case host of a URL, or null; a closing dot isn't part of it."""
    host = F.regexp_replace(F.regexp_extract(F.lower(F.regexp_replace(url, STRAY, "")), HOST, 1), r"\.+$", "")
    return F.when(F.length(host).between(1, LONGEST), host)


def parent_of(host):
    """What follows the first label, or null if that isn't a host of two labels or more."""
    rest = F.regexp_extract(host, r"^[^.]+\.(.+\..+)$", 1)
    return F.nullif(rest, F.lit(""))


def rules_of(host):
    """The host and its parent domains of two labels or more, nearest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda k: F.array_join(F.slice(labels, k, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """Disjoint intervals [since, until) in which a rule is listed, from rule, action, at; until is
    null where nothing ends it.

    A rule is listed from an 'add' to the next 'remove'; further adds in between change nothing;
    of entries at one time a 'remove' holds. Entries with a null in any column, or another
    action, don't count.
    """
    known = entries.where("rule is not null and at is not null and action in ('add', 'remove')")
    known = known.groupBy("rule", "at").agg(F.max("action").alias("action"))
    line = Window.partitionBy("rule").orderBy("at")
    turns = known.withColumn("before", F.lag("action").over(line)).where("before is null or before <> action")
    return turns.withColumn("until", F.lead("at").over(line)).where("action = 'add'").select("rule", F.col("at").alias("since"), "until")


def by_month(listed: DataFrame, asked: DataFrame) -> DataFrame:
    """The intervals that each month of `asked` (rule, bucket) needs: those that begin in it, and
    the one that began before and is the last to do so."""
    own = listed.select("rule", bucket_of(F.col("since")).alias("bucket"), "since", "until")
    turns = own.groupBy("rule", "bucket").agg(F.max(F.struct("since", "until")).alias("x"), F.lit(False).alias("asked"))
    months = turns.unionByName(asked.select("rule", "bucket", F.lit(None).cast(turns.schema["x"].dataType).alias("x"), F.lit(True).alias("asked")))
    months = months.groupBy("rule", "bucket").agg(F.max("x").alias("x"), F.max("asked").alias("asked"))
    line = Window.partitionBy("rule").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = months.withColumn("held", F.last("x", True).over(line)).where("asked and held is not null")
    return own.unionByName(held.select("rule", "bucket", "held.since", "held.until"))


def decide(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_at, host, blocked, blocked_by ('host', 'parent' or null), rule, since.

    captures: page_id, url, fetched_at (seconds). A null or malformed URL or a null time is never
    blocked; repeated captures stay; a host's own rule comes before its parent's, and a nearer
    parent's before a farther one's; any long is a fetch time; other columns are not read; empty
    tables are fine.
    """
    rows = captures.select(captures["page_id"], captures["url"], captures["fetched_at"]).withColumn("host", host_of(F.col("url")))
    listed = intervals(entries)
    asked = rows.where("host is not null and fetched_at is not null").select("host", "fetched_at").distinct()
    tried = asked.select("host", "fetched_at", bucket_of(F.col("fetched_at")).alias("bucket"), F.posexplode(rules_of(F.col("host"))).alias("level", "rule"))
    months = by_month(listed, tried.select("rule", "bucket").distinct().join(listed.select("rule").distinct(), "rule", "left_semi"))
    active = tried.join(months, ["rule", "bucket"]).where("fetched_at >= since and (until is null or fetched_at < until)")
    found = active.groupBy("host", "fetched_at").agg(F.min(F.struct("level", "rule", "since")).alias("x"))
    by = F.when(F.col("x.level") == 0, "host").when(F.col("x.level") > 0, "parent")
    found = found.select("host", "fetched_at", by.alias("blocked_by"), "x.rule", "x.since")
    return rows.join(found, ["host", "fetched_at"], "left").select("page_id", "url", "fetched_at", "host", F.col("blocked_by").isNotNull().alias("blocked"), "blocked_by", "rule", "since")


# The query's captures and list come from the pages table: fetch times and list dates follow from
# page ids, and rules from the hosts seen.

START, YEAR = 1_704_067_200, 31_536_000


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.lit(START) + (F.col("page_id") * 7919) % YEAR).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    hosts = pages.select("page_id", host_of(F.col("url")).alias("rule"))
    firsts = hosts.groupBy("rule").agg(F.min("page_id").alias("p")).where("rule is not null and p % 3 <> 2")
    parents = hosts.select("page_id", parent_of(F.col("rule")).alias("rule")).groupBy("rule").agg(F.min("page_id").alias("p"))
    rules = firsts.unionByName(parents.where("rule is not null and p % 7 = 0"))
    added = F.lit(START) + (F.col("p") * 104_729) % (YEAR // 2)
    removed = added + (F.col("p") % 90 + 10) * 86_400
    dated = F.array(
        F.struct(F.lit("add").alias("action"), added.alias("at")),
        F.struct(F.lit("remove").alias("action"), F.when(F.col("p") % 2 == 0, removed).alias("at")),
        F.struct(F.lit("add").alias("action"), F.when(F.col("p") % 4 == 0, removed + 30 * 86_400).alias("at")),
    )
    return rules.select("rule", F.explode(dated).alias("e")).select("rule", "e.action", "e.at").where("at is not null")


ORACLE = rf"""
WITH hosts AS (
  SELECT page_id, url, {START} + (page_id * 7919) % {YEAR} AS fetched_at,
    regexp_replace(regexp_extract(lower(regexp_replace(url, '{STRAY}', '', 'g')), '{HOST}', 1), '\.+$', '') AS name FROM pages),
named AS (
  SELECT page_id, url, fetched_at, CASE WHEN length(name) BETWEEN 1 AND {LONGEST} THEN name END AS host,
    NULLIF(regexp_extract(CASE WHEN length(name) BETWEEN 1 AND {LONGEST} THEN name END, '^[^.]+\.(.+\..+)$', 1), '') AS parent FROM hosts),
rules AS (
  SELECT host AS rule, min(page_id) AS p FROM named WHERE host IS NOT NULL GROUP BY host HAVING min(page_id) % 3 <> 2
  UNION ALL
  SELECT parent, min(page_id) FROM named WHERE parent IS NOT NULL GROUP BY parent HAVING min(page_id) % 7 = 0),
dated AS (SELECT rule, p, {START} + (p * 104729) % {YEAR // 2} AS added FROM rules),
entries AS (
  SELECT rule, 'add' AS action, added AS at FROM dated
  UNION ALL SELECT rule, 'remove', added + (p % 90 + 10) * 86400 FROM dated WHERE p % 2 = 0
  UNION ALL SELECT rule, 'add', added + (p % 90 + 40) * 86400 FROM dated WHERE p % 4 = 0),
levels AS (
  SELECT DISTINCT host, fetched_at, unnest(range(1, greatest(2, len(string_split(host, '.'))))) AS level FROM named WHERE host IS NOT NULL),
tried AS (
  SELECT host, fetched_at, level, array_to_string(list_slice(string_split(host, '.'), level, len(string_split(host, '.'))), '.') AS rule FROM levels),
active AS (
  SELECT t.host, t.fetched_at, t.level, t.rule, min(a.at) AS since
  FROM tried t JOIN entries a ON a.rule = t.rule AND a.action = 'add' AND a.at <= t.fetched_at
  WHERE NOT EXISTS (SELECT 1 FROM entries r WHERE r.rule = t.rule AND r.action = 'remove' AND r.at >= a.at AND r.at <= t.fetched_at)
  GROUP BY ALL),
nearest AS (
  SELECT host, fetched_at, min(level) AS level, min_by(rule, level) AS rule, min_by(since, level) AS since FROM active GROUP BY ALL)
SELECT n.page_id, n.url, n.fetched_at, n.host, b.level IS NOT NULL AS blocked,
  CASE WHEN b.level = 1 THEN 'host' WHEN b.level > 1 THEN 'parent' END AS blocked_by, b.rule, b.since
FROM named n LEFT JOIN nearest b ON b.host = n.host AND b.fetched_at = n.fetched_at
"""


def query(pages: DataFrame) -> DataFrame:
    return decide(captures_of(pages), entries_of(pages))
