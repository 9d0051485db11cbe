"""URL filters: dated list entries become validity intervals, and every capture meets those active when it was fetched.

An entry says that from ``listed_on`` a key was added to or removed from a list.  Per key, each addition holds until
the next entry of that key.  Intervals are cut at month starts, so the as-of join is an equality join on
(kind, key, month) followed by an exact comparison of dates; the intervals of a key don't overlap, so each key of a
capture meets at most one row per list.  A hot host only makes the capture side of that join uneven, which adaptive
execution splits.  No Python runs on rows.

Defined cases: a null or unparsable URL and a null fetch date match nothing and are kept; entries with a null field are
ignored; repeated entries count once; an addition and a removal on one day leave the key unlisted; repeated captures
are judged alike; empty lists keep everything; columns named like a result are replaced.  Keys are compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatorium.llm.registry import query, table
from curatorium.llm.store import name

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def validity(entries: DataFrame) -> DataFrame:
    """(kind, key, list, valid_from, valid_to): when each key was on a list, end exclusive, null while it still is."""
    keys = ["kind", "key", "list"]
    days = (
        entries.select("kind", F.lower("key").alias("key"), "list", "listed_on", F.col("action"))
        .na.drop()
        .groupBy(*keys, "listed_on")
        .agg(F.max(F.col("action") == "remove").alias("gone"))
    )
    until = F.lead("listed_on").over(Window.partitionBy(*keys).orderBy("listed_on"))
    return days.withColumn("valid_to", until).where(~F.col("gone")).select(*keys, F.col("listed_on").alias("valid_from"), "valid_to")


def url_keys(url: Column, depth: int) -> Column:
    """Array of (kind, key): every suffix of the host from two labels up, and host plus path down to ``depth`` segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    n = F.size(labels)
    domains = F.when(
        n >= 2,
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("key"))),
    )
    steps = F.least(F.size(parts), F.lit(depth))
    prefixes = F.when(
        steps >= 1,
        F.transform(
            F.sequence(F.lit(1), steps),
            lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.lower(F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("key")),
        ),
    )
    none = F.array().cast("array<struct<kind:string,key:string>>")
    return F.when(host != "", F.concat(F.coalesce(domains, none), F.coalesce(prefixes, none))).otherwise(none)


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """``captures`` with n_active (entries active at fetch time), decided_by (kind:key of the deciding one) and kept.

    The most specific active entry decides: the longest key, then "allow" before "block".
    """
    spans = validity(entries)
    depth = entries.where(F.col("kind") == "prefix").agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    horizon = captures.agg(F.max(fetched)).first()[0]
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(horizon)), F.lit(horizon))
    start = F.trunc("valid_from", "MM")
    active = spans.where(F.col("valid_from") <= end).withColumn(
        "month", F.explode(F.sequence(start, F.trunc(end, "MM"), F.expr("interval 1 month")))
    )
    # the verdict depends on the URL and the day alone
    asked = captures.select(F.col(url).alias("__url"), F.col(fetched).alias("__day")).where(F.col("__url").isNotNull() & F.col("__day").isNotNull()).distinct()
    keyed = asked.select("__url", "__day", F.trunc("__day", "MM").alias("month"), F.inline(url_keys(F.col("__url"), depth)))
    met = keyed.join(active, ["kind", "key", "month"]).where(
        (F.col("valid_from") <= F.col("__day")) & (F.col("valid_to").isNull() | (F.col("__day") < F.col("valid_to")))
    )
    rank = F.struct(F.length("key").alias("n"), (F.col("list") == "allow").alias("allow"), F.col("kind").alias("kind"), F.col("key").alias("key"))
    verdict = met.groupBy("__url", "__day").agg(F.count(F.lit(1)).alias("__n"), F.max(rank).alias("__top"))
    joined = captures.join(verdict, (F.col(url) == F.col("__url")) & (F.col(fetched) == F.col("__day")), "left")
    return joined.select(
        *[captures[name(c)] for c in captures.columns if c.lower() not in ("n_active", "decided_by", "kept")],
        F.coalesce("__n", F.lit(0)).cast("bigint").alias("n_active"),
        F.concat_ws(":", "__top.kind", "__top.key").alias("decided_by"),
        F.coalesce("__top.allow", F.lit(True)).alias("kept"),
    )


def _draw(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")


def captures_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a day of the year 2024 drawn from the page id, since the table has none."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), _draw(F.col("page_id").cast("string")) % 366)
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))


def entries_of(captures: DataFrame) -> DataFrame:
    """A dated list drawn from the hosts met: blocks of hosts and of their parent domains, allowed language folders."""
    first = F.lit("2024-01-01").cast("date")
    hosts = captures.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("n", _draw(F.col("host")))
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    n = F.col("n")

    def entry(kind, key, list_, day, action, when):
        return F.when(
            when,
            F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(list_).alias("list"), F.date_add(first, day).alias("listed_on"), F.lit(action).alias("action")),
        )

    host = F.col("host")
    rows = F.array(
        entry("domain", host, "block", n % 300, "add", n % 3 == 0),
        entry("domain", host, "block", n % 300 + n % 90 + 1, "remove", n % 6 == 0),
        entry("domain", host, "block", n % 300 + n % 90 + 41, "add", n % 12 == 0),
        entry("domain", parent, "block", n % 200, "add", (n % 7 == 0) & (parent != "")),
        entry("domain", parent, "block", n % 200 + 60, "remove", (n % 7 == 0) & (parent != "")),
        entry("prefix", F.concat(host, F.lit("/en")), "allow", n % 180, "add", n % 2 == 0),
        entry("prefix", F.concat(host, F.lit("/fr")), "block", n % 250, "add", n % 5 == 0),
    )
    return hosts.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("e")).select("e.*")


ORACLE = r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 4)) AS INT) % 366 AS fetched_on,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages
),
h AS (
  SELECT host, CAST(('0x' || substr(md5(host), 1, 4)) AS INT) AS n, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS parent
  FROM (SELECT DISTINCT host FROM c WHERE host <> '')
),
e AS (
  SELECT 'domain' AS kind, host AS key, 'block' AS list, n % 300 AS d, 'add' AS action FROM h WHERE n % 3 = 0
  UNION SELECT 'domain', host, 'block', n % 300 + n % 90 + 1, 'remove' FROM h WHERE n % 6 = 0
  UNION SELECT 'domain', host, 'block', n % 300 + n % 90 + 41, 'add' FROM h WHERE n % 12 = 0
  UNION SELECT 'domain', parent, 'block', n % 200, 'add' FROM h WHERE n % 7 = 0 AND parent <> ''
  UNION SELECT 'domain', parent, 'block', n % 200 + 60, 'remove' FROM h WHERE n % 7 = 0 AND parent <> ''
  UNION SELECT 'prefix', host || '/en', 'allow', n % 180, 'add' FROM h WHERE n % 2 = 0
  UNION SELECT 'prefix', host || '/fr', 'block', n % 250, 'add' FROM h WHERE n % 5 = 0
),
g AS (SELECT kind, key, list, DATE '2024-01-01' + d AS day, bool_or(action = 'remove') AS gone FROM e GROUP BY ALL),
v AS (SELECT *, lead(day) OVER (PARTITION BY kind, key, list ORDER BY day) AS until FROM g),
m AS (
  SELECT c.page_id, c.url, v.kind, v.key, v.list FROM c JOIN v ON NOT v.gone AND c.fetched_on >= v.day AND (v.until IS NULL OR c.fetched_on < v.until)
    AND CASE WHEN v.kind = 'domain' THEN c.host = v.key OR ends_with(c.host, '.' || v.key) ELSE starts_with(c.host || '/' || lower(array_to_string(c.parts, '/')) || '/', v.key || '/') END
  WHERE c.host <> ''
),
t AS (
  SELECT page_id, url, count(*) AS n, max_by(kind || ':' || key, (length(key), list = 'allow', kind, key)) AS top, max_by(list, (length(key), list = 'allow', kind, key)) AS list
  FROM m GROUP BY page_id, url
)
SELECT c.page_id, c.url, c.fetched_on, coalesce(t.n, 0) AS n_active, coalesce(t.top, '') AS decided_by, coalesce(t.list = 'allow', TRUE) AS kept
FROM c LEFT JOIN t ON t.page_id = c.page_id AND t.url = c.url
"""


@query("op8_url_filters", ORACLE)
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = captures_of(spark, sf_dir)
    return url_filter(captures, entries_of(captures))
