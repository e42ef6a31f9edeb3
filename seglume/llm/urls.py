"""URL filters with dated lists.

A list is a log of entries (key, action, at): from ``at`` on, a host or a domain is blocked ("add") or free again
("remove"). Consecutive entries of a key become validity intervals. Every capture is judged by the entries that were
active when it was fetched: for its host and each parent domain, the interval that holds the fetch time counts, and
the most specific active key names the rule.

The as-of join is by host: a host's keys and intervals are gathered once (their number depends on the list, not on the
captures), and captures are joined with them by an equality on the host, which AQE splits where a host has very many
captures. No capture is sorted or grouped.

Nulls: a null URL or one without a host is never blocked and has a null host; a null fetch time matches no interval;
entries with a null key, action or time are ignored. Of entries of a key at one time the last in the order (action) by
name counts, so "remove" wins over "add". Repeated captures stay. Empty tables give no captures or no blocks. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
FOREVER = "9999-12-31 00:00:00"


def host(url: str | Column) -> Column:
    """The lower-case host without user, port, a leading www and a final dot; null where there is none."""
    found = F.regexp_extract(F.lower(F.col(url) if isinstance(url, str) else url), HOST, 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(found, r"\.$", ""), r"^www\.", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """key, valid_from, valid_to of the times when a key is blocked."""
    log = entries.where("key is not null and action is not null and at is not null")
    log = log.groupBy(F.lower("key").alias("key"), F.col("at").cast("timestamp").alias("at")).agg(F.max("action").alias("action"))
    order = W.partitionBy("key").orderBy("at")
    # an entry that repeats the state begins nothing
    log = log.withColumn("was", F.lag("action").over(order)).where("was is null or was <> action")
    log = log.withColumn("valid_to", F.coalesce(F.lead("at").over(order), F.lit(FOREVER).cast("timestamp")))
    return log.where("action = 'add'").select("key", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """page_id, host, fetched_at, blocked, rule (the key), valid_from; one row a capture."""
    seen = captures.select(F.col(id_col).alias("page_id"), host(url_col).alias("host"), F.col(time_col).cast("timestamp").alias("fetched_at"))
    names = seen.where("host is not null").select("host").distinct()
    parts = F.split("host", r"\.")
    keys = names.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("key"))
    active = keys.join(intervals(entries), "key").groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct(F.length("key").alias("specific"), "valid_from", "valid_to", "key")), asc=False).alias("rules")
    )
    hit = F.get(F.filter("rules", lambda r: (r["valid_from"] <= F.col("fetched_at")) & (F.col("fetched_at") < r["valid_to"])), F.lit(0))
    # captures without a host meet nothing; a key of their own spreads them
    spread = F.concat(F.lit(" "), F.pmod(F.xxhash64("page_id", "fetched_at"), F.lit(4096)).cast("string"))
    out = seen.withColumn("_key", F.coalesce("host", spread)).join(active.withColumnRenamed("host", "_key"), "_key", "left").withColumn("hit", hit)
    return out.select("page_id", "host", "fetched_at", F.col("hit").isNotNull().alias("blocked"), F.col("hit.key").alias("rule"), F.col("hit.valid_from").alias("valid_from"))


# ---- the test tables: fetch times from the page's id, a dated list from its hosts

_DAY0 = "2024-01-01"
#: Domains that the list holds from its first day.
ALWAYS = ("spam-farm.example.org", "cheap-pills.example.com")


def dated_pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr(f"date_add(date '{_DAY0}', cast(page_id % 366 as int))").cast("timestamp").alias("fetched_at"))


def dated_list(pages: DataFrame) -> DataFrame:
    """Every fifth host by its checksum: listed, freed after 60 days, listed again after 120."""
    names = pages.select(host("url").alias("key")).where("key is not null").distinct()
    draw = F.conv(F.substring(F.md5("key"), 1, 7), 16, 10).cast("int")
    drawn = names.select("key", draw.alias("h")).where("h % 5 = 0")
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(d).alias("later")) for a, d in (("add", 0), ("remove", 60), ("add", 120))]))
    drawn = drawn.select("key", "h", moves.alias("m")).select("key", F.col("m.action").alias("action"), F.expr(f"date_add(date '{_DAY0}', h % 200 + m.later)").cast("timestamp").alias("at"))
    always = ", ".join(f"('{k}')" for k in ALWAYS)
    return drawn.unionByName(pages.sparkSession.sql(f"SELECT col1 AS key, 'add' AS action, timestamp '{_DAY0} 00:00:00' AS at FROM VALUES {always}"))


def judge_sql() -> str:
    """The same in DuckDB SQL over the view ``pages``."""
    find = "nullif(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '\\.$', ''), '^www\\.', ''), '')"
    always = ", ".join(f"('{k}')" for k in ALWAYS)
    return f"""WITH seen AS (SELECT page_id, {find} AS host, CAST(DATE '{_DAY0}' + CAST(page_id % 366 AS INT) AS TIMESTAMP) AS fetched_at FROM pages),
drawn AS (SELECT host AS key, CAST('0x' || md5(host)[1:7] AS BIGINT) AS h FROM (SELECT DISTINCT host FROM seen WHERE host IS NOT NULL)),
log AS (SELECT key, action, CAST(DATE '{_DAY0}' + CAST(h % 200 + later AS INT) AS TIMESTAMP) AS noted FROM drawn, (VALUES ('add', 0), ('remove', 60), ('add', 120)) m(action, later) WHERE h % 5 = 0
  UNION ALL SELECT key, 'add', TIMESTAMP '{_DAY0} 00:00:00' FROM (VALUES {always}) a(key)),
once AS (SELECT key, noted, max(action) AS action FROM log GROUP BY ALL),
moved AS (SELECT *, lag(action) OVER (PARTITION BY key ORDER BY noted) AS was FROM once),
spans AS (SELECT key, action, noted AS valid_from, coalesce(lead(noted) OVER (PARTITION BY key ORDER BY noted), TIMESTAMP '{FOREVER}') AS valid_to FROM moved WHERE was IS NULL OR was <> action),
hits AS (SELECT s.page_id, s.host, s.fetched_at, r.key, r.valid_from, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.key) DESC, r.valid_from DESC) AS place
  FROM seen s JOIN spans r ON r.action = 'add' AND (s.host = r.key OR s.host LIKE '%.' || r.key) AND r.valid_from <= s.fetched_at AND s.fetched_at < r.valid_to)
SELECT s.page_id, s.host, s.fetched_at, h.key IS NOT NULL AS blocked, h.key AS rule, h.valid_from FROM seen s LEFT JOIN hits h ON h.page_id = s.page_id AND h.place = 1"""
