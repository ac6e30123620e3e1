"""URL filters by a temporal join of captures with dated list entries, in DataFrame functions only.

An entry says that a host, a domain or a host's first folder joins or leaves a list on a date. Sorted by
date, the entries of a pattern become validity intervals. A capture is matched as of its fetch date with
every interval of its host, of the domains above it, and of its folder.

The range condition is made an equality on (kind, pattern, month): an interval has a row for each month it
touches within the months of the captures, so a capture meets only the few intervals of its own month, and
long histories do not multiply. Captures of a hot host are salted over ``SALTS`` copies of the intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.llm.staging import staged

SALTS = 8
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
FOLDER = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def _number(text: Column) -> Column:
    """28 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to): from each joining date up to the next entry, open at the end.

    Several entries of one date count as one, a leaving one if any is; so a pattern has at most one row per day.
    """
    days = entries.where("list is not null and pattern is not null and kind is not null and at is not null and action is not null").groupBy(
        "list", "kind", "pattern", "at").agg(F.min(F.col("action") == "add").alias("joins"))
    order = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    return days.withColumn("valid_to", F.lead("at").over(order)).where("joins").select("list", "kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def _month(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def temporal_list_join(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (page_id, url, fetched): host, fetched, n_active, active_lists, latest_entry, blocked.

    ``entries`` has list, kind ('host', 'domain' or 'folder'), pattern, action ('add' or 'remove') and a date
    ``at``; incomplete entries are left out. An interval holds from its first day to the day before the next
    entry. A capture with a null URL or time matches nothing; repeated rows each give a row; other columns
    are ignored.
    """
    # written once: both sides of the join below must see the same numbers, whatever order the input comes in
    rows = staged(captures.select("page_id", "url", "fetched").withColumn("row", F.monotonically_increasing_id())).withColumn("host", host_of(F.col("url")))
    labels = F.split("host", r"\.")
    n = F.size(labels)
    above = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    folder = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), FOLDER, 1)
    key = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))
    keys = F.concat(F.array(key("host", F.col("host"))), F.transform(above, lambda d: key("domain", d)),
                    F.when(folder != "", F.array(key("folder", F.concat("host", F.lit("/"), folder)))).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>")))
    day = F.to_date("fetched")
    asked = rows.where("host <> '' and fetched is not null").select("row", day.alias("day"), _month(day).alias("month"), F.explode(keys).alias("k")).select(
        "row", "day", "month", "k.kind", "k.pattern", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    span = captures.agg(_month(F.min(F.to_date("fetched"))).alias("a"), _month(F.max(F.to_date("fetched"))).alias("z")).first()
    first, last = span["a"] or 0, span["z"] or 0
    months = F.sequence(F.greatest(_month(F.col("valid_from")), F.lit(first)), F.least(F.coalesce(_month(F.col("valid_to")), F.lit(last)), F.lit(last)))
    held = validity_intervals(entries).where((_month(F.col("valid_from")) <= last) & (F.coalesce(_month(F.col("valid_to")), F.lit(last)) >= first))
    held = held.withColumn("month", F.explode(months)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    active = asked.join(held, ["kind", "pattern", "month", "salt"]).where("valid_from <= day and (valid_to is null or day < valid_to)")
    found = active.groupBy("row").agg(F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_set("list"))).alias("lists"), F.max("valid_from").alias("latest"))
    n_active = F.coalesce("n", F.lit(0)).cast("long")
    return rows.join(found, "row", "left").select(
        "page_id", "host", F.date_format("fetched", "yyyy-MM-dd HH:mm:ss").alias("fetched"), n_active.alias("n_active"), F.coalesce("lists", F.lit("")).alias("active_lists"),
        F.date_format("latest", "yyyy-MM-dd").alias("latest_entry"), (n_active > 0).alias("blocked"))


# --- captures and a dated list made from the pages ---------------------------------------------------

#: (list, kind, one pattern in so many is listed)
LISTS = (("phishing", "host", 3), ("spam", "domain", 5), ("adult", "folder", 4))
#: Days from the first entry to the later ones; every second entry is a removal.
FIRST_DAY, YEAR_SECONDS = "2024-01-01", 31_536_000


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time in 2024 drawn from the hash of their URL; null URLs have none."""
    seconds = F.pmod(_number(F.col("url")) * 113, F.lit(YEAR_SECONDS))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + seconds).alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for hosts, domains and folders of the pages: listed, removed, and for some listed again."""
    url = F.lower(F.coalesce("url", F.lit("")))
    host, folder = host_of(F.col("url")), F.regexp_extract(url, FOLDER, 1)
    patterns = {"host": host, "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), "folder": F.when(folder != "", F.concat(host, F.lit("/"), folder)).otherwise("")}
    named = pages.select(F.explode(F.array(*[F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), patterns[kind].alias("pattern"), F.lit(one_in).alias("one_in"))
                                             for name, kind, one_in in LISTS])).alias("e")).select("e.*").where("pattern <> ''").distinct()
    draw = _number(F.concat("list", F.lit(" "), "pattern"))
    chosen = named.withColumn("draw", draw).where(F.pmod("draw", "one_in") == 0)
    start = F.pmod(F.floor(F.col("draw") / 64), F.lit(200)).cast("int")
    length = (F.pmod(F.floor(F.col("draw") / 16384), F.lit(120)) + 1).cast("int")
    at = lambda days: F.date_add(F.lit(FIRST_DAY).cast("date"), days)
    event = lambda action, days: F.struct(F.lit(action).alias("action"), at(days).alias("at"))
    log = F.array(event("add", start), event("remove", start + length), event("add", start + 2 * length))
    return chosen.select("list", "kind", "pattern", F.explode(F.when(F.pmod("draw", F.lit(2)) == 0, log).otherwise(F.slice(log, 1, 2))).alias("e")).select(
        "list", "kind", "pattern", "e.action", "e.at")


_N = "('0x' || substr(md5({}), 1, 7))::BIGINT"
ORACLE = rf"""
WITH c AS (SELECT row_number() OVER () AS rid, page_id, url, regexp_extract(lower(coalesce(url, '')), '{HOST}', 1) AS host,
             regexp_extract(lower(coalesce(url, '')), '{FOLDER}', 1) AS folder,
             TIMESTAMP '2024-01-01' + to_seconds(({_N.format('url')} * 113) % {YEAR_SECONDS}) AS fetched FROM pages),
p AS (SELECT 'phishing' AS list, 'host' AS kind, host AS pattern, 3 AS one_in FROM c
      UNION SELECT 'spam', 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1), 5 FROM c
      UNION SELECT 'adult', 'folder', CASE WHEN folder <> '' THEN host || '/' || folder ELSE '' END, 4 FROM c),
q AS (SELECT *, {_N.format("list || ' ' || pattern")} AS draw FROM p WHERE pattern <> ''),
e AS (SELECT list, kind, pattern, draw, (draw // 64) % 200 AS s, (draw // 16384) % 120 + 1 AS n FROM q WHERE draw % one_in = 0),
t AS (SELECT list, kind, pattern, true AS joins, DATE '2024-01-01' + s::INTEGER AS day FROM e
      UNION ALL SELECT list, kind, pattern, false, DATE '2024-01-01' + (s + n)::INTEGER FROM e
      UNION ALL SELECT list, kind, pattern, true, DATE '2024-01-01' + (s + 2 * n)::INTEGER FROM e WHERE draw % 2 = 0),
v AS (SELECT * FROM (SELECT list, kind, pattern, joins, day AS a, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS z FROM t) WHERE joins),
k AS (SELECT rid, 'host' AS kind, host AS pattern FROM c WHERE host <> ''
      UNION ALL SELECT rid, 'domain', array_to_string(string_split(host, '.')[i:], '.')
        FROM (SELECT rid, host, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i FROM c WHERE host <> '')
      UNION ALL SELECT rid, 'folder', host || '/' || folder FROM c WHERE folder <> '' AND host <> ''),
m AS (SELECT rid, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, max(a) AS latest
      FROM k JOIN v USING (kind, pattern) JOIN c USING (rid) WHERE a <= fetched::DATE AND (z IS NULL OR fetched::DATE < z) GROUP BY rid)
SELECT page_id, host, strftime(fetched, '%Y-%m-%d %H:%M:%S') AS fetched, coalesce(n, 0)::BIGINT AS n_active, coalesce(lists, '') AS active_lists,
  strftime(latest, '%Y-%m-%d') AS latest_entry, n IS NOT NULL AS blocked FROM c LEFT JOIN m USING (rid)
"""
