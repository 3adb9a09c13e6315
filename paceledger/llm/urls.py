"""URL filters by temporal list join [native].

A feed of dated list entries (entry, date, listed or delisted) becomes validity
intervals: each entry's rows in date order, every row holding until the next.
An as-of join then evaluates every capture against the entries that cover its
host, or one of its parent domains, and were active on the fetch day.

Captures are first reduced to distinct (host, day) pairs, so a host that holds a
third of all captures meets the list once a day, and the verdicts return on
(host, day), which splits such a host by days. The list may be any size.

Nulls, empties, ties: a null or unparsable URL or null day is never blocked and
has null entry; of several feed rows of one entry and date, "delisted" holds;
repeated captures are each returned; feed rows with null entry or date are void.
Feed entries are compared in lower case without final dots. A very long URL is
matched by one pattern where it lies, in linear time. Input columns named
host, blocked, entry or since are replaced by the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceledger.llm.lines import HOST, host_of


def intervals(feed: DataFrame) -> DataFrame:
    """Turn a feed (entry string, day date, listed boolean) into (entry, since, until) of listed spells; until is exclusive, null if open."""
    days = feed.where("entry IS NOT NULL AND day IS NOT NULL").groupBy(F.rtrim(F.lower("entry"), F.lit(".")).alias("entry"), "day").agg(F.bool_and(F.coalesce("listed", F.lit(False))).alias("listed"))
    spell = Window.partitionBy("entry").orderBy("day")
    return days.withColumn("until", F.lead("day").over(spell)).where("listed").select("entry", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, feed: DataFrame, *, url: str = "url", day: str = "day") -> DataFrame:
    """``captures`` with host, blocked, entry (the most specific active one) and since (its listing day)."""
    names = [c for c in captures.columns if c not in ("host", "blocked", "entry", "since")]
    hosted = captures.select(F.struct(*names).alias("_row"), host_of(F.col(url)).alias("host"), F.col(day).alias("day"))
    spells = intervals(feed)
    seen = hosted.where(F.col("host").isNotNull() & F.col("day").isNotNull()).select("host", "day").distinct()
    labels = F.split("host", "\\.")
    # parents with as many labels as some entry has: where no entry is a bare "com", no host is looked up there
    depths = [r[0] for r in spells.select(F.size(F.split("entry", "\\."))).distinct().collect()]
    levels = F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: (F.size(labels) - i + 1).isin(depths))
    parents = F.transform(levels, lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    candidates = seen.select("host", "day", F.explode(parents).alias("entry"))
    active = candidates.join(spells, "entry").where((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    verdicts = active.groupBy("host", "day").agg(F.max(F.struct(F.length("entry").alias("n"), "entry", "since")).alias("hit"))
    joined = hosted.join(verdicts, ["host", "day"], "left")
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], "host", F.col("hit").isNotNull().alias("blocked"), F.col("hit.entry").alias("entry"), F.col("hit.since").alias("since"))


def filter_urls(captures: DataFrame, feed: DataFrame, *, url: str = "url", day: str = "day") -> DataFrame:
    """The captures that no active entry blocks, with their own columns."""
    work = captures.select(F.struct("*").alias("_row"), F.col(url).alias("url"), F.col(day).alias("day"))
    return evaluate(work, feed).where(~F.col("blocked")).select("_row.*")


def derived_feed(pages: DataFrame) -> DataFrame:
    """A dated list made from the captures themselves: one host in three is listed, later delisted, and some are listed again.

    Hosts are listed by their parent domain where it has more than two labels besides.
    """
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host")).where("host IS NOT NULL")
    hosts = hosts.groupBy(F.regexp_replace("host", "^(www|m|blog)\\.", "").alias("entry")).agg(F.min("page_id").alias("k"), F.count("*").alias("n")).where("k % 3 = 0")
    rows = F.array(
        F.struct((F.col("k") % 200).alias("d"), F.lit(True).alias("listed")),
        F.struct((F.col("k") % 200 + 30 + F.col("n") % 60).alias("d"), F.lit(False).alias("listed")),
        F.struct((F.col("k") % 200 + F.when(F.col("k") % 2 == 0, 120).otherwise(400)).alias("d"), F.lit(True).alias("listed")),
    )
    return hosts.select("entry", F.explode(rows).alias("e")).select("entry", F.date_add(F.lit("2024-01-01").cast("date"), F.col("e.d").cast("int")).alias("day"), "e.listed")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture fetched on day page_id % 365 of 2024, against a feed derived from all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")))
    return evaluate(captures, derived_feed(pages)).select("page_id", "host", F.col("day").cast("string").alias("day"), "blocked", "entry", F.col("since").cast("string").alias("since"))


OP6_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, nullif(rtrim(lower(regexp_extract(url, '{HOST}', 1)), '.'), '') AS host,
         CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS DATE) AS day FROM pages
),
e AS (SELECT regexp_replace(host, '^(www|m|blog)\.', '') AS entry, min(page_id) AS k, count(*) AS n FROM p WHERE host IS NOT NULL GROUP BY 1 HAVING min(page_id) % 3 = 0),
f AS (
  SELECT entry, k % 200 AS d, true AS listed FROM e
  UNION ALL SELECT entry, k % 200 + 30 + n % 60, false FROM e
  UNION ALL SELECT entry, k % 200 + CASE WHEN k % 2 = 0 THEN 120 ELSE 400 END, true FROM e
),
g AS (SELECT entry, CAST(DATE '2024-01-01' + CAST(d AS INTEGER) AS DATE) AS day, min(CASE WHEN listed THEN 1 ELSE 0 END) = 1 AS listed FROM f GROUP BY 1, 2),
s AS (SELECT entry, day AS since, lead(day) OVER (PARTITION BY entry ORDER BY day) AS until, listed FROM g),
hit AS (
  SELECT p.r, s.entry, s.since, row_number() OVER (PARTITION BY p.r ORDER BY length(s.entry) DESC, s.entry DESC, s.since DESC) AS k
  FROM p JOIN s ON s.listed AND s.since <= p.day AND (s.until IS NULL OR p.day < s.until) AND (p.host = s.entry OR ends_with(p.host, '.' || s.entry))
)
SELECT p.page_id, p.host, CAST(p.day AS VARCHAR) AS day, hit.entry IS NOT NULL AS blocked, hit.entry, CAST(hit.since AS VARCHAR) AS since FROM p LEFT JOIN hit ON p.r = hit.r AND hit.k = 1
"""
