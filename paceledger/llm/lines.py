"""Line dedup by site-relative frequency [native].

Within each site, a line's frequency is the number of the site's pages that
hold it, divided by the site's page total. Lines above a boilerplate ratio are
dropped from all of the site's pages. A page counts a line once, however often
it holds it, and rows are counted (line, site) by partial aggregation, so a hot
site or line is one row per task before the shuffle. The lines that exceed the
ratio number at most (mean distinct lines per page / ratio) per site, which
bounds the array joined back to the site's pages. With ``copies=False`` pages
of a site that hold the same text count as one page, so a text that was copied
often isn't boilerplate of its site for that alone. With ``keep_first`` one text
of the site, that with the least hash of those that hold a line, keeps it: so what
a family of near copies shares survives as a whole in one of them, and true
boilerplate in one text of its site.

Nulls, empties, ties: null text counts as empty and stays null; null sites are
one site; blank lines are neither counted nor dropped; repeated rows are pages
of their own; a line found on fewer than ``min_pages`` pages always stays, and
by default these are lines of one page only. Input columns named _n_lines or
_n_dropped are replaced. Lines are compared by a 64-bit hash within their site. A
very long text is split into its lines in one task, which then holds it about
three times. Lines of the site that exceed the ratio are looked up one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceledger.session import materialize

RATIO = 0.1
#: A line that only one page holds is no boilerplate, however few pages its site has.
MIN_PAGES = 2
#: Scheme, user (up to the last @ of the authority), host and port; a backslash ends the authority as a slash does.
HOST = r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#\\]*@)?(\[[^\]/?#\\@]*\]|[^/?#\\@:\[\]]*)(?::[0-9]*)?(?:[/?#\\]|$)"
FILLED = "[^\\x20\\x09-\\x0D]"
BLOCK_TAGS = "p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|nav|header|footer|section|title|head|body|html|main|aside|blockquote|pre"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without user, port and final dots; an IPv6 address keeps its brackets. NULL where there is none."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def visible_lines(html: Column) -> Column:
    """The text of a page, one line per block element; scripts, styles, comments and tags go."""
    text = F.regexp_replace(html, "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(F.translate(text, "\r\n", "  "), f"(?i)</?({BLOCK_TAGS})([\\s/][^>]*)?>", "\n")
    return F.regexp_replace(text, "<[^>]*>", "")


def _filled(line: Column) -> Column:
    return line.rlike(FILLED)


def boilerplate(pages: DataFrame, text: str, site: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(site, lines): (hash, keeper) of the lines above the ratio, per site that has any; without ``copies`` equal texts of a site are one page. The keeper is the least hash of a text with the line."""
    held = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n"), _filled), lambda x: F.xxhash64(x)))
    whole = F.xxhash64(F.col(text)).alias("_text")
    lines = pages.select(F.col(site).alias("site"), whole, F.explode(held).alias("line"))
    texts = pages.select(F.col(site).alias("_site"), whole)
    if not copies:
        lines, texts = lines.distinct(), texts.distinct()
    counts = lines.groupBy("site", "line").agg(F.count("*").alias("n"), F.min("_text").alias("keeper")).where(F.col("n") >= min_pages)
    totals = texts.groupBy("_site").agg(F.count("*").alias("pages"))
    over = counts.join(totals, counts["site"].eqNullSafe(totals["_site"])).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return over.groupBy("site").agg(F.collect_list(F.struct("line", "keeper")).alias("lines"))


def drop_boilerplate(pages: DataFrame, *, text: str = "text", site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True, keep_first: bool = False) -> DataFrame:
    """``pages`` with boilerplate lines gone from ``text``; adds ``_n_lines`` and ``_n_dropped`` (lines that aren't blank)."""
    drop = materialize(boilerplate(pages, text, site, ratio, min_pages, copies), "boilerplate").withColumnsRenamed({"site": "_site", "lines": "_drop"})
    lines = F.split(F.col("_text"), "\n")
    lost = F.transform(F.filter("_drop", lambda d: d["keeper"] != F.xxhash64("_text")) if keep_first else F.col("_drop"), lambda d: d["line"])
    kept = F.when(F.size("_lost") > 0, F.filter(lines, lambda x: ~F.array_contains(F.col("_lost"), F.xxhash64(x)) | ~_filled(x))).otherwise(lines)
    filled = lambda a: F.coalesce(F.size(F.filter(a, _filled)), F.lit(0)).cast("bigint")
    names = [c for c in pages.columns if c not in ("_n_lines", "_n_dropped")]
    work = pages.select(F.struct(*names).alias("_row"), F.col(text).alias("_text"), F.col(site).alias("_host"))
    out = work.join(drop, F.col("_host").eqNullSafe(F.col("_site")), "left").withColumn("_lost", lost)
    out = out.select("_row", kept.alias("_kept"), filled(lines).alias("_n_lines"))
    columns = [F.array_join("_kept", "\n").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in names]
    return out.select(*columns, "_n_lines", (F.col("_n_lines") - filled(F.col("_kept"))).alias("_n_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = materialize(pages.select("page_id", host_of(F.col("url")).alias("host"), visible_lines(F.col("html")).alias("text")), "visible")
    out = drop_boilerplate(pages, site="host")
    return out.select("page_id", "host", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"))


OP8_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, nullif(rtrim(lower(regexp_extract(url, '{HOST}', 1)), '.'), '') AS host,
    regexp_replace(regexp_replace(translate(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), chr(13) || chr(10), '  '),
      '(?i)</?({BLOCK_TAGS})([\s/][^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t
  FROM pages
),
l AS (SELECT r, host, i, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS filled
  FROM (SELECT r, host, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM p) AS q),
c AS (SELECT host, line, count(DISTINCT r) AS n FROM l WHERE filled GROUP BY host, line HAVING count(DISTINCT r) >= {MIN_PAGES}),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT c.host, c.line FROM c JOIN h ON c.host IS NOT DISTINCT FROM h.host WHERE c.n > {RATIO} * h.pages),
m AS (SELECT l.*, filled AND b.line IS NOT NULL AS dropped FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host AND l.line = b.line),
k AS (SELECT r, CAST(sum(CASE WHEN filled THEN 1 ELSE 0 END) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY i) AS t FROM m GROUP BY r)
SELECT p.page_id, p.host, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
  CASE WHEN p.t IS NOT NULL THEN sha256(coalesce(k.t, '')) END AS text_sha256
FROM p LEFT JOIN k ON p.r = k.r
"""
