"""Quality rules with adaptive thresholds [native].

Each document gets a few rates: a count over a whole. A quantile sketch of every
rate is kept per language and source: integer bins and their row counts. Bins
have width 1 up to 2**BIN_BITS and then as many in each further doubling as half
of that, so no value lies above the last bin and a sketch stays bounded. Such
sketches merge by adding counts, in any order, so runs agree, hot groups shrink
to one row per bin before the shuffle, and a quantile is off by less than one
bin.

The thresholds are read off the sketches. Only the middle half of a group is
measured, so what lies in its outer quarters doesn't set its own fence: the upper
fence is the upper quartile plus FENCE times the way there from the median (for
a rate that may also be too low, the lower one likewise). Where the middle half
is a single bin, as with rates that are zero in most texts, the fence is the
middle of the widest break in the upper quarter: the next bin, both taken with
the rate's resolution, must be BREAK times as high; without such a break there is
no fence. Fences are computed for the group, its language and all documents and
shrunk towards the wider level as if that level had PRIOR_ROWS rows: small groups
lean on their language, and nothing switches at a size.

A document is rejected if its count lies further beyond its fence times its
whole than DEVIATIONS square roots of that product. The allowance so grows with
the text and vanishes relative to it; no fixed count enters. Documents are joined
with the thresholds of their group and filtered.

Nulls, empties, ties: null text counts as no words (fails the base rules);
null language or source is a group of its own; repeated rows are judged alike;
of breaks of one width the lowest counts; a group without any document that
passes the base rules has no thresholds. Very long texts: the measures of one
text hold its words' hashes four times in its task, about 40 bytes a word, so a
text of 100 MB needs some gigabytes there. Input columns that clash with the
measures' names are replaced in the output of ``score``; ``filter_quality``
returns exactly its input's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceledger.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
BLANK = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: measure -> (count, whole, units of the rate, lower fence too, resolution: so many units count as nothing)
MEASURES = {
    "symbol_rate": ("n_symbols", "word_chars", 1000, False, 2),
    "upper_rate": ("n_upper", "word_chars", 1000, False, 20),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1000, False, 100),
    "word_length": ("word_chars", "n_words", 100, True, 50),
}
#: Rates of at most this many binary digits are bins of their own; of longer ones this many leading digits are kept.
BIN_BITS = 13
#: Fences lie this many times the way from the median to the quartile beyond that quartile.
FENCE = 6
#: A break in the upper quarter is a bin this many times as high as the one before it.
BREAK = 8
#: Counts may lie this many square roots beyond what a fence gives for the document's length.
DEVIATIONS = 4
#: A group's fences are averaged with its language's, and those with all documents', of this many rows.
PRIOR_ROWS = 10


def add_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and the adaptive measures; the text is scanned once and nothing is shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    word_hash = F.transform(F.regexp_extract_all(t, F.lit(WORD), 0), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD))
    out = docs.withColumn("_w", word_hash).withColumn("_l", lines)
    out = (
        out.withColumn("n_words", F.size("_w").cast("bigint"))
        .withColumn("word_chars", (F.length(t) - F.regexp_count(t, F.lit(BLANK))).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint"))
        .withColumn("n_upper", F.regexp_count(t, F.lit("[A-Z]")).cast("bigint"))
        .withColumn("n_lines", F.size("_l").cast("bigint"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"))
    )
    grams = F.when(
        F.size("_w") >= WINDOW,
        F.transform(
            F.slice("_w", F.lit(1), F.size("_w") - (WINDOW - 1)),
            lambda x, i: F.xxhash64(x, *[F.get("_w", i + k) for k in range(1, WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_g", grams)
    # only texts that repeat a window pay for the sort that locates them
    pairs = F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.cast("bigint").alias("i"))))
    out = out.withColumn("_p", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs))
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    at = F.filter("_p", lambda x, i: same(x, F.get("_p", i + 1)) | ((i > 0) & same(x, F.get("_p", F.greatest(i - 1, F.lit(0))))))
    out = out.withColumn("_r", F.sort_array(F.transform(at, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_r", lambda x, i: F.least(F.lit(WINDOW).cast("bigint"), F.coalesce(F.get("_r", i + 1) - x, F.lit(WINDOW).cast("bigint")))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint")))
    rate = lambda part, whole, units: F.when(F.col(whole) > 0, F.floor(F.col(part) * units / F.col(whole))).otherwise(0).cast("bigint")
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    return out.withColumns({m: rate(part, whole, units) for m, (part, whole, units, *_) in MEASURES.items()}).drop("_w", "_l", "_g", "_p", "_r")


def bin_of(measure: str) -> Column:
    """The least value of the bin that holds a measure's value."""
    return F.expr(f"shiftleft(shiftright({measure}, greatest(length(bin({measure})) - {BIN_BITS}, 0)), greatest(length(bin({measure})) - {BIN_BITS}, 0))")


def sketch(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Quantile sketches: (lang, source, measure, bin, n), over documents that pass the base rules."""
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(m).alias("bin")) for m in MEASURES])
    rows = measured.where(~F.col("base_failed")).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(measures).alias("m"))
    return rows.groupBy("lang", "source", "m.measure", "m.bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """Merge sketches over everything but ``keys``."""
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, *keys: str) -> DataFrame:
    """Rows and outlier fences (low, high) of each measure per ``keys``, from the sketches' quartiles or their widest break; null where there is none."""
    group = Window.partitionBy(*keys, "measure")
    ranked = sketches.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "next": F.lead("bin").over(group.orderBy("bin")), "total": F.sum("n").over(group)})
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bin")))
    resolution = F.create_map(*[F.lit(x) for m, (*_, unit) in MEASURES.items() for x in (m, unit)])[F.col("measure")]
    width = (F.col("next") + resolution) / (F.col("bin") + resolution)
    upper = F.when((F.col("upto") * 4 >= F.col("total") * 3) & (width >= BREAK), F.struct(width.alias("width"), (-F.col("bin")).alias("edge"), "next"))
    per = ranked.groupBy(*keys, "measure").agg(F.max("total").alias("total"), quartile(1).alias("q1"), quartile(2).alias("q2"), quartile(3).alias("q3"), F.max(upper).alias("gap"))
    both = F.create_map(*[F.lit(x) for m, (_, _, _, two, _) in MEASURES.items() for x in (m, two)])[F.col("measure")]
    high = F.when(F.col("q3") > F.col("q2"), (F.col("q3") + FENCE * (F.col("q3") - F.col("q2"))).cast("double")).otherwise((F.col("gap.next") - F.col("gap.edge")) / 2.0)
    low = F.when(both & (F.col("q2") > F.col("q1")), F.greatest(F.col("q1") - FENCE * (F.col("q2") - F.col("q1")), F.lit(0)).cast("double"))
    return per.select(*keys, "measure", "total", low.alias("low"), high.alias("high"))


def shrunk(own: Column, rows: Column, wider: Column) -> Column:
    """A fence of ``rows`` rows averaged with the wider level's, which counts PRIOR_ROWS rows; where one is missing, the other."""
    return F.coalesce((own * rows + wider * PRIOR_ROWS) / (rows + PRIOR_ROWS), own, wider)


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row per (lang, source): each measure's fences, shrunk towards the language's and all documents'."""
    own = fences(sketches, "lang", "source")
    by_lang = fences(merge(sketches, "lang"), "lang").select(F.col("lang").alias("l"), F.col("measure").alias("lm"), F.struct("total", "low", "high").alias("wide"))
    overall = fences(merge(sketches)).select(F.col("measure").alias("am"), F.struct("low", "high").alias("every"))
    by_lang = by_lang.join(overall, F.col("lm") == F.col("am"))
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("lm")))
    fence = lambda side: shrunk(F.col(side), F.col("total"), shrunk(F.col(f"wide.{side}"), F.col("wide.total"), F.col(f"every.{side}")))
    rows = joined.select("lang", "source", "measure", fence("low").alias("low"), fence("high").alias("high"))
    column = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}")
    return rows.groupBy("lang", "source").agg(*[column(m, side) for m in MEASURES for side in ("low", "high")])


def within() -> Column:
    """True where no count lies beyond what its group's fences give for the document's length by more than chance; a side without a fence holds."""
    ok = F.lit(True)
    for m, (part, whole, units, *_) in MEASURES.items():
        count = F.col(part).cast("double")
        for side, sign in (("high", 1), ("low", -1)):
            given = F.col(f"{m}_{side}") * F.col(whole) / F.lit(float(units))
            ok = ok & F.coalesce((count - given) * sign <= DEVIATIONS * F.sqrt(given), F.lit(True))
    return ok


def score(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` (columns ``keep``, or all) with counts, rates, fences, ``base_failed`` and ``kept``."""
    keep = docs.columns if keep is None else keep
    counts = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", *MEASURES]
    own = [c for c in keep if c not in counts]
    work = docs.select(F.struct(*own).alias("_row") if own else F.lit(None).alias("_row"), F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.col(source).alias("_source"))
    measured = materialize(add_measures(work, "_text").select("_row", "_lang", "_source", *counts), "measures")
    limits = materialize(thresholds(sketch(measured, "_lang", "_source")), "thresholds")
    joined = measured.join(limits, F.col("_lang").eqNullSafe(F.col("lang")) & F.col("_source").eqNullSafe(F.col("source")), "left")
    sides = [c for c in limits.columns if c not in ("lang", "source", *own)]
    return joined.withColumn("_kept", ~F.col("base_failed") & within()).select(*(["_row.*"] if own else []), *counts, *sides, F.col("_kept").alias("kept"))


def filter_quality(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """The documents that pass the base rules and lie within their group's fences, with the input's columns."""
    work = docs.select(F.struct("*").alias("_all"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    return score(work, keep=["_all"], **options).where("kept").select("_all.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return score(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), numbered AS (SELECT row_number() OVER () AS r, * FROM words),
w1 AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM numbered),
grams AS (
  SELECT r, i, x || chr(1) || lead(x, 1) OVER p || chr(1) || lead(x, 2) OVER p || chr(1) || lead(x, 3) OVER p || chr(1) || lead(x, 4) OVER p AS g
  FROM w1 WINDOW p AS (PARTITION BY r ORDER BY i)
),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams WHERE g IS NOT NULL) AS q WHERE n > 1),
gaps AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS c FROM twice),
rep AS (SELECT r, sum(c) AS n FROM gaps GROUP BY r),
l1 AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM numbered),
l2 AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l1 WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (
  SELECT a.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_upper,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM numbered AS a LEFT JOIN l2 ON a.r = l2.r LEFT JOIN rep ON a.r = rep.r
),
m AS (
  SELECT *, (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AS base_failed,
         CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbol_rate,
         CASE WHEN word_chars > 0 THEN n_upper * 1000 // word_chars ELSE 0 END AS upper_rate,
         CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line_rate,
         CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_length
  FROM base
),
long AS (
  SELECT lang, source, 'symbol_rate' AS measure, 2 AS unit, symbol_rate AS v FROM m WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'upper_rate', 20, upper_rate FROM m WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'dup_line_rate', 100, dup_line_rate FROM m WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'word_length', 50, word_length FROM m WHERE NOT base_failed
),
binned AS (SELECT lang, source, measure, unit, v - v % (CAST(1 AS BIGINT) << CAST(greatest(length(bin(v)) - 13, 0) AS BIGINT)) AS bin FROM long),
-- one row per level (0 all, 1 language, 2 group), measure and bin
level AS (
  SELECT 2 AS lv, lang, source, measure, unit, bin, count(*) AS n FROM binned GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, measure, unit, bin, count(*) FROM binned GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, measure, unit, bin, count(*) FROM binned GROUP BY ALL
),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, measure) AS total,
         lead(bin) OVER (PARTITION BY lv, lang, source, measure ORDER BY bin) AS nxt FROM level
),
breaks AS (SELECT *, CASE WHEN upto * 4 >= total * 3 AND CAST(nxt + unit AS DOUBLE) / (bin + unit) >= 8 THEN CAST(nxt + unit AS DOUBLE) / (bin + unit) END AS width FROM ranked),
quarter AS (
  SELECT lv, lang, source, measure, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN bin END) AS q1, min(CASE WHEN upto * 4 >= total * 2 THEN bin END) AS q2,
         min(CASE WHEN upto * 4 >= total * 3 THEN bin END) AS q3, max(CASE WHEN width IS NOT NULL THEN {'width': width, 'edge': -bin, 'nxt': nxt} END) AS gap
  FROM breaks GROUP BY lv, lang, source, measure
),
fence AS (
  SELECT lv, lang, source, measure, CAST(total AS DOUBLE) AS total,
         CAST(CASE WHEN measure = 'word_length' AND q2 > q1 THEN greatest(q1 - 6 * (q2 - q1), 0) END AS DOUBLE) AS low,
         CASE WHEN q3 > q2 THEN CAST(q3 + 6 * (q3 - q2) AS DOUBLE) ELSE CAST(gap.nxt - gap.edge AS DOUBLE) / 2 END AS high FROM quarter
),
wide AS (
  SELECT l.lang, l.measure, coalesce((l.low * l.total + a.low * 10) / (l.total + 10), l.low, a.low) AS low, coalesce((l.high * l.total + a.high * 10) / (l.total + 10), l.high, a.high) AS high
  FROM fence AS l JOIN fence AS a ON l.measure = a.measure WHERE l.lv = 1 AND a.lv = 0
),
own AS (
  SELECT g.lang, g.source, g.measure, coalesce((g.low * g.total + w.low * 10) / (g.total + 10), g.low, w.low) AS low, coalesce((g.high * g.total + w.high * 10) / (g.total + 10), g.high, w.high) AS high
  FROM fence AS g JOIN wide AS w ON g.measure = w.measure AND g.lang IS NOT DISTINCT FROM w.lang WHERE g.lv = 2
),
limits AS (
  SELECT lang, source, max(CASE WHEN measure = 'symbol_rate' THEN high END) AS sh, max(CASE WHEN measure = 'upper_rate' THEN high END) AS uh, max(CASE WHEN measure = 'dup_line_rate' THEN high END) AS dh,
         max(CASE WHEN measure = 'word_length' THEN high END) AS wh, max(CASE WHEN measure = 'word_length' THEN low END) AS wl FROM own GROUP BY lang, source
),
given AS (
  SELECT m.*, sh * word_chars / 1000 AS gs, uh * word_chars / 1000 AS gu, dh * n_lines / 1000 AS gd, wh * n_words / 100 AS gh, wl * n_words / 100 AS gl
  FROM m LEFT JOIN limits ON m.lang IS NOT DISTINCT FROM limits.lang AND m.source IS NOT DISTINCT FROM limits.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND coalesce(n_symbols - gs <= 4 * sqrt(gs), true) AND coalesce(n_upper - gu <= 4 * sqrt(gu), true) AND coalesce(n_dup_lines - gd <= 4 * sqrt(gd), true)
        AND coalesce(word_chars - gh <= 4 * sqrt(gh), true) AND coalesce(gl - word_chars <= 4 * sqrt(gl), true)) AS kept
FROM given
"""
