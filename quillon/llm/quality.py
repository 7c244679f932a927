"""Quality rules: thresholds that adapt to each language and source, from mergeable quantile sketches.

A sketch is a histogram of a non-negative integer over fixed log-linear buckets: exact below 32, above that each power
of two is cut into 32 buckets, so a quantile is off by at most 1/32 of its value. Sketches merge by adding counts,
which makes them an ordinary aggregate with map-side combine: a hot source sends one row per bucket and task, and the
sketch of a language is the sum over its sources. All arithmetic is on integers, hence the same in every engine.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .common import in_batches, scoped, written, written_in_batches

#: Rules: the share in thousandths that is judged, the least spread that counts, and whether low values fail too.
RULES = {"word_length": (500, True), "symbols": (50, False), "repeated_lines": (150, False)}
#: A value fails beyond this many spreads (between the lower and the upper quartile) from the quartiles.
SPREADS = 3
#: A language and source with fewer documents uses the sketch of its language, that one's in turn that of all.
LEAST_DOCS = 50
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SHARES = {
    "word_length": "word_chars * 1000 div n_words",
    "symbols": "n_symbols * 1000 div n_words",
    "repeated_lines": "n_dup_lines * 1000 div n_lines",
}
_BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def with_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, then the counts of STATS over each whole text."""
    types = dict(docs.dtypes)
    kept = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("text"))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), STATS])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    arrow = pa.schema([pa.field(f.name, f.type) for f in arrow])
    return in_batches(kept, kernels.by_text(kernels.text_stats, arrow, list(keep)), schema)


def bucket(v: str) -> str:
    """The bucket's smallest value, as SQL over the integer expression v: the five bits below the leading one stay."""
    shift = f"greatest(length(bin({v})) - 6, 0)"
    return f"shiftleft(shiftright({v}, {shift}), {shift})"


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n) over the documents that pass the base rules."""
    pairs = F.expr("stack(3, " + ", ".join(f"'{r}', {e}" for r, e in _SHARES.items()) + ") as (rule, v)")
    shares = stats.where(f"not ({_BASE_FAILED})").select("lang", "source", pairs)
    return shares.groupBy("lang", "source", "rule", F.expr(bucket("v")).alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, and for each rule its lowest and highest good value), one row per language and source."""
    levels = None
    groups = sketch.select("lang", "source").distinct()
    for level, by in enumerate((["lang", "source"], ["lang"], [])):
        merged = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
        so_far = Window.partitionBy(*by, "rule").orderBy("bucket")
        whole = Window.partitionBy(*by, "rule")
        ranked = merged.withColumns({"below": F.sum("n").over(so_far) - F.col("n"), "docs": F.sum("n").over(whole)})
        at = lambda q: F.max(F.when(F.expr(f"below <= (docs - 1) * {q} div 4"), F.col("bucket")))  # noqa: E731, B023
        quartiles = ranked.groupBy(*by, "rule").agg(F.max("docs").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))
        reach = lambda spread: SPREADS * F.greatest(F.col("q3") - F.col("q1"), F.lit(spread))
        of = lambda r, c: F.max(F.when(F.col("rule") == r, c))
        limits = []
        for rule, (spread, low) in RULES.items():
            limits += [of(rule, F.col("q1") - reach(spread) if low else F.lit(-1)).alias(f"{rule}_low"), of(rule, F.col("q3") + reach(spread)).alias(f"{rule}_high")]
        table = quartiles.groupBy(*by).agg(F.max("docs").alias("docs"), F.struct(*limits).alias("limits"))
        on = [F.col(f"g.{c}").eqNullSafe(F.col(f"l{level}.{c}")) for c in by]
        if level == 0:
            levels = groups.alias("g").join(table.alias("l0"), on, "left")
        elif level == 1:
            levels = levels.join(table.alias("l1"), on, "left")
        else:
            levels = levels.join(F.broadcast(table.limit(1)).alias("l2"), F.lit(True), "left")  # one row
    chosen = F.when(F.col("l0.docs") >= LEAST_DOCS, F.col("l0.limits")).when(F.col("l1.docs") >= LEAST_DOCS, F.col("l1.limits")).otherwise(F.col("l2.limits"))
    return levels.select("g.lang", "g.source", chosen.alias("limits")).select("lang", "source", "limits.*")


def _verdict() -> Column:
    good = [F.expr(e).between(F.col(f"{r}_low"), F.col(f"{r}_high")) for r, e in _SHARES.items()]
    inside = good[0] & good[1] & good[2]
    return F.when(F.expr(_BASE_FAILED), False).otherwise(F.coalesce(inside, F.lit(True)))


def judged(stats: DataFrame) -> DataFrame:
    """stats (a written table with lang and source) with base_failed and kept.

    The limits are a written table joined by language and source, null equal to null: small enough, it is broadcast
    by the planner; beyond that it is a shuffle join whose hot sources adaptive execution splits.
    """
    limits = written(thresholds(written(sketches(stats), "sketches")), "limits")
    on = F.col("s.lang").eqNullSafe(F.col("t.lang")) & F.col("s.source").eqNullSafe(F.col("t.source"))
    joined = stats.alias("s").join(limits.alias("t"), on, "left")
    return joined.select("s.*", F.expr(_BASE_FAILED).alias("base_failed"), _verdict().alias("kept"))


@scoped
def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row.

    A null or empty text has no words and fails the base rule; rows with a null language or source form groups of
    their own; a very long text is counted whole; equal rows get equal verdicts; an empty table gives no rows; other columns are not read.
    """
    stats = written_in_batches(with_stats(docs, "doc_id", "lang", "source"), "stats")
    return judged(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@scoped
def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "lang", "source", "text")
    types = dict(held.dtypes)
    from pyspark.sql.pandas.types import to_arrow_schema

    names = ["row", "lang", "source"]
    arrow = to_arrow_schema(held.select(*names, "text").schema)
    out = pa.schema([arrow.field(n) for n in names] + [pa.field(x.split()[0], pa.int64()) for x in STATS.split(", ")])
    ddl = ", ".join([*(f"`{n}` {types[n]}" for n in names), STATS])
    stats = in_batches(held.select(*names, F.col("text").cast("string").alias("text")), kernels.by_text(kernels.text_stats, out, names), ddl)
    return judged(written_in_batches(stats, "stats")).where("kept").select("row.*")


ORACLE_SQL = """
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
starts AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM starts),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again WHERE c > 1) GROUP BY doc_id),
stats AS (
  SELECT words.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats),
shares AS (
  SELECT lang, source, unnest(['word_length', 'symbols', 'repeated_lines']) AS rule,
         unnest([word_chars * 1000 // n_words, n_symbols * 1000 // n_words, n_dup_lines * 1000 // n_lines]) AS v
  FROM base WHERE NOT base_failed),
sketch AS (
  SELECT lang, source, rule, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket, count(*) AS n
  FROM shares GROUP BY ALL),
levels AS (
  SELECT 0 AS lv, lang, source, rule, bucket, n FROM sketch
  UNION ALL SELECT 1, lang, NULL, rule, bucket, sum(n) FROM sketch GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, rule, bucket, sum(n) FROM sketch GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, rule ORDER BY bucket) - n AS below,
         sum(n) OVER (PARTITION BY lv, lang, source, rule) AS docs
  FROM levels),
quartiles AS (
  SELECT lv, lang, source, rule, max(docs) AS docs, max(bucket) FILTER (WHERE below <= (docs - 1) // 4) AS q1,
         max(bucket) FILTER (WHERE below <= (docs - 1) * 3 // 4) AS q3
  FROM ranked GROUP BY ALL),
limits AS (
  SELECT lv, lang, source, max(docs) AS docs,
         max(q1 - 3 * greatest(q3 - q1, 500)) FILTER (WHERE rule = 'word_length') AS wl,
         max(q3 + 3 * greatest(q3 - q1, 500)) FILTER (WHERE rule = 'word_length') AS wh,
         max(q3 + 3 * greatest(q3 - q1, 50)) FILTER (WHERE rule = 'symbols') AS sh,
         max(q3 + 3 * greatest(q3 - q1, 150)) FILTER (WHERE rule = 'repeated_lines') AS rh
  FROM quartiles GROUP BY ALL),
chosen AS (
  SELECT b.*, CASE WHEN l0.docs >= 50 THEN l0.wl WHEN l1.docs >= 50 THEN l1.wl ELSE l2.wl END AS wl,
         CASE WHEN l0.docs >= 50 THEN l0.wh WHEN l1.docs >= 50 THEN l1.wh ELSE l2.wh END AS wh,
         CASE WHEN l0.docs >= 50 THEN l0.sh WHEN l1.docs >= 50 THEN l1.sh ELSE l2.sh END AS sh,
         CASE WHEN l0.docs >= 50 THEN l0.rh WHEN l1.docs >= 50 THEN l1.rh ELSE l2.rh END AS rh
  FROM base b
  LEFT JOIN limits l0 ON l0.lv = 0 AND l0.lang IS NOT DISTINCT FROM b.lang AND l0.source IS NOT DISTINCT FROM b.source
  LEFT JOIN limits l1 ON l1.lv = 1 AND l1.lang IS NOT DISTINCT FROM b.lang
  LEFT JOIN limits l2 ON l2.lv = 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE
         word_chars * 1000 // n_words BETWEEN wl AND wh AND n_symbols * 1000 // n_words <= sh
         AND n_dup_lines * 1000 // n_lines <= rh END AS kept
FROM chosen"""
