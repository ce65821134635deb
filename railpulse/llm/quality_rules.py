"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text is reduced to whole-number features in one pass, inside its row. The features
of the texts that pass the base rules are counted in buckets by language and source: a
quantile sketch whose counts simply add up, so sketches of map tasks, sources and languages
merge in any order to the same numbers. Quartiles read from the sketches give a
range per language and source (of the language, or of all texts, where a group is small), and
a join brings the ranges to the rows. Texts are read once and never shuffled; a source with
a third of all rows costs each map task one row per bucket.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railpulse.llm.common import blank_breaks, words_of
from railpulse.operators.durable import keep

SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50
SMALL_GROUP = 100
# Buckets hold one value up to 2^EXACT_BITS and then keep as many leading bits, an error below 0.2 %.
EXACT_BITS = 10
SPREADS = 3


class Metric(NamedTuple):
    """A whole-number feature; ``slack`` widens its range, for features that hardly vary."""

    value: Column
    slack: int


def metrics() -> dict[str, Metric]:
    def per(part: str, whole: str, scale: int) -> Column:
        return F.floor(F.try_divide(F.col(part) * scale, F.col(whole)))

    return {
        "word_length": Metric(per("word_chars", "n_words", 100), 100),
        "symbol_rate": Metric(per("n_symbols", "n_words", 1000), 100),
        "dup_line_rate": Metric(per("n_dup_lines", "n_lines", 1000), 400),
        "repeat_rate": Metric(per("n_repeat_words", "n_words", 1000), 300),
    }


def _repeats(words: Column, windows: Column) -> Column:
    """Number of words in windows that occur twice or more; ``windows`` has one hash each."""
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.sort_array(placed)

    def pick(sorted_windows: Column) -> Column:
        twice = F.filter(
            sorted_windows,
            lambda w, k: F.coalesce(w["h"] == F.get(sorted_windows, k - 1)["h"], F.lit(False))
            | F.coalesce(w["h"] == F.get(sorted_windows, k + 1)["h"], F.lit(False)),
        )
        at = F.transform(twice, lambda w: w["i"])
        return F.size(
            F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)))
        )

    # The sorted array is named once, so that it is not sorted again per element.
    counted = F.get(F.transform(F.array(ordered), pick), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), counted).otherwise(0)


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) and the features of each row; NULL texts have none of anything.

    Windows of three words are told apart by a 64-bit hash within their text.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(blank_breaks(line)) != "")
    read = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        words_of(text).alias("words"),
        F.length(F.replace(blank_breaks(text), F.lit(" "), F.lit(""))).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        lines.alias("lines"),
    )
    windows = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
    )
    hashed = read.select("*", windows.alias("windows"))
    counted = hashed.select(
        "doc_id", "lang", "source",
        F.size("words").cast("bigint").alias("n_words"),
        F.col("word_chars").cast("bigint").alias("word_chars"),
        F.col("n_symbols").cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeats(F.col("words"), F.col("windows")).cast("bigint").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _bucket(value: Column) -> Column:
    """Lower end of the sketch bucket of a whole number from 0 on."""
    width = F.expr("shiftleft(1L, greatest(length(bin(value)) - {0}, 0))".format(EXACT_BITS))
    return value - value % width


def sketches(features: DataFrame, of: Mapping[str, Metric]) -> DataFrame:
    """Counts by (lang, source, metric, bucket)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), m.value.alias("value")) for n, m in of.items()])
    long = features.where(~F.col("base_failed")).select("lang", "source", F.explode(pairs).alias("p"))
    return (
        long.select("lang", "source", "p.metric", F.coalesce("p.value", F.lit(0)).alias("value"))
        .withColumn("bucket", _bucket(F.col("value")))
        .groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, n, q1, q3): sketches merged to ``keys`` and their quartiles read off."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(*keys, "metric").orderBy("bucket")
    whole = Window.partitionBy(*keys, "metric")
    running = merged.withColumn("upto", F.sum("n").over(along)).withColumn("all", F.sum("n").over(whole))
    return running.groupBy(*keys, "metric").agg(
        F.max("all").alias("n"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket"))).alias("q3"),
    )


def ranges(sketch: DataFrame, of: Mapping[str, Metric]) -> DataFrame:
    """One row per (lang, source) with ``low_<metric>`` and ``high_<metric>``."""
    both = quartiles(sketch, ["lang", "source"]).alias("g")
    by_lang = quartiles(sketch, ["lang"]).alias("l")
    overall = quartiles(sketch, []).alias("a")
    levels = both.join(
        by_lang, F.expr("g.lang <=> l.lang AND g.metric = l.metric")
    ).join(overall, F.expr("g.metric = a.metric"))
    chosen = F.when(F.col("g.n") >= SMALL_GROUP, F.struct("g.q1", "g.q3")).when(
        F.col("l.n") >= SMALL_GROUP, F.struct("l.q1", "l.q3")
    ).otherwise(F.struct("a.q1", "a.q3"))
    picked = levels.select(
        F.col("g.lang").alias("lang"), F.col("g.source").alias("source"),
        F.col("g.metric").alias("metric"), chosen.alias("q"),
    )
    spread = SPREADS * (F.col("q.q3") - F.col("q.q1"))
    columns = []
    for name, metric in of.items():
        mine = F.col("metric") == name
        columns.append(F.max(F.when(mine, F.col("q.q1") - spread - metric.slack)).alias(f"low_{name}"))
        columns.append(F.max(F.when(mine, F.col("q.q3") + spread + metric.slack)).alias(f"high_{name}"))
    return picked.groupBy("lang", "source").agg(*columns)


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    A text is kept if the base rules pass it and each of its features lies in the range
    of its language and source. NULL and empty texts fail the base rules; a NULL
    language or source is a group like others; repeated rows are judged one by one; an
    empty table gives no rows; other columns are ignored.
    """
    of = metrics()
    features = keep(with_features(docs))
    limits = ranges(sketches(features, of), of).alias("r")
    inside = F.lit(True)
    for name, metric in of.items():
        inside &= F.coalesce(metric.value.between(F.col(f"low_{name}"), F.col(f"high_{name}")), F.lit(True))
    return (
        features.alias("f")
        .join(limits.select(
            F.col("lang").alias("r_lang"), F.col("source").alias("r_source"),
            *[f"{end}_{name}" for name in of for end in ("low", "high")],
        ), F.expr("f.lang <=> r_lang AND f.source <=> r_source"), "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", (~F.col("base_failed") & inside).alias("kept"),
        )
    )


def _sql_metric(part: str, whole: str, scale: int) -> str:
    return f"coalesce(({scale} * {part}) // nullif({whole}, 0), 0)"


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
parts AS (
    SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
        [l FOR l IN string_split(text, chr(10)) IF regexp_matches(l, '[^\\x20\\x09-\\x0D]')] AS ls
    FROM texts
), windows AS (
    SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM parts)
), repeated AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT k) AS n_repeat_words
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM repeated) GROUP BY doc_id
), features AS (
    SELECT p.doc_id, lang, source, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM parts p LEFT JOIN covered c ON p.doc_id = c.doc_id
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        {_sql_metric("word_chars", "n_words", 100)} AS word_length,
        {_sql_metric("n_symbols", "n_words", 1000)} AS symbol_rate,
        {_sql_metric("n_dup_lines", "n_lines", 1000)} AS dup_line_rate,
        {_sql_metric("n_repeat_words", "n_words", 1000)} AS repeat_rate
    FROM features
), long AS (
    UNPIVOT (SELECT lang, source, word_length, symbol_rate, dup_line_rate, repeat_rate FROM judged WHERE NOT base_failed)
    ON word_length, symbol_rate, dup_line_rate, repeat_rate INTO NAME metric VALUE v
), buckets AS (
    SELECT lang, source, metric, v - v % (1::BIGINT << greatest(length(bin(v)) - 10, 0)) AS b FROM long
), sized AS (
    SELECT *, count(*) OVER (PARTITION BY lang, source, metric) AS n_group,
        count(*) OVER (PARTITION BY lang, metric) AS n_lang FROM buckets
), groups AS (
    SELECT lang, source, metric, max(n_group) AS n_group, max(n_lang) AS n_lang,
        quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM sized GROUP BY lang, source, metric
), langs AS (
    SELECT lang, metric, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM buckets GROUP BY lang, metric
), overall AS (
    SELECT metric, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM buckets GROUP BY metric
), chosen AS (
    SELECT g.lang, g.source, g.metric,
        CASE WHEN n_group >= 100 THEN g.q1 WHEN n_lang >= 100 THEN l.q1 ELSE a.q1 END AS q1,
        CASE WHEN n_group >= 100 THEN g.q3 WHEN n_lang >= 100 THEN l.q3 ELSE a.q3 END AS q3,
        CASE g.metric WHEN 'dup_line_rate' THEN 400 WHEN 'repeat_rate' THEN 300 ELSE 100 END AS slack
    FROM groups g JOIN langs l ON g.lang IS NOT DISTINCT FROM l.lang AND g.metric = l.metric
    JOIN overall a ON g.metric = a.metric
), outside AS (
    SELECT DISTINCT j.doc_id
    FROM judged j JOIN chosen c ON j.lang IS NOT DISTINCT FROM c.lang AND j.source IS NOT DISTINCT FROM c.source
    WHERE CASE metric WHEN 'word_length' THEN word_length WHEN 'symbol_rate' THEN symbol_rate
        WHEN 'dup_line_rate' THEN dup_line_rate ELSE repeat_rate END
        NOT BETWEEN q1 - 3 * (q3 - q1) - slack AND q3 + 3 * (q3 - q1) + slack
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept
FROM judged
"""
