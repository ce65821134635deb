"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed place in [0, 1) from a hash of its id. Sizes are summed by
source and hash bucket; along the buckets of a source the sums show where its budget
ends. Only the documents of the bucket at that boundary are looked at again, in finer buckets, and the
threshold found so turns the choice of documents into a filter. Thresholds are a row per source: they are
broadcast to where the documents are, which are neither sorted nor moved; with more than
``BROADCAST_SOURCES`` sources documents are joined with them by source and a salt. A source of any size costs
each map task at most one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railpulse.llm.common import n_words
from railpulse.operators.durable import keep

# Weights of the sources in the order of their names, repeated.
WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
CAP = 2
BUCKETS = 1024
#: Sources whose thresholds are broadcast, some ten MB; parts of a source beyond that number.
BROADCAST_SOURCES, SALTS = 100_000, 32


def places(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Bucket and finer bucket of a document, from the first 20 bits of a hash of its id, or without
    an id of its text."""
    name = F.coalesce(doc_id.cast("string"), text.cast("string"), F.lit(""))
    bits = F.conv(F.substring(F.md5(name), 1, 5), 16, 10).cast("int")
    return F.shiftright(bits, 10), bits % BUCKETS


def _targets(sources: DataFrame, weights: Sequence[int], share: Fraction, cap: int) -> DataFrame:
    """Target size per source from (source, source_size), one row each.

    Sources take ``share`` of all sizes in the ratio of their weights, but no more than
    ``cap`` times what they have; what that leaves over is shared again by weight. The
    sources that end at their cap are a prefix of the order by size over weight, so one
    cumulative sum settles the rounds. All comparisons are between whole numbers.
    """
    def whole(c: Column) -> Column:
        return c.cast("decimal(38,0)")

    named = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"),
    )
    earlier = Window.orderBy("ratio", "named").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    up, down = share.numerator, share.denominator
    ranked = (
        sources.withColumn("weight", whole(weight))
        .withColumn("named", F.row_number().over(named))
        .withColumn("ratio", F.col("source_size") / F.col("weight").cast("double"))
        .withColumn("before", whole(F.coalesce(F.sum("source_size").over(earlier), F.lit(0))))
        .withColumn("before_weight", whole(F.coalesce(F.sum("weight").over(earlier), F.lit(0))))
        .withColumn("all_size", whole(F.sum("source_size").over(everything)))
        .withColumn("all_weight", whole(F.sum("weight").over(everything)))
    )
    full = (
        cap * down * whole(F.col("source_size")) * (F.col("all_weight") - F.col("before_weight"))
        <= F.col("weight") * (up * F.col("all_size") - cap * down * F.col("before"))
    )
    filled = ranked.withColumn("full", full)
    full_size = F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(F.lit(0))).over(everything)
    full_weight = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(F.lit(0))).over(everything)
    rest = up * F.col("all_size") - cap * down * whole(full_size)
    shared = whole(F.col("weight") * rest).cast("double") / (
        down * (F.col("all_weight") - whole(full_weight))
    ).cast("double")
    target = F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(shared)
    return filled.select("source", "source_size", target.alias("target"))


def _crossing(histogram: DataFrame, bucket: str) -> DataFrame:
    """The bucket of each source in which the running sum passes ``budget``, and the sum
    before it. ``histogram`` has (source, budget, bucket, size)."""
    along = Window.partitionBy("source").orderBy(bucket)
    running = histogram.withColumn("upto", F.sum("size").over(along))
    reached = F.min_by(F.struct(bucket, (F.col("upto") - F.col("size")).alias("before"), "size"), bucket)
    return (
        running.where(F.col("upto") > F.col("budget"))
        .groupBy("source", "budget")
        .agg(reached.alias("at"))
    )


def _at_source(df: DataFrame, per_source: DataFrame) -> DataFrame:
    """``df``, which has source, bucket and fine, with the columns of its source's row in ``per_source``."""
    found = keep(per_source.withColumnRenamed("source", "edge_source"))
    if found.count() <= BROADCAST_SOURCES:
        return df.join(F.broadcast(found), F.expr("source <=> edge_source")).drop("edge_source")
    spread = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("salt", F.pmod(F.col("bucket") * BUCKETS + F.col("fine"), F.lit(SALTS)))
    return salted.join(spread, F.expr("source <=> edge_source AND salt = part")).drop("edge_source", "part", "salt")


def mix_thresholds(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: Fraction = SHARE,
    cap: int = CAP,
) -> DataFrame:
    """Per source: size, target, copies that all documents get, and the two bucket numbers
    before which documents get one copy more. ``sized`` has (source, bucket, fine, size).

    The sum taken differs from the target by at most half of the sizes in one finer
    bucket, about a millionth of the source, or half of one large document.
    """
    coarse = keep(sized.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    sources = coarse.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = _targets(sources, weights, share, cap)
    base = F.when(
        F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))
    ).otherwise(F.lit(0))
    goals = keep(
        goals.withColumn("copies", base.cast("bigint")).withColumn(
            "budget", F.col("target") - F.col("copies") * F.col("source_size")
        )
    )
    same = "a.source <=> b.source"

    def budgets(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        return df.alias("a").join(goals.alias("b"), F.expr(same)).select("a.*", "b.budget", *extra)

    first = _crossing(budgets(coarse), "bucket").select(
        "source", F.col("at.bucket").alias("edge"), F.col("at.before").alias("before"),
        (F.col("budget") - F.col("at.before")).alias("rest"),
    )
    first = keep(first)
    # Only the rows of the boundary buckets are summed again, in finer buckets.
    fine = (
        _at_source(sized.select("source", "bucket", "fine", "size"), first.select("source", "edge", "rest"))
        .where("bucket = edge").groupBy("source", F.col("rest").alias("budget"), "fine")
        .agg(F.sum("size").alias("size"))
    )
    second = _crossing(fine, "fine")
    # The bucket that crosses is taken if that leaves the smaller error.
    nearer = (F.col("at.before") + F.col("at.size") - F.col("budget")) < (
        F.col("budget") - F.col("at.before")
    )
    second = second.select(
        F.col("source").alias("fine_source"),
        (F.col("at.fine") + nearer.cast("int")).alias("fine_edge"),
    )
    return (
        goals.alias("a")
        .join(first.alias("b"), F.expr(same), "left")
        .join(second, F.expr("a.source <=> fine_source"), "left")
        .select(
            "a.source", "a.source_size", "a.target", "a.copies",
            F.coalesce("b.edge", F.lit(0)).alias("edge"),
            F.coalesce("fine_edge", F.lit(0)).alias("fine_edge"),
        )
    )


def _sized(docs: DataFrame) -> DataFrame:
    bucket, fine = places(F.col("doc_id"), F.col("text"))
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        bucket.alias("bucket"), fine.alias("fine"), n_words(F.col("text")).alias("size"),
    )


def _copies() -> Column:
    inside = (F.col("bucket") < F.col("edge")) | (
        (F.col("bucket") == F.col("edge")) & (F.col("fine") < F.col("fine_edge"))
    )
    return F.col("copies") + inside.cast("bigint")


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    Size is the number of words. NULL texts have size 0; a NULL source is a source of
    its own and comes last; rows with one id, or without one and of one text, are taken or left together;
    texts are whole, however long; an empty table gives no rows; other columns are ignored. ``options`` are those of
    ``mix_thresholds``.
    """
    sized = keep(_sized(docs))
    return _at_source(sized, mix_thresholds(sized, **options)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0 to ``cap`` times), columns unchanged.

    Sizes, sources and odd rows as in ``mix_plan``; rows without words are taken like others. Only sizes and
    places are stored between the passes: texts are read again and stay where they are.
    """
    edges = mix_thresholds(keep(_sized(docs).drop("doc_id")), **options)
    bucket, fine = places(F.col("doc_id"), F.col("text"))
    marked = docs.select(
        F.struct("*").alias("row"), F.col("source").cast("string").alias("source"),
        bucket.alias("bucket"), fine.alias("fine"),
    )
    times = _at_source(marked, edges).select("row", _copies().alias("n"))
    repeated = times.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    return repeated.select("row.*")


ORACLE_SQL = """
WITH sized AS (
    SELECT doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 5))::BIGINT AS place
    FROM documents
), sources AS (
    SELECT source, sum(size)::HUGEINT AS source_size FROM sized GROUP BY source
), weighted AS (
    SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS w,
        row_number() OVER (ORDER BY source NULLS LAST) AS named
    FROM sources
), ranked AS (
    SELECT *,
        coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w::DOUBLE, named
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS s_before,
        coalesce(sum(w) OVER (ORDER BY source_size::DOUBLE / w::DOUBLE, named
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS w_before,
        (sum(source_size) OVER ())::HUGEINT AS s_all, (sum(w) OVER ())::HUGEINT AS w_all
    FROM weighted
), filled AS (
    SELECT *, 4 * source_size * (w_all - w_before) <= w * (3 * s_all - 4 * s_before) AS full_up FROM ranked
), goals AS (
    SELECT source, source_size,
        CASE WHEN full_up THEN (2 * source_size)::DOUBLE
            ELSE (w * (3 * s_all - 4 * (sum(CASE WHEN full_up THEN source_size ELSE 0 END) OVER ())::HUGEINT))::DOUBLE
                / (2 * (w_all - (sum(CASE WHEN full_up THEN w ELSE 0 END) OVER ())::HUGEINT))::DOUBLE
        END AS target
    FROM filled
), based AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS base FROM goals
), spots AS (
    SELECT source, place, sum(size)::BIGINT AS size FROM sized GROUP BY source, place
), running AS (
    SELECT b.source, place, size, target - base * b.source_size::BIGINT AS budget,
        sum(size) OVER (PARTITION BY b.source ORDER BY place) AS upto
    FROM spots JOIN based b ON spots.source IS NOT DISTINCT FROM b.source
), edges AS (
    SELECT source, min_by(CASE WHEN upto - budget < budget - (upto - size) THEN place + 1 ELSE place END, place) AS edge
    FROM running WHERE upto > budget GROUP BY source
)
SELECT doc_id, size, b.source_size::BIGINT AS source_size, target,
    (size * (base + CASE WHEN place < coalesce(edge, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN based b ON sized.source IS NOT DISTINCT FROM b.source
LEFT JOIN edges e ON sized.source IS NOT DISTINCT FROM e.source
"""
