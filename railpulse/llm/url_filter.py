"""URL filters: rules on host and path, and logistic regression where no rule fits.

The regression works on hashed character n-grams of host and path. It is trained from a
small labelled table; training and scoring are DataFrame operations of Spark and its
machine-learning package, without Python on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHED_FEATURES = 1 << 12
GRAM = 3
# The most labelled URLs that training reads, chosen by hash.
LABELLED_URLS = 4000
BLOCK, ALLOW = "block", "allow"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the checked query.
RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest fitting rule, NULL without one; of two equally long
    ones the first in text order."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = (
            (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        ) & F.startswith(path, F.lit(rule.path))
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    if found is None:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return found


def grams(host: Column, path: Column, n: int = GRAM) -> Column:
    """Character n-grams of ``^host`` and of ``path$``, told apart by a prefix."""
    def of(text: Column, mark: str) -> Column:
        last = F.greatest(F.length(text) - (n - 1), F.lit(1))
        return F.transform(
            F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substring(text, i, n))
        )

    return F.concat(of(F.concat(F.lit("^"), host), "h"), of(F.concat(path, F.lit("$")), "p"))


def train_url_model(labelled: DataFrame, limit: int = LABELLED_URLS):
    """A model from (host, path, label 0 or 1), of at most ``limit`` rows; None where the
    table lacks one of the two labels, as there is nothing to tell apart then."""
    sample = (
        labelled.dropDuplicates(["host", "path"])
        .orderBy(F.xxhash64("host", "path"), "host", "path").limit(limit)
    )
    ready = sample.select(grams(F.col("host"), F.col("path")).alias("grams"), F.col("label").cast("double"))
    if ready.select("label").distinct().count() < 2:
        return None
    hashing = HashingTF(numFeatures=HASHED_FEATURES, binary=True, inputCol="grams", outputCol="features")
    regression = LogisticRegression(maxIter=30, regParam=0.01, standardization=False)
    return Pipeline(stages=[hashing, regression]).fit(ready.coalesce(1))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    labelled: DataFrame | None = None,
    limit: int = LABELLED_URLS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``.

    ``labelled`` has (url, label), 1 to block; without it the URLs that the rules decide
    teach the model (a bounded sample of them, chosen by hash). ``score`` is the model's
    probability to block; it decides from 0.5 on where no rule fits. Without two kinds of
    labels there is no model: scores are NULL and URLs without a rule are allowed.
    NULL URLs and those without ``://`` have empty host and path and are judged like
    others. Repeated rows are judged one by one, an empty table gives no rows.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = ruled.where("found IS NOT NULL").select(
            "host", "path", (F.col("found.verdict") == BLOCK).cast("int").alias("label")
        )
    else:
        known = labelled.where("label IS NOT NULL").select(
            host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label"
        )
    model = train_url_model(known, limit)
    if model is None:
        scored = ruled.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(ruled.withColumn("grams", grams(F.col("host"), F.col("path"))))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    by_model = F.when(F.col("score") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", by_model).alias("verdict"), "score",
    )
