"""Exact dedup with composable polynomial fingerprints.

A text is read as bytes in base B modulo two primes. The hash of a chunk is one dot
product, and hashes of neighbouring chunks combine by shifting the left one by the length
of the right one, so a text of any length is hashed chunk by chunk (``combine``). Texts of equal
fingerprint and length are then compared chunk by chunk with the first of them; a text that
differs, which only a collision of fingerprints makes, goes on in a class of its own content.

Per document only a small row of numbers is shuffled; texts are shuffled once, and chunks
only of documents whose fingerprint occurs twice. A group that a third of all
rows belong to is summed map-side; in the comparison its chunks meet the one chunk of
the first document in an equi-join, which AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railpulse.llm.common import slices
from railpulse.operators.durable import keep

CHUNK = 1 << 16
# Primes below 2^31 and bases: products of a residue and a byte stay far below 2^63.
FIELDS = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353))


def normalised(text: Column) -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``; NULL becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for mark in (" ", "\t", "\n", "\x0b", "\x0c", "\r"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


@lru_cache(maxsize=4)
def _powers(prime: int, base: int) -> np.ndarray:
    powers = np.empty(CHUNK, dtype=np.int64)
    power = 1
    for i in range(CHUNK - 1, -1, -1):
        powers[i] = power
        power = power * base % prime
    return powers


def chunk_hash(data: np.ndarray, prime: int, base: int) -> int:
    """Hash of at most CHUNK bytes."""
    return int(np.dot(data.astype(np.int64), _powers(prime, base)[CHUNK - len(data):]) % prime)


def combine(left: int, right: int, right_length: int, prime: int, base: int) -> int:
    """Hash of two neighbouring pieces from their hashes and the length of the right one."""
    return (left * pow(base, right_length, prime) + right) % prime


def fingerprint(data: np.ndarray) -> tuple[int, ...]:
    out = []
    for prime, base in FIELDS:
        whole = 0
        for start in range(0, len(data), CHUNK):
            piece = data[start:start + CHUNK]
            whole = combine(whole, chunk_hash(piece, prime, base), len(piece), prime, base)
        out.append(whole)
    return tuple(out)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_points, body, text_sha256, n_bytes, print_a, print_b) per row."""
    whole = docs.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_points"),
        normalised(F.col("text")).alias("body"),
    )
    schema = T.StructType(
        whole.schema.fields
        + [T.StructField(n, T.LongType()) for n in ("n_bytes", "print_a", "print_b")]
    )

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 8 << 20):
            lengths = pc.binary_length(batch.column("body")).to_pylist()
            found = [
                fingerprint(np.frombuffer(s.as_buffer(), dtype=np.uint8) if n else np.empty(0, np.uint8))
                for s, n in zip(batch.column("body"), lengths)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(lengths, pa.int64()),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                ],
                names=[f.name for f in schema],
            )

    return whole.mapInArrow(prints, schema).withColumn("text_sha256", F.sha2("body", 256))


PRINT = ["n_bytes", "print_a", "print_b"]


def _differing(prints: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows whose text differs from the first text of their fingerprint, chunk by chunk.

    ``shared`` has one row per fingerprint that two or more rows have, with ``first``
    (doc_id and digest of the row to compare with).
    """
    body = F.col("body").cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(CHUNK).cast("bigint"))
    chunks = (
        prints.join(shared, PRINT)
        .select("doc_id", "text_sha256", "first", *PRINT, body.alias("body"), F.explode(starts).alias("start"))
        .select(
            "doc_id", "text_sha256", "first", *PRINT, "start",
            F.substring("body", (F.col("start") + 1).cast("int"), F.lit(CHUNK)).alias("chunk"),
        )
    )
    is_first = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (
        F.col("first.text_sha256") == F.col("text_sha256")
    )
    first = (
        chunks.where(is_first).groupBy(*PRINT, "start").agg(F.first("chunk").alias("first_chunk"))
    )
    others = chunks.where(~is_first)
    return (
        others.join(first, [*PRINT, "start"])
        .where(F.col("chunk") != F.col("first_chunk"))
        .select(*PRINT, F.col("text_sha256").alias("apart")).distinct()
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal when they are the same without white space. Of equal texts the row
    with the most code points in the original text stays, then the smallest doc_id; of
    repeated rows with the same doc_id all count as that row, so all of them are kept.
    NULL texts count as empty, a NULL doc_id as larger than all others; an empty table
    gives no rows, other columns are ignored.
    """
    prints = with_fingerprints(docs)
    small = keep(prints.drop("body"))
    shared = (
        small.groupBy(*PRINT)
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_sha256")).alias("first"))
        .where("n > 1 AND n_bytes > 0").drop("n")
    )
    apart = _differing(prints, shared)
    classed = small.join(
        apart.withColumnRenamed("text_sha256", "apart"),
        [*[small[c] == apart[c] for c in PRINT], F.col("apart") == F.col("text_sha256")], "left",
    ).select(small["*"], F.coalesce("apart", F.lit("")).alias("class"))
    classed = keep(classed)
    best = F.max_by(
        "doc_id", F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("turned"))
    )
    groups = classed.groupBy(*PRINT, "class").agg(
        best.alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return classed.join(groups, [*PRINT, "class"]).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


ORACLE_SQL = """
WITH bodies AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_points,
        sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
    FROM documents
), ranked AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS keep_id,
        count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM bodies
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM ranked
"""
