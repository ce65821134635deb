"""What the text operators share: reading tables, words, and Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what separates words, besides the blank.
WORD_BREAKS = ("\t", "\n", "\x0b", "\x0c", "\r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank_breaks(text: Column) -> Column:
    """``text`` with every word break as a blank; NULL becomes empty."""
    spaced = F.coalesce(text, F.lit(""))
    for mark in WORD_BREAKS:
        spaced = F.replace(spaced, F.lit(mark), F.lit(" "))
    return spaced


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.array_remove(F.split(blank_breaks(text), " "), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of ``column`` in one piece stay near ``limit``
    bytes; a single longer text makes a piece of its own."""
    for batch in batches:
        sizes = batch.column(column)
        start, total = 0, 0
        for i, size in enumerate(pc.binary_length(sizes).to_pylist()):
            total += size or 0
            if total >= limit:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def to_batch(columns: dict[str, Any], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) for f in schema], schema=schema
    )
