"""Best-fit packing of texts into sequences of several permitted lengths.

Texts longer than the largest length are cut there. The pieces are dealt by hash into
shards of bounded size, and each shard is packed by best fit, longest pieces first: a piece
goes into the open bin that it fills best; where none has room, a bin is opened. For every permitted length the bin is
filled on trial with the pieces that are left, the longest that fits first, and the length opens that costs least per
word then held, counted for the length it would shrink to: so the lengths compete for what is left, a piece
opens a short sequence where nothing would fill a long one, and a long one where small pieces will. At the end every bin
shrinks to the smallest permitted length that holds its contents. A shard wastes at most the few bins
that it leaves open, so the loss against one global packing falls with the size of the shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railpulse.llm.common import n_words
from railpulse.operators.durable import keep

LENGTHS = (256, 512, 1024, 2048)
PIECES_PER_SHARD = 20_000


def cost_of(length: int) -> float:
    """Cost of one sequence: linear work, attention that grows with the square, a start-up."""
    return length + length * length / 16_384 + 16


def pack_shard(
    sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = cost_of
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, offset in the bin and final length of the bin for each size.

    ``sizes`` are in falling order, from 1 to the largest length.
    """
    permitted = sorted(lengths)
    costs = {length: cost(length) for length in permitted}
    falling = [-int(size) for size in sizes]
    room: list[tuple[int, int]] = []  # (free words, bin), sorted
    filled: list[int] = []
    bins = np.empty(len(sizes), np.int64)
    offsets = np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, number = room.pop(at)
        else:
            free, number = _opened(falling, i, permitted, costs), len(filled)
            filled.append(0)
        bins[i], offsets[i] = number, filled[number]
        filled[number] += size
        if free > size:
            insort(room, (free - size, number))
    fitted = np.array([permitted[bisect_left(permitted, f)] for f in filled], np.int64)
    return bins, offsets, fitted[bins] if len(filled) else bins


def _opened(falling: Sequence[int], i: int, permitted: Sequence[int], costs: dict[int, float]) -> int:
    """The length to open for piece ``i``; ``falling`` has the negative sizes of all pieces."""
    size, found = -falling[i], []
    for length in permitted[bisect_left(permitted, size):]:
        free, at = length - size, i + 1
        while free and (at := bisect_left(falling, -free, at)) < len(falling):
            free += falling[at]
            at += 1
        held = length - free
        # Of equal costs the longer one, which leaves more choice.
        found.append((costs[permitted[bisect_left(permitted, held)]] / held, -length))
    return -min(found)[1]


def pieces_of(docs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, piece, start, length) in words; a text without words has one empty piece."""
    sized = docs.select("doc_id", n_words(F.col("text")).alias("words"))
    last = F.greatest(F.ceil(F.col("words") / longest) - 1, F.lit(0))
    cut = sized.select("doc_id", "words", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * longest
    return cut.select(
        "doc_id", "piece", start.alias("start"),
        F.least(F.col("words") - start, F.lit(longest)).alias("length"),
    )


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_length, bin_offset), one row per piece.

    ``start`` and ``length`` are words of the text, ``bin_offset`` is where they begin in the
    sequence ``bin_id`` of ``bin_length`` words. Repeated rows are packed one by one. NULL
    texts and those without words keep a row with length 0 and no bin; a NULL doc_id is an id like
    others; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType
    longest = max(lengths)
    pieces = keep(pieces_of(docs, longest))
    filled = pieces.where("length > 0")
    shards = max(1, -(-filled.count() // per_shard))
    # Rows with one id and piece are told apart, so that copies spread over shards as well.
    salt = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards))
    schema = T.StructType([
        T.StructField("doc_id", kind),
        *[
            T.StructField(n, T.LongType())
            for n in ("piece", "start", "length", "bin_id", "bin_length", "bin_offset")
        ],
    ])

    def pack_one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True])
        bins, offsets, fitted = pack_shard(group["length"].tolist(), lengths)
        return group.assign(
            bin_id=(np.int64(key[0]) << 32) + bins, bin_length=fitted, bin_offset=offsets
        )[[f.name for f in schema]]

    packed = filled.withColumn("shard", salt).groupBy("shard").applyInPandas(pack_one, schema)
    empty = pieces.where("length = 0").select(
        "doc_id", "piece", "start", "length",
        *[F.lit(None).cast("bigint").alias(n) for n in ("bin_id", "bin_length", "bin_offset")],
    )
    return packed.unionByName(empty)
