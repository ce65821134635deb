"""Token counts by byte-pair merging, without emitting identifiers.

A piece of text starts as one symbol per byte. The adjacent pair with the lowest rank,
the leftmost of equals, is merged until no ranked pair is left; pairs wait in a heap and
symbols in a linked list, so a piece of n bytes costs O(n log n). The number of tokens is
the number of bytes minus the number of merges.

Texts are processed whole, one Arrow batch at a time, and a worker remembers the counts
of the short pieces it has seen (a bounded table). Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railpulse.llm.common import slices

TOKEN_LIMIT = 1024
REMEMBERED = 400_000
SHORT_PIECE = 64

# Fixed value: how this kind of vocabulary splits text into pieces.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary file.

    Printable Latin-1 characters stand for themselves, the other bytes for the
    characters from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteMerges:
    """Ranks of the merges of one vocabulary, and the strings that are one token as such."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        expected = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        pre = stored["pre_tokenizer"] or {}
        if (
            model["type"] != "BPE"
            or {k: pre.get(k) for k in expected} != expected
            or stored["normalizer"]
            or model.get("ignore_merges")
        ):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        of = byte_symbols()
        # Symbols as numbers: bytes are 0 to 255, the result of merge r is 256 + r
        # unless an earlier merge or byte has made the same string.
        number = {char: byte for char, byte in of.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = number.setdefault(left + right, 256 + rank)
            self.ranks.setdefault((number[left], number[right]), (rank, made))
        self.specials = [t["content"] for t in stored["added_tokens"] if t["content"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in stored["added_tokens"]):
            raise ValueError(f"{path} has special tokens with rules of their own")

    def count(self, piece: bytes) -> int:
        """Tokens of one piece."""
        n = len(piece)
        if n < 2:
            return n
        ranks = self.ranks
        symbol = list(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = ranks.get((symbol[i], symbol[i + 1]))
            if found is not None:
                heap.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has been merged with something else
            symbol[i], symbol[j] = made, -1
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                found = ranks.get((made, symbol[k]))
                if found is not None:
                    heapq.heappush(heap, (found[0], i, found[1], made, symbol[k]))
            h = before[i]
            if h >= 0:
                found = ranks.get((symbol[h], made))
                if found is not None:
                    heapq.heappush(heap, (found[0], h, found[1], symbol[h], made))
        return n - merges

    def counter(self) -> Callable[[str], int]:
        """A function that counts the tokens of a text, special strings being one each."""
        find = regex.compile(PIECES).findall
        special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        count = self.count

        class Counts(dict):
            def __missing__(self, piece: str) -> int:
                n = count(piece.encode())
                if len(piece) <= SHORT_PIECE:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[piece] = n
                return n

        counts = Counts()
        known = counts.__getitem__

        def tokens(text: str) -> int:
            if special is None or not (found := special.findall(text)):
                return sum(map(known, find(text)))
            return len(found) + sum(sum(map(known, find(part))) for part in special.split(text))

        return tokens


@lru_cache(maxsize=2)
def _counter(path: str) -> Callable[[str], int]:
    return ByteMerges(path).counter()


def token_counts(docs: DataFrame, vocabulary: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file that every executor has. NULL
    and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by one;
    an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _counter(vocabulary)
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(pc.binary_length(texts), pa.int64()),
                    pa.array([tokens(t) for t in texts.to_pylist()], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
