"""Repeated passages of words, found level by level with windows of doubled length.

1. The first level looks at windows of half the wanted length, at anchors only: of every wanted window
   the half-length window with the least hash. Equal windows choose equal anchors, so nothing is lost,
   and about one place in six takes part. An anchor survives if another document has it.
2. Windows of twice the length are made where the level below survived: around surviving anchors first,
   later where two neighbouring windows survived. Those that another document has survive, and so on, up
   to the wanted length, or with ``longest=None`` until no candidates are left.
3. A word goes if a window that covers it stands in a smaller document, or earlier in its own.

A window is a row (hash, document, place) in one exchange by hash. A task first settles what it can by
itself: of the equal windows in a batch of texts only the one of the smallest document has to meet those
of other tasks, so a passage that a third of all documents share costs each batch one row a window. Texts
are exchanged once and stay where they are from then on; nothing is sent to the driver.

Windows are told apart by 96 bits of hash. Rows of one doc_id do not remove one another's words, nor do
rows without an id, which come after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse.llm.common import slices
from railpulse.llm.wordcodes import U64, Words, mixed, shifted, sliding, windows
from railpulse.operators.durable import keep

SEPARATORS = b" \t\n\x0b\x0c\r"
WINDOW = 20
#: Bytes of text that are worked on at a time; a longer text is worked on by itself.
TEXT_BYTES = 16 << 20
_CHECK = 0x51ED270B

# ``seen`` packs 32 bits of hash, whether the row is open, whether it met another one, and the place.
_ROWS = "key bigint, seen bigint, doc_id {id}, t bigint"
_OPEN, _MET, _PLACE = 1 << 31, 1 << 30, (1 << 30) - 1


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t): a row is known by its id and the hash of both."""
    return docs.select(
        "doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("t")
    )


def _ranks(batch: pa.RecordBatch) -> np.ndarray:
    """The place of each row's id among those of the batch, from 0; rows without an id come last."""
    ids = batch.column("doc_id").dictionary_encode()
    names = ids.dictionary
    order = np.empty(len(names) + 1, np.int64)
    order[np.asarray(pc.sort_indices(names), np.int64)] = np.arange(len(names))
    order[-1] = len(names)
    return order[np.asarray(ids.indices.fill_null(len(names)), np.int64)]


def _settled(batch: pa.RecordBatch, words: Words, at: np.ndarray, key: np.ndarray, check: np.ndarray | None) -> pa.RecordBatch:
    """The rows of the windows that begin at the words ``at``.

    Open rows: no smaller document of the batch has the window; rows that met: another document of the batch
    has it. Rows that are not open get a key of their own, so that a common window's rows spread. Without
    ``check``, on the first level, documents are told apart by ``t`` alone, which at worst finds too much.
    """
    t = batch.column("t").to_numpy(zero_copy_only=False)
    rank = np.unique(t, return_inverse=True)[1] if check is None else _ranks(batch)
    rank, t = rank[words.text[at]], t[words.text[at]]
    check = np.zeros(len(at), np.int64) if check is None else check
    order = np.lexsort((at, t, rank, check, key))
    at, key, check, rank, t = (x[order] for x in (at, key, check, rank, t))
    is_open = met = np.empty(0, bool)
    if len(at):
        group = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
        starts = np.flatnonzero(group)
        size = np.diff(np.append(starts, len(at)))
        is_open = rank == np.repeat(rank[starts], size)
        met = np.repeat(rank[starts] != rank[starts + size - 1], size)
        keep_row = np.append(True, group[1:] | (rank[1:] != rank[:-1]) | (t[1:] != t[:-1]))
        # Rows of one text next to each other: what they have in common is compressed away in the exchange.
        order = np.flatnonzero(keep_row)
        order = order[np.argsort(at[order])]
        at, key, check, t, is_open, met = (x[order] for x in (at, key, check, t, is_open, met))
        key = np.where(is_open, key, mixed(key ^ mixed(t.view(U64) + words.at[at].astype(U64))))
    place = words.at[at]
    if len(place) and place.max() > _PLACE:
        raise ValueError(f"a text of more than {_PLACE} words")
    seen = (check << 32) + is_open * _OPEN + met * _MET + place
    return pa.RecordBatch.from_arrays([
        pa.array(key.view(np.int64)), pa.array(seen.astype(np.int64)),
        batch.column("doc_id").take(pa.array(words.text[at])), pa.array(t),
    ], names=["key", "seen", "doc_id", "t"])


def _lowest(hashes: np.ndarray, words: Words, window: int) -> np.ndarray:
    """The least hash among the half-length windows of every whole window; 0 where there is none."""
    least = sliding(hashes, window - window // 2 + 1, np.minimum)
    return np.where(words.left >= window, least, U64(0))


def _anchors(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            words = Words(batch.column("text"), SEPARATORS)
            half = windows(words.hashes(), window // 2)
            least = _lowest(half, words, window)
            covering = sliding(least[::-1], window - window // 2 + 1, np.maximum)[::-1]
            at = np.flatnonzero((covering == half) & (covering > 0))
            yield _settled(batch, words, at, half[at], None)

    return rows


def _extended(window: int, length: int):
    """Windows of ``length`` words where those of half the length, at ``marks``, survived."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            words = Words(batch.column("text"), SEPARATORS)
            hashes = words.hashes()
            half = windows(hashes, length // 2)
            alive = np.unique(half[_places(batch.column("marks"), words)])
            if length == window:
                at = np.flatnonzero(_among(_lowest(half, words, window), alive) & (words.left >= length))
            else:
                lives = _among(half, alive) & (words.left >= length // 2)
                at = np.flatnonzero(lives & shifted(lives, length // 2) & (words.left >= length))
            whole = windows(hashes, length)[at]
            more = windows(hashes, length, _CHECK)[at] >> U64(33)
            yield _settled(batch, words, at, whole, more.astype(np.int64))

    return rows


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(values), bool)
    near = np.searchsorted(wanted, values)
    return wanted[np.minimum(near, len(wanted) - 1)] == values


def _places(marks: pa.Array, words: Words) -> np.ndarray:
    """Word numbers in the batch from lists of word numbers in each text."""
    marks = marks.combine_chunks() if isinstance(marks, pa.ChunkedArray) else marks
    counts = np.asarray(pc.list_value_length(marks).fill_null(0), np.int64)
    return np.repeat(words.edges[:-1], counts) + np.asarray(pc.list_flatten(marks), np.int64)


def _met(rows: DataFrame, name: str = "doc_id") -> DataFrame:
    """``rows`` with ``later``: a smaller document has the window, and ``shared``: another one has it.

    ``name`` is the column that tells documents apart.
    """
    dealt = rows.repartition("key").select(
        "key", F.shiftright("seen", 32).cast("int").alias("check"), (F.col("seen").bitwiseAND(_OPEN) != 0).alias("open"),
        (F.col("seen").bitwiseAND(_MET) != 0).alias("met"), F.col("seen").bitwiseAND(_PLACE).cast("int").alias("place"),
        *rows.columns[2:],
    )
    order = Window.partitionBy("key", "check", "open").orderBy(F.col(name).isNull(), name)
    found = dealt.withColumns({"first": F.first(F.struct(name)).over(order), "following": F.lead(F.struct(name)).over(order)})
    later = ~F.col("open") | ~F.col(f"first.{name}").eqNullSafe(F.col(name))
    more = F.col("following").isNotNull() & ~F.col(f"following.{name}").eqNullSafe(F.col(name))
    shared = later | F.col("met") | more
    return found.select(*rows.columns[2:], "place", later.alias("later"), shared.alias("shared"))


def _marked(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``texts`` with the places of their ``rows`` as ``marks``."""
    marks = rows.groupBy("t").agg(F.collect_set("place").alias("marks"))
    return texts.join(marks, "t", how).select("doc_id", "t", "text", "marks")


def _schema(docs: DataFrame) -> str:
    return _ROWS.format(id=docs.schema["doc_id"].dataType.simpleString())


def shared_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, t, place, later, shared) of the windows that anchors of several documents lead to.

    ``window`` is even. ``place`` is the window's first word, ``t`` the xxhash64 of its row's id and text. A
    window that stands in a text more than once has one row, at its first place. Windows of one document
    alone may be among the rows, with ``shared`` false.
    """
    if window < 2 or window % 2:
        raise ValueError(f"a window has an even number of words, not {window}")
    texts, schema = _texts(docs), _schema(docs)
    anchors = texts.mapInArrow(_anchors(window), schema).drop("doc_id")
    alive = _met(anchors, "t").where("shared")
    return _met(_marked(texts, alive, "inner").mapInArrow(_extended(window, window), schema))


def repeat_levels(docs: DataFrame, window: int = WINDOW) -> Iterator[tuple[int, DataFrame]]:
    """(length, windows) for ``window`` words, twice that and so on, until no candidates survive.

    Windows are as in ``shared_windows``, shared ones only. Every level is checkpointed.
    """
    texts, schema, length = _texts(docs), _schema(docs), window
    found = keep(shared_windows(docs, window).where("shared"))
    while not found.isEmpty():
        yield length, found
        length *= 2
        longer = _marked(texts, found, "inner").mapInArrow(_extended(window, length), schema)
        found = keep(_met(longer).where("shared"))


def _cut(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            words = Words(batch.column("text"), SEPARATORS)
            hashes = windows(words.hashes(), window)
            begins = np.flatnonzero(words.left >= window)
            order = begins[np.lexsort((begins, words.text[begins], hashes[begins]))]
            again = order[1:][(hashes[order[1:]] == hashes[order[:-1]]) & (words.text[order[1:]] == words.text[order[:-1]])]
            # A window known from elsewhere goes at all its places in the text; the later ones go anyhow.
            known = _places(batch.column("marks"), words)
            steps = np.zeros(len(words) + 1, np.int64)
            for at in (again, known):
                np.add.at(steps, at, 1)
                np.add.at(steps, at + window, -1)
            gone = np.cumsum(steps[:-1]) > 0
            kept, spans, removed = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                here = gone[words.edges[i]:words.edges[i + 1]]
                parts = (text or b"").split()
                turns = np.flatnonzero(np.diff(here.astype(np.int8), prepend=0, append=0)).tolist()
                left, done = [], 0
                for low, high in zip(turns[::2], turns[1::2]):
                    left += parts[done:low]
                    done = high
                kept.append(b" ".join(left + parts[done:] if turns else parts))
                spans.append([{"first_word": low, "n_words": high - low} for low, high in zip(turns[::2], turns[1::2])])
                removed.append(int(here.sum()))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(words.edges)), pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))),
                pa.array(kept, pa.binary()),
            ], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return rows


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept), a row for every row of ``docs``.

    ``spans`` are the removed runs of words, ``kept`` the other words joined by blanks. NULL and blank texts
    have no words; texts shorter than a window keep all. Texts of any length are whole, one at a time in
    memory. Of equal windows the one of the smallest doc_id stays, in one document the earliest; rows of one
    doc_id, and rows without, leave one another alone. An empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    later = shared_windows(docs, window).where("later")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, spans array<struct<first_word: bigint, n_words: bigint>>, kept binary"
    return _marked(_texts(docs), later, "left").mapInArrow(_cut(window), schema)


def digest(cut: DataFrame) -> DataFrame:
    """What the checked query returns of ``cut_repeats``."""
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("bigint").alias("n_spans"))

