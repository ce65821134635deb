"""Repair of conversations whose turns were lost, emptied, cut, repeated or given a wrong role.

The cheapest edits that make the role initials read ``(s?(ua)+)?`` are a shortest path through a graph of
(rows done, role state). Its edges are weighted with single integers: high digits carry the cost, and below
them ``width`` octal digits spell the letters of the edits, D < I < K < R, from the left, with zeros behind
the last. A minimum of such integers is the least cost and, among equals, the ASCII-least audit; so the whole
choice is an ordinary integer minimum, from the last row to the first. Two audits of equal cost that consume the same rows are
never one the beginning of the other, so minima of neighbouring pieces combine to minima of both.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation with a third of all rows
lies in many partitions. A conversation inside one partition is settled there. Of others, and of those with
more rows than a piece, each partition gives the minima between all pairs of role states; these are combined
per conversation, and the repaired rows then pass one after another through the task that hashes them.
Rows alike in all columns are one counted row. A task holds one piece of texts; an audit is one cell of the
result, and combining holds up to sixteen characters a row for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.operators.durable import keep

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows whose texts a task holds at a time.
PIECE = 256

# Role states: nothing yet, after s, after u, after a; and what may follow.
START, S, U, A = range(4)
STATES = (START, S, U, A)
FOLLOWS = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
TURN = {START: U, S: U, U: A, A: U}  # the state after the only role that a rerole or an insert can give
ROLES = {U: "user", A: "assistant"}
LEGAL = ("su", "ua", "au")
LETTERS = " DIKR"  # by octal digit

Path = dict[tuple[int, int], tuple[int, str]]


def initial(role: str) -> str:
    return role[:1]


class Row:
    """One row, or several alike: what a path has to know of it."""

    __slots__ = ("initial", "copies", "gone", "extra")

    def __init__(self, role: str, copies: int, fault: str):
        self.initial, self.copies = initial(role), copies
        self.gone = fault in ("blank", "duplicate")
        self.extra = TRUNCATED if fault == "truncated" else 0


def fault_of(text: str, seen: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated, or none."""
    ending = text.rstrip(BLANKS)
    if not ending:
        return "blank"
    if seen:
        return "duplicate"
    return "truncated" if ending[-1] not in ".!?" else ""


def least_weights(rows: list[Row], ends: Iterable[int]) -> tuple[list[int | None], int]:
    """The least weight from every role state before ``rows`` to one of ``ends`` after them, and the width."""
    width = sum(row.copies for row in rows) + 2 * len(rows) + 4
    bits, mask = 3 * width, (1 << 3 * width) - 1

    def led(weight: int | None, digit: int, cost: int, times: int = 1) -> int | None:
        """The weight with an edit, or several alike, before all others."""
        if weight is None:
            return None
        letters = digit * (((1 << 3 * times) - 1) // 7)
        return (((weight >> bits) + cost * times) << bits) + (letters << (bits - 3 * times)) + ((weight & mask) >> 3 * times)

    def least(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    def with_inserts(best: list[int | None]) -> list[int | None]:
        for _ in range(2):  # more inserts between two rows never pay
            best = [least(best[q], led(best[TURN[q]], 2, INSERT)) for q in STATES]
        return best

    best = with_inserts([0 if q in ends else None for q in STATES])
    for row in reversed(rows):
        if row.copies > 1:
            best = [led(best[q], 1, DELETE, row.copies - 1) for q in STATES]
        now = []
        for q in STATES:
            edits = [led(best[q], 1, DELETE)]
            if not row.gone:
                if row.initial in FOLLOWS[q]:
                    edits.append(led(best[FOLLOWS[q][row.initial]], 3, KEEP + row.extra))
                edits.append(led(best[TURN[q]], 4, REROLE + row.extra))
            now.append(least(*edits))
        best = with_inserts(now)
    return best, width


def spelled(weight: int, width: int) -> tuple[int, str]:
    """The cost and the letters of a weight."""
    digits = format(weight & ((1 << 3 * width) - 1), f"0{width}o").rstrip("0")
    return weight >> 3 * width, digits.translate({48 + i: letter for i, letter in enumerate(LETTERS)})


def weighed(cost: int, audit: str, width: int) -> int:
    digits = audit.translate({ord(letter): str(i) for i, letter in enumerate(LETTERS) if i})
    return (cost << 3 * width) + (int(digits or "0", 8) << 3 * (width - len(audit)))


def paths(rows: list[Row]) -> Path:
    """The least (cost, audit) between all pairs of role states."""
    found = {}
    for end in STATES:
        best, width = least_weights(rows, (end,))
        found |= {(q, end): spelled(best[q], width) for q in STATES if best[q] is not None}
    return found


def joined(one: Path, two: Path) -> Path:
    """The least paths through two neighbouring pieces."""
    width = max(len(audit) for _, audit in one.values()) + max(len(audit) for _, audit in two.values())
    found = {}
    for q in STATES:
        for end in STATES:
            through = [
                weighed(one[q, m][0] + two[m, end][0], one[q, m][1] + two[m, end][1], width)
                for m in STATES if (q, m) in one and (m, end) in two
            ]
            if through:
                found[q, end] = spelled(min(through), width)
    return found


def joined_all(pieces: list[Path]) -> Path:
    """Neighbours are joined in pairs, the results again, so that letters are copied few times."""
    while len(pieces) > 1:
        pieces = [joined(*pieces[i:i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def cheapest(path: Path) -> tuple[int, str]:
    """Of the paths from nothing to a complete conversation, or to none at all."""
    ends = [path[START, end] for end in (START, A) if (START, end) in path]
    width = max(len(audit) for _, audit in ends)
    return spelled(min(weighed(cost, audit, width) for cost, audit in ends), width)


class Repair:
    """Applies an audit to rows that arrive in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at, self.state = self.at + 1, TURN[self.state]
            yield "I", ROLES[self.state], ""

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the repaired rows that this one gives."""
        for _ in range(copies):
            yield from self._inserted()
            letter, self.at = self.audit[self.at], self.at + 1
            if letter == "K":
                self.state = FOLLOWS[self.state][initial(role)]
                yield letter, role, text
            elif letter == "R":
                self.state = TURN[self.state]
                yield letter, ROLES[self.state], text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


class Digest:
    """SHA-256 of ``role:text`` lines, joined by newlines."""

    def __init__(self):
        self.sum, self.empty = hashlib.sha256(), True

    def add(self, lines: Iterable[tuple[str, str, str]]) -> None:
        for _, role, text in lines:
            self.sum.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False


class Piece:
    """What one partition knows of a conversation."""

    def __init__(self, conv_id: Any, is_open: bool):
        self.conv_id, self.open = conv_id, is_open
        self.texts: list[tuple[str, str, int]] = []
        self.rows: list[Row] = []
        self.done: list[Path] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.low = self.high = self.head = self.tail = None

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        if len(self.rows) == PIECE:
            self.close()
        fault = fault_of(text, seen)
        row = Row(role, copies, fault)
        if fault:
            self.faults[fault] += 1
        self.faults["blank" if fault == "blank" else "duplicate"] += copies - 1
        if self.tail is not None:
            self.illegal += self.tail + row.initial not in LEGAL
        self.illegal += (copies - 1) * (2 * row.initial not in LEGAL)
        self.head = row.initial if self.head is None else self.head
        self.tail = row.initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.rows.append(row)
        if not self.open:
            self.texts.append((role, text, copies))

    def close(self) -> None:
        """Go on without the texts so far."""
        self.open = True
        self.texts = []
        self.done.append(paths(self.rows))
        self.rows = []

    def result(self, part: int) -> dict[str, Any]:
        found = {
            "conv_id": self.conv_id, "part": part, "open": self.open, **self.faults, "illegal": self.illegal,
            "turns": self.turns, "low": self.low, "high": self.high, "head": self.head, "tail": self.tail,
            "cost": None, "audit": None, "repaired_sha256": None, "paths": None,
        }
        if self.open:
            if self.rows:
                self.close()
            found["paths"] = [
                {"entry": q, "exit": end, "cost": cost, "audit": audit}
                for (q, end), (cost, audit) in joined_all(self.done).items()
            ]
            return found
        best, width = least_weights(self.rows, (START, A))
        found["cost"], found["audit"] = spelled(best[START], width)
        repair, digest = Repair(found["audit"]), Digest()
        for text in self.texts:
            digest.add(repair.row(*text))
        digest.add(repair.rest())
        found["repaired_sha256"] = digest.sum.hexdigest()
        return found


_PATHS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PIECE = [
    ("part", pa.int32(), "int"), ("open", pa.bool_(), "boolean"), ("blank", pa.int64(), "bigint"),
    ("duplicate", pa.int64(), "bigint"), ("truncated", pa.int64(), "bigint"), ("illegal", pa.int64(), "bigint"),
    ("turns", pa.int64(), "bigint"), ("low", pa.int64(), "bigint"), ("high", pa.int64(), "bigint"),
    ("head", pa.string(), "string"), ("tail", pa.string(), "string"), ("cost", pa.int64(), "bigint"),
    ("audit", pa.string(), "string"), ("repaired_sha256", pa.string(), "string"),
    ("paths", _PATHS, "array<struct<entry: int, exit: int, cost: bigint, audit: string>>"),
]


def _as_batch(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    fields = [pa.field("conv_id", id_type), *(pa.field(name, kind) for name, kind, _ in _PIECE)]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, piece, out, id_type = TaskContext.get().partitionId(), None, [], None
    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        for row in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "turn", "role", "text", "copies", "seen"))):
            if piece is None or piece.conv_id != row[0]:
                if piece is not None:
                    out.append(piece.result(part))
                # The first conversation of a partition may have begun in another one.
                piece = Piece(row[0], is_open=piece is None)
            piece.add(*row[1:])
            if len(out) >= 1000:
                yield _as_batch(out, id_type)
                out = []
    if piece is not None:
        if piece.rows:
            piece.close()  # and the last one may go on
        yield _as_batch([*out, piece.result(part)], id_type)


def _combined(pieces: pa.Table) -> pa.Table:
    rows = sorted(pieces.to_pylist(), key=lambda row: row["part"])
    whole = {name: sum(row[name] for row in rows) for name in ("blank", "duplicate", "truncated", "illegal", "turns")}
    for one, two in zip(rows, rows[1:]):
        whole["illegal"] += one["tail"] + two["head"] not in LEGAL
    known = [row for row in rows if row["low"] is not None]
    for one, two in zip(known, known[1:]):
        whole["turns"] -= one["high"] == two["low"]
    cost, audit = cheapest(joined_all([
        {(p["entry"], p["exit"]): (p["cost"], p["audit"]) for p in row["paths"]} for row in rows
    ]))
    result = rows[0] | whole | {
        "low": known[0]["low"] if known else None, "high": known[-1]["high"] if known else None,
        "cost": cost, "audit": audit, "paths": None,
    }
    return pa.Table.from_batches([_as_batch([result], pieces.schema.field("conv_id").type)])


_STREAM = ("conv_id", "turn", "role", "text", "copies", "audit")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of conversations whose audit comes before their rows."""
    current, repair, digest, id_type = None, None, Digest(), None

    def finished() -> pa.RecordBatch:
        digest.add(repair.rest())
        return pa.RecordBatch.from_arrays(
            [pa.array([current], id_type), pa.array([digest.sum.hexdigest()])], names=["conv_id", "repaired_sha256"]
        )

    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        for conv_id, _, role, text, copies, audit in zip(*(batch.column(name).to_pylist() for name in _STREAM)):
            if audit is not None:
                if repair is not None:
                    yield finished()
                current, repair, digest = conv_id, Repair(audit), Digest()
            else:
                digest.add(repair.row(role, text, copies))
    if repair is not None:
        yield finished()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows themselves, a batch for each batch."""
    names, current, repair, place = ["conv_id", "place", "edit", "role", "text"], None, None, 0
    for batch in batches:
        id_type, out = batch.schema.field("conv_id").type, []
        for conv_id, _, role, text, copies, audit in zip(*(batch.column(name).to_pylist() for name in _STREAM)):
            found = []
            if audit is not None:
                # The rows of the conversation before are complete but for inserts at its end.
                found = [(current, line) for line in repair.rest()] if repair is not None else []
                out += [(c, place + i, *line) for i, (c, line) in enumerate(found)]
                current, repair, place = conv_id, Repair(audit), 0
                continue
            for line in repair.row(role, text, copies):
                out.append((conv_id, place, *line))
                place += 1
        yield _line_batch(out, names, id_type)
    if repair is not None:
        yield _line_batch([(current, place + i, *line) for i, line in enumerate(repair.rest())], names, id_type)


def _line_batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (id_type, pa.int64(), pa.string(), pa.string(), pa.string())
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_ORDER = ("conv_id", "turn", "role", "text")


def _ordered(rows: DataFrame) -> DataFrame:
    """Counted rows with ``seen``, dealt by ranges and sorted; computed once."""
    spaced = [F.coalesce(F.col(name), F.lit(" ")).alias(name) for name in ("role", "text")]
    counted = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *spaced).groupBy(*_ORDER).agg(
        F.count(F.lit(1)).alias("copies")
    )
    # Only what occurs at several turns; the join hands a text at very many turns to several tasks.
    repeated = counted.groupBy(*(F.col(c).alias(f"same_{c}") for c in ("conv_id", "role", "text"))).agg(
        F.max(F.col("turn").isNull()).alias("timeless"), F.min("turn").alias("low"), F.count(F.lit(1)).alias("times")
    ).where("times > 1")
    same = F.col("conv_id").eqNullSafe(F.col("same_conv_id"))
    for name in ("role", "text"):
        same &= F.col(name) == F.col(f"same_{name}")
    seen = F.col("turn").isNotNull() & (F.col("timeless") | (F.col("low") < F.col("turn")))
    marked = counted.join(repeated, same, "left").select(*_ORDER, "copies", F.coalesce(seen, F.lit(False)).alias("seen"))
    return keep(marked.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER))


def _streamed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Audits, each before the rows of its conversation; one conversation is read by one task, in order."""
    ids = audits.select(F.col("conv_id").alias("wanted"))
    wanted = rows.join(ids, F.col("conv_id").eqNullSafe(F.col("wanted")), "left_semi").select(
        *_STREAM[:-1], F.lit(None).cast("string").alias("audit")
    )
    blanks = [F.lit(None).cast(rows.schema[name].dataType).alias(name) for name in _STREAM[1:-1]]
    both = wanted.union(audits.select("conv_id", *blanks, "audit"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_ORDER[1:])


def _id_type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    ordered, kind = _ordered(rows), _id_type(rows)
    schema = ", ".join([f"conv_id {kind}", *(f"{name} {sql}" for name, _, sql in _PIECE)])
    pieces = keep(ordered.mapInArrow(_pieces, schema))
    combined = keep(pieces.where("open").groupBy("conv_id").applyInArrow(_combined, schema))
    sums = _streamed(ordered, combined.select("conv_id", "audit")).mapInArrow(
        _applied, f"conv_id {kind}, repaired_sha256 string"
    ).select(F.col("conv_id").alias("hashed"), F.col("repaired_sha256").alias("sum"))
    opened = combined.join(sums, F.col("conv_id").eqNullSafe(F.col("hashed"))).withColumn("repaired_sha256", F.col("sum"))
    return ordered, pieces.where("NOT open").unionByName(opened.drop("hashed", "sum"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    ``rows`` has conv_id, turn, role and text; other columns are ignored, whatever their names. Rows count in the
    order of turn, NULL first, then role, then text. A NULL role or text is one blank; rows without a conv_id are
    one conversation. Texts are whole, however long. A role without a first character fits nowhere. An empty
    table gives no rows.
    """
    _, found = _repaired(rows)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return found.select(
        "conv_id", gaps.cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256",
    )


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows that the audits of ``repair`` leave or insert."""
    ordered, found = _repaired(rows)
    return _streamed(ordered, found.select("conv_id", "audit")).mapInArrow(
        _lines, f"conv_id {_id_type(rows)}, place bigint, edit string, role string, text string"
    )


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults that the checksum of ``conv_id:turn`` decides."""
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = (
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    )
    hit = marked.where("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))),
    )
    return hit.select("conv_id", "turn", "role", "text")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """What the checked query returns: every conv_id of ``rows``, also those without rows after damage."""
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    found = ids.join(repair(damaged(rows)), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )
