"""Removal of repeated passages by a distributed merge sort of suffixes.

A passage of WINDOW bytes repeats when the same bytes start in a document with a smaller id.
Suffixes are sorted only where repeats can begin:

1. Documents are dealt by hash into blocks of bounded size. Of every WINDOW bytes the smallest hash
   of GRAM bytes is an anchor, so equal passages have equal anchors, and one byte in fourteen
   or so is one. Blocks exchange the hashes of their anchors, packed by bucket, and learn
   which ones other documents have as well.
2. The suffixes at those anchors, WINDOW bytes long and followed by the bytes before the anchor in
   reverse, are sorted in each block. Equal ones become one entry, so a passage that a third of all rows
   share costs each block one entry. The sorted runs are exchanged front-coded: per entry the
   length of the prefix that it shares with the one before, and the rest.
3. In each bucket a loser tree merges the runs. It carries common prefix lengths along and compares
   bytes only behind them. From the merged order and its prefix lengths the smallest document of every
   passage follows, and with it the spans to remove.
4. Spans return to the blocks, which cut them out.

The blocks are shuffled once (the exchange is used again by each step); everything else that moves
is packed bytes. No step keeps more than a block or a bucket in memory. Blocks and buckets grow in
number with the input; on executors with more memory give them larger sizes, as their product is the
number of packed rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 50
GRAM = 24
BEFORE = WINDOW - GRAM
WIDTH = WINDOW + BEFORE
PAD = 0xFF  # no UTF-8 text has this byte
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
SLICE = 1 << 20
NULL_ID = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The documents of a block in one buffer, WINDOW bytes of padding around each."""

    def __init__(self, docs: pa.Table):
        ids = [NULL_ID if i is None else i for i in docs.column("doc_id").to_pylist()]
        texts = docs.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.starts = WINDOW + np.concatenate([[0], np.cumsum(lengths + WINDOW)[:-1]])
        self.ends = self.starts + lengths
        pad = bytes([PAD]) * WINDOW
        self.buffer = np.frombuffer(pad + b"".join(t + pad for t in self.texts), np.uint8)

    def doc_at(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _window_extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` values in a row."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[:len(out) - step], out[step:])
        done += step
    return out


def anchors(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of a padded buffer, and the hashes of their GRAM bytes."""
    per_window = WINDOW - GRAM + 1
    positions, hashes = [], []
    words = GRAM // 8
    # Slices overlap, so that every window lies in one of them.
    for begin in range(0, max(len(buffer) - WINDOW + 1, 0), SLICE):
        part = buffer[begin:begin + SLICE + WINDOW - 1]
        n = len(part) - GRAM + 1
        eights = np.ascontiguousarray(sliding_window_view(part, 8)).view("<u8").ravel()
        grams = np.full(n, np.uint64(GRAM))
        for w in range(words):
            grams = (grams ^ eights[8 * w:8 * w + n]) * np.uint64(_BASE)
            grams ^= grams >> np.uint64(29)
        grams = _mix(grams)
        padded = np.concatenate([[0], np.cumsum(part == PAD)])
        grams[padded[GRAM:] != padded[:n]] = _NONE
        least = _window_extreme(grams, per_window, np.minimum)
        edge = np.zeros(per_window - 1, np.uint64)
        most = _window_extreme(np.concatenate([edge, least, edge]), per_window, np.maximum)
        here = np.flatnonzero((most == grams) & (grams != _NONE))
        positions.append(here + begin)
        hashes.append(grams[here])
    if not positions:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    place, first = np.unique(np.concatenate(positions), return_index=True)
    # Anchors have small hashes; mixed again they fill the whole range.
    return place, _mix(np.concatenate(hashes)[first] + np.uint64(1))


def _placed(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash, and 40 bits of it that tell the anchors of a bucket apart."""
    return (hashes % np.uint64(buckets)).astype(np.int64), hashes >> np.uint64(24)


def _distinct(block: Block, buckets: int):
    """Anchors with their bucket and the place of their hash among the block's distinct ones."""
    positions, hashes = anchors(block.buffer)
    bucket, short = _placed(hashes, buckets)
    order = np.lexsort((short, bucket))
    b, s = bucket[order], short[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (s[1:] != s[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return positions, bucket, place, b[new], s[new], order, np.flatnonzero(new)


def _ranges(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, after) of the runs of equal values."""
    if len(sorted_values):
        edges = np.flatnonzero(np.diff(sorted_values)) + 1
        firsts = np.concatenate([[0], edges])
        for low, high in zip(firsts, np.append(edges, len(sorted_values))):
            yield int(sorted_values[low]), int(low), int(high)


ANCHORS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("low", pa.binary()),
                     ("high", pa.binary()), ("several", pa.binary())])
FLAGS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("flags", pa.binary())])
RUNS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("run", pa.binary())])
SPANS = pa.schema([("block", pa.int64()), ("spans", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                    ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _table(rows: Sequence[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def anchor_rows(key: int, docs: pa.Table, buckets: int) -> pa.Table:
    block = Block(docs)
    positions, _, _, b, s, order, first = _distinct(block, buckets)
    if not len(order):
        return _table([], ANCHORS)
    owners = block.ids[block.doc_at(positions)][order]
    several = np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first)
    low, high = (s & np.uint64(0xFFFFFFFF)).astype("<u4"), (s >> np.uint64(32)).astype(np.uint8)
    return _table(
        [
            (bucket, key, low[i:j].tobytes(), high[i:j].tobytes(), np.packbits(several[i:j]).tobytes())
            for bucket, i, j in _ranges(b)
        ],
        ANCHORS,
    )


def shared_flags(key: int, rows: pa.Table) -> pa.Table:
    """Which anchors of each block other documents have as well."""
    blocks = rows.column("block").to_pylist()
    keys, several, sizes = [], [], []
    for low, high, more in zip(*(rows.column(c).to_pylist() for c in ("low", "high", "several"))):
        keys.append(np.frombuffer(low, "<u4").astype(np.uint64)
                    | (np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32)))
        sizes.append(len(high))
        several.append(np.unpackbits(np.frombuffer(more, np.uint8), count=len(high)).astype(bool))
    values, multiple = np.concatenate(keys), np.concatenate(several)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(values), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    shared |= multiple
    ends = np.cumsum(sizes)
    return _table(
        [(b, key, np.packbits(shared[e - n:e]).tobytes()) for b, e, n in zip(blocks, ends, sizes)], FLAGS
    )


def _front_coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix lengths of sorted rows with the row before, and the bytes behind them."""
    differs = np.ones((len(keys), WIDTH + 1), bool)
    differs[1:, :WIDTH] = keys[1:] != keys[:-1]
    lengths = differs.argmax(axis=1)
    lengths[0] = 0
    tails = keys[np.arange(WIDTH)[None, :] >= lengths[:, None]]
    return lengths.astype(np.uint8), tails


def _decoded(lengths: np.ndarray, tails: np.ndarray) -> np.ndarray:
    n = len(lengths)
    keys = np.empty((n, WIDTH), np.uint8)
    own = WIDTH - lengths.astype(np.int64)
    begins = np.cumsum(own) - own - lengths
    rows = np.arange(n)
    for column in range(WIDTH):
        source = np.maximum.accumulate(np.where(lengths <= column, rows, 0))
        keys[:, column] = tails[begins[source] + column]
    return keys


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one run: their lengths in bytes, then the arrays, compressed."""
    parts = [a.tobytes() for a in arrays]
    head = np.array([len(p) for p in parts], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpacked(data: bytes, kinds: Sequence[str]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, "<u8", len(kinds))
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw[at:at + int(size)], kind))
        at += int(size)
    return out


RUN_KINDS = ("u1", "u1", "<u4", "<u4", "<u4", "<i8")


def run_rows(key: int, docs: pa.Table, flags: pa.Table, buckets: int) -> pa.Table:
    """The sorted, front-coded suffixes of a block at the anchors that it shares."""
    block = Block(docs)
    positions, bucket, place, b, _, _, _ = _distinct(block, buckets)
    shared = np.zeros(len(b), bool)
    told = dict(zip(flags.column("bucket").to_pylist(), flags.column("flags").to_pylist()))
    for number, low, high in _ranges(b):
        if number in told:
            shared[low:high] = np.unpackbits(np.frombuffer(told[number], np.uint8), count=high - low)
    chosen = shared[place] if len(place) else np.empty(0, bool)
    positions, bucket = positions[chosen], bucket[chosen]
    around = sliding_window_view(block.buffer, WIDTH) if len(positions) else None
    rows = []
    order = np.argsort(bucket, kind="stable")
    for number, low, high in _ranges(bucket[order]):
        at = positions[order[low:high]]
        context = around[at - BEFORE]
        keys = np.empty((len(at), WIDTH), np.uint8)
        keys[:, :WINDOW] = context[:, BEFORE:]
        keys[:, WINDOW:] = context[:, BEFORE - 1::-1] if BEFORE else context[:, :0]
        # What lies behind the end or before the beginning of the document is padding.
        doc = block.doc_at(at)
        behind, ahead = block.ends[doc] - at, at - block.starts[doc]
        keys[:, :WINDOW][np.arange(WINDOW)[None, :] >= behind[:, None]] = PAD
        keys[:, WINDOW:][np.arange(BEFORE)[None, :] >= ahead[:, None]] = PAD
        wide = np.zeros((len(at), -(-WIDTH // 8) * 8), np.uint8)
        wide[:, :WIDTH] = keys
        by = np.lexsort(wide.view(">u8").T[::-1])
        keys, at, doc = keys[by], at[by], doc[by]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        lengths, tails = _front_coded(keys[first])
        counts = np.diff(np.append(first, len(keys)))
        used, index = np.unique(doc, return_inverse=True)
        names = np.stack([used, block.ids[used]]).astype("<i8")
        rows.append((number, key, _packed(
            lengths, tails, counts.astype("<u4"), index.astype("<u4"),
            (at - block.starts[doc]).astype("<u4"), names,
        )))
    return _table(rows, RUNS)


def merge_runs(strings: Sequence[Sequence[bytes]], prefixes: Sequence[Sequence[int]]):
    """Merge sorted runs of strings of one length with a loser tree.

    ``prefixes`` has each string's common prefix length with the one before it in its run.
    Returns the run of each string in merged order and its common prefix length with the
    string before it there. Every candidate carries its common prefix length with the
    last output: the longer one is the smaller string, and only behind equal lengths bytes
    are compared.
    """
    k = 1 << max(len(strings) - 1, 1).bit_length()
    current: list = [run[0] if run else b"" for run in strings] + [b""] * (k - len(strings))
    known = [0 if run else -1 for run in strings] + [-1] * (k - len(strings))
    ends = [len(run) for run in strings]
    at = [0] * len(strings)
    tree = [0] * k

    def loses(w: int, other: int) -> bool:
        """Whether ``w`` loses; the loser's length becomes the one with the winner."""
        a, b = known[w], known[other]
        if a != b:
            return a < b
        if a < 0:
            return False
        x, y = current[w][a:], current[other][a:]
        if x == y:
            known[other] = a + len(x)
            return False
        differ = a + len(x) - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7 >> 3)
        if x < y:
            known[other] = differ
            return False
        known[w] = differ
        return True

    level = list(range(k))
    size = k
    while size > 1:
        size >>= 1
        winners = []
        for i in range(size):
            w, other = level[2 * i], level[2 * i + 1]
            if loses(w, other):
                w, other = other, w
            tree[size + i] = other
            winners.append(w)
        level = winners
    w = level[0]
    runs, common = [], []
    while known[w] >= 0:
        runs.append(w)
        common.append(known[w])
        i = at[w] = at[w] + 1
        if i < ends[w]:
            current[w], known[w] = strings[w][i], prefixes[w][i]
        else:
            known[w] = -1
        node = (w + k) >> 1
        while node:
            other = tree[node]
            a, b = known[w], known[other]
            if a < b or (a == b and a >= 0 and loses(w, other)):
                tree[node], w = w, other
            node >>= 1
    return np.array(runs, np.int64), np.array(common, np.int64)


def repeated_spans(keys: np.ndarray, common: np.ndarray, entry: np.ndarray, docs: np.ndarray):
    """For each occurrence the smallest and largest number of bytes before its anchor at which
    a repeated window starts (-1: none).

    ``keys`` are sorted suffixes with ``common`` prefix lengths; occurrence i is at the suffix
    ``entry[i]`` in document ``docs[i]``.
    """
    n = len(keys)
    behind = (keys[:, :WINDOW] != PAD).sum(axis=1)
    ahead = (keys[:, WINDOW:] != PAD).sum(axis=1)
    order = np.argsort(entry, kind="stable")
    edges = np.searchsorted(entry[order], np.arange(n))
    smallest = np.minimum.reduceat(docs[order], edges)
    nearest = np.full(len(docs), -1, np.int64)
    farthest = np.full(len(docs), -1, np.int64)
    rank = np.zeros(n, np.int64)  # of the bytes before the anchor, the first ``back`` of them
    for back in range(BEFORE + 1):
        if back:
            _, rank = np.unique(rank * 256 + keys[:, WINDOW + back - 1], return_inverse=True)
        segment = np.cumsum(common < WINDOW - back)
        valid = np.flatnonzero((ahead >= back) & (behind >= WINDOW - back))
        if not len(valid):
            continue
        together = segment[valid] * (int(rank.max()) + 1) + rank[valid]
        by = np.argsort(together, kind="stable")
        firsts = np.flatnonzero(np.append(True, np.diff(together[by]) != 0))
        owner = np.empty(len(valid), np.int64)
        owner[by] = np.repeat(
            np.minimum.reduceat(smallest[valid][by], firsts), np.diff(np.append(firsts, len(by)))
        )
        least = np.full(n, NULL_ID, np.int64)
        least[valid] = owner
        hit = least[entry] < docs
        farthest[hit] = back
        nearest[hit & (nearest < 0)] = back
    return nearest, farthest


def span_rows(rows: pa.Table) -> pa.Table:
    """Merge the runs of a bucket and return the spans to remove, packed by block."""
    blocks = rows.column("block").to_pylist()
    strings, prefixes, mats, counts, docs, starts, owners, local = [], [], [], [], [], [], [], []
    for number, data in enumerate(rows.column("run").to_pylist()):
        lengths, tails, count, index, start, names = _unpacked(data, RUN_KINDS)
        mat = _decoded(lengths, tails)
        whole = mat.tobytes()
        strings.append([whole[i:i + WIDTH] for i in range(0, len(whole), WIDTH)])
        prefixes.append(lengths.tolist())
        mats.append(mat)
        counts.append(count.astype(np.int64))
        used, ids = names.reshape(2, -1)
        docs.append(ids[index])
        local.append(used[index])
        starts.append(start.astype(np.int64))
        owners.append(np.full(len(index), number))
    runs, common = merge_runs(strings, prefixes)
    del strings
    # The place of each entry, numbered run after run, in the merged order; equal ones share it.
    sizes = np.array([len(m) for m in mats])
    offsets = np.cumsum(sizes) - sizes
    merged = np.argsort(runs, kind="stable")
    distinct = common < WIDTH
    place = (np.cumsum(distinct) - 1)[merged]
    first = np.flatnonzero(distinct)
    source = np.empty(len(runs), np.int64)
    source[merged] = np.arange(len(runs))
    keys = np.concatenate(mats)[source[first]]
    entry = np.repeat(place, np.concatenate(counts))
    docs_all, starts_all = np.concatenate(docs), np.concatenate(starts)
    nearest, farthest = repeated_spans(keys, common[first], entry, docs_all)
    hit = np.flatnonzero(farthest >= 0)
    local_all, owners_all = np.concatenate(local)[hit], np.concatenate(owners)[hit]
    low, high = starts_all[hit] - farthest[hit], starts_all[hit] - nearest[hit] + WINDOW
    by = np.lexsort((low, local_all, owners_all))
    return _table(
        [
            (blocks[number], _packed(
                local_all[by[i:j]].astype("<u4"), low[by[i:j]].astype("<u4"), high[by[i:j]].astype("<u4")
            ))
            for number, i, j in _ranges(owners_all[by])
        ],
        SPANS,
    )


def _joined(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans, sorted by ``low``, as maximal ones."""
    reach = np.maximum.accumulate(high)
    new = np.append(True, low[1:] > reach[:-1])
    return low[new], reach[np.append(np.flatnonzero(new)[1:], len(low)) - 1]


def cut_rows(docs: pa.Table, spans: pa.Table) -> pa.Table:
    block = Block(docs)
    parts = [_unpacked(s, ("<u4",) * 3) for s in spans.column("spans").to_pylist()]
    rows = []
    if parts:
        local, low, high = (np.concatenate(c).astype(np.int64) for c in zip(*parts))
        by = np.lexsort((low, local))
        local, low, high = local[by], low[by], high[by]
        edges = np.searchsorted(local, np.arange(len(block.ids) + 1))
    for i, (name, text) in enumerate(zip(block.ids, block.texts)):
        removed = n_spans = 0
        digest = hashlib.sha256()
        done = 0
        if parts and edges[i + 1] > edges[i]:
            lows, highs = _joined(low[edges[i]:edges[i + 1]], high[edges[i]:edges[i + 1]])
            n_spans = len(lows)
            for begin, end in zip(lows.tolist(), highs.tolist()):
                digest.update(text[done:begin])
                removed += end - begin
                done = end
        digest.update(text[done:])
        rows.append((None if name == NULL_ID else int(name), len(text), removed, n_spans, digest.hexdigest()))
    return _table(rows, RESULT)


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def without_repeats(
    docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Texts are UTF-8 bytes, NULL is empty. Every byte of a WINDOW-byte string that also starts
    in a document with a smaller id is removed, judged on the whole input. Rows with one
    id never remove from each other; a NULL id is larger than all others; an empty table gives
    no rows; other columns are ignored. ``doc_id`` must be a whole number.
    """
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, -(-total // block_bytes)), max(1, -(-total // bucket_bytes))
    dealt = whole.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    by_block = dealt.groupBy("block")

    def of_block(key, table):
        return anchor_rows(key[0].as_py(), table, buckets)

    def of_bucket(key, table):
        return shared_flags(key[0].as_py(), table)

    def runs(key, left, right):
        return run_rows(key[0].as_py(), left, right, buckets)

    def merged(table):
        return span_rows(table)

    def cut(left, right):
        return cut_rows(left, right)

    flags = by_block.applyInArrow(of_block, _sql(ANCHORS)).groupBy("bucket").applyInArrow(of_bucket, _sql(FLAGS))
    sorted_runs = by_block.cogroup(flags.groupBy("block")).applyInArrow(runs, _sql(RUNS))
    spans = sorted_runs.groupBy("bucket").applyInArrow(merged, _sql(SPANS))
    return by_block.cogroup(spans.groupBy("block")).applyInArrow(cut, _sql(RESULT))
