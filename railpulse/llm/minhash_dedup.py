"""MinHash near-dedup with tensored banding.

Two small collections of minhash bands, A and B, give a table for every pair of a band
of A and a band of B: 8 + 8 bands of two minhashes make 64 tables of four minhashes from
32 minhashes instead of 256. A pair of texts meets in a table unless all bands of A, or
all of B, differ; at a similarity of 0.75 that happens to 3 of 1000 pairs.

1. Texts with the same set of shingles become one class; copies cost a row per map task.
2. In each bucket of a table the classes are compared with one pivot, the class that meets most
   others, never with each other. Exact set sizes confirm links.
3. Where the classes around a pivot are still apart, each class outside of the pivot's component is
   compared with all classes around it, a block of the former with a block of the latter at a time, so that a link
   between two texts that both miss the pivot is found. A task holds two blocks, smaller ones of longer texts;
   only links leave them.
4. Components of the links.

A row is known by a 64-bit hash of its columns, a class by the least of its rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railpulse.llm.common import slices
from railpulse.llm.components import components
from railpulse.operators.durable import keep

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 8, 2
#: Sets in a block, and cells of the table of sets by shingles of the pivot that two blocks fill.
BLOCK, CELLS = 1000, 1 << 24
REMEMBERED = 400_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BASE = np.uint64(0x9E3779B97F4A7C15)
N_HASHES = 2 * BANDS * ROWS


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, N_HASHES + 1, dtype=np.uint64) * _BASE)
_ODD = _mix(_SEEDS) | np.uint64(1)


class Shingles:
    """Sets of shingle hashes; word hashes are remembered, a bounded number of them."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the five-word shingles of a text."""
        if not text:
            return np.empty(0, np.uint64)
        words = _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > REMEMBERED:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(SHINGLE, len(words))
        n = len(words) - width + 1
        out = np.full(n, width, np.uint64)
        for j in range(width):
            out = out * _BASE + hashes[j:j + n]
        return np.unique(_mix(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """N_HASHES minhashes of 32 bits."""
    out = np.empty(N_HASHES, np.uint32)
    for i in range(N_HASHES):
        out[i] = ((shingles ^ _SEEDS[i]) * _ODD[i]).min() >> np.uint64(32)
    return out


def table_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of the BANDS x BANDS tables, one row per signature."""
    values = signatures.astype(np.uint64).reshape(len(signatures), 2, BANDS, ROWS)
    bands = np.full(values.shape[:3], 1, np.uint64)
    for r in range(ROWS):
        bands = _mix(bands * _BASE + values[..., r])
    of_a, of_b = bands[:, 0, :, None], bands[:, 1, None, :]
    number = np.arange(BANDS * BANDS, dtype=np.uint64).reshape(1, BANDS, BANDS)
    return _mix(_mix(of_a + number) * _BASE + of_b).reshape(len(signatures), -1)


def _digests(rows: DataFrame) -> DataFrame:
    """(doc_id, row, n, low, high, sig): size and digest of each set, and its signature."""
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("row", T.LongType()),
        *[T.StructField(n, T.LongType()) for n in ("n", "low", "high")],
        T.StructField("sig", T.BinaryType()),
    ])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in slices(batches, "text", 4 << 20):
            sizes, lows, highs, sigs = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles.of(text)
                sizes.append(len(found))
                lows.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                highs.append(int((_mix(found + _BASE)).sum(dtype=np.uint64).view(np.int64)))
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(lows, pa.int64()),
                 pa.array(highs, pa.int64()), pa.array(sigs, pa.binary())],
                names=[f.name for f in schema],
            )

    return rows.select("doc_id", "row", "text").mapInArrow(digest, schema)


def _keyed(classes: DataFrame) -> DataFrame:
    """(key, node): the buckets of every class."""
    schema = T.StructType([
        T.StructField("node", classes.schema["node"].dataType),
        T.StructField("tables", T.ArrayType(T.LongType())),
    ])

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32)
            found = table_keys(sigs.reshape(batch.num_rows, N_HASHES)).view(np.int64)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * found.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "tables"])

    return classes.select("node", "sig").mapInArrow(keys, schema).select(
        F.explode("tables").alias("key"), "node"
    )


def _star_pairs(buckets: DataFrame) -> DataFrame:
    """(node, pivot): every class with the pivots of its buckets.

    The pivot of a bucket is the class whose buckets have most members in all, which is
    the text that most of a group of variants come from; then the smallest.
    """
    fame = buckets.groupBy("node").agg(F.sum("members").alias("fame"))
    known = buckets.join(fame, "node")
    pivots = known.groupBy("key").agg(F.max(F.struct("fame", F.bitwise_not("node").alias("node"))).alias("best"))
    return (
        buckets.join(pivots, "key")
        .select("node", F.bitwise_not("best.node").alias("pivot"))
        .where("node != pivot").distinct()
    )


def linked(shared: Column, one: Column, other: Column) -> Column:
    return 100 * shared >= PERCENT * (one + other - shared)


def _sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the classes that ``nodes`` names, from one of the rows that are alike."""
    schema = T.StructType([
        T.StructField("node", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType())),
    ])

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in slices(batches, "text", 2 << 20):
            found = [shingles.of(t).view(np.int64) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("row"), lists], names=["node", "shingles"])

    wanted = rows.select("row", "text").join(nodes.select(F.col("node").alias("row")), "row")
    return wanted.groupBy("row").agg(F.first("text").alias("text")).mapInArrow(collect, schema)


def links_within(sets: list[np.ndarray], pivot: np.ndarray, asked: np.ndarray) -> list[tuple[int, int]]:
    """Links of the texts at ``asked`` with all texts of a group around ``pivot``.

    Sizes of common sets come from a matrix product over the pivot's shingles, and from
    the shingles outside of it that two or more of the texts have.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    inside = np.zeros((n, len(pivot)), np.float32)
    outside_of, outside = [], []
    for i, found in enumerate(sets):
        place = np.searchsorted(pivot, found)
        place[place == len(pivot)] = 0
        hit = pivot[place] == found if len(pivot) else np.zeros(len(found), bool)
        inside[i, place[hit]] = 1
        outside.append(found[~hit])
        outside_of.append(np.full((~hit).sum(), i))
    values, owners = np.concatenate(outside), np.concatenate(outside_of)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    edges = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, int)
    ends = np.append(edges[1:], len(values))
    several = ends - edges > 1
    place_of = np.full(n, -1)
    place_of[asked] = np.arange(len(asked))
    found_links = []
    for begin in range(0, len(asked), 256):
        part = asked[begin:begin + 256]
        shared = (inside[part] @ inside.T).astype(np.int64)
        for low, high in zip(edges[several], ends[several]):
            who = owners[low:high]
            mine = place_of[who]
            mine = mine[(mine >= begin) & (mine < begin + len(part))] - begin
            if len(mine):
                shared[np.ix_(mine, who)] += 1
        union = sizes[part][:, None] + sizes[None, :] - shared
        for row, column in np.argwhere(100 * shared >= PERCENT * union):
            if part[row] != column:
                found_links.append((int(part[row]), int(column)))
    return found_links


def _rest_links(pairs: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between classes around one pivot that the star of the pivot has left apart."""
    around = pairs.union(pairs.select(F.col("pivot"), F.col("pivot")).distinct())
    placed = keep(around.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")))
    home = placed.where("node = pivot").select("pivot", F.col("part").alias("home"))
    placed = placed.join(home, "pivot").withColumn("asked", F.col("part") != F.col("home"))
    sizes = sets.select(F.col("node").alias("pivot"), F.size("shingles").alias("n_pivot"))
    block = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.lit(CELLS) / (2 * F.col("n_pivot"))))
    apart = (
        placed.groupBy("pivot")
        .agg(F.count_if("asked").alias("n_asked"), F.count(F.lit(1)).alias("n"))
        .where("n_asked > 1 OR (n_asked > 0 AND n > n_asked + 1)").join(sizes, "pivot")
        .select("pivot", F.ceil(F.col("n_asked") / block).cast("int").alias("askers"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    # A block of classes to ask about meets every block of the group; the pivot is in all of them.
    members = keep(placed.select("pivot", "node", "asked").join(apart, "pivot").withColumns({
        "own": F.pmod(F.xxhash64("node"), F.col("askers")).cast("int"),
        "place": F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"),
    }))

    def dealt(some: DataFrame, asker: Column, block: Column, here: bool) -> DataFrame:
        return some.select("pivot", asker.alias("asker"), "node", block.alias("block"), F.lit(here).alias("here"))

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    rest = members.where("node != pivot")
    pivots = members.where("node = pivot").select("*", all_of("askers").alias("one"))
    meetings = (
        dealt(rest.where("asked"), F.col("own"), all_of("blocks"), True)
        .union(dealt(rest, all_of("askers"), F.col("place"), False))
        .union(dealt(pivots, F.col("one"), all_of("blocks"), False))
    )
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def search(key: tuple, group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        here = group.column("here").to_numpy(zero_copy_only=False)
        asked_nodes = set(nodes[here].tolist())
        # A class that is asked about may be in the other block as well: it is taken once.
        nodes, first = np.unique(nodes, return_index=True)
        group = group.take(first)
        group_sets = [np.sort(np.asarray(s, np.int64)) for s in group.column("shingles").to_numpy()]
        asked = np.flatnonzero([node in asked_nodes for node in nodes.tolist()])
        pivot = group_sets[int(np.flatnonzero(nodes == key[0].as_py())[0])]
        found = links_within(group_sets, pivot, asked) if len(asked) else []
        return pa.table({
            "u": pa.array([nodes[a] for a, _ in found], pa.int64()), "v": pa.array([nodes[b] for _, b in found], pa.int64())
        })

    return meetings.join(sets, "node").select("pivot", "asker", "block", "node", "shingles", "here").groupBy(
        "pivot", "asker", "block"
    ).applyInArrow(search, schema)


def _class_components(rows: DataFrame, digests: DataFrame, one_document: bool = False) -> DataFrame:
    """(n, low, high, component) of every class of texts.

    ``rows`` has row and text. With ``one_document`` the classes of rows of one doc_id are linked, too.
    """
    mark = ["n", "low", "high"]
    classes = keep(
        digests.where("n > 0").groupBy(*mark).agg(F.min("row").alias("node"), F.min("sig").alias("sig"))
    )
    keyed = _keyed(classes)
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = keep(keyed.join(crowded, "key"))
    pairs = keep(_star_pairs(buckets))
    nodes = pairs.select("node").union(pairs.select("pivot")).distinct()
    sets = keep(_sets(rows, nodes))
    shared = F.size(F.array_intersect("shingles", "pivot_shingles"))
    stars = keep(
        pairs.join(sets, "node")
        .join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("pivot_shingles")), "pivot")
        .where(linked(shared, F.size("shingles"), F.size("pivot_shingles")))
        .select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    )
    parts = keep(components(stars))
    rest = _rest_links(pairs, parts, sets)
    named = parts.select("node", "component")
    classes = classes.drop("sig")
    if one_document:
        placed = digests.where("n > 0").join(classes, mark).select("doc_id", "node")
        least = placed.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v < most")
        rest = rest.union(placed.join(least, "doc_id").where("node != v").select("node", "v").distinct())
    rest = keep(rest)
    # Components again, of the few rest links between the components so far.
    higher = (
        rest.join(named.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
        .join(named.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
        .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    )
    joined = components(higher).select(F.col("node").alias("part"), F.col("component").alias("top"))
    tops = classes.join(named, "node", "left").withColumn("part", F.coalesce("component", "node")).join(
        joined, "part", "left"
    )
    return tops.select(*mark, F.coalesce("top", "part").alias("component"))


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are parted by white space, A-Z in lower case. A set has the distinct shingles of five
    words, or the whole sequence of fewer words. Texts are linked where 100 times the
    common shingles are at least 75 times the united ones. Texts without words are alone,
    and so are rows without a doc_id, whose component is NULL; rows with one doc_id
    are one document: what is linked with one of them is linked with all. Texts are whole, however long. An
    empty table gives no rows, other columns are ignored.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    digests = keep(_digests(rows))
    named = digests.where("doc_id IS NOT NULL")
    found = _class_components(rows, named, one_document=True)
    placed = named.where("n > 0").join(found, ["n", "low", "high"])
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = placed.select("doc_id", "component").distinct().join(smallest, "component").select(
        F.col("doc_id").alias("known_id"), "component_id"
    )
    return digests.select("doc_id", F.col("n").alias("n_shingles")).join(
        ids, F.col("doc_id") == F.col("known_id"), "left"
    ).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one row of every group of linked texts, columns unchanged.

    Links as in ``near_components``, but between rows: rows of one doc_id, or without one, are
    different documents here. The row with the smallest doc_id stays (NULL last), among rows of one id
    that of the least hash, of rows alike in all columns any one. Rows without words all stay. An empty table
    gives no rows.
    """
    packed = docs.select(F.struct("*").alias("packed")).select("packed", F.xxhash64("packed").alias("row"))
    rows = packed.select(F.col("packed.doc_id").alias("doc_id"), F.col("packed.text").alias("text"), "row")
    digests = keep(_digests(rows))
    found = _class_components(rows, digests)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    placed = digests.where("n > 0").join(found, ["n", "low", "high"])
    firsts = placed.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    copies = digests.groupBy("row").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    stays = copies.where("n = 0").unionByName(copies.where("n > 0").join(firsts, "row", "left_semi"))
    kept = packed.join(stays, "row")
    once = kept.where("copies = 1 OR n = 0").select("packed")
    alike = kept.where("copies > 1 AND n > 0").groupBy("row").agg(F.first("packed").alias("packed")).select("packed")
    return once.union(alike).select("packed.*")


ORACLE_SQL = """
WITH parts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
        ELSE array_to_string(ws[i:i + 4], ' ') END AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM parts WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
    WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
    WITH RECURSIVE r(node, seen) AS (
        SELECT DISTINCT u, u FROM both_ways
        UNION
        SELECT b.v, r.seen FROM r JOIN both_ways b ON b.u = r.node
    ) SELECT node, min(seen) AS component FROM r GROUP BY node
)
SELECT p.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, p.doc_id) AS component_id,
    p.doc_id = coalesce(component, p.doc_id) AS kept
FROM parts p LEFT JOIN sizes ON p.doc_id = sizes.doc_id LEFT JOIN reach ON p.doc_id = reach.node
"""
