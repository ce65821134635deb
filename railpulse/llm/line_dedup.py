"""Fuzzy line dedup by MinHash, in DataFrame operations only.

1. The signature of a line are 27 minimum hashes of its eight-character shingles, of one in eight, chosen by their own
   hash; lines of up to 128 characters, in which few are chosen, have a second signature of all their shingles. Equal
   lines have one signature; rows are combined in map tasks, so a line that a third of all rows share costs each one row.
2. Three minhashes make a band key; lines that share one of nine keys are candidates. At a similarity of 0.75 of the chosen
   shingles 7 of 1000 pairs share none, at 0.8 one of 1000. Keys of three keep lines that are not similar out of each other's
   buckets.
3. In every bucket the lines are compared with its most frequent one, the pivot. Where some are then still apart from
   it, these are compared with all others of the bucket that they are not connected with already, but for two
   kinds of pairs. Jaccard distance is a metric: two lines whose distances from the pivot differ by more than a quarter cannot
   be similar. And lines of such buckets get sketches: 1536 bits, on each of which an even or an odd number of shingles falls. The bits
   that differ bound from below how many shingles two lines do not share. So of a large group of variants, each unlike
   the others, few pairs are compared.
4. The Jaccard similarity of the two sets of all shingles decides. Links become components, and of every component the first
   line stays.

Lines travel as 64-bit hashes and sets are sets of 64-bit hashes; texts of candidates only, one for all rows that are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railpulse.llm.common import WORD_BREAKS, blank_breaks
from railpulse.llm.components import components
from railpulse.operators.durable import keep

SHINGLE = 8
PERCENT = 75
#: Lines of fewer characters are only ever alone: their few shingles say little.
SHORTEST_LINE = 40
BANDS, ROWS = 9, 3
#: Bits of the hash of a shingle, and which of them are set in those that are signed, one in eight; in lines of few characters all are
#: signed as well. Seeds leave the sign alone, so the minima of one in four, of any sign, are the same, but for lines with positive ones only.
SAMPLED, SIGNED, FEW_CHARACTERS = -(1 << 31) + 3, -(1 << 31), 128
#: Candidate lines that are broadcast as hashes, some MB; more of them are joined by shuffling.
BROADCAST_LINES = 500_000

#: Sketches of lines that are compared away from a pivot: bits, one shingle in how many is in them, and up to how many
#: shingles that only one of two lines has they serve.
STRATA = ((1536, 1, 1400), (256, 16, 2400), (256, 64, 1 << 40))

_WIDTH = 4  # bytes of a character in the coding that shingles are cut from


def plain(line: Column) -> Column:
    """The line as it is compared: word breaks as blanks, none at the ends. A line has no \\n."""
    # Looking for a mark is far cheaper than replacing it, and few lines have one.
    broken = F.lit(False)
    for mark in WORD_BREAKS:
        if mark != "\n":
            broken |= F.contains(line, F.lit(mark))
    return F.trim(F.when(broken, blank_breaks(line)).otherwise(F.coalesce(line, F.lit(""))))


def _seeds(first: int, last: int) -> list[int]:
    """Masks of 31 bits, one per minhash: multiples of the golden ratio."""
    return [(i * 0x9E3779B1) % (1 << 31) for i in range(first, last + 1)]


def _all_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, t, u, line_no, line) of every line of ``rows``, which has doc_id, text, t and u."""
    split = rows.select("doc_id", "t", "u", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return split.select("doc_id", "t", "u", "line_no", plain(F.col("raw")).alias("line"))


def _long(shortest: int) -> Column:
    return F.length("line") >= shortest


def _starts(coded: Column) -> Column:
    """Where the shingles of a coded line begin, counted in bytes from 1."""
    return F.sequence(F.lit(1), F.octet_length(coded) - (_WIDTH * SHINGLE - 1), F.lit(_WIDTH))


def _shingle(coded: Column, at: Column) -> Column:
    return F.substring(coded, at, F.lit(_WIDTH * SHINGLE))


def signatures(lines: DataFrame, shortest: int = SHORTEST_LINE) -> DataFrame:
    """(h, mask, n, m0, m1, ...) per distinct line of (h, line) of ``shortest`` characters or more; ``n`` rows have it.
    A signature is of the shingles whose hash has, of the bits of ``mask``, the sign only; lines without one have one signature.
    """
    # No mask, no row: a filter would compute every line once for itself and once for what follows.
    masks = F.when(F.length("line") < shortest, F.lit(None)).when(
        F.length("line") <= FEW_CHARACTERS, F.array(F.lit(SAMPLED), F.lit(0))
    ).otherwise(F.array(F.lit(SAMPLED)))
    coded = lines.select("h", F.encode("line", "UTF-32").alias("coded"), F.explode(masks).alias("mask"))
    each = coded.select("h", "mask", "coded", F.explode(_starts(F.col("coded"))).alias("at")).select(
        "h", "mask", "at", F.hash(_shingle(F.col("coded"), F.col("at"))).alias("shingle")
    )
    chosen = F.col("shingle").bitwiseAND(F.col("mask")) == F.col("mask").bitwiseAND(F.lit(SIGNED))
    # The first shingle is always there, for the count; as a positive number it takes no minimum from negative ones.
    signed = each.where(chosen | (F.col("at") == 1)).select(
        "h", "mask", "at", F.when(chosen, F.col("shingle")).otherwise(F.lit((1 << 31) - 1)).alias("shingle")
    )
    least = [F.min(F.col("shingle").bitwiseXOR(F.lit(seed))).alias(f"m{i}") for i, seed in enumerate(_seeds(1, BANDS * ROWS))]
    return signed.groupBy("h", "mask").agg(F.count_if(F.col("at") == 1).alias("n"), *least)


def band_keys(signed: DataFrame) -> DataFrame:
    """(h, n, key), a row per signature and band."""
    keys = [
        F.xxhash64(F.lit(band), "mask", *[f"m{band * ROWS + r}" for r in range(ROWS)])
        for band in range(BANDS)
    ]
    return signed.select("h", "n", F.explode(F.array(*keys)).alias("key"))


def _sketches(lines: DataFrame) -> DataFrame:
    """(h, size, w0, w1, ...) of every line of (h, line): how many distinct shingles it has, and for each of STRATA
    how many fall on each of its bits, even or odd."""
    each = lines.select("h", F.explode(shingle_set(F.col("line"))).alias("shingle"))
    words, first = [], 0
    for bits, rate, _ in STRATA:
        at = F.pmod(F.shiftright("shingle", 12), F.lit(bits))
        chosen = F.col("shingle").bitwiseAND(rate - 1) == 0
        place = F.when(chosen, F.shiftright(at, 6).cast("int")).otherwise(-1)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))
        each = each.withColumns({f"place{first}": place, f"bit{first}": bit})
        words += [
            F.bit_xor(F.when(F.col(f"place{first}") == i, F.col(f"bit{first}")).otherwise(F.lit(0).cast("bigint")))
            for i in range(bits // 64)
        ]
        first += bits // 64
    # Never NULL, and known not to be: the code that compares them gets half as long.
    words = [F.coalesce(word, F.lit(0).cast("bigint")).alias(f"w{i}") for i, word in enumerate(words)]
    return each.groupBy("h").agg(F.count(F.lit(1)).alias("size"), *words)


def _may_link() -> Column:
    """Whether the shingles of the rows ``a`` and ``b``, with their sketches, may be similar enough.

    Bits on which two sketches differ are those on which an odd number of shingles fall that only one line has. Similar
    lines have at most a seventh of both sizes of such shingles, and never more odd bits than that. They seldom have as many, since
    some fall on one bit: four standard deviations above the mean are asked for.
    """
    sizes = F.col("a.size") + F.col("b.size")
    most = sizes * ((100 - PERCENT) / (100 + PERCENT))
    found, first = None, 0
    for bits, rate, up_to in STRATA:
        odd = sum(
            (F.bit_count(F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}"))) for i in range(first, first + bits // 64)), F.lit(0)
        )
        load = most / (rate * bits)
        mean = (1 - F.exp(-2 * load)) * (bits / 2)
        spread = F.sqrt(F.greatest(F.lit(0.0), ((1 - F.exp(-4 * load)) / 4 - load * F.exp(-4 * load) / rate) * bits))
        few = odd <= F.least(most, mean + 4 * spread) + 1e-6
        found = F.when(most <= up_to, few) if found is None else found.when(most <= up_to, few)
        first += bits // 64
    longer = F.greatest("a.size", "b.size") * PERCENT <= F.least("a.size", "b.size") * 100
    return longer & found.otherwise(F.lit(True))


def _buckets(keyed: DataFrame) -> DataFrame:
    """(key, h, pivot) of the keys with two or more lines; the pivot is the most frequent one."""
    same = Window.partitionBy("key")
    # Most keys are of one line. The others, which lie together in order already, are gone over again.
    shared = keyed.select("key", "h", "n", F.min("h").over(same).alias("low"), F.max("h").over(same).alias("high")).where("low < high")
    return shared.select("key", "h", F.max(F.struct("n", "h")).over(same).alias("most")).select("key", "h", F.col("most.h").alias("pivot"))


def _shingles(line: Column) -> Column:
    """Hashes of the eight-character shingles, repeats included."""
    def of(coded: Column) -> Column:
        return F.transform(_starts(coded), lambda at: F.xxhash64(_shingle(coded, at)))

    # A variable of a lambda is computed once, an expression in it for every shingle.
    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), of), 0)


def shingle_set(line: Column) -> Column:
    """Hashes of the distinct eight-character shingles."""
    return F.array_distinct(_shingles(line))


def _measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (h, other) with the sizes of their ``shared`` and ``united`` shingles."""
    others = texts.select(F.col("h").alias("other"), F.col("line").alias("other_line"))
    both = pairs.join(texts, "h").join(others, "other")
    # Outside of lambdas, and of hashes instead of sets: so Spark compiles both operations for whole numbers.
    hashed = both.select("h", "other", _shingles(F.col("line")).alias("mine"), _shingles(F.col("other_line")).alias("theirs"))
    return keep(hashed.select(
        "h", "other", F.size(F.array_intersect("mine", "theirs")).alias("shared"),
        F.size(F.array_union("mine", "theirs")).alias("united"),
    ))


def _links(measured: DataFrame) -> DataFrame:
    linked = 100 * F.col("shared") >= PERCENT * F.col("united")
    return measured.where(linked).select(F.col("h").alias("u"), F.col("other").alias("v"))


def line_components(lines: DataFrame, shortest: int = SHORTEST_LINE) -> DataFrame:
    """(h, component) of the lines (h, line) of ``shortest`` characters or more that are linked with other lines."""
    places = keep(_buckets(band_keys(signatures(lines, shortest))))
    wanted = keep(places.select("h").distinct())
    few = wanted.count() <= BROADCAST_LINES
    texts = keep(
        lines.join(F.broadcast(wanted) if few else wanted, "h", "left_semi")
        .groupBy("h").agg(F.first("line").alias("line"))
    )
    stars = _measured(places.where("h != pivot").select("h", F.col("pivot").alias("other")).distinct(), texts)
    parts = keep(components(_links(stars)))
    named = parts.select(F.col("node").alias("h"), F.col("component").alias("part"))
    homes = parts.select(F.col("node").alias("pivot"), F.col("component").alias("home"))
    away = stars.select("h", F.col("other").alias("pivot"), (1 - F.col("shared") / F.col("united")).alias("away"))
    apart = (
        places.where("h != pivot").join(away, ["h", "pivot"]).join(named, "h", "left").join(homes, "pivot", "left")
        .select("key", "h", "away", F.coalesce("part", "h").alias("part"), F.coalesce("home", "pivot").alias("home"))
    )
    apart = keep(apart)
    open_keys = apart.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    crowded = keep(apart.join(open_keys, "key"))
    sketches = keep(_sketches(texts.join(crowded.select("h").distinct(), "h", "left_semi")))
    placed = crowded.join(sketches, "h")
    asked = placed.where("part != home")
    reach = 1 - PERCENT / 100 + 1e-9
    compared = (
        (F.col("a.part") != F.col("b.part")) & ((F.col("b.part") == F.col("b.home")) | (F.col("b.h") < F.col("a.h")))
        & (F.abs(F.col("a.away") - F.col("b.away")) <= reach)
        & _may_link()
    )
    rest = (
        asked.alias("a").join(placed.alias("b"), (F.col("a.key") == F.col("b.key")) & compared)
        .select(F.greatest("a.h", "b.h").alias("h"), F.least("a.h", "b.h").alias("other")).distinct()
    )
    more = _links(_measured(rest, texts))
    # Components again, of the links between the components so far.
    mine = named.select(F.col("h").alias("u"), F.col("part").alias("u_part"))
    theirs = named.select(F.col("h").alias("v"), F.col("part").alias("v_part"))
    between = more.join(mine, "u", "left").join(theirs, "v", "left").select(
        F.coalesce("u_part", "u").alias("u"), F.coalesce("v_part", "v").alias("v")
    )
    tops = components(between).select(F.col("node").alias("part"), F.col("component").alias("top"))
    single = more.select(F.explode(F.array("u", "v")).alias("h")).distinct().join(named, "h", "left_anti").select(
        "h", F.col("h").alias("part")
    )
    return named.union(single).join(tops, "part", "left").select("h", F.coalesce("top", "part").alias("component"))


def _classes(rows: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, t, u, line_no, first) of every line; ``first`` is the place of the line of its class that stays.

    ``rows`` has doc_id, t, u and text.
    """
    if shortest < SHINGLE:
        raise ValueError(f"lines of fewer than {SHINGLE} characters have no shingle")
    lines = _all_lines(rows)
    known = line_components(lines.select(F.xxhash64("line").alias("h"), "line"), shortest).select(F.col("h").alias("known"), "component")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "t", "u", "line_no")
    # Short lines are of no part: each is its own first one.
    hashed = lines.select("doc_id", "t", "u", "line_no", F.when(_long(shortest), F.xxhash64("line")).alias("h"))
    named = keep(hashed.join(known, F.col("h") == F.col("known"), "left").select(
        "doc_id", "t", "u", "line_no", F.coalesce("component", "h").alias("part")
    ))
    firsts = named.where("part IS NOT NULL").groupBy("part").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    return named.join(firsts, "part", "left").select(
        "doc_id", "t", "u", "line_no", F.coalesce("first", order).alias("first")
    )


def _is_first() -> Column:
    same = F.lit(True)
    for name in ("doc_id", "t", "u", "line_no"):
        same &= F.col(name).eqNullSafe(F.col(f"first.{name}"))
    return same


def line_classes(docs: DataFrame, shortest: int = SHORTEST_LINE) -> DataFrame:
    """(doc_id, line_no, first_doc_id, first_line_no, kept), one row for every line of ``docs``.

    Lines are parted by ``\\n`` and compared without outer blanks. Those with fewer than ``shortest``
    characters are in a class of their own. Of linked lines, and of those linked through
    others, the first stays: by doc_id (NULL last), among rows of one doc_id or without one by a hash of the
    text, then by line number; rows alike in doc_id and text are one row and keep the same lines. NULL texts have
    no lines, empty texts have one; texts and lines are whole, however long; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("t"), F.hash("text", "doc_id").alias("u"),
        "text",
    )
    return _classes(rows, shortest).select(
        "doc_id", "line_no", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"),
        _is_first().alias("kept"),
    )


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST_LINE) -> DataFrame:
    """The rows of ``docs`` without repeated lines; all rows and columns stay, ``n_chars``
    follows the text where there is one.

    Lines as in ``line_classes``, but a row is known by all its columns: rows of one doc_id, or without one, lose
    only lines of their own, and rows alike in all columns are one row and keep the same lines. A text whose lines all go becomes
    empty, a NULL text stays NULL; an empty table gives no rows.
    """
    packed = docs.select(F.struct("*").alias("row"))
    known = packed.select("row", F.xxhash64("row").alias("t"), F.hash(F.lit(1), "row").alias("u"))
    rows = known.select(
        F.col("row.doc_id").alias("doc_id"), "t", "u", F.col("row.text").alias("text")
    )
    gone = _classes(rows, shortest).where(~_is_first()).groupBy(F.col("t").alias("gone_t"), F.col("u").alias("gone_u")).agg(
        F.collect_set("line_no").alias("gone")
    )
    same = (F.col("t") == F.col("gone_t")) & (F.col("u") == F.col("gone_u"))
    joined = known.join(gone, same, "left").select("row", "gone", F.split("row.text", "\n").alias("lines"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(numbers, lambda i: F.get("lines", i)), "\n")
    cut = joined.select(
        "row", "gone", F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("row.text")).alias("left_text")
    )
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("left_text").alias("text"))
        elif name == "n_chars":
            whole = F.when(F.col("gone").isNotNull(), F.length("left_text")).otherwise(F.col("row.n_chars"))
            columns.append(whole.cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col(f"row.`{name}`").alias(name))
    return cut.select(*columns)
