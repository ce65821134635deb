"""Phrase collocations: frequent phrases level by level, with tries over the text, then the score of their weakest cut.

1. Words are counted per language. A frequent word is a phrase of one word.
2. For 2, 3, ... words the frequent phrases of one word less are a double-array trie, which is broadcast. A
   task reads a batch of texts as arrays of word hashes and advances the states of all places at the
   same time, one level after another. A place whose state accepts and is followed, one word on, by
   another frequent phrase, begins an Apriori-safe candidate: all its shorter parts are frequent. Candidates
   are numbered by accepting state and last word, and a bincount gives the batch's counts, which are
   summed over all batches. Only candidates that occur are ever made: joining frequent phrases with one
   another would make more of them than there is text.
3. The score of a phrase needs the counts of its parts, all of them frequent phrases.

Broadcasts are bounded: a trie holds at most ``SHARD`` phrases, and more of them take further passes over the
text; the phrases that may follow are a bit map of at most ``MAP_BITS`` bits, which may say yes too often, and
then a candidate is counted in vain. Words and phrases are known by 64-bit hashes of language and words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse.llm.common import slices
from railpulse.llm.wordcodes import U64, Words, mixed, windows
from railpulse.operators.durable import keep

PIECE_MARKS = b".,;:!?\n\x0b\x0c\r"
SEPARATORS = b" \t" + PIECE_MARKS
LONGEST = 5
FREQUENT = 100
TOP = 2000
#: Phrases in one broadcast trie, and bits of the map of phrases that may follow.
SHARD, MAP_BITS = 1 << 20, 1 << 27
#: Bytes of text that are worked on at a time, and counts that a task gathers before it hands them on.
TEXT_BYTES, GATHERED = 4 << 20, 1 << 20
#: Parts of a language that are ranked by themselves before the language is.
RANK_PARTS = 64
NO_LANGUAGE = "und"


class Text:
    """The words of a batch: their hashes with the language, and how many words their piece has from each on."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = words = Words(batch.column("text"), SEPARATORS, lower=True)
        langs = batch.column("lang").dictionary_encode()
        salts = np.array([xxhash.xxh3_64_intdigest(name) for name in langs.dictionary.to_pylist()] or [0], U64)
        self.langs, self.names = np.asarray(langs.indices, np.int64), langs.dictionary.to_pylist()
        self.hashes = mixed(words.hashes() + salts[self.langs[words.text]] if len(words) else words.hashes())
        marks = np.zeros(256, bool)
        marks[np.frombuffer(PIECE_MARKS, np.uint8)] = True
        before = np.cumsum(marks[words.data], dtype=np.int32)
        n = len(words)
        last = np.ones(n, bool)
        if n:
            piece = before[words.begin]
            last[:-1] = (words.text[1:] != words.text[:-1]) | (piece[1:] != piece[:-1])
        ends = np.flatnonzero(last)
        self.left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1 if n else np.empty(0, np.int64)


class Trie:
    """A double-array trie of phrases of one length: the child of state s by code c is ``base[s] + c`` where ``check`` says s.

    ``phrases`` is a sorted matrix of word hashes without repeats, ``number[state]`` the row that an accepting state stands for.
    """

    def __init__(self, phrases: np.ndarray):
        self.words = np.unique(phrases)
        codes = np.searchsorted(self.words, phrases) + 1
        n, length = codes.shape
        span = len(self.words) + 1
        room = 4 * n * length + 4 * span + 64
        self.base, self.check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.check[0] = -2  # the root, nobody's child
        parents = np.zeros(n, np.int64)
        new = np.zeros(n, bool)
        new[:1] = True
        for level in range(length):
            new[1:] |= codes[1:, level] != codes[:-1, level]
            heads = np.flatnonzero(new)
            states = self._placed(parents[heads], codes[heads, level], span)
            parents = states[np.cumsum(new) - 1]
        used = int(np.flatnonzero(self.check != -1)[-1]) + span + 1
        if used > len(self.check):
            self.check = np.concatenate([self.check, np.full(used - len(self.check), -1, np.int64)])
            self.base = np.concatenate([self.base, np.zeros(used - len(self.base), np.int64)])
        self.base, self.check = self.base[:used].astype(np.int32), self.check[:used].astype(np.int32)
        self.number = np.full(used, -1, np.int32)
        self.number[parents] = np.arange(n)

    def _placed(self, parents: np.ndarray, codes: np.ndarray, span: int) -> np.ndarray:
        """A state for every child; the children of one parent are neighbours in the arguments."""
        states = np.zeros(len(codes), np.int64)
        heads = np.flatnonzero(np.append(True, parents[1:] != parents[:-1])) if len(codes) else np.empty(0, np.int64)
        sizes = np.diff(np.append(heads, len(codes)))
        pick = np.random.default_rng(len(codes))
        # Large families first, while there is room; only children take what is left.
        for head, size in sorted(zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()), key=lambda x: -x[1]):
            own = codes[head:head + size]
            for _ in range(200):
                base = int(pick.integers(1, max(2, len(self.check) - 2 * span)))
                if (self.check[base + own] == -1).all():
                    break
            else:
                base = len(self.check)
                self.check = np.concatenate([self.check, np.full(2 * span, -1, np.int64)])
                self.base = np.concatenate([self.base, np.zeros(2 * span, np.int64)])
            states[head:head + size] = base + own
            self.check[base + own] = parents[head]
            self.base[parents[head]] = base
        single = heads[sizes == 1]
        free = np.flatnonzero(self.check[span + 1:] == -1)[:len(single)] + span + 1
        states[single] = free
        self.check[free] = parents[single]
        self.base[parents[single]] = free - codes[single]
        return states

    def states(self, text: Text, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The places whose words are a phrase of ``length`` words and are followed by a word of the same piece, and their states."""
        at = np.flatnonzero(text.left > length)
        code = np.searchsorted(self.words, text.hashes)
        found = self.words[np.minimum(code, len(self.words) - 1)] == text.hashes if len(self.words) else np.zeros(len(code), bool)
        code = np.where(found, code + 1, 0)
        at = at[code[at] > 0]
        state = np.zeros(len(at), np.int64)
        for level in range(length):
            step = code[at + level]
            following = self.base[state] + step
            lives = (step > 0) & (self.check[following] == state)
            at, state = at[lives], following[lives]
        return at, state


class BitMap:
    """Hashes of phrases, a bit each."""

    def __init__(self, bits: int, places: np.ndarray, marks: np.ndarray):
        self.mask = U64(bits - 1)
        self.cells = np.zeros(max(bits >> 6, 1), U64)
        self.cells[places] = marks.view(U64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes & self.mask
        return (self.cells[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1) == 1


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", TEXT_BYTES):
        text = Text(batch)
        words = text.words
        hashes, at, counts = np.unique(text.hashes, return_index=True, return_counts=True)
        data = words.data.tobytes()
        found = [data[a:b] for a, b in zip(words.begin[at].tolist(), words.end[at].tolist())]
        langs = text.langs[words.text[at]]
        per_lang = np.bincount(text.langs[words.text], minlength=len(text.names)) if len(words) else np.zeros(len(text.names), np.int64)
        # A row without a word has the number of all words of the language.
        lang = pa.array(text.names, pa.string()).take(pa.array(np.concatenate([langs, np.arange(len(text.names))])))
        yield pa.RecordBatch.from_arrays([
            lang, pa.array([*found, *[None] * len(text.names)], pa.binary()),
            pa.array(np.concatenate([hashes, np.zeros(len(text.names), U64)]).view(np.int64)),
            pa.array(np.concatenate([counts, per_lang]).astype(np.int64)),
        ], names=["lang", "word", "k", "n"])


class Counts:
    """Counts by key with two numbers each, gathered over several batches."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, key: np.ndarray, number: np.ndarray, last: np.ndarray) -> None:
        """Count every row of the arrays once."""
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, minlength=len(first))
        self.parts.append((key[first], number[first], last[first], counts))
        self.size += len(first)
        if self.size > 2 * GATHERED:
            self._merge()

    def _merge(self) -> None:
        key, number, last, counts = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        sums = np.add.reduceat(counts[order], heads) if len(heads) else counts
        self.parts = [(key[heads], number[order][heads], last[order][heads], sums)]
        self.size = len(heads)

    def full(self) -> bool:
        return self.size > GATHERED

    def taken(self) -> pa.RecordBatch:
        """The counts so far; the next ones begin at nothing."""
        if self.parts:
            self._merge()
            _, number, last, counts = self.parts[0]
        else:
            number = last = counts = np.empty(0, np.int64)
        self.__init__()
        return pa.RecordBatch.from_arrays([
            pa.array(number.astype(np.int32)), pa.array(last.view(np.int64)), pa.array(counts.astype(np.int64)),
        ], names=["number", "k", "n"])


def _candidate_counts(trie, follow, length: int):
    """Counts of (phrase number, hash of the word behind it) in the batches of a task."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Counts()
        for batch in slices(batches, "text", TEXT_BYTES):
            text = Text(batch)
            at, state = trie.value.states(text, length)
            follows = follow.value.has(windows(text.hashes, length)[at + 1])
            at, state = at[follows], state[follows]
            last = text.hashes[at + length]
            gathered.add(mixed(state.astype(U64)) ^ last, trie.value.number[state], last)
            if gathered.full():
                yield gathered.taken()
        yield gathered.taken()

    return rows


def _bits(bits: int, length: int):
    """(place, mark): the cells of the bit map that a batch of phrases sets."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _phrase_hashes(batch.column("ws"), length) & U64(bits - 1)
            place, inverse = np.unique(bit >> U64(6), return_inverse=True)
            marks = np.zeros(len(place), U64)
            np.bitwise_or.at(marks, inverse, U64(1) << (bit & U64(63)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place.astype(np.int64)), pa.array(marks.view(np.int64))], names=["place", "mark"]
            )

    return rows


def _matrix(phrases: pa.Array, length: int) -> np.ndarray:
    phrases = phrases.combine_chunks() if isinstance(phrases, pa.ChunkedArray) else phrases
    return np.asarray(phrases.flatten(), np.int64).view(U64).reshape(-1, length)


def _phrase_hashes(phrases: pa.Array, length: int) -> np.ndarray:
    """The hash that ``windows`` gives for a phrase in a text."""
    return windows(_matrix(phrases, length).reshape(-1), length)[::length]


def _longer(matrix):
    """Phrases from their number in the trie and the hash of the word behind."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = matrix.value[np.asarray(batch.column("number"), np.int64)]
            words = np.column_stack([known, np.asarray(batch.column("k"), np.int64).view(U64)])
            edges = np.arange(0, words.size + 1, words.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(edges), pa.array(words.reshape(-1).view(np.int64))), batch.column("n")],
                names=["ws", "n"],
            )

    return rows


def _follow_map(phrases: DataFrame, count: int, length: int) -> BitMap:
    bits = 64
    while bits < min(64 * count, MAP_BITS):
        bits *= 2
    cells = phrases.select("ws").mapInArrow(_bits(bits, length), "place bigint, mark bigint").groupBy("place").agg(
        F.bit_or("mark").alias("mark")
    ).toArrow()  # at most bits / 64 rows
    return BitMap(bits, np.asarray(cells.column("place"), np.int64), np.asarray(cells.column("mark"), np.int64))


def _extended(texts: DataFrame, phrases: DataFrame, length: int, frequent: int, shard: int) -> DataFrame | None:
    """(ws, n) of the frequent phrases of ``length`` + 1 words; ``phrases`` are those of ``length`` words."""
    spark = texts.sparkSession
    count = phrases.count()
    if not count:
        return None
    follow = spark.sparkContext.broadcast(_follow_map(phrases, count, length))
    shards = -(-count // shard)
    found = None
    for part in range(shards):
        mine = phrases.where(F.pmod(F.xxhash64("ws"), F.lit(shards)) == part) if shards > 1 else phrases
        matrix = _matrix(mine.select("ws").toArrow().column("ws"), length)  # near ``shard`` rows
        matrix = matrix[np.lexsort(matrix.T[::-1])]
        known = spark.sparkContext.broadcast(matrix)
        trie = spark.sparkContext.broadcast(Trie(matrix))
        counts = texts.mapInArrow(_candidate_counts(trie, follow, length), "number int, k bigint, n bigint")
        often = counts.groupBy("number", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent)
        longer = keep(often.mapInArrow(_longer(known), "ws array<bigint>, n bigint"))
        found = longer if found is None else found.union(longer)
    return found


def frequent_phrases(
    docs: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT, shard: int = SHARD
) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, k, n; without a word: all of the language) and phrases (ws, n), of one word on.

    ``k`` is the hash of a word in its language, ``ws`` those of a phrase. ``docs`` has lang and text; other columns are
    ignored. NULL texts have no words, a NULL lang is ``und``. An empty table gives no rows.
    """
    texts = docs.select(
        F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("binary").alias("text")
    )
    counts = texts.mapInArrow(_word_counts, "lang string, word binary, k bigint, n bigint")
    words = keep(
        counts.groupBy("lang", "word", "k").agg(F.sum("n").alias("n"))
        .where((F.col("n") >= frequent) | F.col("word").isNull())
        .select("lang", F.col("word").cast("string").alias("word"), "k", "n")
    )
    now = words.where("word IS NOT NULL").select(F.array("k").alias("ws"), "n")
    found = now
    for length in range(1, longest):
        now = _extended(texts, now, length, frequent, shard)
        if now is None:
            break
        found = found.union(now)
    return words, found


def _scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, ws, a, l, r, n, score) of the phrases of two or more words, by their weakest cut."""
    longer = phrases.where(F.size("ws") > 1).withColumnRenamed("n", "a")
    cuts = longer.select(
        "ws", "a", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k")
    ).select(
        "ws", "a", "k", F.slice("ws", F.lit(1), F.col("k")).alias("head"),
        F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")).alias("tail"),
    )
    heads = phrases.select(F.col("ws").alias("head"), F.col("n").alias("l"))
    tails = phrases.select(F.col("ws").alias("tail"), F.col("n").alias("r"))
    totals = words.where("word IS NULL").select(F.col("lang").alias("total_lang"), F.col("n").alias("total"))
    langs = words.where("word IS NOT NULL").select(F.col("k").alias("first_word"), "lang").join(
        totals, F.col("lang") == F.col("total_lang")
    ).select("first_word", "lang", F.col("total").alias("n"))
    parts = cuts.join(heads, "head").join(tails, "tail").withColumn("first_word", F.col("ws")[0]).join(langs, "first_word")

    # A score is at most ten times n: l and r are no less than a, and a is 100 at least.
    score = F.expr(
        "CAST(1000 * CAST(a AS decimal(19,0)) * CAST(n AS decimal(19,0)) AS decimal(38,0)) "
        "div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))"
    )
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return parts.groupBy("lang", "ws", "a", "n").agg(weakest.alias("cut")).select(
        "lang", "ws", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def _spelled(scored: DataFrame, words: DataFrame) -> DataFrame:
    """``scored`` with ``phrase``, the words joined by blanks, in place of their hashes."""
    names = words.where("word IS NOT NULL").select(F.col("k").alias("w"), "word")
    each = scored.select("ws", F.posexplode("ws").alias("at", "w")).join(names, "w")
    spelled = each.groupBy("ws").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts"))
    phrase = F.array_join(F.col("parts.word"), " ")
    return scored.join(spelled.select("ws", phrase.alias("phrase")), "ws").drop("ws")


def collocations(
    docs: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT, top: int = TOP, shard: int = SHARD
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language.

    A phrase of 2 to ``longest`` words that occurs ``frequent`` times or more scores floor(1000 a n / (l r)) at its
    weakest cut, where a, l and r count the phrase and its two parts and n all words of the language. Phrases inside a
    longer one of the same count are left out. Ties go to more occurrences, then to the lesser phrase by bytes. Texts are
    whole, however long; repeated rows count again. NULL and empty texts add nothing, an empty table gives no rows.
    """
    words, phrases = frequent_phrases(docs, longest, frequent, shard)
    longer = phrases.where(F.size("ws") > 1)
    # A longer phrase never occurs more often, so an equal count one word up is all there is to look for.
    covered = longer.where(F.size("ws") > 2).select(
        F.explode(F.array(F.slice("ws", F.lit(1), F.size("ws") - 1), F.slice("ws", F.lit(2), F.size("ws") - 1))).alias("ws"),
        F.col("n").alias("a"),
    )
    spelled = _spelled(_scored(words, phrases).join(covered, ["ws", "a"], "left_anti"), words)
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    among = Window.partitionBy("lang", part).orderBy(*best)
    few = spelled.withColumn("place", F.row_number().over(among)).where(F.col("place") <= top).drop("place")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH lowered AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), pieces AS (
    SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x != '') AS w
    FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered)
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), grams AS (
    SELECT lang, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS phrase
    FROM (
        SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size
    )
), counted AS (
    SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
    SELECT lang, size, phrase, f, k,
           list_aggregate(string_split(phrase, ' ')[1:k], 'string_agg', ' ') AS head,
           list_aggregate(string_split(phrase, ' ')[k + 1:size], 'string_agg', ' ') AS tail
    FROM (SELECT *, unnest(range(1, size)) AS k FROM counted WHERE size > 1)
), scores AS (
    SELECT c.lang, c.size, c.phrase, c.f AS a, h.f AS l, t.f AS r, totals.n, c.k,
           (1000 * c.f::HUGEINT * totals.n::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT) AS score
    FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head
    JOIN counted t ON t.lang = c.lang AND t.phrase = c.tail JOIN totals ON totals.lang = c.lang
), weakest AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covered AS (
    SELECT lang, f, unnest([
        list_aggregate(string_split(phrase, ' ')[1:size - 1], 'string_agg', ' '),
        list_aggregate(string_split(phrase, ' ')[2:size], 'string_agg', ' ')]) AS phrase
    FROM counted WHERE size > 2
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM weakest w WHERE NOT EXISTS (
        SELECT 1 FROM covered c WHERE c.lang = w.lang AND c.phrase = w.phrase AND 100 * c.f >= 100 * w.a)
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
