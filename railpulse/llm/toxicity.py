"""Toxicity: a convolutional text classifier, trained in numpy.

Words and their beginnings are hashed to embeddings, which add up; filters of several widths slide over them, the maximum
of each filter over the whole text goes into a logistic output. Thresholds for rejecting
texts are calibrated by language on labelled texts that training did not see; the
score itself knows nothing but the text.

All labelled rows that are not held out take part. They are dealt to tasks of some thousand rows; every
task goes over its rows from the same parameters, and what the tasks change is averaged before the next round: of
the vector of a word by the tasks that have the word, of the rest by all. Changes are added as whole numbers, so their order
does not matter. With rows for one task only, it does all rounds at once. Thresholds come from counts of all rows by score.
Scoring is a vectorised UDF over whole texts, a bounded number of words at a time, without any shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railpulse.operators.durable import keep

# Labelled rows that a task trains on, on average; more rows make more tasks. What a task holds at once.
TASK_ROWS = 12_000
HELD_ROWS, HELD_BYTES = 2 * TASK_ROWS, 1 << 26
#: Labels that are broadcast, some MB; more of them are joined by shuffling.
BROADCAST_LABELS = 500_000
HASHED_WORDS = 1 << 16
DIMENSIONS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
EPOCHS = 10
# After which parameters are averaged, where several tasks train.
ROUNDS = 5
FEWEST_STEPS = 400
FEWEST_TEXTS = 5
BATCH = 32
RATE = 0.02
THRESHOLD = 0.3
SPAN = 1 << 16
# Parts of the log-odds in which scores are counted for the thresholds, and of a changed parameter when changes are added.
SCORE_PARTS, CHANGE_PARTS = 2048, 1 << 40
REMEMBERED = 300_000
UNITS = 3

_WORD = re.compile(r"\w+")


def _buckets(word: str) -> list[int]:
    """A word stands for itself and for its beginnings, which languages with endings share."""
    return [zlib.crc32(part.encode()) % HASHED_WORDS for part in (word, word[:4] + "-", word[:5] + "-")]


class WordIds:
    """Buckets of the words seen so far, a bounded number of them between texts."""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.places: dict[str, int] = {}
        self.buckets = np.empty((1024, UNITS), dtype=np.int32)

    def _place(self, word: str) -> int:
        place = self.places.get(word)
        if place is None:
            place = self.places[word] = len(self.places)
            if place == len(self.buckets):
                self.buckets = np.concatenate([self.buckets, np.empty_like(self.buckets)])
            self.buckets[place] = _buckets(word)
        return place

    def of(self, text: str | None) -> np.ndarray:
        """One row of UNITS buckets per word."""
        if len(self.places) > REMEMBERED:
            self._reset()
        words = _WORD.findall((text or "").lower())
        places = np.fromiter(map(self._place, words), dtype=np.int64, count=len(words))
        return self.buckets[places]


def packed(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of several texts in a row, each followed by padding, and their starts."""
    pad = np.full((PAD, UNITS), HASHED_WORDS, dtype=np.int32)
    parts = [part for ids in texts for part in (ids, pad)]
    lengths = np.array([len(ids) + PAD for ids in texts])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)[:-1]])


@dataclass
class ToxicityModel:
    """Parameters of the classifier; ``prior`` is the score of every text without filters."""

    words: np.ndarray | None = None
    filters: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    prior: float = 0.0
    thresholds: Mapping[str, float] = field(default_factory=dict)

    def pooled(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each text, a span of windows at a time."""
        out = np.full((len(starts), len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
        end = len(ids) - PAD
        # Windows that begin in the padding of a text reach into the next one: left out.
        last = np.append(starts[1:], len(ids)) - PAD
        for begin in range(0, max(end, 1), SPAN):
            stop = min(begin + SPAN, end)
            vectors = self.words[ids[begin:stop + PAD]].sum(axis=1)
            n = len(vectors) - PAD
            if n <= 0:
                continue
            first_text = np.searchsorted(starts, begin, side="right") - 1
            after_text = np.searchsorted(starts, stop, side="left")
            for k, width in enumerate(WIDTHS):
                active = np.zeros((n, FILTERS), dtype=np.float32)
                for j in range(width):
                    active += vectors[j:j + n] @ self.filters[k][j]
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                lows = np.maximum(starts[first_text:after_text] - begin, 0)
                highs = np.minimum(last[first_text:after_text] - begin, n)
                full = highs > lows
                edges = np.stack([lows[full], highs[full]], axis=1).ravel()
                if len(edges):
                    padded = np.vstack([active, np.full((1, FILTERS), -np.inf, np.float32)])
                    best = np.maximum.reduceat(padded, edges, axis=0)[::2]
                    rows = np.arange(first_text, after_text)[full]
                    out[rows, columns] = np.maximum(out[rows, columns], best)
        out[np.isneginf(out)] = 0.0  # texts without words: what padding alone gives
        return out

    def score(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        if self.words is None:
            return np.full(len(texts), self.prior)
        if not texts:
            return np.empty(0)
        ids, starts = packed(texts)
        features = np.maximum(self.pooled(ids, starts) + np.concatenate(self.biases), 0)
        return 1 / (1 + np.exp(-np.clip(features @ self.out + self.out_bias, -30, 30).astype(np.float64)))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, THRESHOLD)


class _Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def step(self, parameter: np.ndarray, gradient: np.ndarray, rate: float, rows=slice(None)) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * gradient
        self.v[rows] = 0.99 * self.v[rows] + 0.01 * gradient * gradient
        parameter[rows] -= rate * self.m[rows] / (np.sqrt(self.v[rows]) + 1e-6)


def _started(prior: float, seen_in: np.ndarray, seed: int = 7) -> tuple[ToxicityModel, np.ndarray, np.random.Generator]:
    """A model to begin with, the buckets it may learn and the source of orders; ``seen_in`` has texts by bucket."""
    model = ToxicityModel(prior=prior)
    random = np.random.default_rng(seed)
    words = random.normal(0, 0.01, (HASHED_WORDS + 1, DIMENSIONS)).astype(np.float32)
    # Buckets that few texts have say nothing but which text it is: they stay at zero, as
    # do the words that training never sees.
    alive = seen_in >= FEWEST_TEXTS
    alive[HASHED_WORDS] = False
    words[~alive] = 0
    model.words = words
    model.filters = [
        random.normal(0, 0.5 / np.sqrt(width), (width, DIMENSIONS, FILTERS)).astype(np.float32)
        for width in WIDTHS
    ]
    model.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    model.out = random.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
    model.out_bias = float(np.log(model.prior / (1 - model.prior)))
    return model, alive, random


def _parameters(model: ToxicityModel) -> np.ndarray:
    """All parameters as rows of DIMENSIONS numbers, those of the words first."""
    rest = np.concatenate([x.ravel() for x in (*model.filters, *model.biases, model.out, np.array([model.out_bias]))])
    filled = np.concatenate([rest, np.zeros(-len(rest) % DIMENSIONS)])
    return np.vstack([model.words, filled.reshape(-1, DIMENSIONS)]).astype(np.float64)


def _with_parameters(prior: float, rows: np.ndarray) -> ToxicityModel:
    rest = rows[HASHED_WORDS + 1:].ravel()
    shapes = [*[(width, DIMENSIONS, FILTERS) for width in WIDTHS], *[(FILTERS,)] * len(WIDTHS), (len(WIDTHS) * FILTERS,)]
    ends = np.cumsum([int(np.prod(shape)) for shape in shapes])
    parts = [x.reshape(shape).astype(np.float32) for x, shape in zip(np.split(rest, ends), shapes)]
    n = len(WIDTHS)
    return ToxicityModel(
        words=rows[:HASHED_WORDS + 1].astype(np.float32), filters=parts[:n], biases=parts[n:2 * n], out=parts[2 * n],
        out_bias=float(rest[ends[-1]]), prior=prior,
    )


def _learn(
    model: ToxicityModel, alive: np.ndarray, pieces: Iterable[tuple[list[np.ndarray], np.ndarray]],
    random: np.random.Generator, rounds: range, epochs: int,
) -> None:
    """Go over each piece (word ids, labels 0 or 1) once for each of ``rounds``, out of ``epochs`` in all."""
    words = model.words
    on_words = _Adam(words.shape)
    on_filters = [_Adam(f.shape) for f in model.filters]
    on_biases = [_Adam(b.shape) for b in model.biases]
    on_out, on_bias = _Adam(model.out.shape), _Adam((1,))
    for epoch, (texts, labels) in ((r, piece) for piece in pieces for r in rounds):
        rate = RATE * (1 - epoch / epochs)
        order = random.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin:begin + BATCH]
            ids, starts = packed([texts[i] for i in chosen])
            ends = np.append(starts[1:], len(ids)) - PAD
            vectors = words[ids].sum(axis=1)
            n = len(ids) - PAD
            pooled = np.zeros((len(chosen), len(WIDTHS) * FILTERS), np.float32)
            at = np.zeros(pooled.shape, dtype=np.int64)
            for k, width in enumerate(WIDTHS):
                active = np.zeros((n, FILTERS), np.float32)
                for j in range(width):
                    active += vectors[j:j + n] @ model.filters[k][j]
                for row, (low, high) in enumerate(zip(starts, ends)):
                    if high > low:
                        best = active[low:high].argmax(axis=0)
                        at[row, k * FILTERS:(k + 1) * FILTERS] = low + best
                        pooled[row, k * FILTERS:(k + 1) * FILTERS] = active[low + best, np.arange(FILTERS)]
            pooled += np.concatenate(model.biases)
            features = np.maximum(pooled, 0)
            score = 1 / (1 + np.exp(-np.clip(features @ model.out + model.out_bias, -30, 30)))
            off = ((score - labels[chosen]) / len(chosen)).astype(np.float32)
            back = off[:, None] * model.out * (pooled > 0)
            g_out = features.T @ off + 1e-4 * model.out
            touched: list[np.ndarray] = []
            changes: list[np.ndarray] = []
            g_filters, g_biases = [], []
            for k, width in enumerate(WIDTHS):
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                gradient = np.zeros_like(model.filters[k])
                # Texts without words have no place to learn at.
                part = back[:, columns] * (ends > starts)[:, None]
                for j in range(width):
                    spots = np.minimum(at[:, columns] + j, n + PAD - 1)
                    seen = vectors[spots]  # rows, filters, dimensions
                    gradient[j] = np.einsum("rfd,rf->df", seen, part)
                    change = (part[:, :, None] * model.filters[k][j].T[None]).reshape(-1, DIMENSIONS)
                    touched.append(ids[spots].reshape(-1, UNITS).T.ravel())
                    changes.append(np.tile(change, (UNITS, 1)))
                g_filters.append(gradient + 1e-4 * model.filters[k])
                g_biases.append(back[:, columns].sum(axis=0))
            rows, place = np.unique(np.concatenate(touched), return_inverse=True)
            g_words = np.zeros((len(rows), DIMENSIONS), np.float32)
            np.add.at(g_words, place, np.concatenate(changes))
            learnt = alive[rows]
            rows, g_words = rows[learnt], g_words[learnt]
            on_words.step(words, g_words + 1e-4 * words[rows], rate, rows)
            for k in range(len(WIDTHS)):
                on_filters[k].step(model.filters[k], g_filters[k], rate * 0.2)
                on_biases[k].step(model.biases[k], g_biases[k], rate * 0.2)
            on_out.step(model.out, g_out, rate * 0.2)
            bias = np.array([model.out_bias], np.float32)
            on_bias.step(bias, np.array([off.sum()], np.float32), rate * 0.2)
            model.out_bias = float(bias[0])


def calibrated(counts: pd.DataFrame) -> float:
    """The threshold with the best F1; in the middle of the gap between two groups of scores, each of ``texts``, of which
    ``toxic`` are toxic, from ``low`` to ``high``."""
    ranked = counts.sort_values("low", ascending=False)
    hits = ranked["toxic"].to_numpy().cumsum()
    f1 = 2 * hits / (ranked["texts"].to_numpy().cumsum() + hits[-1])
    best = int(np.argmax(f1))
    below = ranked["high"].iloc[best + 1] if best + 1 < len(ranked) else 0.0
    return float((ranked["low"].iloc[best] + below) / 2)


def _coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ids instead of texts, two bytes each."""
    ids = WordIds()
    for batch in batches:
        coded = [ids.of(text).astype(np.uint16).tobytes() for text in batch.column("text").to_pylist()]
        rest = ["doc_id", "lang", "toxic"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(coded, pa.binary())], names=[*rest, "words"])


def _parted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fourth row of a task is for the thresholds."""
    before = 0
    for batch in batches:
        last = (before + np.arange(batch.num_rows)) % 4 == 3
        before += batch.num_rows
        yield batch.append_column("last", pa.array(last))


def _ids(coded: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).reshape(-1, UNITS) for x in coded.to_pylist()]


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(word ids, labels) of the rows, a bounded number of them and of their words at a time."""
    texts: list[np.ndarray] = []
    labels: list[int] = []
    size = 0
    for batch in batches:
        for ids, label in zip(_ids(batch.column("words")), batch.column("toxic").to_pylist()):
            texts.append(ids)
            labels.append(label)
            size += ids.nbytes
            if len(texts) >= HELD_ROWS or size >= HELD_BYTES:
                yield texts, np.array(labels, np.float32)
                texts, labels, size = [], [], 0
    if texts:
        yield texts, np.array(labels, np.float32)


def _texts_by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(HASHED_WORDS, np.int64)
    for batch in batches:
        for ids in _ids(batch.column("words")):
            seen[np.unique(ids)] += 1
    buckets = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(seen[buckets])], names=["bucket", "texts"])


_CHANGES = [f"d{i}" for i in range(DIMENSIONS)]


def _trained(training: DataFrame, prior: float, n: int, tasks: int) -> ToxicityModel:
    """The model of all rows (words, toxic) of ``training``, ``n`` of them in ``tasks`` partitions."""
    spark = training.sparkSession
    seen_in = np.zeros(HASHED_WORDS + 1, np.int64)
    counts = training.mapInArrow(_texts_by_bucket, "bucket bigint, texts bigint").groupBy("bucket").agg(F.sum("texts")).toArrow()
    seen_in[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    model, alive, random = _started(prior, seen_in)
    epochs = max(EPOCHS, -(-FEWEST_STEPS * BATCH * tasks // n))
    a_round = epochs if tasks == 1 else -(-epochs // ROUNDS)
    for first in range(0, epochs, a_round):
        mine = range(first, min(first + a_round, epochs))
        shared = spark.sparkContext.broadcast((model, alive, random))

        def go_over(batches: Iterable[pa.RecordBatch], mine=mine, shared=shared) -> Iterator[pa.RecordBatch]:
            known, learnt, orders = shared.value
            before = _parameters(known)
            now = _with_parameters(known.prior, before)
            jumps = mine.start * tasks + TaskContext.get().partitionId()
            _learn(now, learnt, _pieces(batches), np.random.Generator(orders.bit_generator.jumped(jumps)), mine, epochs)
            changed = _parameters(now) - before
            rows = np.flatnonzero(changed.any(axis=1) | (np.arange(len(changed)) > HASHED_WORDS))
            if changed.any():
                whole = np.rint(changed[rows] * CHANGE_PARTS).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), *[pa.array(np.ascontiguousarray(x)) for x in whole.T]], names=["row", *_CHANGES]
                )

        schema = ", ".join(f"{name} bigint" for name in ["row", *_CHANGES])
        moved = training.mapInArrow(go_over, schema).groupBy("row").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(name).alias(name) for name in _CHANGES]
        ).toArrow()
        rows = _parameters(model)
        sums = np.stack([moved.column(name).to_numpy() for name in _CHANGES], axis=1) / CHANGE_PARTS
        rows[moved.column("row").to_numpy()] += sums / moved.column("n").to_numpy()[:, None]
        model = _with_parameters(prior, rows)
        shared.unpersist()
    return model


def _thresholds(asked: DataFrame, model: ToxicityModel, fewest: int) -> dict[str, float]:
    """Thresholds of the languages with enough rows of both labels in ``asked`` (words, lang, toxic)."""
    shared = asked.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("toxic"), pa.array(shared.value.score(_ids(part.column("words"))))],
                    names=["lang", "toxic", "score"],
                )

    def chosen(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        toxic = counts["toxic"].sum()
        enough = toxic >= fewest and counts["texts"].sum() - toxic >= fewest
        return pd.DataFrame({"lang": [key[0]], "threshold": [calibrated(counts) if enough else THRESHOLD], "enough": [bool(enough)]})

    odds = F.log("score") - F.log(1 - F.col("score"))
    counts = (
        asked.where("lang IS NOT NULL").mapInArrow(scored, "lang string, toxic bigint, score double")
        .groupBy("lang", F.floor(odds * SCORE_PARTS).alias("part"))
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("toxic").alias("toxic"), F.min("score").alias("low"), F.max("score").alias("high"))
    )
    # A language has a bounded number of parts, however many rows.
    found = counts.groupBy("lang").applyInPandas(chosen, "lang string, threshold double, enough boolean").where("enough")
    return {r.lang: r.threshold for r in found.orderBy("lang").collect()}


def train(docs: DataFrame, labels: DataFrame, fewest: int = 20) -> ToxicityModel:
    """A model from all labelled rows of ``docs``.

    Rows whose crc32 of the id is 2 modulo 4 are held out altogether. Three quarters of
    the others train the classifier; the last quarter sets the thresholds of the languages
    with at least ``fewest`` texts of either label there, others keep THRESHOLD. NULL labels do
    not count; of several labels of one document the highest does.
    """
    def seen(rows: DataFrame) -> DataFrame:
        return rows.where("doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)

    known = seen(labels.where("toxic IS NOT NULL")).groupBy("doc_id").agg(F.max("toxic").cast("bigint").alias("toxic"))
    few = known.count() <= BROADCAST_LABELS
    coded = keep(
        seen(docs.select("doc_id", "text", "lang")).join(F.broadcast(known) if few else known, "doc_id")
        .select("doc_id", "lang", "toxic", "text")
        .mapInArrow(_coded, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, toxic bigint, words binary")
    )
    # Rows stay where they are: whole partitions make a task, which goes over them in the order of a hash.
    tasks = max(1, min(-(-coded.count() // TASK_ROWS), coded.rdd.getNumPartitions()))
    rows = coded.coalesce(tasks).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "words").mapInArrow(
        _parted, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*coded.schema, T.StructField("last", T.BooleanType())])
    ).select("lang", "toxic", "words", "last")
    training = rows.where("NOT last")
    found = training.agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("prior")).first()
    prior = float(found.prior or 0.0)
    # With one kind of label only, a constant score.
    model = _trained(training, prior, found.n, tasks) if 0 < prior < 1 else ToxicityModel(prior=prior)
    model.thresholds = _thresholds(rows.where("last"), model, fewest)
    return model


def scorer(docs: DataFrame, model: ToxicityModel) -> Column:
    """Score of the column ``text`` as a vectorised UDF; the model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = WordIds()
        for texts in batches:
            found = []
            for begin in range(0, len(texts), 256):
                found.append(shared.value.score([ids.of(t) for t in texts.iloc[begin:begin + 256]]))
            yield pd.Series(np.concatenate(found) if found else np.empty(0))

    return score(F.coalesce("text", F.lit("")))


def _limit(model: ToxicityModel) -> Column:
    """The threshold of the row's language."""
    limits = F.lit(THRESHOLD)
    for lang, threshold in model.thresholds.items():
        limits = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(threshold)).otherwise(limits)
    return limits


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, rejected) for every row of ``docs``.

    ``predicted`` is by the fixed threshold, ``rejected`` by the calibrated one of the row's language, which decides in
    ``without_toxic``. NULL and empty texts get the score of a text without words; without two kinds of
    labels every score is the share of toxic labels (0 without labels). Texts are whole, a span of words at a time.
    Repeated rows are scored one by one, an empty table gives no rows, other columns are ignored.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", scorer(docs, model).alias("score"), _limit(model).alias("threshold"))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` below the threshold of their language, columns unchanged.

    Rows are judged one by one, as in ``toxicity_scores``; an empty table gives no rows.
    """
    model = train(docs, labels)
    marked = docs.select(F.struct("*").alias("row"), scorer(docs, model).alias("score"), _limit(model).alias("most"))
    return marked.where("score < most").select("row.*")
