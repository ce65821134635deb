"""Phrase mining against plain code, and the trie by itself."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from railpulse.llm import phrases

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, longest, frequent, top):
    """(lang, rank, phrase, a, l, r, n, score) in plain Python."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for at in range(len(words) - size + 1):
                    counts[lang][tuple(words[at:at + size])] += 1
    found = []
    for lang, f in counts.items():
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= frequent}
        ranked, longest_count = [], Counter()
        for longer, c in candidates.items():
            for size in range(2, len(longer)):
                for at in range(len(longer) - size + 1):
                    inner = longer[at:at + size]
                    longest_count[inner] = max(longest_count[inner], c)
        for phrase, a in candidates.items():
            if longest_count[phrase] >= a:
                continue
            score, k, left, right = min(
                (1000 * a * totals[lang] // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]])
                for k in range(1, len(phrase))
            )
            ranked.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], start=1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture
def corpus(vocabulary):
    pick = random.Random(21)
    few = vocabulary[:25]
    phrase = [pick.choices(vocabulary, k=n) for n in (2, 3, 4, 5, 6, 7)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(pick.randint(0, 12)):
            words += pick.choices(few, k=pick.randint(0, 4)) + pick.choice(phrase)
            words.append(pick.choice(["", ".", ", And", "; ", "\n", "!\t", "And", "É", "\x0b"]))
        rows.append((" ".join(words), pick.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), (" \t.", "fr"), ("a " * 3000, "xx"), ("A a. a", "xx"), (" ".join(few) * 400, "en")]


def test_phrases_as_by_brute_force(spark, frame, corpus):
    docs = frame([(i, text, lang, "web") for i, (text, lang) in enumerate(corpus)])
    for longest, frequent, top in ((5, 12, 2000), (5, 30, 7), (3, 2, 50), (2, 5, 3)):
        want = plain_collocations(corpus, longest, frequent, top)
        assert rows_of(phrases.collocations(docs, longest, frequent, top)) == want and want


def test_shards_and_batches_do_not_change_the_result(frame, corpus, monkeypatch):
    docs = frame([(i, text, lang, "web") for i, (text, lang) in enumerate(corpus)])
    want = plain_collocations(corpus, 4, 12, 100)
    monkeypatch.setattr(phrases, "TEXT_BYTES", 500)
    monkeypatch.setattr(phrases, "GATHERED", 20)
    monkeypatch.setattr(phrases, "MAP_BITS", 64)  # says yes nearly always: counts stay right
    assert rows_of(phrases.collocations(docs, 4, 12, 100, shard=9)) == want


def test_odd_rows_and_empty_tables(frame, odd_rows):
    assert phrases.collocations(frame([])).collect() == []
    assert phrases.collocations(frame(odd_rows), frequent=10**6).collect() == []
    found = rows_of(phrases.collocations(frame(odd_rows), frequent=2, top=5))
    assert found == plain_collocations([(r[1], r[2] if len(r) > 2 else "en") for r in odd_rows], 5, 2, 5)


def test_products_beyond_64_bits(spark):
    words = spark.createDataFrame(
        [("en", "a", 1, 3 * 10**14), ("en", "b", 2, 2 * 10**14 + 1), ("en", None, 0, 9 * 10**17)], "lang string, word string, k long, n long")
    known = spark.createDataFrame([([1], 3 * 10**14), ([2], 2 * 10**14 + 1), ([1, 2], 10**14 + 7)], "ws array<long>, n long")
    row = phrases._scored(words, known).first()
    assert row.score == 1000 * (10**14 + 7) * 9 * 10**17 // (3 * 10**14 * (2 * 10**14 + 1))


def texts(*rows):
    return pa.RecordBatch.from_pydict({"lang": ["en"] * len(rows), "text": pa.array([r.encode() for r in rows], pa.binary())})


@pytest.mark.parametrize("n", [1, 3, 60, 700])
@pytest.mark.parametrize("length", [1, 2, 4])
def test_the_trie_accepts_its_phrases_only(n, length):
    pick = np.random.default_rng(n)
    text = phrases.Text(texts(" ".join(f"w{x}" for x in pick.zipf(1.3, 3000) % 200)))
    at = pick.integers(0, len(text.hashes) - length, n)
    wanted = np.unique(np.array([text.hashes[i:i + length] for i in at]), axis=0)
    trie = phrases.Trie(wanted)
    found, state = trie.states(text, length)
    rows = {tuple(row): i for i, row in enumerate(wanted.tolist())}
    windows = [tuple(text.hashes[i:i + length].tolist()) for i in range(len(text.hashes))]
    assert dict(zip(found.tolist(), trie.number[state].tolist())) == {
        i: rows[w] for i, w in enumerate(windows) if w in rows and text.left[i] > length}


def test_a_trie_without_phrases():
    trie = phrases.Trie(np.empty((0, 2), np.uint64))
    assert len(trie.states(phrases.Text(texts("a b c")), 2)[0]) == 0


def test_pieces_end_at_marks_and_texts():
    text = phrases.Text(texts("a b, c\td", "", "e\nf"))
    assert text.left.tolist() == [2, 1, 2, 1, 1, 1]
