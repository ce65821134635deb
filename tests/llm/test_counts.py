"""Token counts against the library, best-fit packing against its rules."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from railpulse.llm import packing, token_counts
from tests.llm import plain

VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return found


def test_counts_equal_the_library(frame, sentence, library):
    pick = random.Random(9)
    special = [t["content"] for t in token_counts.json.load(open(VOCABULARY, encoding="utf-8"))["added_tokens"]]
    texts = [None, "", " ", "\n\n  \n x", "don't we'LL I'm", "1234 567", "a" * 3000, "é́ \U0001F600\U0001F468‍\U0001F469",
             "  x", sentence(9000), *["a " + s + s + " b" for s in special]]
    texts += ["".join(chr(pick.choice([pick.randint(32, 126), pick.randint(0x80, 0x2FFF), 32, 10])) for _ in range(200))
              for _ in range(60)]
    got = token_counts.token_counts(frame(list(enumerate(texts))), VOCABULARY).collect()
    for r in got:
        text = texts[r.doc_id] or ""
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), want, want > 1024)
    assert len(got) == len(texts)


def check_packing(rows, got, lengths):
    """Every word once, no bin over its length, no bin larger than needed."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        if r.bin_id is not None:
            bins[r.bin_id].append((r.bin_offset, r.length, r.bin_length))
    for doc_id, text in rows:
        at = 0
        for number, (piece, start, length) in enumerate(sorted(pieces[doc_id])):
            assert (piece, start) == (number, at)
            at += length
        assert at == len(plain.words(text))
    for members in bins.values():
        at = 0
        for offset, length, size in sorted(members):
            assert offset == at
            at += length
        assert {m[2] for m in members} == {min(x for x in lengths if x >= at)}
    return bins


def test_bins_hold_every_word_once(frame, sentence):
    pick = random.Random(4)
    rows = [(i, sentence(pick.choice([3, 40, 200, 255, 300, 700, 1500, 5000]))) for i in range(300)] + [(900, ""), (901, None)]
    for per_shard in (20_000, 50):
        got = packing.pack(frame(rows), per_shard=per_shard).collect()
        bins = check_packing(rows, got, packing.LENGTHS)
        words = sum(len(plain.words(t)) for _, t in rows)
        assert sum(m[0][2] for m in bins.values()) <= 1.1 * words
    assert {r.bin_id for r in got if r.doc_id in (900, 901)} == {None}


def test_a_piece_goes_where_it_fits_best():
    bins, offsets, lengths = packing.pack_shard([9, 7, 3, 1], (10,), lambda n: n)
    assert bins.tolist() == [0, 1, 1, 0] and offsets.tolist() == [0, 0, 7, 9] and lengths.tolist() == [10] * 4
    bins, _, lengths = packing.pack_shard([3], (4, 16))
    assert lengths.tolist() == [4]


@pytest.mark.parametrize("operator", [
    packing.pack, lambda docs: token_counts.token_counts(docs, VOCABULARY),
], ids=["packing", "tokens"])
def test_odd_rows_and_empty_tables(frame, odd_rows, operator):
    got = operator(frame(odd_rows)).collect()
    assert {str(r.doc_id) for r in got} == {str(r[0]) for r in odd_rows}
    assert len(got) >= len(odd_rows) and operator(frame([])).collect() == []
