"""Suffix, line, exact and near dedup against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from railpulse.llm import exact_dedup, line_dedup, minhash_dedup, substring_dedup, suffix_dedup
from railpulse.llm.components import components
from railpulse.operators.durable import keep
from tests.llm import plain


def changed(text: str, places: int, seed: int) -> str:
    pick = random.Random(seed)
    words = text.split(" ")
    for at in pick.sample(range(len(words)), places):
        words[at] = "other" + str(pick.randint(0, 99))
    return " ".join(words)


def pairs_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- suffix dedup

def test_repeated_passages_are_cut_as_by_brute_force(frame, sentence):
    passage, other = sentence(20), sentence(12)
    rows = [(i, sentence(15) + passage[i:] + sentence(5) + (other if i % 3 == 0 else "")) for i in range(12)]
    rows += [(50, passage + passage), (51, "a" * 300), (52, "a" * 120), (53, passage[:50]), (54, passage.encode()[:49].decode(errors="ignore")),
             (55, "ß" * 40), (56, "ß" * 25), (57, ""), (58, None)]
    want = plain.cut_repeats(rows)
    for sizes in ({}, {"block_bytes": 600, "bucket_bytes": 900}):
        got = suffix_dedup.without_repeats(frame(rows), **sizes).collect()
        assert {r[0]: tuple(r[1:5]) for r in got} == want and len(got) == len(rows)
    assert want[53][1] == len(passage[:50].encode()) and want[54][1] == 0 and want[52][1] == 120


def test_rows_of_one_id_keep_their_text(frame, sentence):
    text = sentence(30)
    got = suffix_dedup.without_repeats(frame([(1, text), (1, text), (None, text)]))
    assert pairs_of(got.where("doc_id = 1"), "n_removed") == [(0,), (0,)]
    assert got.where("doc_id IS NULL").first().n_removed == len(text.encode())


def test_loser_tree_merges_runs_with_their_common_prefixes():
    pick = random.Random(3)
    runs = [sorted(bytes(pick.choices(b"ab", k=6)) for _ in range(n)) for n in (9, 0, 4, 1, 17)]

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))

    prefixes = [[0] + [common(a, b) for a, b in zip(run, run[1:])] for run in runs]
    order, lengths = suffix_dedup.merge_runs(runs, prefixes)
    at = [0] * len(runs)
    merged = []
    for run in order:
        merged.append(runs[run][at[run]])
        at[run] += 1
    assert merged == sorted(x for run in runs for x in run)
    assert list(lengths)[1:] == [common(a, b) for a, b in zip(merged, merged[1:])]


# --- line dedup

def test_similar_lines_are_classed_as_by_brute_force(frame, sentence):
    lines = [sentence(14) for _ in range(6)]
    near = [changed(line, 1, k) for k, line in enumerate(lines)]
    chain = [lines[0]]
    for k in range(4):
        chain.append(changed(chain[-1], 1, 40 + k))
    rows = [(i, "\n".join([lines[i], sentence(14), "short line", " " + lines[0] + "\t"])) for i in range(6)]
    rows += [(10 + i, "\n".join([near[i], "short line", lines[(i + 1) % 6]])) for i in range(6)]
    rows += [(30, "\n".join(chain)), (31, "x" * 200 + "\n" + "x" * 100), (32, ""), (33, None)]
    want = plain.line_classes(rows)
    got = line_dedup.line_classes(frame(rows)).collect()
    assert {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in got} == want
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.first_doc_id, r.first_line_no)) for r in got)
    left = {r.doc_id: r for r in line_dedup.dedup_lines(frame(rows)).collect()}
    for doc_id, text in rows:
        if text is not None:
            kept = [x for n, x in enumerate(text.split("\n")) if want[(doc_id, n)] == (doc_id, n)]
            assert left[doc_id].text == "\n".join(kept) and left[doc_id].n_chars == len(left[doc_id].text)
    assert left[33].text is None and left[10].text == "short line"


def test_a_line_of_very_many_rows_stays_once(spark, frame, sentence):
    line = sentence(12)
    got = line_dedup.dedup_lines(frame([(i, f"{line}\nown {i}") for i in range(500)]))
    assert got.where(got.text.contains(line)).count() == 1 and got.count() == 500


# --- exact dedup

def test_equal_texts_are_grouped_as_by_brute_force(frame, sentence):
    long = sentence(30_000)
    rows = [(1, "a b c"), (2, "abc"), (3, "a  b\tc"), (4, "abd"), (5, ""), (6, None), (7, "\n"),
            (8, long), (9, long.replace(" ", "\n")), (10, long + "x"), (11, "a b c "), (12, " a b c")]
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id))
    want = {
        doc_id: (min(members)[1], len(members), hashlib.sha256(body.encode()).hexdigest())
        for body, members in groups.items() for _, doc_id in members
    }
    got = exact_dedup.exact_groups(frame(rows)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got) and len(got) == len(rows)


def test_chunk_hashes_combine(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(200_001), np.uint8)
    for (prime, base), got in zip(exact_dedup.FIELDS, exact_dedup.fingerprint(data)):
        whole = 0
        for byte in data.tolist():
            whole = (whole * base + byte) % prime
        assert got == whole


def test_texts_of_one_fingerprint_are_told_apart(spark, frame, monkeypatch):
    real = exact_dedup.with_fingerprints

    def colliding(docs):
        return real(docs).selectExpr(
            "doc_id", "n_points", "body", "text_sha256", "n_bytes", "0L AS print_a", "0L AS print_b"
        )

    monkeypatch.setattr(exact_dedup, "with_fingerprints", colliding)
    got = exact_dedup.exact_groups(frame([(1, "abc"), (2, "abd"), (3, "a bd"), (4, "abe"), (5, "abc")]))
    assert pairs_of(got, "doc_id", "keep_id", "group_size") == [(1, 1, 2), (2, 3, 2), (3, 3, 2), (4, 4, 1), (5, 1, 2)]


# --- near dedup

def test_near_copies_are_linked_as_by_brute_force(frame, sentence):
    rows = []
    for k in range(12):
        base = sentence(60 + 10 * k)
        rows += [(10 * k + n, changed(base, n, 7 * k + n)) for n in range(4)]
    chain = sentence(80)
    for n in range(6):
        rows.append((300 + n, chain))
        chain = changed(chain, 1, 900 + n)
    rows += [(400, "One two"), (401, "one TWO"), (402, "one two three"), (403, ""), (404, None), (405, "É a b c d"), (406, "é a b c d")]
    want = plain.near_components(rows)
    got = minhash_dedup.near_components(frame(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = minhash_dedup.without_near_copies(frame(rows))
    assert pairs_of(left, "doc_id") == sorted({(c,) for _, c in want.values()})


def test_stars_take_no_further_rounds(spark, monkeypatch):
    kept = []
    monkeypatch.setattr("railpulse.llm.components.keep", lambda df: kept.append(1) or keep(df))
    links = spark.createDataFrame([(9, 1), (1, 8), (7, 1), (5, 4), (4, 5), (3, 3), (None, 2)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {1: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4}
    assert len(kept) == 1
    kept.clear()
    chain = spark.createDataFrame([(3, 2), (2, 1)], "a bigint, b bigint")
    assert {r.node: r.component for r in components(chain).collect()} == {1: 1, 2: 1, 3: 1}
    assert len(kept) == 3


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (91, 91), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 91: 90}


# --- odd tables

OPERATORS = {
    "suffix": suffix_dedup.without_repeats, "exact": exact_dedup.exact_groups,
    "near": minhash_dedup.near_components, "lines": line_dedup.dedup_lines,
    "windows": substring_dedup.cut_repeats,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(frame, odd_rows, name):
    got = OPERATORS[name](frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows)
    assert OPERATORS[name](frame([])).collect() == []
    if name == "lines":
        assert next(r for r in got if r.doc_id == 4).text == "" and got[0].gone == "gone"


# --- recall of line dedup

def _shingles(line):
    return {line[i:i + 8] for i in range(len(line) - 7)}


def _similar_pairs(kind, pick):
    """Two lines of 40 characters or more whose similarity is 0.75 or more."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word(low, high):
        return "".join(pick.choices(letters, k=pick.randint(low, high)))

    def other(letter):
        return pick.choice(letters.replace(letter, ""))

    while True:
        if kind == "two long words":
            line = f"{word(21, 24)} {word(21, 24)}"
            near = other(line[0]) + line[1:]
        elif kind == "three words":
            line = " ".join(word(14, 16) for _ in range(3))
            near = line[:-1] + other(line[-1])
        elif kind == "short words at the end":
            line = " ".join([word(4, 9) for _ in range(7)] + [word(1, 1) for _ in range(4)])
            near = line[:-1] + other(line[-1])
        elif kind == "two letters":
            line = " ".join(word(10, 14) for _ in range(5))
            near = other(line[0]) + line[1:-1] + other(line[-1])
        elif kind == "a word replaced":
            words = [word(2, 9) for _ in range(pick.randint(20, 60))]
            line = " ".join(words)
            words[pick.randrange(len(words))] = word(2, 9)
            near = " ".join(words)
        else:
            line = word(44, 44)
            near = line[:-1] + other(line[-1])
        if len(line) >= 40 and len(near) >= 40 and plain.similar(_shingles(line), _shingles(near)):
            return line, near


KINDS = ("two long words", "three words", "short words at the end", "two letters", "a word replaced", "one token")


def test_similar_lines_meet_in_a_band(spark):
    n, rows = 600, []
    for kind in KINDS:
        pick = random.Random(kind)
        rows += [(f"{kind} {k}", line) for k in range(n) for line in _similar_pairs(kind, pick)]
    lines = spark.createDataFrame(rows, "pair string, line string").selectExpr("pair", "line", "xxhash64(line) AS h")
    keys = line_dedup.band_keys(line_dedup.signatures(lines.select("h", "line"))).select("h", "key")
    met = lines.join(keys, "h").groupBy("pair", "key").agg(F.count_distinct("h").alias("lines")).where("lines = 2")
    found = {}
    for row in met.select("pair").distinct().collect():
        kind = row.pair.rsplit(" ", 1)[0]
        found[kind] = found.get(kind, 0) + 1
    assert {kind: found.get(kind, 0) >= 0.99 * n for kind in KINDS} == dict.fromkeys(KINDS, True), found


def test_signatures_of_one_shingle_in_eight(spark, sentence):
    """They are the minima of one in four, since negative numbers are less; lines without a shingle to sign are alike."""
    texts = [sentence(n) for n in (40, 60, 200)]
    plain_lines = [chr(97 + i) * 200 for i in range(26)]
    lines = spark.createDataFrame([(x,) for x in texts + plain_lines], "line string").selectExpr("xxhash64(line) AS h", "line")
    signed = {r.h: r for r in line_dedup.signatures(lines).where(F.col("mask") != 0).collect()}
    each = lines.select("h", F.explode(F.sequence(F.lit(1), F.length("line") - 7)).alias("at"), "line").select(
        "h", F.hash(F.encode(F.substring("line", F.col("at"), F.lit(8)), "UTF-32")).alias("shingle")
    )
    found = {}
    for r in each.collect():
        found.setdefault(r.h, set()).add(r.shingle)
    seeds, alike = line_dedup._seeds(1, line_dedup.BANDS * line_dedup.ROWS), set()
    for h, shingles in found.items():
        got = tuple(signed[h][f"m{i}"] for i in range(len(seeds)))
        quarter = {x for x in shingles if x & 3 == 0}
        if any(x < 0 for x in quarter):
            assert got == tuple(min(x ^ seed for x in quarter) for seed in seeds)
        else:
            alike.add(got)
    assert len(alike) == 1 and None not in alike.pop()
    assert all(r.n == 1 for r in signed.values()) and len(signed) == len(texts + plain_lines)


def test_shingles_are_of_characters(spark):
    lines = ["ä" * 50, "日本" * 30, "x" * 45 + "\U0001F600", "plain ascii of more than forty characters"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.size(line_dedup.shingle_set(F.col("line"))).alias("n"))
    assert {r.line: r.n for r in df.collect()} == {x: len(_shingles(x)) for x in lines}


def test_few_lines_of_a_large_group_are_measured(spark, vocabulary, monkeypatch):
    """Variants of one text, with three words replaced in each: below the limit to one another, but not far."""
    pick = random.Random(8)
    base = pick.choices(vocabulary, k=60)
    lines = []
    for _ in range(80):
        words = list(base)
        for at in pick.sample(range(60), 3):
            words[at] = "".join(pick.choices("0123456789", k=6))
        lines.append(" ".join(words))
    sets = [_shingles(x) for x in lines]
    close = [(i, j) for i in range(80) for j in range(i) if plain.similar(sets[i], sets[j])]
    measured, real = [], line_dedup._measured

    def counted(pairs, texts):
        measured.append(pairs.count())
        return real(pairs, texts)

    monkeypatch.setattr(line_dedup, "_measured", counted)
    table = spark.createDataFrame(list(enumerate(lines)), "i int, line string").selectExpr("i", "xxhash64(line) AS h", "line")
    found = {r.h: r.component for r in line_dedup.line_components(table.select("h", "line")).collect()}
    part = {r.i: found.get(r.h, r.h) for r in table.collect()}
    assert all(part[i] == part[j] for i, j in close)
    assert len(set(part.values())) >= 80 - len(close)
    assert sum(measured) <= 80 * 79 / 2 / 3, (measured, len(close))


def test_sketches_never_part_similar_lines(spark, vocabulary):
    """Pairs of any length whose similarity is at the limit or above; most of those well below it go."""
    pick = random.Random(21)
    rows = []
    for k in range(240):
        size = pick.choice([12, 60, 150, 700, 2500])
        words = pick.choices(vocabulary, k=size)
        other = list(words)
        for _ in range(max(1, int(size * pick.choice([0.02, 0.06, 0.08, 0.3])))):
            other[pick.randrange(size)] = pick.choice(vocabulary)
        rows.append((k, " ".join(words), " ".join(other)))
    pairs = spark.createDataFrame(rows, "k int, x string, y string").selectExpr("k", "xxhash64(x) AS x", "xxhash64(y) AS y")
    lines = spark.createDataFrame([(x,) for r in rows for x in r[1:]], "line string").distinct()
    sketches = line_dedup._sketches(lines.selectExpr("xxhash64(line) AS h", "line")).cache()
    both = pairs.join(sketches.alias("a"), F.col("x") == F.col("a.h")).join(sketches.alias("b"), F.col("y") == F.col("b.h"))
    passed = {r.k for r in both.where(line_dedup._may_link()).select("k").collect()}
    far = 0
    for k, x, y in rows:
        a, b = _shingles(x), _shingles(y)
        if plain.similar(a, b):
            assert k in passed
        elif len(a & b) < 0.4 * len(a | b):
            far += 1
            assert k not in passed, (len(x), len(a & b) / len(a | b))
    assert far > 10


def test_no_text_is_lost_under_one_id(frame, sentence):
    x, y, z = (sentence(12) for _ in range(3))
    rows = [(0, x), (1, f"{x}\nq"), (1, f"{y}\nq"), (None, f"{y}!\nq"), (None, f"{z}\nq"), (None, None)]
    left = sorted(r.text or "-" for r in line_dedup.dedup_lines(frame(rows)).collect())
    assert left == sorted([x, "q", f"{y}\nq", "q", f"{z}\nq", "-"])


def test_no_row_is_lost_under_one_id(frame, sentence):
    a, b, c = sentence(40), sentence(40), sentence(40)
    rows = [(1, a), (5, a), (5, b), (None, b), (None, c), (None, c), (7, ""), (7, ""), (8, None)]
    left = minhash_dedup.without_near_copies(frame(rows)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in left) == sorted(
        [("1", a), ("5", b), ("None", c), ("7", ""), ("7", ""), ("8", "")]
    )
    assert left[0].gone == "gone"


def test_rows_of_one_id_are_one_document(frame, sentence):
    a, b = sentence(40), sentence(40)
    rows = [(1, a), (5, a), (5, b), (9, b), (None, a), (3, "")]
    got = minhash_dedup.near_components(frame(rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [
        ("1", "1"), ("3", "3"), ("5", "1"), ("5", "1"), ("9", "1"), ("None", "None")]


def test_links_between_blocks_of_a_large_group(spark, frame, vocabulary, monkeypatch):
    """A third of all texts are around one pivot, some only linked with each other: found in blocks of sixteen."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    pick = random.Random(2)
    base = pick.choices(vocabulary, k=60)
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(pick.randint(0, 3)):
            words[pick.randrange(60)] = pick.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(pick.choices(vocabulary, k=50))) for i in range(240)]
    want = plain.near_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_components(frame(rows)).collect()}
    # Links at the limit may be missed by the bands: 3 of 1000.
    assert sum(got[i] != want[i] for i in got) <= 3


# --- substring dedup

def test_repeated_windows_go_as_by_brute_force(frame, vocabulary):
    pick = random.Random(13)
    shared = [pick.choices(vocabulary, k=n) for n in (20, 21, 35, 60, 150)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(pick.randint(0, 5)):
            words += pick.choices(vocabulary, k=pick.randint(0, 30)) + (pick.choice(shared) if pick.random() < 0.7 else [])
        rows.append((i * 3 % 61, pick.choice([" ", "\n", " \t"]).join(words)))
    rows += [(100, " ".join(shared[4] * 3)), (101, "a " * 70), (102, "a " * 45), (103, ""), (104, None), (105, " ".join(shared[0][:19]))]
    for window in (20, 6):
        want = plain.cut_windows(rows, window)
        cut = substring_dedup.cut_repeats(frame(rows), window)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.n_spans) for r in substring_dedup.digest(cut).collect()}
        assert got == want
        assert all(sum(s.n_words for s in r.spans) == r.n_removed for r in cut.collect())


def test_batches_do_not_change_the_result(frame, sentence, monkeypatch):
    line = sentence(25)
    rows = [(i, f"{sentence(5)} {line} {sentence(i % 30)}") for i in range(200)]
    want = plain.cut_windows(rows)
    monkeypatch.setattr(substring_dedup, "TEXT_BYTES", 2000)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.n_spans) for r in substring_dedup.digest(substring_dedup.cut_repeats(frame(rows))).collect()}
    assert got == want


def test_levels_end_when_no_window_is_repeated(frame, vocabulary):
    pick = random.Random(3)
    passage = pick.choices(vocabulary, k=100)
    rows = [(i, " ".join(pick.choices(vocabulary, k=9) + passage[i:100 - i])) for i in range(3)]
    found = {}
    for length, windows in substring_dedup.repeat_levels(frame(rows)):
        found[length] = {(r.doc_id, r.place) for r in windows.collect()}
    texts = {i: plain.words(t) for i, t in rows}
    for length in (20, 40, 80):
        owners = {}
        for i, words in texts.items():
            for at in range(len(words) - length + 1):
                owners.setdefault(tuple(words[at:at + length]), []).append((i, at))
        assert found[length] == {place for places in owners.values() if len({i for i, _ in places}) > 1 for place in places}
    assert set(found) == {20, 40, 80}


def test_rows_of_one_id_leave_one_another_alone(frame, sentence):
    a = sentence(30)
    cut = substring_dedup.cut_repeats(frame([(5, a), (5, f"x {a}"), (None, a), (None, f"y {a}"), (7, f"{a} {a}")]))
    assert sorted((str(r.doc_id), r.n_removed) for r in cut.collect()) == [("5", 0), ("5", 0), ("7", 60), ("None", 30), ("None", 30)]


def test_windows_have_an_even_number_of_words(frame):
    with pytest.raises(ValueError, match="even"):
        substring_dedup.shared_windows(frame([]), 7)
