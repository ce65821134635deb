"""The same results in plain Python, without any of the methods, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


class Sets:
    """Union-find over any keys."""

    def __init__(self):
        self.above = {}

    def find(self, x):
        while self.above.setdefault(x, x) != x:
            x = self.above[x]
        return x

    def join(self, a, b):
        self.above[self.find(a)] = self.find(b)

    def classes(self) -> dict:
        found = defaultdict(list)
        for x in list(self.above):
            found[self.find(x)].append(x)
        return found


def similar(a: set, b: set, percent: int = 75) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def cut_repeats(docs: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple]:
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256)."""
    coded = sorted((i, (t or "").encode()) for i, t in docs)
    first: dict[bytes, int] = {}
    for i, data in coded:
        for at in range(len(data) - window + 1):
            first.setdefault(data[at:at + window], i)
    found = {}
    for i, data in coded:
        gone = bytearray(len(data))
        for at in range(len(data) - window + 1):
            if first[data[at:at + window]] < i:
                gone[at:at + window] = b"\x01" * window
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        found[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return found


def line_classes(docs: list[tuple[int, str | None]], shortest: int = 40, size: int = 8) -> dict:
    """(doc_id, line_no): (first_doc_id, first_line_no)."""
    lines = {}
    for i, text in sorted(docs):
        if text is not None:
            for number, line in enumerate(text.split("\n")):
                lines[(i, number)] = re.sub(r"[\x09-\x0d]", " ", line).strip(" ")
    sets = Sets()
    grams = {}
    for at, line in lines.items():
        sets.find(at)
        if len(line) >= shortest:
            grams[at] = {line[k:k + size] for k in range(len(line) - size + 1)}
    seen = list(grams)
    for k, a in enumerate(seen):
        for b in seen[:k]:
            if similar(grams[a], grams[b]):
                sets.join(a, b)
    return {at: min(members) for members in sets.classes().values() for at in members}


def near_components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id)."""
    shingles = {}
    for i, text in docs:
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        shingles[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = Sets()
    seen = sorted(shingles)
    for k, a in enumerate(seen):
        sets.find(a)
        for b in seen[:k]:
            if shingles[a] and shingles[b] and similar(shingles[a], shingles[b]):
                sets.join(a, b)
    return {
        i: (len(shingles[i]), min(members)) for members in sets.classes().values() for i in members
    }


def cut_windows(docs: list[tuple[int, str | None]], window: int = 20) -> dict[int, tuple]:
    """doc_id: (n_words, n_removed, kept_sha256, n_spans)."""
    texts = sorted((i, words(t)) for i, t in docs)
    first: dict[tuple, tuple] = {}
    for i, w in texts:
        for at in range(len(w) - window + 1):
            first.setdefault(tuple(w[at:at + window]), (i, at))
    found = {}
    for i, w in texts:
        gone = bytearray(len(w))
        for at in range(len(w) - window + 1):
            if first[tuple(w[at:at + window])] < (i, at):
                gone[at:at + window] = b"\x01" * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        found[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), spans)
    return found
