"""Best-fit packing against a plain version that scans all bins and pieces, and against the optimum of few pieces."""

from __future__ import annotations

import random

import pytest

from railpulse.llm.packing import LENGTHS, cost_of, pack_shard


def plain_pack(sizes, lengths=LENGTHS):
    """Per bin its final length and the numbers of its pieces."""
    opened, free, inside = [], [], []
    for i, size in enumerate(sizes):
        places = [(room, b) for b, room in enumerate(free) if room >= size]
        if places:
            b = min(places)[1]
        else:
            trials = []
            for length in sorted(lengths):
                if length >= size:
                    held = size
                    for other in sizes[i + 1:]:
                        if held + other <= length:
                            held += other
                    trials.append((cost_of(min(x for x in lengths if x >= held)) / held, -length))
            b = len(opened)
            opened.append(-min(trials)[1])
            free.append(opened[b])
            inside.append([])
        free[b] -= size
        inside[b].append(i)
    return [(min(x for x in lengths if x >= sum(sizes[i] for i in bin_)), bin_) for bin_ in inside]


def packed(sizes, lengths=LENGTHS):
    bins, offsets, fitted = pack_shard(sizes, lengths)
    found = {}
    for i, (b, at, length) in enumerate(zip(bins.tolist(), offsets.tolist(), fitted.tolist())):
        before = found.setdefault(b, (length, []))
        assert before[0] == length and at == sum(sizes[k] for k in before[1])
        before[1].append(i)
    return [found[b] for b in sorted(found)]


KINDS = {
    "small": lambda p: p.randint(1, 200), "middle": lambda p: p.randint(200, 600), "near 256": lambda p: p.randint(200, 256),
    "mixed": lambda p: min(2048, int(p.lognormvariate(5.5, 1.2)) + 1), "few values": lambda p: p.choice([2048, 1500, 700, 60, 1]),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n", [0, 1, 2, 30, 400])
def test_packs_as_the_plain_version(kind, n):
    pick = random.Random(f"{kind} {n}")
    for lengths in (LENGTHS, (2048,), (64, 300, 2048)):
        sizes = sorted((KINDS[kind](pick) for _ in range(n)), reverse=True)
        assert packed(sizes, lengths) == plain_pack(sizes, lengths)


def cheapest(sizes):
    """The least cost of all ways to put the pieces into bins."""
    best = [float("inf")]

    def put(i, held):
        if i == len(sizes):
            best[0] = min(best[0], sum(cost_of(min(x for x in LENGTHS if x >= h)) for h in held))
            return
        for b in range(len(held)):
            if held[b] + sizes[i] <= LENGTHS[-1]:
                put(i + 1, [*held[:b], held[b] + sizes[i], *held[b + 1:]])
        put(i + 1, [*held, sizes[i]])

    put(0, [])
    return best[0]


def test_near_the_optimum_of_few_pieces():
    pick = random.Random(7)
    ratios = []
    for _ in range(150):
        sizes = sorted((KINDS["mixed"](pick) for _ in range(pick.randint(1, 7))), reverse=True)
        cost = sum(cost_of(length) for length, _ in packed(sizes))
        ratios.append(cost / cheapest(sizes))
    assert max(ratios) <= 1.5 and sum(ratios) / len(ratios) <= 1.05


def test_every_length_is_opened_where_it_pays():
    def lengths(sizes):
        return sorted(length for length, _ in packed(sizes))

    assert lengths([250]) == [256]
    assert lengths([250, 250]) == [512]
    assert lengths([700, 700, 600]) == [2048]
    assert lengths([2048, 1024, 512, 256]) == [256, 512, 1024, 2048]
