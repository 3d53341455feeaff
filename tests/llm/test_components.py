import random

import pytest

from shelfmark.llm import components


def brute(pairs):
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            group[max(x, y)] = min(x, y)
    return sorted((x, root(x)) for x in group)


def shuffled(pairs, seed):
    nodes = sorted({x for p in pairs for x in p})
    names = random.Random(seed).sample(range(-(1 << 61), 1 << 61), len(nodes))
    name = dict(zip(nodes, names, strict=True))
    return [(name[a], name[b]) for a, b in pairs]


PATH = [(i, i + 1) for i in range(1999)]
RING = [((s, 0), ((s + 1) % 400, 0)) for s in range(400)] + [((s, 0), (s, leaf)) for s in range(400) for leaf in range(1, 5)]
GRAPHS = {
    "path": shuffled(PATH, 1),
    "path in order": PATH,
    "ring of stars": shuffled(RING, 2),
    "ring of stars in order": [(5 * a[0] + a[1], 5 * b[0] + b[1]) for a, b in RING],
    "large hub": [(10_000, i) for i in range(500)] + [(20_000, i) for i in range(500, 900)] + [(10_000, 20_000)],
    "odd ones": [(1, 1), (2, None), (None, 3), (5, 4), (4, 5), (5, 4), (-7, 4), (8, 9), (9, 10)],
    "nothing": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, monkeypatch, name):
    rounds, hops = [], components._hops
    monkeypatch.setattr(components, "_hops", lambda *args: rounds.append(1) or hops(*args))
    got = components.connected(spark.createDataFrame(GRAPHS[name], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == brute(GRAPHS[name])
    assert len(rounds) <= 22  # 2 log2 of 2,000


@pytest.mark.parametrize("at_once", [0, 100])
@pytest.mark.parametrize("name", GRAPHS)
def test_components_in_rounds(spark, monkeypatch, name, at_once):
    monkeypatch.setattr(components, "EDGES_AT_ONCE", at_once)
    test_components(spark, monkeypatch, name)


def test_few_edges_take_no_round(spark, monkeypatch):
    monkeypatch.setattr(components, "_hops", None)
    assert sorted(map(tuple, components.connected(spark.createDataFrame(PATH, "a long, b long")).collect())) == brute(PATH)
