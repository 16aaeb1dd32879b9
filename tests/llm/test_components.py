"""Connected components against union-find, in one task and by star steps."""

import random

import pytest

pytest.importorskip("stratavault.llm.registry")
from stratavault.llm import components as steps


def links():
    """Paths, a star, a ring and pairs linked twice, in any order and direction."""
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 1500) if i % 300]
    pairs += [(2000, 2000 + i) for i in range(1, 200)] + [(3000 + i, 3000 + (i + 1) % 50) for i in range(50)]
    pairs += [(4000, 4001), (4001, 4000), (4000, 4001), (5000, 5000)]
    to = list(range(-6000, 6000))
    rng.shuffle(to)
    pairs = [(to[a], to[b]) if rng.random() < 0.5 else (to[b], to[a]) for a, b in pairs]
    rng.shuffle(pairs)
    return pairs


def want(pairs):
    above = {}

    def top(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    for a, b in pairs:
        p, q = top(a), top(b)
        above[max(p, q)] = min(p, q)
    return {x: top(x) for a, b in pairs if a != b for x in (a, b)}


@pytest.fixture
def written(monkeypatch):
    """How many tables have been written."""
    labels, write = [], steps.materialize
    monkeypatch.setattr(steps, "materialize", lambda df, label: (labels.append(label), write(df, label))[1])
    return labels


def test_few_links_take_no_rounds(spark, written):
    """Links dealt over many tasks are contracted there and then in one task."""
    pairs = links()
    rows = steps.components(spark.createDataFrame(pairs, "a long, b long").repartition(16)).collect()
    assert {r["node"]: r["component"] for r in rows} == want(pairs) and len(rows) == len(want(pairs))
    assert len(written) == 2
    assert steps.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_links_take_star_steps(spark, written, monkeypatch):
    monkeypatch.setattr(steps, "_HELD", 0)  # in this process: no set of links is small
    pairs = links()
    rows = steps.components(spark.createDataFrame(pairs, "a long, b long").repartition(16)).collect()
    assert {r["node"]: r["component"] for r in rows} == want(pairs) and len(rows) == len(want(pairs))
    assert "links-large" in written
