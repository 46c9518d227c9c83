import random

import pytest

from larkspur.llm import links
from larkspur.llm.links import connected_components


def least_reachable(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def some_edges():
    rnd = random.Random(4)
    path = [(i + 1000, i + 1001) for i in range(120)]
    return rnd.sample(path, len(path)) + [(-5, 7), (-5, 9), (9, 8)] + [(rnd.randint(0, 80) * 7919, rnd.randint(0, 80) * 7919 + 1) for _ in range(70)]


def test_few_edges_need_no_rounds(spark, monkeypatch):
    """Edges that one task may hold are joined there; no round of exchanges is spent on them."""
    monkeypatch.setattr(links, "_are_stars", lambda e: pytest.fail("a round was begun"))
    edges = some_edges()
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    assert dict(map(tuple, got.collect())) == least_reachable(edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(links, "ALONE", 10, raising=False)
    edges = some_edges()
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    assert dict(map(tuple, got.collect())) == least_reachable(edges)
