"""Connected components against a plain union: chains, stars, cycles, repeated edges and loops."""

import random

import pytest

import cases
from labelflow.llm.components import components


def _chain(n):
    order = list(range(n))
    random.Random(5).shuffle(order)
    return list(zip(order, order[1:]))


def _random(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("edges", [
    [], [(3, 3)], [(1, 2), (2, 1), (1, 2)], [(9, i) for i in range(9)], [(0, i) for i in range(1, 40)],
    _chain(150), _random(300, 200, 1), _random(120, 150, 2) + [(7, 7)], [(-5, 4), (4, 2 ** 62), (8, 9)]])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    real = [(a, b) for a, b in edges if a != b]
    nodes = sorted({x for e in real for x in e})
    assert sorted(r.node for r in got) == nodes            # each node once
    assert {r.node: r.label for r in got} == cases.components(nodes, real)
