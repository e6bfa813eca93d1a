"""Connected components against union-find, with and without the spread join."""

import random

import pytest

from admitflow.plans.components import connected_components


@pytest.mark.parametrize("plain", [0])
def test_components(spark, plain):
    draw = random.Random(7)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(9)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(45)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["root"] for r in connected_components(frame, plain=plain).collect()}
    assert got == {n: find(n) for n in list(root)}
    assert connected_components(frame.limit(0)).count() == 0
