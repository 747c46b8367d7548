"""Connected components against a walk over the graph, on both ways of joining."""

import random

import pytest

from marlstone.llm import components


@pytest.mark.parametrize("small", [0, 200_000])
def test_components_of_a_graph_with_a_hub(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL_ROWS", small)
    rng = random.Random(small)
    edges = [(7, k) for k in range(100, 160)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)] + [(k, k + 1) for k in range(600, 640)] + [(1, 1)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = start
                todo += near[n]
    d = spark.createDataFrame(edges, "u long, v long")
    assert {r["node"]: r["component"] for r in components.connected(d).collect()} == want
    keys = spark.createDataFrame([(k % 3, k) for k in range(50)] + [(9, 1)], "key long, node long")
    assert {(r["u"], r["v"]) for r in components.star_edges(keys).collect()} == {(k % 3, k) for k in range(3, 50)}
