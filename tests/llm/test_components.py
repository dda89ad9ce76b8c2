"""Connected components against a plain search."""

from __future__ import annotations

import random

from dqspark.llm.components import components


def test_components(spark):
    rng = random.Random(1)
    ids = [rng.getrandbits(62) - 2**61 for _ in range(400)]
    edges = [(a, b) for a, b in zip(ids[:150], ids[1:151])]  # a long path
    edges += [(rng.choice(ids[200:]), rng.choice(ids[200:])) for _ in range(90)] + [(ids[0], ids[0]), edges[3]]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a in near if near[a] == {a}}
    assert got == {k: v for k, v in want.items() if k not in loops}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
