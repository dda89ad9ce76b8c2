"""All three ways find what a full comparison finds."""

from __future__ import annotations

import numpy as np
import pytest

from dqspark.operators.similarity import best_match, unit_rows


def vectors(seed, n, centres=12, spread=0.15, hot=0.0):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(0).normal(size=(centres, 16))
    label = rng.integers(0, centres, n)
    label[rng.random(n) < hot] = 0
    return middle[label] + rng.normal(size=(n, 16)) * spread * np.linalg.norm(middle[label], axis=1, keepdims=True) / 4


def brute(q, e, threshold, skip):
    like = unit_rows(q) @ unit_rows(e).T
    found = {}
    for i, row in enumerate(like):
        if skip:
            row = row.copy()
            row[i] = -1
        j = int(row.argmax())
        if row[j] >= threshold:
            found[i] = (j, round(float(row[j]), 9))
    return found


@pytest.mark.parametrize("threshold", [0.92, 0.98, 0.3])
@pytest.mark.parametrize("way", ["few entries", "few queries", "cells"])
@pytest.mark.parametrize("skip", [False, True])
def test_exact(spark, way, threshold, skip):
    e = vectors(1, 300, hot=0.4)
    q = e if skip else vectors(2, 120, hot=0.4)
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "e bigint, v array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q bigint, v array<double>")
    small = {"few entries": 1000, "few queries": len(q) if not skip else 299, "cells": 10}[way]
    if way == "few queries" and skip:
        queries, q = queries.where("q < 50"), q[:50]
    got = best_match(
        queries, entries, "q", "e", "v", "v", threshold, skip_same_key=skip, small_side=small, pivots=20, cell_rows=25
    )
    assert {r["q"]: (r["e"], round(r["similarity"], 9)) for r in got.collect()} == brute(q, e, threshold, skip)


def test_cells_visit_few_pairs(spark):
    """At 0.98 a query visits few of the twenty cells."""
    e = vectors(3, 400, spread=0.05)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "k bigint, v array<double>")
    got = best_match(df, df, "k", "k", "v", "v", 0.98, skip_same_key=True, small_side=10, pivots=20)
    assert got.columns == ["k", "similar_k", "similarity"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert got.count() == len(brute(e, e, 0.98, True))


def test_zero_and_missing_vectors(spark):
    e = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "e int, v array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "q int, v array<double>")
    for small in (10, 1, 0):
        got = best_match(q, e, "q", "e", "v", "v", small_side=small).collect()
        assert [tuple(r) for r in got] == [(1, 3, 1.0)]


def test_repeated_query_keys(spark):
    """One row per key, the same whichever side is small."""
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "e int, v array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (1, [0.0, 3.0]), (2, [1.0, 0.0])], "q int, v array<double>")
    for small in (10, 1, 0):
        got = best_match(q, e, "q", "e", "v", "v", small_side=small).collect()
        assert sorted((r["q"], r["e"]) for r in got) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("threshold", [0.92, 0.6, 0.2])
@pytest.mark.parametrize("skip", [False, True])
def test_blocks_of_evenly_spread_vectors(spark, threshold, skip):
    """Vectors in all directions, some of them near others; copies, zero vectors and repeated keys among them."""
    rng = np.random.default_rng(7)
    e = rng.normal(size=(400, 32))
    q = e if skip else np.concatenate([e[:80] + 0.1 * rng.normal(size=(80, 32)), rng.normal(size=(120, 32)), np.zeros((3, 32))])
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "e bigint, v array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q bigint, v array<double>")
    got = best_match(queries, entries, "q", "e", "v", "v", threshold, skip, small_side=0, pivots=16, block_bytes=100 * 32 * 8)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "block_q" in plan and "cell" not in plan
    assert {r["q"]: (r["e"], round(r["similarity"], 9)) for r in got.collect()} == brute(q, e, threshold, skip)


def test_blocks_with_lasting_ties(spark):
    e = np.repeat(np.random.default_rng(1).normal(size=(1, 8)), 50, axis=0)
    rows = spark.createDataFrame([(49 - i, v.tolist()) for i, v in enumerate(e)], "k bigint, v array<double>")
    from dqspark.operators.similarity import _by_blocks, principal

    q, x = rows.selectExpr("k AS q", "v"), rows.selectExpr("k AS e", "v")
    parts = _by_blocks(q, x, "q bigint, e bigint, s double", 0.9, False, principal(unit_rows(e), 0.9), 3, 1)
    assert {(r["q"], r["e"]) for r in parts.collect()} == {(i, 0) for i in range(50)}


def test_first_coordinates_decide_most_pairs():
    """At 0.92 evenly spread vectors are told apart by a part of their coordinates."""
    from dqspark.operators.similarity import bounded_best, principal

    units = unit_rows(np.random.default_rng(3).normal(size=(1500, 64)))
    directions = principal(units, 0.92)
    assert directions.shape[1] < 32
    found, evaluated = bounded_best(np.arange(1500), units, np.arange(1500), units, 0.92, True, directions)
    assert not len(found) and evaluated < 0.01 * 1500**2


@pytest.mark.parametrize("threshold", [0.92, 0.35])
@pytest.mark.parametrize("skip", [False, True])
@pytest.mark.parametrize("key", ["bigint", "string"])
def test_pairs_of_many_blocks(spark, threshold, skip, key):
    """Many blocks are stored once and none is copied; copies, ties across blocks, zero vectors and missing ones among them."""
    rng = np.random.default_rng(11)
    e = rng.normal(size=(500, 32))
    e[300:320] = e[:20]
    e[77] = 0
    q = e if skip else np.concatenate([e[:90] + 0.1 * rng.normal(size=(90, 32)), rng.normal(size=(110, 32)), e[:20], np.zeros((3, 32))])
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "e bigint, v array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q bigint, v array<double>")
    more = spark.createDataFrame([(None, [1.0] * 32), (1000, None)], "k bigint, v array<double>")
    entries, queries = entries.union(more), queries.union(more)
    if key == "string":
        entries, queries = entries.selectExpr("lpad(e, 4, '0') AS e", "v"), queries.selectExpr("lpad(q, 4, '0') AS q", "v")
    got = best_match(queries, entries, "q", "e", "v", "v", threshold, skip, small_side=0, pivots=64, block_bytes=30 * 32 * 8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "block_q" in plan and "Generate" not in plan and "cell" not in plan
    assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()
    found = {int(r["q"]): (int(r["e"]), round(r["similarity"], 9)) for r in got.collect()}
    want = {k: v for k, v in brute(q, e, threshold, skip).items() if v[1] > 0}
    assert found.keys() == want.keys() and all(abs(found[k][1] - want[k][1]) < 2e-9 for k in want)
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()}


def test_copies_for_cells_leave_a_batch_by_parts(spark, monkeypatch):
    """Vectors in all directions visit every cell: the copies of a batch are not made at once."""
    import pandas as pd

    from dqspark.operators import similarity

    e = np.random.default_rng(2).normal(size=(1000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "k bigint, v array<double>")
    steps, real = [], type(rows).mapInPandas
    monkeypatch.setattr(type(rows), "mapInPandas", lambda df, f, kind: steps.append((f, kind)) or real(df, f, kind))
    monkeypatch.setattr(similarity, "_parts", lambda cells, cell_rows: [1])
    similarity._by_cells(rows.selectExpr("k AS q", "v"), rows.selectExpr("k AS e", "v"), "q bigint, e bigint, s double", 0.35, False, 64, 20_000)
    visit = next(f for f, kind in steps if " q " in kind)
    batch = pd.DataFrame({"q": np.arange(1000), "v": list(e)})
    sizes = [len(part) for part in visit(iter([batch]))]
    assert sum(sizes) > 2 * similarity.COPIED_ROWS and max(sizes) <= similarity.COPIED_ROWS


def test_sides_that_visit_most_cells_are_not_copied(spark):
    """More blocks than cells: the queries still are not sent to every cell."""
    e = np.random.default_rng(5).normal(size=(400, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "k bigint, v array<double>")
    got = best_match(rows, rows, "k", "k", "v", "v", 0.35, True, small_side=0, pivots=20, block_bytes=4 * 16 * 8)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "block_q" in plan and "cell" not in plan
    assert {r["k"]: (r["similar_k"], round(r["similarity"], 9)) for r in got.collect()} == brute(e, e, 0.35, True)
