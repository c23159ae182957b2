from __future__ import annotations

import numpy as np
import pytest

from stripmill.operators import partition as P


@pytest.mark.parametrize("tile,across", [(1, 1), (2, 3), (5, 2), (32, 4096)])
def test_neighbours_across_borders_of_tiles(spark, monkeypatch, tile, across):
    monkeypatch.setattr(P, "TILE", tile)
    monkeypatch.setattr(P, "ACROSS", across)
    rng = np.random.default_rng(tile)
    a = np.where(rng.random((23, 17)) < 0.35, rng.integers(1, 9, (23, 17)), 0).astype(float)
    a[7] = rng.integers(1, 9, 17)
    a[11] = 0
    df = spark.createDataFrame([(int(k), int(p), float(a[k, p])) for k, p in zip(*np.nonzero(a))], "k long, p long, v double")
    got = {r.k: tuple(r[1:]) for r in P.neighbours(df).collect()}
    for k in range(23):
        if a[k].any():
            b = a[k + 1] if k < 22 else np.zeros(17)
            assert got.pop(k) == (np.count_nonzero(a[k]), a[k] @ b, a[k, 1:] @ b[:-1], a[k, :-1] @ b[1:])
    assert not got


def test_entries_are_shuffled_once(spark):
    df = spark.range(1000).selectExpr("id % 40 as k", "id as p", "1.0D as v")
    plan = P.neighbours(df)._jdf.queryExecution().executedPlan().toString()
    # the entries by tile, then partial sums by slice
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_tiles_are_dealt_to_more_tasks_where_there_are_more_entries(spark, monkeypatch):
    from stripmill.operators import running

    monkeypatch.setattr(running, "TASK_ROWS", 100)
    entries = spark.range(2000).selectExpr("id div 4 AS k", "id % 4 AS p", "1D AS v")
    found = P.neighbours(entries)
    assert "Repartition" in (plan := found._jdf.queryExecution().logical().toString()) and ", 20" in plan
    assert {(r.n, r.d0, r.df, r.db) for r in found.where("k < 499").collect()} == {(4, 4.0, 3.0, 3.0)}


def test_entries_are_not_written_where_their_tasks_are_known(spark, monkeypatch):
    from stripmill.operators.coo import Matrix

    matrix = Matrix(spark.range(300).selectExpr("id div 5 AS i", "(id * 7) % 23 AS j", "1D AS v"), 60, 23)
    want = [sorted(map(tuple, s.collect())) for s in P.partitioned(matrix, 0.5)]

    def fail(df):
        raise AssertionError("written")

    monkeypatch.setattr(P, "kept", fail)
    assert [sorted(map(tuple, s.collect())) for s in P.partitioned(matrix, 0.5, parts=3)] == want
