"""Interval joins, products of blocks as blocks, and matrices saved for many products."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_matrix import column

from stripmill.operators import blocks as B
from stripmill.operators import coo as C
from stripmill.operators import kernel as N
from stripmill.operators import partition as P
from stripmill.operators import product as M
from stripmill.operators import saved as S
from stripmill.operators.interval import Uniform, binned, located
from stripmill.sources.scratch import kept


def randomly(spark, seed, m=60, n=50):
    """A matrix with a dense corner, a row and a column one wide, a column that holds a third of all entries, and empty rows."""
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((m, n)) < 0.05, rng.integers(1, 9, (m, n)), 0).astype(float)
    a[:20, :15] = rng.integers(0, 9, (20, 15))
    a[:, 30] = rng.integers(1, 9, m)
    a[40:45] = 0
    return a, C.from_dense(spark, a.tolist())


def vector(n, seed=1):
    return np.random.default_rng(seed).integers(1, 9, n).astype(float)


def rows_of(spark, x):
    if x.ndim == 1:
        return spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "j long, x double")
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "j long, xs array<double>")


def split(spark, matrix, edges, density):
    members = B.assigned(matrix.df, P.strips_at(spark, edges[0]), P.strips_at(spark, edges[1]))
    return members, B.densities(members, B.is_dense(density))


EDGES = [0, 1, 20, 21, 40, 45, 60], [0, 15, 16, 30, 31, 50]


@pytest.mark.parametrize("few", [0, 64])
def test_every_index_finds_its_strip(spark, few):
    rng = random.Random(few)
    edges = sorted(rng.sample(range(2, 900), 40))
    # with gaps, and one strip that is much wider than the others
    strips = [(k, lo, hi - (k % 3 == 0)) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))] + [(99, 1000, 5000)]
    points = spark.range(-5, 5100).select(F.col("id").alias("i"))
    df = spark.createDataFrame(strips, "strip long, lo long, hi long")
    got = sorted(map(tuple, located(points, "i", df, ("a", "l", "h"), few=few).collect()))
    assert got == sorted((i, *s) for i in range(-5, 5100) for s in strips if s[1] <= i < s[2])
    assert located(points, "i", df.limit(0), ("a", "l", "h"), few=few).collect() == []
    twice = binned(points, "i", spark.createDataFrame([(1, 0, 10), (2, 5, 300)], "name long, lo long, hi long"), ["name"])
    assert sorted(map(tuple, twice.where("i between 3 and 11").collect())) == sorted([(i, 1) for i in range(3, 10)] + [(i, 2) for i in range(5, 12)])
    assert column(located(points, "i", Uniform(12, 3), ("a", "l", "h")).where("i % 4 = 3"), "i", "a", "l", "h") == [(3, 0, 0, 4), (7, 1, 4, 8), (11, 2, 8, 12)]


@pytest.mark.parametrize("density", [0, 30, 100])
@pytest.mark.parametrize("cells", [1, 1 << 22])
def test_hybrid_products_equal_dense_ones(spark, monkeypatch, density, cells):
    monkeypatch.setattr(N, "CELLS", cells)
    a, matrix = randomly(spark, 3)
    members, chosen = split(spark, matrix, EDGES, density)
    x = vector(50)
    got = dict(map(tuple, B.hybrid_spmv(members, chosen, rows_of(spark, x)).collect()))
    some = np.flatnonzero(a.any(axis=1)).tolist()
    assert got == {i: (a @ x)[i] for i in some}
    wide = np.stack([vector(50, k) for k in range(70)], axis=1)
    found = np.zeros((60, 70))
    for i, k, y in B.hybrid_spmm_wide(members, chosen, rows_of(spark, wide), 70).collect():
        found[i, k] = y
    assert (found == a @ wide).all()


def test_rows_of_blocks_that_meet_nothing_have_no_result(spark):
    matrix = C.from_dense(spark, [[1, 0, 2], [0, 0, 3], [0, 0, 0], [4, 5, 6]])
    members, chosen = split(spark, matrix, ([0, 4], [0, 3]), 0)
    x = spark.createDataFrame([(0, 1.0), (1, 2.0)], "j long, x double")
    want = sorted(map(tuple, M.spmv(matrix.df, x).collect()))
    assert sorted(map(tuple, B.hybrid_spmv(members, chosen, x).collect())) == want == [(0, 1.0), (3, 14.0)]


def test_plan_of_hybrid_products_multiplies_blocks(spark):
    _, matrix = randomly(spark, 3)
    members, chosen = split(spark, matrix, EDGES, 30)
    plan = B.hybrid_spmv(members, chosen, rows_of(spark, vector(50)))._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("span,place,entries", [(1 << 20, 1 << 24, 1 << 20), (7, 40, 11), (1, 1, 1)])
def test_saved_products(spark, monkeypatch, span, place, entries):
    monkeypatch.setattr(S, "ENTRIES", entries)
    a, matrix = randomly(spark, 5)
    members, chosen = split(spark, matrix, EDGES, 30)
    with S.saving(kept(members), kept(chosen), span, place) as saved:
        for seed in range(2):
            x = vector(50, seed)
            got = dict(map(tuple, S.product(saved, rows_of(spark, x)).collect()))
            assert got == {i: (a @ x)[i] for i in np.flatnonzero(a.any(axis=1)).tolist()}
        wide = np.stack([vector(50, k) for k in range(5)], axis=1)
        got = {(i, k): y for i, k, y in S.product(saved, rows_of(spark, wide), 5).collect()}
        assert got == {(i, k): (a @ wide)[i, k] for i in np.flatnonzero(a.any(axis=1)).tolist() for k in range(5)}
        part = spark.createDataFrame([(30, 2.0)], "j long, x double")
        assert dict(map(tuple, S.product(saved, part).collect())) == {i: 2 * a[i, 30] for i in np.flatnonzero(a[:, 30]).tolist()}


def test_a_product_shuffles_nothing_of_the_matrix(spark):
    _, matrix = randomly(spark, 5)
    members, chosen = split(spark, matrix, EDGES, 30)
    with S.saving(kept(members), kept(chosen)) as saved:
        y = S.product(saved, rows_of(spark, vector(50)))
        y.collect()
        plan = y._jdf.queryExecution().executedPlan().toString()
        # an exchange for the vector's parts and one for the partial sums; the bucketed scan stands below no exchange
        above = plan[: plan.index("Bucketed: true")]
        side = above[above.rindex("FlatMapCoGroupsInArrow") :]
        assert "Exchange" not in side
    assert not spark.catalog.tableExists(saved.table)


def test_a_hot_column_is_spread_over_places(spark, monkeypatch):
    monkeypatch.setattr(S, "ENTRIES", 100)
    rng = random.Random(1)
    rows = [(i, 7, 1.0) for i in range(3000)] + [(rng.randrange(3000), rng.randrange(400), 1.0) for _ in range(6000)]
    df = spark.createDataFrame(rows, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    members = kept(B.assigned(df, Uniform(3000, 1), Uniform(400, 4)))
    chosen = kept(B.densities(members, B.is_dense(100)))
    with S.saving(members, chosen, 50, 500) as saved:
        loads = S.loads(saved).collect()
        total = df.count()
        assert sum(r.work for r in loads) == total and max(r.work for r in loads) <= 500 + 200
        assert len(loads) >= total // 500
        x = spark.range(400).select(F.col("id").alias("j"), (F.col("id") + 1.0).alias("x"))
        assert sorted(map(tuple, S.product(saved, x).collect())) == sorted(map(tuple, M.spmv(df, x).collect()))


def test_places_differ_by_a_unit_of_each_round(spark, monkeypatch):
    monkeypatch.setattr(S, "LIST", 50)
    rng = random.Random(8)
    work = [(k % 3, k, int(1000 / (1 + rng.randrange(100))) + (5000 if k == 4 else 0)) for k in range(400)]
    units = spark.createDataFrame(work, "range long, id long, work long")
    found, per = S.placed(units, ["id"], 700)
    rounds = -(-max(sum(w[0] == r for w in work) for r in range(3)) // 50)
    load = {}
    for r in found.collect():
        load.setdefault(r.range, {}).setdefault(r.place, []).append(r.work)
    assert found.count() == 400
    for r in per.collect():
        most = max(w[2] for w in work if w[0] == r.range)
        sums = [sum(x) for x in load[r.range].values()]
        assert all(r.base <= p < r.base + r.places for p in load[r.range])
        assert max(sums) <= 700 + rounds * most and len(sums) == min(r.places, sum(w[0] == r.range for w in work))


def test_chained_products(spark):
    a, matrix = randomly(spark, 11, 50, 50)
    members, chosen = split(spark, matrix, ([0, 20, 50], EDGES[1]), 30)
    x = vector(50)
    with S.saving(kept(members), kept(chosen)) as saved:
        y = S.chained(saved, rows_of(spark, x), 3, 0.5)
    # y stays when the matrix is gone
    got = dict(map(tuple, y.collect()))
    want = a @ (a @ (a @ x)) / 8
    assert got == {i: want[i] for i in got} and all(want[i] == 0 for i in range(50) if i not in got)
    assert re.fullmatch("saved_[0-9a-f]{32}", saved.table)
