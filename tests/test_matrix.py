from __future__ import annotations

import math
import random

import pytest

from stripmill.functions.similarity import best_shift, best_shift_or_zero, mean_shift
from stripmill.operators import blocks as B
from stripmill.operators import coo as C
from stripmill.operators import evaluation as E
from stripmill.operators import partition as P
from stripmill.operators import product as M
from stripmill.operators import synth as Y
from stripmill.operators.running import running_sum

# The example matrix by which the block format is defined; results below that name no computation are those it must give.
F1 = """
 4  2  .  .  .  1  .  .  . -1  1
 1  5  .  .  .  2  .  .  .  . -1
 .  .  6  1  2  2  .  .  .  .  .
 .  .  2  7  1  .  .  .  .  .  .
 .  . -1  2  9  3  .  .  .  .  .
 2  1  3  4  5 10  4  3  2  .  .
 .  .  .  .  .  4 13  4  2  .  .
 .  .  .  .  .  3  3 11  3  .  .
 .  .  .  .  .  .  2  .  7  .  .
 8  4  .  .  .  .  .  .  . 25  3
-2  3  .  .  .  .  .  .  .  8 12
"""
DENSE = [[0.0 if x == "." else float(x) for x in line.split()] for line in F1.strip().split("\n")]
EDGES = [0, 2, 5, 6, 9, 11]


def sparse_variant():
    return [[0.0 if (i, j) in ((0, 9), (9, 9), (10, 9)) else v for j, v in enumerate(row)] for i, row in enumerate(DENSE)]


def vector(spark, values):
    return spark.createDataFrame(list(enumerate(map(float, values))), "j long, x double")


def column(df, *names, order="i"):
    return [r[0] if len(names) == 1 else tuple(r) for r in df.orderBy(order).select(*names).collect()]


def blocked(spark, dense=DENSE):
    matrix = C.from_dense(spark, dense)
    rows = P.strips_at(spark, EDGES)
    return (matrix, rows, *B.blocked(matrix, rows, P.strips_at(spark, EDGES)))


def test_products(spark):
    matrix = C.from_dense(spark, DENSE)
    assert matrix.df.count() == 47
    want = [7, 7, 11, 10, 13, 34, 23, 20, 9, 40, 21]
    assert column(M.spmv_full(matrix, Y.constant_vector(spark, 11)), "y") == want
    assert column(M.spmv_full(matrix, vector(spark, range(1, 12))), "y") == [15, 12, 44, 39, 68, 184, 165, 154, 77, 299, 216]
    for r in M.spmm(matrix.df, Y.constant_matrix(spark, 11, 3)).collect():
        assert r.y == want[r.i] and 0 <= r.k < 3
    wide = spark.range(11).selectExpr("id as j", "array(1.0D, 2.0D) as xs")
    assert sorted(map(tuple, M.spmm_wide(matrix.df, wide, 2).collect())) == sorted((i, k, y * (k + 1.0)) for i, y in enumerate(want) for k in range(2))


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_products_in_parts(spark, broadcast):
    """Entries meet the right side in as many tasks as asked for, whether or not it is broadcast."""
    matrix = C.from_dense(spark, DENSE)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        y = M.spmv(matrix.df, vector(spark, range(1, 12)), parts=7)
        assert column(y, "y") == [15, 12, 44, 39, 68, 184, 165, 154, 77, 299, 216]
        assert ", 7)" in y._jdf.queryExecution().toString()
        wide = spark.range(11).selectExpr("id as j", "array(id + 1.0D, 2.0D * (id + 1)) as xs")
        both = M.spmm_wide(matrix.df.unionByName(matrix.df), wide, 2, parts=7)
        assert sorted(map(tuple, both.collect())) == sorted((r.i, k, 2 * r.y * (k + 1)) for r in y.collect() for k in range(2))
        assert ", 7)" in both._jdf.queryExecution().toString()
        assert column(M.spmv_full(matrix, vector(spark, range(1, 12)), 7), "y") == [15, 12, 44, 39, 68, 184, 165, 154, 77, 299, 216]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_edge_products(spark):
    rect = C.from_dense(spark, [[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 0, 0]])
    assert column(M.spmv_full(rect, vector(spark, [1, 2, 3, 4])), "y") == [6, 6, 0]
    twice = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (0, 0, 2.0), (1, 0, 0.0)], "i long, j long, v double")
    assert column(M.spmv(twice, vector(spark, [1])), "y") == [5]
    assert C.built(twice).where("i = 0").first().v == 5 and C.distinct(twice).count() == 3 and C.nonzero(twice).count() == 3
    with pytest.raises(Exception, match="outside the matrix"):
        C.checked(C.Matrix(twice, 1, 1)).collect()
    assert column(C.row_pointers(rect), "ptr") == [0, 2, 3, 3]


def test_blocks(spark):
    matrix, rows, members, blocks = blocked(spark)
    shape = [(0, 0, 4, 4), (0, 2, 2, 2), (0, 4, 3, 4), (1, 1, 9, 9), (1, 2, 2, 3), (2, 0, 2, 2), (2, 1, 3, 3), (2, 2, 1, 1), (2, 3, 3, 3), (3, 2, 2, 3), (3, 3, 8, 9), (4, 0, 4, 4), (4, 4, 4, 4)]
    assert column(blocks, "a", "b", "nnz", "size", order="bid") == shape
    assert column(blocks, "offset", order="bid") == [0, 4, 6, 10, 19, 22, 24, 27, 28, 31, 34, 43, 47]
    assert column(B.strip_pointers(blocks, rows), "first", "last", order="a") == [(0, 3), (3, 5), (5, 9), (9, 11), (11, 13)]
    for density in (0, 26, 80, 100):
        chosen = B.split(blocks, B.is_dense(density))
        y = B.hybrid_spmv(members, chosen, Y.constant_vector(spark, 11))
        assert column(y, "y") == [7, 7, 11, 10, 13, 34, 23, 20, 9, 40, 21]
        assert (B.residual(members, chosen).count() == 0) == (density < 66)
    chosen = B.split(blocks, B.is_dense(0))
    stored = B.values(members, chosen)
    assert stored.where("bid = 0").first().vals == [4, 1, 2, 5]
    assert sorted(map(tuple, B.to_coo(stored).collect())) == sorted(map(tuple, matrix.df.collect()))
    assert column(B.kernel_spmv(stored, vector(spark, range(1, 12))), "y") == [15, 12, 44, 39, 68, 184, 165, 154, 77, 299, 216]
    assert column(B.hybrid_spmm(members, chosen, Y.constant_matrix(spark, 11, 2)).where("k = 1"), "y") == [7, 7, 11, 10, 13, 34, 23, 20, 9, 40, 21]
    assert tuple(B.report(chosen, 121).first()) == (47, 4, 13, 13, 0.39, 0.42)
    assert column(B.strip_work(chosen), "work", order="a") == [10, 12, 9, 12, 8]


def test_hybrid_split_at_80(spark):
    _, _, members, blocks = blocked(spark, sparse_variant())
    chosen = B.split(blocks, B.is_dense(80))
    assert [r.bid for r in chosen.where("not is_dense").orderBy("bid").collect()] == [2, 4, 9, 12]
    assert column(chosen.where("is_dense"), "dense_ordinal", order="bid") == list(range(9))
    rest = B.residual(members, chosen).orderBy("i", "j").collect()
    assert [r.v for r in rest] == [1, -1, 2, 3, 4, 3, 3, 12] and [r.j for r in rest] == [10, 10, 5, 5, 5, 5, 10, 10]
    assert column(B.hybrid_spmv(members, chosen, Y.constant_vector(spark, 11)), "y") == [8, 7, 11, 10, 13, 34, 23, 20, 9, 15, 13]
    assert chosen.select(B.is_dense_floor(80).alias("d")).where("d").count() >= chosen.where("is_dense").count()


def test_similarities_and_cuts(spark):
    raw = C.from_dense(spark, DENSE)
    assert column(P.similarities(raw, "j", best_shift), "sim", order="k") == pytest.approx([8.8, 6, 10.5, 18.5, 16.142857, 22.857143, 39.75, 23.75, 43.75, 75.25], abs=1e-6)
    ones = C.Matrix(C.pattern(raw.df), 11, 11)
    assert column(P.similarities(ones, "j", best_shift), "sim", order="k") == pytest.approx([1, 0.2, 1, 1, 0.428571, 0.571429, 0.75, 0.75, 0.25, 0.75], abs=1e-6)
    assert column(P.similarities(ones, "i", best_shift_or_zero), "sim", order="k") == pytest.approx([0.8, 0.25, 0.75, 0.75, 0.444444, 0.444444, 1, 0.5, 0.25, 1], abs=1e-6)
    assert column(P.similarities(ones, "j", mean_shift), "sim", order="k") == pytest.approx([0.6, 0.2, 0.833333, 0.833333, 0.428571, 0.428571, 0.666667, 0.666667, 0.083333, 0.5], abs=1e-6)
    edges = lambda axis, thr, f=best_shift_or_zero: [0, *column(P.strips(P.cuts_between_runs(ones, axis, thr, f), 11), "hi", order="strip")]
    assert edges("j", 0.2) == edges("i", 0.2) == [0, 11]
    assert edges("j", 0.6) == EDGES and edges("i", 0.6) == [0, 2, 5, 6, 8, 9, 11]
    assert edges("j", 0.2, mean_shift) == edges("i", 0.2, mean_shift) == [0, 9, 11]


def test_runs_of_empty_slices(spark):
    matrix = C.from_dense(spark, [[1, 1, 0, 0, 0, 1], [1, 1, 0, 0, 0, 0], [0] * 6, [0, 0, 0, 0, 1, 1]])
    rows, columns = P.partitioned(matrix)
    assert column(columns, "lo", "hi", order="strip") == [(0, 2), (2, 4), (4, 6)]
    assert column(rows, "lo", "hi", order="strip") == [(0, 2), (2, 3), (3, 4)]
    members, blocks = B.blocked(matrix, rows, columns)
    assert column(B.strip_pointers(blocks, rows), "first", "last", order="a")[1] == (-1, -1)
    everywhere = P.cuts_everywhere(matrix, "j", 0.2, best_shift)
    assert column(everywhere, "cut", order="k") == [False, True, False, True, False]


def test_random_matrices_against_a_loop(spark):
    rng = random.Random(4)
    for _ in range(3):
        m, n = rng.randrange(2, 9), rng.randrange(2, 12)
        dense = [[float(rng.random() < 0.3) for _ in range(n)] for _ in range(m)]
        cols = [[row[k] for row in dense] for k in range(n)]
        want = []
        for a, b in zip(cols, cols[1:]):
            if any(a) and any(b):
                dots = [sum(x * y for x, y in zip(a, b)), sum(x * y for x, y in zip(a[1:], b)), sum(x * y for x, y in zip(a, b[1:]))]
                want.append(max(dots) / max(sum(a), sum(b)) < 0.5)
            else:
                want.append(any(a) or any(b))
        assert column(P.cuts_between_runs(C.from_dense(spark, dense), "j", 0.5), "cut", order="k") == want


def test_strips_and_running_sums(spark):
    assert column(P.strips_uniform(spark, 12, 3), "lo", "hi", order="strip") == [(0, 4), (4, 8), (8, 12)]
    found = column(P.strips_random(spark, 50, 7, seed=3), "lo", "hi", order="strip")
    assert len(found) == 7 and found == column(P.strips_random(spark, 50, 7, seed=3), "lo", "hi", order="strip")
    assert found[0][0] == 0 and found[-1][1] == 50 and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    for bad in (lambda: P.strips_uniform(spark, 10, 3), lambda: P.strips_random(spark, 5, 1), lambda: P.strips_at(spark, [0, 3, 3])):
        with pytest.raises(ValueError):
            bad()
    rows = spark.range(100).selectExpr("id", "id % 3 as g", "1L as one")
    got = running_sum(rows, "id", "one", "s", ("g",), chunk=7).collect()
    assert all(r.s == r.id // 3 + 1 for r in got)


def test_synthetic(spark):
    matrix, high, wide = Y.generated(spark, 60, 40, 6, 4, 3, 25, 5, uniform=False, seed=2)
    members, blocks = B.blocked(matrix, high, wide)
    found = blocks.collect()
    assert len(found) == 8
    dense = [r for r in found if r.nnz == r.size - r.size * 25 // 100]
    sparse = [r for r in found if r.nnz == min(10, r.size)]
    assert len(dense) + len(sparse) >= 8
    again = Y.generated(spark, 60, 40, 6, 4, 3, 25, 5, uniform=False, seed=2)[0]
    assert sorted(map(tuple, again.df.collect())) == sorted(map(tuple, matrix.df.collect()))


def test_evaluation(spark):
    rows = spark.createDataFrame([("a", float(t)) for t in range(11)] + [("b", 1.0), ("b", 50.0)], "name string, t double")
    assert sorted(map(tuple, E.medians(rows, "name").collect())) == [("a", 5.0, 5.0), ("b", 25.5, 50.0)]
    assert sorted(map(tuple, E.trimmed(rows, "name").collect())) == [("a", 9, 5.0), ("b", 2, 25.5)]
    wide = E.pivoted(spark.createDataFrame([("a", 1, 2.5), ("b", 2, 3.5)], "name string, threads long, t double"), [1, 2])
    assert sorted(map(tuple, wide.collect())) == [("a", "2.5", "N/A"), ("b", "N/A", "3.5")]
    assert E.least_loaded([5, 0, 3, 3], 2) == [[0], [2, 3]] and E.least_loaded([0, 0], 2) == []
    parts = E.even_distribution(spark.range(7).toDF("f"), "f", 3).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in parts] == [3, 2, 2]


def test_comparison_and_last_wins(spark):
    left = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i long, y double")
    right = spark.createDataFrame([(0, 1.0), (1, 2.5), (3, 3.0)], "i long, y double")
    assert sorted(map(str, map(tuple, E.differing(left, right, "i", "y").collect()))) == ["(1, 2.0, 2.5)", "(2, 3.0, None)", "(3, None, 3.0)"]
    twice = spark.createDataFrame([(0, 0, 1.0, 2), (0, 0, 5.0, 1)], "i long, j long, v double, n int")
    assert C.last_wins(twice, "n").first().v == 1


def test_labels_and_forest(spark, tmp_path):
    grid = E.parameter_grid(spark, [1, 40, 2000], [1, 50], [0, 50, 90])
    assert grid.count() == 18 and grid.where("dim1 = 40 and dim2 = 50 and perc_zeros = 50").first().nnz == 1000
    rows = grid.unionByName(spark.createDataFrame([(1, 1, 100, 0)], "dim1 long, dim2 long, perc_zeros long, nnz long"))
    timed = rows.selectExpr("*", "2 + nnz / 100.0D as csr_time", "1 + nnz / 200.0D as block_time")
    got = {(r.dim1, r.dim2, r.perc_zeros): r.target for r in E.labelled(timed).collect()}
    assert got[40, 50, 0] == 1 and got[40, 50, 90] == 0 and got[1, 1, 0] == 0 and got[2000, 1, 0] == 1
    model, error = E.trained(E.labelled(timed), trees=5)
    assert not math.isnan(error)
    E.save_model(model, f"{tmp_path}/model")
    _, _, _, blocks = blocked(spark)
    assert E.classified(blocks, E.load_model(f"{tmp_path}/model")).where("is_dense").count() == 0


@pytest.mark.parametrize("band", [1, 4, 1 << 14])
def test_wide_rows_go_once_to_each_band(spark, monkeypatch, band):
    """Entries of equal coordinates, rows that meet nothing, two matrices; the right side's rows move with bands of rows and not with entries."""
    from stripmill.operators import kernel as N

    monkeypatch.setattr(N, "BAND", band)
    found = [(m, i, j, float(i + 2 * j + len(m))) for m in ("a", "bb") for i in range(11) for j in (i % 3, i % 3, 2, 7)]
    entries = spark.createDataFrame(found, "m string, i long, j long, v double")
    right = {j: [float(j + k) for k in range(5)] for j in range(7)}
    x = spark.createDataFrame(list(right.items()), "j long, xs array<float>")
    want = {}
    for m, i, j, v in found:
        if j in right:
            want[m, i] = [y + v * r for y, r in zip(want.get((m, i), [0.0] * 5), right[j])]
    got = N.row_products(entries, x, 5, ("m",))
    assert {(r.m, r.i): r.ys for r in got.collect()} == want
    plan = N.row_products(entries.where("m = 'a'"), x, 5)._jdf.queryExecution().logical().toString()
    assert "RepartitionByExpression" in plan and "_band" in plan
    members = entries.where("m = 'a'").selectExpr("i", "j", "v", "0L AS a", "0L AS b", "0L AS r0", "11L AS r1", "0L AS c0", "8L AS c1")
    for dense in (True, False):
        chosen = spark.createDataFrame([(0, 0, 0, 8, dense)], "a long, b long, c0 long, c1 long, is_dense boolean")
        assert {(r.i, r.k): r.y for r in B.hybrid_spmm_wide(members, chosen, x, 5).collect()} == {(i, k): y for (m, i), ys in want.items() if m == "a" for k, y in enumerate(ys)}
