"""Many matrices in one table, two-level numbering and ranks, and what goes with them."""

from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.sql import functions as F
from test_files import entries, put
from test_matrix import column

from stripmill.operators import blocks as B
from stripmill.operators import coo as C
from stripmill.operators import evaluation as E
from stripmill.operators import partition as P
from stripmill.operators import product as M
from stripmill.operators import running
from stripmill.sources import files
from stripmill.sources.scratch import kept


def several(spark):
    """Three sparse matrices of different sizes, one of them empty, and the same in one table."""
    rng = random.Random(6)
    single = {f"m{k}": C.from_dense(spark, [[float(rng.randrange(1, 9)) * (rng.random() < share) for _ in range(n)] for _ in range(m)]) for k, (m, n, share) in enumerate([(9, 7, 0.4), (5, 12, 0.2), (3, 4, 0.0)])}
    rows = [(name, *e) for name, x in single.items() for e in entries(x)]
    dims = spark.createDataFrame([(name, x.rows, x.columns) for name, x in single.items()], "matrix_id string, rows long, columns long")
    return single, C.Matrices(spark.createDataFrame(rows, "matrix_id string, i long, j long, v double"), dims)


def of(df, name):
    return sorted(map(tuple, df.where(F.col("matrix_id") == name).drop("matrix_id").collect()))


def test_each_of_many_matrices_is_as_if_alone(spark):
    single, many = several(spark)
    rows, columns = map(kept, P.partitioned(many, 0.5))
    members, blocks = B.blocked_all(many.df, rows, columns, C.KEYS)
    chosen = kept(B.split(blocks, B.is_dense(40), C.KEYS))
    x = spark.range(20).select(F.col("id").alias("j"), (F.col("id") + 1.0).alias("x"))
    y = B.hybrid_spmv(members, chosen, x, C.KEYS)
    report = B.report(chosen, many.dims.select("matrix_id", (F.col("rows") * F.col("columns")).alias("cells")), C.KEYS)
    for name, matrix in single.items():
        r, c = P.partitioned(matrix, 0.5)
        assert of(rows, name) == sorted(map(tuple, r.collect())) and of(columns, name) == sorted(map(tuple, c.collect()))
        one, alone = B.blocked(matrix, r, c)
        split = B.split(alone, B.is_dense(40))
        assert of(chosen, name) == sorted(map(tuple, split.collect()))
        assert of(y, name) == sorted(map(tuple, M.spmv(matrix.df, x).collect()))
        assert of(B.strip_pointers(chosen, rows, C.KEYS), name) == sorted(map(tuple, B.strip_pointers(split, r).collect()))
        if matrix.df.count():
            assert of(report, name) == [tuple(B.report(split, matrix.rows * matrix.columns).first())]


def test_collections_of_files(spark, tmp_path):
    single, _ = several(spark)
    for name, matrix in single.items():
        files.write_matrix_market(matrix, f"{tmp_path}/all/{name}/{name}.mtx")
    put(tmp_path, "all/s/s.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n% text\n3 3 2\n2 1\n3 3\n")
    found = files.read_collection(spark, f"{tmp_path}/all")
    assert sorted(map(tuple, found.dims.collect())) == [("m0", 9, 7), ("m1", 5, 12), ("m2", 3, 4), ("s", 3, 3)]
    assert all(of(found.df, name) == entries(matrix) for name, matrix in single.items())
    assert of(found.df, "s") == [(0, 1, 1), (1, 0, 1), (2, 2, 1)]
    put(tmp_path, "bad/b.mtx", "%%MatrixMarket matrix coordinate complex general\n1 1 0\n")
    with pytest.raises(Exception, match="can't be read|cannot be read|can be read"):
        files.read_collection(spark, f"{tmp_path}/bad").dims.collect()


def test_pattern_files(spark, tmp_path):
    single, _ = several(spark)
    for name in ("m0", "m2"):
        ones = sorted((i, j, 1.0) for i, j, _ in entries(single[name]))
        files.write_pattern(single[name], f"{tmp_path}/{name}.smtx")
        again = files.read_pattern(spark, f"{tmp_path}/{name}.smtx")
        assert (entries(again), again.rows, again.columns) == (ones, single[name].rows, single[name].columns)
        files.pattern_to_matrix_market(spark, f"{tmp_path}/{name}.smtx", f"{tmp_path}/{name}.mtx")
        assert entries(files.read_matrix_market(spark, f"{tmp_path}/{name}.mtx")) == ones


def test_ranks_with_ties_and_nulls(spark):
    rng = random.Random(1)
    groups = {"a": [float(rng.randrange(5)) for _ in range(300)], "b": [rng.random() for _ in range(1001)], "c": [7.0], "d": [1.0, 2.0]}
    rows = [(g, t) for g, ts in groups.items() for t in ts] + [("a", None), ("e", None)]
    got = {r.name: (r.median_t, r.upper_median_t) for r in E.medians(spark.createDataFrame(rows, "name string, t double"), "name").collect()}
    assert got == {g: (pytest.approx(median(ts)), sorted(ts)[len(ts) // 2]) for g, ts in groups.items()}


def test_spread_and_two_values_at_once(spark):
    df = spark.createDataFrame([("x", 0, 10), ("y", 3, 3), ("z", -4, 1)], "n string, lo long, hi long")
    got = sorted((r.n, r.k) for r in running.spread(df, "lo", "hi", "k", chunk=3).collect())
    assert got == [("x", k) for k in range(10)] + [("z", k) for k in range(-4, 1)]
    rows = spark.range(50).select("id", F.lit(1).cast("long").alias("a"), F.col("id").alias("b"))
    assert all((r.x, r.y) == (r.id + 1, r.id * (r.id + 1) // 2) for r in running.running_sum(rows, "id", ["a", "b"], ["x", "y"], chunk=7).collect())


def test_dealing_and_manual_strips(spark):
    work = spark.createDataFrame([(0, 5), (1, 0), (2, 3), (3, 3)], "a long, work long")
    assert column(E.dealt(work, "a", 2), "a", "work", "part", order="a") == [(0, 5, 0), (2, 3, 1), (3, 3, 1)]
    for name, (rows, columns) in P.MANUAL_STRIPS.items():
        found = P.strips_by_hand(spark, name)
        assert [found[0].count(), found[1].count()] == [len(rows) - 1, len(columns) - 1]
