from __future__ import annotations

import pytest
from test_files import entries
from test_matrix import DENSE, blocked, column, sparse_variant, vector

from stripmill.operators import blocks as B
from stripmill.operators import coo as C
from stripmill.operators import partition as P
from stripmill.sources import files


@pytest.mark.parametrize("largest", [1, 2, 5])
def test_blocks_over_the_largest_array_are_whole(spark, monkeypatch, tmp_path, largest):
    matrix, rows, members, blocks = blocked(spark, DENSE)
    chosen = B.split(blocks, B.is_dense(0))
    cells = lambda stored: sorted((r.bid, r["first"] + k, v) for r in stored.collect() for k, v in enumerate(r.vals))
    want = cells(B.values(members, chosen))
    monkeypatch.setattr(B, "LARGEST", largest)
    stored = B.values(members, chosen)
    assert max(len(r.vals) for r in stored.collect()) <= largest
    assert cells(stored) == want
    assert sorted(map(tuple, B.to_coo(stored).collect())) == sorted(map(tuple, matrix.df.collect()))
    assert column(B.kernel_spmv(stored, vector(spark, range(1, 12))), "y") == [15, 12, 44, 39, 68, 184, 165, 154, 77, 299, 216]
    matrix, rows, members, blocks = blocked(spark, sparse_variant())
    arrays = files.block_arrays(matrix, members, B.split(blocks, B.is_dense(80)), rows, rows)
    files.write_arrays(spark, arrays, files.VBRC, f"{tmp_path}/b")
    assert entries(files.read_blocks(spark, f"{tmp_path}/b")) == entries(matrix)


def test_work_on_dense_blocks_grows_with_their_nonzeros(spark):
    """A block of 10 ** 12 cells, all treated as dense, with a few nonzeros."""
    found = [(0, 0, 2.0), (999_999, 7, 3.0), (512, 999_999, 5.0), (999_999, 999_999, 1.0)]
    members = B.assigned(spark.createDataFrame(found, "i long, j long, v double"), *[spark.createDataFrame([(0, 0, 1_000_000)], "strip long, lo long, hi long")] * 2)
    chosen = B.densities(members, B.is_dense(0))
    x = spark.createDataFrame([(0, 1.0), (7, 2.0), (999_999, 10.0)], "j long, x double")
    want = [(0, 2.0), (512, 50.0), (999_999, 16.0)]
    assert sorted(map(tuple, B.kernel_spmv(B.tiled(members, chosen), x, B.ranges(chosen)).collect())) == want
    assert sorted(map(tuple, B.hybrid_spmv(members, chosen, x).collect())) == want
    assert sorted(map(tuple, B.to_coo(B.tiled(members, chosen)).collect())) == sorted(found)


@pytest.mark.parametrize("chunk", [1, 4, 1 << 16])
def test_cells_of_dense_blocks_are_whole_and_no_block_is_an_array(spark, monkeypatch, chunk):
    matrix, rows, members, blocks = blocked(spark, DENSE)
    for density in (0, 80, 100):
        chosen = B.split(blocks, B.is_dense(density))
        want = sorted((r.bid, r["first"] + k, v) for r in B.values(members, chosen).collect() for k, v in enumerate(r.vals))
        monkeypatch.setattr(B, "CHUNK", chunk)
        assert sorted(map(tuple, B.cells(members, chosen).collect())) == want


def test_cells_take_no_python_and_tasks_grow_with_them(spark, monkeypatch):
    """Two blocks of a million cells in all with four entries, two of them in one place."""
    found = [(0, 0, 2.0), (999, 7, 3.0), (999, 7, 4.0), (512, 999, 5.0)]
    cut = P.strips_at(spark, [0, 1000]), P.strips_at(spark, [0, 500, 1000])
    members, blocks = B.blocked(C.Matrix(spark.createDataFrame(found, "i long, j long, v double"), 1000, 1000), *cut)
    monkeypatch.setattr(B, "TASK_CELLS", 1 << 16)
    cells = B.cells(members, B.split(blocks, B.is_dense(0)))
    assert "MapInArrow" not in cells._jdf.queryExecution().toString() and cells.rdd.getNumPartitions() == 1_000_000 >> 16
    assert cells.groupBy("bid").count().orderBy("bid").collect() == [(0, 500_000), (1, 500_000)]
    assert sorted(map(tuple, cells.where("v <> 0").collect())) == [(0, 0, 2.0), (0, 7_999, 7.0), (1, 499_512, 5.0)]
