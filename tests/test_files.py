from __future__ import annotations

import pytest

from stripmill.operators import blocks as B
from stripmill.operators import coo as C
from stripmill.operators import synth as Y
from stripmill.sources import files

from test_matrix import DENSE, blocked, column, sparse_variant


def entries(matrix):
    return sorted(map(tuple, matrix.df.where("v <> 0").select("i", "j", "v").collect()))


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_matrix_market(spark, tmp_path):
    real = C.from_dense(spark, DENSE)
    files.write_matrix_market(real, f"{tmp_path}/out")
    again = files.read_matrix_market(spark, f"{tmp_path}/out")
    assert (entries(again), again.rows, again.columns) == (entries(real), 11, 11)
    text = "%%MatrixMarket matrix coordinate {}\n% a comment\n\n2 2 2\n1 1{}\n2 1{}\n"
    sym = files.read_matrix_market(spark, put(tmp_path, "a.mtx", text.format("real symmetric", " 5", " 7e0")))
    assert entries(sym) == [(0, 0, 5), (0, 1, 7), (1, 0, 7)]
    skew = files.read_matrix_market(spark, put(tmp_path, "b.mtx", text.format("integer skew-symmetric", " 0", " 7")))
    assert entries(skew) == [(0, 1, -7), (1, 0, 7)]
    flat = files.read_matrix_market(spark, put(tmp_path, "c/c.mtx", text.format("pattern general", "", "")))
    assert entries(flat) == [(0, 0, 1), (1, 0, 1)]
    same = files.read_matrix_market(spark, put(tmp_path, "d.mtx", "%%MatrixMarket matrix coordinate integer general\n2 2 2\n2 2 2\n1 1 1\n"))
    assert entries(same) == [(0, 0, 1), (1, 1, 2)]
    for kind in ("complex general", "real hermitian"):
        with pytest.raises(ValueError):
            files.read_matrix_market(spark, put(tmp_path, "bad.mtx", text.format(kind, " 1", " 1")))
    with pytest.raises(ValueError, match="square"):
        files.read_matrix_market(spark, put(tmp_path, "bad.mtx", "%%MatrixMarket matrix coordinate real symmetric\n2 3 0\n"))
    (tmp_path / "bad.mtx").unlink()
    assert [r.name for r in files.matrix_files(spark, str(tmp_path), named_as_folder=True).collect()] == ["c"]
    many = files.read_matrices(spark, str(tmp_path))
    assert {(r.matrix_id, r["count"]) for r in many.groupBy("matrix_id").count().collect()} == {("a", 3), ("b", 3), ("c", 2), ("d", 2)}


def test_pattern_file(spark, tmp_path):
    found = files.read_pattern(spark, put(tmp_path, "p.smtx", "3, 4, 4\n0 2 2 4\n0 3 1 2\n"))
    assert (entries(found), found.rows, found.columns) == ([(0, 0, 1), (0, 3, 1), (2, 1, 1), (2, 2, 1)], 3, 4)


def test_block_files(spark, tmp_path):
    for dense, density, names in ((DENSE, 0, files.VBR), (DENSE, 0, files.VBRC), (sparse_variant(), 80, files.VBRC), (DENSE, 100, files.VBRC)):
        matrix, rows, members, blocks = blocked(spark, dense)
        chosen = B.split(blocks, B.is_dense(density))
        arrays = files.block_arrays(matrix, members, chosen, rows, rows)
        if density == 80:
            assert arrays["indx"] == "0,4,6,15,17,20,21,24,33,37" and arrays["ublocks"] == "2,4,9,12"
            assert arrays["indptr"] == "0,1,2,3,3,4,4,5,6,6,7,8" and arrays["indices"] == "10,10,5,5,5,5,10,10"
            assert [float(x) for x in arrays["csr_val"].split(",")] == [1, -1, 2, 3, 4, 3, 3, 12]
        assert arrays["bindx"] == "0,2,4,1,2,0,1,2,3,2,3,0,4" and arrays["rpntr"] == "0,2,5,6,9,11"
        assert (arrays["bpntrb"], arrays["bpntre"]) == ("0,3,5,9,11", "3,5,9,11,13")
        files.write_arrays(spark, arrays, names, f"{tmp_path}/b{density}{len(names)}")
        again = files.read_blocks(spark, f"{tmp_path}/b{density}{len(names)}")
        assert (entries(again), again.rows, again.columns) == (entries(matrix), 11, 11)


def test_vectors_results_and_tables(spark, tmp_path):
    files.write_dense(Y.constant_matrix(spark, 3, 2, 1.5), f"{tmp_path}/m", "j", "k")
    assert files.read_dense(spark, f"{tmp_path}/m", 2).count() == 6
    assert column(files.read_vector(spark, put(tmp_path, "v", "x=[1.0,2.5,]\n")), "x", order="j") == [1, 2.5]
    files.write_result(spark.createDataFrame([(1, 2.0), (0, 1.25)], "i long, y double"), f"{tmp_path}/y")
    assert [r.value for r in spark.read.text(f"{tmp_path}/y").collect()] == ["1.250000", "2.000000"]
    times = files.read_timings(spark, put(tmp_path, "t.csv", "a,1,2.5\nb,7\nc,ERROR,3\n"))
    assert sorted(map(tuple, times.collect())) == [("a", 0, 1.0), ("a", 1, 2.5), ("b", 0, 7.0), ("c", 1, 3.0)]
    files.write_table(spark.createDataFrame([(1, 2.5)], "dim1 int, csr_time double"), f"{tmp_path}/csv")
    assert [tuple(r) for r in files.read_table(spark, f"{tmp_path}/csv", "dim1 int, csr_time double").collect()] == [(1, 2.5)]


def test_files_in_many_parts(spark, tmp_path, monkeypatch):
    """Formats that name a whole array on one line are written by many tasks, in order, and read by many."""
    from stripmill.operators import running

    monkeypatch.setattr(running, "TASK_ROWS", 8)
    matrix = C.from_dense(spark, DENSE)
    files.write_pattern(matrix, f"{tmp_path}/p.smtx")
    files.write_matrix_market(matrix, f"{tmp_path}/m/m.mtx")
    text = {}
    for name in ("p.smtx", "m/m.mtx"):
        parts = sorted((tmp_path / name).glob("part-*"))
        assert len(parts) > 3
        text[name] = "".join(p.read_text() for p in parts)
    assert [len(line.split()) for line in text["p.smtx"].split("\n")] == [1, 12, matrix.df.count()]
    assert text["m/m.mtx"].split("\n")[:2] == ["%%MatrixMarket matrix coordinate real general", f"11 11 {matrix.df.count()}"]
    again = files.read_matrix_market(spark, f"{tmp_path}/m/m.mtx")
    assert (entries(again), again.rows, again.columns) == (entries(matrix), 11, 11)
    assert entries(files.read_pattern(spark, f"{tmp_path}/p.smtx")) == [(i, j, 1) for i, j, _ in entries(matrix)]


def test_zeros_of_dense_blocks_are_text_only(spark, tmp_path, monkeypatch):
    """A block of a million cells with three entries: what is shuffled and read again is a row for each nonzero and each run, not for each cell."""
    from stripmill.operators import partition as P

    entries_ = [(0, 0, 2.0), (999, 7, 3.0), (512, 999, 1e20)]
    matrix = C.Matrix(spark.createDataFrame(entries_, "i long, j long, v double"), 1000, 1000)
    rows = P.strips_at(spark, [0, 1000])
    members, blocks = B.blocked(matrix, rows, rows)
    lines = files.block_lines(matrix, members, B.split(blocks, B.is_dense(0)), rows, rows)
    assert lines["val"].count() <= 3 + -(-1_000_000 // files.CELLS)
    monkeypatch.setattr(files, "TASK_CHARS", 1 << 19)
    monkeypatch.setattr(files, "TEXT", 1 << 13)
    files.write_lines(lines, files.VBR, f"{tmp_path}/b.vbr")
    parts = sorted((tmp_path / "b.vbr").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert len(parts) > 3 and [len(line.split(",")) for line in text.split("\n")][0] == 1_000_000 and len(text.split("\n")) == len(files.VBR)
    assert files.read_arrays(spark, f"{tmp_path}/b.vbr").where("name = 'val'").count() == 3
    assert entries(files.read_blocks(spark, f"{tmp_path}/b.vbr")) == sorted(entries_)
    # one file with lines as they are written elsewhere, looked at in pieces smaller than a line
    monkeypatch.setattr(files, "PIECE", 1 << 10)
    assert entries(files.read_blocks(spark, put(tmp_path, "one.vbr", text.replace("\t", "").replace(" ", "")))) == sorted(entries_)


def test_block_text_is_cut_anywhere(monkeypatch):
    """The same items and marks come of a text however it is cut into rows and pieces."""
    import pyarrow as pa

    text = "val = [1.0, -0.0,+2.5e-05,0.0]\nindx=[]\nrpntr=[0, 2]\n"

    def found(rows):
        batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(rows)), pa.array([0] * len(rows)), pa.array(rows)], ["file", "begin", "value"])
        return [(r["at"], r["name"]) for b in files._counted(iter([batch])) for r in b.to_pylist()]

    want = [(0, "val"), (5, ""), (6, "indx"), (7, ""), (8, "rpntr"), (11, ""), (12, None)]
    assert found([text]) == want and found(text.split(",")) == want
    for piece in (1, 7, 20):
        monkeypatch.setattr(files, "PIECE", piece)
        assert found([text]) == want and found(text.split(",")) == want
