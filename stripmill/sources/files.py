"""Readers and writers of matrix files: Matrix Market, pattern files, block formats, dense vectors.

A file's data are read and parsed by Spark; only the header of a single matrix, or where the arrays of a file begin, comes to the
driver. A file is written as a folder of its name, whose parts, one after the other in order of their names, are the file's text: each task
writes the numbers of one range of places, also of formats that name a whole array on one line, whose numbers are then
followed by a space each; in block files a tab stands for the space after about TEXT characters. Reading takes such folders and single
files alike, and splits long lines at the numbers, those of block files in folders at the tabs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripmill.operators import blocks as B
from stripmill.operators.coo import Matrices, Matrix, row_pointers, symmetrized
from stripmill.operators.interval import binned
from stripmill.operators.kernel import groups
from stripmill.operators.running import running_sum, spread, tasks
from stripmill.sources.scratch import kept

VBR = ("val", "indx", "bindx", "rpntr", "cpntr", "bpntrb", "bpntre")
VBRC = ("val", "csr_val", "indptr", "indices", "indx", "bindx", "rpntr", "cpntr", "bpntrb", "bpntre", "ublocks")
KINDS = ("real", "integer", "pattern")
SYMMETRIES = {"general": 0.0, "symmetric": 1.0, "skew-symmetric": -1.0}


#: Cells of dense blocks that are written as one value and zeros at most, characters that one task writes, and those in a row of text, about.
CELLS, TASK_CHARS, TEXT = 1 << 12, 1 << 25, 1 << 20
#: A zero as it follows another number.
ZERO = ", 0.0"
#: Where a row was read: rows of a file in parts or splits rise in it.
PLACE = "struct(_metadata.file_path AS file, _metadata.file_block_start AS begin, monotonically_increasing_id() AS nth)"


def read_matrix_market(spark: SparkSession, path: str) -> Matrix:
    lines = spark.read.text(path).select(F.expr(PLACE).alias("at"), "value")
    bare = ~F.col("value").startswith("%") & (F.trim("value") != "")
    # the size line is the first that is no comment
    first = lambda cond: F.min(F.when(cond, F.struct("at", "value")))
    found = lines.agg(first(F.col("value").startswith("%%MatrixMarket")).alias("banner"), first(bare).alias("size")).first()
    words = found.banner.value.lower().split() if found.banner else []
    if len(words) != 5 or words[1:3] != ["matrix", "coordinate"] or words[3] not in KINDS or words[4] not in SYMMETRIES:
        raise ValueError(f"not a Matrix Market file that can be read: {' '.join(words)}")
    kind, sign, (rows, columns, _) = words[3], SYMMETRIES[words[4]], map(int, found.size.value.split())
    if sign and rows != columns:
        raise ValueError("a symmetric matrix must be square")
    head, field = found.size["at"], F.split(F.trim("value"), r"\s+")
    data = lines.where(bare & ~((F.col("at.file") == head.file) & (F.col("at.begin") == head.begin) & (F.col("at.nth") == head.nth))).select(field.alias("f"))
    value = F.lit(1.0) if kind == "pattern" else F.col("f")[2].cast("double")
    entries = data.select((F.col("f")[0].cast("long") - 1).alias("i"), (F.col("f")[1].cast("long") - 1).alias("j"), value.alias("v"))
    return Matrix(symmetrized(entries, sign) if sign else entries, rows, columns)


def _write(lines: DataFrame, path: str, order: list[str], parts: int, by: str = "\n") -> None:
    """Column value of the rows in the given order as the text of a file in parts, each value followed by `by`."""
    ordered = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.select("value").write.mode("overwrite").option("lineSep", by).text(path)


def write_matrix_market(matrix: Matrix, path: str) -> None:
    """Header, then nonzeros by row and column."""
    entries = kept(matrix.df.where("v <> 0").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v"))
    stored = entries.count()
    lines = ["%%MatrixMarket matrix coordinate real general", f"{matrix.rows} {matrix.columns} {stored}"]
    head = reduce(DataFrame.unionByName, [entries.sparkSession.range(1).select(F.lit(k - 2).cast("long").alias("at"), F.lit(0).cast("long").alias("place"), F.lit(line).alias("value")) for k, line in enumerate(lines)])
    body = entries.select(F.col("i").alias("at"), F.col("j").alias("place"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, "v").alias("value"))
    _write(head.unionByName(body), path, ["at", "place"], tasks(stored))


def _whole(path: str) -> Column:
    """The name of a file for those of its parts."""
    return F.regexp_replace(path, r"/part-[^/]*$", "")


def matrix_files(spark: SparkSession, folder: str, named_as_folder: bool = False) -> DataFrame:
    """(path, name) of the .mtx files below a folder; only those named as their folder, if asked."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.mtx,part-*}").load(folder)
    rows = found.select(_whole("path").alias("path")).where(F.col("path").endswith(".mtx")).distinct()
    rows = rows.select("path", F.regexp_extract("path", r"([^/]+)\.mtx$", 1).alias("name"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent"))
    return (rows.where("name = parent") if named_as_folder else rows).select("path", "name")


def read_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """(matrix_id, i, j, v) of all Matrix Market files below a folder."""
    return read_collection(spark, folder).df


def read_collection(spark: SparkSession, folder: str) -> Matrices:
    """All Matrix Market files below a folder, matrix_id being a file's name. One plan reads every file: banners and size
    lines, two for each file, are joined with the entries of their file."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.mtx,part-*}").text(folder)
    lines = read.select(_whole("_metadata.file_path").alias("path"), F.expr(PLACE).alias("at"), "value").where(F.col("path").endswith(".mtx"))
    words = F.split(F.lower(F.trim("value")), r"\s+")
    banners = lines.where(F.col("value").startswith("%%MatrixMarket")).groupBy(F.col("path").alias("of")).agg(F.min(F.struct("at", words.alias("w")))["w"].alias("w"))
    data = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    heads = data.groupBy(F.col("path").alias("of")).agg(F.min(F.struct("at", "f")).alias("size")).join(banners, "of", "left")
    sign = F.create_map(*[F.lit(x) for pair in SYMMETRIES.items() for x in pair])
    fits = F.coalesce((F.size("w") == 5) & (F.col("w")[1] == "matrix") & (F.col("w")[2] == "coordinate") & F.col("w")[3].isin(*KINDS) & F.col("w")[4].isin(*SYMMETRIES), F.lit(False))
    whole = lambda k: F.col("size.f")[k].cast("long")
    square = fits & ((F.col("w")[4] == "general") | (whole(0) == whole(1)))
    said = F.concat(F.lit("not a Matrix Market file that can be read: "), F.col("of"))
    heads = heads.select(F.col("of"), F.when(square, F.regexp_extract("of", r"([^/]+)\.mtx$", 1)).otherwise(F.raise_error(said)).alias("matrix_id"), whole(0).alias("rows"), whole(1).alias("columns"), F.col("size.at").alias("head"), (F.col("w")[3] == "pattern").alias("bare"), sign[F.col("w")[4]].alias("sign"))
    met = data.join(F.broadcast(heads), F.col("path") == F.col("of")).where("at <> head")
    value = F.when(F.col("bare"), F.lit(1.0)).otherwise(F.col("f")[2].cast("double"))
    entry = met.select("matrix_id", (F.col("f")[0].cast("long") - 1).alias("i"), (F.col("f")[1].cast("long") - 1).alias("j"), value.alias("v"), "sign")
    once = F.array(F.struct("i", "j", "v"))
    both = F.concat(once, F.array(F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * F.col("sign")).alias("v"))))
    mirrored = F.when((F.col("sign") != 0) & (F.col("i") != F.col("j")), both).otherwise(once)
    entries = entry.select("matrix_id", F.explode(mirrored).alias("e")).select("matrix_id", "e.i", "e.j", "e.v")
    return Matrices(entries, heads.select("matrix_id", "rows", "columns"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows (file, begin, items), in order of their place in a split, how many items of the split are before."""
    split, held = None, 0
    for batch in batches:
        many = np.diff(np.asarray(batch.column(2).offsets, np.int64))
        of = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        cuts = [k for k in range(len(of)) if k == 0 or of[k] != of[k - 1]]
        before = np.cumsum(many) - many
        for begin, end in zip(cuts, [*cuts[1:], len(of)]):
            if of[begin] != split:
                split, held = of[begin], 0
            before[begin:end] += held - before[begin]
            held = int(before[end - 1] + many[end - 1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], ["file", "begin", "items", "before"])


def _items(spark: SparkSession, path: str, by: str, pattern: str) -> DataFrame:
    """(nth, item): what the pattern finds in a file, numbered from 0. The text is read in pieces that end with `by`, which are numbered
    within the splits that a task reads, and these by their sums, so that a line as long as the file takes many tasks."""
    read = spark.read.option("lineSep", by).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.regexp_extract_all("value", F.lit(pattern), F.lit(0)).alias("items"))
    sums = read.groupBy("file", "begin").agg(F.sum(F.size("items")).alias("many"))
    upto = Window.orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    base = sums.select(F.col("file").alias("_file"), F.col("begin").alias("_begin"), F.coalesce(F.sum("many").over(upto), F.lit(0)).alias("base"))
    rows = read.mapInArrow(_numbered, "file string, begin long, items array<string>, before long")
    met = rows.join(F.broadcast(base), (F.col("file") == F.col("_file")) & (F.col("begin") == F.col("_begin")))
    return met.select((F.col("base") + F.col("before")).alias("nth"), F.posexplode("items").alias("at", "item")).select((F.col("nth") + F.col("at")).alias("nth"), "item")


def read_pattern(spark: SparkSession, path: str) -> Matrix:
    """A pattern file: `rows,columns,nnz`, row pointers, column indices; values are 1. Only the first line comes to the driver."""
    items = kept(_items(spark, path, " ", r"\n|[^\s,]+"))
    ends = [r.nth for r in items.where("item = '\n'").orderBy("nth").limit(3).collect()]
    head = [int(r["item"]) for r in items.where(F.col("nth") < ends[0]).orderBy("nth").collect()]
    of = lambda k: items.where(F.col("nth") > ends[k - 2]).where(F.col("nth") < ends[k - 1] if k <= len(ends) else F.lit(True)).select((F.col("nth") - ends[k - 2] - 1).alias("pos"), F.col("item").cast("long").alias("x"))
    pointers = of(2).where(F.col("pos") <= head[0])
    upto = pointers.select((F.col("pos") - 1).alias("i"), F.col("x").alias("end"))
    places = spread(pointers.select(F.col("pos").alias("i"), F.col("x").alias("begin")).join(upto, "i"), "begin", "end", "pos")
    return Matrix(places.join(of(3), "pos").select("i", F.col("x").alias("j"), F.lit(1.0).alias("v")), head[0], head[1])


def write_pattern(matrix: Matrix, path: str) -> None:
    """The nonzeros' places as a pattern file."""
    entries = kept(matrix.df.where("v <> 0").select("i", "j"))
    pointers = row_pointers(Matrix(entries, matrix.rows, matrix.columns))
    _write_lines([(f"{matrix.rows},{matrix.columns},{entries.count()}\n", _line(pointers, "ptr", "i"), ""), ("", _line(entries, "j", "i", "j"), "")], path, "")


def pattern_to_matrix_market(spark: SparkSession, path: str, to: str) -> None:
    """A pattern file as a Matrix Market file of ones."""
    write_matrix_market(read_pattern(spark, path), to)


def _line(df: DataFrame, value: str, *order: str, zeros: Column | None = None) -> DataFrame:
    """(o1, o2, value, zeros): the text of one array, a row for each number and the zeros that follow it, by o1 and o2."""
    keys = [F.col(c).cast("long") for c in order] + [F.lit(0).cast("long")] * (2 - len(order))
    return df.select(keys[0].alias("o1"), keys[1].alias("o2"), F.col(value).cast("string").alias("value"), (F.lit(0) if zeros is None else zeros).cast("int").alias("zeros"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (before, value, zeros, after) as text, about TEXT characters in a row, which ends with the space that stands for a tab."""
    for batch in batches:
        begin, value, zeros, after = batch.columns
        size = pc.add(pc.binary_length(value), pc.multiply(zeros, len(ZERO))).to_numpy(zero_copy_only=False)
        for part in groups(size, TEXT):
            of = lambda column: column.slice(part.start, part.stop - part.start)  # noqa: E731, B023
            rows = pc.binary_join_element_wise(of(begin), of(value), pc.binary_repeat(ZERO, of(zeros)), of(after), "")
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), " ")
            yield pa.RecordBatch.from_arrays([joined], ["value"])


def _write_lines(lines: list[tuple[str, DataFrame, str]], path: str, by: str = ",", long: bool = False) -> None:
    """Arrays (o1, o2, value, zeros), each with the text before and after it, as lines of one file, their numbers followed by `by` and a
    space, or, if `long`, with tabs some way apart in place of spaces. What stands between the numbers of two arrays goes to the last before and the
    first after it. Zeros become text where they are written."""
    numbered = [line.select(F.lit(k).alias("line"), "o1", "o2", "value", "zeros") for k, (_, line, _) in enumerate(lines)]
    rows = kept(reduce(DataFrame.unionByName, numbered).withColumn("tie", F.monotonically_increasing_id()))
    order = F.struct("o1", "o2", "tie")
    ends = {r.line: r for r in rows.groupBy("line").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.sum(F.length("value") + F.lit(len(ZERO)) * F.col("zeros").cast("long")).alias("chars")).collect()}
    before, after, text, last = {}, {}, "", None
    for k, (head, _, tail) in enumerate(lines):
        text += ("\n" if k else "") + head
        if k in ends:
            before[ends[k]["first"].tie], text, last = text, "", ends[k]["last"].tie
            after[last] = ""
        if last is not None and not text:
            after[last] += tail
        else:
            text += tail
    if last is None:
        rows = rows.sparkSession.range(1).select(F.lit("").alias("before"), F.lit(text).alias("value"), F.lit("").alias("after"), *[F.lit(0).alias(c) for c in ("line", "o1", "o2", "tie", "zeros")])
    else:
        after[last] += text
        said = lambda of, other: F.coalesce(F.create_map(*[x for tie, text in of.items() for x in (F.lit(tie).cast("long"), F.lit(text))])[F.col("tie")], F.lit(other))
        rows = rows.withColumns({"before": said(before, ""), "after": said(after, by)})
    parts = max(tasks(sum(r.n for r in ends.values())), sum(r.chars for r in ends.values()) // TASK_CHARS)
    order = ["line", "o1", "o2", "tie"]
    if not long:
        return _write(rows.withColumn("value", F.concat("before", "value", F.repeat(F.lit(ZERO), F.col("zeros")), "after")), path, order, parts, " ")
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.select("before", "value", "zeros", "after").mapInArrow(_texts, "value string").write.mode("overwrite").option("lineSep", "\t").text(path)


def write_arrays(spark: SparkSession, arrays: dict[str, str], names: tuple[str, ...], path: str) -> None:
    """Arrays that the driver holds as text."""
    lines = spark.range(len(names)).select(F.col("id").alias("at"), F.element_at(F.array(*[F.lit(f"{name}=[{arrays[name]}]") for name in names]), (F.col("id") + 1).cast("int")).alias("value"))
    _write(lines, path, ["at"], 1)


def write_lines(arrays: dict[str, DataFrame], names: tuple[str, ...], path: str) -> None:
    """Arrays, each a table (o1, o2, value, zeros), as lines name=[...]; they don't pass the driver."""
    _write_lines([(f"{name}=[", arrays[name], "]") for name in names], path, long=True)


def block_lines(matrix: Matrix, members: DataFrame, chosen: DataFrame, rows: DataFrame, columns: DataFrame) -> dict[str, DataFrame]:
    """The arrays of the block formats, each a table (o1, o2, value, zeros). bindx and bpntr describe all blocks, val and
    indx the dense ones; the residual is in CSR form, padded with a zero in the last cell if its row or column is
    unused."""
    bounds = lambda s: _line(s.select("lo").unionByName(s.agg(F.max("hi").alias("lo"))), "lo", "lo")
    pointers = B.strip_pointers(chosen, rows)
    dense = chosen.where("is_dense").select(F.col("dense_ordinal").alias("n"), "size")
    ends = running_sum(dense, "n", "size", "end").select((F.col("n") + 1).alias("n"), "end")
    ends = ends.unionByName(chosen.sparkSession.range(1).select(F.col("id").alias("n"), F.lit(0).cast("long").alias("end")))
    cells = _line(B.gaps(members, chosen, run_cells=CELLS), "v", "bid", "pos", zeros=F.expr("after - pos - 1"))
    rest = B.residual(members, chosen)
    last = rest.agg(F.max("i").alias("i"), F.max("j").alias("j")).where((F.col("i") < matrix.rows - 1) | (F.col("j") < matrix.columns - 1))
    rest = rest.unionByName(last.select(F.lit(matrix.rows - 1).cast("long").alias("i"), F.lit(matrix.columns - 1).cast("long").alias("j"), F.lit(0.0).alias("v")))
    some = rest.agg(F.count("*").alias("some")).where("some > 0").select()  # without residual there are no pointers either
    indptr = _line(row_pointers(Matrix(rest, matrix.rows, matrix.columns)), "ptr", "i").crossJoin(F.broadcast(some))
    return {
        "val": cells,
        "indx": _line(ends, "end", "n"),
        "bindx": _line(chosen, "b", "bid"),
        "rpntr": bounds(rows),
        "cpntr": bounds(columns),
        "bpntrb": _line(pointers, "first", "a"),
        "bpntre": _line(pointers, "last", "a"),
        "csr_val": _line(rest, "v", "i", "j"),
        "indptr": indptr,
        "indices": _line(rest, "j", "i", "j"),
        "ublocks": _line(chosen.where("not is_dense"), "bid", "bid"),
    }


def block_arrays(matrix: Matrix, members: DataFrame, chosen: DataFrame, rows: DataFrame, columns: DataFrame) -> dict[str, str]:
    """block_lines() on the driver, for matrices of that size."""
    return {name: ",".join(r.value + ZERO * r.zeros for r in line.orderBy("o1", "o2").collect()) for name, line in block_lines(matrix, members, chosen, rows, columns).items()}


#: Characters that are looked at together; what separates numbers, and what all but zeros have (no exponent is written without a digit).
PIECE = 1 << 22
SEPARATOR, TELLING = (np.isin(np.arange(256), list(chars)) for chars in (b", \t\r\n", b"123456789abcdfghijklmnopqrstuvwxyzABCDFGHIJKLMNOPQRSTUVWXYZ"))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes, np.ndarray, dict[int, str]]]:
    """Of the text in rows (file, begin, value): its split, pieces of it, where their items begin, and, by their number, the items that are marks:
    the names of arrays where they begin, an empty one where they end."""
    for batch in batches:
        of = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        size = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
        cuts = [k for k in range(len(of)) if k == 0 or of[k] != of[k - 1]]
        for begin, end in zip(cuts, [*cuts[1:], len(of)]):
            for part in groups(size[begin:end] + 1, PIECE):
                rows = batch.column(2).slice(begin + part.start, part.stop - part.start)
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), ",")[0].as_buffer().to_pybytes()
                at = 0
                while at < len(text):
                    # a long row goes on after a number
                    upto = len(text) if len(text) - at <= PIECE else (text.rfind(b",", at, at + PIECE) + 1 or text.find(b",", at + PIECE) + 1 or len(text))
                    piece, at, names = text[at:upto], upto, {}
                    if b"[" in piece or b"]" in piece:
                        piece = piece.replace(b"[", b"[ ").replace(b"]", b" ] ")
                        for mark in re.finditer(rb"(\w+)\s*=\s*\[|\]", piece):
                            names[mark.end() - 1] = (mark[1] or b"").decode()
                        piece = re.sub(rb"\w+\s*=\s*\[", lambda mark: b" " * (len(mark[0]) - 1) + b"]", piece)
                    apart = SEPARATOR[np.frombuffer(piece, np.uint8)]
                    starts = np.flatnonzero(~apart & np.r_[True, apart[:-1]])
                    yield of[begin], piece, starts, {int(np.searchsorted(starts, k)): name for k, name in names.items()}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, begin, at, name): the items of each split, where name is null, and its marks by their number in it."""
    for split, group in groupby(_marked(batches), key=lambda found: found[0]):
        rows, many = [], 0
        for _, _, starts, names in group:
            rows += [(many + k, name) for k, name in names.items()]
            many += len(starts)
        rows.append((many, None))
        columns = [pa.array([split[0]] * len(rows), pa.string()), pa.array([split[1]] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["file", "begin", "at", "name"])


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(name, pos, v) of every array in a block file, without the zeros of val and csr_val. Where the arrays begin and end, and a row for each split that a
    task reads, come to the driver. The text is read in pieces, up to the tabs in a folder of parts and up to the commas in a single file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    parts = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    read = spark.read.option("lineSep", "\t" if parts else ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")
    found = read.mapInArrow(_counted, "file string, begin long, at long, name string").collect()
    base, many = {}, 0
    for r in sorted((r for r in found if r.name is None), key=lambda r: (r.file, r.begin)):
        base[r.file, r.begin], many = many, many + r.at
    marks = sorted((base[r.file, r.begin] + r.at, r.name) for r in found if r.name is not None)
    arrays = [(here + 1, there, name) for (here, name), (there, end) in zip(marks, marks[1:]) if name and not end]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for split, group in groupby(_marked(batches), key=lambda found: found[0]):
            at = base[split]
            for _, text, starts, _ in group:
                for low, high, name in arrays:
                    begin, end = max(low - at, 0), min(high - at, len(starts))
                    if begin >= end:
                        continue
                    mine = np.arange(begin, end)
                    if name in ("val", "csr_val"):
                        last = int(starts[end]) if end < len(starts) else len(text)
                        telling = np.flatnonzero(TELLING[np.frombuffer(text, np.uint8, last - int(starts[begin]), int(starts[begin]))]) + starts[begin]
                        mine = np.unique(np.searchsorted(starts, telling, side="right") - 1)
                    if len(mine):
                        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(text)].astype(np.int32)), pa.py_buffer(text)).take(pa.array(mine))
                        v = pc.ascii_ltrim(pc.ascii_rtrim(words, ", \t\r\n]"), "+").cast(pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.repeat(name, len(mine)), pa.array(mine + at - low), v], ["name", "pos", "v"])
                at += len(starts)

    return read.mapInArrow(run, "name string, pos long, v double")


def read_blocks(spark: SparkSession, path: str) -> Matrix:
    """The matrix in a block file, with or without a sparse part: entries of dense blocks and of the residual."""
    arrays = kept(read_arrays(spark, path))
    of = lambda name, column: arrays.where(F.col("name") == name).select("pos", F.col("v").alias(column))
    bounds = lambda name, s, lo, hi: of(name, lo).join(of(name, hi).select((F.col("pos") - 1).alias("pos"), hi), "pos").select(F.col("pos").alias(s), F.col(lo).cast("long").alias(lo), F.col(hi).cast("long").alias(hi))
    first, last = of("bpntrb", "x").withColumnRenamed("pos", "a"), of("bpntre", "y").withColumnRenamed("pos", "a")
    numbered = spread(first.join(last, "a").where("x >= 0"), F.col("x").cast("long"), F.col("y").cast("long"), "bid").select("a", "bid")
    columns = of("bindx", "b").select(F.col("pos").alias("bid"), F.col("b").cast("long").alias("b"))
    left_out = of("ublocks", "u").select(F.col("u").cast("long").alias("bid"))
    dense = numbered.join(columns, "bid").join(left_out, "bid", "left_anti")
    dense = running_sum(dense.withColumn("one", F.lit(1).cast("long")), "bid", "one", "n").withColumn("n", F.col("n") - 1)
    offset = bounds("indx", "n", "begin", "end")
    placed = kept(dense.join(offset, "n").join(bounds("rpntr", "a", "r0", "r1"), "a").join(bounds("cpntr", "b", "c0", "c1"), "b").withColumnsRenamed({"begin": "lo", "end": "hi"}))
    # only nonzeros are there, and each is in one block
    at = binned(of("val", "v").where("v <> 0"), "pos", placed.withColumn("begin", F.col("lo")), ["begin", "r0", "r1", "c0"])
    inside = F.col("pos") - F.col("begin")
    entries = at.select((F.col("r0") + inside % (F.col("r1") - F.col("r0"))).alias("i"), (F.col("c0") + F.floor(inside / (F.col("r1") - F.col("r0")))).alias("j"), "v")
    spans = spread(bounds("indptr", "i", "begin", "end"), "begin", "end", "pos").select("i", "pos")
    rest = spans.join(of("indices", "j"), "pos").join(of("csr_val", "v"), "pos").where("v <> 0").select("i", F.col("j").cast("long").alias("j"), "v")
    size = arrays.where(F.col("name").isin("rpntr", "cpntr")).groupBy("name").agg(F.max("v").alias("n")).collect()
    n = {r.name: int(r.n) for r in size}
    return Matrix(entries.unionByName(rest), n["rpntr"], n["cpntr"])


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(j, x) of comma-separated numbers on one line, with or without a name and brackets."""
    return _numbers(spark, path).select(F.col("pos").cast("long").alias("j"), "x")


def read_dense(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(j, k, x) of a row-major matrix of the given width on one line."""
    return _numbers(spark, path).select(F.expr(f"pos div {width}").alias("j"), (F.col("pos") % width).cast("long").alias("k"), "x")


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    items = _items(spark, path, ",", r"\w+\s*=\s*\[|\[|\]|[^\s,\[\]=]+")
    marks = items.where(F.col("item").endswith("[") | (F.col("item") == "]")).orderBy("nth").limit(2).collect()
    begin = marks[0].nth + 1 if marks else 0
    inside = (F.col("nth") >= begin) & (F.col("nth") < marks[1].nth if len(marks) > 1 else F.lit(True))
    return items.where(inside).select((F.col("nth") - begin).alias("pos"), F.col("item").cast("double").alias("x"))


def write_dense(values: DataFrame, path: str, *order: str) -> None:
    """One comma-separated line of column x in the given order."""
    _write_lines([("", _line(values, "x", *order), "")], path)


def write_result(y: DataFrame, path: str) -> None:
    """One value of y a line, by row."""
    rows = kept(y.select(F.col("i").cast("long").alias("at"), F.format_string("%f", F.col("y")).alias("value")))
    _write(rows, path, ["at"], tasks(rows.count()))


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """(name, rep, t) of headerless lines name,t1,t2,... of any length."""
    fields = F.split("value", ",")
    rows = spark.read.text(path).select(F.trim(fields[0]).alias("name"), F.posexplode(F.slice(fields, F.lit(2), F.size(fields))).alias("rep", "t"))
    return rows.select("name", F.col("rep").cast("long").alias("rep"), F.expr("try_cast(trim(t) as double)").alias("t")).where("t is not null")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header, such as threshold training rows."""
    return spark.read.csv(path, header=True, schema=schema)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
