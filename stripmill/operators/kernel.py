"""Products of dense blocks as blocks: cells in binary, multiplied in Arrow batches, many of one shape at once.

A block's row holds its bounds r0 r1 c0 c1 and its cells column by column. Blocks meet slices of the right side by an equi-join on their
columns; each batch adds up what its blocks give to the same rows before it returns them. One row high and one column wide are shapes
like any other.

Products that need no stored zeros take pieces of blocks with the places and values of their nonzeros: a task fills those tiles of a piece that
have a nonzero, so that the work grows with the nonzeros and not with the cells of blocks, and multiplies the tiles as dense ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripmill.operators.running import spread

#: Cells that are worked on together.
CELLS = 1 << 22
#: Rows and columns of a tile.
TILE = 8
#: Rows that one task adds up at a time.
BAND = 1 << 14


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., for length[0] numbers; then the same from start[1], and so on."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def doubles(column: pa.BinaryArray | pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of doubles, in binary or in arrays, and where each row's begin; one more for the end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes() if offsets[0] % 8 else data, np.float64), (offsets - offsets[0]) // 8


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of arrays, and how many each row has; a null has none."""
    column = batch.column(batch.schema.get_field_index(name))
    many = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), many


def groups(size: np.ndarray, most: int) -> Iterator[slice]:
    """Rows in order, cut so that sizes add up to at most `most`, or one row is alone."""
    begin, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > begin and held + n > most:
            yield slice(begin, k)
            begin, held = k, 0
        held += n
    if begin < len(size):
        yield slice(begin, len(size))


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in groups(numbers(batch, "size"), CELLS):
            rows = batch.slice(part.start, part.stop - part.start)
            size = numbers(rows, "size").astype(np.int64)
            begin = np.cumsum(size) - size
            at, many = lists(rows, "_at")
            v, _ = lists(rows, "_v")
            # entries of one place add up
            cells = np.bincount(np.repeat(begin, many) + at, weights=v, minlength=int(size.sum())) if len(v) else np.zeros(int(size.sum()))
            offsets = np.r_[begin, size.sum()] * 8
            binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(cells)])
            kept = [k for k, f in enumerate(rows.schema) if f.name not in ("_at", "_v")]
            yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in kept], binary], names=[*[rows.schema.field(k).name for k in kept], "cells"])


def filled(blocks: DataFrame) -> DataFrame:
    """Blocks (size, _at, _v, ...) with `cells` in place of the nonzeros' places and values."""
    kept = [f for f in blocks.schema.fields if f.name not in ("_at", "_v")]
    return blocks.mapInArrow(_fill, T.StructType([*kept, T.StructField("cells", T.BinaryType())]))


def unpacked(blocks: DataFrame) -> DataFrame:
    """Blocks with an array `vals` in place of `cells`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("cells")
            data, offsets = doubles(batch.column(at))
            vals = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(data))
            yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(batch.columns) if k != at], vals], names=[*[n for n in batch.schema.names if n != "cells"], "vals"])

    kept = [f for f in blocks.schema.fields if f.name != "cells"]
    return blocks.mapInArrow(run, T.StructType([*kept, T.StructField("vals", T.ArrayType(T.DoubleType()))]))


def nonzeros(blocks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, v) of the nonzeros in blocks with cells or vals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = doubles(batch.column(batch.schema.get_field_index("cells")))
            at = np.flatnonzero(data)
            row = np.searchsorted(offsets, at, side="right") - 1
            r0, r1, c0 = (numbers(batch, n) for n in ("r0", "r1", "c0"))
            pos, high = at - offsets[row], (r1 - r0)[row]
            named = [batch.column(batch.schema.get_field_index(k)).take(pa.array(row)) for k in keys]
            yield pa.RecordBatch.from_arrays([*named, pa.array(r0[row] + pos % high), pa.array(c0[row] + pos // high), pa.array(data[at])], names=[*keys, "i", "j", "v"])

    schema = T.StructType([*[blocks.schema[k] for k in keys], T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("v", T.DoubleType())])
    return blocks.select(*keys, "r0", "r1", "c0", _cells(blocks)).mapInArrow(run, schema)


def _tiles(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, row, column, cells) of the tiles with a nonzero in pieces r0 r1 c0 c1 with places `_at`, column by column, and values `_v`: a tile's
    first row and column in its piece, and its cells by column. Entries of one place add up."""
    at, many = lists(rows, "_at")
    v, _ = lists(rows, "_v")
    high, wide = numbers(rows, "r1") - numbers(rows, "r0"), numbers(rows, "c1") - numbers(rows, "c0")
    down = -(-high // TILE)
    most = down * -(-wide // TILE)
    base, of = np.cumsum(most) - most, np.repeat(np.arange(len(many)), many)
    row, column = at % high[of], at // high[of]
    tile, which = np.unique(base[of] + column // TILE * down[of] + row // TILE, return_inverse=True)
    cells = np.bincount((which * TILE + column % TILE) * TILE + row % TILE, weights=v, minlength=len(tile) * TILE * TILE).reshape(-1, TILE, TILE)
    piece = np.searchsorted(base, tile, side="right") - 1
    return piece, (tile - base[piece]) % down[piece] * TILE, (tile - base[piece]) // down[piece] * TILE, cells


def _held(batch: pa.RecordBatch, width: int = 0) -> np.ndarray:
    """Numbers that working on each piece takes: tiles, their part of the right side and of the result."""
    high, wide = numbers(batch, "r1") - numbers(batch, "r0"), numbers(batch, "c1") - numbers(batch, "c0")
    _, many = lists(batch, "_at")
    return np.minimum(many, -(-high // TILE) * -(-wide // TILE)) * TILE * (TILE + 2 * width) + wide * width


def entries_of_tiles(pieces: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, v) of the nonzeros in the tiles of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(_held(batch), CELLS):
                rows = batch.slice(part.start, part.stop - part.start)
                piece, row, column, cells = _tiles(rows)
                tile, c, r = np.nonzero(cells)
                of = piece[tile]
                named = [rows.column(rows.schema.get_field_index(k)).take(pa.array(of)) for k in keys]
                yield pa.RecordBatch.from_arrays([*named, pa.array(numbers(rows, "r0")[of] + row[tile] + r), pa.array(numbers(rows, "c0")[of] + column[tile] + c), pa.array(cells[tile, c, r])], names=[*keys, "i", "j", "v"])

    schema = T.StructType([*[pieces.schema[k] for k in keys], T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("v", T.DoubleType())])
    return pieces.select(*keys, "r0", "r1", "c0", "c1", "_at", "_v").mapInArrow(run, schema)


def _tile_sums(rows: pa.RecordBatch, width: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, i, y) of pieces against the rows of the right side that they have; only of rows with a nonzero that meets one."""
    piece, row, column, cells = _tiles(rows)
    wide = -(-(numbers(rows, "c1") - numbers(rows, "c0")) // TILE) * TILE
    base = np.cumsum(wide) - wide
    at, many = lists(rows, "_xat")
    x, there = np.zeros((int(wide.sum()), width)), np.zeros(int(wide.sum()), bool)
    place = np.repeat(base, many) + at
    x[place], there[place] = lists(rows, "_xs")[0].reshape(-1, width), True
    # tiles of one key and the same rows are added up
    code, which = np.unique(np.stack([key[piece], numbers(rows, "r0")[piece] + row], axis=1), axis=0, return_inverse=True)
    order = np.argsort(which.reshape(-1), kind="stable")
    sums, met = np.zeros((len(code), TILE, width)), np.zeros((len(code), TILE), bool)
    for begin in range(0, len(order), step := max(1, CELLS // (TILE * (TILE + 2 * width)))):
        mine = order[begin : begin + step]
        right = (base[piece[mine]] + column[mine])[:, None] + np.arange(TILE)
        y = np.matmul(cells[mine].transpose(0, 2, 1), x[right])
        here = ((cells[mine] != 0) & there[right][:, :, None]).any(axis=1)
        to = which.reshape(-1)[mine]
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        sums[to[cuts]] += np.add.reduceat(y, cuts)
        met[to[cuts]] |= np.logical_or.reduceat(here, cuts)
    one, r = np.nonzero(met)
    return code[one, 0], code[one, 1] + r, sums[one, r]


def tile_products(pieces: DataFrame, x: DataFrame, width: int, keys: tuple[str, ...] = (), ranges: DataFrame | None = None) -> DataFrame:
    """As block_products(), of pieces (keys, r0, r1, c0, c1, _at, _v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(_held(batch, width), CELLS):
                rows = batch.slice(part.start, part.stop - part.start)
                named = list(zip(*(rows.column(rows.schema.get_field_index(k)).to_pylist() for k in keys))) if keys else [()] * rows.num_rows
                numbered = {name: k for k, name in enumerate(dict.fromkeys(named))}
                names = list(numbered)
                key, i, y = _tile_sums(rows, width, np.array([numbered[n] for n in named]))
                ys = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * width, pa.int32()), pa.array(y.reshape(-1)))
                own = [pa.array([names[n][c] for n in key.tolist()], rows.schema.field(k).type) for c, k in enumerate(keys)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(i), ys], names=[*keys, "i", "ys"])

    right = slices(pieces if ranges is None else ranges, x).withColumnRenamed("_at", "_xat")
    met = pieces.select(*keys, "r0", "r1", "c0", "c1", "_at", "_v").join(right, ["c0", "c1"])
    schema = T.StructType([*[pieces.schema[k] for k in keys], T.StructField("i", T.LongType()), T.StructField("ys", T.ArrayType(T.DoubleType()))])
    return met.mapInArrow(run, schema)


def row_products(entries: DataFrame, x: DataFrame, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, ys): the rows of entries (keys, i, j, v) times x, (j, xs) with arrays of the given width. Rows are added up in bands of BAND: a row of x
    goes once to each band that has an entry for it, and not with each entry, and a band's sums are held by one task."""
    band = F.expr(f"i div {BAND}").alias("_band")
    entry = F.struct(F.expr(f"cast(i % {BAND} AS int)").alias("at"), F.col("v").cast("double").alias("v"))
    lines = entries.groupBy(*keys, band, "j").agg(F.collect_list(entry).alias("_cells"))
    met = lines.join(x.select("j", F.col("xs").cast("array<double>").alias("_xs")), "j").select(*keys, "_band", F.col("_cells.at").alias("_at"), F.col("_cells.v").alias("_v"), "_xs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, there = None, np.zeros((BAND, width)), np.zeros(BAND, bool)

        def ended() -> Iterator[pa.RecordBatch]:
            rows = np.flatnonzero(there)
            for begin in range(0, len(rows), step := max(1, CELLS // width)):
                mine = rows[begin : begin + step]
                ys = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1) * width, pa.int32()), pa.array(sums[mine].reshape(-1)))
                own = [pa.array([value] * len(mine), kind) for value, kind in zip(now, kinds)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(mine + now[-1] * BAND), ys], names=[*keys, "i", "ys"])
            sums[there], there[:] = 0, False

        for batch in batches:
            kinds = [batch.column(k).type for k in range(len(keys))]
            of = list(zip(*(column.to_pylist() for column in batch.columns[: len(keys) + 1])))
            cuts = [k for k in range(len(of)) if k == 0 or of[k] != of[k - 1]]
            for begin, end in zip(cuts, [*cuts[1:], len(of)]):
                if of[begin] != now:
                    if now is not None:
                        yield from ended()
                    now = of[begin]
                same = batch.slice(begin, end - begin)
                for part in groups(lists(same, "_at")[1] * width, CELLS // 4):
                    rows = same.slice(part.start, part.stop - part.start)
                    (at, many), (v, _), (right, _) = (lists(rows, name) for name in ("_at", "_v", "_xs"))
                    order = np.argsort(at, kind="stable")
                    line = np.repeat(np.arange(len(many)), many)[order]
                    first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
                    to = at[order][first]
                    sums[to] += np.add.reduceat(v[order, None] * right.reshape(-1, width)[line], first)
                    there[to] = True
        if now is not None:
            yield from ended()

    schema = T.StructType([*[entries.schema[k] for k in keys], T.StructField("i", T.LongType()), T.StructField("ys", T.ArrayType(T.DoubleType()))])
    return met.repartition(*keys, "_band").sortWithinPartitions(*keys, "_band").mapInArrow(run, schema)


def _cells(blocks: DataFrame) -> Column:
    return F.col("cells" if "cells" in blocks.columns else "vals").alias("cells")


def slices(blocks: DataFrame, x: DataFrame) -> DataFrame:
    """(c0, c1, _at, _xs): for each range of columns that blocks have the places in it where x has a row, and those rows,
    one after the other. x is (j, x), or (j, xs) with arrays."""
    points = spread(blocks.select("c0", "c1").distinct(), "c0", "c1", "j").join(x, "j")
    value = F.array(F.col("x").cast("double")) if "x" in x.columns else F.col("xs").cast("array<double>")
    met = points.groupBy("c0", "c1").agg(F.collect_list(F.struct((F.col("j") - F.col("c0")).cast("int").alias("at"), value.alias("xs"))).alias("_rows"))
    return met.select("c0", "c1", F.col("_rows.at").alias("_at"), F.flatten("_rows.xs").alias("_xs"))


def multiplied(r0: np.ndarray, shapes: np.ndarray, cells: np.ndarray, begin: np.ndarray, at: np.ndarray, many: np.ndarray, xs: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, i, y) of blocks (height, width) whose cells begin at `begin`, against the rows of x that they have, `many` each, at places
    `at`; i only of rows with a nonzero that meets a row of x. Blocks of one key and the same rows are added up."""
    width = xs.shape[1]
    x_begin = np.cumsum(many) - many
    kinds, kind = np.unique(shapes, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    for k, (high, wide) in enumerate(kinds.tolist()):
        mine = np.flatnonzero(kind == k)
        same = np.all(np.diff(begin[mine]) == high * wide)
        v = cells[begin[mine[0]] : begin[mine[-1]] + high * wide] if same else cells[ragged(begin[mine], np.full(len(mine), high * wide))]
        v = v.reshape(len(mine), wide, high)
        right = np.zeros((len(mine), wide, width))
        there = np.zeros((len(mine), wide), bool)
        from_ = ragged(x_begin[mine], many[mine])
        of = np.repeat(np.arange(len(mine)), many[mine])
        right[of, at[from_]] = xs[from_]
        there[of, at[from_]] = True
        y = np.matmul(v.transpose(0, 2, 1), right)
        met = ((v != 0) & there[:, :, None]).any(axis=1)
        rows = np.stack([key[mine], r0[mine]], axis=1)
        one, which = np.unique(rows, axis=0, return_inverse=True)
        which = which.reshape(-1)
        if len(one) < len(mine):
            order = np.argsort(which, kind="stable")
            cuts = np.searchsorted(which[order], np.arange(len(one)))
            rows, y, met = one, np.add.reduceat(y[order], cuts), np.logical_or.reduceat(met[order], cuts)
        block, row = np.nonzero(met)
        yield rows[block, 0], rows[block, 1] + row, y[block, row]


def _multiply(width: int, keys: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = np.stack([numbers(batch, "r1") - numbers(batch, "r0"), numbers(batch, "c1") - numbers(batch, "c0")], axis=1)
            for part in groups(shapes.prod(axis=1) + shapes.sum(axis=1) * width, CELLS):
                rows = batch.slice(part.start, part.stop - part.start)
                named = list(zip(*(rows.column(rows.schema.get_field_index(k)).to_pylist() for k in keys))) if keys else [()] * rows.num_rows
                numbered = {name: k for k, name in enumerate(dict.fromkeys(named))}
                cells, begin = doubles(rows.column(rows.schema.get_field_index("cells")))
                at, many = lists(rows, "_at")
                xs, _ = lists(rows, "_xs")
                names = list(numbered)
                for key, i, y in multiplied(numbers(rows, "r0"), shapes[part], cells, begin[:-1], at, many, xs.reshape(-1, width), np.array([numbered[n] for n in named])):
                    ys = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * width, pa.int32()), pa.array(y.reshape(-1)))
                    own = [pa.array([names[n][c] for n in key.tolist()], rows.schema.field(k).type) for c, k in enumerate(keys)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(i), ys], names=[*keys, "i", "ys"])

    return run


def block_products(blocks: DataFrame, x: DataFrame, width: int, keys: tuple[str, ...] = (), ranges: DataFrame | None = None) -> DataFrame:
    """(keys, i, ys): partial sums of blocks with cells or vals times x, which is (j, x), or (j, xs) with arrays of the given width.
    Ranges have the blocks' (c0, c1), for where reading the blocks for them would cost more."""
    met = blocks.select(*keys, "r0", "r1", "c0", "c1", _cells(blocks)).join(slices(blocks if ranges is None else ranges, x), ["c0", "c1"])
    schema = T.StructType([*[blocks.schema[k] for k in keys], T.StructField("i", T.LongType()), T.StructField("ys", T.ArrayType(T.DoubleType()))])
    return met.mapInArrow(_multiply(width, keys), schema)


def wide_rows(x: DataFrame, width: int) -> DataFrame:
    """(j, xs) of a right matrix (j, k, x) with columns 0 to width - 1; absent means zero, several add up."""
    return x.groupBy("j").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("x"))), F.lit(0.0)) for k in range(width)]).alias("xs"))


def by_columns(parts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, k, y) from partial sums (keys, i, ys)."""
    return parts.select(*keys, "i", F.posexplode("ys").alias("k", "y")).select(*keys, "i", F.col("k").cast("long").alias("k"), "y")
