"""Variable-size blocks: entries grouped by row strip and column strip, stored densely or left sparse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stripmill.operators.coo import Matrix
from stripmill.operators.interval import Uniform, located
from stripmill.operators.kernel import block_products, by_columns, entries_of_tiles, filled, nonzeros, row_products, tile_products, unpacked, wide_rows
from stripmill.operators.running import CHUNK, running_sum, spread
from stripmill.sources.scratch import kept

#: Cells of the largest array; larger blocks are stored as several.
LARGEST = 1 << 22
#: Rows and columns of the pieces that products work on.
SIDE = 1 << 10
#: Cells that one task returns, about.
TASK_CELLS = 1 << 24


def assigned(entries: DataFrame, rows: DataFrame | Uniform, columns: DataFrame | Uniform, keys: tuple[str, ...] = ()) -> DataFrame:
    """Nonzeros with their block (a, b), its bounds r0 r1 c0 c1 and their address in it, column by column.

    Here and below keys, such as matrix_id, name the columns that keep several matrices in one table apart."""
    met = located(located(entries.where("v <> 0"), "i", rows, ("a", "r0", "r1"), keys), "j", columns, ("b", "c0", "c1"), keys)
    address = (F.col("j") - F.col("c0")) * (F.col("r1") - F.col("r0")) + F.col("i") - F.col("r0")
    return met.select(*keys, "a", "b", "i", "j", "v", "r0", "r1", "c0", "c1", address.alias("pos"))


def _in_strips(blocks: DataFrame, values: dict[str, Column], keys: tuple[str, ...]) -> DataFrame:
    """Adds, for each named value, its sum over all blocks up to this one, by row strip, then column strip:
    sums of the row strips run on in two levels, so that neither many strips nor a long one meet in one task."""
    per = blocks.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("a").alias("_a")).agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    base = running_sum(per, "_a", [f"_{n}" for n in values], [f"_upto_{n}" for n in values], tuple(f"_{k}" for k in keys))
    own = Window.partitionBy(*keys, "a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cond = F.col("a") == F.col("_a")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    met = blocks.withColumns({f"_own_{n}": F.sum(v).over(own) for n, v in values.items()}).join(base, cond)
    return met.select(*blocks.columns, *[(F.col(f"_upto_{n}") - F.col(f"_{n}") + F.col(f"_own_{n}")).alias(n) for n in values])


def stats(members: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bid, a, b, r0, r1, c0, c1, nnz, size, offset) of the blocks that have a nonzero, numbered by
    row strip, then column strip; offset is where a block's cells begin."""
    blocks = members.groupBy(*keys, "a", "b").agg(F.first("r0").alias("r0"), F.first("r1").alias("r1"), F.first("c0").alias("c0"), F.first("c1").alias("c1"), F.count("*").alias("nnz"))
    blocks = blocks.withColumn("size", (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0")))
    numbered = _in_strips(blocks, {"nth": F.lit(1).cast("long"), "upto": F.col("size")}, keys)
    return numbered.select(*keys, (F.col("nth") - 1).alias("bid"), "a", "b", "r0", "r1", "c0", "c1", "nnz", "size", (F.col("upto") - F.col("size")).alias("offset"))


def densities(members: DataFrame, rule: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Blocks that have a nonzero, with nnz, size and is_dense, but without the numbers of stats() and split(), which products don't need."""
    blocks = members.groupBy(*keys, "a", "b").agg(*[F.first(c).alias(c) for c in ("r0", "r1", "c0", "c1")], F.count("*").alias("nnz"))
    return blocks.withColumn("size", (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0"))).withColumn("is_dense", rule)


def strip_pointers(blocks: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, first, last) block numbers of every row strip, from first to before last; -1 where it has none."""
    per = blocks.groupBy(*keys, F.col("a").alias("strip")).agg(F.min("bid").alias("x"), (F.max("bid") + 1).alias("y"))
    found = rows.join(per, [*keys, "strip"], "left")
    return found.select(*keys, F.col("strip").alias("a"), F.coalesce("x", F.lit(-1)).alias("first"), F.coalesce("y", F.lit(-1)).alias("last"))


def is_dense(density: float) -> Column:
    """Share of nonzeros above a percentage: 0 makes every block dense, 100 none."""
    return F.col("nnz") * 100.0 / F.col("size") > density


def is_dense_floor(density: float) -> Column:
    """As is_dense, against the rounded-down number of cells."""
    return F.col("nnz") > F.floor(F.col("size") * density / 100)


def split(blocks: DataFrame, rule: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Blocks with is_dense, and dense_ordinal: the number among the dense ones, null for others."""
    chosen = blocks.withColumn("is_dense", rule)
    numbered = _in_strips(chosen, {"nth": F.col("is_dense").cast("long")}, keys)
    return numbered.select(*chosen.columns, F.when(F.col("is_dense"), F.col("nth") - 1).alias("dense_ordinal"))


def residual(members: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, v) of the nonzeros outside dense blocks."""
    dense = chosen.where("is_dense").select(*keys, "a", "b")
    return members.join(dense, [*keys, "a", "b"], "left_anti").select(*keys, "i", "j", "v")


def pieces(chosen: DataFrame) -> DataFrame:
    """Dense blocks, those over LARGEST cut into runs of whole columns, or of a part of one column, that
    keep to it; r0 r1 c0 c1 and size are the piece's, `first` is the address in the block where it begins."""
    names = dict(high="r1 - r0", tall=f"least(r1 - r0, {LARGEST})", wide=f"greatest(1, {LARGEST} div (r1 - r0))")
    dense = chosen.where("is_dense").selectExpr("*", *[f"{e} AS _{n}" for n, e in names.items()])
    cut = dense.withColumn("_c", F.explode(F.expr("sequence(c0, c1 - 1, _wide)"))).withColumn("_r", F.explode(F.expr("sequence(r0, r1 - 1, _tall)")))
    own = dict(r0="_r", r1="least(r1, _r + _tall)", c0="_c", c1="least(c1, _c + _wide)", size="(least(r1, _r + _tall) - _r) * (least(c1, _c + _wide) - _c)")
    return cut.selectExpr(*[f"{own[c]} AS {c}" if c in own else c for c in chosen.columns], "(_c - c0) * _high + _r - r0 AS first")


def packed(members: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = (), cut: DataFrame | None = None) -> DataFrame:
    """Dense blocks, in pieces(), which may be given, with `cells`: their values as doubles in binary, column by column, zeros included.

    Only members of dense blocks are gathered, at most LARGEST of them in one row."""
    dense = members.join(chosen.where("is_dense").select(*keys, "a", "b"), [*keys, "a", "b"], "left_semi")
    # a member's piece follows from its block's bounds: the same steps as in pieces(), so that the join is an equi-join
    high, pos = F.col("r1") - F.col("r0"), F.col("pos")
    column, row = F.expr("pos div (r1 - r0)"), F.col("pos") % high
    tall, wide = F.least(high, F.lit(LARGEST)), F.greatest(F.lit(1), F.floor(F.lit(LARGEST) / high))
    first = (column - column % wide) * high + row - row % tall
    # inside of the piece, whose columns are as high as it is
    c0, r0 = column - column % wide, row - row % tall
    at = (column - c0) * F.least(tall, high - r0) + row - r0
    cells = dense.select(*keys, "a", "b", first.cast("long").alias("first"), F.struct(at.cast("int").alias("at"), "v").alias("cell")).groupBy(*keys, "a", "b", "first").agg(F.collect_list("cell").alias("_cells"))
    met = (pieces(chosen) if cut is None else cut).join(cells, [*keys, "a", "b", "first"], "left").select(*chosen.columns, "first", F.col("_cells.at").alias("_at"), F.col("_cells.v").alias("_v"))
    return filled(met)


def values(members: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """As packed(), with the cells as an array `vals`."""
    return unpacked(packed(members, chosen, keys))


def gaps(members: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = (), run_cells: int | None = None) -> DataFrame:
    """(keys, bid, pos, after, v): the cells of dense blocks as a value and zeros, which stand from pos + 1 to before after.

    Blocks are cut into runs of CHUNK places, or as many as given. A run's nonzeros and its first place are put in order, and each returns itself and
    the next: what is shuffled and sorted grows with the nonzeros and the runs, and tasks grow in number with the cells."""
    many = run_cells or CHUNK
    spark, dense = members.sparkSession, chosen.where("is_dense")
    whole = dense.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), whole // TASK_CELLS)
    run = [*keys, "a", "b", "run"]
    begins = spread(dense.select(*keys, "a", "b", "bid", "size"), F.lit(0).cast("long"), F.expr(f"(size - 1) div {many} + 1"), "run")
    begins = begins.select(*run, (F.col("run") * many).alias("pos"), F.lit(0.0).alias("v"), "bid", "size")
    met = begins.unionByName(members.select(*keys, "a", "b", F.expr(f"pos div {many}").alias("run"), "pos", F.col("v").cast("double").alias("v")), allowMissingColumns=True)
    # entries of one place add up; runs of blocks that aren't dense have no first place and so no number
    placed = met.repartition(parts, *run).groupBy(*run, "pos").agg(F.sum("v").alias("v"), F.max("bid").alias("bid"), F.max("size").alias("size"))
    upto = Window.partitionBy(*run).orderBy("pos")
    first = lambda c: F.first(c).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    after = F.coalesce(F.lead("pos").over(upto), F.least(first("size"), (F.col("run") + 1) * many))
    return placed.select(*keys, first("bid").alias("bid"), "pos", after.alias("after"), "v").where("bid IS NOT NULL")


def cells(members: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bid, pos, v) of every cell of dense blocks, zeros included, which are made from gaps() where they are returned."""
    found = gaps(members, chosen, keys).withColumnRenamed("pos", "_at")
    made = found.select(*keys, "bid", "_at", "v", F.explode(F.sequence("_at", F.col("after") - 1)).alias("pos"))
    return made.select(*keys, "bid", "pos", F.when(F.col("pos") == F.col("_at"), F.col("v")).otherwise(0.0).alias("v"))


def tiled(members: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Dense blocks for products: (keys, r0, r1, c0, c1, _at, _v), pieces of SIDE rows and columns at most with the places and values of
    their nonzeros, from which tasks fill tiles. Pieces without a nonzero are left out, as nothing comes of them."""
    return _in_pieces(members.join(chosen.where("is_dense").select(*keys, "a", "b"), [*keys, "a", "b"], "left_semi"), keys)


def _in_pieces(members: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pieces of whatever blocks the members (keys, i, j, v, r0, r1, c0, c1) are in."""
    corner = members.selectExpr(*keys, f"i - (i - r0) % {SIDE} AS r", f"j - (j - c0) % {SIDE} AS c", "r1", "c1", "i", "j", "v")
    bound = corner.selectExpr(*keys, "r AS r0", f"least(r1, r + {SIDE}) AS r1", "c AS c0", f"least(c1, c + {SIDE}) AS c1", "i", "j", "v")
    cell = F.struct(F.expr("cast((j - c0) * (r1 - r0) + i - r0 AS int)").alias("at"), F.col("v").cast("double").alias("v"))
    met = bound.groupBy(*keys, "r0", "r1", "c0", "c1").agg(F.collect_list(cell).alias("_cells"))
    return met.select(*keys, "r0", "r1", "c0", "c1", F.col("_cells.at").alias("_at"), F.col("_cells.v").alias("_v"))


def ranges(chosen: DataFrame) -> DataFrame:
    """(c0, c1) of the pieces in tiled()."""
    cut = chosen.where("is_dense").select("c0", "c1").distinct().selectExpr("c1", f"explode(sequence(c0, c1 - 1, {SIDE}L)) AS c0")
    return cut.selectExpr("c0", f"least(c1, c0 + {SIDE}) AS c1").distinct()


def to_coo(blocks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, v) of the nonzeros in blocks with cells or vals, or in pieces as of tiled()."""
    return entries_of_tiles(blocks, keys) if "_at" in blocks.columns else nonzeros(blocks, keys)


def hybrid_entries(members: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Nonzeros of dense blocks, read from their tiles, and the residual's."""
    return to_coo(tiled(members, chosen, keys), keys).unionByName(residual(members, chosen, keys))


def hybrid_spmv(members: DataFrame, chosen: DataFrame, x: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, y): dense blocks are multiplied as blocks, the residual by a join; their partial sums meet in one aggregation."""
    dense = tile_products(tiled(members, chosen, keys), x, 1, keys, ranges(chosen)).select(*keys, "i", F.col("ys")[0].alias("y"))
    rest = residual(members, chosen, keys).join(x, "j").select(*keys, "i", (F.col("v") * F.col("x")).alias("y"))
    return dense.unionByName(rest).groupBy(*keys, "i").agg(F.sum("y").alias("y"))


def hybrid_spmm_wide(members: DataFrame, chosen: DataFrame, x: DataFrame, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, k, y) for a right matrix whose rows are arrays (j, xs) of the given width, as hybrid_spmv(). The residual is added up by row_products(),
    partial sums of dense blocks meet it as rows of the width, and become a row for each column only in the result."""
    dense = tile_products(tiled(members, chosen, keys), x, width, keys, ranges(chosen))
    rest = row_products(residual(members, chosen, keys), x, width, keys)
    sums = [F.sum(F.col("ys")[k]).alias(f"y{k}") for k in range(width)]
    whole = dense.unionByName(rest).groupBy(*keys, "i").agg(*sums)
    return by_columns(whole.select(*keys, "i", F.array(*[f"y{k}" for k in range(width)]).alias("ys")), keys)


def hybrid_spmm(members: DataFrame, chosen: DataFrame, x: DataFrame, keys: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """(keys, i, k, y) for a right matrix (j, k, x) with columns 0 to width - 1, which are counted if not given; absent means zero."""
    width = width or (x.agg(F.max("k")).first()[0] or 0) + 1
    return hybrid_spmm_wide(members, chosen, wide_rows(x, width), width, keys)


def kernel_spmv(blocks: DataFrame, x: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """(i, y) of blocks with cells or vals, or of pieces as of tiled(), all treated as dense; ranges (c0, c1) of their columns, if they are known otherwise."""
    return (tile_products if "_at" in blocks.columns else block_products)(blocks, x, 1, (), ranges).groupBy("i").agg(F.sum(F.col("ys")[0]).alias("y"))


def strip_work(chosen: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, work): cells that the dense blocks of each row strip operate on."""
    return chosen.groupBy(*keys, "a").agg(F.sum(F.when(F.col("is_dense"), F.col("size")).otherwise(0)).alias("work"))


def report(chosen: DataFrame, cells: int | DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Nonzeros, extra operations, blocks, dense blocks, and the share of the matrix's cells that
    nonzeros are and that is operated on. With keys, cells is a table (keys, cells) and there is a row for each matrix."""
    operated = F.sum(F.when(F.col("is_dense"), F.col("size")).otherwise(F.col("nnz")))
    found = chosen.groupBy(*keys).agg(F.sum("nnz").alias("nnz"), operated.alias("operated"), F.count("*").alias("num_blocks"), F.sum(F.col("is_dense").cast("long")).alias("num_dense_blocks"))
    found = found.join(cells, list(keys)) if keys else found.withColumn("cells", F.lit(cells))
    share = lambda c: F.round(F.col(c) / F.col("cells").cast("double"), 2)
    return found.select(*keys, "nnz", (F.col("operated") - F.col("nnz")).alias("extra_nnz"), "num_blocks", "num_dense_blocks", share("nnz").alias("old_density"), share("operated").alias("new_density"))


def blocked(matrix: Matrix, rows: DataFrame | Uniform, columns: DataFrame | Uniform) -> tuple[DataFrame, DataFrame]:
    """Members and blocks of a matrix under given strips."""
    return blocked_all(matrix.df, rows, columns, ())


def blocked_all(entries: DataFrame, rows: DataFrame | Uniform, columns: DataFrame | Uniform, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """As blocked(), for many matrices in one table."""
    members = assigned(entries, rows, columns, keys)
    return members, stats(members, keys)


def stored(members: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Members and blocks, written once: products and files read them several times."""
    members = kept(members)
    return members, kept(stats(members, keys))
