"""Texture matrices over voxel tables as joins on shifted coordinates, for volumes too large for one task.

Voxels are gathered in cells, BLOCK in a row along z, with the levels beside their ends. Cells meet those of the lines
around them (5 or 9 lines, a constant) by an equi-join on (volume_id, x, y, block), and pairs are read off within a row;
so a voxel moves once, and what moves for the join is a row for each line and cell. The matrices are summed before they
are shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "volume_id"
#: Voxels of a cell.
BLOCK = 8
#: Lines around a voxel's own, and those of them that come first; with its own line they hold the 26 neighbours.
LINES = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
HALF = [d for d in LINES if d >= (0, 0)]


def _cells(voxels: DataFrame) -> DataFrame:
    """volume_id, x, y, b, _0 .. of the region: levels from one before to one behind the cell b of a line, null where there is none."""
    own = voxels.filter("intensity_mask > 0").select(KEY, "x", "y", "g", F.floor(F.col("z") / BLOCK).cast("int").alias("_b"), F.pmod("z", F.lit(BLOCK)).cast("int").alias("_k"))
    place = lambda block, k: F.struct(block.alias("b"), k.cast("int").alias("k"))
    b, k = F.col("_b"), F.col("_k")
    none = F.lit(None).cast("struct<b:int,k:int>")
    beside = F.when(k == 0, place(b - 1, F.lit(BLOCK + 1))).when(k == BLOCK - 1, place(b + 1, F.lit(0))).otherwise(none)
    each = own.select(KEY, "x", "y", "g", F.explode(F.array_compact(F.array(place(b, k + 1), beside))).alias("_at"))
    return each.groupBy(KEY, "x", "y", F.col("_at.b").alias("b")).agg(*[F.max(F.when(F.col("_at.k") == i, F.col("g"))).alias(f"_{i}") for i in range(BLOCK + 2)])


def _met(voxels: DataFrame, lines: list[tuple[int, int]]) -> DataFrame:
    """volume_id, x, y, b, own and other levels (_0 .., o0 ..), same: each cell beside the cells of the lines around it.

    The sizes of exploded tables are guessed far too low, so neither side may be broadcast.
    """
    cells = _cells(voxels)
    some = F.coalesce(*[F.col(f"_{i}") for i in range(1, BLOCK + 1)]).isNotNull()
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in lines]))
    own = cells.filter(some).select("*", around.alias("_d")).select(*cells.columns, (F.col("x") + F.col("_d.dx")).alias("_x"), (F.col("y") + F.col("_d.dy")).alias("_y"))
    other = cells.select(F.col(KEY).alias("_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("b").alias("ob"), *[F.col(f"_{i}").alias(f"o{i}") for i in range(BLOCK + 2)])
    on = (F.col(KEY) == F.col("_id")) & (F.col("_x") == F.col("ox")) & (F.col("_y") == F.col("oy")) & (F.col("b") == F.col("ob"))
    same = (F.col("x") == F.col("ox")) & (F.col("y") == F.col("oy"))
    return own.join(other.hint("merge"), on).select(*cells.columns, *[f"o{i}" for i in range(BLOCK + 2)], same.alias("same"))


def glcm(voxels: DataFrame) -> DataFrame:
    """volume_id, i, j, n over all 13 directions, both ways."""
    pair = lambda i, j: F.when(F.col(f"_{i}").isNotNull() & F.col(f"o{j}").isNotNull() & (F.lit(True) if j > i else ~F.col("same")), F.struct(F.col(f"_{i}").alias("i"), F.col(f"o{j}").alias("j")))
    pairs = F.array_compact(F.array(*[pair(i, i + d) for i in range(1, BLOCK + 1) for d in (-1, 0, 1)]))
    one = _met(voxels, HALF).select(KEY, F.explode(pairs).alias("p")).groupBy(KEY, F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.count("*").alias("n"))
    ways = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return one.select(KEY, ways.alias("p"), "n").groupBy(KEY, F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.sum("n").alias("n"))


def neighbourhood(voxels: DataFrame, alpha: float = 0) -> DataFrame:
    """volume_id, x, y, z, g, neighbours, mean level of the neighbours, dependence (counting itself)."""
    met = _met(voxels, LINES)

    def over(i: int, of) -> Column:  # noqa: ANN001
        """The sum of `of` over the neighbours of the i-th voxel in the other cell."""
        each = [F.when(F.col(f"o{i + d}").isNotNull() & (F.lit(True) if d else ~F.col("same")), of(F.col(f"o{i + d}"))).otherwise(F.lit(0)) for d in (-1, 0, 1)]
        return F.sum(each[0] + each[1] + each[2])

    inner = range(1, BLOCK + 1)
    sums = [F.max(f"_{i}").alias(f"g{i}") for i in inner]
    sums += [over(i, lambda o: F.lit(1)).alias(f"n{i}") for i in inner] + [over(i, lambda o: o.cast("double")).alias(f"s{i}") for i in inner]
    sums += [over(i, lambda o, i=i: (F.abs(o - F.col(f"_{i}")) <= alpha).cast("int")).alias(f"l{i}") for i in inner]
    voxel = F.array(*[F.struct((F.col("b") * BLOCK + (i - 1)).cast("int").alias("z"), F.col(f"g{i}").alias("g"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s"), F.col(f"l{i}").alias("l")) for i in inner])
    got = met.groupBy(KEY, "x", "y", "b").agg(*sums).select(KEY, "x", "y", F.explode(F.filter(voxel, lambda v: v["g"].isNotNull())).alias("v"))
    n = F.col("v.n")
    return got.select(KEY, "x", "y", "v.z", "v.g", n.alias("neighbours"), F.when(n > 0, F.col("v.s") / n).alias("mean"), (F.col("v.l") + 1).alias("dependence"))


def ngldm(voxels: DataFrame, alpha: float = 0) -> DataFrame:
    return neighbourhood(voxels, alpha).groupBy(KEY, F.col("g").alias("i"), F.col("dependence").alias("j")).agg(F.count("*").alias("n"))


def ngtdm(voxels: DataFrame) -> DataFrame:
    """volume_id, i, n, s of the voxels with a neighbour."""
    near = neighbourhood(voxels).filter("neighbours > 0")
    return near.groupBy(KEY, F.col("g").alias("i")).agg(F.count("*").alias("n"), F.sum(F.abs(F.col("g") - F.col("mean"))).alias("s"))
