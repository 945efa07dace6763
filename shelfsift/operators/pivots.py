"""A tree of pivots over dense vectors: cells of bounded size, however many rows there are.

A cell of more than CELL rows (more in large tables, see ``cell_rows``) gets up to FAN of its own vectors as pivots, and each of its rows goes to
the nearest; cells that are still too large are split again. So the depth grows with the logarithm of
the rows, and a table holds the pivots of a level: one row per split cell, never all of them in the
driver. Rows and pivots meet in units of some PIECE rows, so a cell that holds most rows is many tasks.
A cell that kept most rows of its parent, as copies of one vector make it, is left larger than CELL;
users cut such cells into tiles.

A row's cell is its path from the root, the number of a child behind each slash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsift.operators.joins import broadcast_small, skew_join
from shelfsift.session import stage

CELL = 2048
CELLS = 16  # cells of equal size beyond which larger tables get larger cells, as vectors that nothing prunes visit every cell
LARGEST = 1 << 16  # rows of a cell at most, so that a task's memory is bounded
FAN = 256
PIECE = 8192
SHRUNK = 0.75  # share of its parent's rows beyond which a cell is not split again
ROUNDING = 1e-6  # of a distance by the product form, as a share of the lengths of both vectors


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64")


def _squares(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.maximum((m * m).sum(1)[:, None] - 2 * m @ p.T + (p * p).sum(1)[None, :], 0)


def cell_rows(n: int) -> int:
    """Rows of a cell of a table of ``n``: visits grow with the rows alone up to CELLS * LARGEST of them."""
    return max(CELL, min(-(-n // CELLS), LARGEST))


def _census(*more):
    return [F.count(F.lit(1)).alias("_n"), F.approx_count_distinct(F.xxhash64("_vec")).alias("_kinds"), *more]


def _dealt(rows: DataFrame, sizes: DataFrame, level: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(rows, cell)`` for units of some PIECE rows of the cells of ``level``, which has one row per cell.

    ``sizes``: (_cell, _n), the number of ``rows`` in each.
    """
    counted = sizes.select("_cell", "_n")
    pieces = F.ceil(F.col("_n") / PIECE).cast("int")
    left = skew_join(rows, counted.join(level.select("_cell"), "_cell", "left_semi"), ["_cell"], counted, "_n")
    left = left.select(*rows.columns, F.pmod(F.xxhash64("_id"), pieces).cast("int").alias("_piece"))
    # New names, as both sides may come from one table.
    fresh = [F.col(c).alias("_key" if c == "_cell" else c) for c in level.columns]
    right = level.join(counted, "_cell").select(*fresh, F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_unit"))
    names = [field.split()[0] for field in schema.split(", ")]
    return left.groupBy("_cell", "_piece").cogroup(right.groupBy("_key", "_unit")).applyInPandas(
        lambda l, r: work(l, r.iloc[0]) if len(l) and len(r) else pd.DataFrame(columns=names), schema)


def _chosen(rows: DataFrame, split: DataFrame, cell: int) -> DataFrame:
    """(_cell, _pivots): up to FAN different vectors of each cell to split, spread by hash; at least two of them."""
    wanted = F.least(F.lit(FAN), F.ceil(2 * F.col("_n") / cell))
    # Twice as many as wanted are drawn, so that only a slim part of a cell is made distinct and ranked.
    drawn = F.shiftrightunsigned(F.xxhash64("_vec"), 11) * 2.0**-53 < 2 * wanted / F.col("_kinds")
    sample = skew_join(rows, split.select("_cell", "_n", "_kinds"), ["_cell"], split, "_n").where(drawn)
    each = sample.groupBy("_cell", "_n", F.xxhash64("_vec").alias("_h")).agg(F.first("_vec").alias("_vec"))
    ranked = each.withColumn("_at", F.row_number().over(Window.partitionBy("_cell").orderBy("_h"))).where(F.col("_at") <= wanted)
    return ranked.groupBy("_cell").agg(F.sort_array(F.collect_list(F.struct("_at", "_vec"))).alias("_p")).where(F.size("_p") > 1).select(
        "_cell", F.col("_p._vec").alias("_pivots"))


def _to_nearest(rows: pd.DataFrame, cell: pd.Series) -> pd.DataFrame:
    square = _squares(matrix(rows["_vec"]), np.vstack(cell["_pivots"]))
    child = square.argmin(1)
    return pd.DataFrame({
        "_id": rows["_id"], "_vec": rows["_vec"], "_cell": rows["_cell"], "_child": child,
        "_d": np.sqrt(square[np.arange(len(child)), child])})


def _below(cell: str = "_cell", child: str = "_child"):
    return F.concat(cell, F.lit("/"), F.col(child).cast("string"))


def grown(rows: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """The staged (_id, _vec) with their _cell, the levels of the tree, and (_cell, _n) of its leaves.

    A level: (_cell, _pivots, _children), the children that hold rows as (number, radius, rows). A cell
    that kept more than SHRUNK of its parent's rows is left as it is, so the depth is logarithmic.
    """
    kind = rows.schema["_id"].dataType.simpleString()
    now = rows.select("_id", "_vec", F.lit("").alias("_cell"))
    sizes = stage(now.groupBy("_cell").agg(*_census(F.lit(None).cast("long").alias("_of"))))
    cell = cell_rows(sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    placed, levels, leaves = [], [], []
    while True:
        split = sizes.where((F.col("_n") > cell) & (F.col("_kinds") > 1) & (F.col("_of").isNull() | (F.col("_n") <= SHRUNK * F.col("_of"))))
        pivots = stage(_chosen(now, split, cell))
        rest = sizes.join(pivots.select("_cell"), "_cell", "left_anti").select("_cell", "_n")
        placed.append(skew_join(now, rest, ["_cell"], sizes, "_n").select("_id", "_vec", "_cell"))
        leaves.append(rest)
        if pivots.isEmpty():
            break
        moved = stage(_dealt(now, sizes, pivots, _to_nearest, f"_id {kind}, _vec array<double>, _cell string, _child int, _d double"))
        children = stage(moved.groupBy("_cell", "_child").agg(*_census(F.max("_d").alias("_radius"))))
        listed = children.groupBy("_cell").agg(F.sort_array(F.collect_list(F.struct("_child", "_radius", "_n"))).alias("_children"))
        levels.append(stage(pivots.join(listed, "_cell")))
        now = moved.select("_id", "_vec", _below().alias("_cell"))
        above = sizes.select("_cell", F.col("_n").alias("_of"))
        sizes = stage(children.join(above, "_cell").select(_below().alias("_cell"), "_n", "_kinds", "_of"))
    for each in placed[1:]:
        placed[0] = placed[0].unionByName(each)
    for each in leaves[1:]:
        leaves[0] = leaves[0].unionByName(each)
    return stage(placed[0]), levels, stage(leaves[0])


def _cell_arrays(cell: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, pivots, radii and rows of the children that hold rows."""
    number = np.array([c["_child"] for c in cell["_children"]])
    return (number, np.vstack(cell["_pivots"])[number], np.array([c["_radius"] for c in cell["_children"]]),
            np.array([c["_n"] for c in cell["_children"]]))


def _count(rows: DataFrame) -> DataFrame:
    return stage(rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")))


def _descend(rows: DataFrame, levels: list[DataFrame], step: Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """Take ``rows`` with a _cell down to leaves; ``step(rows, sizes, level, depth)`` goes one level down and is staged."""
    ended = None
    for depth, level in enumerate(levels):
        at_leaf = rows.join(broadcast_small(level.select("_cell")), "_cell", "left_anti").select(*rows.columns)
        ended = at_leaf if ended is None else ended.unionByName(at_leaf)
        rows = stage(step(rows, _count(rows), level, depth))
    return rows if ended is None else ended.unionByName(rows)


def nearest_leaf(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(_id, _vec, _cell): the leaf found by going to the nearest pivot that holds rows, level by level."""
    kind = rows.schema["_id"].dataType.simpleString()

    def work(some: pd.DataFrame, cell: pd.Series) -> pd.DataFrame:
        number, pivots, _, _ = _cell_arrays(cell)
        child = number[_squares(matrix(some["_vec"]), pivots).argmin(1)]
        return pd.DataFrame({"_id": some["_id"], "_vec": some["_vec"], "_cell": some["_cell"], "_child": child})

    def step(some: DataFrame, sizes: DataFrame, level: DataFrame, depth: int) -> DataFrame:
        moved = _dealt(some, sizes, level, work, f"_id {kind}, _vec array<double>, _cell string, _child int")
        return moved.select("_id", "_vec", _below().alias("_cell"))

    return _descend(rows.select("_id", "_vec", F.lit("").alias("_cell")), levels, step)


def visits(rows: DataFrame, levels: list[DataFrame], k: int | None = None) -> DataFrame:
    """(_id, _vec, _cell): every leaf in which a row may have a neighbour within its reach _r, one row per visit.

    With a column _home, the row's own leaf, only leaves behind it in the order of the tree are
    visited, so that of two rows in different leaves exactly one visits the other. With ``k``, a reach is
    also bounded by the nearest children that hold ``k`` rows together: no k-th neighbour is farther
    than their farthest row can be.

    A child is out of reach if its ball is, or if the row lies so far on the side of another pivot that
    the plane halfway between the two is.
    """
    kind = rows.schema["_id"].dataType.simpleString()
    later_only = "_home" in rows.columns
    kept = ["_id", "_vec", "_r", *(["_home"] if later_only else [])]
    fields = f"_id {kind}, _vec array<double>, _r double, " + ("_home string, " if later_only else "")

    def work(some: pd.DataFrame, cell: pd.Series) -> pd.DataFrame:
        number, pivots, radius, held = _cell_arrays(cell)
        m = matrix(some["_vec"])
        square = _squares(m, pivots)
        dist = np.sqrt(square)
        lengths = np.sqrt((m * m).sum(1))[:, None] + np.sqrt((pivots * pivots).sum(1)).max()
        reach = np.minimum(some["_r"].to_numpy(dtype="float64"), 1e300)
        if k is not None:
            far = dist + radius[None, :]
            order = far.argsort(1)
            enough = held[order].cumsum(1) >= k
            bound = np.take_along_axis(far, order, 1)[np.arange(len(m)), enough.argmax(1)] + ROUNDING * lengths[:, 0]
            reach = np.where(enough[:, -1], np.minimum(reach, bound), reach)
        room = reach[:, None] + ROUNDING * lengths
        gap = np.sqrt(_squares(pivots, pivots))[square.argmin(1)]
        side = square - square.min(1)[:, None]
        hit = (dist - radius[None, :] <= room) & (side <= 2 * gap * room + 1e-12 * lengths**2)
        if later_only:
            own = some["_own"].to_numpy(dtype="int64")
            # The own child is gone down as well: leaves behind the own one may lie in it.
            hit = (hit & (number[None, :] > own[:, None])) | (number[None, :] == own[:, None])
        out = some[kept].copy()
        out["_r"], out["_cell"], out["_to"] = reach, some["_cell"], [number[row].tolist() for row in hit]
        return out

    def step(some: DataFrame, sizes: DataFrame, level: DataFrame, depth: int) -> DataFrame:
        if later_only:
            inside = F.startswith("_home", F.concat("_cell", F.lit("/")))
            own = F.when(inside, F.element_at(F.split("_home", "/"), depth + 2).cast("int")).otherwise(-1)
            some = some.withColumn("_own", own)
        moved = _dealt(some, sizes, level, work, fields + "_cell string, _to array<int>")
        return moved.select(*kept, "_cell", F.explode("_to").alias("_child")).select(*kept, _below().alias("_cell"))

    found = _descend(rows.select(*kept, F.lit("").alias("_cell")), levels, step)
    return (found.where("_cell != _home") if later_only else found).select("_id", "_vec", "_cell")
