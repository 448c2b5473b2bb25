"""Growing, shrinking and closing sets of cells by true distances.

Sets are rows of runs (aoi_id, y, x0, x1), ends included. A disc is a stack of row segments: growing copies each run once for each
row that the disc reaches, widened by the disc's half width there; a sweep along each row then tells how many segments
cover each place. At least one: the set has grown; one of every row of the disc: it has shrunk. The work goes with
runs times reach, never with cells times the disc's area.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Metres by which gaps are closed and by which the area then grows; fixed values.
CLOSE_M, BUFFER_M = 150.0, 300.0
ROW = ["aoi_id", "y"]


def runs_of(cells: DataFrame) -> DataFrame:
    """Cells (aoi_id, y, x), repeated or not, as maximal runs of each row."""
    one = cells.select(*ROW, "x").distinct()
    start = F.col("x") - F.row_number().over(Window.partitionBy(*ROW).orderBy("x"))
    return one.withColumn("_g", start).groupBy(*ROW, "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def cells_of(runs: DataFrame) -> DataFrame:
    return runs.select(*ROW, F.explode(F.sequence("x0", "x1")).alias("x"))


def disc(reach: float) -> list[tuple[int, int]]:
    """(row offset, half width) of the cells whose centres lie within ``reach`` cells of a centre."""
    square = math.floor(reach * reach + 1e-9)
    tall = math.isqrt(square)
    return [(dy, math.isqrt(square - dy * dy)) for dy in range(-tall, tall + 1)]


def _swept(runs: DataFrame, reach: float, sign: int, least: int) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(sign * w).alias("w")) for dy, w in disc(reach)]))
    moved = runs.select("aoi_id", "y", "x0", "x1", rows.alias("_d"))
    moved = moved.select("aoi_id", (F.col("y") + F.col("_d.dy")).cast("int").alias("y"), (F.col("x0") - F.col("_d.w")).alias("a"), (F.col("x1") + F.col("_d.w") + 1).alias("b")).where("a < b")
    end = lambda c, d: F.struct(F.col(c).alias("x"), F.lit(d).alias("d"))
    edges = moved.select(*ROW, F.inline(F.array(end("a", 1), end("b", -1))))
    edges = edges.groupBy(*ROW, "x").agg(F.sum("d").alias("d")).where("d <> 0")
    by = Window.partitionBy(*ROW).orderBy("x")
    level = edges.withColumn("_in", F.sum("d").over(by) >= least)
    # segments that touch become one run
    turns = level.withColumn("_was", F.coalesce(F.lag("_in").over(by), F.lit(False))).where("_in <> _was")
    return turns.withColumn("x1", (F.lead("x").over(by) - 1).cast("int")).where("_in").select(*ROW, F.col("x").cast("int").alias("x0"), "x1")


def grow(runs: DataFrame, reach: float) -> DataFrame:
    """All cells within ``reach`` cells of one, from centre to centre."""
    return _swept(runs, reach, 1, 1)


def shrink(runs: DataFrame, reach: float) -> DataFrame:
    """The cells whose every neighbour within ``reach`` cells is there."""
    return _swept(runs, reach, -1, len(disc(reach)))


def wet_area(cells: DataFrame, *, cell_m: float = 30.0, close_m: float = CLOSE_M, buffer_m: float = BUFFER_M) -> DataFrame:
    """Ever-wet cells with gaps closed over ``close_m`` metres, then grown by ``buffer_m``, as cells (aoi_id, y, x).

    Closing first grows, then shrinks, so that no narrow channel is lost. Distances run between cell centres, and cells
    may lie beyond the grid that the set came from, also at negative places. No cells give no cells.
    """
    if cell_m <= 0 or close_m < 0 or buffer_m < 0:
        raise ValueError("a cell has a positive size and distances aren't negative")
    out = runs_of(cells)
    if close_m:
        out = shrink(grow(out, close_m / cell_m), close_m / cell_m)
    return cells_of(grow(out, buffer_m / cell_m) if buffer_m else out)
