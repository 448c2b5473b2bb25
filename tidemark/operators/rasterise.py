"""Polygons to grid cells: every cell that a polygon covers a part of.

An edge is cut at the grid's rows; within a row it crosses the cells from its least to its greatest place. The cells between
edges follow from parity: along the centre line of each row, places alternate between outside and inside. Both
are rows keyed by (area, row), so a large polygon is spread over its rows, and one row's crossings are sorted by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A grid has an origin, steps that may be negative (rows downwards), and a size: (aoi_id, x0, y0, dx, dy, height, width).
GRID = "x0", "y0", "dx", "dy", "height", "width"


def edges(rings: DataFrame, grids: DataFrame) -> DataFrame:
    """(aoi_id, u1, v1, u2, v2, height, width): the edges of rings (aoi_id, points array<struct<x, y>>) in units of cells, v upwards; closing edges are added."""
    at = rings.join(grids.select("aoi_id", *GRID), "aoi_id")
    p = F.transform("points", lambda q: F.struct(((q["x"] - F.col("x0")) / F.col("dx")).alias("u"), ((q["y"] - F.col("y0")) / F.col("dy")).alias("v")))
    at = at.where(F.size("points") > 1).withColumn("_p", p)
    turned = F.concat(F.slice("_p", F.lit(2), F.size("_p") - 1), F.slice("_p", F.lit(1), F.lit(1)))
    pairs = at.select("aoi_id", "height", "width", F.explode(F.arrays_zip(F.col("_p").alias("a"), turned.alias("b"))).alias("e"))
    e = pairs.select("aoi_id", "height", "width", F.col("e.a.u").alias("_ua"), F.col("e.a.v").alias("_va"), F.col("e.b.u").alias("_ub"), F.col("e.b.v").alias("_vb"))
    up = F.col("_va") <= F.col("_vb")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    e = e.select("aoi_id", "height", "width", pick("_ua", "_ub").alias("u1"), pick("_va", "_vb").alias("v1"), pick("_ub", "_ua").alias("u2"), pick("_vb", "_va").alias("v2"))
    return e.where("u1 <> u2 OR v1 <> v2")


def _span(low: Column, high: Column, size: str) -> Column:
    """The whole numbers from ``low`` to ``high`` within the grid; an empty array if there are none."""
    a, b = F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.col(size) - 1).cast("int")
    return F.when(a <= b, F.sequence(a, b))


def _place(v: Column) -> Column:
    """Where an edge that rises is at height v."""
    return F.col("u1") + (v - F.col("v1")) * (F.col("u2") - F.col("u1")) / (F.col("v2") - F.col("v1"))


def crossed(edge_rows: DataFrame) -> DataFrame:
    """(aoi_id, y, x): the cells whose inside an edge passes through."""
    rows = edge_rows.withColumn("y", F.explode(_span(F.floor("v1"), F.ceil("v2") - 1, "height")))
    level = F.col("v1") == F.col("v2")
    a = F.when(level | (F.col("v1") >= F.col("y")), F.col("u1")).otherwise(_place(F.col("y")))
    b = F.when(level | (F.col("v2") <= F.col("y") + 1), F.col("u2")).otherwise(_place(F.col("y") + 1))
    rows = rows.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b))
    return rows.select("aoi_id", "y", F.explode(_span(F.floor("_a"), F.ceil("_b") - 1, "width")).alias("x"))


def filled(edge_rows: DataFrame) -> DataFrame:
    """(aoi_id, y, x): the cells whose centre is inside, by the even-odd rule."""
    half = F.lit(0.5)
    rows = edge_rows.where("v1 < v2").withColumn("y", F.explode(_span(F.ceil(F.col("v1") - half), F.ceil(F.col("v2") - half) - 1, "height")))
    rows = rows.select("aoi_id", "y", "width", _place(F.col("y") + half).alias("u"))
    by = Window.partitionBy("aoi_id", "y").orderBy("u")
    spans = rows.withColumn("_n", F.row_number().over(by)).withColumn("_to", F.lead("u").over(by)).where("_n % 2 = 1")
    return spans.select("aoi_id", "y", F.explode(_span(F.ceil(F.col("u") - half), F.ceil(F.col("_to") - half) - 1, "width")).alias("x"))


def cells_touched(rings: DataFrame, grids: DataFrame) -> DataFrame:
    """The cells (aoi_id, y, x) of each area's grid of which its polygons cover any part.

    ``rings``: (aoi_id, points), shells and holes alike, in any direction, closed or not; an area's rings together obey the even-odd rule. A cell
    belongs if its centre is inside or an edge passes through its inside; merely touching its border doesn't count.
    Rings of fewer than two points, areas without a grid, and what lies beyond the grid give no cells.
    """
    e = edges(rings, grids)
    return crossed(e).unionByName(filled(e)).distinct()
