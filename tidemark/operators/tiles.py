"""How to cut an area's grid into tiles, and reading only the tiles that matter."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tile sizes to choose from beside no tiling, the cost of a tile in pixels, and the least gain for which to tile; fixed values.
CANDIDATES, TILE_OVERHEAD, MIN_IMPROVEMENT = (2048, 1024, 512), 262144.0, 0.15
TILE = ["tile_y", "tile_x"]
#: Tiles share a folder of at least so many rows and columns of pixels, else folders, which the driver lists, would grow as fast as pixels.
FOLDER, FOLDER_SIDE = ["folder_y", "folder_x"], min(CANDIDATES)


def _clipped(size, at: str, length: str):
    """How many rows (or columns) of a tile lie on the grid."""
    return F.greatest(F.lit(0), F.least((F.col(at) + 1) * size, F.col(length)) - F.col(at) * size)


def candidate_costs(cells: DataFrame, shapes: DataFrame, *, candidates: tuple[int, ...] = CANDIDATES, pixel_cost: float = 1.0, tile_overhead: float = TILE_OVERHEAD) -> DataFrame:
    """(aoi_id, tile_pixels, n_tiles, intersecting_pixels, predicted_cost), ``tile_pixels`` null for the whole grid as one.

    Cells are first brought down to the distinct tiles of the candidates' common divisor; all sizes are sums over those, so
    the cells are read once whatever the number of candidates.
    """
    if pixel_cost <= 0 or tile_overhead < 0 or not candidates or min(candidates) < 1:
        raise ValueError("sizes and the cost of a pixel are positive, a tile's isn't negative")
    base = math.gcd(*candidates)
    fine = cells.select("aoi_id", F.expr(f"y div {base}").alias("_y"), F.expr(f"x div {base}").alias("_x")).distinct()
    sizes = F.explode(F.array(*[F.lit(c) for c in sorted(set(candidates))])).alias("tile_pixels")
    tiles = fine.select("aoi_id", sizes, "_y", "_x").select("aoi_id", "tile_pixels", F.expr(f"_y div (tile_pixels div {base})").alias("tile_y"), F.expr(f"_x div (tile_pixels div {base})").alias("tile_x")).distinct()
    at = tiles.join(shapes.select("aoi_id", "height", "width"), "aoi_id")
    pixels = _clipped(F.col("tile_pixels"), "tile_y", "height") * _clipped(F.col("tile_pixels"), "tile_x", "width")
    cut = at.withColumn("_p", pixels.cast("long")).where("_p > 0").groupBy("aoi_id", "tile_pixels").agg(F.count("*").alias("n_tiles"), F.sum("_p").alias("intersecting_pixels"))
    whole = shapes.join(fine.select("aoi_id").distinct(), "aoi_id", "left_semi").select("aoi_id", F.lit(None).cast("int").alias("tile_pixels"), F.lit(1).cast("long").alias("n_tiles"), (F.col("height").cast("long") * F.col("width")).alias("intersecting_pixels"))
    return cut.unionByName(whole).withColumn("predicted_cost", pixel_cost * F.col("intersecting_pixels") + tile_overhead * F.col("n_tiles"))


def plan_tiles(cells: DataFrame, shapes: DataFrame, *, min_improvement: float = MIN_IMPROVEMENT, **costs) -> DataFrame:
    """(aoi_id, tile_pixels, n_tiles, intersecting_pixels, predicted_cost, relative_improvement, tiled): the cheapest way to read each area.

    Tiles have to save ``min_improvement`` of the whole grid's cost, else ``tile_pixels`` is null. Of equal costs no tiling, then the larger tiles. Areas without
    cells are left out.
    """
    if not 0 <= min_improvement <= 1:
        raise ValueError("the least improvement is a share")
    scored = candidate_costs(cells, shapes, **costs)
    row = F.struct("predicted_cost", F.col("tile_pixels").isNotNull().alias("t"), (-F.col("tile_pixels")).alias("s"), "tile_pixels", "n_tiles", "intersecting_pixels")
    best = scored.groupBy("aoi_id").agg(F.min(row).alias("b"), F.max(F.when(F.col("tile_pixels").isNull(), row)).alias("w"))
    gain = F.coalesce(F.try_divide(F.col("w.predicted_cost") - F.col("b.predicted_cost"), F.col("w.predicted_cost")), F.lit(0.0))
    tiled = F.col("b.tile_pixels").isNotNull() & (gain >= min_improvement)
    pick = lambda c: F.when(tiled, F.col(f"b.{c}")).otherwise(F.col(f"w.{c}")).alias(c)
    return best.select("aoi_id", pick("tile_pixels"), pick("n_tiles"), pick("intersecting_pixels"), pick("predicted_cost"), F.when(tiled, gain).otherwise(0.0).alias("relative_improvement"), tiled.alias("tiled"))


def planned_windows(plan: DataFrame, cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """(aoi_id, tile_y, tile_x, y0, y1, x0, x1): the windows to read, ends exclusive; one for the whole grid where it isn't tiled."""
    p = plan.select("aoi_id", "tile_pixels").join(shapes.select("aoi_id", "height", "width"), "aoi_id")
    size = F.coalesce("tile_pixels", F.greatest("height", "width"))
    own = cells.join(p.select("aoi_id", size.alias("_s")), "aoi_id").select("aoi_id", "_s", F.expr("y div _s").cast("int").alias("tile_y"), F.expr("x div _s").cast("int").alias("tile_x")).distinct()
    own = own.join(shapes.select("aoi_id", "height", "width"), "aoi_id")
    edge = lambda t, k, end: F.least((F.col(t) + k) * F.col("_s"), F.col(end)).cast("int")
    return own.select("aoi_id", *TILE, edge("tile_y", 0, "height").alias("y0"), edge("tile_y", 1, "height").alias("y1"), edge("tile_x", 0, "width").alias("x0"), edge("tile_x", 1, "width").alias("x1")).where("y0 < y1 AND x0 < x1")


def _in_folder(tiles: DataFrame, size: int) -> DataFrame:
    """Tiles with the folder that holds them."""
    k = math.ceil(FOLDER_SIDE / size)
    return tiles.withColumns({f: F.expr(f"{t} div {k}").cast("int") for f, t in zip(FOLDER, TILE, strict=True)})


def write_tiles(pixels: DataFrame, path: str, size: int) -> None:
    """Pixels as a table with their tile (tile_y, tile_x) of ``size`` pixels, ordered by it, partitioned by folders of tiles."""
    tiled = pixels.withColumn("tile_y", F.expr(f"y div {size}").cast("int")).withColumn("tile_x", F.expr(f"x div {size}").cast("int"))
    _in_folder(tiled, size).repartition(*FOLDER).sortWithinPartitions(*FOLDER, *TILE).write.mode("overwrite").partitionBy(*FOLDER).parquet(path)


def read_tiles(spark: SparkSession, path: str, cells: DataFrame | None, size: int, *, skip: DataFrame | None = None) -> DataFrame:
    """Pixels of the tiles in which an area has cells, and that aren't on the list of those already done.

    ``cells`` (aoi_id, y, x): None reads every tile, as nothing is then known to be empty. ``skip``: (aoi_id, tile_y, tile_x). The folders of the tiles
    left, which are few, are joined on the table's partition columns, so files of other folders are pruned when the scan starts; then pixels meet their tiles.
    """
    pixels = spark.read.parquet(path)
    if cells is not None:
        wanted = cells.groupBy("aoi_id", F.expr(f"y div {size}").cast("int").alias("tile_y"), F.expr(f"x div {size}").cast("int").alias("tile_x")).agg(F.count("*").alias("_n"))
        wanted = wanted if skip is None else wanted.join(skip, ["aoi_id", *TILE], "left_anti")
        wanted = wanted.where("_n > 0").drop("_n")
        folders = _in_folder(wanted, size).select(*FOLDER).distinct()
        return pixels.join(F.broadcast(folders), FOLDER, "left_semi").drop(*FOLDER).join(wanted.hint("merge"), ["aoi_id", *TILE])
    pixels = pixels.drop(*FOLDER)
    return pixels if skip is None else pixels.join(skip, ["aoi_id", *TILE], "left_anti")
