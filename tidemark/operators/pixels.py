"""Pixels to monthly counts: decoding, mosaics, composites, clips, reductions, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio_pct
from .prepare import unrepeated

#: Canonical mask codes, fixed values.
WATER, DRY, INVALID, OUTSIDE = 1, 0, -1, -2
#: Every step keeps the area in its keys.
CELL = ["aoi_id", "y", "x"]
MONTH = ["aoi_id", "month"]


def decode(raw: Column, encoding: str = "wofs") -> Column:
    """Canonical code of a raw observation."""
    if encoding == "wofs":
        code = F.when(raw.isNull() | (raw.bitwiseAND(1) == 1), INVALID).when(raw == 128, WATER).when(raw == 0, DRY).otherwise(INVALID)
    elif encoding == "binary":
        code = F.when(raw == 1, WATER).when(raw == 0, DRY).otherwise(INVALID)
    elif encoding == "canonical":
        code = F.when(raw.isin(WATER, DRY, INVALID, OUTSIDE), raw).otherwise(INVALID)
    else:
        raise ValueError(f"no encoding {encoding}")
    return code.cast("int")


def day_mosaic(obs: DataFrame) -> DataFrame:
    """One observation a cell and day: the first by time and scene that saw anything (raw without bit 0), else the first.

    Observations are dealt by cell: composites, clips and statistics that follow move none of them again.
    """
    order = F.struct((F.col("raw").isNull() | (F.col("raw").bitwiseAND(1) == 1)).alias("blank"), "obs_ts", "scene_id", "part")
    return obs.repartition(*CELL).groupBy("month", F.to_date("obs_ts").alias("day"), *CELL).agg(F.min(F.struct(order.alias("o"), "raw")).getField("raw").alias("raw"))


def monthly_composite(coded: DataFrame, *, majority: bool = True) -> DataFrame:
    """One code a cell and month: more water than dry sightings, or any water; a tie is dry."""
    by = coded.groupBy("month", *CELL)
    top = F.max("code")
    if not majority:
        return by.agg(top.alias("code"))
    votes = F.sum(F.when(F.col("code") == WATER, 1).when(F.col("code") == DRY, -1).otherwise(0))
    return by.agg(F.when(votes > 0, WATER).when(top >= 0, DRY).otherwise(top).cast("int").alias("code"))


def cell_set(cells: DataFrame, mark: str) -> DataFrame:
    """Distinct cells with a column ``mark``, for a merge join.

    Areas have as many cells as a month has pixels. Spark takes a set that is exploded from a small table for as small as
    that table, would send it whole to the driver and to all executors, and keeps to that when it knows the size.
    """
    return cells.select(*CELL).distinct().withColumn(mark, F.lit(True)).hint("merge")


def clip(mask: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells outside the area become OUTSIDE; inside, OUTSIDE becomes INVALID."""
    inside = cell_set(cells, "_in")
    code = F.when(F.col("_in").isNull(), OUTSIDE).when(F.col("code") == OUTSIDE, INVALID).otherwise(F.col("code"))
    return mask.join(inside, CELL, "left").withColumn("code", code.cast("int")).drop("_in")


def fill_inside(mask: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of the area that are marked OUTSIDE become INVALID; all else stays."""
    inside = cell_set(cells, "_in")
    code = F.when(F.col("_in").isNotNull() & (F.col("code") == OUTSIDE), INVALID).otherwise(F.col("code"))
    return mask.join(inside, CELL, "left").withColumn("code", code.cast("int")).drop("_in")


def complete_cube(mask: DataFrame, cells: DataFrame, duplicates: str | None = None, order: str | None = None) -> DataFrame:
    """Every month of an area's span for every cell of the area; what is missing is INVALID.

    ``duplicates``: None if the mask is known to have one code a cell and month; ``raise`` or ``first`` (by ``order``) as in ``prepare.unrepeated``.
    """
    if duplicates is not None:
        mask = unrepeated(mask, ["month", *CELL], duplicates, order)
    span = mask.groupBy("aoi_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi")).select("aoi_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return cells.join(F.broadcast(span), "aoi_id").join(mask, ["month", *CELL], "left").withColumn("code", F.coalesce("code", F.lit(INVALID)))


def monthly_reduction(mask: DataFrame, keys: list[str] = MONTH, wet: DataFrame | None = None) -> DataFrame:
    """Pixel counts and percentages, partial sums first.

    ``n_wet_aoi`` counts the area's pixels among the cells of ``wet``, the valid ones if None; ``wet_fill_pct`` is the share of them under water.
    """
    n = lambda c: F.count_if(c)
    code = F.col("code")
    valid = code.isin(WATER, DRY)
    if wet is None:
        within = valid
    else:
        mask = mask.join(cell_set(wet, "_wet"), CELL, "left")
        within = F.col("_wet").isNotNull() & (code != OUTSIDE)
    out = mask.groupBy(*keys).agg(n(code == WATER).alias("n_water"), n(code == DRY).alias("n_dry"), n(valid).alias("n_valid"), n(code != OUTSIDE).alias("n_aoi"), n(within).alias("n_wet_aoi"))
    out = out.withColumn("n_invalid", F.col("n_aoi") - F.col("n_valid"))
    return out.withColumn("extent_pct", ratio_pct("n_water", "n_valid")).withColumn("invalid_pct", ratio_pct("n_invalid", "n_aoi")).withColumn("wet_fill_pct", ratio_pct("n_water", "n_wet_aoi"))


def unseen_months(cells: DataFrame, start: str, end: str) -> DataFrame:
    """The counts of months without any scene: all pixels of the mask invalid, no extent."""
    months = F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.trunc(F.lit(end).cast("date"), "MM"), F.expr("interval 1 month"))).alias("month")
    n = cells.groupBy("aoi_id").agg(F.count("*").alias("n_aoi"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_water", "n_valid", "n_wet_aoi")]
    return n.select("aoi_id", months, *zero, "n_aoi", F.col("n_aoi").alias("n_invalid"), F.lit(None).cast("double").alias("extent_pct"), F.when(F.col("n_aoi") > 0, 100.0).alias("invalid_pct"))


def sum_tiles(parts: DataFrame) -> DataFrame:
    """Tile counts to whole-area counts; ``sound`` tells whether valid and invalid add up."""
    out = parts.groupBy(*MONTH).agg(*[F.sum(c).alias(c) for c in ("n_water", "n_valid", "n_invalid", "n_aoi")])
    return out.withColumn("extent_pct", ratio_pct("n_water", "n_valid")).withColumn("invalid_pct", ratio_pct("n_invalid", "n_aoi")).withColumn("sound", F.col("n_aoi") == F.col("n_valid") + F.col("n_invalid"))


def statistics(mask: DataFrame) -> DataFrame:
    """How often each cell was clear, and wet, over the record."""
    out = mask.groupBy(*CELL).agg(F.count_if(F.col("code") == WATER).alias("count_wet"), F.count_if(F.col("code").isin(WATER, DRY)).alias("count_clear"))
    return out.withColumn("frequency", ratio_pct("count_wet", "count_clear"))


def ever_wet(stats: DataFrame, persistence_min: float = 0.0) -> DataFrame:
    wet = F.col("count_wet") > 0 if persistence_min == 0 else (F.col("count_clear") > 0) & (F.col("count_wet") / F.col("count_clear") >= persistence_min)
    return stats.where(wet).select(*CELL)


def historical_mask(stats: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of the area that were ever wet."""
    return ever_wet(stats).join(cell_set(cells, "_in"), CELL, "left_semi")


def planning_footprint(cells: DataFrame, *, factor: int = 4, safety: int = 1) -> DataFrame:
    """Coarse cells with anything in them, widened by ``safety`` cells to all sides."""
    coarse = cells.select("aoi_id", F.expr(f"y div {factor}").cast("int").alias("y"), F.expr(f"x div {factor}").cast("int").alias("x")).distinct()
    steps = F.sequence(F.lit(-safety), F.lit(safety))
    wide = coarse.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return wide.select("aoi_id", (F.col("y") + F.col("dy")).cast("int").alias("y"), (F.col("x") + F.col("dx")).cast("int").alias("x")).where("y >= 0 AND x >= 0").distinct()


def coarsen(mask: DataFrame, factor: int) -> DataFrame:
    """Blocks of factor x factor cells: outside only if wholly so, else the commoner of water and dry, else invalid."""
    if factor < 1:
        raise ValueError("the factor is a positive whole number")
    code = F.col("code")
    out = mask.groupBy(*MONTH, F.expr(f"y div {factor}").cast("int").alias("y"), F.expr(f"x div {factor}").cast("int").alias("x")).agg(F.count_if(code != OUTSIDE).alias("inside"), F.count_if(code == WATER).alias("w"), F.count_if(code == DRY).alias("d"))
    return out.select(*MONTH, "y", "x", F.when(F.col("inside") == 0, OUTSIDE).when(F.col("w") > F.col("d"), WATER).when(F.col("d") > F.col("w"), DRY).otherwise(INVALID).alias("code"))


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per month, cells inside both masks and how many differ."""
    j = a.withColumnRenamed("code", "ca").join(b.withColumnRenamed("code", "cb"), ["month", *CELL]).where(f"ca <> {OUTSIDE} AND cb <> {OUTSIDE}")
    return j.groupBy(*MONTH).agg(F.count("*").alias("n_shared"), F.count_if(F.col("ca") != F.col("cb")).alias("n_mismatch"))


def uncontained(mask: DataFrame, history: DataFrame) -> DataFrame:
    """Water sightings per month outside the historical mask."""
    return mask.where(F.col("code") == WATER).join(cell_set(history, "_in"), CELL, "left_anti").groupBy(*MONTH).agg(F.count("*").alias("n_outside"))


def active_windows(cells: DataFrame, size: int = 512) -> DataFrame:
    return cells.select("aoi_id", F.expr(f"y div {size}").cast("int").alias("tile_y"), F.expr(f"x div {size}").cast("int").alias("tile_x")).distinct()


def tiles_in(tiles: DataFrame, cells: DataFrame | None, size: int) -> DataFrame:
    """The tiles that hold a cell of ``cells``; all of them if None, as nothing is then known to be empty."""
    return tiles if cells is None else tiles.join(active_windows(cells, size).hint("merge"), ["aoi_id", "tile_y", "tile_x"], "left_semi")


def spans_tiles(cells: DataFrame, size: int) -> DataFrame:
    """Whether an area's bounding box reaches over more than one tile."""
    at = lambda f, c: F.floor(f(c) / size)
    return cells.groupBy("aoi_id").agg(((at(F.min, "y") != at(F.max, "y")) | (at(F.min, "x") != at(F.max, "x"))).alias("spans_tiles"))


def grid_windows(shapes: DataFrame, size: int) -> DataFrame:
    """Row-major windows of shapes(aoi_id, height, width): (aoi_id, tile_y, tile_x, y0, y1, x0, x1), ends exclusive, cut at the edges."""
    span = lambda c: F.sequence(F.lit(0), (F.ceil(F.col(c) / size) - 1).cast("int"))
    rows = shapes.where("height > 0 AND width > 0").withColumn("tile_y", F.explode(span("height"))).withColumn("tile_x", F.explode(span("width")))
    edge = lambda t, c, k: F.least((F.col(t) + k) * size, F.col(c)).cast("int")
    return rows.select("aoi_id", "tile_y", "tile_x", edge("tile_y", "height", 0).alias("y0"), edge("tile_y", "height", 1).alias("y1"), edge("tile_x", "width", 0).alias("x0"), edge("tile_x", "width", 1).alias("x1"))


def union_inside(parts: list[DataFrame], area: DataFrame) -> DataFrame:
    """The cells of any of several sets, within the area."""
    out = parts[0].select(*CELL)
    for x in parts[1:]:
        out = out.unionByName(x.select(*CELL))
    return out.distinct().join(cell_set(area, "_in"), CELL, "left_semi")


def same_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per area, how many cells only one of two sets has: none if one derives wholly from the other."""
    j = a.select(*CELL).distinct().withColumn("_a", F.lit(1)).join(b.select(*CELL).distinct().withColumn("_b", F.lit(1)), CELL, "full")
    return j.groupBy("aoi_id").agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per area and month, pixels that two cubes hold differently, those in one only included."""
    j = a.withColumnRenamed("code", "ca").join(b.withColumnRenamed("code", "cb"), ["month", *CELL], "full")
    return j.groupBy(*MONTH).agg(F.count("*").alias("n_pixels"), F.count_if(~F.col("ca").eqNullSafe(F.col("cb"))).alias("n_differing"))


def fidelity(mask: DataFrame, factors: list[int]) -> DataFrame:
    """Per area and factor: the share of valid pixels that a coarsened mask, spread out again, still shows right."""
    out = None
    for f in factors:
        up = coarsen(mask, f).select("aoi_id", "month", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("code").alias("_c"))
        own = mask.where(F.col("code").isin(WATER, DRY)).withColumn("_y", F.expr(f"y div {f}").cast("int")).withColumn("_x", F.expr(f"x div {f}").cast("int"))
        got = own.join(up, ["aoi_id", "month", "_y", "_x"]).groupBy("aoi_id").agg(F.count("*").alias("n_valid"), F.count_if(F.col("code") != F.col("_c")).alias("n_mismatch"))
        got = got.select("aoi_id", F.lit(f).alias("factor"), "n_valid", "n_mismatch", (1 - F.col("n_mismatch") / F.col("n_valid")).alias("fidelity"))
        out = got if out is None else out.unionByName(got)
    return out


def scenes_by_year(scenes: DataFrame) -> DataFrame:
    """Scenes and observations of each area and calendar year."""
    return scenes.groupBy("aoi_id", F.year("obs_ts").alias("yr")).agg(F.countDistinct("scene_id").alias("n_scenes"), F.count("*").alias("n_observations"))


#: Metres a pixel among which a resolution is chosen, bytes of scratch a pixel and month, and the share of the amplitude that one pixel may be; fixed values.
LADDER, SCRATCH_BYTES, SIGNAL_SHARE = (30, 60, 100, 150, 300), 5, 0.10


def plan_resolution(areas: DataFrame, *, budget_gb: float, time_chunk: int = 24, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """areas(aoi_id, area_m2, amplitude_pp): the finest resolution whose scratch memory fits, with its needs and why it was chosen.

    ``native_no_fit``: not even the coarsest fits; ``signal_veto_no_fit``: one pixel is more than a tenth of the amplitude, if one is known.
    """
    steps = F.array(*[F.lit(r) for r in sorted(ladder)])
    gb = lambda r: F.col("area_m2") / (r * r) * time_chunk * SCRATCH_BYTES / 1e9
    fits = F.element_at(F.filter(steps, lambda r: gb(r) <= budget_gb), 1)
    x = areas.withColumn("_fit", F.when(F.size(F.filter(steps, lambda r: gb(r) <= budget_gb)) > 0, fits)).withColumn("res_m", F.coalesce("_fit", F.lit(max(ladder))))
    x = x.withColumn("peak_gb", gb(F.col("res_m"))).withColumn("floor_pp", F.lit(100.0) * F.col("res_m") * F.col("res_m") / F.col("area_m2"))
    reason = F.when(F.col("_fit").isNull(), "native_no_fit").when(F.col("floor_pp") > SIGNAL_SHARE * F.col("amplitude_pp"), "signal_veto_no_fit").when(F.col("res_m") == min(ladder), "ok").otherwise("coarsened")
    return x.select("aoi_id", "res_m", "peak_gb", "floor_pp", reason.alias("reason"))
