"""Areas from vector files: GeoJSON in, rings out, and what is wrong with them as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTS = "array<array<double>>"


def read_geojson(spark: SparkSession, path: str, *, name: str = "name") -> DataFrame:
    """(area, part, ring, kind, points array<struct<x, y>>): the rings of all features of the files at ``path``, one row for a feature without any.

    ``area`` is the property ``name``, or else file and place of the feature. Shells have ring 0, holes follow.
    A file is one JSON document and so one task's work; many areas belong into many files.
    """
    geometry = "struct<type:string,coordinates:string>"
    one = f"struct<type:string,properties:map<string,string>,geometry:{geometry}>"
    docs = spark.read.schema(f"type string, features array<{one}>, properties map<string,string>, geometry {geometry}").option("multiLine", True).json(path)
    alone = F.array(F.struct("type", "properties", "geometry").cast(one))
    features = docs.select(F.input_file_name().alias("_file"), F.posexplode_outer(F.when(F.col("type") == "FeatureCollection", F.col("features")).when(F.col("type") == "Feature", alone)).alias("_i", "f"))
    named = features.select(F.coalesce(F.element_at("f.properties", name), F.concat_ws("#", "_file", "_i")).alias("area"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("_c"))
    several = F.when(F.col("kind") == "MultiPolygon", F.from_json("_c", f"array<array<{_POINTS}>>")).when(F.col("kind") == "Polygon", F.array(F.from_json("_c", f"array<{_POINTS}>")))
    parts = named.select("area", "kind", F.posexplode_outer(several).alias("part", "_p"))
    rings = parts.select("area", "kind", "part", F.posexplode_outer("_p").alias("ring", "_r"))
    return rings.select("area", "part", "ring", "kind", F.transform("_r", lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y"))).alias("points"))


def area_errors(rings: DataFrame, *, bands: int = 256) -> DataFrame:
    """(area, error): what keeps an area from use, one row for each sort of fault; sound areas have none.

    Faults: no polygon, a ring of fewer than four points, a ring that doesn't close, places that aren't numbers, and edges that
    cross. Only edges that share one of the area's ``bands`` of height meet in the join that looks for crossings.
    """
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    bad = lambda q: q["x"].isNull() | q["y"].isNull() | F.isnan(q["x"]) | F.isnan(q["y"])
    none = ~F.coalesce(F.col("kind").isin("Polygon", "MultiPolygon"), F.lit(False)) | F.coalesce(F.size("points") <= 0, F.lit(True))
    fault = F.when(none, "null or empty geometry").when(F.exists("points", bad), "places that are not numbers").when(F.size("points") < 4, "a ring of fewer than four points").when((first["x"] != last["x"]) | (first["y"] != last["y"]), "a ring that does not close")
    judged = rings.withColumn("error", fault)
    sound = judged.where("error IS NULL")
    e = sound.select("area", "part", "ring", F.posexplode(F.arrays_zip(F.col("points").alias("a"), F.slice("points", F.lit(2), F.size("points") - 1).alias("b"))).alias("i", "e")).where("e.b IS NOT NULL")
    e = e.select("area", F.struct("part", "ring", "i").alias("id"), F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    reach = e.groupBy("area").agg(F.min(F.least("a.y", "b.y")).alias("_lo"), F.max(F.greatest("a.y", "b.y")).alias("_hi"))
    band = lambda y: F.coalesce(F.try_divide((y - F.col("_lo")) * bands, F.col("_hi") - F.col("_lo")), F.lit(0.0)).cast("int")
    e = e.join(reach, "area").select("area", "id", "a", "b", F.explode(F.sequence(band(F.least("a.y", "b.y")), band(F.greatest("a.y", "b.y")))).alias("_band"))
    o = e.select("area", "_band", F.col("id").alias("jd"), F.col("a").alias("c"), F.col("b").alias("d"))
    side = lambda p, q, r: F.signum((F.col(f"{q}.x") - F.col(f"{p}.x")) * (F.col(f"{r}.y") - F.col(f"{p}.y")) - (F.col(f"{q}.y") - F.col(f"{p}.y")) * (F.col(f"{r}.x") - F.col(f"{p}.x")))
    cross = e.join(o, ["area", "_band"]).where("id < jd").where((side("a", "b", "c") * side("a", "b", "d") < 0) & (side("c", "d", "a") * side("c", "d", "b") < 0))
    return judged.where("error IS NOT NULL").select("area", "error").unionByName(cross.select("area", F.lit("edges that cross").alias("error"))).distinct()
