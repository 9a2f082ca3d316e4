"""Assigning readings to cities by point in polygon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazemeter.session import written

#: Rings smaller than this, in degrees, share cells of this size.
SMALLEST = 2.0**-12

def _cell(degrees: Column, level: Column) -> Column:
    """Number of the grid cell at a level, whose cells measure ``2 ** level`` degrees."""
    return F.floor(degrees / F.pow(F.lit(2.0), level)).cast("long")


def polygon_rings(locations: DataFrame) -> DataFrame:
    """One row per polygon ring with its bounding box and the level of cells at least as wide and as high as the box."""
    xs, ys = F.transform("ring", lambda p: p["longitude"]), F.transform("ring", lambda p: p["latitude"])
    boxed = locations.select("zipcode", "city", F.explode("polygons.points").alias("ring")).withColumns({
        "min_lon": F.array_min(xs), "max_lon": F.array_max(xs), "min_lat": F.array_min(ys), "max_lat": F.array_max(ys),
    })
    extent = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"), F.lit(SMALLEST))
    return boxed.where(F.size("ring") > 0).withColumns({
        "number": F.monotonically_increasing_id(), "level": F.ceil(F.log2(extent)).cast("int"),
    })


def polygon_cells(rings: DataFrame) -> DataFrame:
    """Bounding boxes by the cells of their level they touch: four at most, however large a ring is."""
    level = F.col("level")
    span = lambda low, high: F.explode(F.sequence(_cell(F.col(low), level), _cell(F.col(high), level)))
    return (
        rings.select("number", "level", "min_lon", "max_lon", "min_lat", "max_lat")
        .withColumn("cell_lon", span("min_lon", "max_lon"))
        .withColumn("cell_lat", span("min_lat", "max_lat"))
    )


def _segments(ring: Column) -> Column:
    """Edges of a ring, from each vertex to the next and from the last to the first.

    A ring that repeats its first vertex at the end gets one edge of length zero,
    which no ray crosses and which holds no point besides that vertex.
    """
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(
        a["longitude"].alias("x0"), a["latitude"].alias("y0"),
        b["longitude"].alias("x1"), b["latitude"].alias("y1"),
    ))


def ring_edges(rings: DataFrame) -> DataFrame:
    """``(number, x0, y0, x1, y1, level, strip)``: every edge of every ring in the strips of latitude it touches.

    An edge is put into strips about as high as itself, so it is in two of them at most, however the heights of a ring's edges differ.
    """
    edges = rings.select("number", F.inline(_segments(F.col("ring"))))
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    edges = edges.withColumn("level", F.ceil(F.log2(F.greatest(high - low, F.lit(SMALLEST)))).cast("int"))
    return edges.withColumn("strip", F.explode(F.sequence(_cell(low, F.col("level")), _cell(high, F.col("level")))))


def inside_rings(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of ``pairs(lat, lon, number)`` whose point lies strictly inside the ring (points on an edge do not).

    A point meets the edges of its own strip at each level of the ring, and no others; how many of them an eastward ray
    crosses is added up. So neither a ring nor its edges are ever in one place, and a ring of very many vertices costs a point about as
    much as a small one. ``edges`` are a table.
    """
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    levels = edges.select("number", "level").distinct()
    asked = pairs.join(levels, "number").withColumn("strip", _cell(lat, F.col("level")))
    side = (F.col("x1") - F.col("x0")) * (lat - F.col("y0")) - (lon - F.col("x0")) * (F.col("y1") - F.col("y0"))
    # An eastward ray crosses an edge iff the edge spans the latitude and, seen along its upward direction, the point lies to the left.
    spans = (F.col("y0") > lat) != (F.col("y1") > lat)
    crossed = spans & F.when(F.col("y1") > F.col("y0"), side > 0).otherwise(side < 0)
    within = lambda at, a, b: at.between(F.least(a, b), F.greatest(a, b))
    touched = within(lat, "y0", "y1") & within(lon, "x0", "x1") & (side == 0)
    met = asked.join(edges, ["number", "level", "strip"]).where(crossed | touched)
    counted = met.groupBy("lat", "lon", "number").agg(F.count_if(crossed).alias("crossings"), F.bool_or(touched).alias("touched"))
    return counted.where("crossings % 2 = 1 and not touched").select("lat", "lon", "number")


def point_in_polygon(points: DataFrame, locations: DataFrame) -> DataFrame:
    """``points`` (with ``lat``, ``lon``) inside a location, plus ``zipcode`` and ``city``.

    Every ring lies in cells of about its own size, so a point meets, at each of the few levels in use, only rings that
    are as near as they are large. That join and the box test work on narrow rows; the pairs that are left meet edges by strips of
    latitude. Of several locations that hold a point the smallest zipcode wins. The result has one row
    per distinct point.
    """
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    rings = written(polygon_rings(locations), "rings")
    levels = sorted(r[0] for r in rings.select("level").distinct().collect())  # powers of two between SMALLEST and 360 degrees
    placed = points.select("lat", "lon").distinct().withColumn(
        "level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))
    ).withColumns({"cell_lon": _cell(lon, F.col("level")), "cell_lat": _cell(lat, F.col("level"))})
    in_box = (lon >= F.col("min_lon")) & (lon <= F.col("max_lon")) & (
        (lat >= F.col("min_lat")) & (lat <= F.col("max_lat"))
    )
    near = placed.join(polygon_cells(rings), ["level", "cell_lon", "cell_lat"]).where(in_box).select("lat", "lon", "number")
    inside = inside_rings(near, written(ring_edges(rings), "edges"))
    return (
        inside.join(rings.select("number", "zipcode", "city"), "number")
        .groupBy("lat", "lon")
        .agg(F.min(F.struct("zipcode", "city")).alias("hit"))
        .select("lat", "lon", "hit.zipcode", "hit.city")
    )


def with_city(readings: DataFrame, lookup: DataFrame) -> DataFrame:
    """Readings with the city ``lookup`` gives for their coordinate; others are dropped.

    Spark broadcasts the lookup if its table is below the threshold. Otherwise both sides are shuffled by
    coordinate, and partitions a much-used sensor makes too large are split at run time by what was measured of them.
    """
    return readings.drop("city").join(lookup.select("lat", "lon", "city"), ["lat", "lon"])


def locate(readings: DataFrame, locations: DataFrame) -> DataFrame:
    """Readings with the ``city`` they lie in; each distinct coordinate is looked up once."""
    return with_city(readings, point_in_polygon(readings, locations))
