"""Seasons, anchors, places and weather slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import dimension

EARTH_METRES = 6371000.0


def in_season(day: Column, start: str, end: str) -> Column:
    """Whether a date lies in a season of month and day (MMDD texts), which may run over the turn of the year."""
    at = F.date_format(day, "MMdd")
    s, e = F.col(start), F.col(end)
    return F.when(s <= e, at.between(s, e)).otherwise((at >= s) | (at <= e))


def season_of(df: DataFrame, day: str, options: DataFrame) -> DataFrame:
    """df with the label of the first option (by prio) whose season holds the day; options is a dimension: prio, label, start, end."""
    label: Column = F.lit(None).cast("string")
    for o in sorted(dimension(options.select(F.struct("prio", "label", "start", "end").alias("o")), "o"), key=lambda r: -r["prio"]):
        at = F.date_format(day, "MMdd")
        hit = at.between(o["start"], o["end"]) if o["start"] <= o["end"] else (at >= o["start"]) | (at <= o["end"])
        label = F.when(hit, o["label"]).otherwise(label)
    return df.withColumn("season", label)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_METRES) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


#: Places that a cell of a key should have on average, and the least size of a cell in degrees.
IN_A_CELL, LEAST_CELL = 4, 1e-3


def nearest_place(points: DataFrame, places: DataFrame, keys: list[str], point: str, place: str, in_a_cell: float = IN_A_CELL) -> DataFrame:
    """For each of points (keys, point, lat, lon) the nearest of places (keys, place, lat, lon) with the same keys: point, nearest,
    metres (1 digit; equally far ones count by the least id). The places of each key set the size of its cells, by their number
    and spread, so that a cell has `in_a_cell` of them. A point looks into its cell and the eight around it; what it finds there
    is the nearest, if it is nearer than the edge of these cells. Those that find none or one too far off, which are few, look at
    all places of their keys. Points without a place of their keys are left out. What stands in one spot is one: of places there
    the least id, and points there look once, so piles of either don't multiply."""
    world = places.groupBy(*keys, F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).agg(F.min(place).alias("_place"))
    spread = lambda c: F.greatest(F.max(c) - F.min(c), F.lit(LEAST_CELL))
    wide = F.sqrt(spread("_lat") * spread("_lon") * in_a_cell / F.count("*"))
    # Cells go round the world a whole number of times.
    turns = world.groupBy(*keys).agg(F.greatest(F.lit(4), F.floor(360 / F.greatest(wide, F.lit(LEAST_CELL)))).cast("int").alias("_turns"))
    cell = lambda c: F.floor(F.col(c) / (F.lit(360.0) / F.col("_turns"))).cast("int")
    around = F.expr("explode(transform(sequence(0, 8), i -> struct(CAST(i DIV 3 AS INT) - 1 AS a, CAST(i % 3 - 1 AS INT) AS b)))")
    spots = points.select(*keys, "lat", "lon").distinct()
    looking = spots.join(turns, keys).withColumn("_to", around)
    looking = looking.withColumns({"_i": cell("lat") + F.col("_to.a"), "_j": F.pmod(cell("lon") + F.col("_to.b"), F.col("_turns"))}).drop("_to")
    standing = world.join(turns, keys).withColumns({"_i": cell("_lat"), "_j": F.pmod(cell("_lon"), F.col("_turns"))}).drop("_turns")
    metres = F.round(haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")), 1)
    best = F.min(F.when(F.col("_place").isNotNull(), F.struct(metres.alias("m"), F.col("_place").alias("p")))).alias("best")
    found = looking.join(standing, [*keys, "_i", "_j"], "left").groupBy(*keys, "lat", "lon", "_turns").agg(best)
    edge = F.lit(EARTH_METRES) * F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(F.lit(360.0) / F.col("_turns"))))
    found = found.withColumn("_far", F.coalesce(F.col("best.m") + 0.1 >= edge, F.lit(True))).drop("_turns")
    rest = found.join(world.withColumn("_far", F.lit(True)), [*keys, "_far"], "left")
    last = rest.groupBy(*keys, "lat", "lon", "_far", "best").agg(best.alias("other"))
    chosen = F.when(F.col("_far"), F.col("other")).otherwise(F.col("best"))
    spot = last.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), chosen["p"].alias("nearest"), chosen["m"].alias("metres"))
    here = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("lat", "lon")]
    return points.select(*keys, point, "lat", "lon").distinct().join(spot, here).select(point, "nearest", "metres")


#: The conformal grid of the forecast (kilometres, degrees, origin cell).
GRID = {"re": 6371.00877, "cell": 5.0, "slat1": 30.0, "slat2": 60.0, "olon": 126.0, "olat": 38.0, "xo": 43, "yo": 136}


def grid_cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The cell of the Lambert conformal conic grid."""
    import math

    rad = math.radians
    half = lambda d: math.tan(math.pi / 4 + rad(d) / 2)
    n = math.log(math.cos(rad(GRID["slat1"])) / math.cos(rad(GRID["slat2"]))) / math.log(half(GRID["slat2"]) / half(GRID["slat1"]))
    f = half(GRID["slat1"]) ** n * math.cos(rad(GRID["slat1"])) / n
    scale = GRID["re"] / GRID["cell"]
    origin = scale * f / half(GRID["olat"]) ** n
    radius = F.lit(scale * f) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), n)
    turn = F.radians(lon - GRID["olon"])
    turn = F.when(turn > math.pi, turn - 2 * math.pi).when(turn < -math.pi, turn + 2 * math.pi).otherwise(turn) * n
    return F.floor(radius * F.sin(turn) + GRID["xo"] + 0.5).cast("int"), F.floor(F.lit(origin) - radius * F.cos(turn) + GRID["yo"] + 0.5).cast("int")


def slots_wide(items: DataFrame, keys: list[str], category: str, value: str, order: str, categories: list[str]) -> DataFrame:
    """From category rows to one row for each slot; the last value of a category counts."""
    last = lambda c: F.max_by(F.when(F.col(category) == c, F.col(value)), F.when(F.col(category) == c, F.col(order)))
    return items.groupBy(*keys).agg(*[last(c).alias(c) for c in categories])


def nearest_noon(df: DataFrame, keys: list[str], hour: str, value: str, order: str) -> DataFrame:
    """For each key the value whose hour is nearest to noon, the first in order of equals."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(F.abs(F.col(hour) - 12), F.col(order))).alias(value))


def spine(df: DataFrame, keys: list[str], first: Column, days: int) -> DataFrame:
    """One row for each key and each of `days` days from the first."""
    return df.select(*keys).distinct().select(*keys, F.explode(F.sequence(first, F.date_add(first, days - 1))).alias("day"))


def filled(df: DataFrame, keys: list[str], day: str, value: str, default: float) -> DataFrame:
    """The value of a day, or the last before it, or the default; is_extrapolated says whether it isn't the day's own."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    own = F.col(value)
    return df.withColumns({"is_extrapolated": own.isNull(), value: F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default))})


def release(at: Column, first_hour: int, every_hours: int, lag_minutes: int) -> Column:
    """The time of the newest release at a time, where releases come every few hours (which divide the day) from an hour on
    and can be had some minutes later."""
    step, offset = every_hours * 3600, first_hour * 3600
    seconds = F.unix_seconds(at.cast("timestamp"))
    return F.timestamp_seconds(F.floor((seconds - lag_minutes * 60 - offset) / step) * step + offset)
