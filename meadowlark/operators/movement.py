"""Tracks of animals: days, steps, gaps, revisits, residence, boundaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import geodesic_km, inside_fraction, point_in_polygon, segment_km
from .joins import CellSpread, all_finite
from .relational import quantiles, with_quantiles

Distance = Callable[[Column, Column, Column, Column], Column]


def last_fix_of_day(fixes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """An animal's last fix of each UTC day (ties to the largest record id), with the day's ``fix_count``."""
    day = Window.partitionBy(*keys, "entity_id", "day")
    ordered = day.orderBy(F.desc("observed_at"), F.desc("source_record_id"))
    dated = fixes.withColumn("day", F.to_date("observed_at"))
    return dated.select("*", F.row_number().over(ordered).alias("_place"), F.count("*").over(day).alias("fix_count")).where("_place = 1").drop("_place")


def first_fix_of_day(fixes: DataFrame) -> DataFrame:
    day = Window.partitionBy("entity_id", "day").orderBy("observed_at", "source_record_id")
    return fixes.withColumn("day", F.to_date("observed_at")).withColumn("_place", F.row_number().over(day)).where("_place = 1").drop("_place")


def with_previous(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    track = Window.partitionBy(*keys, "entity_id").orderBy("day")
    return daily.withColumns({f"previous_{c}": F.lag(c).over(track) for c in ("day", "longitude", "latitude", "available_at") if c in daily.columns})


def with_next(df: DataFrame, entity: str, time: str, columns: Sequence[str]) -> DataFrame:
    track = Window.partitionBy(entity).orderBy(time)
    return df.withColumns({f"next_{c}": F.lead(c).over(track) for c in columns})


def daily_movement(fixes: DataFrame, keys: Sequence[str] = (), distance: Distance = geodesic_km) -> DataFrame:
    """A row an animal and UTC day: the last good fix, fix_count, and km from the last good fix of the day before.

    Only fixes of quality ``ok`` count. The displacement is null if the day before has none: gaps are never bridged.
    ``available_at`` is that of the later of the two fixes if there is a displacement, else that of the day's own.
    """
    good = fixes.where("quality_flag = 'ok'")
    steps = with_previous(last_fix_of_day(good, keys), keys)
    adjacent = F.datediff("day", "previous_day") == 1
    km = F.when(adjacent, distance(F.col("previous_longitude"), F.col("previous_latitude"), F.col("longitude"), F.col("latitude")))
    available = [F.when(adjacent, F.greatest("available_at", "previous_available_at")).otherwise(F.col("available_at")).alias("available_at")] if "available_at" in fixes.columns else []
    return steps.select(*keys, "entity_id", "day", "longitude", "latitude", "cell", "fix_count", km.alias("displacement_km"), *available)


def movement_summary(df: DataFrame) -> DataFrame:
    """One row: animals, rows, days, displacements, missing ones, their sum and median, gap days, first and last day."""
    totals = df.agg(F.count_distinct("entity_id").alias("animals"), F.count("*").alias("rows"), F.count_distinct("day").alias("days"), F.count("displacement_km").alias("displacements"),
                    F.count_if(F.col("displacement_km").isNull()).alias("missing"), F.sum("displacement_km").alias("total_km"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    # A gap day is one of an animal's own span without a row.
    spans = df.groupBy("entity_id").agg((F.datediff(F.max("day"), F.min("day")) + 1 - F.count_distinct("day")).alias("gaps"))
    median = quantiles(df, {"median_km": (F.col("displacement_km"), 0.5)})
    out = totals.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(spans.agg(F.sum("gaps").alias("gap_days"))))
    return out.select("animals", "rows", "days", "displacements", "missing", "total_km", "median_km", "first_day", "last_day", "gap_days")


def missing_days(df: DataFrame) -> DataFrame:
    """(entity_id, day) of the calendar days inside an animal's span that have no row, from the jumps between its days."""
    track = Window.partitionBy("entity_id").orderBy("day")
    jumps = df.select("entity_id", "day").distinct().withColumn("next", F.lead("day").over(track)).where("datediff(next, day) > 1")
    return jumps.select("entity_id", F.explode(F.sequence(F.date_add("day", 1), F.date_sub("next", 1))).alias("day"))


def timeline(df: DataFrame, column: str = "displacement_km") -> DataFrame:
    """A day's median and number of animals."""
    return df.groupBy("day").agg(F.median(column).alias("median"), F.count_distinct("entity_id").alias("animals"))


def track_map(df: DataFrame) -> DataFrame:
    """A line of (time, lon, lat) an animal of two points or more, with the number of rows without coordinates."""
    point = F.when(F.col("longitude").isNotNull() & F.col("latitude").isNotNull(), F.struct("observed_at", "longitude", "latitude"))
    lines = df.groupBy("entity_id").agg(F.array_sort(F.collect_list(point)).alias("line"), F.count_if(point.isNull()).alias("missing"))
    return lines.where(F.size("line") >= 2)


def last_points(df: DataFrame, time: str = "observed_at") -> DataFrame:
    """Each animal's last row, if that has coordinates."""
    last = df.groupBy("entity_id").agg(F.max_by(F.struct("longitude", "latitude", time), F.struct(time, "source_record_id")).alias("at"))
    return last.where("at.longitude is not null and at.latitude is not null").select("entity_id", "at.*")


def revisits(df: DataFrame, cell: str = "cell") -> DataFrame:
    """A cell's observations, animals, and animals with two rows or more; null cells are left out."""
    each = df.where(F.col(cell).isNotNull()).groupBy(cell, "entity_id").count()
    return each.groupBy(cell).agg(F.sum("count").alias("observations"), F.count("*").alias("animals"), F.count_if(F.col("count") >= 2).alias("repeat_animals"))


def monthly_movement(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("records"), F.count_distinct("entity_id").alias("animals"), F.sum("fix_count").alias("fixes"),
                                                                             F.count("displacement_km").alias("displacements"), F.sum("displacement_km").alias("total_km"), F.avg("displacement_km").alias("mean_km"))


def compare_windows(df: DataFrame, windows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Two named windows (name, first day, last day): animals, rows, displacements and their median."""
    if len(windows) != 2 or windows[0][0] == windows[1][0]:
        raise ValueError("two windows of different names")
    named = F.array(*(F.struct(F.lit(n).alias("window"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in windows))
    rows = df.withColumn("w", F.explode(named)).where("to_date(day) between w.a and w.b").withColumn("window", F.col("w.window"))
    counts = rows.groupBy("window").agg(F.count_distinct("entity_id").alias("animals"), F.count("*").alias("rows"), F.count("displacement_km").alias("displacements"))
    return with_quantiles(counts, rows, {"median_km": (F.col("displacement_km"), 0.5)}, ["window"])


def route_overlap(df: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(name, entity_id): points inside, km of path, km inside, and their share (0 for a path of no length).

    ``boundaries`` has name and rings. Steps meet boundaries whose box touches theirs, by coarse cells; only those are
    clipped. Fixes without finite coordinates are left out. A path is measured once an animal. The result has a row for each boundary and animal.
    """
    steps = with_next(df.where(all_finite("longitude", "latitude")), "entity_id", "observed_at", ["longitude", "latitude"])
    here, ahead = (F.col("longitude"), F.col("latitude")), (F.col("next_longitude"), F.col("next_latitude"))
    km = F.when(ahead[0].isNotNull(), segment_km(*here, *ahead))
    paths = steps.groupBy("entity_id").agg(F.coalesce(F.sum(km), F.lit(0.0)).alias("path_km"))
    box = (F.least(here[0], ahead[0]), F.least(here[1], ahead[1]), F.greatest(here[0], ahead[0]), F.greatest(here[1], ahead[1]))
    narrow = steps.select("entity_id", "longitude", "latitude", "next_longitude", "next_latitude")
    pairs = CellSpread(boundaries.select("name", "rings"), "rings").meet(narrow, box)
    inside = F.when(ahead[0].isNotNull(), km * inside_fraction(*here, *ahead, F.col("rings")))
    met = pairs.groupBy("name", "entity_id").agg(F.count_if(point_in_polygon(*here, F.col("rings"))).alias("points_inside"), F.sum(inside).alias("inside_km"))
    every = boundaries.select("name").distinct().crossJoin(paths)  # the rows of the result
    out = every.join(met, ["name", "entity_id"], "left").select("name", "entity_id", F.coalesce("points_inside", F.lit(0)).alias("points_inside"), "path_km", F.coalesce("inside_km", F.lit(0.0)).alias("inside_km"))
    return out.withColumn("share", F.when(F.col("path_km") > 0, F.col("inside_km") / F.col("path_km")).otherwise(0.0))


def residence_intervals(df: DataFrame, value: str = "vegetation_index", max_gap_hours: float = 6) -> DataFrame:
    """Intervals between an animal's fixes in turn: hours, both values, and ``state`` usable, gap or unmeasured."""
    extra = [c for c in ("valid_from", "valid_until") if c in df.columns]
    steps = with_next(df, "entity_id", "observed_at", ["observed_at", value, "longitude", "latitude", *extra]).where("next_observed_at is not null")
    t0, t1 = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("observed_at", "next_observed_at"))
    hours = (t1 - t0) / 3.6e9
    known = F.lit(True)
    for c in (value, f"next_{value}", "longitude", "next_longitude", "latitude", "next_latitude"):
        known = known & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    if extra:
        us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        middle = (t0 + t1) / 2
        known = known & F.coalesce((us("valid_from") <= t0) & (us("next_valid_from") <= middle) & (us("valid_until") >= middle) & (us("next_valid_until") > t1), F.lit(False))
    state = F.when((hours <= 0) | (hours > max_gap_hours), "gap").when(known, "usable").otherwise("unmeasured")
    return steps.select("entity_id", "observed_at", "next_observed_at", value, f"next_{value}", hours.alias("hours"), state.alias("state"))


def residence_time(df: DataFrame, value: str = "vegetation_index", max_gap_hours: float = 6) -> DataFrame:
    """An animal's hours above and at most at the threshold, share above, weighted mean, and excluded hours.

    Half an interval goes to the value at each of its ends. The threshold is the median value of the fixes that usable
    intervals touch, of all animals.
    """
    steps = residence_intervals(df, value, max_gap_hours)
    usable = steps.where("state = 'usable'")
    half = (F.col("hours") / 2).alias("hours")
    ends = usable.select("entity_id", "observed_at", F.col(value).alias("value"), half).unionByName(usable.select("entity_id", F.col("next_observed_at").alias("observed_at"), F.col(f"next_{value}").alias("value"), half))
    threshold = quantiles(ends.groupBy("entity_id", "observed_at").agg(F.max("value").alias("value")), {"threshold": (F.col("value"), 0.5)})
    spent = ends.crossJoin(F.broadcast(threshold)).groupBy("entity_id", "threshold").agg(
        F.sum("hours").alias("hours"), F.coalesce(F.sum(F.when(F.col("value") > F.col("threshold"), F.col("hours"))), F.lit(0.0)).alias("hours_above"), (F.sum(F.col("value") * F.col("hours")) / F.sum("hours")).alias("weighted_mean"))
    left_out = steps.groupBy("entity_id").agg(*(F.coalesce(F.sum(F.when(F.col("state") == s, F.col("hours"))), F.lit(0.0)).alias(f"{s}_hours") for s in ("gap", "unmeasured")), F.count_if(F.col("state") == "usable").alias("intervals"))
    return spent.join(left_out, "entity_id").withColumn("share_above", F.col("hours_above") / F.col("hours"))
