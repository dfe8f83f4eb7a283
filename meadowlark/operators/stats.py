"""Statistics of feature tables; medians and quantiles are exact, with linear interpolation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell_centre
from ..sources.storage import written
from .relational import average_rank, quantiles, with_quantiles

# The least evidence for a habitat comparison.
MIN_HABITAT_SIDE, MIN_HABITAT_PAIRS = 2, 4


def finite(column: str) -> Column:
    return F.when(~F.isnan(column) & (F.abs(F.col(column)) != float("inf")), F.col(column))


def statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a column: n, missing, mean, sample sd (null if n < 2), min, quartiles, max of its finite values."""
    def of(c: str) -> Column:
        v = finite(c)
        sd = F.when(F.count(v) >= 2, F.stddev_samp(v))
        return F.struct(F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), sd.alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))

    quarters = {f"q{i}_{j}": (finite(c), j / 4) for i, c in enumerate(columns) for j in (1, 2, 3)}
    one = df.agg(*(of(c).alias(f"s{i}") for i, c in enumerate(columns))).crossJoin(F.broadcast(quantiles(df, quarters)))
    rows = [F.struct(F.lit(c).alias("column"), *(F.col(f"s{i}.{f}").alias(f) for f in ("n", "missing", "mean", "sd", "min")), *(F.col(f"q{i}_{j}").alias(f) for j, f in enumerate(("q1", "median", "q3"), 1)), F.col(f"s{i}.max").alias("max")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def distribution(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, n) over equal widths from the least to the greatest finite value."""
    values = df.select(finite(column).alias("v")).where("v is not null")
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    return values.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def habitat_split(df: DataFrame, environment: str, value: str = "displacement_km") -> DataFrame:
    """Median ``value`` where the environment is above its own median, and where it isn't; null sides below two rows.

    No row without four rows that have both.
    """
    both = written(df.where(F.col(environment).isNotNull() & F.col(value).isNotNull()).select(environment, value))
    middle = quantiles(both, {"threshold": (F.col(environment), 0.5)})
    above = F.col(environment) > F.col("threshold")
    sides = both.crossJoin(F.broadcast(middle))
    counts = sides.agg(F.max("threshold").alias("threshold"), F.count("*").alias("pairs"), F.count_if(above).alias("n_above"), F.count_if(~above).alias("n_below"))
    medians = quantiles(sides, {"median_above": (F.when(above, F.col(value)), 0.5), "median_below": (F.when(~above, F.col(value)), 0.5)})
    split = counts.crossJoin(F.broadcast(medians))
    enough = lambda n, c: F.when(F.col(n) >= MIN_HABITAT_SIDE, F.col(c)).alias(c)
    return split.where(F.col("pairs") >= MIN_HABITAT_PAIRS).select("threshold", "pairs", "n_above", "n_below", enough("n_above", "median_above"), enough("n_below", "median_below"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Of the rows with both finite: n, Pearson, Spearman (average ranks), r squared, OLS line, excluded rows.

    No row if there are fewer than three pairs or one side doesn't vary.
    """
    pairs = written(df.select(finite(x).alias("x"), finite(y).alias("y")))
    both = pairs.where("x is not null and y is not null")
    ranked = average_rank(average_rank(both, "x", "rx"), "y", "ry")
    pearson = F.corr("x", "y")
    out = ranked.agg(F.count("*").alias("n"), pearson.alias("pearson"), F.corr("rx", "ry").alias("spearman"), (pearson * pearson).alias("r2"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count_distinct("x").alias("vx"), F.count_distinct("y").alias("vy"))
    total = pairs.agg(F.count("*").alias("total"))
    return out.crossJoin(total).where("n >= 3 and vx > 1 and vy > 1").select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "pearson", "spearman", "r2", "slope", "intercept", (F.col("total") - F.col("n")).alias("excluded"))


def correlations(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``correlation`` of every two of the variables."""
    df = written(df.select(*variables))
    parts = [correlation(df, a, b) for a, b in combinations(variables, 2)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def trend(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """A UTC day's median of each variable; null where a day has no value."""
    return df.groupBy("day").agg(*(F.median(v).alias(v) for v in variables))


def environment_summary(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(variable, n, median)."""
    medians = quantiles(df, {f"m{i}": (F.col(v), 0.5) for i, v in enumerate(variables)})
    one = df.agg(*(F.count(v).alias(f"n{i}") for i, v in enumerate(variables))).crossJoin(F.broadcast(medians))
    return one.select(F.inline(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("median")) for i, v in enumerate(variables)))))


def regional_median(vegetation: DataFrame) -> DataFrame:
    counts = vegetation.groupBy("composite").agg(F.count("index_value").alias("n"))
    return with_quantiles(counts, vegetation, {"median": (F.col("index_value"), 0.5)}, ["composite"])


def index_change(vegetation: DataFrame) -> DataFrame:
    """A cell's mean an index composite, and its difference to the composite before."""
    means = vegetation.groupBy("cell", "composite").agg(F.avg("index_value").alias("mean"))
    return means.withColumn("change", F.col("mean") - F.lag("mean").over(Window.partitionBy("cell").orderBy("composite")))


def binned_response(df: DataFrame, x: str, edges: Sequence[float], y: str, above: float) -> DataFrame:
    """(bin, n, median, mean, share of y over ``above``) by half-open bins (edge, next edge]."""
    place = F.coalesce(*(F.when((F.col(x) > a) & (F.col(x) <= b), F.lit(i)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    rows = df.withColumn("bin", place).where(F.col("bin").isNotNull() & F.col(y).isNotNull()).select("bin", y)
    sums = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.avg((F.col(y) > above).cast("double")).alias("share_above"))
    return with_quantiles(sums, rows, {"median": (F.col(y), 0.5)}, ["bin"])


def period_response(days: DataFrame) -> DataFrame:
    """A composite's animals and medians of distance, latitude, index and change."""
    return days.groupBy("composite").agg(F.count_distinct("entity_id").alias("animals"), *(F.median(c).alias(f"median_{c}") for c in ("displacement_km", "latitude", "index_value", "change")))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def monthly_cells(observations: DataFrame) -> DataFrame:
    return observations.groupBy(F.date_format("time_start", "yyyy-MM").alias("month"), "variable").agg(F.count("*").alias("records"), F.count_distinct("cell").alias("cells"), F.avg("value").alias("mean"), F.count("value").alias("values"))


def index_summary(df: DataFrame, source: str, first: Column, last: Column) -> DataFrame:
    """(variable, n, present, mean): rows, rows with a value and their mean, to 3 places, of a source's UTC days first to last."""
    rows = df.where((F.col("source_id") == source) & F.to_date("time_start").between(first, last))
    return rows.groupBy("variable").agg(F.count("*").alias("n"), F.count("value").alias("present"), F.round(F.avg("value"), 3).alias("mean"))


def zonal_sums(pixels: DataFrame) -> DataFrame:
    """(cell, variable): sum, sum of squares and number of the values; sums of parts add up to those of the whole."""
    v = F.col("value")
    return pixels.where(v.isNotNull()).groupBy("cell", "variable").agg(F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.count("*").alias("pixel_count"))


def zonal_stats(pixels: DataFrame, pixels_per_cell: float, min_valid: float = 0.5) -> DataFrame:
    """(cell, variable): mean, population sd, valid_fraction, pixel_count; values are null below ``min_valid``.

    A cell without a valid pixel has no row.
    """
    mean = F.col("total") / F.col("pixel_count")
    sd = F.sqrt(F.greatest(F.col("squares") / F.col("pixel_count") - mean * mean, F.lit(0.0)))
    fraction = F.least(F.col("pixel_count") / F.lit(float(pixels_per_cell)), F.lit(1.0))
    ok = fraction >= min_valid
    return zonal_sums(pixels).select("cell", "variable", F.when(ok, mean).alias("value"), F.when(ok, sd).alias("std"), fraction.alias("valid_fraction"), "pixel_count")


# What an item says of all its rows.
ITEM_COLUMNS = ("time_start", "time_end", "time_precision", "available_at", "source_id", "processing_version", "product_status", "series_id")


def to_cell_observations(zones: DataFrame, items: DataFrame, units: DataFrame, mapping_version: str, stat: str, resolution_m: float) -> DataFrame:
    """Zonal statistics as cell observations, each with what its item, the mapping and the unit table say.

    ``zones`` has source_item_id, cell, variable, value, std, valid_fraction and pixel_count; ``items`` has source_item_id and
    ITEM_COLUMNS, ``units`` variable and unit; both have a row a key, or the query fails. A row of an unknown item fails it
    too, as observations must have a time; the unit of an unknown variable is null. Spark broadcasts the two if they are small.
    """
    once = lambda df, key, columns: df.groupBy(key).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in columns)).withColumn(
        key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{key} twice: "), F.col(key).cast("string"))).cast("string"))).drop("_n")
    stamped = zones.join(once(items, "source_item_id", ITEM_COLUMNS).withColumn("_known", F.lit(True)), "source_item_id", "left").join(once(units, "variable", ["unit"]), "variable", "left")
    known = F.when(F.col("_known"), F.col("source_item_id")).otherwise(F.raise_error(F.concat(F.lit("unknown item: "), F.coalesce("source_item_id", F.lit("null")))).cast("string"))
    return stamped.select(F.col("series_id").alias("dataset_id"), "cell", "variable", "value", "std", "valid_fraction", "pixel_count", "unit", known.alias("source_item_id"), *(c for c in ITEM_COLUMNS if c != "series_id"),
                          F.lit(mapping_version).alias("mapping_version"), F.lit(stat).alias("stat"), F.lit(float(resolution_m)).alias("source_resolution_m"), cell_flag(F.col("value"), F.col("product_status")).alias("quality_flag"))


def sample_cell_centres(cells: DataFrame, source: DataFrame, raster: tuple[float, float, float, float, int, int], value: str = "value") -> DataFrame:
    """``cells`` (row, col) with the value of the pixel of a coarser source that lies under each cell's centre.

    ``source`` has pixel_row, pixel_col and the value; ``raster`` is its north-up place in degrees: west, north, width and
    height of a pixel, rows, columns. Centres are unprojected and looked up by arithmetic, so cells and pixels meet by
    equal pixels; cells outside the raster, or over a pixel that isn't there, are left out.
    """
    west, north, wide, high, rows, cols = raster
    lon, lat = cell_centre(F.col("row"), F.col("col"))
    placed = cells.select("*", F.floor((F.lit(float(north)) - lat) / high).alias("pixel_row"), F.floor((lon - west) / wide).alias("pixel_col"))
    inside = placed.where(F.col("pixel_row").between(0, rows - 1) & F.col("pixel_col").between(0, cols - 1))
    return inside.join(source.select("pixel_row", "pixel_col", value), ["pixel_row", "pixel_col"]).select(*cells.columns, "pixel_row", "pixel_col", value)


def cell_flag(value: Column, status: Column) -> Column:
    return F.when(value.isNull(), "low_valid_fraction").when(status == "preliminary", "preliminary").otherwise("ok")


def fix_flag(visible: Column) -> Column:
    return F.when(F.lower(visible).isin("true", "1"), "ok").otherwise("marked_outlier")
