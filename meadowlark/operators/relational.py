"""Projections, filters, aggregates and row selection with explicit rules for nulls, ties and duplicates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

MAX_LIST = 1000
_ZONED = re.compile(r"\d{4}-\d{2}-\d{2}[T ][0-9:.]+(Z|[+-]\d{2}:?\d{2})")


class CheckFailed(ValueError):
    """A check on data found rows that break a rule; ``code`` names the rule."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def select_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``{new name: source}``; new names must differ from each other, whatever their case."""
    if len({c.lower() for c in columns}) < len(columns):
        raise ValueError("output columns collide")
    return df.select(*(F.col(source).alias(name) for name, source in columns.items()))


def filter_rows(df: DataFrame, predicates: Sequence[tuple]) -> DataFrame:
    """Rows for which all (column, operator, value) hold: eq ne lt le gt ge in is_null not_null.

    A null satisfies no comparison, ``ne`` included. Timestamps compare with ISO texts that carry a zone.
    """
    def test(name: str, operator: str, value: object = None) -> Column:
        c, kind = F.col(name), df.schema[name].dataType.simpleString()

        def literal(v: object) -> Column:
            if kind.startswith("timestamp") and isinstance(v, str):
                if not _ZONED.fullmatch(v):
                    raise ValueError(f"{v!r} has no time zone")
                at = F.to_timestamp(F.lit(v))
                return at if kind == "timestamp" else F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
            return F.lit(v)

        if operator == "is_null":
            return c.isNull()
        if operator == "not_null":
            return c.isNotNull()
        if operator == "in":
            if not 1 <= len(value) <= MAX_LIST:
                raise ValueError(f"a list has 1 to {MAX_LIST} values")
            return c.isin(*map(literal, value))
        compare = {"eq": Column.__eq__, "ne": Column.__ne__, "lt": Column.__lt__, "le": Column.__le__, "gt": Column.__gt__, "ge": Column.__ge__}
        return compare[operator](c, literal(value))

    return df.where(reduce(Column.__and__, (test(*p) for p in predicates), F.lit(True)))


def time_bucket(df: DataFrame, column: str, output: str, period: str) -> DataFrame:
    """Start of the UTC day, month or year of a time, as ``output``; null stays null."""
    if period not in ("day", "month", "year"):
        raise ValueError("period is day, month or year")
    kind = df.schema[column].dataType.simpleString()
    return df.withColumn(output, F.date_trunc(period, column).cast(kind))


def aggregate(df: DataFrame, group_by: Sequence[str], aggregations: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(column, method, output) of sum, mean, min, max, count by group; nulls are left out, a null key is a group.

    The sum and the mean of nothing are null; ``count`` counts values.
    """
    if not group_by:
        raise ValueError("at least one key")
    methods = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
    return df.groupBy(*group_by).agg(*(methods[m](c).alias(o) for c, m, o in aggregations))


def in_time_range(df: DataFrame, time: str, start: object, end: object) -> DataFrame:
    """Both ends are inside."""
    return df.where(F.col(time).between(start, end))


def in_interval_range(df: DataFrame, start_col: str, end_col: str, start: Column, end: Column, lookback_s: int = 0) -> DataFrame:
    """Whole intervals inside [start - lookback, end]."""
    return df.where((F.col(start_col) >= widen(start, lookback_s)) & (F.col(end_col) <= end))


def widen(start: Column, lookback_s: int) -> Column:
    return start - F.make_dt_interval(secs=F.lit(lookback_s))


def in_bbox(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float]) -> DataFrame:
    west, south, east, north = box
    return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def in_region(df: DataFrame, lon: str, lat: str, rings: Sequence[Sequence[tuple[float, float]]]) -> DataFrame:
    """Points in a polygon, its boundary included. The box is tested first, so that it reaches the scan."""
    from ..functions.geo import point_in_polygon

    xs, ys = zip(*(p for ring in rings for p in ring), strict=True)
    literal = F.array(*(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring)) for ring in rings))
    return in_bbox(df, lon, lat, (min(xs), min(ys), max(xs), max(ys))).where(point_in_polygon(F.col(lon), F.col(lat), literal))


def is_in(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows with one of the values; no values, no filter."""
    return df.where(F.col(column).isin(*values)) if values else df


def in_scope(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows of the allowed scopes; ``public`` always is."""
    return df.where(F.col(column).isin("public", *allowed))


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def mask_nonfinite(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinities become null."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in columns})


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")


def sorted_output(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*(F.asc_nulls_last(k) for k in keys))


def limited(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows with ``total_records`` and ``truncated``."""
    total = df.agg(F.count("*").alias("total_records"))
    first = df.orderBy(*(F.asc_nulls_last(k) for k in order)).limit(n)
    return first.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total_records") > n)


def sample_rows(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows, all of them if there are fewer: for a look at a table."""
    return df.limit(n)


def guard_rows(df: DataFrame, n: int = 100_000) -> DataFrame:
    """``df``, if it has at most ``n`` rows; no more than n + 1 are counted."""
    if df.limit(n + 1).count() > n:
        raise CheckFailed("ROW_LIMIT", f"more than {n} rows")
    return df


def running_total(df: DataFrame, order: str, value: str, output: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row, in the order of a column; rows of equal order get the same sum.

    Rows are dealt by ranges of (by, order) and written. Each part is summed, and the sums of the parts before are added to
    the running sums inside a part. No task orders more than a part, but for the parts' own sums.
    """
    # Ranges are sampled: a second run could cut elsewhere.
    parts = written(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*(F.col(k).alias(f"_by_{i}") for i, k in enumerate(by)), F.col("_part").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.col("_part") == F.col("_at")
    for i, k in enumerate(by):
        own = own & F.col(k).eqNullSafe(F.col(f"_by_{i}"))
    inside = F.sum(value).over(Window.partitionBy(*by, "_part").orderBy(order))
    return parts.withColumn("_inside", inside).join(offsets, own).select(*df.columns, (F.coalesce("_inside", F.lit(0)) + F.col("_before")).alias(output))


def numbered(df: DataFrame, order: Sequence[Column], output: str) -> DataFrame:
    """Adds the place of each row (from 1) in an order without ties: rows are dealt by ranges and written, each part is
    numbered, and the sizes of the parts before are added. Only those sizes meet in one task."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_inside", inside).join(offsets, "_part").withColumn(output, F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")


def collected(df: DataFrame, by: Sequence[str], columns: Sequence[str], order: Sequence[str], output: str) -> DataFrame:
    """(by, output): a group's values in the order of columns, nulls first; one column as values, several as structs.

    A group is one array in one task: for groups of bounded size, such as the batches of a series.
    """
    ordered = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*columns).alias("value"))))
    value = (lambda x: x["value"][columns[0]]) if len(columns) == 1 else (lambda x: x["value"])
    return df.groupBy(*by).agg(F.transform(ordered, value).alias(output))


def through(df: DataFrame, order: str, last: object, value: str, output: str) -> DataFrame:
    """Rows up to and with ``last`` (a selected month, say), with their running total."""
    return running_total(df.where(F.col(order) <= F.lit(last)), order, value, output)


def average_rank(df: DataFrame, column: str, output: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the rank of a value, ties sharing the mean of their ranks; nulls have none, and a null key is a group.

    Ranks come from running totals over the counts of distinct values, so that ties meet before anything is ordered.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    placed = running_total(counts, column, "_n", "_upto", by)
    ranks = placed.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(by)), F.col(column).alias("_value"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(output))
    same = F.col(column) == F.col("_value")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return df.join(ranks, same, "left").select(*df.columns, output)


def quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column, float]], accuracy: int = 100_000, by: Sequence[str] = ()) -> DataFrame:
    """For each name the exact quantile of a column's non-null values, with linear interpolation; null without any.

    One row, or one for each group of the columns ``by`` (a null key is a group). Approximate quantiles of bounded size
    give two values that a wanted one lies between. What is below and above these is only counted, so that a task orders
    the distinct values between them, some 4 in ``accuracy`` of a group's rows.
    """
    margin = 2 / accuracy
    shares = [q for _, q in wanted.values()]
    keys = [f"_k{i}" for i in range(len(by))]
    values = df.select(*(F.col(k).alias(n) for k, n in zip(by, keys, strict=True)), *(c.cast("double").alias(f"v{i}") for i, (c, _) in enumerate(wanted.values())))
    bounds = (F.struct(F.count(f"v{i}").alias("n"), F.percentile_approx(f"v{i}", [max(0.0, q - margin), min(1.0, q + margin)], accuracy).alias("at")).alias(f"e{i}") for i, q in enumerate(shares))
    ends = values.groupBy(*keys).agg(*bounds)
    each = [F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"), F.col(f"e{i}.n").alias("total"), F.col(f"e{i}.at").alias("at")) for i in range(len(shares))]
    if by:  # a row a group; Spark broadcasts it if it is small
        sided = ends.withColumnsRenamed({k: f"{k}_end" for k in keys})
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{k}_end")) for k in keys))
        beside = values.join(sided, same)
    else:
        beside = values.crossJoin(F.broadcast(ends))
    rows = beside.select(*keys, F.inline(F.array(*each))).where("v is not null")
    side = F.when(F.col("v") < F.col("at")[0], -1).when(F.col("v") > F.col("at")[1], 1).otherwise(0)
    counted = rows.groupBy(*keys, "i", "total", side.alias("side"), F.when(side == 0, F.col("v")).alias("inside")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "i").orderBy("side", "inside")))
    position = F.array(*map(F.lit, shares))[F.col("i")] * (F.col("total") - 1)
    placed = upto.withColumns({"start": F.col("upto") - F.col("n"), "position": position})

    def ranked(rank: Column) -> Column:
        missed = F.raise_error(F.lit("a quantile lies outside its bounds")).cast("double")
        value = F.when(F.col("side") == 0, F.col("inside")).when((F.col("side") < 0) & (rank == F.col("upto") - 1), F.col("greatest")).when((F.col("side") > 0) & (rank == F.col("start")), F.col("least")).otherwise(missed)
        return F.max(F.when((F.col("start") <= rank) & (rank < F.col("upto")), value))

    found = placed.groupBy(*keys, "i", "position").agg(ranked(F.floor("position")).alias("low"), ranked(F.ceil("position")).alias("high"))
    part = F.col("position") - F.floor("position")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high"))
    out = found.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, value)).alias(name) for i, name in enumerate(wanted)))
    return out.withColumnsRenamed(dict(zip(keys, by, strict=True)))


def with_quantiles(grouped: DataFrame, df: DataFrame, wanted: Mapping[str, tuple[Column, float]], by: Sequence[str]) -> DataFrame:
    """``grouped``, a row for each group of ``df``, with the groups' exact quantiles."""
    found = quantiles(df, wanted, by=by).withColumnsRenamed({k: f"_of_{i}" for i, k in enumerate(by)})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(by)))
    return grouped.join(found, same, "left").select(*grouped.columns, *wanted)


def point_rows(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Rows as GeoJSON: a geometry text and all other columns as a properties text."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    geometry = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    return df.select(geometry.alias("geometry"), F.to_json(F.struct(*rest)).alias("properties"))


def lattice(df: DataFrame, rows: int, cols: int, months: int, start: str = "2024-01-01") -> DataFrame:
    """A row for each place of a lattice and month, beside each row of ``df``."""
    out = df.withColumn("lattice_row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("lattice_col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return out.withColumn("month", F.explode(F.expr(f"sequence(date'{start}', add_months(date'{start}', {months - 1}), interval 1 month)")))
