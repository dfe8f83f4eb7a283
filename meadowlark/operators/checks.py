"""Checks on data: they fail with a code, or report counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import as_number, as_time, finite
from .relational import CheckFailed


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of several rows, with their ``count``."""
    return df.groupBy(*keys).count().where("count > 1")


def check_unique(df: DataFrame, keys: Sequence[str], nonnull: bool = False, code: str = "DUPLICATE_KEY") -> None:
    if nonnull:
        check_nonnull(df, keys)
    if not duplicates(df, keys).isEmpty():
        raise CheckFailed(code, f"{', '.join(keys)} repeat")


def null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a null in any of the columns."""
    return df.where(reduce(Column.__or__, (F.col(c).isNull() for c in columns)))


def code_of(check: Callable[[], object]) -> str:
    """The code with which a check fails, or ``ok``."""
    try:
        check()
    except CheckFailed as e:
        return e.code
    return "ok"


def check_nonnull(df: DataFrame, columns: Sequence[str]) -> None:
    if not null_rows(df, columns).isEmpty():
        raise CheckFailed("NULL_VALUE", f"null in {', '.join(columns)}")


def overlapping(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Intervals that start before an earlier one of their key has ended."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("previous_end", F.max(end).over(before)).where(F.col(start) < F.col("previous_end"))


def invalid_intervals(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(F.col(start).isNull() | F.col(end).isNull() | (F.col(end) <= F.col(start)))


def check_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> None:
    if not invalid_intervals(df, start, end).isEmpty():
        raise CheckFailed("INVALID_INTERVAL", "null or not positive")
    if not overlapping(df, keys, start, end).isEmpty():
        raise CheckFailed("OVERLAPPING_INTERVALS", f"for {', '.join(keys)}")


def wrong_geometry(df: DataFrame, column: str, kinds: Sequence[str]) -> DataFrame:
    """Rows whose kind of geometry is null or another."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*kinds))


def check_geometry(df: DataFrame, column: str, kinds: Sequence[str]) -> None:
    if not wrong_geometry(df, column, kinds).isEmpty():
        raise CheckFailed("GEOMETRY_TYPE", f"only {', '.join(kinds)}")


def output_report(df: DataFrame, keys: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """One row: rows, null_keys, duplicate_keys, nonfinite numbers."""
    null_key = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    bad = reduce(Column.__or__, ((F.isnan(c) | (F.abs(F.col(c)) == float("inf"))) for c in numbers), F.lit(False))
    counts = df.agg(F.count("*").alias("rows"), F.count_if(null_key).alias("null_keys"), F.count_if(bad).alias("nonfinite"))
    return counts.crossJoin(duplicates(df, keys).agg(F.count("*").alias("duplicate_keys")))


def check_output(df: DataFrame, keys: Sequence[str], numbers: Sequence[str] = (), max_rows: int = 100_000) -> None:
    found = output_report(df, keys, numbers).first()
    if not 0 < found["rows"] <= max_rows or found["null_keys"] or found["duplicate_keys"] or found["nonfinite"]:
        raise CheckFailed("OUTPUT_INVALID", str(found.asDict()))


def off_grain(df: DataFrame, entity: str, time: str, grain: str = "day") -> DataFrame:
    """(entity, at, count) of animals and UTC days, or animals and times (grain ``fix``), with several rows."""
    at = F.to_date(time) if grain == "day" else F.col(time)
    return duplicates(df.select(entity, at.alias("at")), [entity, "at"])


def check_grain(df: DataFrame, entity: str, time: str, grain: str = "day") -> None:
    """One row an animal and UTC day, or an animal and time (grain ``fix``)."""
    if not off_grain(df, entity, time, grain).isEmpty():
        raise CheckFailed("WRONG_GRAIN", f"several rows of a {entity} and {grain}")
    check_nonnull(df, [entity])


def wgs84_report(df: DataFrame, lon: str, lat: str) -> DataFrame:
    return df.agg(F.count_if(~F.col(lon).between(-180, 180)).alias("bad_lon"), F.count_if(~F.col(lat).between(-90, 90)).alias("bad_lat"))


def check_count(df: DataFrame, n: int) -> None:
    if df.count() != n:
        raise CheckFailed("ROW_COUNT", f"not {n} rows")


def count_negative(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column) < 0).alias("negative"), F.count("*").alias("rows"))


def column_quality(df: DataFrame) -> DataFrame:
    """(column, null_count, row_count), in one pass."""
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("null_count"), F.col("n").alias("row_count")) for i, c in enumerate(df.columns)))))


def quarantine(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows to which no rule applies, and the others with the ``reason`` of the first that does."""
    reason = F.coalesce(*(F.when(rule, F.lit(name)) for name, rule in rules))
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def join_report(joined: DataFrame, matches: str) -> DataFrame:
    """Rows, unmatched rows, and rows with several eligible matches, from a join's count of matches."""
    return joined.agg(F.count("*").alias("rows"), F.count_if(F.col(matches) == 0).alias("unmatched"), F.count_if(F.col(matches) > 1).alias("ambiguous"))


def coverage_overlaps(start: Column, end: Column, want_start: Column, want_end: Column, have: Column, want: Column) -> Column:
    """Whether coverage meets a query in time and species; unknown coverage isn't a failure."""
    in_time = F.coalesce((start <= want_end) & (end >= want_start), F.lit(True))
    return in_time & F.coalesce((F.size(want) == 0) | F.arrays_overlap(have, want), F.lit(True))


#: Widest finite values of the kinds that have bounds.
BOUNDS = {"longitude": 180, "latitude": 90}
KINDS = ("number", "integer", "time", *BOUNDS)


def _problem(column: str, kind: str) -> Column:
    """bad (not null, and no value of its kind), nonfinite, outside (of the globe), or null where nothing is wrong."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    c = F.col(f"`{column}`")
    if kind == "time":
        return F.when(c.isNotNull() & as_time(c).isNull(), "bad")
    x = as_number(c)
    found = F.when(c.isNotNull() & x.isNull(), "bad").when(~finite(x), "nonfinite")
    return found.when(F.abs(x) > BOUNDS[kind], "outside") if kind in BOUNDS else found


def type_report(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """(column, kind, rows, nulls, bad, nonfinite, outside, example) of columns that should be of a kind, in one pass.

    ``bad`` values aren't null and can't be read, and ``example`` is the smallest text of one. NaN and infinities are
    nonfinite, and places beyond the globe outside; a value counts once. A row for each column of a table without rows, too.
    """
    each = []
    for c, kind in kinds.items():
        problem = _problem(c, kind)
        of = lambda name, p=problem: F.count_if(F.coalesce(p == name, F.lit(False))).alias(name)
        column = F.col(f"`{c}`")
        each.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.count_if(column.isNull()).alias("nulls"), of("bad"), of("nonfinite"), of("outside"), F.min(F.when(problem == "bad", column.cast("string"))).alias("example")))
    return df.agg(*(e.alias(f"c{i}") for i, e in enumerate(each))).select(F.inline(F.array(*(f"c{i}" for i in range(len(each))))))


def typed(df: DataFrame, kinds: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose columns have their kinds, as doubles and times with values that aren't finite as null; and
    the others as they came, with their ``problems`` as column:problem, in the order of ``kinds``. Integers are doubles
    too, as a fraction isn't a fault. Null has every kind. Nothing is shuffled."""
    problems = F.array_compact(F.array(*(F.when(_problem(c, k).isin("bad", "outside"), F.concat(F.lit(f"{c}:"), _problem(c, k))) for c, k in kinds.items())))
    marked = df.withColumn("problems", problems)
    number = lambda c: F.when(finite(as_number(c)), as_number(c))
    read = {c: as_time(F.col(f"`{c}`")) if k == "time" else number(F.col(f"`{c}`")) for c, k in kinds.items()}
    return marked.where(F.size("problems") == 0).drop("problems").withColumns(read), marked.where(F.size("problems") > 0)


def check_types(df: DataFrame, kinds: Mapping[str, str]) -> None:
    """Fails on values that can't be read (BAD_TIMESTAMP, BAD_NUMBER) or lie outside the globe (OUTSIDE_WGS84), in the order of ``kinds``."""
    found = {r["column"]: r for r in type_report(df, kinds).collect()}
    for c, kind in kinds.items():
        if found[c]["bad"]:
            raise CheckFailed("BAD_TIMESTAMP" if kind == "time" else "BAD_NUMBER", f"{found[c]['bad']} values of {c}, as {found[c]['example']!r}")
        if found[c]["outside"]:
            raise CheckFailed("OUTSIDE_WGS84", f"{found[c]['outside']} values of {c}")


COUNTERS = ("rows_read", "out_of_scope", "out_of_time", "wrong_species", "no_coordinates", "invalid_numbers", "nonfinite", "negative", "outside_wgs84", "rows_kept", "off_grain", "no_animal")


class Prepared(NamedTuple):
    """Rows of a feature table that a question may use, and counters that fill while these rows are first written or collected."""

    rows: DataFrame
    source: DataFrame
    observed: Observation

    def counts(self) -> dict[str, int]:
        """What was left out, by its first reason, and what was changed; waits for the first action on ``rows``."""
        if self.source.isEmpty():  # Spark takes plans of no rows out, with their counters
            return dict.fromkeys(COUNTERS, 0)
        return dict(self.observed.get)

    def check(self) -> None:
        """Fails if numbers couldn't be read, places lie outside the globe, an animal is null or has two rows at one time, or no row is left."""
        counts = self.counts()
        for code in ("invalid_numbers", "outside_wgs84", "off_grain", "no_animal"):
            if counts[code]:
                raise CheckFailed(code.upper(), f"{counts[code]} rows")
        if not counts["rows_kept"]:
            raise CheckFailed("NO_ROWS", "no row is left")


def prepare(df: DataFrame, start: object, end: object, numbers: Sequence[str] = (), species: Sequence[str] = (), scopes: Sequence[str] = (), entity: str = "entity_id", time: str = "day", longitude: str = "longitude", latitude: str = "latitude", displacement: str = "displacement_km", by_day: bool = True) -> Prepared:
    """A feature table cut to a question's scopes, time range (both ends inside) and species, in one pass.

    ``numbers``, and places and distances given as texts, become doubles; texts that are no numbers are counted and null. NaN and infinities are null, and counted;
    negative displacements stay, and are counted. A row without coordinates goes, if the table has coordinates. ``public``
    rows are always in scope; no species, no filter. ``off_grain`` counts rows beyond the first of an animal and day, or
    of an animal and time. Columns that the table lacks are not tested. No job runs before the caller's own.
    """
    has = lambda c: c in df.columns
    texts = [c for c, t in df.dtypes if t == "string" and c in (longitude, latitude, displacement)]
    numbers = list(dict.fromkeys([*numbers, *texts]))
    parsed = {c: F.col(c).try_cast("double") for c in numbers}
    bad = reduce(Column.__or__, (F.col(c).isNotNull() & parsed[c].isNull() for c in numbers), F.lit(False))
    rows = df.withColumn("_bad", bad).withColumns(parsed)
    floats = [c for c, t in rows.dtypes if t in ("double", "float")]
    odd = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    rows = rows.withColumn("_odd", reduce(lambda a, c: a + F.coalesce(odd(c), F.lit(False)).cast("int"), floats, F.lit(0)))
    rows = rows.withColumns({c: F.when(~odd(c), F.col(c)) for c in floats})
    reasons = {}
    if has("access_scope"):
        reasons["out_of_scope"] = ~F.coalesce(F.col("access_scope").isin("public", *scopes), F.lit(False))
    reasons["out_of_time"] = ~F.coalesce(F.col(time).between(start, end), F.lit(False))
    if species and has("species"):
        reasons["wrong_species"] = ~F.coalesce(F.col("species").isin(*species), F.lit(False))
    outside = F.lit(False)
    if has(longitude) and has(latitude):
        reasons["no_coordinates"] = F.col(longitude).isNull() | F.col(latitude).isNull()
        outside = F.coalesce(~F.col(longitude).between(-180, 180), F.lit(False)) | F.coalesce(~F.col(latitude).between(-90, 90), F.lit(False))
    reason = reduce(lambda rest, r: F.when(reasons[r], r).otherwise(rest), reversed(reasons), F.lit(None).cast("string"))
    negative = F.count_if(F.coalesce(F.col(displacement) < 0, F.lit(False))) if has(displacement) else F.lit(0)
    every = ("out_of_scope", "out_of_time", "wrong_species", "no_coordinates")
    at = F.to_date(time) if by_day else F.col(time)
    # Rows that go are counted beside those that stay, so that the counters stand above the only shuffle.
    same = Window.partitionBy(entity, "_at", "_reason").orderBy("_at")
    numbered = rows.withColumns({"_reason": reason, "_at": at}).withColumn("_nth", F.row_number().over(same))
    kept = F.col("_reason").isNull()
    seen = {"rows_read": F.count("*")} | {r: F.count_if(F.coalesce(F.col("_reason") == r, F.lit(False))) for r in every}
    seen |= {"invalid_numbers": F.count_if("_bad"), "nonfinite": F.coalesce(F.sum("_odd"), F.lit(0)), "negative": negative, "outside_wgs84": F.count_if(outside)}
    seen |= {"rows_kept": F.count_if(kept), "off_grain": F.count_if(kept & (F.col("_nth") > 1)), "no_animal": F.count_if(kept & F.col(entity).isNull())}
    observed = Observation()
    counted = numbered.observe(observed, *(seen[c].alias(c) for c in COUNTERS))
    return Prepared(counted.where("_reason is null").select(*df.columns), df, observed)
