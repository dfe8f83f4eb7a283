"""Joins with declared cardinality, tie-breaks, availability and tolerance; range joins by time buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.geo import point_in_polygon
from .checks import check_intervals, check_nonnull, check_unique
from .relational import CheckFailed


def _seconds(column: Column) -> Column:
    """Microseconds since 1970 of a time with or without a zone."""
    return F.unix_micros(column.cast("timestamp"))


def join_checked(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], right_columns: Sequence[str], how: str = "left", cardinality: str = "many_to_one", left_units: Mapping[str, str] | None = None, right_units: Mapping[str, str] | None = None) -> DataFrame:
    """Left or inner join on pairs of keys; duplicate right keys fail, and left ones too if one_to_one. Null keys never match.

    Keys of a pair must have one type, whole numbers of any width among them, and one unit where both sides name one.
    """
    if how not in ("left", "inner") or cardinality not in ("one_to_one", "many_to_one"):
        raise ValueError("left or inner; one_to_one or many_to_one")
    kind = lambda df, c: "whole" if isinstance(df.schema[c].dataType, IntegralType) else df.schema[c].dataType.simpleString()
    for a, b in keys:
        if kind(left, a) != kind(right, b):
            raise CheckFailed("KEY_TYPE", f"{a} is {kind(left, a)}, {b} is {kind(right, b)}")
        unit_a, unit_b = (left_units or {}).get(a), (right_units or {}).get(b)
        if unit_a and unit_b and unit_a != unit_b:
            raise CheckFailed("KEY_UNIT", f"{a} is in {unit_a}, {b} in {unit_b}")
    right_keys = [r for _, r in keys]
    known = right.dropna(subset=right_keys)
    check_unique(known, right_keys, code="JOIN_VALIDATION_FAILED")
    if cardinality == "one_to_one":
        check_unique(left.dropna(subset=[k for k, _ in keys]), [k for k, _ in keys], code="JOIN_VALIDATION_FAILED")
    side = known.select(*(F.col(r).alias(f"_key_{i}") for i, r in enumerate(right_keys)), *right_columns)
    condition = [F.col(k) == F.col(f"_key_{i}") for i, (k, _) in enumerate(keys)]
    return left.join(side, condition, how).drop(*(f"_key_{i}" for i in range(len(keys))))


def all_finite(*columns: str) -> Column:
    """Whether none is null, NaN or infinite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return ok


class CellSpread:
    """Coarse cells by which the boxes of a polygon layer meet those of other rows.

    A cell is a quarter of a mean polygon's box, but no less than 1/256 of the layer's extent, so a polygon has some
    dozen cells as a rule. Other rows are spread over cells inside the layer's extent only.
    """

    def __init__(self, polygons: DataFrame, rings: str):
        corner = lambda f, axis: f(F.transform(F.flatten(rings), lambda p: p[axis]))
        self.boxed = polygons.withColumns({"_w": corner(F.array_min, "x"), "_s": corner(F.array_min, "y"), "_e": corner(F.array_max, "x"), "_n": corner(F.array_max, "y")}).where(all_finite("_w", "_s", "_e", "_n"))
        size = self.boxed.agg(F.avg(F.greatest(F.col("_e") - F.col("_w"), F.col("_n") - F.col("_s"))).alias("mean"), F.min("_w").alias("w"), F.min("_s").alias("s"), F.max("_e").alias("e"), F.max("_n").alias("n")).first()
        self.extent = tuple(size)[1:] if size["mean"] is not None else (0.0, 0.0, 0.0, 0.0)
        self.cell = max((size["mean"] or 0.0) / 4, (self.extent[2] - self.extent[0]) / 256, (self.extent[3] - self.extent[1]) / 256) or 1.0

    def spread(self, df: DataFrame, box: Sequence[Column]) -> DataFrame:
        """Adds _cx and _cy: a row for each cell that the row's box (west, south, east, north) shares with the extent."""
        at = lambda c: F.floor(c / self.cell)
        w, s, e, n = self.extent
        ends = [at(F.greatest(box[0], F.lit(w))), at(F.greatest(box[1], F.lit(s))), at(F.least(box[2], F.lit(e))), at(F.least(box[3], F.lit(n)))]
        held = df.withColumns(dict(zip(("_c0", "_c1", "_c2", "_c3"), ends, strict=True))).where("_c0 <= _c2 and _c1 <= _c3")
        return held.withColumn("_cx", F.explode(F.sequence("_c0", "_c2"))).withColumn("_cy", F.explode(F.sequence("_c1", "_c3"))).drop("_c2", "_c3")

    def meet(self, df: DataFrame, box: Sequence[Column]) -> DataFrame:
        """Rows of ``df`` with the polygons whose box shares a point with theirs; each pair once, by equal cells.

        Boxes with a null, NaN or infinite side meet nothing.
        """
        own = ("_bw", "_bs", "_be", "_bn")
        boxed = df.withColumns(dict(zip(own, box, strict=True))).where(all_finite(*own))
        sides = self.spread(boxed, [F.col(c) for c in own]).withColumnsRenamed({"_c0": "_d0", "_c1": "_d1"})
        polygons = self.spread(self.boxed, [F.col(c) for c in ("_w", "_s", "_e", "_n")])
        pairs = sides.join(polygons, ["_cx", "_cy"]).where((F.col("_cx") == F.greatest("_c0", "_d0")) & (F.col("_cy") == F.greatest("_c1", "_d1")))
        near = (F.col("_bw") <= F.col("_e")) & (F.col("_w") <= F.col("_be")) & (F.col("_bs") <= F.col("_n")) & (F.col("_s") <= F.col("_bn"))
        return pairs.where(near).drop("_cx", "_cy", "_c0", "_c1", "_d0", "_d1", "_bw", "_bs", "_be", "_bn", "_w", "_s", "_e", "_n")


def polygon_hits(points: DataFrame, polygons: DataFrame, lon: str, lat: str, rings: str) -> DataFrame:
    """Rows of ``points`` with each polygon that holds them, its boundary included. The sides' columns must differ."""
    x, y = F.col(lon), F.col(lat)
    return CellSpread(polygons, rings).meet(points, (x, y, x, y)).where(point_in_polygon(x, y, F.col(rings)))


def spatial_join(points: DataFrame, polygons: DataFrame, lon: str, lat: str, rings: str, tie_break: str, right_columns: Sequence[str], how: str = "left") -> DataFrame:
    """Each point with the polygon that holds it, its boundary included; of several, that of the smallest tie-break.

    Adds ``matches``, how many hold it. Distinct places are looked up once, by the coarse cells of the polygons' boxes
    and then the exact test, and go back to the points by their coordinates.
    """
    check_nonnull(polygons, [tie_break])
    check_unique(polygons, [tie_break])
    places = points.select(F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y")).where(all_finite("_x", "_y")).distinct()
    layer = polygons.select(F.col(tie_break).alias("_tie"), F.col(rings).alias("_rings"), *(F.col(c).alias(f"_r_{c}") for c in right_columns))
    hits = polygon_hits(places, layer, "_x", "_y", "_rings")
    best = hits.groupBy("_x", "_y").agg(F.min_by(F.struct(*(F.col(f"_r_{c}").alias(c) for c in right_columns)), "_tie").alias("_hit"), F.count("*").alias("_matches"))
    known = F.coalesce(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.lit(False))
    joined = points.where(known).join(best, (F.col(lon) == F.col("_x")) & (F.col(lat) == F.col("_y")), how)
    out = joined.select(*points.columns, *(F.col(f"_hit.{c}").alias(c) for c in right_columns), F.coalesce("_matches", F.lit(0)).alias("matches"))
    if how != "left":
        return out
    nothing = points.where(~known)  # needn't meet in a task
    return out.union(nothing.select(*points.columns, *(F.lit(None).cast(out.schema[c].dataType) for c in right_columns), F.lit(0).alias("matches")))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, tie_break: str, tolerance_s: int, right_columns: Sequence[str], available_at: str | None = None, how: str = "left", slice_s: int = 86_400) -> DataFrame:
    """The latest right row at or before each left row, at most ``tolerance_s`` earlier, ties to the smallest tie-break.

    With ``available_at`` only right rows available at the left time count, and those of null availability never do.
    Time is cut into slices of ``slice_s``. The best right row of each key and slice is carried to the later slices by a
    running maximum over slices, and then each slice runs through one window of its own in the order in which right rows
    become eligible: the best so far is the answer, as no older row can be nearer. So a key of many rows is spread over
    as many tasks as it has slices, and no pairs are made.
    """
    check_nonnull(right, [tie_break])
    check_unique(right, [*keys, right_time, tie_break])
    side = right.where(F.col(right_time).isNotNull())
    eligible = _seconds(F.col(right_time))
    if available_at:
        side = side.where(F.col(available_at).isNotNull())
        eligible = F.greatest(eligible, _seconds(F.col(available_at)))
    ties = Window.partitionBy(*keys, right_time).orderBy(F.desc(tie_break))
    payload = F.struct(_seconds(F.col(right_time)).alias("at"), F.row_number().over(ties).alias("tie"), F.struct(*(F.col(c).alias(f"r_{i}") for i, c in enumerate(right_columns))).alias("row"))
    slice_of = F.floor(F.col("_t") / (slice_s * 1_000_000)).alias("_slice")
    rights = side.dropna(subset=list(keys)).select(*keys, eligible.alias("_t"), F.lit(0).alias("_side"), payload.alias("_best")).select("*", slice_of)
    known = F.col(left_time).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = left.withColumn("_row", F.struct(*left.columns))
    lefts = rows.where(known).select(*keys, _seconds(F.col(left_time)).alias("_t"), F.lit(1).alias("_side"), "_row").select("*", slice_of)
    # Of each slice the best right row, and before each slice the best of those before it.
    lasts = rights.groupBy(*keys, "_slice").agg(F.max("_best").alias("_last")).unionByName(lefts.select(*keys, "_slice").distinct(), allowMissingColumns=True)
    lasts = lasts.groupBy(*keys, "_slice").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_slice", F.lit(-1).alias("_side"), F.max("_last").over(before).alias("_best")).where("_best is not null")
    both = lefts.unionByName(rights, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    # Carried rows come first, then rows in order of time, right ones first: a row frame sees every right row that is eligible.
    running = Window.partitionBy(*keys, "_slice").orderBy(F.asc_nulls_first("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.max("_best").over(running)).where("_side = 1")
    match = F.when(F.col("_found.at") >= F.col("_t") - tolerance_s * 1_000_000, F.col("_found.row"))
    out = found.select("_row", match.alias("_match"))
    if how == "inner":
        out = out.where(F.col("_match").isNotNull())
    else:  # rows with a null key or time match nothing and needn't meet in a task
        out = out.union(rows.where(~known).select("_row", F.lit(None).cast(out.schema["_match"].dataType)))
    return out.select("_row.*", *(F.col(f"_match.r_{i}").alias(c) for i, c in enumerate(right_columns)))


def _bucketed(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_bucket_time: str, window_s: int) -> DataFrame:
    """Left rows with right rows whose time falls into the window's bucket or the one before."""
    size = window_s * 1_000_000
    bucket = lambda c: F.floor(_seconds(F.col(c)) / size)
    lefts = left.withColumn("_bucket", F.explode(F.array(bucket(left_time), bucket(left_time) - 1)))
    return lefts.join(right.withColumn("_bucket", bucket(right_bucket_time)), [*keys, "_bucket"])


def window_sum(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, start: str, end: str, value: str, output: str, window_s: int, minimum_coverage: float = 0.0, available_at: str | None = None) -> DataFrame:
    """Adds to each left row the sum of the right values whose whole interval lies in the ``window_s`` before it.

    ``<output>_coverage`` is the share of the window under intervals with a value (0 without any); the sum is null below
    ``minimum_coverage``. Right intervals must be valid and not overlap for a key. Exact sums: nothing is subtracted.
    Sums are made once for each key and time of the left side, and go back to its rows by these.
    """
    check_intervals(right, keys, start, end)
    own = [*keys, left_time]
    side = right.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("_v"), *([F.col(available_at).alias("_a")] if available_at else []))
    t = _seconds(F.col(left_time))
    pairs = _bucketed(left.select(*own).dropna().distinct(), side, keys, left_time, "_e", window_s).where((_seconds(F.col("_s")) >= t - window_s * 1_000_000) & (_seconds(F.col("_e")) <= t))
    if available_at:
        pairs = pairs.where(F.col("_a") <= F.col(left_time))
    covered = F.sum(F.when(F.col("_v").isNotNull(), (_seconds(F.col("_e")) - _seconds(F.col("_s"))) / 1e6)) / window_s
    sums = pairs.groupBy(*own).agg(F.sum("_v").alias("_sum"), F.coalesce(covered, F.lit(0.0)).alias("_cover"))
    coverage = F.coalesce("_cover", F.lit(0.0))
    return left.join(sums, own, "left").select(*left.columns, F.when(coverage >= minimum_coverage, F.col("_sum")).alias(output), coverage.alias(f"{output}_coverage"))


def preceding_days_sum(left: DataFrame, right: DataFrame, keys: Sequence[str], day: str, start: str, end: str, value: str, days: int) -> DataFrame:
    """Adds ``total`` and ``days_observed`` of the values whose interval lies in the ``days`` before a day."""
    own = [*keys, day]
    side = right.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("_v"))
    t = _seconds(F.col(day))
    pairs = _bucketed(left.select(*own).dropna().distinct(), side, keys, day, "_e", days * 86_400).where((_seconds(F.col("_s")) >= t - days * 86_400_000_000) & (_seconds(F.col("_e")) <= t))
    sums = pairs.groupBy(*own).agg(F.sum("_v").alias("total"), F.count("_v").alias("days_observed"))
    return left.join(sums, own, "left").select(*left.columns, "total", F.coalesce("days_observed", F.lit(0)).alias("days_observed"))


#: Left and right rows of a block of pairs: lists of 63 groups of 8 repeat byte by byte in a Parquet page, which has 20,000 rows.
BLOCK = (504, 64)


def validity_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, valid_from: str, valid_until: str, right_columns: Sequence[str], longest_s: int, parts: int = 4, left_columns: Sequence[str] | None = None) -> DataFrame:
    """All pairs with valid_from <= time < valid_until. ``longest_s`` bounds the length of a validity; longer ones fail.

    Time is cut into buckets of a ``parts``-th of ``longest_s``. A validity goes to each bucket that it touches, parts + 1
    at most, and a left row to its own, so a pair meets once, left rows aren't repeated, and few pairs fail the exact
    test. A hot key is spread over its buckets. Rows without a key or time match nothing, nor do validities without both ends.

    The pairs are the work, and small tables can make many: so both sides are dealt by key and bucket over a stated number
    of tasks, which Spark doesn't join into few by their bytes, and neither is broadcast to the few tasks that read the other.
    There rows next in time are gathered into blocks, blocks meet, and their pairs are made one block after the other: each
    right row with the same list of left rows, so that files keep a pair in a fraction of a byte. ``left_columns`` are those
    to return, all if not given; the rest isn't shuffled. A validity is shuffled with its length, which is often the same and
    then takes little room.
    """
    size = longest_s * 1_000_000 / parts
    bucket = lambda at: F.floor(at / size)
    start, lasts = F.col("_s"), F.col("_lasts")
    names = left.columns if left_columns is None else list(left_columns)
    own, others = [f"_l_{i}" for i in range(len(names))], [f"_r_{i}" for i in range(len(right_columns))]
    lefts = left.dropna(subset=[*keys, time]).select(*keys, _seconds(F.col(time)).alias("_t"), *(F.col(c).alias(x) for c, x in zip(names, own, strict=True))).withColumn("_bucket", bucket(F.col("_t")))
    side = right.dropna(subset=list(keys)).select(*keys, _seconds(F.col(valid_from)).alias("_s"), (_seconds(F.col(valid_until)) - _seconds(F.col(valid_from))).alias("_lasts"), *(F.col(c).alias(x) for c, x in zip(right_columns, others, strict=True)))
    touched = F.when(lasts > longest_s * 1_000_000, F.raise_error(F.lit("a validity is longer than longest_s")).cast("array<bigint>")).when(lasts > 0, F.sequence(bucket(start), bucket(start + lasts - 1)))
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)

    def blocks(df: DataFrame, by: str, rows: int, *made: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(by))
        return df.repartition(tasks, *keys, "_bucket").withColumn("_block", F.floor((place - 1) / rows)).groupBy(*keys, "_bucket", "_block").agg(*made).drop("_block")

    many = blocks(lefts, "_t", BLOCK[0], F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.collect_list(F.struct("_t", *own)).alias("_lefts"))
    few = blocks(side.withColumn("_bucket", F.explode(touched)), "_s", BLOCK[1], F.collect_list(F.struct("_s", (start + lasts).alias("_e"), *others)).alias("_rights"))
    meets = lambda x: (x["_s"] <= F.col("_last")) & (F.col("_first") < x["_e"])
    met = many.join(few.hint("merge"), [*keys, "_bucket"]).where(F.exists("_rights", meets))
    pairs = met.select("_lefts", F.inline(F.filter("_rights", meets))).select("_s", "_e", *others, F.inline("_lefts")).where((start <= F.col("_t")) & (F.col("_t") < F.col("_e")))
    return pairs.select(*(F.col(x).alias(c) for x, c in zip([*own, *others], [*names, *right_columns], strict=True)))


#: Versions are below 2 ** LEVELS.
LEVELS = 20


def _nodes(added: Column, gone: Column) -> Column:
    """(level, node): the aligned blocks of 2 ** level versions that make up [added, gone), some two a level at most."""
    def at(level: Column) -> Column:
        size = F.pow(F.lit(2), level)
        low, high = F.ceil(added / size).cast("long"), F.floor(gone / size).cast("long")
        left = F.when((low < high) & (low % 2 == 1), F.struct(level.alias("level"), low.alias("node")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("node")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))


def live_in_versions(datasets: DataFrame, batches: DataFrame, series: str = "series_id") -> DataFrame:
    """Each dataset version with the batches of its series that are live in it: added <= version, not superseded by then.

    A batch's versions [added, superseded) are cut into aligned blocks, and a version lies in one block of each level, so
    both meet by equal (series, level, node), once: versions and batches that don't fit make no rows. Only the distinct
    spans of a series are cut, however many batches have them; batches join them by equality. Columns of ``batches`` must
    differ from those of ``datasets``, but for the series. Versions are whole numbers from 0 below 2 ** 20.
    """
    held = with_span(batches)
    own = [series, "_added", "_open"]
    return live_spans(datasets, held.select(*own).distinct(), series).join(held, own).drop("_added", "_open")


def with_span(batches: DataFrame) -> DataFrame:
    """Adds _added and _open, the versions of a batch: from _added to below _open, neither null."""
    return batches.withColumns({"_added": F.greatest("added_in_version", F.lit(0)), "_open": F.coalesce("superseded_in_version", F.lit(1 << LEVELS))})


def live_spans(datasets: DataFrame, spans: DataFrame, series: str = "series_id") -> DataFrame:
    """Each dataset version with the spans (series, _added, _open) of its series that it lies in; see ``live_in_versions``."""
    top = F.lit(1 << LEVELS)
    version = F.when(F.col("version").between(0, top - 1), F.col("version")).otherwise(F.when(F.col("version").isNotNull(), F.raise_error(F.lit("a version is out of range")).cast("long")))
    blocks = F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.floor(version / F.pow(F.lit(2), k)).cast("long").alias("node")))).alias("_block")
    cut = F.explode(_nodes(F.col("_added"), F.col("_open"))).alias("_block")
    asked, held = datasets.where("version is not null").select("*", blocks), spans.select("*", cut)
    unfold = lambda df: df.select("*", F.col("_block.level").alias("_level"), F.col("_block.node").alias("_node")).drop("_block")
    return unfold(asked).join(unfold(held), [series, "_level", "_node"]).drop("_level", "_node")


def expand_versions(datasets: DataFrame, batches: DataFrame, rows: DataFrame, series: str = "series_id", batch: str = "batch_key") -> DataFrame:
    """Rows of the batches that are live in each dataset's version (see ``live_in_versions``)."""
    return live_in_versions(datasets, batches, series).join(rows, [series, batch])


def with_dimension(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Inner join with a dimension table; Spark broadcasts it if it is small enough."""
    return df.join(dimension, key)


def restrict_to_cells(environment: DataFrame, *tracks: DataFrame, cell: str = "cell") -> DataFrame:
    """Environment rows of cells that a track uses."""
    used = tracks[0].select(cell)
    for t in tracks[1:]:
        used = used.union(t.select(cell))
    return environment.join(used.distinct(), cell, "left_semi")


def unmatched_count(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti").agg(F.count("*").alias("unmatched"))


def hide_split_series(datasets: DataFrame, series: DataFrame, marker: str = "--study-") -> DataFrame:
    """Datasets whose series wasn't split: no series id starts with theirs and the marker."""
    parents = series.select(F.regexp_extract("series_id", f"^(.*?){marker}", 1).alias("series_id")).where("series_id <> ''").distinct()
    return datasets.join(parents, "series_id", "left_anti")
