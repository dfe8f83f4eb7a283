"""Hand-computed cases: nulls, ties, exact bounds, failures."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meadowlark.functions import geo, indices, text
from meadowlark.operators import catalog, checks, forecast, joins, movement, relational, report, series, stats
from meadowlark.operators.relational import CheckFailed
from meadowlark.sources import tracking
from meadowlark.streaming import append, corrections

DAY = dt.date(2026, 1, 1)


def day(n):
    return DAY + dt.timedelta(n - 1)


@pytest.fixture(scope="module")
def tracks(spark):
    """Two animals; A lacks the third day."""
    rows = [("A", day(1), 10.0, 0.0, None, "w1", 1.0), ("A", day(2), 10.1, 0.0, 10.0, "w1", 8.0), ("A", day(4), 10.2, 0.0, 10.0, "w1", 0.0), ("B", day(1), 20.0, 1.0, None, "w2", 1.0),
            ("B", day(2), 20.0, 1.1, 4.0, "w2", 9.0), ("B", day(3), 20.0, 1.2, 4.0, "w1", 1.0), ("B", day(4), 20.0, 1.3, 4.0, "w2", 0.0)]
    return spark.createDataFrame(rows, "entity_id string, day date, longitude double, latitude double, displacement_km double, cell string, rainfall double")


def test_movement_summary(tracks):
    r = movement.movement_summary(tracks).first()
    assert (r.animals, r.rows, r.displacements, r.missing, r.total_km, r.median_km, r.gap_days) == (2, 7, 5, 2, 32.0, 4.0, 1)
    assert {x.day: x.median for x in movement.timeline(tracks).collect()}[day(2)] == 7.0
    assert [(x.entity_id, x.day) for x in movement.missing_days(tracks).collect()] == [("A", day(3))]


def test_habitat_and_windows(tracks):
    r = stats.habitat_split(tracks, "rainfall").first()
    assert (r.n_above, r.median_above, r.n_below, r.median_below) == (2, 7.0, 3, 4.0)
    w = {x.window: (x.displacements, x.median_km) for x in movement.compare_windows(tracks, [("early", "2026-01-01", "2026-01-02"), ("late", "2026-01-03", "2026-01-04")]).collect()}
    assert w == {"early": (2, 7.0), "late": (3, 4.0)}
    with pytest.raises(ValueError):
        movement.compare_windows(tracks, [("one", "2026-01-01", "2026-01-02")])


def test_revisits(tracks):
    r = {x.cell: (x.observations, x.animals, x.repeat_animals) for x in movement.revisits(tracks).collect()}
    assert r == {"w1": (4, 2, 1), "w2": (3, 1, 1)}


def test_route_overlap(spark, tracks):
    boundary = spark.range(1).select(F.lit("box").alias("name"), geo.box_ring(*map(F.lit, (9.5, -0.5, 10.5, 0.5))).alias("rings"))
    r = {x.entity_id: (x.points_inside, x.share) for x in movement.route_overlap(tracks.withColumn("observed_at", F.col("day").cast("timestamp")), boundary).collect()}
    assert r["A"][0] == 3 and math.isclose(r["A"][1], 1.0) and r["B"] == (0, 0.0)


def _fixes(spark, hours, values):
    rows = [("A", dt.datetime(2026, 1, 1) + dt.timedelta(hours=h), 10.0, 0.0, v) for h, v in zip(hours, values, strict=True)]
    return spark.createDataFrame(rows, "entity_id string, observed_at timestamp, longitude double, latitude double, vegetation_index double")


def test_residence(spark):
    r = movement.residence_time(_fixes(spark, (0, 1, 2, 6), (0.2, 0.2, 0.8, 0.8))).first()
    assert (r.hours, r.hours_above, r.share_above, r.intervals) == (6.0, 4.5, 0.75, 3) and math.isclose(r.weighted_mean, 0.65)
    r = movement.residence_time(_fixes(spark, (0, 1, 2, 6, 19), (0.2, 0.2, 0.8, 0.8, 0.8))).first()
    assert (r.hours, r.gap_hours) == (6.0, 13.0)


def test_asof_join_bounds_ties_and_availability(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    left = spark.createDataFrame([("k", t(10)), ("k", t(20)), (None, t(10)), ("z", t(10))], "k string, at timestamp")
    right = spark.createDataFrame([("k", t(5), "b", 1, t(5)), ("k", t(5), "a", 2, t(5)), ("k", t(9), "c", 3, t(15)), ("k", t(10), "d", 4, None), (None, t(9), "e", 5, t(9))], "k string, rt timestamp, tie string, v int, seen timestamp")
    plain = {(r.k, r["at"].hour): r.v for r in joins.asof_join(left, right, ["k"], "at", "rt", "tie", 5 * 3600, ["v"]).collect()}
    assert plain == {("k", 10): 4, ("k", 20): None, (None, 10): None, ("z", 10): None}
    seen = {(r.k, r["at"].hour): r.v for r in joins.asof_join(left, right, ["k"], "at", "rt", "tie", 11 * 3600, ["v"], "seen").collect()}
    assert seen == {("k", 10): 2, ("k", 20): 3, (None, 10): None, ("z", 10): None}
    with pytest.raises(CheckFailed):
        joins.asof_join(left, right.union(right), ["k"], "at", "rt", "tie", 60, ["v"])


def test_window_sum_coverage(spark):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(d)
    rain = spark.createDataFrame([("c", t(i), t(i + 1), 4.5 if i != 3 else None) for i in range(7)], "k string, s timestamp, e timestamp, v double")
    left = spark.createDataFrame([("c", t(7)), ("x", t(7))], "k string, at timestamp")
    r = {x.k: (x.rain, round(x.rain_coverage, 6)) for x in joins.window_sum(left, rain, ["k"], "at", "s", "e", "v", "rain", 7 * 86_400).collect()}
    assert r == {"c": (27.0, round(6 / 7, 6)), "x": (None, 0.0)}
    strict = joins.window_sum(left, rain, ["k"], "at", "s", "e", "v", "rain", 7 * 86_400, 0.9).where("k = 'c'").first()
    assert strict.rain is None
    with pytest.raises(CheckFailed):
        joins.window_sum(left, rain.union(rain), ["k"], "at", "s", "e", "v", "rain", 86_400)


def test_join_checked(spark):
    left, right = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string"), spark.createDataFrame([(1, 5), (None, 6)], "k int, v int")
    assert {(r.x, r.v) for r in joins.join_checked(left, right, [("k", "k")], ["v"]).collect()} == {("a", 5), ("b", None)}
    with pytest.raises(CheckFailed, match="JOIN_VALIDATION_FAILED"):
        joins.join_checked(left, right.union(right), [("k", "k")], ["v"])


def test_spatial_join_tie_and_boundary(spark):
    boxes = spark.createDataFrame([("b", 0.0), ("a", 1.0)], "name string, west double").select("name", geo.box_ring(F.col("west"), F.lit(0.0), F.col("west") + 1, F.lit(1.0)).alias("rings")).withColumn("tie", F.col("name"))
    points = spark.createDataFrame([(1, 1.0, 0.5), (2, 0.5, 0.5), (3, 5.0, 5.0), (4, None, 1.0)], "i int, x double, y double")
    r = {p.i: (p.name, p.matches) for p in joins.spatial_join(points, boxes, "x", "y", "rings", "tie", ["name"]).collect()}
    assert r == {1: ("a", 2), 2: ("b", 1), 3: (None, 0), 4: (None, 0)}


def test_filter_rows_nulls_and_lists(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert [r.v for r in relational.filter_rows(df, [("v", "ne", 1)]).collect()] == [2]
    assert relational.filter_rows(df, [("v", "is_null")]).count() == 1
    with pytest.raises(ValueError):
        relational.filter_rows(df, [("v", "in", [])])
    with pytest.raises(ValueError):
        relational.filter_rows(df.withColumn("t", F.current_timestamp()), [("t", "ge", "2024-01-01T00:00:00")])
    with pytest.raises(ValueError):
        relational.select_columns(df, {"a": "v", "A": "v"})


def test_aggregate_nulls(spark):
    df = spark.createDataFrame([(None, None), (None, 2.0), ("k", None)], "g string, v double")
    r = {x.g: (x.s, x.n) for x in relational.aggregate(df, ["g"], [("v", "sum", "s"), ("v", "count", "n")]).collect()}
    assert r == {None: (2.0, 1), "k": (None, 0)}


def test_grid_and_distance(spark):
    r = spark.range(1).select(geo.cell_id(F.lit(36.925), F.lit(-1.45)).alias("c"), geo.geodesic_km(*map(F.lit, (0.0, 0.0, 1.0, 0.0))).alias("km")).first()
    assert r.c == "E1K-r7492-c20911" and math.isclose(r.km, 111.31949079, rel_tol=1e-6)
    with pytest.raises(Exception, match="bad cell id"):
        spark.range(1).select(geo.parse_cell_id(F.lit("x"))[0]).collect()


def test_polygon_with_hole(spark):
    ring = lambda a, b: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))))
    rings = F.array(ring(0, 10), ring(4, 6))
    r = spark.range(1).select(*(geo.point_in_polygon(F.lit(x), F.lit(5.0), rings).alias(n) for n, x in (("inside", 1.0), ("hole", 5.0), ("edge", 10.0), ("out", 11.0))), geo.inside_fraction(*map(F.lit, (0.0, 5.0, 20.0, 5.0)), rings).alias("share")).first()
    assert (r.inside, r.hole, r.edge, r.out) == (True, False, True, False) and math.isclose(r.share, 0.4)


def test_indices(spark):
    r = spark.range(1).select(indices.normalized_difference(indices.s2_reflectance(F.lit(6000), F.lit(-1000)), indices.s2_reflectance(F.lit(2000), F.lit(-1000))).alias("ndvi"), indices.normalized_difference(F.lit(1.0), F.lit(-1.0)).alias("none"), indices.modis_vi(F.lit(-3000), F.lit(0)).alias("fill"), indices.chirps_rain(F.lit(-9999)).alias("rain")).first()
    assert math.isclose(r.ndvi, 0.4 / 0.6) and r.none is None and r.fill is None and r.rain is None


def test_versions(spark):
    registry = spark.createDataFrame([("s", "a", 1, None), ("s", "b", 1, None)], "series_id string, batch_key string, added_in_version int, superseded_in_version int")
    new = spark.createDataFrame([("s", "b", None), ("s", "c", ["a"])], "series_id string, batch_key string, supersedes array<string>")
    out = series.append_batch(registry, new)
    assert {(r.batch_key, r.added_in_version, r.superseded_in_version) for r in out.collect()} == {("a", 1, 2), ("b", 1, None), ("c", 2, None)}
    assert {r.batch_key for r in series.live_batches(out, 1).collect()} == {"a", "b"}
    assert {r.batch_key for r in series.append_batch(out, new).collect()} == {"a", "b", "c"}


def test_preliminary_then_final(spark):
    rows = spark.createDataFrame([("c", "rain", "x", dt.datetime(2024, 3, 1), "preliminary", "1", "1", 1.0, dt.datetime(2024, 3, 2), "i", 2.0), ("c", "rain", "x", dt.datetime(2024, 3, 1), "final", "1", "1", 1.0, dt.datetime(2024, 4, 1), "i", 5.0)],
                                 "cell string, variable string, source_id string, time_start timestamp, product_status string, processing_version string, mapping_version string, valid_fraction double, available_at timestamp, source_item_id string, value double").withColumns({"added_in_version": F.lit(1), "superseded_in_version": F.lit(None).cast("int")})
    assert series.current_at(rows).first().value == 5.0
    assert series.current_at(rows, cutoff=dt.datetime(2024, 3, 10)).first().value == 2.0


def test_forecast(spark):
    rows = [("A", day(i), float(i % 3), float(i)) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "entity_id string, day date, displacement_km double, rainfall double")
    examples = forecast.with_baseline(forecast.next_day_examples(df, "2026-02-10", ["displacement_km", "rainfall"]))
    model = forecast.ridge(examples.where("not held_out"), ["displacement_km", "rainfall"])
    assert forecast.mean_errors(examples.where("held_out"), model).first().n > 10
    ahead = forecast.forward(df, forecast.residual_band(examples.where("held_out")), 3, model).collect()
    assert len(ahead) == 3 and all(r.low <= r.high and r.predicted >= 0 for r in ahead)
    assert forecast.recursive_model_mae(examples, "2026-02-10", model).first().recursive_mae >= 0
    assert forecast.ridge(examples.limit(3), ["displacement_km"]) is None
    with pytest.raises(ValueError):
        forecast.forward(df, forecast.residual_band(examples), 31)


def test_statistics_of_few_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "v double")
    r = stats.statistics(df, ["v"]).first()
    assert (r.n, r.missing, r.sd, r.median) == (1, 2, None, 1.0)
    assert stats.correlation(df.withColumn("w", F.col("v")), "v", "w").count() == 0


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int")
    with pytest.raises(CheckFailed):
        checks.check_unique(df, ["k"])
    with pytest.raises(CheckFailed):
        relational.guard_rows(df, 1)
    good, bad = checks.quarantine(df, [("one", F.col("v") == 1)])
    assert (good.count(), bad.count()) == (0, 2)
    with pytest.raises(CheckFailed):
        checks.check_output(df.limit(0), ["k"])


def test_tracking_readers(spark, tmp_path):
    raw = spark.createDataFrame([("1", "2024-01-01 00:00:00", "36.9", "-1.4", "x", None, "note"), ("2", "bad", "36.9", "-1.4", "x", "gps", "n")], "`event-id` string, timestamp string, `location-long` string, `location-lat` string, `individual-local-identifier` string, `sensor-type` string, extra string")
    r = tracking.read_tracking(raw, "m", "9").collect()
    assert [(x.entity_id, x.sensor_type, x.attributes) for x in r] == [("m:9:x", "unknown", '{"extra":"note"}')]
    with pytest.raises(CheckFailed):
        tracking.read_tracking(raw.drop("timestamp"), "m", "9")
    (tmp_path / "p.csv").write_text("name,Lat,LNG\na,1.5,2.5\n")
    assert tracking.read_points_csv(spark, str(tmp_path / "p.csv")).first().lon == 2.5
    (tmp_path / "b.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"n"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[0,0]}}]}')
    b = tracking.read_boundaries(tracking.read_geojson(spark, str(tmp_path / "b.json"))).collect()
    assert [x.name for x in b] == ["n"] and len(b[0].rings[0]) == 4


def test_feature_table_round_trip(spark, tracks, tmp_path):
    path = str(tmp_path / "features")
    tracking.write_features(tracks, path, {"entity_id": {"type": "string", "role": "entity_id"}, "day": {"type": "date"}, "displacement_km": {"type": "double", "unit": "km"}}, ["entity_id", "day"])
    back = tracking.read_features(spark, path, ["day", "displacement_km"], {"entity_id": "A"})
    assert back.count() == 3 and back.schema["displacement_km"].metadata["unit"] == "km"
    with pytest.raises(CheckFailed):
        tracking.read_features(spark, path, ["day"], {"nope": 1})
    with pytest.raises(CheckFailed):
        tracking.write_features(tracks.limit(0), path + "2", {"entity_id": {"type": "string"}}, ["entity_id"])


def test_catalog_unknown_coverage(spark):
    rows = [("a", 0.0, 0.0, 2.0, 2.0, ["x"]), ("b", None, None, None, None, ["x"]), ("c", 50.0, 50.0, 60.0, 60.0, ["x"]), ("d", 0.0, 0.0, 2.0, 2.0, ["y"])]
    df = spark.createDataFrame(rows, "dataset_id string, west double, south double, east double, north double, columns array<string>").withColumns({"start": F.lit("2024-01-01").cast("date"), "end": F.lit("2024-02-01").cast("date")})
    span = [F.lit(x).cast("date") for x in ("2024-01-05", "2024-01-10")]
    r = {x.dataset_id: x.status for x in catalog.eligibility(df, ["x"], (1.0, 1.0, 3.0, 3.0), *span).collect()}
    assert r == {"a": "eligible", "b": "unresolved", "c": "ineligible", "d": "ineligible"}


def test_stream_append_is_idempotent(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    df = spark.createDataFrame([("s", "b1", 1), ("s", "b2", 2)], "series_id string, batch_key string, v int")
    df.write.parquet(str(source))
    for run in ("c1", "c2"):  # a second checkpoint reads everything once more
        stream = spark.readStream.schema(df.schema).parquet(str(source))
        append.append_stream(stream, path, str(tmp_path / run)).awaitTermination()
    assert spark.read.parquet(path).count() == 2


def test_stream_append_leaves_nothing_of_a_failed_batch(spark, tmp_path, monkeypatch):
    """The write of a micro-batch fails after some files; the retry stores all of its rows."""
    path, source = str(tmp_path / "table"), tmp_path / "source"
    df = spark.createDataFrame([(f"s{i % 3}", f"b{i}", i) for i in range(30)], "series_id string, batch_key string, v int")
    df.write.parquet(str(source))
    broken = tmp_path / "table-staged"
    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet

    def halfway(self, to, *args, **kwargs):
        write(self, to, *args, **kwargs)
        if "-staged" in to and not (tmp_path / "failed").exists():
            (tmp_path / "failed").touch()
            raise OSError("lost")

    monkeypatch.setattr(DataFrameWriter, "parquet", halfway)
    stream = lambda: append.append_stream(spark.readStream.schema(df.schema).parquet(str(source)), path, str(tmp_path / "c"))
    with pytest.raises(Exception, match="lost"):
        stream().awaitTermination()
    assert broken.exists() and not list(tmp_path.glob("table/micro_batch=*"))
    stream().awaitTermination()
    assert spark.read.parquet(path).count() == 30


def test_daily_counts(spark):
    fixes = spark.sql("select * from values ('a', timestamp'2024-01-01 01:00'), ('a', timestamp'2024-01-01 23:00'), ('a', timestamp'2024-01-02 00:00'), ('b', timestamp'2024-01-02 05:00') as t(entity_id, observed_at)")
    assert sorted(r["count"] for r in append.daily_counts(fixes).collect()) == [1, 1, 2]


def test_spatial_join_of_repeated_rows_and_odd_layers(spark):
    square = lambda x, y, d: [[(x, y), (x + d, y), (x + d, y + d), (x, y + d), (x, y)]]
    kind = "tie int, name string, rings array<array<struct<x:double,y:double>>>"
    layer = spark.createDataFrame([(1, "small", square(0.0, 0.0, 0.001)), (2, "wide", square(-170.0, -80.0, 160.0)), (3, "far", square(100.0, 50.0, 1.0))], kind)
    points = spark.createDataFrame([(1, 0.0005, 0.0005), (1, 0.0005, 0.0005), (2, -20.0, 3.0), (3, 100.5, 51.0), (4, None, 1.0), (5, 179.0, 89.0)], "i int, x double, y double")
    r = sorted((p.i, p.name or "", p.matches) for p in joins.spatial_join(points, layer, "x", "y", "rings", "tie", ["name"]).collect())
    assert r == [(1, "small", 1), (1, "small", 1), (2, "wide", 1), (3, "far", 1), (4, "", 0), (5, "", 0)]
    assert joins.spatial_join(points, layer.limit(0), "x", "y", "rings", "tie", ["name"]).where("matches = 0").count() == 6


def test_route_overlap_clips_what_meets(spark):
    square = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]
    layer = spark.createDataFrame([("in", square), ("out", [[(x + 40, y) for x, y in square[0]]])], "name string, rings array<array<struct<x:double,y:double>>>")
    df = spark.sql("select * from values ('a', timestamp'2024-01-01 01:00', -1.0D, 0.5D), ('a', timestamp'2024-01-01 02:00', 3.0D, 0.5D), ('b', timestamp'2024-01-01 02:00', 5.0D, 5.0D) as t(entity_id, observed_at, longitude, latitude)")
    r = {(x.name, x.entity_id): x for x in movement.route_overlap(df, layer).collect()}
    assert len(r) == 4 and abs(r["in", "a"].share - 0.25) < 1e-9 and r["out", "a"].share == r["in", "b"].share == 0 and r["in", "a"].points_inside == 0
    assert abs(r["out", "a"].path_km - r["in", "a"].inside_km * 4) < 1e-6


def test_joins_keep_repeated_and_null_rows(spark):
    left = spark.sql("select * from values ('a', timestamp'2024-01-03'), ('a', timestamp'2024-01-03'), (null, timestamp'2024-01-03'), ('a', null) as t(k, at)")
    rain = spark.sql("select * from values ('a', timestamp'2024-01-01', timestamp'2024-01-02', 2.0D) as t(k, s, e, v)")
    assert sorted(str(r.rain) for r in joins.window_sum(left, rain, ["k"], "at", "s", "e", "v", "rain", 7 * 86_400).collect()) == ["2.0", "2.0", "None", "None"]
    assert sorted(str(r.total) for r in joins.preceding_days_sum(left, rain, ["k"], "at", "s", "e", "v", 7).collect()) == ["2.0", "2.0", "None", "None"]
    assert joins.validity_join(left.withColumn("at", F.expr("at - interval 36 hours")), rain, ["k"], "at", "s", "e", ["v"], 86_400).count() == 2
    right = rain.select("k", F.col("s").alias("rt"), F.lit(1).alias("tie"), "v").union(spark.sql("select null, timestamp'2024-01-01', 1, 9.0D"))
    assert sorted(str(r.v) for r in joins.asof_join(left, right, ["k"], "at", "rt", "tie", 5 * 86_400, ["v"]).collect()) == ["2.0", "2.0", "None", "None"]
    with pytest.raises(CheckFailed, match="KEY_TYPE"):
        joins.join_checked(left, rain.withColumn("k", F.lit(1)), [("k", "k")], ["v"])
    with pytest.raises(CheckFailed, match="KEY_UNIT"):
        joins.join_checked(left, rain, [("k", "k")], ["v"], left_units={"k": "m"}, right_units={"k": "km"})


def test_upsert_merges_json_objects(spark):
    old = spark.createDataFrame([("a", '{"x": 1, "y": "old"}'), ("b", '{"k": true}'), ("c", None)], "entity_id string, notes string")
    new = spark.createDataFrame([("a", '{"y": "new", "z": {"n": [1, 2]}}'), ("b", None), ("c", '{"m": 2.5}'), ("d", '{"q": "7"}')], "entity_id string, notes string")
    found = {r.entity_id: json.loads(r.notes) for r in series.upsert_entities(old, new, objects=["notes"]).collect()}
    assert found == {"a": {"x": 1, "y": "new", "z": {"n": [1, 2]}}, "b": {"k": True}, "c": {"m": 2.5}, "d": {"q": "7"}}


@pytest.mark.parametrize("accuracy", [50, 100_000])
@pytest.mark.parametrize("kind", ["distinct", "ties", "constant", "two", "one", "none"])
def test_quantiles_are_those_of_sorted_values(spark, kind, accuracy):
    draw = np.random.default_rng(7)
    values = {"distinct": draw.normal(size=4001), "ties": draw.integers(0, 9, 3000) / 4, "constant": np.full(500, 2.5), "two": np.array([1.0, 4.0]), "one": np.array([3.0]), "none": np.array([])}[kind]
    rows = [(float(v),) for v in values] + [(None,)] * 3
    df = spark.createDataFrame(rows, "v double").repartition(5)
    shares = {f"q{i}": q for i, q in enumerate((0.0, 0.1, 0.25, 0.5, 0.9, 1.0))}
    got = relational.quantiles(df, {n: (F.col("v"), q) for n, q in shares.items()}, accuracy).collect()
    assert len(got) == 1
    for n, q in shares.items():
        assert got[0][n] == (pytest.approx(float(np.quantile(values, q)), rel=1e-12, abs=1e-12) if len(values) else None)


# --- distances, hot keys, prefix sums, grouped quantiles


def inverse_by_hand(lon1, lat1, lon2, lat2):
    """Distance on the ellipsoid by integrating along the sphere's auxiliary great circle, until nothing moves."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    dlon = math.radians((lon2 - lon1 + 180) % 360 - 180)
    lam = dlon
    for _ in range(200):
        ss = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if ss == 0:
            return 0.0
        cs = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma, sa = math.atan2(ss, cs), math.cos(u1) * math.cos(u2) * math.sin(lam) / ss
        ca2 = 1 - sa * sa
        cm = cs - 2 * math.sin(u1) * math.sin(u2) / ca2 if ca2 > 1e-15 else 0.0
        c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
        lam = dlon + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
    u = ca2 * (a * a - b * b) / (b * b)
    x = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    y = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    return b * x * (sigma - y * ss * (cm + y / 4 * (cs * (2 * cm * cm - 1) - y / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) / 1000


def test_geodesic_is_the_converged_formula(spark):
    rng = random.Random(7)
    rows = [(rng.uniform(-180, 180), rng.uniform(-80, 80), rng.uniform(-180, 180), rng.uniform(-80, 80)) for _ in range(300)] + [(179.9, 10.0, -179.9, 10.0), (0.0, 90.0, 50.0, -90.0), (36.0, -1.0, 36.000001, -1.0), (5.0, 5.0, 5.0, 5.0)]
    rows = [r for r in rows if geo_angle(r) < 175]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = df.select("*", geo.geodesic_km(*map(F.col, "abcd")).alias("km")).collect()
    assert all(abs(r.km - inverse_by_hand(r.a, r.b, r.c, r.d)) < 1e-6 for r in got)


def geo_angle(r):
    lon1, lat1, lon2, lat2 = map(math.radians, r)
    return math.degrees(math.acos(max(-1, min(1, math.sin(lat1) * math.sin(lat2) + math.cos(lat1) * math.cos(lat2) * math.cos(lon2 - lon1)))))


def test_geodesic_of_odd_points(spark):
    odd = [(None, 0.0, 1.0, 1.0), (math.nan, 0.0, 1.0, 1.0), (0.0, math.inf, 1.0, 1.0)]
    assert [r[0] for r in spark.createDataFrame(odd, "a double, b double, c double, d double").select(geo.geodesic_km(*map(F.col, "abcd"))).collect()] == [None] * 3
    near = spark.range(1).select(geo.geodesic_km(*map(F.lit, (0.0, 0.0, 179.7, 0.5))), geo.haversine_km(*map(F.lit, (0.0, 0.0, 179.7, 0.5)))).first()
    assert near[0] == near[1]  # nearly antipodal


def test_points_without_finite_coordinates_meet_no_polygon(spark):
    rings = [[[(100.0 + i, 60.0), (100.01 + i, 60.0), (100.01 + i, 60.01), (100.0 + i, 60.01), (100.0 + i, 60.0)]] for i in range(5)]
    layer = spark.createDataFrame([(str(i), r) for i, r in enumerate(rings)] + [("bad", [[(math.nan, 60.0), (101.0, 60.0), (101.0, 61.0), (math.nan, 60.0)]])], "name string, rings array<array<struct<x:double,y:double>>>")
    points = [(0, 100.005, 60.005), (1, math.nan, 60.0), (2, 100.0, math.inf), (3, None, 60.0), (4, -math.inf, math.nan), (5, 0.0, 0.0)]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    spread = joins.CellSpread(layer, "rings").meet(df.select("id", "lon", "lat"), tuple(map(F.col, ("lon", "lat", "lon", "lat"))))
    assert {r.id for r in spread.collect()} == {0}
    got = {r.id: (r.name, r.matches) for r in joins.spatial_join(df, layer, "lon", "lat", "rings", "name", ["name"]).collect()}
    assert got == {0: ("0", 1)} | {i: (None, 0) for i in range(1, 6)}
    steps = df.select(F.lit("a").alias("entity_id"), F.timestamp_seconds(F.col("id")).alias("observed_at"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    assert sum(r.points_inside for r in movement.route_overlap(steps, layer).collect()) == 1


@pytest.mark.parametrize("slice_s", [1, 7, 100, 10**6])
def test_asof_slices_are_brute_force(spark, slice_s):
    rng = random.Random(slice_s)
    left = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(-50, 300)])) for i in range(200)]
    right = [(j, rng.choice(["a", "a", "b", None]), t := rng.randrange(-50, 300), rng.choice([None, t, t + rng.randrange(90)])) for j in range(120)]
    at = lambda c: F.timestamp_seconds(F.col(c)).alias(c)
    lefts = spark.createDataFrame(left, "id int, k string, t long").select("id", "k", at("t"))
    rights = spark.createDataFrame(right, "r int, k string, u long, seen long").select("r", "k", at("u"), at("seen"))
    got = {x.id: x.r for x in joins.asof_join(lefts, rights, ["k"], "t", "u", "r", 60, ["r"], "seen", slice_s=slice_s).collect()}

    def best(k, t):
        fit = [(u, -r) for r, key, u, seen in right if k is not None and key == k and t is not None and seen is not None and t - 60 <= u <= t and seen <= t]
        return -max(fit)[1] if fit else None

    assert got == {i: best(k, t) for i, k, t in left}


def test_asof_of_one_hot_key_uses_many_tasks(spark):
    rows = spark.range(4000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), F.col("id").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = joins.asof_join(rows, rows.select("k", F.col("t").alias("u"), "n"), ["k"], "t", "u", "n", 3600, ["n"], slice_s=3600)
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals_and_ranks_cross_parts(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, x int")
    got = relational.average_rank(df, "x", "rank", ["g"]).collect()
    assert len(got) == len(rows)

    def rank(g, x):
        own = [b for a, b in rows if a == g and b is not None]
        return sum(b < x for b in own) + (own.count(x) + 1) / 2 if x is not None else None

    assert all(r["rank"] == rank(r.g, r.x) for r in got)
    totals = relational.running_total(df.where("x is not null").groupBy("x").agg(F.count("*").alias("n")), "x", "n", "total").collect()
    assert {r.x: r.total for r in totals} == {x: sum(b is not None and b <= x for _, b in rows) for x in {b for _, b in rows} - {None}}
    plan = relational.running_total(df, "x", "x", "total")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("lit", "") or plan.count("SinglePartition") == 1  # only the parts' sums meet


def test_grouped_quantiles(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([None, rng.gauss(0, 1), 1.0])) for _ in range(5000)] + [("empty", None), ("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q1, r.median) for r in relational.quantiles(df, {"q1": (F.col("v"), 0.25), "median": (F.col("v"), 0.5)}, 1000, ["g"]).collect()}
    for g in ("a", "b", "c", None, "one"):
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g] == pytest.approx(tuple(np.percentile(own, [25, 50])))
    whole = relational.with_quantiles(df.groupBy("g").count(), df, {"median": (F.col("v"), 0.5)}, ["g"])
    assert {r.g: r.median for r in whole.collect()}["empty"] is None and whole.count() == 6


# --- streams of ids that look like numbers, versions, coverage, preparation


def test_stream_append_keeps_ids_that_look_like_numbers(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "series_id string, batch_key string, v int"
    sent = [("007", "b", 1), ("7", "b", 2), ("abc", "b", 3), ("7", "b", 4), (None, "b", 5), (None, "b", 6), ("1e3", "b", 7), ("2024-01-01", "b", 8)]
    for i, row in enumerate(sent):
        source = tmp_path / f"source{i}"
        spark.createDataFrame([row], schema).write.parquet(str(source))
        append.append_stream(spark.readStream.schema(schema).parquet(str(source)), path, str(tmp_path / f"checkpoint{i}")).awaitTermination()
    got = append.stored_rows(spark, path, spark.createDataFrame([], schema).schema).collect()
    assert sorted((r.series_id or "", r.batch_key, r.v) for r in got) == [("", "b", 5), ("007", "b", 1), ("1e3", "b", 7), ("2024-01-01", "b", 8), ("7", "b", 2), ("abc", "b", 3)]


def test_versions_meet_live_batches_once(spark):
    rng = random.Random(6)
    batches = [(rng.choice("ab"), f"b{i}", a := rng.randrange(70), rng.choice([None, a, a + 1, a + rng.randrange(60)])) for i in range(150)] + [("a", "all", 0, None), ("a", "last", 2**20 - 1, None)]
    versions = [(s, v) for s in "abc" for v in (*range(72), 127, 128, 2**20 - 1)] + [("a", None)]
    held = spark.createDataFrame(batches, "series_id string, batch_key string, added_in_version int, superseded_in_version int")
    got = joins.live_in_versions(spark.createDataFrame(versions, "series_id string, version int"), held).select("series_id", "version", "batch_key").collect()
    assert sorted(map(tuple, got)) == sorted((s, v, b) for s, v in versions if v is not None for t, b, low, high in batches if s == t and low <= v and (high is None or v < high))


def test_only_distinct_spans_are_cut_into_blocks(spark):
    """2,000 batches of three spans, one of them written in two ways: each batch comes once, and few rows of blocks are made."""
    spans = [(0, None), (0, 1 << joins.LEVELS), (None, 3)]
    held = spark.createDataFrame([("a", f"b{i}", *spans[i % 3]) for i in range(2_000)], "series_id string, batch_key string, added_in_version int, superseded_in_version int")
    versions = spark.createDataFrame([("a", 1), ("a", 5)], "series_id string, version int")
    live = joins.live_in_versions(versions, held)
    got = sorted((r.version, r.batch_key) for r in live.collect())
    assert got == sorted((v, f"b{i}") for v in (1, 5) for i in range(2_000) if v == 1 or i % 3 < 2)
    assert live.columns == ["series_id", "version", "batch_key", "added_in_version", "superseded_in_version"]
    plan = live._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cut = next(i for i, line in enumerate(plan) if "Generate" in line and "_added" in line)
    assert any("Aggregate" in line for line in plan[cut:])


def test_sources_are_covered_by_the_union_of_their_files(spark):
    d = dt.date
    files = [("a", 0.0, 0.0, 1.0, 1.0, d(2024, 1, 1), d(2024, 1, 10)), ("a", 0.5, 0.5, 2.0, 2.0, d(2024, 1, 5), d(2024, 1, 7)), ("a", 0.5, 0.5, 2.0, 2.0, d(2024, 1, 14), d(2024, 2, 1)),
             ("b", None, None, None, None, None, d(2024, 3, 1)), ("c", 5.0, 5.0, 6.0, 6.0, d(2024, 1, 12), d(2024, 1, 12))]
    df = spark.createDataFrame(files, "source_id string, west double, south double, east double, north double, start date, end date")
    got = {x.source_id: (x.files, x.gaps, x.uncovered_days, x.share) for x in catalog.source_coverage_gaps(df, (0.0, 0.0, 2.0, 2.0), F.lit(d(2024, 1, 3)), F.lit(d(2024, 1, 13))).collect()}
    assert got["a"] == (3, [], 3, pytest.approx((1 + 1.5 * 1.5 - 0.25) / 4))
    assert got["b"] == (1, ["bbox_unknown", "start_unknown"], 0, None)
    assert got["c"] == (1, ["bbox", "start", "end"], 0, 0.0)
    kinds = spark.createDataFrame([(["rain"],), (None,), ([],)], "variables array<string>")
    assert [x.kind for x in catalog.missing_kinds(kinds, ["rain", "snow"]).collect()] == ["snow"]


def test_preparation_counts_what_it_leaves_out(spark):
    d = dt.date
    rows = [("a", d(2024, 1, 1), "public", "kob", 1.0, 1.0, "1"), ("a", d(2024, 1, 1), "public", "kob", 1.0, 1.0, "2"), ("b", d(2024, 1, 1), "secret", "kob", 1.0, 1.0, "x"), ("b", d(2023, 1, 1), "public", "kob", 1.0, 1.0, None),
            ("c", d(2024, 1, 1), None, "kob", 1.0, 1.0, "3"), ("c", d(2024, 1, 2), "public", "topi", 1.0, 1.0, "-3"), ("d", d(2024, 1, 2), "public", "kob", math.nan, 1.0, "inf"), (None, d(2024, 1, 3), "public", "kob", 200.0, 1.0, "4"), ("e", None, "public", "kob", 1.0, 1.0, "4")]
    df = spark.createDataFrame(rows, "entity_id string, day date, access_scope string, species string, longitude double, latitude double, displacement_km string")
    prepared = checks.prepare(df, d(2024, 1, 1), d(2024, 1, 31), ["displacement_km"], ["kob"])
    assert sorted(str((x.entity_id, x.displacement_km)) for x in prepared.rows.collect()) == ["('a', 1.0)", "('a', 2.0)", "(None, 4.0)"]
    assert prepared.counts() == {"rows_read": 9, "out_of_scope": 2, "out_of_time": 2, "wrong_species": 1, "no_coordinates": 1, "invalid_numbers": 1, "nonfinite": 2, "negative": 1, "outside_wgs84": 1, "rows_kept": 3, "off_grain": 1, "no_animal": 1}
    with pytest.raises(CheckFailed, match="INVALID_NUMBERS"):
        prepared.check()
    nothing = checks.prepare(df.drop("access_scope", "species", "longitude", "displacement_km"), d(2030, 1, 1), d(2030, 1, 31))
    assert nothing.rows.count() == 0 and nothing.counts()["rows_read"] == nothing.counts()["out_of_time"] == 9
    with pytest.raises(CheckFailed, match="NO_ROWS"):
        nothing.check()
    empty = checks.prepare(df.limit(0), d(2030, 1, 1), d(2030, 1, 31))
    assert empty.rows.count() == 0 and empty.counts()["rows_read"] == 0


def test_cells_take_the_pixel_under_their_centre(spark):
    cells = spark.createDataFrame([(7492, 20911), (7492, 20912), (0, 0), (None, 1)], "row long, col long")
    lon, lat = cells.where("row = 7492 and col = 20911").select(*geo.cell_centre(F.col("row"), F.col("col"))).first()
    source = spark.createDataFrame([(0, 0, 5.0), (0, 1, 6.0), (1, 1, None)], "pixel_row long, pixel_col long, value double")
    raster = (lon - 0.001, lat + 0.001, 0.01, 0.01, 2, 2)  # a cell is 0.0104 degrees wide
    got = stats.sample_cell_centres(cells, source, raster).collect()
    assert sorted(map(tuple, got)) == [(7492, 20911, 0, 0, 5.0), (7492, 20912, 0, 1, 6.0)]


# --- corrections of a stream, studies, places in an order


CELL_ROWS = "source_id string, variable string, cell long, time_start timestamp_ntz, product_status string, processing_version string, mapping_version string, valid_fraction double, available_at timestamp_ntz, source_item_id string, value double"


def _observation(day, status, value, item="i", processing="1", cell=1, variable="rain"):
    at = None if day is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    return ("s", variable, cell, at, status, processing, "1", 1.0, at, item, value)


def _sent(spark, tmp_path, batches, late_days):
    """Sends each batch to a stream of its own start, so that each is a restart; the changes after all."""
    sent, path = tmp_path / "sent", str(tmp_path / "changes")
    for rows in batches:
        spark.createDataFrame(rows, CELL_ROWS).coalesce(1).write.mode("append").parquet(str(sent))
        stream = spark.readStream.schema(CELL_ROWS).parquet(str(sent))
        corrections.write_corrections(corrections.corrections(stream, late_days), path, str(tmp_path / "checkpoint")).awaitTermination()
    return spark.read.parquet(path)


def test_a_final_row_replaces_a_preliminary_one(spark, tmp_path):
    first = [_observation(0, "preliminary", 1.0), _observation(1, "final", 2.0), _observation(1, "preliminary", 9.0, "z", "9"), _observation(0, "preliminary", None, cell=None, variable=None)]
    batches = [first, first, [_observation(0, "final", 3.0, "j")], [_observation(0, "preliminary", 8.0, "zz", "9"), _observation(1, "final", 4.0, "i", "2")], first + [_observation(0, "final", 3.0, "j")]]
    changes = _sent(spark, tmp_path, batches, 30)
    held = {(x.cell, x.day.day if x.day else None): (x.value, x.product_status, x.revision) for x in corrections.in_force(changes).collect()}
    assert held == {(1, 1): (3.0, "final", 2), (1, 2): (4.0, "final", 2), (None, 1): (None, "preliminary", 1)}
    counts = {x.action: x.n for x in changes.groupBy("action").agg(F.sum("rows").alias("n")).collect()}
    assert counts == {"new": 3, "replaced": 2, "unchanged": sum(map(len, batches)) - 5}


def test_late_rows_of_a_stream_are_counted_and_change_nothing(spark, tmp_path):
    batches = [[_observation(0, "preliminary", 1.0), _observation(20, "preliminary", 2.0)], [_observation(9, "final", 7.0), _observation(10, "final", 8.0), _observation(None, "final", 9.0), _observation(40, "final", 5.0)],
               [_observation(20, "final", 6.0), _observation(40, "final", 5.5, "j")], [_observation(0, "final", 6.0, cell=2)]]
    changes = _sent(spark, tmp_path, batches, 10)
    assert changes.where("action = 'late'").agg(F.sum("rows")).first()[0] == 3  # days 9 and 20, and one without a time
    held = {(x.cell, (x.day - dt.date(2024, 1, 1)).days): x.value for x in corrections.in_force(changes).collect()}
    assert held == {(1, 0): 1.0, (1, 10): 8.0, (1, 20): 2.0, (1, 40): 5.5, (2, 0): 6.0}
    assert changes.agg(F.sum("rows")).first()[0] == sum(map(len, batches))


def test_files_of_a_stream_dont_grow_with_the_table(spark, tmp_path):
    """One version holds all rows: its files are bounded, too."""
    rows = spark.range(4_000).select(F.lit(1).alias("version"), F.col("id").cast("string").alias("item"))
    assert corrections.send(rows, str(tmp_path / "sent"), "version", "item", file_rows=400) == 10
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "sent")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 4_000 and max(sizes) < 800
    assert corrections.send(rows.limit(3), str(tmp_path / "few"), "version", "item") == 6


def test_the_order_of_a_stream_doesnt_matter(spark, tmp_path):
    rng = random.Random(8)
    rows = [_observation(rng.randrange(5), rng.choice(["final", "preliminary", None]), rng.random(), rng.choice(["a", "b", "", None]), rng.choice(["1", "2", None]), rng.randrange(3)) for _ in range(120)]
    rows = [(*x[:7], rng.choice([None, math.nan, 0.5, 1.0]), rng.choice([None, x[8]]), *x[9:]) for x in rows]
    one = corrections.in_force(_sent(spark, tmp_path / "a", [rows], 100)).select("cell", "day", "value", "source_item_id")
    many = rng.sample(rows, len(rows))
    two = corrections.in_force(_sent(spark, tmp_path / "b", [many[:50], many[20:90], many[90:]], 100)).select("cell", "day", "value", "source_item_id")
    ranked = lambda df: sorted((x.cell, x.day) for x in df.collect())
    assert ranked(one) == ranked(two)
    by_rank = {}
    for x in rows:
        fraction = -1.0 if x[7] is None or math.isnan(x[7]) else x[7]
        rank = (x[4] == "final", x[5] or "", x[6] or "", fraction, x[8] or dt.datetime.min, x[9] or "")
        by_rank.setdefault((x[2], x[3].date()), []).append((rank, x[10]))
    best = {k: {v for r, v in found if r == max(found)[0]} for k, found in by_rank.items()}
    for df in (one, two):
        assert all(x.value in best[x.cell, x.day] for x in df.collect())


def test_studies_get_their_own_versions(spark):
    d = lambda x: dt.datetime(2023, 12, 30) + dt.timedelta(days=x)
    manifest = lambda study, title: json.dumps({k: x for k, x in (("study", study), ("title", title)) if x is not None})
    registry = spark.createDataFrame([("m", "a", "ia", manifest("1", "Data from: Kob"), 2, 5), ("m", "b", "ib", manifest("1", ""), 5, None), ("m", "c", "ic", manifest("1", None), 9, None), ("m", "d", "id", manifest("2", "Topi"), 3, 4), ("m", "e", "ie", None, 7, None)],
                                     "series_id string, batch_key string, source_item_id string, raw_manifest string, added_in_version int, superseded_in_version int")
    split = series.split_by_study(registry)
    got = {x.batch_key: (x.new_series_id, x.new_version, x.new_superseded) for x in split.collect()}
    assert got == {"a": ("m--study-1", 1, 2), "b": ("m--study-1", 2, None), "c": ("m--study-1", 3, None), "d": ("m--study-2", 1, 2), "e": ("m", 1, None)}
    fixes = spark.createDataFrame([("m", "a", "x", d(0), 0.0, 0.0, "c0"), ("m", "b", "x", d(0), 1.0, 2.0, "c1"), ("m", "b", "y", d(5), 3.0, -4.0, "c1"), ("m", "c", None, d(2), None, None, None), ("m", "d", "x", d(1), 9.0, 9.0, "c9"), ("n", "b", "x", d(9), 9.0, 9.0, "c9")],
                                  "series_id string, batch_key string, entity_id string, observed_at timestamp_ntz, longitude double, latitude double, cell string")
    entities = spark.createDataFrame([("x", "Kobus kob"), ("y", None)], "entity_id string, taxon_name string")
    sets = {x.dataset_id: x for x in series.study_datasets(split, fixes, entities).collect()}
    one, two = sets["m--study-1"], sets["m--study-2"]
    assert (one.version, one.description, one.artifacts, one.row_count, one.start, one.end) == (3, "Kob", ["ib", "ic"], 3, d(0), d(5))
    assert (one.west, one.south, one.east, one.north, one.cells, one.species) == (1.0, -4.0, 3.0, 2.0, 1, ["Kobus kob"])
    assert one.tags[3:] == ["year:2023", "year:2024"] and list(series.STUDY_TAGS) == one.tags[:3]
    assert (two.version, two.description, two.artifacts, two.row_count, two.start, two.species, two.tags) == (2, "Topi", [], 0, None, [], list(series.STUDY_TAGS))
    assert series.study_datasets(series.split_by_study(registry.limit(0)), fixes, entities).count() == 0


def test_published_versions_are_left_out(spark):
    rows = [("s", 1, None, "m1", "kob", "i2", 1.0, 2.0), ("s", 2, None, "m2", None, "i1", 3.0, 4.0), ("s", 3, 4, "m3", "topi", "i3", 9.0, 9.0), ("t", 1, None, "m1", "kob", "i9", None, 4.0), ("u", 1, None, "m1", "kob", "i9", 1.0, 91.0)]
    df = spark.createDataFrame([(*x, dt.datetime(2024, 1, 1), "fix", 1) for x in rows], "series_id string, added_in_version int, superseded_in_version int, mapping_version string, taxon string, item string, lon double, lat double, time_start timestamp_ntz, variable string, cell int")
    held = spark.createDataFrame([("s", 1), ("t", 1), ("u", 0)], "series_id string, version int")
    got = {x.series_id: x for x in series.publish_summary(df, ["series_id"], held, "taxon", "item", "lon", "lat").collect()}
    assert set(got) == {"s", "u"}
    assert (got["s"].version, got["s"].mapping_versions, got["s"].taxa, got["s"].artifacts, got["s"].row_count) == (2, "m1,m2", ["kob"], ["i2", "i1"], 2)
    assert (got["s"].west, got["s"].south, got["s"].east, got["s"].north) == (1.0, 2.0, 3.0, 4.0) and got["u"].west is None and got["u"].north is None
    later = spark.createDataFrame([("s", 5)], "series_id string, version int")  # one published later than what is live
    assert {x.series_id for x in series.publish_summary(df, ["series_id"], later).collect()} == {"t", "u"}


def test_items_stamp_cell_observations(spark):
    zones = spark.createDataFrame([("i", 1, "nd", 0.5, 0.1, 1.0, 9), ("i", 2, "x", None, None, 0.1, 1)], "source_item_id string, cell int, variable string, value double, std double, valid_fraction double, pixel_count long")
    items = spark.createDataFrame([("i", 1, 2, "day", 3, "src", "v", "preliminary", "s")], "source_item_id string, time_start int, time_end int, time_precision string, available_at int, source_id string, processing_version string, product_status string, series_id string")
    units = spark.createDataFrame([("nd", "1")], "variable string, unit string")
    got = {x.cell: (x.dataset_id, x.unit, x.quality_flag, x.stat, x.available_at) for x in stats.to_cell_observations(zones, items, units, "m", "mean", 30).collect()}
    assert got == {1: ("s", "1", "preliminary", "mean", 3), 2: ("s", None, "low_valid_fraction", "mean", 3)}
    for bad in ((zones.withColumn("source_item_id", F.lit("j")), items, units), (zones, items.union(items), units), (zones, items, units.union(units))):
        with pytest.raises(Exception, match="unknown item|twice"):
            stats.to_cell_observations(*bad, "m", "mean", 30).collect()


def test_places_are_numbered_over_parts(spark):
    rng = random.Random(9)
    values = rng.sample(range(10**6), 3000)
    df = spark.createDataFrame([(v // 7, v) for v in values] + [(None, -1)], "a int, b int").repartition(5)
    got = relational.numbered(df, [F.desc("a"), F.asc("b")], "place").collect()
    order = sorted(((None if v < 0 else v // 7, v) for v in [*values, -1]), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.place)] == order and sorted(x.place for x in got) == list(range(1, 3002))
    assert relational.numbered(df.limit(0), [F.asc("b")], "place").count() == 0


def test_validities_meet_by_the_buckets_they_touch(spark):
    random.seed(5)
    t = lambda s: dt.datetime(1969, 12, 30) + dt.timedelta(seconds=s)  # noqa: E731  before and after 1970
    left = [(random.choice("ab"), t(random.randrange(400_000)), i) for i in range(300)] + [(None, t(5), -1), ("a", None, -2)]
    right = [(random.choice("ab"), t(s := random.randrange(400_000)), t(s + random.choice([0, 1, 7, 3_600, 86_400])), i) for i in range(200)] + [("a", None, t(9), -1), ("a", t(9), None, -2), (None, t(0), t(9), -3)]
    want = sorted((x[2], y[3]) for x in left for y in right if x[0] and x[0] == y[0] and x[1] and y[1] and y[2] and y[1] <= x[1] < y[2])
    lefts, rights = spark.createDataFrame(left, "k string, at timestamp, i int"), spark.createDataFrame(right, "k string, s timestamp, e timestamp, j int")
    for parts in (1, 4, 7):
        found = joins.validity_join(lefts, rights, ["k"], "at", "s", "e", ["j"], 86_400, parts)
        assert found.columns == ["k", "at", "i", "j"] and sorted((r.i, r.j) for r in found.collect()) == want
    with pytest.raises(Exception, match="longer than longest_s"):
        joins.validity_join(lefts, rights, ["k"], "at", "s", "e", ["j"], 86_399).collect()
    assert joins.validity_join(lefts, rights.limit(0), ["k"], "at", "s", "e", ["j"], 60).count() == 0


def test_pairs_of_small_tables_are_spread_over_tasks(spark):
    lefts = spark.range(400).coalesce(1).select(F.concat(F.lit("a"), F.col("id") % 1).alias("k"), F.timestamp_seconds(F.col("id") * 900).alias("at"), F.col("id").alias("i"))
    rights = lefts.select("k", F.col("at").alias("s"), F.expr("at + interval 1 day").alias("e"), F.col("i").alias("j"))
    found = joins.validity_join(lefts, rights, ["k"], "at", "s", "e", ["j"], 86_400).withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in found.groupBy("task").count().collect()]
    assert len(tasks) > 3 and sum(tasks) == sum(min(i + 1, 96) for i in range(400)) and max(tasks) < sum(tasks) / 2


def test_blocks_of_pairs_are_whole_and_small_on_disk(spark, tmp_path):
    lefts = spark.range(601).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 3).alias("at"), F.col("id").cast("string").alias("i"))
    rights = spark.range(5000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") - 3000).alias("s"), F.timestamp_seconds(F.col("id")).alias("e"), F.col("id").cast("string").alias("j"))
    joins.validity_join(lefts, rights, ["k"], "at", "s", "e", ["j"], 86_400).select("i", "j").write.parquet(f"{tmp_path}/pairs")
    j = F.col("j").cast("long")
    found = spark.read.parquet(f"{tmp_path}/pairs").groupBy("i").agg(F.count("*"), F.count_distinct("j"), F.min(j), F.max(j)).collect()
    last = {str(i): min(3 * i + 3000, 4999) for i in range(601)}
    assert sorted(map(tuple, found)) == sorted((i, to - 3 * int(i), to - 3 * int(i), 3 * int(i) + 1, to) for i, to in last.items())
    stored = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert stored < 0.3 * sum(x[1] for x in found)


def test_validities_come_with_the_columns_asked_for(spark):
    left = spark.sql("select 'a' as k, timestamp'2024-01-02' as at, 1 as i, 'x' as rest")
    right = spark.sql("select 'a' as k, timestamp'2024-01-01' as s, timestamp'2024-01-03' as e, 2 as j, 'y' as other")
    found = joins.validity_join(left, right, ["k"], "at", "s", "e", ["j"], 2 * 86_400, left_columns=["i", "k"])
    assert found.columns == ["i", "k", "j"] and [tuple(r) for r in found.collect()] == [(1, "a", 2)]


def test_numbers_as_reports_show_them(spark):
    shown = {None: "unknown", math.nan: "unknown", math.inf: "unknown", 0.0: "0", -0.0000001: "0", -2.5: "-2.5", 12.0: "12", 100.0: "100", 1.2345678: "1.234568", 0.1 + 0.2: "0.3", 1e12: "1000000000000", 1234.5: "1234.5"}
    df = spark.createDataFrame([(x,) for x in shown], "x double").select("x", text.formatted(F.col("x")).alias("t"), text.formatted(F.col("x"), 1).alias("one"))
    found = df.collect()
    assert [r.t for r in found] == list(shown.values())
    assert {r.one for r in found if r.x == 1.2345678} == {"1.2"}


def test_reports_of_groups(spark):
    rows = [("a", 2, "later", "d2", None), ("a", 1, "first", "d1", "few rows."), ("a", 1, None, "d1", "few rows."), ("b", 1, "only", None, None), ("c", 1, None, None, None), (None, 1, "x", "d", "y")]
    df = spark.createDataFrame(rows, "k string, n int, said string, dataset string, limits string")
    found = {r.k: r.report for r in report.render(df, ["k"], ["n"], "said", "dataset", "limits", "us").collect()}
    assert found == {"a": "first\n\nlater\n\nEvidence: datasets d1, d2.\n\nAttribution: us.\n\nLimitations: few rows.", "b": "only\n\nAttribution: us.", "c": "Attribution: us.", None: "x\n\nEvidence: datasets d.\n\nAttribution: us.\n\nLimitations: y"}
    assert report.render(df.limit(0), ["k"], ["n"], "said").count() == 0
    assert {r.report for r in report.render(df.where("k = 'c'"), ["k"], ["n"], "said").collect()} == {""}


def test_types_are_counted_and_parted(spark):
    rows = [("1", "1.5", "2026-01-01"), (" -2e3 ", "91", "2026-01-01T10:00:00Z"), ("1d", "NaN", "soon"), (None, None, None), ("Infinity", "-90", "2026-02-30"), ("", "x", "2026-01-01 01:02:03")]
    df = spark.createDataFrame(rows, "n string, `la t` string, seen string")
    kinds = {"n": "number", "la t": "latitude", "seen": "time"}
    found = {r["column"]: (r.kind, r.rows, r.nulls, r.bad, r.nonfinite, r.outside, r.example) for r in checks.type_report(df, kinds).collect()}
    assert found == {"n": ("number", 6, 1, 2, 1, 0, ""), "la t": ("latitude", 6, 1, 1, 1, 1, "x"), "seen": ("time", 6, 1, 2, 0, 0, "2026-02-30")}
    good, bad = checks.typed(df, kinds)
    assert [(r.n, r["la t"], r.seen) for r in good.collect()] == [(1.0, 1.5, dt.datetime(2026, 1, 1)), (None, None, None)]
    assert [r.problems for r in bad.collect()] == [["la t:outside"], ["n:bad", "seen:bad"], ["seen:bad"], ["n:bad", "la t:bad"]]
    assert bad.drop("problems").schema == df.schema and bad.first().n == " -2e3 "
    for kind, code in (({"n": "integer"}, "BAD_NUMBER"), ({"seen": "time"}, "BAD_TIMESTAMP"), ({"la t": "number"}, "BAD_NUMBER")):
        assert checks.code_of(lambda k=kind: checks.check_types(df, k)) == code
    assert checks.code_of(lambda: checks.check_types(df.where("n = ' -2e3 '"), kinds)) == "OUTSIDE_WGS84"
    assert checks.code_of(lambda: checks.check_types(df.where("n = '1'"), kinds)) == "ok"
    empty = checks.type_report(df.limit(0), kinds).collect()
    assert [(r["column"], r.rows, r.bad, r.example) for r in empty] == [(c, 0, 0, None) for c in kinds]
    native = spark.createDataFrame([(1, math.nan, dt.datetime(2026, 1, 1))], "n int, `la t` double, seen timestamp")
    assert [(r.bad, r.nonfinite) for r in checks.type_report(native, kinds).collect()] == [(0, 0), (0, 1), (0, 0)]
    with pytest.raises(ValueError):
        checks.type_report(df, {"n": "colour"})


def test_exports_say_what_a_reader_leaves_out(spark):
    rows = [("1", "2026-01-01 00:00:00", "1", "2", "a"), ("2", None, "1", "2", "a"), ("3", "never", None, "2", "a"), ("4", "never", "x", "2", "a"), ("5", "2026-01-01 00:00:00", "x", "2", "a"), ("6", "2026-01-01 00:00:00", "181", "2", "a")]
    df = tracking.normalize_headers(spark.createDataFrame(rows, "event_id string, timestamp string, location_long string, location_lat string, individual_local_identifier string"))
    assert tracking.tracking_report(df).first().asDict() == {"rows": 6, "missing": 2, "bad_time": 1, "bad_place": 1, "kept": 2, "outside_wgs84": 1}
    assert tracking.read_tracking(df, "m", "9").count() == 2


def test_new_cells_of_each_version(spark):
    df = spark.createDataFrame([("s", 1, 1), ("s", 1, 2), ("s", 2, 2), ("t", 1, 3), (None, 1, 1), ("s", None, 1), ("s", 3, None)], "series_id string, cell int, added_in_version int")
    assert sorted(series.new_cells(df).collect()) == [("s", 1, 1), ("s", 2, 2), ("t", 1, 3)]


def test_share_of_words_is_one_for_texts_and_columns(spark):
    texts = ["The apache LICENSE", "apachelicense the9", "the,the", "", None, "9the the-license", "LİCENSE theé", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for asked in ("the Apache license", "the the", "9the", "l\u0130cense", "..."):
        found = df.select(catalog.word_share(F.col("t"), asked).alias("a"), catalog.word_share(F.col("t"), F.lit(asked)).alias("b")).collect()
        assert [r.a for r in found] == [r.b for r in found]
