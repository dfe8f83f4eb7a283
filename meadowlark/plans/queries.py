"""One query for each operator of the inventory, over the driver's tables, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, indices
from ..functions.text import formatted
from ..operators import catalog, checks, forecast, joins, movement, relational, report, series, stats
from ..sources import tracking
from ..sources.storage import shared_folder
from ..streaming import append, corrections
from .views import FIRST_DAY, Views, r, spheroid_sql, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
REGION = (36.90, -1.55, 37.00, -1.45)
RING = [[(36.90, -1.55), (37.00, -1.55), (37.00, -1.45), (36.90, -1.45), (36.90, -1.55)]]
CUTOFF = "2024-01-20"
NTZ = T.TimestampNTZType()


def query(name: str, views: str = "", sql: str | None = None):
    def register(make: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(views, sql)
        return make

    return register


def at(text: str):
    return F.lit(text).cast(NTZ)


# --- scans and sinks ---------------------------------------------------------------------------------------------


def _export(v: Views) -> DataFrame:
    """Events as a tracking export, all text."""
    e = v.fixes
    return e.select(F.when(F.col("event_type") != "purchase", F.col("source_record_id")).alias("event_id"), F.col("observed_at").cast("string").alias("timestamp"), F.col("longitude").cast("string").alias("location_long"),
                    F.when(F.col("event_type") != "click", F.col("latitude").cast("string")).alias("location_lat"), F.col("entity_id").alias("individual_local_identifier"), F.when(F.col("event_type") == "error", "false").otherwise("true").alias("visible"))


@query("scan_tracking_csv", "fixes", "SELECT source_record_id, 'm:9:' || entity_id AS entity_id, observed_at, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude, 'gps' AS sensor_type, quality_flag FROM fixes WHERE event_type NOT IN ('click', 'purchase')")
def _(v):
    df = tracking.normalize_headers(_export(v)).where("`event-id` is not null")
    out = tracking.read_tracking(df, "m", "9")
    return out.select("source_record_id", "entity_id", F.col("observed_at").cast(NTZ).alias("observed_at"), r("longitude").alias("longitude"), r("latitude").alias("latitude"), "sensor_type", "quality_flag")


@query("scan_tracking_api_csv", "fixes", "SELECT 'synthetic:' || substr(sha256('9|' || entity_id || '|' || strftime(observed_at, '%Y-%m-%d %H:%M:%S')), 1, 24) AS source_record_id, count(*) AS n FROM fixes WHERE event_type <> 'click' GROUP BY 1")
def _(v):
    named = _export(v).withColumn("timestamp", F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    out = tracking.read_tracking(tracking.with_event_ids(tracking.normalize_headers(named), "9"), "m", "9")
    return out.groupBy("source_record_id").agg(F.count("*").alias("n"))


@query("scan_tracking_nested_json", "fixes", "SELECT entity_id, date_trunc('millisecond', observed_at)::TIMESTAMP AS observed_at, round(longitude, 6) AS longitude FROM fixes")
def _(v):
    place = F.struct(F.unix_millis(F.col("observed_at").cast("timestamp")).alias("timestamp"), F.col("longitude").alias("location_long"), F.col("latitude").alias("location_lat"))
    nested = v.fixes.groupBy("entity_id").agg(F.collect_list(place).alias("locations")).select(F.array(F.struct(F.col("entity_id").alias("individual_local_identifier"), "locations")).alias("individuals"))
    flat = tracking.flatten_individuals(nested)
    return flat.select(F.col("individual_local_identifier").alias("entity_id"), F.col("timestamp").cast(NTZ).alias("observed_at"), r("location_long").alias("longitude"))


@query("scan_deployment_reference", "", "SELECT c_nationkey::VARCHAR AS animal, min(c_custkey) AS deploy_on, max(c_custkey) AS deploy_off, count(*) AS deployments FROM customer GROUP BY 1")
def _(v):
    reference = v.table("customer").select(F.col("c_nationkey").cast("string").alias("animal-id"), F.col("c_mktsegment").alias("animal-taxon"), F.col("c_custkey").alias("deploy-on-date"), F.col("c_custkey").alias("deploy-off-date"))
    return tracking.deployments(reference).select(F.col("animal-id").alias("animal"), "deploy_on", "deploy_off", F.size("deployments").cast("long").alias("deployments"))


@query("scan_pixels", "pixels", "SELECT cell, count(*) AS n FROM pixels WHERE x BETWEEN 1 AND 3 AND y BETWEEN 100 AND 20000 GROUP BY cell")
def _(v):
    return tracking.pixels(v.pixels, (1, 100, 3, 20000)).groupBy("cell").agg(F.count("*").alias("n"))


@query("align_bands_nearest", "pixels", "WITH coarse AS (SELECT y // 4 AS j, max(red) AS red20 FROM pixels WHERE x = 1 GROUP BY 1) SELECT p.cell, sum(c.red20) AS total FROM pixels p LEFT JOIN coarse c ON p.y // 4 = c.j AND p.x // 4 = 0 GROUP BY p.cell")
def _(v):
    named = v.pixels.withColumn("scene_id", F.lit("a"))
    coarse = named.where("x = 1").groupBy("scene_id", F.floor(F.col("y") / 4).alias("j")).agg(F.max("red").alias("red20")).select("scene_id", F.lit(0).alias("x"), (F.col("j") * 4).alias("y"), "red20")
    return tracking.align(named, coarse, 4, ["red20"]).groupBy("cell").agg(F.sum("red20").alias("total"))


@query("scan_boundaries", "boundaries", "SELECT name, round(west, 6) AS west, round(north, 6) AS north FROM boundaries")
def _(v):
    ring = F.transform(F.col("rings")[0], lambda p: F.array(p["x"], p["y"]))
    features = v.boundaries.select(F.lit("Polygon").alias("type"), F.to_json(F.struct(F.array(ring).alias("coordinates"))).alias("geometry"), F.to_json(F.struct("name")).alias("properties"))
    points = F.flatten("rings")
    return tracking.read_boundaries(features).select("name", r(F.array_min(F.transform(points, lambda p: p["x"]))).alias("west"), r(F.array_max(F.transform(points, lambda p: p["y"]))).alias("north"))


@query("scan_pinned", "datasets", "SELECT dataset_id, description FROM datasets WHERE dataset_id = 'd3' AND version = 0 AND access_scope = 'public'")
def _(v):
    return tracking.scan_pinned(v.datasets, "d3", 0, "public", ["dataset_id", "description"])


@query("scan_scoped", "fixes", "SELECT cell, count(*) AS n FROM fixes WHERE longitude BETWEEN 36.90e0 AND 37.00e0 AND latitude BETWEEN -1.55e0 AND -1.45e0 AND observed_at BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20' AND cell IN ('c6', 'c7', 'c8') GROUP BY cell")
def _(v):
    df = relational.in_region(relational.is_in(v.fixes, "cell", ["c6", "c7", "c8"]), "longitude", "latitude", RING)
    return relational.in_time_range(df, "observed_at", relational.widen(at("2024-01-10"), 2 * 86_400), at("2024-01-20")).groupBy("cell").agg(F.count("*").alias("n"))


@query("scan_feature_table", "", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(v):
    return tracking.read_features(v.spark, f"{v.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], {"o_orderstatus": "F"})


@query("scan_features_csv", "boundaries", "SELECT name, round(west, 6) AS lon, round(south, 6) AS lat FROM boundaries")
def _(v):
    path = shared_folder(v.spark)
    v.boundaries.select("name", F.col("west").alias("LNG"), F.col("south").alias("Latitude")).write.csv(path, header=True)
    return tracking.read_points_csv(v.spark, path).select("name", r("lon").alias("lon"), r("lat").alias("lat"))


@query("scan_features_geojson", "boundaries", "SELECT name, 'Polygon' AS type, 1 AS rings, round(east, 6) AS east FROM boundaries")
def _(v):
    path = shared_folder(v.spark)
    ring = F.transform(F.col("rings")[0], lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("name").alias("properties"))
    layers = v.boundaries.groupBy(F.lit("FeatureCollection").alias("type"), F.col("name")).agg(F.collect_list(feature).alias("features"))
    layers.select(F.to_json(F.struct("type", "features"))).repartition(25).write.text(path)
    features = tracking.read_geojson(v.spark, path)
    back = tracking.read_boundaries(features)
    east = F.array_max(F.transform(F.flatten("rings"), lambda p: p["x"]))
    return back.select("name", F.lit("Polygon").alias("type"), F.size("rings").alias("rings"), r(east).alias("east"))


@query("sink_feature_table", "daily", "SELECT entity_id, day, round(displacement_km, 6) AS displacement_km FROM daily WHERE cell = 'c3'")
def _(v):
    path = shared_folder(v.spark)
    columns = {"entity_id": {"type": "string", "role": "entity_id"}, "day": {"type": "date", "role": "event_time"}, "cell": {"type": "string", "role": "cell_id"}, "displacement_km": {"type": "double", "unit": "km"}}
    tracking.write_features(v.daily, path, columns, ["entity_id", "day"])
    return tracking.read_features(v.spark, path, ["entity_id", "day", "displacement_km"], {"cell": "c3"}).withColumn("displacement_km", r("displacement_km"))


@query("sink_geojson", "boundaries", """SELECT count(*) AS n, min(json_extract_string(g, '$.type')) AS type FROM (SELECT '{"type":"Point"}' AS g FROM boundaries)""")
def _(v):
    rows = relational.point_rows(v.boundaries.drop("rings"), "west", "south")
    return rows.agg(F.count("*").alias("n"), F.min(F.get_json_object("geometry", "$.type")).alias("type"))


@query("sample_rows", "", "SELECT 20::BIGINT AS n, 20::BIGINT AS keys, 20::BIGINT AS known")
def _(v):
    orders = v.table("orders")
    sample = relational.sample_rows(orders, 20)
    known = sample.join(orders.select("o_orderkey"), "o_orderkey", "left_semi")
    return sample.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys")).crossJoin(known.agg(F.count("*").alias("known")))


@query("lattice_generator", "", "SELECT n_nationkey, i AS lattice_row, j AS lattice_col, (DATE '2024-01-01' + to_months(m))::DATE AS month FROM nation, (SELECT unnest(range(3))::INTEGER AS i), (SELECT unnest(range(2))::INTEGER AS j), (SELECT unnest(range(4))::INTEGER AS m)")
def _(v):
    return relational.lattice(v.table("nation").select("n_nationkey"), 3, 2, 4)


# --- projections and filters -------------------------------------------------------------------------------------


@query("op_select", "", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def _(v):
    return relational.select_columns(v.table("orders"), {"id": "o_orderkey", "price": "o_totalprice"})


@query("op_filter", "fixes", "SELECT source_record_id, entity_id FROM fixes WHERE quality_flag <> 'marked_outlier' AND cell IN ('c1', 'c2') AND observed_at >= TIMESTAMP '2024-01-05 00:00:00' AND value > 10 AND attributes IS NOT NULL")
def _(v):
    return relational.filter_rows(v.fixes, [("quality_flag", "ne", "marked_outlier"), ("cell", "in", ["c1", "c2"]), ("observed_at", "ge", "2024-01-05T00:00:00Z"), ("value", "gt", 10), ("attributes", "not_null")]).select("source_record_id", "entity_id")


@query("filter_time_range", "fixes", "SELECT count(*) FILTER (WHERE observed_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15') AS kept, count(*) FILTER (WHERE NOT observed_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15') AS excluded FROM fixes")
def _(v):
    kept = relational.in_time_range(v.fixes, "observed_at", at("2024-01-05"), at("2024-01-15")).agg(F.count("*").alias("kept"))
    return kept.crossJoin(v.fixes.agg(F.count("*").alias("n"))).select("kept", (F.col("n") - F.col("kept")).alias("excluded"))


@query("filter_interval_range", "rain", "SELECT cell, interval_start FROM rain WHERE interval_start >= TIMESTAMP '2024-01-08' AND interval_end <= TIMESTAMP '2024-01-20'")
def _(v):
    return relational.in_interval_range(v.rain, "interval_start", "interval_end", at("2024-01-10"), at("2024-01-20"), 2 * 86_400).select("cell", "interval_start")


@query("filter_lookback", "daily", "SELECT entity_id, day, round(rolling, 6) AS rolling FROM (SELECT *, avg(displacement_km) OVER (PARTITION BY entity_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS rolling FROM daily WHERE day >= DATE '2024-01-04') WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
def _(v):
    wide = v.daily.where(F.col("day") >= relational.widen(at("2024-01-10"), 6 * 86_400).cast("date"))
    return relational.in_time_range(forecast.rolling_mean(wide, "displacement_km", 7, "rolling"), "day", F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date")).select("entity_id", "day", r("rolling").alias("rolling"))


@query("filter_region", "fixes", "SELECT source_record_id FROM fixes WHERE longitude BETWEEN 36.90e0 AND 37.00e0 AND latitude BETWEEN -1.55e0 AND -1.45e0")
def _(v):
    return relational.in_region(v.fixes, "longitude", "latitude", RING).select("source_record_id")


@query("filter_bbox", "fixes", "SELECT cell, count(*) AS n FROM fixes WHERE longitude BETWEEN 36.90e0 AND 37.00e0 AND latitude BETWEEN -1.55e0 AND -1.45e0 GROUP BY cell")
def _(v):
    return relational.in_bbox(v.fixes, "longitude", "latitude", REGION).groupBy("cell").agg(F.count("*").alias("n"))


@query("filter_species", "fixes", "SELECT source_record_id FROM fixes WHERE event_type IN ('view', 'click')")
def _(v):
    return relational.is_in(v.fixes, "event_type", ["view", "click"]).select("source_record_id")


@query("filter_scope", "datasets", "SELECT dataset_id, version FROM datasets WHERE access_scope IN ('public', 'team')")
def _(v):
    return relational.in_scope(v.datasets, "access_scope", ["team"]).select("dataset_id", "version")


@query("filter_quality", "fixes", "SELECT source_record_id FROM fixes WHERE quality_flag = 'ok'")
def _(v):
    return v.fixes.where("quality_flag = 'ok'").select("source_record_id")


@query("filter_cloud_cover", "", "SELECT p_partkey FROM part WHERE p_size <= 20 AND starts_with(p_brand, 'Brand#1')")
def _(v):
    return tracking.clear_scenes(v.table("part").select("p_partkey", F.col("p_size").alias("cloud_cover"), F.col("p_brand").alias("item_id")), 20, "Brand#1").select("p_partkey")


@query("drop_missing_coordinates", "daily", "SELECT count(*) FILTER (WHERE displacement_km IS NOT NULL) AS kept, count(*) FILTER (WHERE displacement_km IS NULL) AS dropped FROM daily")
def _(v):
    kept = relational.drop_missing(v.daily, "displacement_km", "longitude").agg(F.count("*").alias("kept"))
    return kept.crossJoin(v.daily.agg(F.count("*").alias("n"))).select("kept", (F.col("n") - F.col("kept")).alias("dropped"))


@query("mask_nonfinite", "", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS ratio FROM lineitem")
def _(v):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax") / F.nullif("l_discount", F.lit(0.0)))
    return relational.mask_nonfinite(v.table("lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio")), "ratio").withColumn("ratio", r("ratio"))


@query("filter_ready_family", "datasets", "SELECT dataset_id, version FROM datasets WHERE status = 'ready' AND family = 'cells'")
def _(v):
    return v.datasets.where("status = 'ready' and family = 'cells'").select("dataset_id", "version")


@query("case_conditional", "steps", "SELECT entity_id, day, CASE WHEN pday IS NULL THEN 'first' WHEN day - pday = 1 THEN 'adjacent' ELSE 'gap' END AS step FROM steps")
def _(v):
    days = movement.with_previous(v.daily)
    return days.select("entity_id", "day", F.when(F.col("previous_day").isNull(), "first").when(F.datediff("day", "previous_day") == 1, "adjacent").otherwise("gap").alias("step"))


# --- joins -------------------------------------------------------------------------------------------------------


@query("op_join", "", "SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _(v):
    return joins.join_checked(v.table("orders"), v.table("customer"), [("o_custkey", "c_custkey")], ["c_name", "c_acctbal"]).select("o_orderkey", "c_name", "c_acctbal")


@query("op_spatial_join", "fixes boundaries", """SELECT source_record_id, min(name) AS name, count(name) AS matches FROM fixes LEFT JOIN boundaries ON longitude BETWEEN west AND east AND latitude BETWEEN south AND north GROUP BY source_record_id""")
def _(v):
    named = v.boundaries.withColumn("tie", F.col("name"))
    return joins.spatial_join(v.fixes, named, "longitude", "latitude", "rings", "tie", ["name"]).select("source_record_id", "name", "matches")


@query("op_asof_join", "daily vegetation", """WITH hits AS (SELECT d.entity_id, d.day, v.source_record_id AS record, round(v.index_value, 6) AS index_value, row_number() OVER (PARTITION BY d.entity_id, d.day ORDER BY v.observed_at DESC, v.source_record_id) AS place
    FROM daily d JOIN vegetation v ON v.cell = d.cell AND v.observed_at <= d.day::TIMESTAMP AND v.observed_at >= d.day::TIMESTAMP - INTERVAL 5 DAY AND v.observed_at + INTERVAL 1 DAY <= d.day::TIMESTAMP)
    SELECT d.entity_id, d.day, h.record, h.index_value FROM daily d LEFT JOIN hits h ON h.entity_id = d.entity_id AND h.day = d.day AND h.place = 1""")
def _(v):
    days = v.daily.withColumn("at", F.col("day").cast(NTZ))
    seen = v.vegetation.withColumn("seen", F.col("observed_at") + F.expr("interval 1 day"))
    out = joins.asof_join(days, seen, ["cell"], "at", "observed_at", "source_record_id", 5 * 86_400, ["source_record_id", "index_value"], "seen")
    return out.select("entity_id", "day", F.col("source_record_id").alias("record"), r("index_value").alias("index_value"))


@query("op_window_aggregate", "daily rain", """WITH sums AS (SELECT d.entity_id, d.day, sum(r.rainfall_mm) AS total, count(*) / 7.0e0 AS cover FROM daily d JOIN rain r ON r.cell = d.cell AND r.interval_start >= d.day::TIMESTAMP - INTERVAL 7 DAY
    AND r.interval_end <= d.day::TIMESTAMP AND r.available_at <= d.day::TIMESTAMP GROUP BY 1, 2)
    SELECT d.entity_id, d.day, CASE WHEN coalesce(cover, 0) >= 0.5 THEN round(total, 6) END AS rain, round(coalesce(cover, 0), 6) AS rain_coverage FROM daily d LEFT JOIN sums s ON s.entity_id = d.entity_id AND s.day = d.day""")
def _(v):
    days = v.daily.withColumn("at", F.col("day").cast(NTZ))
    out = joins.window_sum(days, v.rain, ["cell"], "at", "interval_start", "interval_end", "rainfall_mm", "rain", 7 * 86_400, 0.5, "available_at")
    return out.select("entity_id", "day", r("rain").alias("rain"), r("rain_coverage").alias("rain_coverage"))


@query("join_preceding_days", "daily rain", """SELECT d.entity_id, d.day, round(sum(r.rainfall_mm), 6) AS total, count(r.rainfall_mm) AS days_observed FROM daily d LEFT JOIN rain r ON r.cell = d.cell AND r.interval_start >= d.day::TIMESTAMP - INTERVAL 14 DAY AND r.interval_end <= d.day::TIMESTAMP GROUP BY 1, 2""")
def _(v):
    days = v.daily.withColumn("at", F.col("day").cast(NTZ))
    return joins.preceding_days_sum(days, v.rain, ["cell"], "at", "interval_start", "interval_end", "rainfall_mm", 14).select("entity_id", "day", r("total").alias("total"), "days_observed")


@query("join_validity_containment", "fixes vegetation", "SELECT f.source_record_id AS fix, v.source_record_id AS composite FROM fixes f JOIN vegetation v ON v.cell = f.cell AND v.observed_at <= f.observed_at AND f.observed_at < v.observed_until")
def _(v):
    right = v.vegetation.select("cell", F.col("observed_at").alias("from"), "observed_until", F.col("source_record_id").alias("composite"))
    out = joins.validity_join(v.fixes, right, ["cell"], "observed_at", "from", "observed_until", ["composite"], 16 * 86_400, 8, left_columns=["source_record_id"])
    return out.select(F.col("source_record_id").alias("fix"), "composite")


def _registry(v: Views) -> DataFrame:
    """A batch a series, version and status of the cell observations."""
    return v.cell_obs.groupBy("series_id", F.concat_ws("|", "added_in_version", "product_status", "processing_version").alias("batch_key")).agg(F.first("added_in_version").alias("added_in_version"), F.first("superseded_in_version").alias("superseded_in_version"), F.count("*").alias("row_count"))


_REGISTRY = "registry AS (SELECT series_id, concat_ws('|', added_in_version, product_status, processing_version) AS batch_key, any_value(added_in_version) AS added_in_version, any_value(superseded_in_version) AS superseded_in_version, count(*) AS row_count FROM cell_obs GROUP BY 1, 2)"


@query("join_version_expansion", "cell_obs", f"WITH {_REGISTRY} SELECT b.series_id, v.version, sum(b.row_count)::BIGINT AS n FROM registry b, (SELECT unnest([2, 4, 6])::INTEGER AS version) v WHERE added_in_version <= version AND (superseded_in_version IS NULL OR superseded_in_version > version) GROUP BY 1, 2")
def _(v):
    versions = v.cell_obs.select("series_id").distinct().withColumn("version", F.explode(F.array(*map(F.lit, (2, 4, 6)))))
    rows = v.cell_obs.select("series_id", F.concat_ws("|", "added_in_version", "product_status", "processing_version").alias("batch_key"), "value")
    return joins.expand_versions(versions, _registry(v), rows).groupBy("series_id", "version").agg(F.count("*").alias("n"))


@query("join_using_dimension", "", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def _(v):
    return joins.with_dimension(v.table("supplier").withColumnRenamed("s_nationkey", "n_nationkey"), v.table("nation"), "n_nationkey").groupBy("n_name").agg(F.count("*").alias("n"))


_CHANGE = "change AS (SELECT *, mean - lag(mean) OVER (PARTITION BY cell ORDER BY composite) AS change FROM (SELECT cell, composite, avg(index_value) AS mean FROM vegetation GROUP BY 1, 2))"


def _composites(v: Views) -> DataFrame:
    """Days with the composite that they fall into, and the cell's change in it."""
    days = v.features.withColumn("composite", F.floor(F.datediff("day", F.lit(FIRST_DAY)) / 8).cast("int"))
    return days.join(stats.index_change(v.vegetation), ["cell", "composite"], "left").withColumnRenamed("vegetation_index", "index_value")


_DAYS = f"{_CHANGE}, days AS (SELECT f.*, c.composite, c.mean, c.change FROM (SELECT *, ((day - DATE '2024-01-01') // 8)::INTEGER AS comp FROM features) f LEFT JOIN change c ON c.cell = f.cell AND c.composite = f.comp)"


@query("join_merge_left", "features vegetation", f"WITH {_DAYS} SELECT entity_id, day, round(change, 6) AS change FROM days")
def _(v):
    return _composites(v).select("entity_id", "day", r("change").alias("change"))


@query("semi_join_cells", "rain fixes", "SELECT cell, interval_start FROM rain WHERE cell IN (SELECT cell FROM fixes WHERE value > 490)")
def _(v):
    return joins.restrict_to_cells(v.rain, v.fixes.where("value > 490")).select("cell", "interval_start")


@query("semi_join_published", "", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(v):
    entries = v.table("lineitem").where("l_returnflag = 'R'").select(F.to_json(F.struct(F.struct(F.col("l_orderkey").alias("key")).alias("batch"))).alias("manifest"))
    return catalog.published(v.table("orders"), entries, "o_orderkey", "", "manifest", "$.batch.key").select("o_orderkey")


@query("published_manifests", "datasets", """SELECT o_orderkey AS artifact_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN datasets d ON d.dataset_id = 'd' || (l_suppkey // 3) WHERE l_orderkey = o_orderkey AND d.status = 'ready'
    AND d.access_scope = CASE WHEN o_orderkey % 2 = 0 THEN 'public' ELSE 'private' END AND l_linenumber - 1 <= d.version AND (l_returnflag <> 'R' OR l_linenumber + 1 > d.version))""")
def _(v):
    manifests = v.table("orders").select(F.col("o_orderkey").alias("artifact_id"), F.lit("1").alias("version"), F.lit("sha").alias("checksum"), F.when(F.col("o_orderkey") % 2 == 0, "public").otherwise("private").alias("access_scope"))
    named = F.to_json(F.struct(F.col("l_orderkey").alias("artifact_id"), F.lit("1").alias("version"), F.lit("sha").alias("checksum")))
    batches = v.table("lineitem").select(F.concat(F.lit("d"), (F.col("l_suppkey") / 3).cast("long").cast("string")).alias("series_id"), (F.col("l_linenumber") - 1).alias("added_in_version"),
                                         F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") + 1).alias("superseded_in_version"), named.alias("raw_manifest"))
    return catalog.published_manifests(manifests, batches, v.datasets).select("artifact_id")


@query("anti_join_unmatched", "", "SELECT count(*) AS unmatched FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(v):
    return joins.unmatched_count(v.table("customer").withColumnRenamed("c_custkey", "k"), v.table("orders").withColumnRenamed("o_custkey", "k"), ["k"])


@query("anti_join_prefix", "", "WITH ids AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'p' || (s_suppkey // 10) || '--study-' || s_suppkey ELSE 'p' || s_suppkey END AS series_id FROM supplier) SELECT series_id FROM ids a WHERE NOT EXISTS (SELECT 1 FROM ids b WHERE starts_with(b.series_id, a.series_id || '--study-'))")
def _(v):
    key = F.col("s_suppkey")
    ids = v.table("supplier").select(F.when(key % 3 == 0, F.concat(F.lit("p"), F.floor(key / 10).cast("string"), F.lit("--study-"), key.cast("string"))).otherwise(F.concat(F.lit("p"), key.cast("string"))).alias("series_id"))
    return joins.hide_split_series(ids, ids)


@query("cross_lattice", "", "SELECT n_nationkey, i AS lattice_row, j AS lattice_col FROM nation, (SELECT unnest(range(4))::INTEGER AS i), (SELECT unnest(range(5))::INTEGER AS j)")
def _(v):
    return relational.lattice(v.table("nation").select("n_nationkey"), 4, 5, 1).drop("month")


# --- aggregates --------------------------------------------------------------------------------------------------


@query("op_aggregate", "fixes", "SELECT cell, event_type, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(value) AS n FROM fixes GROUP BY 1, 2")
def _(v):
    out = relational.aggregate(v.fixes, ["cell", "event_type"], [("value", "sum", "total"), ("value", "mean", "mean"), ("value", "min", "low"), ("value", "max", "high"), ("value", "count", "n")])
    return out.withColumns({"total": r("total"), "mean": r("mean")})


@query("op_time_bucket", "fixes", "SELECT date_trunc('month', observed_at)::TIMESTAMP AS month, date_trunc('day', observed_at)::TIMESTAMP AS day, count(*) AS n FROM fixes GROUP BY 1, 2")
def _(v):
    return relational.time_bucket(relational.time_bucket(v.fixes, "observed_at", "month", "month"), "observed_at", "day", "day").groupBy("month", "day").agg(F.count("*").alias("n"))


@query("agg_fixes_per_entity", "fixes", "SELECT entity_id, count(*) AS n, min(observed_at) AS first_at, max(observed_at) AS last_at FROM fixes WHERE longitude BETWEEN 36.90e0 AND 37.00e0 AND latitude BETWEEN -1.55e0 AND -1.45e0 GROUP BY 1")
def _(v):
    return relational.in_bbox(v.fixes, "longitude", "latitude", REGION).groupBy("entity_id").agg(F.count("*").alias("n"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))


@query("agg_index_summary", "cell_obs", "SELECT variable, count(*) AS n, count(value) AS present, round(avg(value), 3) AS mean FROM cell_obs WHERE year(time_start) = 1997 GROUP BY 1")
def _(v):
    return stats.index_summary(v.cell_obs, "lineitem", *(F.lit(x).cast("date") for x in ("1997-01-01", "1997-12-31")))


@query("agg_distinct_count", "daily", "SELECT count(DISTINCT entity_id) AS animals, count(DISTINCT day) AS days, count(DISTINCT cell) AS cells FROM daily")
def _(v):
    return v.daily.agg(F.count_distinct("entity_id").alias("animals"), F.count_distinct("day").alias("days"), F.count_distinct("cell").alias("cells"))


_MONTHLY = "SELECT strftime(day, '%Y-%m') AS month, count(*) AS records, count(DISTINCT entity_id) AS animals, sum(fix_count)::BIGINT AS fixes, count(displacement_km) AS displacements, round(sum(displacement_km), 6) AS total_km, round(avg(displacement_km), 6) AS mean_km FROM daily GROUP BY 1"


@query("agg_monthly_movement", "daily", _MONTHLY)
def _(v):
    return movement.monthly_movement(v.daily).withColumns({"total_km": r("total_km"), "mean_km": r("mean_km")})


@query("agg_monthly_cells", "cell_obs", "SELECT strftime(time_start, '%Y-%m') AS month, variable, count(*) AS records, count(DISTINCT cell) AS cells, round(avg(value), 6) AS mean, count(value) AS values FROM cell_obs GROUP BY 1, 2")
def _(v):
    return stats.monthly_cells(v.cell_obs).withColumn("mean", r("mean"))


@query("agg_cumulative_through", "cell_obs", "SELECT month, sum(records) OVER (ORDER BY month)::BIGINT AS through FROM (SELECT strftime(time_start, '%Y-%m') AS month, count(*) AS records FROM cell_obs GROUP BY 1) WHERE month <= '1996-06'")
def _(v):
    months = v.cell_obs.groupBy(F.date_format("time_start", "yyyy-MM").alias("month")).agg(F.count("*").alias("records"))
    return relational.through(months, "month", "1996-06", "records", "through").select("month", "through")


@query("agg_series_summary", "cell_obs", "SELECT series_id, min(time_start) AS first_start, max(time_start) AS last_start, count(*) AS row_count, array_to_string(list_sort(list(DISTINCT variable)), ',') AS variables, count(DISTINCT cell) AS cells FROM cell_obs GROUP BY 1")
def _(v):
    return series.series_summary(v.cell_obs, ["series_id"]).withColumn("variables", F.concat_ws(",", "variables"))


@query("agg_regional_median", "vegetation", "SELECT composite, round(median(index_value), 6) AS median, count(index_value) AS n FROM vegetation GROUP BY 1")
def _(v):
    return stats.regional_median(v.vegetation).withColumn("median", r("median"))


@query("agg_cell_mean_per_composite", "vegetation", "SELECT cell, composite, round(avg(index_value), 6) AS mean FROM vegetation GROUP BY 1, 2")
def _(v):
    return stats.index_change(v.vegetation).select("cell", "composite", r("mean").alias("mean"))


_NDVI = "long AS (SELECT cell, 'nd' AS variable, CASE WHEN scl NOT IN (3) AND nir + red <> 0 THEN (nir - red) / (nir + red) END AS value FROM pixels)"


def _long_pixels(v: Views) -> DataFrame:
    value = F.when(~F.col("scl").isin(3), indices.normalized_difference(F.col("nir"), F.col("red")))
    return v.pixels.select("cell", F.lit("nd").alias("variable"), value.alias("value"))


@query("agg_zonal_partial_final", "pixels", f"WITH {_NDVI} SELECT cell, variable, round(sum(value), 6) AS total, round(sum(value * value), 6) AS squares, count(value) AS pixel_count FROM long WHERE value IS NOT NULL GROUP BY 1, 2")
def _(v):
    return stats.zonal_sums(_long_pixels(v)).withColumns({"total": r("total"), "squares": r("squares")})


@query("agg_array_json", "", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey) AS orders FROM orders GROUP BY 1")
def _(v):
    orders = v.table("orders").withColumn("age", -F.unix_date(F.to_date("o_orderdate")))
    return relational.collected(orders, ["o_custkey"], ["o_orderkey"], ["age", "o_orderkey"], "orders").withColumn("orders", F.concat_ws(",", "orders"))


@query("agg_having", "", "SELECT l_orderkey, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(v):
    return checks.duplicates(v.table("lineitem"), ["l_orderkey"])


@query("agg_null_counts", "daily", "SELECT 'displacement_km' AS column, count(*) FILTER (WHERE displacement_km IS NULL) AS null_count, count(*) AS row_count FROM daily UNION ALL SELECT 'cell', count(*) FILTER (WHERE cell IS NULL), count(*) FROM daily")
def _(v):
    return checks.column_quality(v.daily.select("displacement_km", "cell"))


@query("agg_weighted_mean", "", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def _(v):
    return v.table("lineitem").groupBy("l_returnflag").agg(r(stats.weighted_mean(F.col("l_discount"), F.col("l_quantity"))).alias("mean"))


@query("agg_filtered_sum", "", "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 6) AS total FROM lineitem GROUP BY 1")
def _(v):
    return v.table("lineitem").groupBy("l_returnflag").agg(r(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity")))).alias("total"))


@query("agg_coverage_union", "datasets", """SELECT family, access_scope, CASE WHEN count(west) = count(*) THEN round(min(west), 6) END AS west, CASE WHEN count(north) = count(*) THEN round(max(north), 6) END AS north, min("start") AS "start", max("end") AS "end" FROM datasets GROUP BY 1, 2""")
def _(v):
    return catalog.coverage_union(v.datasets, ["family", "access_scope"]).select("family", "access_scope", r("west").alias("west"), r("north").alias("north"), "start", "end")


# --- grid and geometry -------------------------------------------------------------------------------------------

_K0 = f"{geo._K0!r}e0"
_CELLS = f"""placed AS (SELECT *, floor((7314540.830638552e0 - {geo.SEMI_MAJOR / (2 * geo._K0)!r}e0 * ((1 - {geo._E2!r}e0) * (sin(radians(latitude)) / (1 - {geo._E2!r}e0 * sin(radians(latitude)) * sin(radians(latitude)))
    - ln((1 - {geo._E!r}e0 * sin(radians(latitude))) / (1 + {geo._E!r}e0 * sin(radians(latitude)))) / (2 * {geo._E!r}e0)))) / 1000.8950233495556e0)::BIGINT AS grow,
    floor((radians(longitude) * {geo.SEMI_MAJOR * geo._K0!r}e0 + 17367530.445161488e0) / 1000.8950233495556e0)::BIGINT AS gcol FROM fixes)"""


@query("cell_id_for_point", "fixes", f"WITH {_CELLS} SELECT source_record_id, 'E1K-r' || grow || '-c' || gcol AS cell_id FROM placed")
def _(v):
    return v.fixes.select("source_record_id", geo.cell_id(F.col("longitude"), F.col("latitude")).alias("cell_id"))


@query("cell_flat_index", "fixes", f"WITH {_CELLS} SELECT source_record_id, grow * 34704 + gcol AS flat, grow AS row, gcol AS col FROM placed")
def _(v):
    row, col = geo.cell_row_col(F.col("longitude"), F.col("latitude"))
    flat = v.fixes.select("source_record_id", geo.flat_index(row, col).alias("flat"))
    back = geo.from_flat_index(F.col("flat"))
    return flat.select("source_record_id", "flat", back[0].alias("row"), back[1].alias("col"))


@query("parse_cell_id", "fixes", f"WITH {_CELLS} SELECT DISTINCT grow AS row, gcol AS col FROM placed")
def _(v):
    row, col = geo.parse_cell_id(geo.cell_id(F.col("longitude"), F.col("latitude")))
    return v.fixes.select(row.alias("row"), col.alias("col")).distinct()


@query("cell_centre", "fixes", f"WITH {_CELLS} SELECT source_record_id, grow, gcol FROM placed")
def _(v):
    lon, lat = geo.cell_centre(*geo.cell_row_col(F.col("longitude"), F.col("latitude")))
    row, col = geo.cell_row_col(lon, lat)  # a centre lies in its own cell
    return v.fixes.select("source_record_id", row.alias("grow"), col.alias("gcol"))


@query("cells_in_bbox", "fixes", f"""WITH {_CELLS}, ends AS (SELECT 36.90e0 AS longitude, -1.45e0 AS latitude UNION ALL SELECT 37.00e0, -1.55e0), {_CELLS.replace("placed AS", "corners AS").replace("FROM fixes", "FROM ends")},
    box AS (SELECT row, unnest(range(lo, hi + 1)) AS col FROM (SELECT unnest(range(min(grow), max(grow) + 1)) AS row, min(gcol) AS lo, max(gcol) AS hi FROM corners))
    SELECT row, col, 'E1K-r' || row || '-c' || col AS cell_id, count(source_record_id) AS fixes FROM box LEFT JOIN placed ON row = grow AND col = gcol GROUP BY 1, 2""")
def _(v):
    used = v.fixes.groupBy(geo.cell_id(F.col("longitude"), F.col("latitude")).alias("cell_id")).agg(F.count("*").alias("fixes"))
    return geo.cells_in_bbox(v.spark, *REGION).join(used, "cell_id", "left").select("row", "col", "cell_id", F.coalesce("fixes", F.lit(0)).alias("fixes"))


@query("cell_polygon", "fixes", "SELECT source_record_id, true AS inside, false AS below, false AS beside FROM fixes")
def _(v):
    row, col = geo.cell_row_col(F.col("longitude"), F.col("latitude"))
    holds = lambda r, c: geo.point_in_polygon(F.col("longitude"), F.col("latitude"), F.array(geo.cell_ring(r, c)))
    return v.fixes.select("source_record_id", holds(row, col).alias("inside"), holds(row + 1, col).alias("below"), holds(row, col - 1).alias("beside"))


_E4, _E6 = geo._E2**2, geo._E2**3
#: A coarse source at an offset that is no multiple of a cell: west, north, width and height of a pixel, rows, columns.
COARSE = (36.8437, -1.4171, 0.0131, 0.0117, 14, 15)
_CENTRES = f"""centres AS (SELECT DISTINCT grow, gcol, asin((7314540.830638552e0 - (grow + 0.5e0) * 1000.8950233495556e0) * {2 * geo._K0 / (geo.SEMI_MAJOR * geo._QP)!r}::DOUBLE) AS beta, degrees(((gcol + 0.5e0) * 1000.8950233495556e0 - 17367530.445161488e0)
    / {geo.SEMI_MAJOR * geo._K0!r}::DOUBLE) AS clon, degrees(beta + sin(beta * 2) * {geo._E2 / 3 + 31 * _E4 / 180 + 517 * _E6 / 5040!r}::DOUBLE + sin(beta * 4) * {23 * _E4 / 360 + 251 * _E6 / 3780!r}::DOUBLE + sin(beta * 6) * {761 * _E6 / 45360!r}::DOUBLE) AS clat FROM placed)"""
_COARSE = f"""coarse AS (SELECT floor((-1.4171e0 - latitude) / 0.0117e0)::BIGINT AS prow, floor((longitude - 36.8437e0) / 0.0131e0)::BIGINT AS pcol, count(*) AS n FROM fixes WHERE event_type = 'view' GROUP BY 1, 2)"""


@query("sample_cell_centres", "fixes", f"""WITH {_CELLS}, {_CENTRES}, {_COARSE}, under AS (SELECT *, floor((-1.4171e0 - clat) / 0.0117e0)::BIGINT AS prow, floor((clon - 36.8437e0) / 0.0131e0)::BIGINT AS pcol FROM centres)
    SELECT grow AS row, gcol AS col, prow AS pixel_row, pcol AS pixel_col, n FROM under JOIN coarse USING (prow, pcol) WHERE prow BETWEEN 0 AND 13 AND pcol BETWEEN 0 AND 14""")
def _(v):
    west, north, wide, high, *_ = COARSE
    row, col = geo.cell_row_col(F.col("longitude"), F.col("latitude"))
    pixel = [F.floor((F.lit(north) - F.col("latitude")) / high).alias("pixel_row"), F.floor((F.col("longitude") - west) / wide).alias("pixel_col")]
    source = v.fixes.where("event_type = 'view'").groupBy(*pixel).agg(F.count("*").alias("n"))
    return stats.sample_cell_centres(v.fixes.select(row.alias("row"), col.alias("col")).distinct(), source, COARSE, "n")


@query("footprint_from_cells", "cell_obs", "SELECT series_id, count(DISTINCT cell) AS cells FROM cell_obs GROUP BY 1")
def _(v):
    return catalog.footprint(v.cell_obs, ["series_id"]).groupBy("series_id").agg(F.count("*").alias("cells"))


_SHARE = "(greatest(least(east, 37.00e0) - greatest(west, 36.90e0), 0) * greatest(least(north, -1.45e0) - greatest(south, -1.55e0), 0) / ((37.00e0 - 36.90e0) * (-1.45e0 + 1.55e0)))"


@query("area_share", "boundaries", f"SELECT name, round({_SHARE}, 6) AS share FROM boundaries")
def _(v):
    return v.boundaries.select("name", r(catalog.spatial_share(REGION)).alias("share"))


@query("grows_materially", "cell_obs", """WITH old AS (SELECT DISTINCT series_id, cell FROM cell_obs WHERE added_in_version <= 2), new AS (SELECT DISTINCT series_id, cell FROM cell_obs WHERE added_in_version <= 3)
    SELECT o.series_id, count(*) AS previous_cells, (SELECT count(*) FROM new n WHERE n.series_id = o.series_id AND NOT EXISTS (SELECT 1 FROM old p WHERE p.series_id = n.series_id AND p.cell = n.cell)) AS new_cells,
    (SELECT count(*) FROM new n WHERE n.series_id = o.series_id AND NOT EXISTS (SELECT 1 FROM old p WHERE p.series_id = n.series_id AND p.cell = n.cell)) > count(*) * 0.10 AS grows FROM old o GROUP BY 1""")
def _(v):
    of = lambda n: catalog.footprint(v.cell_obs.where(F.col("added_in_version") <= n), ["series_id"])
    return catalog.footprint_growth(of(2), of(3), ["series_id"])


@query("bbox_overlap_antimeridian", "boundaries", "SELECT a.name, count(*) AS n FROM boundaries a JOIN boundaries b ON a.west <= b.east AND b.west <= a.east AND a.south <= b.north AND b.south <= a.north GROUP BY 1")
def _(v):
    box = lambda p: tuple(F.col(f"{p}.{c}") for c in ("west", "south", "east", "north"))
    return v.boundaries.alias("a").join(v.boundaries.alias("b"), geo.bbox_overlap(box("a"), box("b"))).groupBy(F.col("a.name").alias("name")).agg(F.count("*").alias("n"))


@query("bbox_contains", "boundaries", "SELECT name, (west <= 36.92e0 AND south <= -1.53e0 AND east >= 36.93e0 AND north >= -1.52e0) AS inside FROM boundaries")
def _(v):
    return v.boundaries.select("name", geo.bbox_contains(tuple(map(F.col, ("west", "south", "east", "north"))), tuple(map(F.lit, (36.92, -1.53, 36.93, -1.52)))).alias("inside"))


@query("point_in_polygon", "fixes boundaries", "SELECT name, count(*) FILTER (WHERE longitude BETWEEN west AND east AND latitude BETWEEN south AND north) AS n FROM fixes, boundaries GROUP BY 1")
def _(v):
    hits = joins.polygon_hits(v.fixes.select("longitude", "latitude"), v.boundaries.select("name", "rings"), "longitude", "latitude", "rings")
    counts = hits.groupBy("name").agg(F.count("*").alias("n"))
    return v.boundaries.select("name").join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


_HAVERSINE = "12742.0176e0 * asin(sqrt(least(1.0e0, pow(sin(radians(latitude - plat) / 2), 2) + cos(radians(plat)) * cos(radians(latitude)) * pow(sin(radians(longitude - plon) / 2), 2))))"


@query("geodesic_km", "measured", f"""WITH far AS ({spheroid_sql("(SELECT * EXCLUDE (km), km AS step_km FROM measured)", "longitude", "latitude", "longitude * -4", "latitude + day(day) * 2.5e0")})
    SELECT entity_id, day, round(step_km, 6) AS step_km, round(km, 6) AS far_km FROM far""")
def _(v):
    days = movement.with_previous(v.daily)
    step = geo.geodesic_km(*(F.col(c) for c in ("previous_longitude", "previous_latitude", "longitude", "latitude")))
    far = geo.geodesic_km(F.col("longitude"), F.col("latitude"), F.col("longitude") * -4, F.col("latitude") + F.day("day") * 2.5)
    return days.select("entity_id", "day", r(step).alias("step_km"), r(far).alias("far_km"))


@query("haversine_km", "steps", f"SELECT entity_id, day, round({_HAVERSINE}, 6) AS km FROM steps WHERE plon IS NOT NULL")
def _(v):
    days = movement.with_previous(v.daily).where("previous_longitude is not null")
    return days.select("entity_id", "day", r(geo.haversine_km(*(F.col(c) for c in ("previous_longitude", "previous_latitude", "longitude", "latitude")))).alias("km"))


_SEGMENT = "sqrt(pow((longitude - plon) * cos(radians((plat + latitude) / 2)) * 111.32e0, 2) + pow((latitude - plat) * 110.574e0, 2))"


@query("segment_km", "steps", f"SELECT entity_id, day, round({_SEGMENT}, 6) AS km FROM steps WHERE plon IS NOT NULL")
def _(v):
    days = movement.with_previous(v.daily).where("previous_longitude is not null")
    return days.select("entity_id", "day", r(geo.segment_km(*(F.col(c) for c in ("previous_longitude", "previous_latitude", "longitude", "latitude")))).alias("km"))


@query("segment_inside_fraction", "boundaries", "SELECT name, CASE WHEN abs((north + south) / 2 - 0) < 9 THEN 0.5e0 END AS share FROM boundaries")
def _(v):
    middle, half = (F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2
    return v.boundaries.select("name", r(geo.inside_fraction(half, middle, F.col("east") + 0.025, middle, F.col("rings"))).alias("share"))


@query("pixel_centre", "pixels", "SELECT x, round(10.0e0 + (x + 0.5e0) * 30, 6) AS px, round(500.0e0 - (y + 0.5e0) * 30, 6) AS py, y FROM pixels")
def _(v):
    px, py = geo.pixel_xy(F.lit(10.0), F.lit(500.0), F.lit(30.0), F.col("y"), F.col("x"))
    return v.pixels.select("x", "y", r(px).alias("px"), r(py).alias("py"))


@query("pixel_area", "boundaries", "SELECT name, round(abs((east - west) * (south - north)), 6) AS area FROM boundaries")
def _(v):
    return v.boundaries.select("name", r(geo.pixel_area(F.col("east") - F.col("west"), F.lit(0.0), F.lit(0.0), F.col("south") - F.col("north"))).alias("area"))


@query("lonlat_bounds", "fixes", """WITH bad AS (SELECT cell, longitude, CASE WHEN cell = 'c3' AND event_type = 'error' THEN 95e0 WHEN cell = 'c4' AND event_type = 'click' THEN NULL ELSE latitude END AS latitude FROM fixes)
    SELECT cell, CASE WHEN ok THEN round(w, 6) END AS west, CASE WHEN ok THEN round(s, 6) END AS south, CASE WHEN ok THEN round(e, 6) END AS east, CASE WHEN ok THEN round(n, 6) END AS north
    FROM (SELECT cell, bool_and(coalesce(abs(latitude) <= 90, false)) AS ok, min(longitude) AS w, min(latitude) AS s, max(longitude) AS e, max(latitude) AS n FROM bad GROUP BY 1)""")
def _(v):
    bad = F.when((F.col("cell") == "c3") & (F.col("event_type") == "error"), 95.0).when((F.col("cell") == "c4") & (F.col("event_type") == "click"), None).otherwise(F.col("latitude"))
    return geo.lonlat_bounds(v.fixes.withColumn("latitude", bad), "longitude", "latitude", ["cell"]).select("cell", *(r(c).alias(c) for c in ("west", "south", "east", "north")))


# --- pixels ------------------------------------------------------------------------------------------------------


@query("normalized_difference", "pixels", "SELECT x, y, round((nir - red) / nullif(nir + red, 0), 6) AS nd FROM pixels")
def _(v):
    return v.pixels.select("x", "y", r(indices.normalized_difference(F.col("nir"), F.col("red"))).alias("nd"))


@query("s2_reflectance", "pixels", "SELECT x, y, CASE WHEN red <> 0 THEN round((red - 1000) / 10000.0e0, 6) END AS value FROM pixels")
def _(v):
    return v.pixels.select("x", "y", r(indices.s2_reflectance(F.col("red"), indices.s2_offset(F.lit("05.09")))).alias("value"))


@query("s2_offset_for_baseline", "pixels", "SELECT DISTINCT x, CASE WHEN x >= 4 THEN -1000 ELSE 0 END AS offset FROM pixels")
def _(v):
    return v.pixels.select("x", indices.s2_offset(F.concat(F.lit("0"), F.col("x").cast("string"), F.lit(".00"))).alias("offset")).distinct()


@query("s2_clear_mask", "pixels", "SELECT scl NOT IN (0, 1, 3, 8, 9, 10, 11) AS clear, count(*) AS n FROM pixels GROUP BY 1")
def _(v):
    return v.pixels.groupBy(indices.s2_clear(F.col("scl")).alias("clear")).agg(F.count("*").alias("n"))


@query("s2_indices", "pixels", """WITH bands AS (SELECT x, y, scl NOT IN (0, 1, 3, 8, 9, 10, 11) AS ok, (nir - 1000) / 10000.0e0 AS n, (red - 1000) / 10000.0e0 AS r, (red * 2 - 1000) / 10000.0e0 AS g, (nir + red - 1000) / 10000.0e0 AS s FROM pixels)
    SELECT x, y, 'ndvi' AS variable, CASE WHEN ok THEN round((n - r) / nullif(n + r, 0), 6) END AS value FROM bands
    UNION ALL SELECT x, y, 'mndwi', CASE WHEN ok THEN round((g - s) / nullif(g + s, 0), 6) END FROM bands
    UNION ALL SELECT x, y, 'ndmi', CASE WHEN ok THEN round((n - s) / nullif(n + s, 0), 6) END FROM bands""")
def _(v):
    bands = v.pixels.select("x", "y", "scl", F.col("nir").alias("b_nir"), F.col("red").alias("b_red"), (F.col("red") * 2).alias("b_green"), (F.col("nir") + F.col("red")).alias("b_swir"))
    return indices.s2_indices(bands, F.lit(-1000)).withColumn("value", r("value"))


@query("modis_vi", "pixels", "SELECT x, y, CASE WHEN scl IN (0, 1) AND nir <> -3000 THEN round(nir * 0.0001e0, 6) END AS value FROM pixels")
def _(v):
    return v.pixels.select("x", "y", r(indices.modis_vi(F.col("nir"), F.col("scl"))).alias("value"))


@query("chirps_rain", "", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS rain FROM customer")
def _(v):
    return v.table("customer").select("c_custkey", indices.chirps_rain(F.col("c_acctbal")).alias("rain"))


_ZONAL = f"""{_NDVI}, zones AS (SELECT cell, variable, sum(value) / count(value) AS mean, sqrt(greatest(sum(value * value) / count(value) - pow(sum(value) / count(value), 2), 0)) AS sd, least(count(value) / 150.0e0, 1) AS fraction, count(value) AS pixel_count FROM long WHERE value IS NOT NULL GROUP BY 1, 2)"""


@query("zonal_stats", "pixels", f"WITH {_ZONAL} SELECT cell, variable, CASE WHEN fraction >= 0.5 THEN round(mean, 6) END AS value, CASE WHEN fraction >= 0.5 THEN round(sd, 5) END AS std, round(fraction, 6) AS valid_fraction, pixel_count FROM zones")
def _(v):
    return stats.zonal_stats(_long_pixels(v), 150).withColumns({"value": r("value"), "std": F.round("std", 5), "valid_fraction": r("valid_fraction")})


@query("quality_flags_cell", "pixels cell_obs", f"WITH {_ZONAL} SELECT CASE WHEN fraction < 0.5 THEN 'low_valid_fraction' WHEN cell % 2 = 0 THEN 'preliminary' ELSE 'ok' END AS flag, count(*) AS n FROM zones GROUP BY 1")
def _(v):
    status = F.when(F.col("cell") % 2 == 0, "preliminary").otherwise("final")
    return stats.zonal_stats(_long_pixels(v), 150).groupBy(stats.cell_flag(F.col("value"), status).alias("flag")).agg(F.count("*").alias("n"))


@query("quality_flags_fix", "", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'marked_outlier' ELSE 'ok' END AS flag FROM events")
def _(v):
    return v.table("events").select("event_id", stats.fix_flag(F.when(F.col("event_type") == "error", "FALSE").otherwise("True")).alias("flag"))


@query("to_cell_observations", "pixels", f"""WITH {_ZONAL}, items AS (SELECT 'item' || n_nationkey AS item, DATE '2024-01-01' + n_nationkey::INTEGER AS time_start, 'v' || (n_nationkey % 3) AS processing_version, CASE WHEN n_nationkey % 2 = 0 THEN 'preliminary' ELSE 'final' END AS status, 'nd--' || n_regionkey AS dataset_id FROM nation)
    SELECT dataset_id, cell, variable, CASE WHEN fraction >= 0.5 THEN round(mean, 6) END AS value, pixel_count, '1' AS unit, item AS source_item_id, time_start, time_start + 1 AS time_end, 'day' AS time_precision, time_start + 3 AS available_at, 'pixels' AS source_id, processing_version,
        status AS product_status, 'm2' AS mapping_version, 'mean' AS stat, 30e0 AS source_resolution_m, CASE WHEN fraction < 0.5 THEN 'low_valid_fraction' WHEN status = 'preliminary' THEN 'preliminary' ELSE 'ok' END AS quality_flag
    FROM zones JOIN items ON item = 'item' || (cell % 25)""")
def _(v):
    key = F.col("n_nationkey")
    start = F.date_add(F.lit(FIRST_DAY).cast("date"), key.cast("int"))
    items = v.table("nation").select(
        F.concat(F.lit("item"), key.cast("string")).alias("source_item_id"), start.alias("time_start"), F.date_add(start, 1).alias("time_end"), F.lit("day").alias("time_precision"), F.date_add(start, 3).alias("available_at"), F.lit("pixels").alias("source_id"),
        F.concat(F.lit("v"), (key % 3).cast("string")).alias("processing_version"), F.when(key % 2 == 0, "preliminary").otherwise("final").alias("product_status"), F.concat(F.lit("nd--"), F.col("n_regionkey").cast("string")).alias("series_id"))
    zones = stats.zonal_stats(_long_pixels(v), 150).withColumn("source_item_id", F.concat(F.lit("item"), (F.col("cell") % 25).cast("string")))
    units = v.spark.createDataFrame([("nd", "1"), ("rain", "mm")], "variable string, unit string")
    return stats.to_cell_observations(zones, items, units, "m2", "mean", 30).drop("std", "valid_fraction").withColumn("value", r("value"))


@query("rainfall_from_cells", "", "SELECT c_custkey AS cell, c_acctbal AS value, 1.0e0 AS valid_fraction, 'sum' AS stat FROM customer WHERE c_acctbal >= 0")
def _(v):
    rain = v.table("customer").select(F.col("c_custkey").alias("cell"), indices.chirps_rain(F.col("c_acctbal")).alias("value")).where("value is not null")
    return rain.withColumns({"valid_fraction": F.lit(1.0), "stat": F.lit("sum")})


# --- windows, order, sets ----------------------------------------------------------------------------------------

_ORDER = "ORDER BY product_status <> 'final', processing_version DESC, mapping_version DESC, valid_fraction DESC, available_at DESC, source_item_id DESC"


@query("win_current_cell", "cell_obs", f"SELECT cell, variable, source_item_id, value FROM (SELECT *, row_number() OVER (PARTITION BY cell, variable, source_id, time_start::DATE {_ORDER}) AS place FROM cell_obs) WHERE place = 1")
def _(v):
    return series.current_cells(v.cell_obs).select("cell", "variable", "source_item_id", "value")


@query("win_current_fix", "fixes", "SELECT entity_id, source_record_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, observed_at, sensor_type ORDER BY source_record_id DESC) AS place FROM fixes) WHERE place = 1")
def _(v):
    return series.current_fixes(v.fixes.withColumn("added_in_version", F.lit(1))).select("entity_id", "source_record_id")


@query("win_version_current", "cell_obs", f"SELECT series_id, cell, variable, source_item_id FROM (SELECT *, row_number() OVER (PARTITION BY series_id, cell, variable, source_id, time_start::DATE {_ORDER}) AS place FROM cell_obs) WHERE place = 1")
def _(v):
    return series.current_cells(v.cell_obs, ["series_id"]).select("series_id", "cell", "variable", "source_item_id")


@query("win_last_fix_of_day", "last_fixes", "SELECT entity_id, day, source_record_id, fix_count FROM last_fixes WHERE place = 1")
def _(v):
    return movement.last_fix_of_day(v.fixes.where("quality_flag = 'ok'")).select("entity_id", "day", "source_record_id", "fix_count")


@query("win_previous_day", "steps", "SELECT entity_id, day, pday AS previous_day, round(plon, 6) AS previous_longitude FROM steps")
def _(v):
    return movement.with_previous(v.daily).select("entity_id", "day", "previous_day", r("previous_longitude").alias("previous_longitude"))


@query("win_first_fix_of_day", "fixes", "SELECT DISTINCT ON (entity_id, observed_at::DATE) entity_id, observed_at::DATE AS day, source_record_id FROM fixes ORDER BY entity_id, observed_at::DATE, observed_at, source_record_id")
def _(v):
    return movement.first_fix_of_day(v.fixes).select("entity_id", "day", "source_record_id")


@query("win_latest_version", "datasets", "SELECT dataset_id, max(version) AS version, arg_max(description, version) AS description FROM datasets GROUP BY 1")
def _(v):
    return catalog.latest_datasets(v.datasets).select("dataset_id", "version", "description")


@query("win_prev_end_overlap", "vegetation", "SELECT cell, source_record_id FROM (SELECT *, max(observed_until) OVER (PARTITION BY cell ORDER BY observed_at, observed_until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM vegetation) WHERE observed_at < pe")
def _(v):
    return checks.overlapping(v.vegetation, ["cell"], "observed_at", "observed_until").select("cell", "source_record_id")


@query("win_lead_next", "daily", "SELECT entity_id, day, lead(day) OVER (PARTITION BY entity_id ORDER BY day) AS next_day, lead(cell) OVER (PARTITION BY entity_id ORDER BY day) AS next_cell FROM daily")
def _(v):
    return movement.with_next(v.daily, "entity_id", "day", ["day", "cell"]).select("entity_id", "day", "next_day", "next_cell")


@query("win_diff", "vegetation", f"WITH {_CHANGE} SELECT cell, composite, round(change, 6) AS change FROM change")
def _(v):
    return stats.index_change(v.vegetation).select("cell", "composite", r("change").alias("change"))


@query("win_rolling_7d_mean", "daily", "SELECT entity_id, day, round(avg(displacement_km) OVER (PARTITION BY entity_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 6) AS rolling FROM daily")
def _(v):
    return forecast.rolling_mean(v.daily, "displacement_km", 7, "rolling").select("entity_id", "day", r("rolling").alias("rolling"))


@query("win_rank_average", "", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderstatus, o_orderdate) - 1) / 2.0e0 AS place FROM orders")
def _(v):
    return relational.average_rank(v.table("orders"), "o_orderdate", "place", ["o_orderstatus"]).select("o_orderkey", "place")


@query("win_cumulative", "fixes", "SELECT day, sum(n) OVER (ORDER BY day)::BIGINT AS total FROM (SELECT observed_at::DATE AS day, count(*) AS n FROM fixes GROUP BY 1)")
def _(v):
    days = v.fixes.groupBy(F.to_date("observed_at").alias("day")).agg(F.count("*").alias("n"))
    return relational.running_total(days, "day", "n", "total").select("day", "total")


@query("sort_output_keys", "daily", "SELECT entity_id, day, row_number() OVER (PARTITION BY entity_id ORDER BY day) AS place FROM daily")
def _(v):
    from pyspark.sql import Window

    return relational.sorted_output(v.daily.select("entity_id", "day", F.row_number().over(Window.partitionBy("entity_id").orderBy("day")).alias("place")), ["entity_id", "day"])


@query("limit_features", "fixes", "SELECT source_record_id, (SELECT count(*) FROM fixes) AS total_records, true AS truncated FROM fixes ORDER BY observed_at, source_record_id LIMIT 500")
def _(v):
    return relational.limited(v.fixes, ["observed_at", "source_record_id"], 500).select("source_record_id", "total_records", "truncated")


@query("row_limit_guard", "daily", "SELECT count(*) AS n, 'ok' AS enough, 'ROW_LIMIT' AS too_many FROM daily")
def _(v):
    n = v.daily.count()
    codes = [checks.code_of(lambda limit=limit: relational.guard_rows(v.daily, limit)) for limit in (n, n - 1)]
    return relational.guard_rows(v.daily, n).agg(F.count("*").alias("n"), *(F.lit(c).alias(name) for c, name in zip(codes, ("enough", "too_many"), strict=True)))


_REVISITS = "SELECT cell, sum(n)::BIGINT AS observations, count(*) AS animals, count(*) FILTER (WHERE n >= 2) AS repeat_animals FROM (SELECT cell, entity_id, count(*) AS n FROM daily GROUP BY 1, 2) GROUP BY 1"


@query("topk_revisits", "daily", f"SELECT * FROM ({_REVISITS}) ORDER BY observations DESC, cell LIMIT 5")
def _(v):
    return movement.revisits(v.daily).orderBy(F.desc("observations"), "cell").limit(5)


@query("last_point_per_animal", "fixes", "SELECT entity_id, arg_max(round(longitude, 6), (observed_at, source_record_id)) AS longitude FROM fixes GROUP BY 1")
def _(v):
    return movement.last_points(v.fixes).select("entity_id", r("longitude").alias("longitude"))


@query("page_truncation", "datasets", "SELECT dataset_id, version, (SELECT count(*) FROM datasets) AS total_records, (SELECT count(*) FROM datasets) > 10 AS truncated FROM datasets ORDER BY dataset_id, version LIMIT 10")
def _(v):
    return relational.limited(v.datasets, ["dataset_id", "version"], 10).select("dataset_id", "version", "total_records", "truncated")


@query("union_all_endpoints", "rain", "SELECT cell, interval_start AS at FROM rain UNION ALL SELECT cell, interval_end FROM rain")
def _(v):
    return v.rain.select("cell", F.col("interval_start").alias("at")).unionByName(v.rain.select("cell", F.col("interval_end").alias("at")))


@query("union_partials", "pixels", f"WITH {_NDVI} SELECT cell, round(sum(value), 6) AS total, count(value) AS pixel_count FROM long WHERE value IS NOT NULL GROUP BY 1")
def _(v):
    px = _long_pixels(v)
    parts = stats.zonal_sums(px.where("cell % 2 = 0")).unionByName(stats.zonal_sums(px.where("cell % 2 = 1")))
    return parts.groupBy("cell").agg(r(F.sum("total")).alias("total"), F.sum("pixel_count").alias("pixel_count"))


@query("union_candidates_dedup", "datasets", "SELECT dataset_id, version, CASE WHEN a AND b THEN 'family,status' WHEN a THEN 'family' ELSE 'status' END AS methods FROM (SELECT dataset_id, version, family = 'cells' AS a, status = 'ready' AS b FROM datasets) WHERE a OR b")
def _(v):
    return catalog.union_candidates(("family", v.datasets.where("family = 'cells'")), ("status", v.datasets.where("status = 'ready'"))).withColumn("methods", F.concat_ws(",", "methods"))


@query("distinct_fixes", "fixes", "SELECT count(DISTINCT (entity_id, observed_at)) AS n FROM fixes")
def _(v):
    return v.fixes.dropDuplicates(["entity_id", "observed_at"]).agg(F.count("*").alias("n"))


_GAPS = "SELECT entity_id, unnest(range(a, b, INTERVAL 1 DAY))::DATE AS day FROM (SELECT entity_id, min(day) AS a, max(day) AS b FROM daily GROUP BY 1) EXCEPT SELECT entity_id, day FROM daily"


@query("except_calendar_days", "daily", _GAPS)
def _(v):
    return movement.missing_days(v.daily)


@query("except_known_cells", "cell_obs", """SELECT DISTINCT series_id, cell, added_in_version AS version FROM cell_obs o
    WHERE NOT EXISTS (SELECT 1 FROM cell_obs p WHERE p.series_id = o.series_id AND p.cell = o.cell AND p.added_in_version < o.added_in_version)""")
def _(v):
    return series.new_cells(v.cell_obs)


@query("set_overlap", "datasets", "SELECT dataset_id, version, list_has_any(variables, ['rain', 'x']) AS meets FROM datasets")
def _(v):
    return v.datasets.select("dataset_id", "version", F.arrays_overlap("variables", F.array(F.lit("rain"), F.lit("x"))).alias("meets"))


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query("array_intersect_size", "", f"SELECT doc_id, len(list_intersect({_WORDS}, ['the', 'license', 'apache'])) / 3.0e0 AS share FROM documents")
def _(v):
    return v.table("documents").select("doc_id", catalog.word_share(F.col("text"), F.lit("the Apache license")).alias("share"))


@query("new_quarters", "datasets", """SELECT dataset_id, version, array_to_string(list_sort(list_filter(list_distinct(list_transform(range("start"::DATE, ("end" + 1)::DATE, INTERVAL 1 DAY), lambda d: year(d) || '-Q' || quarter(d))), lambda q: q <> '2024-Q1')), ',') AS quarters FROM datasets""")
def _(v):
    first = F.lit(FIRST_DAY).cast("date")
    return v.datasets.select("dataset_id", "version", F.concat_ws(",", F.array_sort(catalog.new_quarters(first, first, F.col("start"), F.col("end")))).alias("quarters"))


# --- checks ------------------------------------------------------------------------------------------------------


@query("check_unique_key", "", "SELECT l_orderkey, count(*) AS count, 'DUPLICATE_KEY' AS code, 'ok' AS of_orders FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(v):
    lines, orders = v.table("lineitem"), v.table("orders")
    codes = [checks.code_of(lambda: checks.check_unique(lines, ["l_orderkey"])), checks.code_of(lambda: checks.check_unique(orders, ["o_orderkey"], nonnull=True))]
    return checks.duplicates(lines, ["l_orderkey"]).select("*", F.lit(codes[0]).alias("code"), F.lit(codes[1]).alias("of_orders"))


@query("check_nonnull", "datasets", "SELECT dataset_id, version, 'NULL_VALUE' AS code, 'ok' AS of_ids FROM datasets WHERE west IS NULL OR variables IS NULL")
def _(v):
    codes = [checks.code_of(lambda columns=columns: checks.check_nonnull(v.datasets, columns)) for columns in (["west", "variables"], ["dataset_id", "version"])]
    return checks.null_rows(v.datasets, ["west", "variables"]).select("dataset_id", "version", F.lit(codes[0]).alias("code"), F.lit(codes[1]).alias("of_ids"))


@query("check_intervals_valid", "datasets", 'SELECT dataset_id, version FROM datasets WHERE "end" <= "start"')
def _(v):
    return checks.invalid_intervals(v.datasets, "start", "end").select("dataset_id", "version")


@query("check_intervals_disjoint", "vegetation", """SELECT cell, count(*) AS n, 'OVERLAPPING_INTERVALS' AS code, 'ok' AS of_rain FROM (SELECT cell, observed_at, max(observed_until) OVER (PARTITION BY cell ORDER BY observed_at, observed_until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM vegetation)
    WHERE observed_at < before GROUP BY 1""")
def _(v):
    codes = [checks.code_of(lambda: checks.check_intervals(v.vegetation, ["cell"], "observed_at", "observed_until")), checks.code_of(lambda: checks.check_intervals(v.rain, ["cell"], "interval_start", "interval_end"))]
    found = checks.overlapping(v.vegetation, ["cell"], "observed_at", "observed_until").groupBy("cell").agg(F.count("*").alias("n"))
    return found.select("*", F.lit(codes[0]).alias("code"), F.lit(codes[1]).alias("of_rain"))


@query("check_geometry_type", "boundaries", "SELECT name, 'GEOMETRY_TYPE' AS code, 'ok' AS of_polygons FROM boundaries WHERE length(name) % 3 <> 0")
def _(v):
    turn = F.length("name") % 3
    kinds = v.boundaries.withColumn("kind", F.when(turn == 0, "Polygon").when(turn == 1, "Point"))
    good = lambda df: checks.code_of(lambda: checks.check_geometry(df, "kind", ["Polygon", "MultiPolygon"]))
    return checks.wrong_geometry(kinds, "kind", ["Polygon", "MultiPolygon"]).select("name", F.lit(good(kinds)).alias("code"), F.lit(good(kinds.where("kind = 'Polygon'"))).alias("of_polygons"))


@query("check_output", "fixes", """WITH kept AS (SELECT CASE WHEN event_type <> 'error' THEN entity_id END AS entity_id, cell, CASE WHEN event_type = 'click' THEN 'Infinity'::DOUBLE ELSE value END AS value FROM fixes)
    SELECT count(*) AS rows, count(*) FILTER (WHERE entity_id IS NULL OR cell IS NULL) AS null_keys, count(*) FILTER (WHERE value = 'Infinity'::DOUBLE) AS nonfinite,
    (SELECT count(*) FROM (SELECT 1 FROM kept GROUP BY entity_id, cell HAVING count(*) > 1)) AS duplicate_keys, 'OUTPUT_INVALID' AS code FROM kept""")
def _(v):
    kept = v.fixes.select(F.when(F.col("event_type") != "error", F.col("entity_id")).alias("entity_id"), "cell", F.when(F.col("event_type") == "click", F.lit(float("inf"))).otherwise(F.col("value")).alias("value"))
    code = checks.code_of(lambda: checks.check_output(kept, ["entity_id", "cell"], ["value"]))
    return checks.output_report(kept, ["entity_id", "cell"], ["value"]).withColumn("code", F.lit(code))


@query("check_grain", "fixes", "SELECT entity_id, observed_at::DATE AS at, count(*) AS count, 'WRONG_GRAIN' AS code, 'ok' AS of_days FROM fixes GROUP BY 1, 2 HAVING count(*) > 1")
def _(v):
    codes = [checks.code_of(lambda: checks.check_grain(v.fixes, "entity_id", "observed_at")), checks.code_of(lambda: checks.check_grain(v.daily, "entity_id", "day"))]
    return checks.off_grain(v.fixes, "entity_id", "observed_at").select("*", F.lit(codes[0]).alias("code"), F.lit(codes[1]).alias("of_days"))


@query("check_wgs84", "", "SELECT count(*) FILTER (WHERE NOT c_acctbal / 50 BETWEEN -180 AND 180) AS bad_lon, count(*) FILTER (WHERE NOT c_custkey BETWEEN -90 AND 90) AS bad_lat FROM customer")
def _(v):
    return checks.wgs84_report(v.table("customer").select((F.col("c_acctbal") / 50).alias("lon"), F.col("c_custkey").alias("lat")), "lon", "lat")


@query("check_row_count", "", "SELECT count(*) AS n, 'ok' AS same, 'ROW_COUNT' AS other FROM orders")
def _(v):
    df = v.table("orders")
    n = df.agg(F.count_distinct("o_orderkey")).first()[0]
    codes = [checks.code_of(lambda want=want: checks.check_count(df, want)) for want in (n, n + 1)]
    return df.agg(F.count("*").alias("n"), F.lit(codes[0]).alias("same"), F.lit(codes[1]).alias("other"))


@query("check_coverage_overlap", "datasets", """SELECT dataset_id, version, ("start" <= DATE '2024-06-30' AND "end" >= DATE '2024-06-01') AND list_has_any(variables, ['rain']) AS ok FROM datasets""")
def _(v):
    ok = checks.coverage_overlaps(F.col("start"), F.col("end"), F.lit("2024-06-01").cast("date"), F.lit("2024-06-30").cast("date"), F.col("variables"), F.array(F.lit("rain")))
    return v.datasets.select("dataset_id", "version", ok.alias("ok"))


@query("coverage_gaps", "datasets", """SELECT dataset_id, version, concat_ws(',', CASE WHEN NOT coalesce(west <= 36.90e0 AND south <= -1.55e0 AND east >= 37.00e0 AND north >= -1.45e0, false) THEN 'bbox' END,
    CASE WHEN "start" > DATE '2024-06-01' THEN 'start' END, CASE WHEN "end" < DATE '2024-06-30' THEN 'end' END) AS gaps FROM datasets""")
def _(v):
    return catalog.coverage_gaps(v.datasets, REGION, F.lit("2024-06-01").cast("date"), F.lit("2024-06-30").cast("date")).select("dataset_id", "version", F.concat_ws(",", "gaps").alias("gaps"))


@query("source_coverage_gaps", "datasets", """WITH files AS (SELECT *, (right(description, 9)::BIGINT % 40)::BIGINT AS source_id FROM datasets),
    u AS (SELECT source_id, count(*) AS files, bool_or(west IS NULL) AS nobox, min(west) AS w, min(south) AS s, max(east) AS e, max(north) AS n, min("start") AS a, max("end") AS b FROM files GROUP BY 1),
    days AS (SELECT source_id, unnest(generate_series("start", "end", INTERVAL 1 DAY))::DATE AS day FROM files),
    holes AS (SELECT u.source_id, count(*) AS uncovered_days FROM u, (SELECT unnest(generate_series(DATE '2024-03-01', DATE '2024-12-31', INTERVAL 1 DAY))::DATE AS day) c
        WHERE c.day BETWEEN u.a AND u.b AND NOT EXISTS (SELECT 1 FROM days d WHERE d.source_id = u.source_id AND d.day = c.day) GROUP BY 1),
    xs AS (SELECT DISTINCT source_id, unnest([greatest(west, 36.90e0), least(east, 37.00e0)]) AS x FROM files WHERE greatest(west, 36.90e0) <= least(east, 37.00e0) AND greatest(south, -1.55e0) <= least(north, -1.45e0)),
    ys AS (SELECT DISTINCT source_id, unnest([greatest(south, -1.55e0), least(north, -1.45e0)]) AS y FROM files WHERE greatest(west, 36.90e0) <= least(east, 37.00e0) AND greatest(south, -1.55e0) <= least(north, -1.45e0)),
    tiles AS (SELECT * FROM (SELECT source_id, x, lead(x) OVER (PARTITION BY source_id ORDER BY x) AS x2 FROM xs) JOIN (SELECT source_id, y, lead(y) OVER (PARTITION BY source_id ORDER BY y) AS y2 FROM ys) USING (source_id)),
    shares AS (SELECT source_id, coalesce(sum((x2 - x) * (y2 - y)) FILTER (EXISTS (SELECT 1 FROM files f WHERE f.source_id = tiles.source_id AND f.west <= (x + x2) / 2 AND f.east >= (x + x2) / 2 AND f.south <= (y + y2) / 2 AND f.north >= (y + y2) / 2)), 0) / 0.01e0 AS share FROM tiles GROUP BY 1)
    SELECT u.source_id, files, concat_ws(',', CASE WHEN nobox THEN 'bbox_unknown' WHEN NOT (w <= 36.90e0 AND s <= -1.55e0 AND e >= 37.00e0 AND n >= -1.45e0) THEN 'bbox' END, CASE WHEN a > DATE '2024-03-01' THEN 'start' END, CASE WHEN b < DATE '2024-12-31' THEN 'end' END) AS gaps,
        coalesce(uncovered_days, 0)::BIGINT AS uncovered_days, CASE WHEN w IS NOT NULL THEN round(coalesce(share, 0), 6) END AS share FROM u LEFT JOIN holes USING (source_id) LEFT JOIN shares USING (source_id)""")
def _(v):
    files = v.datasets.withColumn("source_id", F.right("description", F.lit(9)).cast("long") % 40)
    out = catalog.source_coverage_gaps(files, REGION, F.lit("2024-03-01").cast("date"), F.lit("2024-12-31").cast("date"))
    return out.select("source_id", "files", F.concat_ws(",", "gaps").alias("gaps"), "uncovered_days", r("share").alias("share"))


@query("missing_data_kinds", "datasets", "SELECT kind FROM (SELECT unnest(['rain', 'snow', 'fixes', 'wind']) AS kind) WHERE kind NOT IN (SELECT unnest(variables) FROM datasets)")
def _(v):
    return catalog.missing_kinds(v.datasets, ["rain", "snow", "fixes", "wind"])


@query("quarantine_split", "", "SELECT CASE WHEN p_size > 45 THEN 'too large' WHEN p_retailprice < 950 THEN 'too cheap' ELSE 'good' END AS reason, count(*) AS n FROM part GROUP BY 1")
def _(v):
    good, bad = checks.quarantine(v.table("part"), [("too large", F.col("p_size") > 45), ("too cheap", F.col("p_retailprice") < 950)])
    return good.withColumn("reason", F.lit("good")).unionByName(bad).groupBy("reason").agg(F.count("*").alias("n"))


@query("warn_negative", "", "SELECT count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(*) AS rows FROM customer")
def _(v):
    return checks.count_negative(v.table("customer"), "c_acctbal")


@query("join_diagnostics", "fixes boundaries", "WITH m AS (SELECT source_record_id, count(name) AS matches FROM fixes LEFT JOIN boundaries ON longitude BETWEEN west AND east AND latitude BETWEEN south AND north GROUP BY 1) SELECT count(*) AS rows, count(*) FILTER (WHERE matches = 0) AS unmatched, count(*) FILTER (WHERE matches > 1) AS ambiguous FROM m")
def _(v):
    joined = joins.spatial_join(v.fixes, v.boundaries.withColumn("tie", F.col("name")), "longitude", "latitude", "rings", "tie", ["name"])
    return checks.join_report(joined, "matches")


# --- versions ----------------------------------------------------------------------------------------------------


@query("batch_key", "cell_obs", "SELECT source_item_id, 'lineitem|' || source_item_id || '|' || processing_version || '|' || product_status AS batch_key FROM cell_obs")
def _(v):
    return v.cell_obs.select("source_item_id", series.batch_key(F.col("source_id"), F.col("source_item_id"), F.col("processing_version"), F.col("product_status")).alias("batch_key"))


@query("stream_corrections", "cell_obs", """SELECT source_id, variable, cell, day, value, product_status, source_item_id FROM (SELECT *, time_start::DATE AS day, row_number() OVER (PARTITION BY source_id, variable, cell, time_start::DATE
    ORDER BY product_status = 'final' DESC, processing_version DESC, mapping_version DESC, valid_fraction DESC, available_at DESC, source_item_id DESC) AS place FROM cell_obs) WHERE place = 1""")
def _(v):
    """The observations as a stream of files by version, in some four micro-batches, with one version twice.

    Files are as many as the table has parts, so that no task holds a share of the table that grows with it.
    """
    folder = shared_folder(v.spark)
    files = corrections.send(v.cell_obs, f"{folder}/sent", "added_in_version", "source_item_id")
    files += corrections.send(v.cell_obs.where("added_in_version = 2"), f"{folder}/sent", "added_in_version", "source_item_id")
    stream = v.spark.readStream.schema(v.cell_obs.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{folder}/sent")
    corrections.write_corrections(corrections.corrections(stream, 4000), f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    held = corrections.in_force(v.spark.read.parquet(f"{folder}/changes"))
    return held.select("source_id", "variable", "cell", "day", "value", "product_status", "source_item_id")


@query("stream_append", "cell_obs", """SELECT lpad((substr(series_id, 2)::BIGINT % 9)::VARCHAR, 3, '0') AS series_id, concat_ws('|', added_in_version, product_status, processing_version) AS batch_key, count(*) AS row_count FROM cell_obs GROUP BY 1, 2""")
def _(v):
    """A row a batch of nine series, as a stream of files, one a micro-batch; those of one version come twice."""
    folder = shared_folder(v.spark)
    number = F.lpad((F.substring("series_id", 2, 20).cast("long") % 9).cast("string"), 3, "0")
    batches = v.cell_obs.groupBy(number.alias("series_id"), F.concat_ws("|", "added_in_version", "product_status", "processing_version").alias("batch_key")).agg(F.count("*").alias("row_count"))
    sent = batches.repartition(3, "series_id", "batch_key")
    sent.write.parquet(f"{folder}/sent")
    sent.where("batch_key like '2|%'").write.mode("append").parquet(f"{folder}/sent")
    stream = v.spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/sent")
    append.append_stream(stream, f"{folder}/series", f"{folder}/checkpoint").awaitTermination()
    return append.stored_rows(v.spark, f"{folder}/series", sent.schema).select("series_id", "batch_key", "row_count")


@query("stream_daily_counts", "fixes", """SELECT entity_id, observed_at::DATE AS day, count(*) AS fixes FROM fixes GROUP BY 1, 2 HAVING observed_at::DATE + INTERVAL 2 DAY <= (SELECT max(observed_at) FROM fixes)""")
def _(v):
    """Days that the watermark has closed, of the fixes as a stream."""
    folder = shared_folder(v.spark)
    sent = v.fixes.select("entity_id", F.col("observed_at").cast("timestamp").alias("observed_at"))
    sent.write.parquet(f"{folder}/sent")
    counts = append.daily_counts(v.spark.readStream.schema(sent.schema).parquet(f"{folder}/sent")).select("entity_id", F.to_date("window.start").alias("day"), F.col("count").alias("fixes"))
    counts.writeStream.format("parquet").option("path", f"{folder}/counts").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema(counts.schema).parquet(f"{folder}/counts")


@query("series_id", "", "SELECT s_suppkey, 'src--' || s_name || '--1km' || CASE WHEN s_suppkey % 3 = 0 THEN '--study-' || s_suppkey ELSE '' END AS series_id FROM supplier")
def _(v):
    study = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("string"))
    return v.table("supplier").select("s_suppkey", series.series_id(F.lit("src"), F.col("s_name"), F.lit("1km"), study).alias("series_id"))


@query("append_batch", "cell_obs", f"""WITH {_REGISTRY}, kept AS (SELECT * FROM registry WHERE added_in_version <= 3), fresh AS (SELECT series_id, batch_key FROM registry WHERE added_in_version >= 3 EXCEPT SELECT series_id, batch_key FROM kept),
    last AS (SELECT series_id, max(greatest(added_in_version, coalesce(superseded_in_version, 0))) AS last FROM kept GROUP BY 1)
    SELECT series_id, batch_key, added_in_version FROM kept UNION ALL SELECT f.series_id, f.batch_key, coalesce(last, 0) + 1 FROM fresh f LEFT JOIN last USING (series_id)""")
def _(v):
    registry = _registry(v)
    new = registry.where("added_in_version >= 3").select("series_id", "batch_key", F.lit(None).cast("array<string>").alias("supersedes"))
    return series.append_batch(registry.where("added_in_version <= 3"), new).select("series_id", "batch_key", "added_in_version")


@query("live_batches_at", "cell_obs", f"WITH {_REGISTRY} SELECT series_id, batch_key FROM registry WHERE added_in_version <= 4 AND (superseded_in_version IS NULL OR superseded_in_version > 4)")
def _(v):
    return series.live_batches(_registry(v), 4).select("series_id", "batch_key")


@query("current_at", "cell_obs", f"""SELECT cell, variable, source_item_id FROM (SELECT *, row_number() OVER (PARTITION BY cell, variable, source_id, time_start::DATE {_ORDER}) AS place FROM cell_obs
    WHERE added_in_version <= 4 AND (superseded_in_version IS NULL OR superseded_in_version > 4) AND available_at <= TIMESTAMP '1996-01-01') WHERE place = 1""")
def _(v):
    return series.current_at(v.cell_obs, 4, at("1996-01-01")).select("cell", "variable", "source_item_id")


@query("current_cell_observations", "cell_obs", f"SELECT cell, variable, source_item_id FROM (SELECT *, row_number() OVER (PARTITION BY cell, variable, source_id, time_start::DATE {_ORDER}) AS place FROM cell_obs WHERE superseded_in_version IS NULL) WHERE place = 1")
def _(v):
    return series.current_at(v.cell_obs).select("cell", "variable", "source_item_id")


@query("current_animal_locations", "fixes", "SELECT entity_id, observed_at, source_record_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, observed_at ORDER BY source_record_id DESC) AS place FROM fixes WHERE event_type <> 'purchase') WHERE place = 1")
def _(v):
    rows = v.fixes.withColumns({"added_in_version": F.lit(1), "superseded_in_version": F.when(F.col("event_type") == "purchase", 2)})
    return series.current_fixes(series.live_batches(rows)).select("entity_id", "observed_at", "source_record_id")


@query("recipe_vegetation", "cell_obs", f"SELECT series_id, cell, variable, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, cell, variable, source_id, time_start::DATE {_ORDER}) AS place FROM cell_obs WHERE superseded_in_version IS NULL AND variable IN ('ndvi', 'evi')) WHERE place = 1")
def _(v):
    return series.current_cells(series.live_batches(v.cell_obs), ["series_id"]).where("variable in ('ndvi', 'evi')").select("series_id", "cell", "variable", "value")


_RECIPE_SETS = "sets AS (SELECT series_id AS dataset_id, version, CASE WHEN substr(series_id, 2)::BIGINT % 5 = 0 THEN 'draft' ELSE 'ready' END AS status FROM (SELECT DISTINCT series_id FROM cell_obs), (SELECT unnest([0, 1, 3, 6])::INTEGER AS version))"


def _recipe_sets(v: Views) -> DataFrame:
    number = F.expr("substr(series_id, 2)").cast("long")
    return v.cell_obs.select("series_id").distinct().select(F.col("series_id").alias("dataset_id"), F.explode(F.array(*map(F.lit, (0, 1, 3, 6)))).alias("version"), F.when(number % 5 == 0, "draft").otherwise("ready").alias("status"),
                                                            F.lit("cell_observations").alias("family"), F.lit("public").alias("access_scope"))


def _recipe_rows(v: Views) -> DataFrame:
    return v.cell_obs.select("series_id", F.concat_ws("|", "added_in_version", "product_status", "processing_version").alias("batch_key"), "cell", "variable", "source_id", "time_start", "available_at", "product_status", "processing_version", "mapping_version", "valid_fraction", "source_item_id", "value")


def _recipe_sql(variables: str, columns: str) -> str:
    return f"""WITH {_RECIPE_SETS} SELECT dataset_id, version, cell, source_item_id AS record, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, version, cell, variable, source_id, time_start::DATE {_ORDER}) AS place
        FROM cell_obs JOIN sets ON series_id = dataset_id AND status = 'ready' AND added_in_version <= version AND (superseded_in_version IS NULL OR superseded_in_version > version) WHERE variable IN ({variables})) WHERE place = 1"""


@query("recipe_rainfall_versions", "cell_obs", _recipe_sql("'rain'", "value AS rainfall_mm"))
def _(v):
    return series.recipe_rainfall(_recipe_sets(v), _registry(v), _recipe_rows(v), "rain").select("dataset_id", "version", "cell", F.col("source_record_id").alias("record"), "rainfall_mm")


@query("recipe_vegetation_versions", "cell_obs", _recipe_sql("'ndvi', 'evi'", "variable AS index_name, value AS index_value"))
def _(v):
    return series.recipe_vegetation(_recipe_sets(v), _registry(v), _recipe_rows(v)).select("dataset_id", "version", "cell", F.col("source_record_id").alias("record"), "index_name", "index_value")


_FIX_BATCHES = "b AS (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error']) AS kind, unnest([1, 2, 2, 3, 4]) AS added, unnest([NULL, 4, 3, NULL, NULL]) AS gone)"


@query("recipe_animals_versions", "fixes", f"""WITH {_FIX_BATCHES} SELECT version, entity_id, observed_at, record, species FROM (SELECT version, entity_id, f.observed_at, source_record_id AS record, 'taxon' || split_part(entity_id, ':', 3)::BIGINT % 7 AS species,
    row_number() OVER (PARTITION BY version, entity_id, f.observed_at ORDER BY added DESC, source_record_id DESC) AS place FROM (SELECT * EXCLUDE (observed_at), date_trunc('day', observed_at) AS observed_at FROM fixes) f JOIN b ON kind = event_type, (SELECT unnest([1, 2, 3, 5]) AS version)
    WHERE added <= version AND (gone IS NULL OR gone > version) AND split_part(entity_id, ':', 3)::BIGINT % 7 <> 6) WHERE place = 1""")
def _(v):
    batches = v.spark.createDataFrame([("events", k, a, g) for k, a, g in (("view", 1, None), ("click", 2, 4), ("purchase", 2, 3), ("signup", 3, None), ("error", 4, None))], "series_id string, batch_key string, added_in_version int, superseded_in_version int")
    sets = v.spark.createDataFrame([("events", i, s, "animal_locations", "public") for i, s in ((1, "ready"), (2, "ready"), (3, "ready"), (4, "draft"), (5, "ready"))], "dataset_id string, version int, status string, family string, access_scope string")
    fixes = v.fixes.select(F.lit("events").alias("series_id"), F.col("event_type").alias("batch_key"), "entity_id", F.date_trunc("day", "observed_at").cast(NTZ).alias("observed_at"), "sensor_type", "source_record_id", "longitude", "latitude", "available_at", "quality_flag")
    number = F.element_at(F.split("entity_id", ":"), 3).cast("long")
    entities = v.fixes.select("entity_id").distinct().where(number % 7 != 6).select("entity_id", F.concat(F.lit("taxon"), (number % 7).cast("string")).alias("taxon_name"))
    return series.recipe_animals(sets, batches, fixes, entities).select("version", "entity_id", "observed_at", F.col("source_record_id").alias("record"), "species")


@query("upsert_entities", "", "SELECT coalesce(n.k, o.k) AS entity_id, coalesce(n.c_mktsegment, o.c_mktsegment) AS life_stage, least(o.c_acctbal, n.c_acctbal) AS deploy_on, greatest(o.c_acctbal, n.c_acctbal) AS deploy_off FROM (SELECT c_custkey // 2 AS k, * FROM customer WHERE c_custkey % 2 = 0) o FULL JOIN (SELECT c_custkey // 2 AS k, * FROM customer WHERE c_custkey % 2 = 1) n ON o.k = n.k")
def _(v):
    rows = v.table("customer").select("c_custkey", F.floor(F.col("c_custkey") / 2).alias("entity_id"), F.col("c_mktsegment").alias("life_stage"), F.col("c_acctbal").alias("deploy_on"), F.col("c_acctbal").alias("deploy_off"))
    return series.upsert_entities(rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 2 = 1"), texts=["life_stage"], first=["deploy_on"], last=["deploy_off"])


@query("split_series_by_study", "cell_obs", f"""WITH {_REGISTRY}, own AS (SELECT *, series_id || '--study-' || split_part(batch_key, '|', 3) AS new_series_id FROM registry),
    numbers AS (SELECT new_series_id, event, row_number() OVER (PARTITION BY new_series_id ORDER BY event)::INTEGER AS number FROM (SELECT new_series_id, added_in_version AS event FROM own UNION SELECT new_series_id, superseded_in_version FROM own WHERE superseded_in_version IS NOT NULL))
    SELECT o.new_series_id, batch_key, a.number AS new_version, g.number AS new_superseded FROM own o JOIN numbers a ON a.new_series_id = o.new_series_id AND a.event = added_in_version LEFT JOIN numbers g ON g.new_series_id = o.new_series_id AND g.event = superseded_in_version""")
def _(v):
    manifests = _registry(v).withColumn("raw_manifest", F.to_json(F.struct(F.element_at(F.split("batch_key", r"\|"), 3).alias("study"))))
    return series.split_by_study(manifests).select("new_series_id", "batch_key", "new_version", "new_superseded")


_EVENTS = ("view", "click", "signup", "purchase", "error")
_USER = "split_part(entity_id, ':', 3)::BIGINT"
_STUDIES = f"""tracks AS (SELECT *, {_USER} % 4 AS u, list_position({list(_EVENTS)}, event_type) AS kind, event_type || '|' || ({_USER} % 4) AS batch_key FROM fixes),
    own AS (SELECT DISTINCT batch_key, u, event_type, CASE WHEN u = 3 THEN 'tracks' ELSE 'tracks--study-' || u END AS dataset_id, kind + u AS added, CASE WHEN event_type = 'click' THEN kind + 3 * u + 1 END AS gone FROM tracks),
    numbers AS (SELECT dataset_id, event, row_number() OVER (PARTITION BY dataset_id ORDER BY event) AS number FROM (SELECT dataset_id, added AS event FROM own UNION SELECT dataset_id, gone FROM own WHERE gone IS NOT NULL)),
    heads AS (SELECT o.dataset_id, array_to_string(list('item-' || batch_key ORDER BY added, batch_key) FILTER (WHERE gone IS NULL), ',') AS artifacts FROM own o GROUP BY 1),
    latest_title AS (SELECT dataset_id, CASE WHEN u <> 2 THEN event_type END AS description, row_number() OVER (PARTITION BY dataset_id ORDER BY u = 2, added DESC, batch_key DESC) AS place FROM own)"""


@query("study_datasets", "fixes", f"""WITH {_STUDIES} SELECT h.dataset_id, (SELECT max(number) FROM numbers n WHERE n.dataset_id = h.dataset_id) AS version, description, h.artifacts, count(*) AS row_count, min(observed_at) AS "start", max(observed_at) AS "end", round(min(longitude), 6) AS west,
        round(min(latitude), 6) AS south, round(max(longitude), 6) AS east, round(max(latitude), 6) AS north, count(DISTINCT cell) AS cells, array_to_string(list_sort(list(DISTINCT CASE WHEN {_USER} % 7 < 6 THEN 'taxon' || ({_USER} % 7) END)), ',') AS species,
        'sensor_type:gps,temporal_resolution:sub_daily,study_design:gps_collar,' || array_to_string(list_transform(range(year(min(observed_at)), year(max(observed_at)) + 1), lambda y: 'year:' || y), ',') AS tags
    FROM heads h JOIN own o USING (dataset_id) JOIN latest_title l ON l.dataset_id = h.dataset_id AND place = 1 JOIN tracks t ON t.batch_key = o.batch_key WHERE o.gone IS NULL GROUP BY h.dataset_id, description, h.artifacts""")
def _(v):
    user = F.element_at(F.split("entity_id", ":"), 3).cast("long")
    u, kind = user % 4, F.array_position(F.array(*map(F.lit, _EVENTS)), F.col("event_type"))
    tracks = v.fixes.withColumns({"u": u, "kind": kind, "series_id": F.lit("tracks"), "batch_key": F.concat_ws("|", "event_type", u.cast("string"))})
    manifest = F.to_json(F.struct(F.when(F.col("u") != 3, F.col("u").cast("string")).alias("study"), F.when(F.col("u") != 2, F.concat(F.lit("Data from: "), F.col("event_type"))).alias("title")))
    registry = tracks.select("series_id", "batch_key", "u", "kind", "event_type").distinct().select(
        "series_id", "batch_key", F.concat(F.lit("item-"), "batch_key").alias("source_item_id"), manifest.alias("raw_manifest"), (F.col("kind") + F.col("u")).cast("int").alias("added_in_version"),
        F.when(F.col("event_type") == "click", F.col("kind") + 3 * F.col("u") + 1).cast("int").alias("superseded_in_version"))
    entities = v.fixes.select("entity_id").distinct().where(user % 7 != 6).select("entity_id", F.concat(F.lit("taxon"), (user % 7).cast("string")).alias("taxon_name"))
    sets = series.study_datasets(series.split_by_study(registry), tracks, entities)
    return sets.withColumns({c: r(c) for c in ("west", "south", "east", "north")} | {c: F.concat_ws(",", c) for c in ("artifacts", "species", "tags")})


_DAILY = "SELECT entity_id, day, round(longitude, 6) AS longitude, fix_count, round(displacement_km, 6) AS displacement_km, available_at FROM daily"


@query("daily_movement", "daily", _DAILY)
def _(v):
    return v.daily.select("entity_id", "day", r("longitude").alias("longitude"), "fix_count", r("displacement_km").alias("displacement_km"), "available_at")


@query("already_ingested", "cell_obs", "SELECT source_item_id FROM cell_obs o WHERE NOT EXISTS (SELECT 1 FROM cell_obs p WHERE p.value > 25 AND p.source_item_id = o.source_item_id AND p.processing_version = o.processing_version AND p.product_status = o.product_status)")
def _(v):
    return series.not_ingested(v.cell_obs, v.cell_obs.where("value > 25")).select("source_item_id")


@query("table_fingerprint", "", "SELECT count(*) AS rows, true AS same, false AS changed_is_same, false AS doubled_is_same FROM orders")
def _(v):
    orders = v.table("orders")
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == orders.agg(F.max("o_orderkey")).first()[0], 0.0).otherwise(F.col("o_totalprice")))
    own, *others = (series.table_fingerprint(df).first() for df in (orders, orders.repartition(7), changed, orders.union(orders)))
    return orders.agg(F.count("*").alias("rows"), *(F.lit(own == x).alias(c) for x, c in zip(others, ("same", "changed_is_same", "doubled_is_same"), strict=True)))


# --- catalog -----------------------------------------------------------------------------------------------------

_LATEST = "latest AS (SELECT DISTINCT ON (dataset_id) * FROM datasets ORDER BY dataset_id, version DESC)"
_TIME = """CASE WHEN "start" IS NOT NULL THEN greatest(date_diff('day', greatest("start", DATE '2024-03-01'), least("end", DATE '2024-08-01')), 0) / date_diff('day', DATE '2024-03-01', DATE '2024-08-01') END"""
_FOUND = f"""{_LATEST}, shares AS (SELECT *, CASE WHEN west IS NOT NULL THEN {_SHARE} END AS s, {_TIME} AS t FROM latest WHERE status = 'ready' AND access_scope = 'public' AND list_has_any(variables, ['rain', 'fixes'])),
    found AS (SELECT *, coalesce(s, 1) * coalesce(t, 1) AS score FROM shares WHERE (s IS NULL OR s > 0) AND (t IS NULL OR t > 0))"""
_SPAN = ("2024-03-01", "2024-08-01")


def _found(v: Views) -> DataFrame:
    start, end = (F.lit(x).cast("date") for x in _SPAN)
    return catalog.search(v.datasets, REGION, start, end, ["public"], variables=["rain", "fixes"])


@query("search_datasets", "datasets", f"WITH {_FOUND} SELECT dataset_id, version, list_contains(tags, 't1') OR list_contains(tags, 't3') AS asked FROM found")
def _(v):
    start, end = (F.lit(x).cast("date") for x in _SPAN)
    named = v.datasets.withColumn("hidden", F.when(F.array_contains("tags", "t2"), F.col("tags")))
    tagged = catalog.search(named, REGION, start, end, ["public"], variables=["rain", "fixes"], any_tags=["t1", "t2", "t3"], suggested="hidden").select("dataset_id", F.lit(True).alias("asked"))
    return _found(v).select("dataset_id", "version").join(tagged, "dataset_id", "left").select("dataset_id", "version", F.coalesce("asked", F.lit(False)).alias("asked"))


@query("spatial_share", "datasets", f"SELECT dataset_id, version, CASE WHEN west IS NOT NULL THEN round({_SHARE}, 6) END AS share FROM datasets")
def _(v):
    return v.datasets.select("dataset_id", "version", r(catalog.spatial_share(REGION)).alias("share"))


@query("temporal_share", "datasets", f"SELECT dataset_id, version, round({_TIME}, 6) AS share FROM datasets")
def _(v):
    return v.datasets.select("dataset_id", "version", r(catalog.temporal_share(*(F.lit(x).cast("date") for x in _SPAN))).alias("share"))


@query("match_score", "datasets", f"WITH {_FOUND} SELECT dataset_id, round(score, 6) AS score FROM found")
def _(v):
    return _found(v).select("dataset_id", r("score").alias("score"))


@query("rank_matches", "datasets", f"WITH {_FOUND} SELECT dataset_id, row_number() OVER (ORDER BY score DESC, dataset_id) AS place FROM found")
def _(v):
    return catalog.ranked(_found(v)).select("dataset_id", "place")


@query("lexical_search", "", f"SELECT doc_id, len(list_intersect({_WORDS}, ['the', 'license', 'apache'])) / 3.0e0 AS share FROM documents WHERE len(list_intersect({_WORDS}, ['the', 'license', 'apache'])) > 0 ORDER BY share DESC, doc_id LIMIT 50")
def _(v):
    return catalog.lexical_search(v.table("documents"), "doc_id", "text", "the Apache license", 50)


@query("eligibility", "datasets", """WITH reasons AS (SELECT dataset_id || '.' || version AS dataset_id,
    list_filter([CASE WHEN NOT list_contains(variables, 'rain') THEN 'missing:rain' END, CASE WHEN "end" < DATE '2024-03-01' OR "start" > DATE '2024-08-01' THEN 'time_disjoint' END,
        CASE WHEN NOT coalesce(west <= 37.00e0 AND 36.90e0 <= east AND south <= -1.45e0 AND -1.55e0 <= north, true) THEN 'space_disjoint' END, CASE WHEN version = 2 THEN 'unit:rain' END,
        CASE WHEN "end" >= DATE '2024-03-01' AND "start" <= DATE '2024-08-01' AND "start" > DATE '2024-02-23' THEN 'lookback_short' END, CASE WHEN status <> 'ready' THEN 'status' END], lambda x: x IS NOT NULL) AS hard,
    list_filter([CASE WHEN west IS NULL THEN 'space_unknown' END, CASE WHEN version = 1 AND list_contains(variables, 'rain') THEN 'unit_unknown:rain' END], lambda x: x IS NOT NULL) AS unknown FROM datasets)
    SELECT dataset_id, CASE WHEN len(hard) > 0 THEN 'ineligible' WHEN len(unknown) > 0 THEN 'unresolved' ELSE 'eligible' END AS status, array_to_string(list_concat(hard, unknown), ',') AS reasons FROM reasons""")
def _(v):
    unit = F.when(F.col("version") != 1, F.create_map(F.lit("rain"), F.when(F.col("version") == 0, "mm").otherwise("inch")))
    named = v.datasets.withColumns({"units": F.coalesce(unit, F.create_map().cast("map<string,string>")), "columns": F.col("variables")}).withColumn("dataset_id", F.concat_ws(".", "dataset_id", "version"))
    found = catalog.eligibility(named, ["rain"], REGION, *(F.lit(x).cast("date") for x in _SPAN), units={"rain": "mm"}, lookback_days=7, statuses=["ready"])
    return found.select("dataset_id", "status", F.concat_ws(",", "reasons").alias("reasons"))


@query("deterministic_tags", "datasets", f"""WITH {_LATEST} SELECT dataset_id, 'variable:' || unnest(variables) AS tag FROM latest UNION SELECT dataset_id, 'year:' || unnest(range(year("start"), year("end") + 1)) FROM latest
    UNION SELECT dataset_id, 'region:box' FROM latest WHERE west IS NOT NULL AND {_SHARE} >= 0.05 UNION SELECT dataset_id, 'source:' || family FROM latest""")
def _(v):
    box = v.spark.createDataFrame([("box", *REGION)], "region string, west double, south double, east double, north double")
    return catalog.dataset_tags(catalog.latest_datasets(v.datasets), box, "family")


@query("merge_tags", "datasets", "SELECT dataset_id, version, CASE WHEN version = 0 THEN 'a=t' ELSE 'a=t,b=u' END AS tags FROM datasets")
def _(v):
    tag = lambda k, x: F.struct(F.lit(k).alias("key"), F.lit(x).alias("value"))
    suggested = F.when(F.col("version") == 0, F.array(tag("a", "x"), tag("zz", "y"))).otherwise(F.array(tag("a", "x"), tag("b", "u")))
    merged = catalog.merge_tags(F.array(tag("a", "t")), suggested, ["a", "b"])
    return v.datasets.select("dataset_id", "version", F.concat_ws(",", F.transform(merged, lambda t: F.concat_ws("=", t["key"], t["value"]))).alias("tags"))


@query("publish_summary", "cell_obs", """WITH live AS (SELECT *, substr(series_id, 2)::BIGINT AS k FROM cell_obs WHERE superseded_in_version IS NULL),
    items AS (SELECT series_id, array_to_string(list(source_item_id ORDER BY added, source_item_id), ',') AS artifacts FROM (SELECT series_id, source_item_id, min(added_in_version) AS added FROM live GROUP BY 1, 2) GROUP BY 1)
    SELECT series_id, max(added_in_version) AS version, count(*) AS row_count, string_agg(DISTINCT mapping_version, ',') AS mapping_versions, min(time_start) AS first_start, max(time_start) AS last_start, array_to_string(list_sort(list(DISTINCT variable)), ',') AS variables, count(DISTINCT cell) AS cells,
        array_to_string(list_sort(list(DISTINCT product_status)), ',') AS taxa, artifacts,
        round(min(cell / 10e0), 6) AS west, round(min(-(cell % 50)), 6) AS south, round(max(cell / 10e0), 6) AS east, round(max(-(cell % 50)), 6) AS north FROM live JOIN items USING (series_id) GROUP BY series_id, artifacts, k HAVING k % 4 = 0 OR max(added_in_version) > 4 + k % 4""")
def _(v):
    k = F.substring("series_id", 2, 20).cast("long")
    rows = v.cell_obs.withColumns({"lon": F.col("cell") / 10.0, "lat": -(F.col("cell") % 50).cast("double")})
    registered = v.cell_obs.select("series_id", (k % 4 + 4).cast("int").alias("version")).distinct().where(k % 4 != 0)
    out = series.publish_summary(rows, ["series_id"], registered, "product_status", "source_item_id", "lon", "lat")
    return out.withColumns({c: F.concat_ws(",", c) for c in ("variables", "taxa", "artifacts")} | {c: r(c) for c in ("west", "south", "east", "north")})


@query("needs_relabel", "datasets", """WITH pairs AS (SELECT a.dataset_id || '.' || b.version AS dataset_id, a."start" AS s0, a."end" AS e0, b."start" AS s1, b."end" AS e1, CASE WHEN a.west IS NULL THEN 0 ELSE 1 END AS c0, CASE WHEN b.west IS NOT NULL AND (a.west IS NULL OR a.west <> b.west OR a.south <> b.south) THEN 1 ELSE 0 END AS c1
        FROM datasets a JOIN datasets b ON a.dataset_id = b.dataset_id AND b.version = a.version + 1)
    SELECT dataset_id, (c0 > 0 AND c1 > c0 * 0.1) OR len(list_filter(list_transform(range(date_trunc('quarter', s1)::DATE, (e1 + 1)::DATE, INTERVAL 3 MONTH), lambda d: (year(d), quarter(d))), lambda q: NOT list_contains(list_transform(range(date_trunc('quarter', s0)::DATE, (e0 + 1)::DATE, INTERVAL 3 MONTH), lambda d: (year(d), quarter(d))), q))) > 0 AS relabel FROM pairs""")
def _(v):
    named = lambda version: v.datasets.withColumn("dataset_id", F.concat_ws(".", "dataset_id", version))
    before, after = named(F.col("version") + 1), named(F.col("version"))
    cells = lambda df: catalog.footprint(df.withColumn("cell", F.when(F.col("west").isNotNull(), F.concat_ws(":", "west", "south"))), ["dataset_id"])
    return catalog.needs_relabel(before, after, catalog.footprint_growth(cells(before), cells(after), ["dataset_id"]))


@query("public_catalog_listing", "datasets", "SELECT dataset_id, version, family FROM datasets WHERE access_scope = 'public' AND status = 'ready'")
def _(v):
    return catalog.public_catalog(v.datasets).select("dataset_id", "version", "family")


@query("distinct_sources", "", "SELECT DISTINCT json_extract_string(props, '$.k') AS source FROM events")
def _(v):
    return catalog.distinct_sources(v.table("events"), "props", "$.k")


# --- analysis ----------------------------------------------------------------------------------------------------


_FLAGGED = """flagged AS (SELECT *, CASE WHEN u % 5 = 0 THEN 'out_of_scope' WHEN day NOT BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' THEN 'out_of_time' WHEN u % 3 = 1 THEN 'wrong_species' WHEN cell IN ('c7', 'c9') THEN 'no_coordinates' END AS reason
    FROM (SELECT *, split_part(entity_id, ':', 3)::BIGINT AS u FROM daily))"""


def _prepared(v: Views) -> checks.Prepared:
    """Days with scopes and species, some without places, some of a place that is no number, and some negative distances, as texts."""
    u, cell = F.element_at(F.split("entity_id", ":"), 3).cast("long"), F.col("cell")
    km = F.when(cell == "c5", -F.col("displacement_km")).otherwise(F.col("displacement_km")).cast("string")
    longitude = F.when(cell == "c7", float("nan")).when(cell != "c9", F.col("longitude"))
    table = v.daily.withColumns({"access_scope": F.when(u % 5 == 0, "secret").otherwise(F.when(u % 5 == 1, "team").otherwise("public")), "species": F.when(u % 3 == 1, "topi").otherwise("kob"), "longitude": longitude, "displacement_km": km})
    return checks.prepare(table, F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date"), ["displacement_km"], ["kob"], ["team"])


@query("prepare_features", "daily", f"WITH {_FLAGGED} SELECT entity_id, day, round(CASE WHEN cell = 'c5' THEN -displacement_km ELSE displacement_km END, 6) AS displacement_km FROM flagged WHERE reason IS NULL")
def _(v):
    return _prepared(v).rows.select("entity_id", "day", r("displacement_km").alias("displacement_km"))


@query("prepare_report", "daily", f"""WITH {_FLAGGED} SELECT count(*) AS rows_read, count(*) FILTER (reason = 'out_of_scope') AS out_of_scope, count(*) FILTER (reason = 'out_of_time') AS out_of_time, count(*) FILTER (reason = 'wrong_species') AS wrong_species,
    count(*) FILTER (reason = 'no_coordinates') AS no_coordinates, 0 AS invalid_numbers, count(*) FILTER (cell = 'c7') AS nonfinite, count(*) FILTER (cell = 'c5' AND displacement_km > 0) AS negative, 0 AS outside_wgs84,
    count(*) FILTER (reason IS NULL) AS rows_kept, 0 AS off_grain, 0 AS no_animal FROM flagged""")
def _(v):
    prepared = _prepared(v)
    prepared.rows.write.parquet(shared_folder(v.spark))  # the one action; counters come with it
    prepared.check()
    return v.spark.createDataFrame([prepared.counts()])


#: An export in which some places and times can't be read, lie outside the globe, or aren't finite.
_DAMAGED = """damaged AS (SELECT source_record_id, CASE cell WHEN 'c3' THEN 'NaN' WHEN 'c4' THEN '190.5' WHEN 'c5' THEN 'east' ELSE longitude::VARCHAR END AS lon,
    CASE event_type WHEN 'error' THEN 'n/a' WHEN 'click' THEN NULL ELSE latitude::VARCHAR END AS lat, CASE WHEN entity_id LIKE '%7' THEN '2024-13-45' ELSE observed_at::VARCHAR END AS seen FROM fixes),
    read AS (SELECT *, TRY_CAST(lon AS DOUBLE) AS x, TRY_CAST(lat AS DOUBLE) AS y, TRY_CAST(seen AS TIMESTAMP) AS t FROM damaged)"""
_KINDS = {"lon": "longitude", "lat": "latitude", "seen": "time"}


def _damaged(v: Views) -> DataFrame:
    cell, kind = F.col("cell"), F.col("event_type")
    return v.fixes.select(
        "source_record_id", F.when(cell == "c3", "NaN").when(cell == "c4", "190.5").when(cell == "c5", "east").otherwise(F.col("longitude").cast("string")).alias("lon"),
        F.when(kind == "error", "n/a").when(kind != "click", F.col("latitude").cast("string")).alias("lat"), F.when(F.col("entity_id").endswith("7"), "2024-13-45").otherwise(F.col("observed_at").cast("string")).alias("seen"))


def _type_counts(column: str, kind: str, value: str, bound: int | None) -> str:
    bad = f"{column} IS NOT NULL AND {value} IS NULL"
    odd = f"NOT isfinite({value})" if bound else "false"
    outside = f"isfinite({value}) AND abs({value}) > {bound}" if bound else "false"
    return f"SELECT '{column}' AS \"column\", '{kind}' AS kind, count(*) AS rows, count(*) FILTER ({column} IS NULL) AS nulls, count(*) FILTER ({bad}) AS bad, count(*) FILTER ({odd}) AS nonfinite, count(*) FILTER ({outside}) AS outside, min({column}) FILTER ({bad}) AS example FROM read"


@query("type_report", "fixes", f"WITH {_DAMAGED} {_type_counts('lon', 'longitude', 'x', 180)} UNION ALL {_type_counts('lat', 'latitude', 'y', 90)} UNION ALL {_type_counts('seen', 'time', 't', None)}")
def _(v):
    return checks.type_report(_damaged(v), _KINDS)


_FAULTS = """list_filter([CASE WHEN lon IS NOT NULL AND x IS NULL THEN 'lon:bad' WHEN isfinite(x) AND abs(x) > 180 THEN 'lon:outside' END, CASE WHEN lat IS NOT NULL AND y IS NULL THEN 'lat:bad' END, CASE WHEN seen IS NOT NULL AND t IS NULL THEN 'seen:bad' END], lambda p: p IS NOT NULL)"""


@query("type_quarantine", "fixes", f"WITH {_DAMAGED} SELECT source_record_id, round(CASE WHEN len({_FAULTS}) = 0 AND isfinite(x) THEN x END, 6) AS lon, round(CASE WHEN len({_FAULTS}) = 0 THEN y END, 6) AS lat, CASE WHEN len({_FAULTS}) = 0 THEN t END AS seen, array_to_string({_FAULTS}, ',') AS problems FROM read")
def _(v):
    good, bad = checks.typed(_damaged(v), _KINDS)
    nothing = {c: F.lit(None).cast(good.schema[c].dataType) for c in _KINDS}
    both = good.withColumn("problems", F.lit("")).unionByName(bad.withColumns({**nothing, "problems": F.array_join("problems", ",")}))
    return both.select("source_record_id", r("lon").alias("lon"), r("lat").alias("lat"), F.col("seen").cast(NTZ).alias("seen"), "problems")


@query("tracking_report", "fixes", f"""WITH {_DAMAGED}, told AS (SELECT *, CASE WHEN lon IS NULL OR lat IS NULL OR seen IS NULL THEN 'missing' WHEN t IS NULL THEN 'bad_time' WHEN x IS NULL OR y IS NULL THEN 'bad_place' END AS why FROM read)
    SELECT count(*) AS rows, count(*) FILTER (why = 'missing') AS missing, count(*) FILTER (why = 'bad_time') AS bad_time, count(*) FILTER (why = 'bad_place') AS bad_place, count(*) FILTER (why IS NULL) AS kept,
    count(*) FILTER (why IS NULL AND NOT (isfinite(x) AND abs(x) <= 180 AND abs(y) <= 90)) AS outside_wgs84 FROM told""")
def _(v):
    return tracking.tracking_report(_damaged(v).withColumnsRenamed({"lon": "location-long", "lat": "location-lat", "seen": "timestamp"}))


def _shown(value: str, decimals: int = 6) -> str:
    return f"coalesce(CASE WHEN round({value}, {decimals}) = 0 THEN '0' ELSE rtrim(rtrim(printf('%.{decimals}f', round({value}, {decimals})), '0'), '.') END, 'unknown')"


@query("report_numbers", "cell_obs", f"SELECT source_item_id, {_shown('CASE WHEN cell % 3 <> 0 THEN (0.5 - valid_fraction) * cell * 1000 END', 3)} AS shown, {_shown('value / 8', 6)} AS eighths FROM cell_obs")
def _(v):
    signed = F.when(F.col("cell") % 3 != 0, (0.5 - F.col("valid_fraction")) * F.col("cell") * 1000)
    return v.cell_obs.select("source_item_id", formatted(signed, 3).alias("shown"), formatted(F.col("value") / 8).alias("eighths"))


@query("report_movement", "daily", f"""WITH months AS (SELECT entity_id, strftime(day, '%Y-%m') AS month, count(*) AS days, sum(displacement_km) AS km, count(displacement_km) AS moves FROM daily GROUP BY 1, 2),
    told AS (SELECT *, month || ': ' || days || ' days, ' || {_shown('km', 3)} || ' km, ' || {_shown('km / moves', 3)} || ' km a day.' AS said, 'month-' || month AS dataset, CASE WHEN moves < days THEN (days - moves) || ' days of ' || month || ' have no distance.' END AS limits FROM months)
    SELECT entity_id, string_agg(said, chr(10) || chr(10) ORDER BY month) || chr(10) || chr(10) || 'Evidence: datasets ' || string_agg(dataset, ', ' ORDER BY dataset) || '.' || chr(10) || chr(10) || 'Attribution: collars.'
    || coalesce(chr(10) || chr(10) || 'Limitations: ' || string_agg(limits, ' ' ORDER BY limits COLLATE "C"), '') AS report FROM told GROUP BY 1""")
def _(v):
    months = v.daily.groupBy("entity_id", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("days"), F.sum("displacement_km").alias("km"), F.count("displacement_km").alias("moves"))
    km = F.col("km")
    said = F.concat("month", report.sentence(": ", F.col("days"), " days, ", (km, 3), " km, ", (km / F.nullif(F.col("moves"), F.lit(0)), 3), " km a day."))
    limits = F.when(F.col("moves") < F.col("days"), F.concat(report.sentence(F.col("days") - F.col("moves"), " days of "), "month", F.lit(" have no distance.")))
    told = months.select("entity_id", "month", said.alias("said"), F.concat(F.lit("month-"), "month").alias("dataset"), limits.alias("limits"))
    return report.render(told, ["entity_id"], ["month"], "said", "dataset", "limits", "collars")


@query("movement_summary", "daily", f"SELECT count(DISTINCT entity_id) AS animals, count(*) AS rows, count(DISTINCT day) AS days, count(displacement_km) AS displacements, count(*) - count(displacement_km) AS missing, round(sum(displacement_km), 6) AS total_km, round(median(displacement_km), 6) AS median_km, min(day) AS first_day, max(day) AS last_day, (SELECT count(*) FROM ({_GAPS})) AS gap_days FROM daily")
def _(v):
    return movement.movement_summary(v.daily).withColumns({"total_km": r("total_km"), "median_km": r("median_km")})


@query("gap_days", "daily", f"SELECT entity_id, count(*) AS gaps FROM ({_GAPS}) GROUP BY 1")
def _(v):
    return movement.missing_days(v.daily).groupBy("entity_id").agg(F.count("*").alias("gaps"))


@query("movement_timeline", "daily", "SELECT day, round(median(displacement_km), 6) AS median, count(DISTINCT entity_id) AS animals FROM daily GROUP BY 1")
def _(v):
    return movement.timeline(v.daily).withColumn("median", r("median"))


@query("track_map", "fixes", """SELECT entity_id, string_agg(epoch_us(observed_at) || ' ' || round(longitude * 1000000)::BIGINT || ' ' || round(latitude * 1000000)::BIGINT, ';' ORDER BY observed_at, longitude, latitude) FILTER (WHERE event_type <> 'error') AS line,
    count(*) FILTER (WHERE event_type = 'error') AS missing FROM fixes GROUP BY 1 HAVING count(*) FILTER (WHERE event_type <> 'error') >= 2""")
def _(v):
    lines = movement.track_map(v.fixes.withColumn("longitude", F.when(F.col("event_type") != "error", F.col("longitude"))))
    point = lambda p: F.concat_ws(" ", F.unix_micros(p["observed_at"].cast("timestamp")), *(F.round(p[c] * 1000000).cast("long") for c in ("longitude", "latitude")))
    return lines.select("entity_id", F.concat_ws(";", F.transform("line", point)).alias("line"), "missing")


@query("revisit_summary", "daily", _REVISITS)
def _(v):
    return movement.revisits(v.daily)


@query("habitat_split", "features", """WITH m AS (SELECT median(rainfall) AS threshold FROM features WHERE rainfall IS NOT NULL AND displacement_km IS NOT NULL) SELECT round(max(threshold), 6) AS threshold, count(*) AS pairs, count(*) FILTER (WHERE rainfall > threshold) AS n_above, count(*) FILTER (WHERE rainfall <= threshold) AS n_below,
    round(median(displacement_km) FILTER (WHERE rainfall > threshold), 6) AS median_above, round(median(displacement_km) FILTER (WHERE rainfall <= threshold), 6) AS median_below FROM features, m WHERE rainfall IS NOT NULL AND displacement_km IS NOT NULL""")
def _(v):
    return stats.habitat_split(v.features, "rainfall").withColumns({c: r(c) for c in ("threshold", "median_above", "median_below")})


@query("window_comparison", "daily", "SELECT w AS window, count(DISTINCT entity_id) AS animals, count(*) AS rows, count(displacement_km) AS displacements, round(median(displacement_km), 6) AS median_km FROM (SELECT *, unnest(CASE WHEN day <= DATE '2024-01-10' THEN ['early'] WHEN day >= DATE '2024-01-20' THEN ['late'] ELSE [] END) AS w FROM daily) GROUP BY 1")
def _(v):
    return movement.compare_windows(v.daily, [("early", "2024-01-01", "2024-01-10"), ("late", "2024-01-20", "2024-01-31")]).withColumn("median_km", r("median_km"))


@query("environment_summary", "features", "SELECT 'rainfall' AS variable, count(rainfall) AS n, round(median(rainfall), 6) AS median FROM features UNION ALL SELECT 'vegetation_index', count(vegetation_index), round(median(vegetation_index), 6) FROM features")
def _(v):
    return stats.environment_summary(v.features, ["rainfall", "vegetation_index"]).withColumn("median", r("median"))


@query("statistics", "features", " UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max FROM features" for c in ("displacement_km", "rainfall")))
def _(v):
    return stats.statistics(v.features, ["displacement_km", "rainfall"]).withColumns({c: r(c) for c in ("mean", "sd", "min", "q1", "median", "q3", "max")})


@query("distribution", "", "SELECT least(floor((o_totalprice - low) / (high - low) * 10), 9)::INTEGER AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders) GROUP BY 1")
def _(v):
    return stats.distribution(v.table("orders"), "o_totalprice", 10)


@query("trend", "features", "SELECT day, round(median(displacement_km), 6) AS displacement_km, round(median(rainfall), 6) AS rainfall FROM features GROUP BY 1")
def _(v):
    return stats.trend(v.features, ["displacement_km", "rainfall"]).withColumns({c: r(c) for c in ("displacement_km", "rainfall")})


def _correlation_sql(x: str, y: str) -> str:
    return f"""SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(corr(a, b) * corr(a, b), 6) AS r2, round(regr_slope(b, a), 6) AS slope, round(regr_intercept(b, a), 5) AS intercept, (SELECT count(*) FROM features) - count(*) AS excluded
    FROM (SELECT {x} AS a, {y} AS b, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0e0 AS ra, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0e0 AS rb FROM features WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""


def _rounded_correlation(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 5 if c == "intercept" else 6) for c in ("pearson", "spearman", "r2", "slope", "intercept")})


@query("correlation", "features", _correlation_sql("rainfall", "displacement_km"))
def _(v):
    return _rounded_correlation(stats.correlation(v.features, "rainfall", "displacement_km"))


@query("pairwise_variables", "features", " UNION ALL ".join(_correlation_sql(*p) for p in (("displacement_km", "rainfall"), ("displacement_km", "vegetation_index"), ("rainfall", "vegetation_index"))))
def _(v):
    return _rounded_correlation(stats.correlations(v.features, ["displacement_km", "rainfall", "vegetation_index"]))


@query("ndvi_change", "vegetation", f"WITH {_CHANGE} SELECT cell, composite, round(mean, 6) AS mean, round(change, 6) AS change FROM change")
def _(v):
    return stats.index_change(v.vegetation).withColumns({"mean": r("mean"), "change": r("change")})


@query("period_response", "features vegetation", f"WITH {_DAYS} SELECT comp AS composite, count(DISTINCT entity_id) AS animals, round(median(displacement_km), 6) AS median_displacement_km, round(median(latitude), 6) AS median_latitude, round(median(vegetation_index), 6) AS median_index_value, round(median(change), 6) AS median_change FROM days GROUP BY 1")
def _(v):
    return stats.period_response(_composites(v)).withColumns({f"median_{c}": r(f"median_{c}") for c in ("displacement_km", "latitude", "index_value", "change")})


_EDGES = (-1.0, -0.05, 0.0, 0.05, 0.10, 1.0)


@query("binned_response", "features vegetation", f"WITH {_DAYS} SELECT bin, count(*) AS n, round(median(displacement_km), 6) AS median, round(avg(displacement_km), 6) AS mean, round(avg((displacement_km > 5)::INTEGER), 6) AS share_above FROM (SELECT *, CASE WHEN change > -1 AND change <= -0.05 THEN 0 WHEN change > -0.05 AND change <= 0 THEN 1 WHEN change > 0 AND change <= 0.05 THEN 2 WHEN change > 0.05 AND change <= 0.10 THEN 3 WHEN change > 0.10 AND change <= 1 THEN 4 END AS bin FROM days) WHERE bin IS NOT NULL AND displacement_km IS NOT NULL GROUP BY 1")
def _(v):
    return stats.binned_response(_composites(v), "change", _EDGES, "displacement_km", 5).withColumns({c: r(c) for c in ("median", "mean", "share_above")})


def _fix_values(v: Views) -> DataFrame:
    return v.fixes.withColumn("vegetation_index", F.col("value") / 500)


_RESIDENCE = """inter AS (SELECT entity_id, observed_at, value / 500 AS a, lead(value / 500) OVER w AS b, lead(observed_at) OVER w AS nxt FROM fixes WINDOW w AS (PARTITION BY entity_id ORDER BY observed_at)),
    gaps AS (SELECT *, epoch_us(nxt - observed_at) / 3.6e9 AS hours FROM inter WHERE nxt IS NOT NULL),
    ends AS (SELECT entity_id, observed_at, a AS value, hours / 2 AS hours FROM gaps WHERE hours > 0 AND hours <= 12 UNION ALL SELECT entity_id, nxt, b, hours / 2 FROM gaps WHERE hours > 0 AND hours <= 12),
    middle AS (SELECT median(value) AS threshold FROM (SELECT DISTINCT entity_id, observed_at, value FROM ends))"""


@query("residence_time", "fixes", f"""WITH {_RESIDENCE} SELECT entity_id, round(threshold, 6) AS threshold, round(sum(hours), 6) AS hours, round(coalesce(sum(hours) FILTER (WHERE value > threshold), 0), 6) AS hours_above, round(sum(value * hours) / sum(hours), 6) AS weighted_mean,
    round(coalesce((SELECT sum(g.hours) FROM gaps g WHERE g.entity_id = e.entity_id AND (g.hours > 12 OR g.hours <= 0)), 0), 6) AS gap_hours FROM ends e, middle GROUP BY entity_id, threshold""")
def _(v):
    out = movement.residence_time(_fix_values(v), max_gap_hours=12)
    return out.select("entity_id", *(r(c).alias(c) for c in ("threshold", "hours", "hours_above", "weighted_mean", "gap_hours")))


@query("sampling_grain", "fixes", "SELECT entity_id, count(*) AS intervals FROM (SELECT entity_id, lead(observed_at) OVER (PARTITION BY entity_id ORDER BY observed_at) AS nxt FROM fixes) WHERE nxt IS NOT NULL GROUP BY 1")
def _(v):
    checks.check_grain(v.fixes, "entity_id", "observed_at", "fix")
    return movement.residence_intervals(_fix_values(v)).groupBy("entity_id").agg(F.count("*").alias("intervals"))


@query("route_overlap", "fixes boundaries", """WITH seg AS (SELECT entity_id, longitude, latitude, lead(longitude) OVER w AS nlon, lead(latitude) OVER w AS nlat FROM fixes WINDOW w AS (PARTITION BY entity_id ORDER BY observed_at)),
    met AS (SELECT *, longitude BETWEEN west AND east AND latitude BETWEEN south AND north AS inside, nlon - longitude AS dx, nlat - latitude AS dy, sqrt(pow((nlon - longitude) * cos(radians((latitude + nlat) / 2)) * 111.32e0, 2) + pow((nlat - latitude) * 110.574e0, 2)) AS km FROM seg, boundaries),
    cut AS (SELECT *, CASE WHEN dx <> 0 THEN least((west - longitude) / dx, (east - longitude) / dx) WHEN longitude BETWEEN west AND east THEN 0 ELSE 2 END AS x0, CASE WHEN dx <> 0 THEN greatest((west - longitude) / dx, (east - longitude) / dx) ELSE 1 END AS x1,
        CASE WHEN dy <> 0 THEN least((south - latitude) / dy, (north - latitude) / dy) WHEN latitude BETWEEN south AND north THEN 0 ELSE 2 END AS y0, CASE WHEN dy <> 0 THEN greatest((south - latitude) / dy, (north - latitude) / dy) ELSE 1 END AS y1 FROM met),
    sums AS (SELECT name, entity_id, count(*) FILTER (WHERE inside) AS points_inside, coalesce(sum(km), 0) AS path_km, coalesce(sum(CASE WHEN km IS NOT NULL THEN km * greatest(0, least(1, x1, y1) - greatest(0, x0, y0)) END), 0) AS inside_km FROM cut GROUP BY 1, 2)
    SELECT name, entity_id, points_inside, round(path_km, 5) AS path_km, round(inside_km, 4) AS inside_km, round(CASE WHEN path_km > 0 THEN inside_km / path_km ELSE 0 END, 6) AS share FROM sums""")
def _(v):
    met = movement.route_overlap(v.fixes, v.boundaries.select("name", "rings"))
    return met.select("name", "entity_id", "points_inside", F.round("path_km", 5).alias("path_km"), F.round("inside_km", 4).alias("inside_km"), r("share").alias("share"))


# --- forecasts ---------------------------------------------------------------------------------------------------

_EXAMPLES = f"""pairs AS (SELECT entity_id, day, displacement_km, rainfall, lead(day) OVER w AS target_day, lead(displacement_km) OVER w AS target FROM features WINDOW w AS (PARTITION BY entity_id ORDER BY day)),
    examples AS (SELECT *, target_day >= DATE '{CUTOFF}' AS held_out, avg(displacement_km) OVER (PARTITION BY entity_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS baseline FROM pairs WHERE target_day - day = 1 AND target IS NOT NULL AND displacement_km IS NOT NULL)"""
#: One feature, z-scored, with a penalty of 1: slope = n cov / (n var + var) on the raw scale.
_MODEL = "model AS (SELECT (count(*) * covar_pop(target, displacement_km)) / (count(*) * var_pop(displacement_km) + var_pop(displacement_km)) AS slope, avg(target) AS my, avg(displacement_km) AS mx FROM examples WHERE NOT held_out)"


def _examples(v: Views) -> DataFrame:
    return forecast.with_baseline(forecast.next_day_examples(v.features, CUTOFF, ["displacement_km", "rainfall"]))


def _fit(v: Views) -> tuple[DataFrame, forecast.Ridge]:
    examples = _examples(v)
    return examples, forecast.ridge(examples.where("not held_out"), ["displacement_km"])


@query("forecast_examples", "features", f"WITH {_EXAMPLES} SELECT entity_id, day, round(target, 6) AS target, held_out FROM examples")
def _(v):
    return _examples(v).select("entity_id", "day", r("target").alias("target"), "held_out")


@query("forecast_baseline_7d", "features", f"WITH {_EXAMPLES} SELECT entity_id, day, round(baseline, 6) AS baseline FROM examples")
def _(v):
    return _examples(v).select("entity_id", "day", r("baseline").alias("baseline"))


@query("forecast_ridge", "features", f"WITH {_EXAMPLES}, {_MODEL} SELECT entity_id, day, round(my + slope * (displacement_km - mx), 5) AS predicted FROM examples, model WHERE held_out")
def _(v):
    examples, model = _fit(v)
    return examples.where("held_out").select("entity_id", "day", F.round(model.predict({"displacement_km": F.col("displacement_km")}), 5).alias("predicted"))


@query("forecast_select", "features", f"WITH {_EXAMPLES}, {_MODEL} SELECT count(*) AS n, round(avg(abs(target - baseline)), 5) AS baseline_mae, round(avg(abs(target - (my + slope * (displacement_km - mx)))), 5) AS model_mae, CASE WHEN avg(abs(target - (my + slope * (displacement_km - mx)))) < avg(abs(target - baseline)) - 1e-9 THEN 'model' ELSE 'baseline' END AS presented FROM examples, model WHERE held_out")
def _(v):
    examples, model = _fit(v)
    return forecast.mean_errors(examples.where("held_out"), model).withColumns({c: F.round(c, 5) for c in ("baseline_mae", "model_mae")})


@query("forecast_residual_band", "features", f"WITH {_EXAMPLES} SELECT round(quantile_cont(target - baseline, 0.1), 6) AS p10, round(quantile_cont(target - baseline, 0.9), 6) AS p90 FROM examples WHERE held_out")
def _(v):
    return forecast.residual_band(_examples(v).where("held_out")).select(r("p10").alias("p10"), r("p90").alias("p90"))


_FORWARD = f"""{_EXAMPLES}, band AS (SELECT quantile_cont(target - baseline, 0.1) AS p10, quantile_cont(target - baseline, 0.9) AS p90 FROM examples WHERE held_out),
    known AS (SELECT *, max(day) OVER (PARTITION BY entity_id) AS last FROM features WHERE displacement_km IS NOT NULL), origin AS (SELECT entity_id, max(last) AS last, avg(displacement_km) AS mean FROM known WHERE day > last - 7 GROUP BY 1),
    ahead AS (SELECT entity_id, last + step::INTEGER AS day, step, mean AS predicted, greatest(0, mean + p10 * sqrt(step)) AS low, greatest(greatest(0, mean + p10 * sqrt(step)), mean + p90 * sqrt(step)) AS high FROM origin, band, (SELECT unnest(range(1, 6)) AS step))"""


def _ahead(v: Views, model: forecast.Ridge | None = None) -> DataFrame:
    return forecast.forward(v.features, forecast.residual_band(_examples(v).where("held_out")), 5, model)


@query("forecast_forward", "features", f"WITH {_FORWARD} SELECT entity_id, day, round(predicted, 6) AS predicted, round(low, 6) AS low, round(high, 6) AS high FROM ahead")
def _(v):
    return _ahead(v).select("entity_id", "day", *(r(c).alias(c) for c in ("predicted", "low", "high")))


@query("forecast_timeline", "features", f"WITH {_FORWARD} SELECT day, round(median(displacement_km), 6) AS median, NULL::DOUBLE AS low, NULL::DOUBLE AS high, false AS predicted FROM features GROUP BY 1 UNION ALL SELECT day, round(median(predicted), 6), round(median(low), 6), round(median(high), 6), true FROM ahead GROUP BY 1")
def _(v):
    return forecast.forecast_timeline(v.features, _ahead(v)).withColumns({c: r(c) for c in ("median", "low", "high")})


@query("forecast_recursive_mae", "features", f"WITH {_EXAMPLES}, before AS (SELECT *, max(day) OVER (PARTITION BY entity_id) AS last FROM examples WHERE day < DATE '{CUTOFF}'), anchors AS (SELECT entity_id, avg(displacement_km) AS anchor FROM before WHERE day > last - 7 GROUP BY 1) SELECT count(*) AS n, round(avg(abs(target - anchor)), 6) AS recursive_mae FROM examples JOIN anchors USING (entity_id) WHERE held_out")
def _(v):
    return forecast.recursive_mae(_examples(v), CUTOFF).withColumn("recursive_mae", r("recursive_mae"))


@query("forecast_per_animal", "features", f"WITH {_EXAMPLES}, {_MODEL} SELECT entity_id, count(*) AS n, round(avg(abs(target - (my + slope * (displacement_km - mx)))), 5) AS one_step_mae, round(avg(abs(target - baseline)), 5) AS baseline_mae FROM examples, model WHERE held_out GROUP BY 1")
def _(v):
    examples, model = _fit(v)
    return forecast.per_animal(examples.where("held_out"), model.predict({"displacement_km": F.col("displacement_km")})).withColumns({c: F.round(c, 5) for c in ("one_step_mae", "baseline_mae")})


@query("forecast_own_models", "features", f"""WITH {_EXAMPLES}, own AS (SELECT entity_id, count(*) AS n, count(*) * covar_pop(target, displacement_km) / (count(*) * var_pop(displacement_km) + var_pop(displacement_km)) AS slope, avg(target) AS my, avg(displacement_km) AS mx FROM examples WHERE NOT held_out GROUP BY 1 HAVING count(*) >= 10)
    SELECT entity_id, count(*) AS n_holdout, round(avg(abs(target - (my + slope * (displacement_km - mx)))), 5) AS model_mae FROM examples JOIN own USING (entity_id) WHERE held_out GROUP BY 1 HAVING count(*) >= 5""")
def _(v):
    return forecast.own_models(_examples(v), ["displacement_km"]).select("entity_id", "n_holdout", F.round("model_mae", 5).alias("model_mae"))


_STEPS = f"moves AS (SELECT entity_id, day, cell, lead(day) OVER w AS target_day, lead(cell) OVER w AS target_cell FROM tracks WINDOW w AS (PARTITION BY entity_id ORDER BY day)), cases AS (SELECT *, target_day >= DATE '{CUTOFF}' AS held_out FROM moves WHERE target_day - day = 1), trans AS (SELECT cell, target_cell AS next_cell, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, min((entity_id, day))) AS place FROM cases WHERE NOT held_out GROUP BY cell, target_cell)"
_TRACKS = "tracks AS (SELECT entity_id, day, 'g' || floor(longitude * 200)::BIGINT AS cell FROM daily)"


def _tracks(v: Views) -> DataFrame:
    return v.daily.select("entity_id", "day", F.concat(F.lit("g"), F.floor(F.col("longitude") * 200).cast("string")).alias("cell"))


@query("cell_transition_forecast", "daily", f"WITH {_TRACKS}, {_STEPS} SELECT c.entity_id, count(*) AS n, round(avg((coalesce(t.next_cell, c.cell) = c.target_cell)::INTEGER), 6) AS model_accuracy, round(avg((c.cell = c.target_cell)::INTEGER), 6) AS baseline_accuracy FROM cases c LEFT JOIN trans t ON t.cell = c.cell AND t.place = 1 WHERE c.held_out GROUP BY 1")
def _(v):
    return forecast.next_cell_accuracy(forecast.cell_examples(_tracks(v), CUTOFF)).withColumns({c: r(c) for c in ("model_accuracy", "baseline_accuracy")})


@query("cell_transition_forward", "daily", f"WITH {_TRACKS}, {_STEPS}, best AS (SELECT cell, next_cell FROM trans WHERE place = 1), o AS (SELECT entity_id, max(day) AS last, arg_max(cell, day) AS cell FROM tracks GROUP BY 1), s1 AS (SELECT o.entity_id, last, coalesce(next_cell, o.cell) AS cell FROM o LEFT JOIN best ON best.cell = o.cell), s2 AS (SELECT s1.entity_id, last, coalesce(next_cell, s1.cell) AS cell FROM s1 LEFT JOIN best ON best.cell = s1.cell) SELECT entity_id, 1 AS step, last + 1 AS day, cell FROM s1 UNION ALL SELECT entity_id, 2, last + 2, cell FROM s2")
def _(v):
    tracks = _tracks(v)
    return forecast.next_cell_forward(tracks, forecast.cell_examples(tracks, CUTOFF), 2)


@query("feature_coverage", "datasets", """SELECT family, greatest(min("start"), DATE '2024-03-01') AS "start", least(max("end"), DATE '2024-08-01') AS "end" FROM datasets GROUP BY 1""")
def _(v):
    return catalog.family_coverage(v.datasets, *(F.lit(x).cast("date") for x in _SPAN))
