"""The driver's tables seen as tracks, rainfall, vegetation, cells, pixels, boundaries and dataset descriptors.

Each view is defined twice with the same expressions: as a DataFrame and as SQL for DuckDB.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import FLATTENING, INVERSE_STEPS, SEMI_MAJOR, box_ring
from ..operators import joins
from ..operators.movement import daily_movement

WEST, SOUTH = 36.85, -1.60
FIRST_DAY = "2024-01-01"


class Views:
    """Lazy views over the tables in a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def fixes(self) -> DataFrame:
        user, event = F.col("user_id"), F.col("event_id")
        return self.table("events").select(
            F.concat(F.lit("events:1:"), user.cast("string")).alias("entity_id"), event.cast("string").alias("source_record_id"), F.col("ts").alias("observed_at"),
            (F.lit(WEST) + (user % 25) * 0.01 + (event % 7) * 0.001).alias("longitude"), (F.lit(SOUTH) + (user % 20) * 0.01 + (event % 11) * 0.001).alias("latitude"),
            F.when(F.col("event_type") == "error", "marked_outlier").otherwise("ok").alias("quality_flag"), F.lit("gps").alias("sensor_type"),
            F.concat(F.lit("c"), (user % 25).cast("string")).alias("cell"), F.col("props").alias("attributes"), (F.col("ts") + F.expr("interval 1 hour")).alias("available_at"), "value", "event_type",
        )

    @cached_property
    def rain(self) -> DataFrame:
        day = F.date_trunc("day", "observed_at").cast("timestamp_ntz")
        daily = self.fixes.where("event_type = 'view'").groupBy("cell", day.alias("interval_start")).agg(F.sum("value").alias("rainfall_mm"))
        return daily.select("cell", "interval_start", (F.col("interval_start") + F.expr("interval 1 day")).alias("interval_end"), "rainfall_mm", (F.col("interval_start") + F.expr("interval 2 days")).alias("available_at"))

    @cached_property
    def vegetation(self) -> DataFrame:
        return self.fixes.where("event_type = 'signup'").select(
            "cell", "observed_at", (F.col("observed_at") + F.expr("interval 16 days")).alias("observed_until"), F.least(F.col("value") / 500, F.lit(1.0)).alias("index_value"), "source_record_id",
            F.floor(F.datediff("observed_at", F.lit(FIRST_DAY)) / 8).cast("int").alias("composite"))

    @cached_property
    def cell_obs(self) -> DataFrame:
        late = F.make_dt_interval(F.col("l_linenumber"))
        return self.table("lineitem").select(
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("series_id"), (F.col("l_partkey") % 500).alias("cell"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("source_item_id"),
            F.col("l_linenumber").alias("added_in_version"), F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") + 2).alias("superseded_in_version"), F.when(F.col("l_linestatus") == "F", "final").otherwise("preliminary").alias("product_status"),
            F.col("l_returnflag").alias("processing_version"), F.lit("1").alias("mapping_version"), (1 - F.col("l_discount")).alias("valid_fraction"), F.col("l_shipdate").alias("time_start"), (F.col("l_shipdate") + late).alias("available_at"),
            F.col("l_quantity").alias("value"), F.element_at(F.array(*map(F.lit, ("ndvi", "evi", "rain"))), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("variable"), F.lit("lineitem").alias("source_id"))

    @cached_property
    def pixels(self) -> DataFrame:
        return self.table("lineitem").select((F.col("l_partkey") % 500).alias("cell"), F.col("l_extendedprice").alias("nir"), (F.col("l_quantity") * 100).alias("red"), F.col("l_linenumber").alias("scl"), F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x"))

    @cached_property
    def boundaries(self) -> DataFrame:
        key = F.col("n_nationkey")
        west, south = F.lit(WEST) + (key % 5) * 0.05, F.lit(SOUTH) + F.floor(key / 5) * 0.05
        return self.table("nation").select(F.col("n_name").alias("name"), west.alias("west"), south.alias("south"), (west + 0.05).alias("east"), (south + 0.05).alias("north"), box_ring(west, south, west + 0.05, south + 0.05).alias("rings"))

    @cached_property
    def datasets(self) -> DataFrame:
        boxes = self.boundaries.join(self.table("nation").select(F.col("n_name").alias("name"), "n_nationkey"), "name").withColumnRenamed("n_nationkey", "s_nationkey")
        key = F.col("s_suppkey")
        start = F.date_add(F.lit(FIRST_DAY).cast("date"), (key % 400).cast("int"))
        even = lambda c: F.when(key % 7 != 0, F.col(c))
        return self.table("supplier").join(boxes, "s_nationkey").select(
            F.concat(F.lit("d"), (key / 3).cast("long").cast("string")).alias("dataset_id"), (key % 3).cast("int").alias("version"), F.when(key % 5 == 0, "private").otherwise("public").alias("access_scope"), F.when(key % 11 == 0, "draft").otherwise("ready").alias("status"),
            F.when(key % 2 == 0, "cells").otherwise("animals").alias("family"), F.col("s_name").alias("description"), *(even(c).alias(c) for c in ("west", "south", "east", "north")), start.alias("start"), F.date_add(start, (key % 90).cast("int")).alias("end"),
            F.when(key % 2 == 0, F.array(F.lit("ndvi"), F.lit("rain"))).otherwise(F.array(F.lit("fixes"))).alias("variables"), F.array(F.concat(F.lit("t"), (key % 4).cast("string"))).alias("tags"))

    @cached_property
    def daily(self) -> DataFrame:
        """Distances to the micrometre: beyond it, two engines' sines differ, and equal steps must tie in ranks."""
        return daily_movement(self.fixes).withColumn("displacement_km", F.round("displacement_km", 9))

    @cached_property
    def features(self) -> DataFrame:
        """Days with the rain of the seven days before and the last vegetation value."""
        days = self.daily.withColumn("at", F.col("day").cast("timestamp_ntz"))
        wet = joins.window_sum(days, self.rain, ["cell"], "at", "interval_start", "interval_end", "rainfall_mm", "rainfall", 7 * 86_400)
        return joins.asof_join(wet, self.vegetation, ["cell"], "at", "observed_at", "source_record_id", 30 * 86_400, ["index_value"]).drop("at").withColumnRenamed("index_value", "vegetation_index")


def r(column: Column | str) -> Column:
    """Rounded as in the SQL."""
    return F.round(column, 6)


def spheroid_sql(source: str, lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """``source`` with km on the WGS84 ellipsoid: the steps of the inverse formula one below the other."""
    f, flat, b = f"{FLATTENING!r}::DOUBLE", f"{1 - FLATTENING!r}::DOUBLE", SEMI_MAJOR * (1 - FLATTENING)
    arc = """sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs, atan2(ss, cs) AS sigma, CASE WHEN ss = 0 THEN 0e0 ELSE c1 * c2 * sin(lam) / ss END AS sa,
        1 - sa * sa AS ca2, CASE WHEN ca2 < 1e-15 THEN 0e0 ELSE cs - 2 * s1 * s2 / ca2 END AS cm"""
    made = "ss, cs, sigma, sa, ca2, cm"
    out = f"""SELECT *, radians((({lon2}) - ({lon1}) + 180 + 360) % 360 - 180) AS dlon, {flat} * tan(radians({lat1})) AS t1, {flat} * tan(radians({lat2})) AS t2, 1 / sqrt(1 + t1 * t1) AS c1, t1 * c1 AS s1, 1 / sqrt(1 + t2 * t2) AS c2, t2 * c2 AS s2, dlon AS lam, 1e0 AS moved FROM {source}"""
    for _ in range(INVERSE_STEPS):
        out = f"""SELECT * EXCLUDE ({made}, lam, moved, c, new), new AS lam, abs(new - lam) AS moved FROM (SELECT *, {arc}, {f} / 16 * ca2 * (4 + {f} * (4 - 3 * ca2)) AS c,
            dlon + (1 - c) * {f} * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))) AS new FROM ({out}))"""
    far = f"12742.0176e0 * asin(sqrt(least(1e0, pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))))"
    return f"""SELECT * EXCLUDE ({made}, dlon, t1, t2, c1, s1, c2, s2, lam, moved, u, big_a, big_b), CASE WHEN moved < 1e-9 THEN {b / 1000!r}::DOUBLE * big_a * (sigma - big_b * ss * (cm + big_b / 4 * (cs * (2 * cm * cm - 1)
        - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) WHEN moved IS NOT NULL THEN {far} END AS km FROM (SELECT *, {arc}, ca2 * {(SEMI_MAJOR**2 - b**2) / b**2!r}::DOUBLE AS u,
        1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big_a, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS big_b FROM ({out}))"""


SQL_VIEWS = {
    "fixes": """SELECT 'events:1:' || user_id AS entity_id, event_id::VARCHAR AS source_record_id, ts AS observed_at,
        36.85e0 + (user_id % 25) * 0.01e0 + (event_id % 7) * 0.001e0 AS longitude, -1.60e0 + (user_id % 20) * 0.01e0 + (event_id % 11) * 0.001e0 AS latitude,
        CASE WHEN event_type = 'error' THEN 'marked_outlier' ELSE 'ok' END AS quality_flag, 'gps' AS sensor_type, 'c' || (user_id % 25) AS cell, props AS attributes,
        ts + INTERVAL 1 HOUR AS available_at, value, event_type FROM events""",
    "rain": """SELECT cell, date_trunc('day', observed_at)::TIMESTAMP AS interval_start, date_trunc('day', observed_at)::TIMESTAMP + INTERVAL 1 DAY AS interval_end, sum(value) AS rainfall_mm,
        date_trunc('day', observed_at)::TIMESTAMP + INTERVAL 2 DAY AS available_at FROM fixes WHERE event_type = 'view' GROUP BY cell, date_trunc('day', observed_at)""",
    "vegetation": """SELECT cell, observed_at, observed_at + INTERVAL 16 DAY AS observed_until, least(value / 500, 1.0e0) AS index_value, source_record_id,
        ((observed_at::DATE - DATE '2024-01-01') // 8)::INTEGER AS composite FROM fixes WHERE event_type = 'signup'""",
    "cell_obs": """SELECT 's' || l_suppkey AS series_id, l_partkey % 500 AS cell, l_orderkey || '-' || l_linenumber AS source_item_id, l_linenumber AS added_in_version,
        CASE WHEN l_returnflag = 'R' THEN l_linenumber + 2 END AS superseded_in_version, CASE WHEN l_linestatus = 'F' THEN 'final' ELSE 'preliminary' END AS product_status, l_returnflag AS processing_version,
        '1' AS mapping_version, 1 - l_discount AS valid_fraction, l_shipdate AS time_start, l_shipdate + to_days(l_linenumber) AS available_at, l_quantity AS value,
        (['ndvi', 'evi', 'rain'])[l_linenumber % 3 + 1] AS variable, 'lineitem' AS source_id FROM lineitem""",
    "pixels": "SELECT l_partkey % 500 AS cell, l_extendedprice AS nir, l_quantity * 100 AS red, l_linenumber AS scl, l_orderkey AS y, l_linenumber AS x FROM lineitem",
    "boundaries": """SELECT n_name AS name, n_nationkey, 36.85e0 + (n_nationkey % 5) * 0.05e0 AS west, -1.60e0 + (n_nationkey // 5) * 0.05e0 AS south,
        36.85e0 + (n_nationkey % 5) * 0.05e0 + 0.05e0 AS east, -1.60e0 + (n_nationkey // 5) * 0.05e0 + 0.05e0 AS north FROM nation""",
    "datasets": """SELECT 'd' || (s_suppkey // 3) AS dataset_id, (s_suppkey % 3)::INTEGER AS version, CASE WHEN s_suppkey % 5 = 0 THEN 'private' ELSE 'public' END AS access_scope,
        CASE WHEN s_suppkey % 11 = 0 THEN 'draft' ELSE 'ready' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'cells' ELSE 'animals' END AS family, s_name AS description,
        CASE WHEN s_suppkey % 7 <> 0 THEN west END AS west, CASE WHEN s_suppkey % 7 <> 0 THEN south END AS south, CASE WHEN s_suppkey % 7 <> 0 THEN east END AS east, CASE WHEN s_suppkey % 7 <> 0 THEN north END AS north,
        DATE '2024-01-01' + (s_suppkey % 400)::INTEGER AS "start", DATE '2024-01-01' + (s_suppkey % 400)::INTEGER + (s_suppkey % 90)::INTEGER AS "end",
        CASE WHEN s_suppkey % 2 = 0 THEN ['ndvi', 'rain'] ELSE ['fixes'] END AS variables, ['t' || (s_suppkey % 4)] AS tags FROM supplier JOIN boundaries ON n_nationkey = s_nationkey""",
    "last_fixes": """SELECT *, observed_at::DATE AS day, row_number() OVER (PARTITION BY entity_id, observed_at::DATE ORDER BY observed_at DESC, source_record_id DESC) AS place,
        count(*) OVER (PARTITION BY entity_id, observed_at::DATE) AS fix_count FROM fixes WHERE quality_flag = 'ok'""",
    "steps": """SELECT *, lag(day) OVER w AS pday, lag(longitude) OVER w AS plon, lag(latitude) OVER w AS plat, lag(available_at) OVER w AS pavailable
        FROM last_fixes WHERE place = 1 WINDOW w AS (PARTITION BY entity_id ORDER BY day)""",
    "measured": spheroid_sql("steps", "plon", "plat", "longitude", "latitude"),
    "daily": """SELECT entity_id, day, longitude, latitude, cell, fix_count, CASE WHEN day - pday = 1 THEN round(km, 9) END AS displacement_km,
        CASE WHEN day - pday = 1 THEN greatest(available_at, pavailable) ELSE available_at END AS available_at FROM measured""",
    "latest_vegetation": """SELECT d.entity_id, d.day, v.index_value, row_number() OVER (PARTITION BY d.entity_id, d.day ORDER BY v.observed_at DESC, v.source_record_id) AS place
        FROM daily d JOIN vegetation v ON v.cell = d.cell AND v.observed_at <= d.day::TIMESTAMP AND v.observed_at >= d.day::TIMESTAMP - INTERVAL 30 DAY""",
    "wet": """SELECT d.entity_id, d.day, sum(r.rainfall_mm) AS rainfall FROM daily d JOIN rain r ON r.cell = d.cell AND r.interval_start >= d.day::TIMESTAMP - INTERVAL 7 DAY AND r.interval_end <= d.day::TIMESTAMP GROUP BY d.entity_id, d.day""",
    "features": """SELECT d.*, w.rainfall, v.index_value AS vegetation_index FROM daily d LEFT JOIN wet w ON w.entity_id = d.entity_id AND w.day = d.day
        LEFT JOIN latest_vegetation v ON v.entity_id = d.entity_id AND v.day = d.day AND v.place = 1""",
}
#: What each view reads besides tables.
_NEEDS = {"rain": ["fixes"], "vegetation": ["fixes"], "datasets": ["boundaries"], "last_fixes": ["fixes"], "steps": ["last_fixes"], "measured": ["steps"], "daily": ["measured"], "latest_vegetation": ["daily", "vegetation"], "wet": ["daily", "rain"], "features": ["wet", "latest_vegetation"]}


def with_views(names: str, select: str) -> str:
    """``select`` after the named views and those that they read; a select may begin with further views."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    views = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order)
    rest = select.strip()
    if not views:
        return rest
    return f"WITH {views},\n{rest[5:]}" if rest.startswith("WITH ") else f"WITH {views}\n{rest}"
