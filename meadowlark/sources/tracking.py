"""Readers of tracking exports, deployments, points and boundaries; writers of feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import cell_id
from ..operators.relational import CheckFailed, in_bbox
from ..operators.stats import fix_flag

# Headers of the tracking format.
REQUIRED = ("event-id", "timestamp", "location-long", "location-lat", "individual-local-identifier")
MAPPED = (*REQUIRED, "visible", "sensor-type", "tag-local-identifier")


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.replace("_", "-") for c in df.columns))


def with_event_ids(df: DataFrame, study: str) -> DataFrame:
    """If any event id is missing, all become ``synthetic:`` and 24 hex digits of a hash of study, animal and time."""
    name = F.concat_ws("|", F.lit(study), F.col("`individual-local-identifier`"), F.col("timestamp"))
    synthetic = F.concat(F.lit("synthetic:"), F.substring(F.sha2(name, 256), 1, 24))
    if "event-id" in df.columns and df.where(F.col("`event-id`").isNull()).isEmpty():
        return df
    return df.withColumn("event-id", synthetic)


def read_tracking(df: DataFrame, source: str, study: str, aoi: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Rows of a tracking export (all text) as fixes. Missing required columns fail; rows without time or place go.

    The sensor is ``gps`` without such a column, ``unknown`` where it is null; other columns are kept as JSON.
    """
    if lost := [c for c in REQUIRED if c not in df.columns]:
        raise CheckFailed("MISSING_COLUMNS", ", ".join(lost))
    col = lambda name: F.col(f"`{name}`")
    sensor = F.coalesce(col("sensor-type"), F.lit("unknown")) if "sensor-type" in df.columns else F.lit("gps")
    quality = fix_flag(col("visible")) if "visible" in df.columns else F.lit("ok")
    rest = [col(c) for c in df.columns if c not in MAPPED]
    fixes = df.select(
        col("event-id").alias("source_record_id"),
        F.concat_ws(":", F.lit(source), F.lit(study), col("individual-local-identifier")).alias("entity_id"),
        (col("tag-local-identifier") if "tag-local-identifier" in df.columns else F.lit(None).cast("string")).alias("tag_id"),
        F.try_to_timestamp(col("timestamp")).alias("observed_at"),
        col("location-long").try_cast("double").alias("longitude"), col("location-lat").try_cast("double").alias("latitude"),
        sensor.alias("sensor_type"), quality.alias("quality_flag"), (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("attributes"),
    ).dropna(subset=["longitude", "latitude", "observed_at"])
    fixes = in_bbox(fixes, "longitude", "latitude", aoi) if aoi else fixes
    return fixes.withColumn("cell_id", cell_id(F.col("longitude"), F.col("latitude")))


def tracking_report(df: DataFrame) -> DataFrame:
    """One row on an export that ``read_tracking`` takes: rows, and those that it leaves out by their first reason, missing
    (no time or place), bad_time, bad_place (text that can't be read); then outside_wgs84, rows kept beyond the globe."""
    at, x, y = (F.col(f"`{c}`") for c in ("timestamp", "location-long", "location-lat"))
    lon, lat = x.try_cast("double"), y.try_cast("double")
    missing = at.isNull() | x.isNull() | y.isNull()
    bad_time = ~missing & F.try_to_timestamp(at).isNull()
    bad_place = ~missing & ~bad_time & (lon.isNull() | lat.isNull())
    kept = ~missing & ~bad_time & ~bad_place
    outside = kept & ~(lon.between(-180, 180) & lat.between(-90, 90))
    return df.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(name) for name, c in (("missing", missing), ("bad_time", bad_time), ("bad_place", bad_place), ("kept", kept), ("outside_wgs84", outside))))


def flatten_individuals(df: DataFrame) -> DataFrame:
    """Nested ``individuals[].locations[]`` with epoch milliseconds as flat rows."""
    each = df.select(F.explode("individuals").alias("i")).select("i.individual_local_identifier", F.explode("i.locations").alias("at"))
    return each.select("individual_local_identifier", F.timestamp_millis("at.timestamp").alias("timestamp"), F.col("at.location_long").alias("location_long"), F.col("at.location_lat").alias("location_lat"))


def deployments(reference: DataFrame, animal: str = "animal-id") -> DataFrame:
    """A row an animal: first non-null taxon, sex, stage and site, least deploy-on, greatest deploy-off, sorted deployments."""
    col = lambda name: F.col(f"`{name}`")
    first = [F.first(col(c), ignorenulls=True).alias(c) for c in ("animal-taxon", "animal-sex", "animal-life-stage", "study-site") if c in reference.columns]
    return reference.groupBy(col(animal)).agg(*first, F.min(col("deploy-on-date")).alias("deploy_on"), F.max(col("deploy-off-date")).alias("deploy_off"), F.array_sort(F.collect_list(F.struct(col("deploy-on-date"), col("deploy-off-date")))).alias("deployments"))


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows with latitude and longitude columns under their usual names; a missing or bad coordinate fails."""
    df = spark.read.csv(path, header=True)
    plain = {c: c.lstrip("﻿").strip().lower() for c in df.columns}
    pick = lambda names: next((c for c, p in plain.items() if p in names), None)
    lat, lon = pick(("lat", "latitude")), pick(("lon", "lng", "longitude"))
    if not lat or not lon:
        raise CheckFailed("MISSING_COLUMNS", "latitude and longitude")
    x, y = F.col(f"`{lon}`").try_cast("double"), F.col(f"`{lat}`").try_cast("double")
    out = df.withColumns({"lon": x, "lat": y})
    if not out.where(F.coalesce(~F.col("lon").between(-180, 180) | ~F.col("lat").between(-90, 90), F.lit(True))).isEmpty():
        raise CheckFailed("BAD_COORDINATE", path)
    return out


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(type, geometry, properties) of a FeatureCollection, a Feature or a bare geometry; texts are JSON."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    kind = F.get_json_object("t", "$.type")
    features = F.when(kind == "FeatureCollection", F.from_json(F.get_json_object("t", "$.features"), "array<string>")).otherwise(F.array("t"))
    each = text.select(F.explode(features).alias("f"))
    is_feature = F.get_json_object("f", "$.type") == "Feature"
    geometry = F.when(is_feature, F.get_json_object("f", "$.geometry")).otherwise(F.col("f"))
    out = each.select(geometry.alias("geometry"), F.when(is_feature, F.get_json_object("f", "$.properties")).alias("properties"))
    return out.select(F.get_json_object("geometry", "$.type").alias("type"), "geometry", "properties")


def read_boundaries(features: DataFrame) -> DataFrame:
    """(name, rings) of polygons and multipolygons; other and empty geometries are left out."""
    point = "array<array<array<double>>>"
    parts = F.when(F.col("type") == "Polygon", F.from_json(F.get_json_object("geometry", "$.coordinates"), point)).when(F.col("type") == "MultiPolygon", F.flatten(F.from_json(F.get_json_object("geometry", "$.coordinates"), f"array<{point}>")))
    rings = F.transform(parts, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return features.select(F.get_json_object("properties", "$.name").alias("name"), rings.alias("rings")).where(F.size("rings") > 0)


def scan_pinned(df: DataFrame, dataset: str, version: int, scope: str, columns: Sequence[str]) -> DataFrame:
    return df.where((F.col("dataset_id") == dataset) & (F.col("version") == version) & (F.col("access_scope") == scope)).select(*columns)


def read_features(spark: SparkSession, path: str, columns: Sequence[str], filters: dict[str, object] | None = None) -> DataFrame:
    """Projection and equality filters reach the scan; unknown filter columns fail."""
    df = spark.read.parquet(path)
    if unknown := set(filters or {}) - set(df.columns):
        raise CheckFailed("UNKNOWN_COLUMN", ", ".join(sorted(unknown)))
    for c, v in (filters or {}).items():
        df = df.where(F.col(c) == v)
    return df.select(*columns)


def write_features(df: DataFrame, path: str, columns: dict[str, dict], keys: Sequence[str]) -> None:
    """Columns {name: {type, unit, role, …}} as Parquet with descriptors as metadata; empty or repeated keys fail."""
    from ..operators.checks import check_unique

    out = df.select(*(F.col(name).cast(d["type"]).alias(name, metadata={k: v for k, v in d.items() if k != "type"}) for name, d in columns.items()))
    if out.isEmpty():
        raise CheckFailed("EMPTY_OUTPUT", path)
    check_unique(out, keys, nonnull=True)
    out.write.parquet(path)


def pixels(df: DataFrame, aoi: tuple[float, float, float, float] | None = None) -> DataFrame:
    return in_bbox(df, "x", "y", aoi) if aoi else df


def align(reference: DataFrame, coarse: DataFrame, size: float, bands: Sequence[str]) -> DataFrame:
    """Bands of a coarser pixel table on the reference's pixels, by the coarse pixel that holds each."""
    at = lambda axis: F.floor(F.col(axis) / size)
    side = coarse.select("scene_id", at("x").alias("_i"), at("y").alias("_j"), *bands)
    return reference.withColumns({"_i": at("x"), "_j": at("y")}).join(side, ["scene_id", "_i", "_j"], "left").drop("_i", "_j")


def clear_scenes(df: DataFrame, max_cloud: float = 80, prefix: str = "") -> DataFrame:
    return df.where((F.col("cloud_cover") <= max_cloud) & F.col("item_id").startswith(prefix))


def text_day_range(start: Column, end: Column) -> tuple[Column, Column]:
    """Times of a range; a bare date as the end means its whole day."""
    last = F.when(F.length(end) == 10, F.to_timestamp_ntz(F.concat(end, F.lit(" 23:59:59.999999")))).otherwise(F.to_timestamp_ntz(end))
    return F.to_timestamp_ntz(start), last
