"""Tables as append-only series of batches: versions, live batches, current rows, supersession."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import lonlat_bounds
from .joins import expand_versions
from .relational import collected, latest


def batch_key(*parts: Column) -> Column:
    """source|item|processing|status|mapping."""
    return F.concat_ws("|", *parts)


def series_id(source: Column, product: Column, grid: Column, study: Column | None = None) -> Column:
    """source--product--grid, and --study-<id> for a study."""
    base = F.concat_ws("--", source, product, grid)
    return base if study is None else F.when(study.isNull(), base).otherwise(F.concat(base, F.lit("--study-"), study))


def live_batches(registry: DataFrame, version: Column | int | None = None) -> DataFrame:
    """Batches of a version: added by then and not superseded by then; without a version, those never superseded."""
    gone = F.col("superseded_in_version")
    if version is None:
        return registry.where(gone.isNull())
    return registry.where((F.col("added_in_version") <= version) & (gone.isNull() | (gone > version)))


def current_cells(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row a cell, variable, source and UTC day: final ones first, then the latest processing and mapping versions,
    the largest valid fraction, the latest availability, and the largest item id. ``keys`` come before these keys."""
    order = [F.when(F.col("product_status") == "final", 0).otherwise(1), F.desc("processing_version"), F.desc("mapping_version"), F.desc("valid_fraction"), F.desc("available_at"), F.desc("source_item_id")]
    return latest(rows.withColumn("day", F.to_date("time_start")), [*keys, "cell", "variable", "source_id", "day"], *order)


def current_fixes(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row an entity, time and sensor: of the latest version, then of the largest record id."""
    return latest(rows, [*keys, "entity_id", "observed_at", "sensor_type"], F.desc("added_in_version"), F.desc("source_record_id"))


def current_at(rows: DataFrame, version: int | None = None, cutoff: object | None = None) -> DataFrame:
    """Current cell rows of a version, or as they could be seen at ``cutoff``: availability is tested before ranking."""
    seen = live_batches(rows, version)
    return current_cells(seen if cutoff is None else seen.where(F.col("available_at") <= cutoff))


# The vegetation indices.
INDICES = ("ndvi", "evi", "mndwi", "ndmi")


def _ready(datasets: DataFrame, family: str) -> DataFrame:
    """(series_id, version, access_scope) of the ready datasets of a family; a dataset's id is that of its series."""
    return datasets.where((F.col("status") == "ready") & (F.col("family") == family)).select(F.col("dataset_id").alias("series_id"), "version", "access_scope")


def recipe_cells(datasets: DataFrame, batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Current cell rows of each ready dataset version: those of its live batches, one a cell, variable, source and day."""
    live = expand_versions(_ready(datasets, "cell_observations"), batches.select("series_id", "batch_key", "added_in_version", "superseded_in_version"), rows)
    return current_cells(live, ["series_id", "version", "access_scope"]).withColumnRenamed("series_id", "dataset_id")


def recipe_rainfall(datasets: DataFrame, batches: DataFrame, rows: DataFrame, variable: str = "rainfall_mm") -> DataFrame:
    """Rain by dataset version, cell and interval."""
    cells = recipe_cells(datasets, batches, rows.where(F.col("variable") == variable))
    return cells.select("dataset_id", "version", "access_scope", F.col("source_item_id").alias("source_record_id"), "cell", F.col("time_start").alias("interval_start"), F.col("value").alias("rainfall_mm"), "available_at", "product_status", "valid_fraction")


def recipe_vegetation(datasets: DataFrame, batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Vegetation indices by dataset version, cell and acquisition."""
    cells = recipe_cells(datasets, batches, rows.where(F.col("variable").isin(*INDICES)))
    return cells.select("dataset_id", "version", "access_scope", F.col("source_item_id").alias("source_record_id"), "cell", F.col("time_start").alias("observed_at"), F.col("variable").alias("index_name"), F.col("value").alias("index_value"), "available_at", "valid_fraction")


def recipe_animals(datasets: DataFrame, batches: DataFrame, fixes: DataFrame, entities: DataFrame) -> DataFrame:
    """Fixes by dataset version; of an animal, time and sensor that of the latest batch, then of the largest record id.

    ``entities`` gives entity_id and taxon_name; fixes of unknown animals are left out.
    """
    live = expand_versions(_ready(datasets, "animal_locations"), batches.select("series_id", "batch_key", "added_in_version", "superseded_in_version"), fixes)
    current = current_fixes(live, ["series_id", "version", "access_scope"])
    named = entities.select(F.col("entity_id").alias("_entity"), F.col("taxon_name").alias("species"))
    return current.join(named, F.col("entity_id") == F.col("_entity")).drop("_entity").withColumnRenamed("series_id", "dataset_id")


def not_ingested(items: DataFrame, registry: DataFrame, keys: Sequence[str] = ("source_item_id", "processing_version", "product_status")) -> DataFrame:
    return items.join(registry.select(*keys).distinct(), list(keys), "left_anti")


def append_batch(registry: DataFrame, batches: DataFrame) -> DataFrame:
    """The registry with new batches: known (series_id, batch_key) are left out, so that a repeat changes nothing.

    The new batches of a series get the version after its latest. ``batches`` has series_id, batch_key and
    ``supersedes`` (an array of batch keys that go out of force in that version, or null). One writer a series.
    """
    fresh = batches.join(registry.select("series_id", "batch_key"), ["series_id", "batch_key"], "left_anti")
    last = registry.groupBy("series_id").agg(F.max(F.greatest("added_in_version", F.coalesce("superseded_in_version", F.lit(0)))).alias("last"))
    numbered = fresh.join(last, "series_id", "left").withColumn("added_in_version", F.coalesce("last", F.lit(0)) + 1)
    gone = numbered.select("series_id", F.explode("supersedes").alias("batch_key"), F.col("added_in_version").alias("_gone")).distinct()
    old = registry.join(gone, ["series_id", "batch_key"], "left").withColumn("superseded_in_version", F.coalesce("superseded_in_version", "_gone")).select(registry.columns)
    added = numbered.withColumn("superseded_in_version", F.lit(None).cast("int"))
    return old.unionByName(added.select(*[c for c in added.columns if c in registry.columns]), allowMissingColumns=True)


def series_summary(rows: DataFrame, by: Sequence[str], taxon: str = "") -> DataFrame:
    """First start, last end, rows, sorted variables and number of cells; the sorted taxa too, if a column is named."""
    taxa = [F.array_sort(F.collect_set(taxon)).alias("taxa")] if taxon else []
    return rows.groupBy(*by).agg(F.min("time_start").alias("first_start"), F.max("time_start").alias("last_start"), F.count("*").alias("row_count"),
                                 F.array_sort(F.collect_set("variable")).alias("variables"), F.count_distinct("cell").alias("cells"), *taxa)


def merged_json(old: Column, new: Column) -> Column:
    """Two JSON objects as one: of a key in both, the new value; null beside an object counts as empty."""
    kind = "map<string,variant>"
    before, after = F.from_json(old, kind), F.from_json(new, kind)
    both = F.map_concat(F.map_filter(before, lambda k, _: ~F.map_contains_key(after, k)), after)
    return F.when(before.isNull(), new).when(after.isNull(), old).otherwise(F.to_json(both))


def new_cells(observations: DataFrame, cell: str = "cell") -> DataFrame:
    """(series_id, cell, version): each cell of a series with the version that first had it, so what a version adds to those
    before it. One grouping, for all versions at once; rows without a series, cell or version add nothing."""
    known = observations.where(F.col("series_id").isNotNull() & F.col(cell).isNotNull() & F.col("added_in_version").isNotNull())
    return known.groupBy("series_id", cell).agg(F.min("added_in_version").alias("version"))


def upsert_entities(current: DataFrame, new: DataFrame, key: str = "entity_id", texts: Sequence[str] = (), first: Sequence[str] = (), last: Sequence[str] = (), objects: Sequence[str] = ()) -> DataFrame:
    """Current entities with new values: texts are replaced by non-null ones, ``first`` keep the least, ``last`` the
    greatest, and JSON ``objects`` are merged by key."""
    both = current.select(key, *(F.col(c).alias(f"_old_{c}") for c in (*texts, *first, *last, *objects))).join(new.select(key, *texts, *first, *last, *objects), key, "full")
    merged = (merged_json(F.col(f"_old_{c}"), F.col(c)).alias(c) for c in objects)
    return both.select(key, *(F.coalesce(c, f"_old_{c}").alias(c) for c in texts), *(F.least(c, f"_old_{c}").alias(c) for c in first), *(F.greatest(c, f"_old_{c}").alias(c) for c in last), *merged)


def split_by_study(registry: DataFrame, manifest: str = "raw_manifest", path: str = "$.study") -> DataFrame:
    """Batches of a mixed series as series of one study each, with new_series_id, new_version and new_superseded.

    The versions of a new series are those in which one of its own batches came or went, numbered from 1; a batch goes in
    the version in which it went before. Batches without a study stay in their series. Numbers meet batches by series and
    version, so that a series of many batches is spread over its versions.
    """
    study = F.get_json_object(manifest, path)
    own = F.when(study.isNull(), F.col("series_id")).otherwise(F.concat("series_id", F.lit("--study-"), study))
    split = registry.withColumn("new_series_id", own)
    events = split.select("new_series_id", F.explode(F.array_compact(F.array("added_in_version", "superseded_in_version"))).alias("_event")).distinct()
    numbers = events.withColumn("_number", F.row_number().over(Window.partitionBy("new_series_id").orderBy("_event")))
    added = numbers.select("new_series_id", F.col("_event").alias("added_in_version"), F.col("_number").alias("new_version"))
    gone = numbers.select("new_series_id", F.col("_event").alias("superseded_in_version"), F.col("_number").alias("new_superseded"))
    both = split.join(added, ["new_series_id", "added_in_version"], "left").join(gone, ["new_series_id", "superseded_in_version"], "left")
    return both.select(*registry.columns, "new_series_id", "new_version", "new_superseded")


# What the tags of every study say.
STUDY_TAGS = ("sensor_type:gps", "temporal_resolution:sub_daily", "study_design:gps_collar")


def study_datasets(split: DataFrame, fixes: DataFrame, entities: DataFrame, manifest: str = "raw_manifest", title: str = "$.title") -> DataFrame:
    """A dataset for each series of ``split_by_study``: its last version and, of its batches in force, what they cover.

    dataset_id, version, description, artifacts, row_count, start, end, west, south, east, north, cells, species, tags. The
    description is the title in the manifest of the latest batch that has one, without a leading "Data from: ". Artifacts are the batches'
    items by version and item. Species are the known ones of ``entities`` (entity_id, taxon_name), sorted; tags those of
    every study and a year for each from the first fix to the last. Series without fixes in force have no years and no box.
    Fixes meet their batch by (series_id, batch_key), once, and are summed by batch before batches are.
    """
    text = F.nullif(F.regexp_replace(F.get_json_object(manifest, title), "^Data from: ", ""), F.lit(""))
    current = F.col("new_superseded").isNull()
    item = F.when(current, F.struct("new_version", "source_item_id"))
    head = split.groupBy("new_series_id").agg(
        F.max(F.greatest("new_version", F.coalesce("new_superseded", F.lit(0)))).alias("version"), F.max_by(text, F.when(text.isNotNull(), F.struct("new_version", "batch_key"))).alias("description"),
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["source_item_id"]).alias("artifacts"))
    live = split.where(current).select("series_id", "batch_key", "new_series_id")
    named = fixes.join(entities.select("entity_id", "taxon_name"), "entity_id", "left").join(live, ["series_id", "batch_key"])
    ends = [F.min("observed_at").alias("start"), F.max("observed_at").alias("end"), F.min("longitude").alias("west"), F.min("latitude").alias("south"), F.max("longitude").alias("east"), F.max("latitude").alias("north")]
    sums = named.groupBy("new_series_id").agg(F.count("*").alias("row_count"), *ends, F.array_sort(F.collect_set("taxon_name")).alias("species"))
    cells = named.groupBy("new_series_id", "cell").agg(F.count("*").alias("_n")).groupBy("new_series_id").agg(F.count("cell").alias("cells"))
    years = F.coalesce(F.transform(F.sequence(F.year("start"), F.year("end")), lambda y: F.concat(F.lit("year:"), y.cast("string"))), F.array().cast("array<string>"))
    out = head.join(sums, "new_series_id", "left").join(cells, "new_series_id", "left")
    return out.select(F.col("new_series_id").alias("dataset_id"), "version", "description", "artifacts", F.coalesce("row_count", F.lit(0)).alias("row_count"), "start", "end", "west", "south", "east", "north",
                      F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("species", F.array().cast("array<string>")).alias("species"), F.concat(F.array(*map(F.lit, STUDY_TAGS)), years).alias("tags"))


def publish_summary(rows: DataFrame, by: Sequence[str], registered: DataFrame | None = None, taxon: str = "", item: str = "", lon: str = "", lat: str = "") -> DataFrame:
    """Live rows as versions to publish: version, mapping_versions, row_count, span and variables of each series.

    With ``taxon`` its sorted species too, with ``item`` the artifacts by the version that added them and then by name,
    and with ``lon`` and ``lat`` the box of the points, which is unknown if one of them is. Series whose version is
    registered already, or a later one, are left out.
    """
    live = live_batches(rows)
    versions = live.groupBy(*by).agg(F.max("added_in_version").alias("version"), F.concat_ws(",", F.array_sort(F.collect_set("mapping_version"))).alias("mapping_versions"))
    out = series_summary(live, by, taxon).join(versions, list(by))
    if item:
        items = live.groupBy(*by, item).agg(F.min("added_in_version").alias("_added"))
        out = out.join(collected(items, by, [item], ["_added", item], "artifacts"), list(by))
    if lon and lat:
        out = out.join(lonlat_bounds(live, lon, lat, by), list(by))
    if registered is None:
        return out
    last = registered.groupBy(*by).agg(F.max("version").alias("_published"))
    return out.join(last, list(by), "left").where("_published is null or _published < version").drop("_published")


def table_fingerprint(df: DataFrame, decimals: int = 8) -> DataFrame:
    """(rows, sum, xor) over hashes of rows; order doesn't matter, and floating-point numbers are rounded first."""
    columns = [F.round(c, decimals).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    rows = df.select(F.xxhash64(*columns).alias("h"))
    return rows.agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("h").alias("xor"))
