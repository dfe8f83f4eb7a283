"""Tables of dataset descriptors: search, coverage, eligibility, tags."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bbox_overlap, bbox_share
from .joins import live_spans, with_span
from .relational import numbered

Box = tuple[float, float, float, float]
#: Fixed value: the least share of a region that earns its tag.
REGION_SHARE = 0.05


def latest_datasets(datasets: DataFrame) -> DataFrame:
    """The highest version of each dataset."""
    return datasets.groupBy("dataset_id").agg(F.max_by(F.struct(*[c for c in datasets.columns if c != "dataset_id"]), "version").alias("d")).select("dataset_id", "d.*")


def _box(names: Sequence[str] = ("west", "south", "east", "north")) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def spatial_share(region: Box) -> Column:
    """Share of a region under a dataset's box; null if that is unknown."""
    return F.when(F.col("west").isNotNull(), bbox_share(_box(), tuple(map(F.lit, region))))


def temporal_share(start: Column, end: Column) -> Column:
    """Share of a time span that coverage has; an instant counts 1 or 0; unknown coverage is null."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    span = us(end) - us(start)
    common = F.least(us(F.col("end")), us(end)) - F.greatest(us(F.col("start")), us(start))
    share = F.when(span > 0, F.greatest(common, F.lit(0)) / span).otherwise((common >= 0).cast("double"))
    return F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), share)


def score(spatial: Column, temporal: Column) -> Column:
    return F.coalesce(spatial, F.lit(1.0)) * F.coalesce(temporal, F.lit(1.0))


def words(text: Column) -> Column:
    """Distinct words of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1))


def word_share(text: Column, query: str | Column) -> Column:
    """Share of the query's words that a text has; null for a null text and for a query without words.

    Of a query that is the same for all rows only its words are looked for in a text; of a column's, all words of a text
    are listed.
    """
    if isinstance(query, str):
        asked, lowered = sorted(set(re.findall("[a-z0-9]+", query.lower()))), F.lower(text)
        has = (F.contains(lowered, F.lit(w)) & lowered.rlike(f"(?<![a-z0-9]){w}(?![a-z0-9])") for w in asked)
        return sum((h.cast("int") for h in has), F.lit(0)) / float(len(asked)) if asked else F.lit(None).cast("double")
    asked = words(query)
    return F.size(F.array_intersect(words(text), asked)) / F.nullif(F.size(asked), F.lit(0))


def lexical_search(df: DataFrame, key: str, text: str, query: str, limit: int) -> DataFrame:
    """(key, share) of the ``limit`` rows with the largest share of the query's words, above none; ties by key."""
    found = df.select(key, word_share(F.col(text), query).alias("share")).where("share > 0")
    return found.orderBy(F.desc("share"), key).limit(limit)


def search(datasets: DataFrame, region: Box, start: Column, end: Column, scopes: Sequence[str], families: Sequence[str] = (), variables: Sequence[str] = (), all_tags: Sequence[str] = (), text: str = "", any_tags: Sequence[str] = (), species: Sequence[str] = (), suggested: str = "") -> DataFrame:
    """Latest versions that match every condition, with shares and score; unknown coverage is kept, a share of 0 isn't.

    All words of ``text`` must be in the description. Of ``any_tags`` one must be there, and of ``species`` one in the
    column of that name. ``suggested`` names a column of tags that weren't given by people or rules: these don't count.
    """
    out = latest_datasets(datasets).where(F.col("status") == "ready").where(F.col("access_scope").isin(*scopes))
    tags = F.array_except("tags", F.coalesce(F.col(suggested), F.array().cast("array<string>"))) if suggested else F.col("tags")
    listed = lambda names: F.array(*map(F.lit, names))
    if families:
        out = out.where(F.col("family").isin(*families))
    if variables:
        out = out.where(F.arrays_overlap("variables", listed(variables)))
    if species:
        out = out.where(F.arrays_overlap("species", listed(species)))
    if all_tags:
        out = out.where(F.size(F.array_except(listed(all_tags), tags)) == 0)
    if any_tags:
        out = out.where(F.arrays_overlap(tags, listed(any_tags)))
    if text:
        out = out.where(word_share(F.col("description"), text) == 1)
    shares = out.withColumn("spatial_share", spatial_share(region)).withColumn("temporal_share", temporal_share(start, end))
    kept = shares.where("(spatial_share is null or spatial_share > 0) and (temporal_share is null or temporal_share > 0)")
    return kept.withColumn("score", score(F.col("spatial_share"), F.col("temporal_share")))


def ranked(matches: DataFrame) -> DataFrame:
    """Matches with their place: by score, then number of tags, then id; numbered by ranges."""
    return numbered(matches, [F.desc("score"), F.desc(F.size("tags")), F.asc("dataset_id")], "place")


def eligibility(datasets: DataFrame, required: Sequence[str], region: Box, start: Column, end: Column, species: Sequence[str] = (), units: Mapping[str, str] | None = None, lookback_days: int = 0, statuses: Sequence[str] = ()) -> DataFrame:
    """(dataset_id, status, reasons): ineligible for a hard reason, unresolved for an unknown, else eligible.

    A reason is a code, or code:column. ``units`` are expected of columns, in a map of that name (a column without one
    is unknown). With a lookback, coverage must begin so many days before the start, as windows and as-of steps reach
    back. Of ``statuses`` the dataset must have one.
    """
    listed = lambda names: F.array(*map(F.lit, names))
    overlap = bbox_overlap(_box(), tuple(map(F.lit, region)))
    hard = [F.when(~F.array_contains("columns", c), F.lit(f"missing:{c}")) for c in required]
    hard += [F.when((F.col("end") < start) | (F.col("start") > end), F.lit("time_disjoint")), F.when(F.col("west").isNotNull() & ~overlap, F.lit("space_disjoint"))]
    unknown = [F.when(F.col("start").isNull() | F.col("end").isNull(), F.lit("time_unknown")), F.when(F.col("west").isNull(), F.lit("space_unknown"))]
    if species:
        hard.append(F.when(~F.arrays_overlap("species", listed(species)), F.lit("species_disjoint")))
        unknown.append(F.when(F.col("species").isNull(), F.lit("species_unknown")))
    for column, unit in (units or {}).items():
        hard.append(F.when(F.col("units")[column] != unit, F.lit(f"unit:{column}")))
        unknown.append(F.when(F.array_contains("columns", column) & F.col("units")[column].isNull(), F.lit(f"unit_unknown:{column}")))
    if lookback_days:
        hard.append(F.when((F.col("end") >= start) & (F.col("start") <= end) & (F.col("start") > F.date_sub(start, lookback_days)), F.lit("lookback_short")))
    if statuses:
        hard.append(F.when(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), F.lit("status")))
    found = datasets.withColumns({"_hard": F.array_compact(F.array(*hard)), "_unknown": F.array_compact(F.array(*unknown))})
    status = F.when(F.size("_hard") > 0, "ineligible").when(F.size("_unknown") > 0, "unresolved").otherwise("eligible")
    return found.select("dataset_id", status.alias("status"), F.concat("_hard", "_unknown").alias("reasons"))


def union_candidates(*hits: tuple[str, DataFrame]) -> DataFrame:
    """Hits (dataset_id, version, …) of several methods, once each, with the sorted names of the methods."""
    parts = [df.select("dataset_id", "version", F.lit(name).alias("method")) for name, df in hits]
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy("dataset_id", "version").agg(F.array_sort(F.collect_set("method")).alias("methods"))


def dataset_tags(datasets: DataFrame, regions: DataFrame, source: str = "") -> DataFrame:
    """(dataset_id, tag): one for each variable, each year of coverage, each region of which enough is covered, and the
    ``source``, if that names a column. Boxes meet regions by cells of ten degrees."""
    variables = datasets.select("dataset_id", F.explode(F.transform("variables", lambda v: F.concat(F.lit("variable:"), v))).alias("tag"))
    years = datasets.select("dataset_id", F.explode(F.transform(F.sequence(F.year("start"), F.year("end")), lambda y: F.concat(F.lit("year:"), y.cast("string")))).alias("tag"))
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / 10), F.floor(F.col(high) / 10)))
    boxes = datasets.select("dataset_id", "west", "south", "east", "north").where("west is not null").withColumn("cx", cells("west", "east")).withColumn("cy", cells("south", "north"))
    named = regions.select("region", *(F.col(c).alias(f"r_{c}") for c in ("west", "south", "east", "north"))).withColumn("cx", cells("r_west", "r_east")).withColumn("cy", cells("r_south", "r_north"))
    share = bbox_share(_box(), _box(("r_west", "r_south", "r_east", "r_north")))
    out = variables.union(years).union(boxes.join(named, ["cx", "cy"]).where(share >= REGION_SHARE).select("dataset_id", F.concat(F.lit("region:"), "region")))
    if source:
        out = out.union(datasets.where(F.col(source).isNotNull()).select("dataset_id", F.concat(F.lit("source:"), F.col(source))))
    return out.distinct()


def merge_tags(given: Column, suggested: Column, vocabulary: Sequence[str]) -> Column:
    """Tags (key, value) of both: suggested ones only of known keys that aren't given."""
    keys = F.transform(given, lambda t: t["key"])
    new = F.filter(suggested, lambda t: t["key"].isin(*vocabulary) & ~F.array_contains(keys, t["key"]))
    return F.concat(given, new)


def coverage_union(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Box and time span of several files; unknown if one is."""
    def all_known(f: object, c: str) -> Column:
        return F.when(F.count_if(F.col(c).isNull()) == 0, f(c)).alias(c)

    return df.groupBy(*by).agg(*(all_known(f, c) for f, c in ((F.min, "west"), (F.min, "south"), (F.max, "east"), (F.max, "north"), (F.min, "start"), (F.max, "end"))))


def coverage_gaps(union: DataFrame, region: Box, start: Column, end: Column) -> DataFrame:
    """Adds ``gaps``: what of a request isn't covered."""
    w, s, e, n = map(F.lit, region)
    inside = (F.col("west") <= w) & (F.col("south") <= s) & (F.col("east") >= e) & (F.col("north") >= n)
    gaps = [F.when(~F.coalesce(inside, F.lit(False)), F.lit("bbox")), F.when(~F.coalesce(F.col("start") <= start, F.lit(False)), F.lit("start")), F.when(~F.coalesce(F.col("end") >= end, F.lit(False)), F.lit("end"))]
    return union.withColumn("gaps", F.array_compact(F.array(*gaps)))


def missing_kinds(files: DataFrame, kinds: Sequence[str], column: str = "variables") -> DataFrame:
    """(kind): the requested data kinds that no file has."""
    wanted = files.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return wanted.join(files.select(F.explode(column).alias("kind")).distinct(), "kind", "left_anti")


def uncovered_days(files: DataFrame, by: Sequence[str], start: Column, end: Column) -> DataFrame:
    """(by, first, last): runs of requested days between a source's first and last one that none of its files covers.

    Files without both ends tell nothing here. Days before the first and after the last file are the ``start`` and ``end``
    gaps of ``source_coverage_gaps``.
    """
    known = files.where("start <= end").select(*by, "start", "end").distinct()
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    holes = known.withColumn("_upto", F.max("end").over(before)).where("datediff(start, _upto) > 1")
    cut = holes.select(*by, F.greatest(F.date_add("_upto", 1), start).alias("first"), F.least(F.date_sub("start", 1), end).alias("last"))
    return cut.where("first <= last")


def covered_share(files: DataFrame, by: Sequence[str], region: Box) -> DataFrame:
    """(by, share): the part of a region's area that the union of a source's boxes covers; sources without a box have no row.

    Equal boxes count once. The boxes' west and east sides cut the region into strips; in each strip the boxes over it are
    swept from south to north. Boxes don't wrap over the antimeridian.
    """
    w, s, e, n = region
    inside = files.where("west <= east and south <= north").select(*by, *(f(F.lit(float(a)), f2(F.lit(float(b)), F.col(c))).alias(c) for c, f, a, f2, b in (("west", F.greatest, w, F.least, e), ("south", F.greatest, s, F.least, n), ("east", F.greatest, w, F.least, e), ("north", F.greatest, s, F.least, n)))).distinct()
    sides = inside.select(*by, F.explode(F.array("west", "east")).alias("_x")).distinct()
    strips = sides.withColumn("_next", F.lead("_x").over(Window.partitionBy(*by).orderBy("_x"))).where("_next > _x")
    over = inside.join(strips, list(by)).where((F.col("west") <= F.col("_x")) & (F.col("east") >= F.col("_next")))
    below = Window.partitionBy(*by, "_x").orderBy("south", "north").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("north") - F.greatest(F.col("south"), F.coalesce(F.max("north").over(below), F.col("south"))), F.lit(0.0))
    area = over.withColumn("_area", fresh * (F.col("_next") - F.col("_x"))).groupBy(*by).agg(F.sum("_area").alias("_area"))
    shares = inside.select(*by).distinct().join(area, list(by), "left")
    return shares.select(*by, (F.coalesce("_area", F.lit(0.0)) / ((e - w) * (n - s))).alias("share"))


def source_coverage_gaps(files: DataFrame, region: Box, start: Column, end: Column, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """(by, files, gaps, uncovered_days, share): what of a request the union of each source's files leaves out.

    ``gaps`` are codes of the union's bounds: bbox, start, end, or each with _unknown if one file doesn't tell. Bounds say
    nothing of what lies between: uncovered_days counts requested days in holes between files, and ``share`` is the part of
    the region under some file (null if no file has a box).
    """
    union = coverage_union(files, by).join(files.groupBy(*by).agg(F.count("*").alias("files")), list(by))
    w, s, e, n = map(F.lit, region)
    box = F.col("west").isNull() | F.col("south").isNull() | F.col("east").isNull() | F.col("north").isNull()
    inside = (F.col("west") <= w) & (F.col("south") <= s) & (F.col("east") >= e) & (F.col("north") >= n)
    gaps = [F.when(box, "bbox_unknown").when(~inside, "bbox"), F.when(F.col("start").isNull(), "start_unknown").when(F.col("start") > start, "start"), F.when(F.col("end").isNull(), "end_unknown").when(F.col("end") < end, "end")]
    holes = uncovered_days(files, by, start, end).groupBy(*by).agg(F.sum(F.datediff("last", "first") + 1).alias("uncovered_days"))
    out = union.join(holes, list(by), "left").join(covered_share(files, by, region), list(by), "left")
    return out.select(*by, "files", F.array_compact(F.array(*gaps)).alias("gaps"), F.coalesce("uncovered_days", F.lit(0)).alias("uncovered_days"), "share")


def footprint(df: DataFrame, by: Sequence[str], cell: str = "cell") -> DataFrame:
    """The set of cells, as rows (by…, cell); a footprint is as large as it has rows."""
    return df.select(*by, cell).where(F.col(cell).isNotNull()).distinct()


def footprint_growth(previous: DataFrame, current: DataFrame, by: Sequence[str], threshold: float = 0.10) -> DataFrame:
    """(by…, previous_cells, new_cells, grows): whether new cells are more than ``threshold`` of those before."""
    fresh = current.join(previous, [*by, "cell"], "left_anti").groupBy(*by).agg(F.count("*").alias("new_cells"))
    before = previous.groupBy(*by).agg(F.count("*").alias("previous_cells"))
    both = before.join(fresh, list(by), "left").withColumn("new_cells", F.coalesce("new_cells", F.lit(0)))
    return both.withColumn("grows", F.col("new_cells") > F.col("previous_cells") * threshold)


def quarters(start: Column, end: Column) -> Column:
    """Quarters of a span, as year-Qn."""
    first = F.date_trunc("quarter", start).cast("date")
    return F.transform(F.sequence(first, F.date_trunc("quarter", end).cast("date"), F.expr("interval 3 months")), lambda d: F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")))


def new_quarters(previous_start: Column, previous_end: Column, start: Column, end: Column) -> Column:
    return F.array_except(quarters(start, end), quarters(previous_start, previous_end))


def needs_relabel(previous: DataFrame, current: DataFrame, growth: DataFrame) -> DataFrame:
    """(dataset_id, relabel): whether a new version covers a new quarter, or its footprint ``grows`` (see footprint_growth)."""
    before = previous.select("dataset_id", F.col("start").alias("_start"), F.col("end").alias("_end"))
    both = current.select("dataset_id", "start", "end").join(before, "dataset_id").join(growth.select("dataset_id", "grows"), "dataset_id", "left")
    fresh = new_quarters(F.col("_start"), F.col("_end"), F.col("start"), F.col("end"))
    return both.select("dataset_id", (F.coalesce(F.size(fresh) > 0, F.lit(False)) | F.coalesce("grows", F.lit(False))).alias("relabel"))


def distinct_sources(df: DataFrame, json: str, path: str) -> DataFrame:
    """The distinct values at a path of a JSON column, null among them, as ``source``."""
    return df.select(F.get_json_object(json, path).alias("source")).distinct()


def family_coverage(datasets: DataFrame, start: Column, end: Column, by: str = "family") -> DataFrame:
    """(by, start, end): the time that a family's datasets cover together, clipped to a request."""
    return datasets.groupBy(by).agg(F.greatest(F.min("start"), start).alias("start"), F.least(F.max("end"), end).alias("end"))


def published(df: DataFrame, entries: DataFrame, key: str, entry_key: str, json: str = "", path: str = "") -> DataFrame:
    """Rows of ``df`` that an entry names, by a column or at a path of a JSON column."""
    named = F.get_json_object(json, path).cast(df.schema[key].dataType) if json else F.col(entry_key)
    return df.join(entries.select(named.alias(key)).where(F.col(key).isNotNull()), key, "left_semi")


def public_catalog(datasets: DataFrame) -> DataFrame:
    return datasets.where("access_scope = 'public' and status = 'ready'").orderBy("family", "dataset_id")


def published_manifests(manifests: DataFrame, batches: DataFrame, datasets: DataFrame, manifest: str = "raw_manifest") -> DataFrame:
    """Manifests (artifact_id, version, checksum, access_scope…) that a live batch of a ready dataset of their scope names.

    The chain is reduced from its small end: ready versions, then the distinct spans of their series that are live in a
    scope, then the manifests of their batches, each once, whose keys are taken from JSON; only these keys meet the large
    table, whose rows of other keys a Bloom filter or a broadcast of the keys, as Spark chooses, leaves out at the scan.
    """
    ready = datasets.where("status = 'ready'").select(F.col("dataset_id").alias("series_id"), "version", F.col("access_scope").alias("_scope"))
    parts = ("artifact_id", "version", "checksum")
    held = with_span(batches)
    own = ["series_id", "_added", "_open"]
    live = live_spans(ready, held.select(*own).distinct()).select(*own, "_scope").distinct()
    named = live.join(held.select(*own, F.col(manifest).alias("_manifest")), own).select("_scope", "_manifest").distinct()
    keys = named.select("_scope", *(F.get_json_object("_manifest", f"$.{k}").alias(f"_{k}") for k in parts))
    same = F.col("access_scope") == F.col("_scope")
    for k in parts:
        same = same & (F.col(k).cast("string") == F.col(f"_{k}"))
    return manifests.join(keys, same, "left_semi")
