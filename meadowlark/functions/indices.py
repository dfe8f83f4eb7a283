"""Band arithmetic on pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the products' definitions.
S2_SCALE, S2_BASELINE_OFFSET = 10_000.0, -1000
S2_CLOUDY_CLASSES = (0, 1, 3, 8, 9, 10, 11)
MODIS_SCALE, MODIS_FILL, MODIS_GOOD = 0.0001, -3000, (0, 1)
RAIN_NODATA = -9999


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is zero or a band is null."""
    return (a - b) / F.nullif(a + b, F.lit(0.0))


def s2_offset(baseline: Column) -> Column:
    """Offset of reflectances from a processing baseline such as ``05.09``."""
    parts = F.split(baseline, r"\.")
    return F.when(F.get(parts, F.lit(0)).cast("int") >= 4, S2_BASELINE_OFFSET).otherwise(0)


def s2_reflectance(digital: Column, offset: Column) -> Column:
    return F.when(digital != 0, (digital + offset) / S2_SCALE)


def s2_clear(scene_class: Column) -> Column:
    return ~scene_class.isin(*S2_CLOUDY_CLASSES)


def s2_indices(pixels: DataFrame, offset: Column) -> DataFrame:
    """(…, b_green, b_red, b_nir, b_swir, scl) -> long (…, variable, value) of ndvi, mndwi and ndmi; cloud gives null."""
    band = lambda name: F.when(s2_clear(F.col("scl")), s2_reflectance(F.col(name), offset))
    pairs = {"ndvi": ("b_nir", "b_red"), "mndwi": ("b_green", "b_swir"), "ndmi": ("b_nir", "b_swir")}
    keep = [c for c in pixels.columns if not c.startswith("b_") and c != "scl"]
    values = [F.struct(F.lit(name).alias("variable"), normalized_difference(band(a), band(b)).alias("value")) for name, (a, b) in pairs.items()]
    return pixels.select(*keep, F.inline(F.array(*values)))


def modis_vi(raw: Column, reliability: Column) -> Column:
    return F.when((raw != MODIS_FILL) & reliability.isin(*MODIS_GOOD), raw * MODIS_SCALE)


def chirps_rain(raw: Column) -> Column:
    return F.when((raw != RAIN_NODATA) & (raw >= 0), raw)
