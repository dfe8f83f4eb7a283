"""Column expressions on WGS84 points, polygons and the global 1 km equal-area grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the equal-area grid (EPSG:6933).
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
GRID_SIZE = 1000.8950233495556
GRID_ROWS, GRID_COLS = 14616, 34704
GRID_X0, GRID_Y0 = -17367530.445161488, 7314540.830638552
STANDARD_PARALLEL = 30.0
EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE_X, KM_PER_DEGREE_Y = 111.32, 110.574

_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)
_K0 = math.cos(math.radians(STANDARD_PARALLEL)) / math.sqrt(1 - _E2 * math.sin(math.radians(STANDARD_PARALLEL)) ** 2)
_QP = (1 - _E2) * (1 / (1 - _E2) - math.log((1 - _E) / (1 + _E)) / (2 * _E))


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Grid metres (x, y) of a point."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    return F.radians(lon) * (SEMI_MAJOR * _K0), q * (SEMI_MAJOR / (2 * _K0))


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of grid metres, by the series from authalic to geodetic latitude."""
    beta = F.asin(y * (2 * _K0 / (SEMI_MAJOR * _QP)))
    e4, e6 = _E2**2, _E2**3
    lat = beta + F.sin(beta * 2) * (_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) + F.sin(beta * 4) * (23 * e4 / 360 + 251 * e6 / 3780) + F.sin(beta * 6) * (761 * e6 / 45360)
    return F.degrees(x / (SEMI_MAJOR * _K0)), F.degrees(lat)


def cell_row_col(lon: Column, lat: Column) -> tuple[Column, Column]:
    x, y = project(lon, lat)
    return F.floor((F.lit(GRID_Y0) - y) / GRID_SIZE), F.floor((x - F.lit(GRID_X0)) / GRID_SIZE)


def cell_name(row: Column, col: Column) -> Column:
    return F.concat(F.lit("E1K-r"), row.cast("string"), F.lit("-c"), col.cast("string"))


def cell_id(lon: Column, lat: Column) -> Column:
    """Name of the 1 km cell that holds a point; null for null coordinates."""
    return cell_name(*cell_row_col(lon, lat))


def flat_index(row: Column, col: Column) -> Column:
    return row * GRID_COLS + col


def from_flat_index(index: Column) -> tuple[Column, Column]:
    return F.floor(index / GRID_COLS), F.pmod(index, F.lit(GRID_COLS))


def parse_cell_id(cell: Column) -> tuple[Column, Column]:
    """Row and column of a cell's name; a bad name fails the query, null stays null."""
    pattern = r"^E1K-r(\d+)-c(\d+)$"
    ok = F.when(cell.isNotNull() & ~cell.rlike(pattern), F.raise_error(F.concat(F.lit("bad cell id "), cell))).otherwise(cell)
    return F.regexp_extract(ok, pattern, 1).cast("long"), F.regexp_extract(ok, pattern, 2).cast("long")


def cell_centre(row: Column, col: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a cell's centre."""
    return unproject((col + 0.5) * GRID_SIZE + GRID_X0, F.lit(GRID_Y0) - (row + 0.5) * GRID_SIZE)


def cell_ring(row: Column, col: Column) -> Column:
    """A cell as a closed ring of (x, y) in degrees."""
    corners = []
    for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)):
        lon, lat = unproject((col + dx) * GRID_SIZE + GRID_X0, F.lit(GRID_Y0) - (row + dy) * GRID_SIZE)
        corners.append(F.struct(lon.alias("x"), lat.alias("y")))
    return F.array(*corners)


def cells_in_bbox(spark: SparkSession, west: float, south: float, east: float, north: float) -> DataFrame:
    """(row, col, cell_id) of all cells that a box touches, clamped to the grid."""
    ends = spark.range(1).select(*(f.alias(n) for n, f in zip(("top", "left"), cell_row_col(F.lit(west), F.lit(north)), strict=True)), *(f.alias(n) for n, f in zip(("bottom", "right"), cell_row_col(F.lit(east), F.lit(south)), strict=True)))
    clamp = lambda c, high: F.greatest(F.lit(0), F.least(F.lit(high - 1), c))
    rows = ends.select(F.explode(F.sequence(clamp(F.col("top"), GRID_ROWS), clamp(F.col("bottom"), GRID_ROWS))).alias("row"), "left", "right")
    cells = rows.select("row", F.explode(F.sequence(clamp(F.col("left"), GRID_COLS), clamp(F.col("right"), GRID_COLS))).alias("col"))
    return cells.withColumn("cell_id", cell_name(F.col("row"), F.col("col")))


def lonlat_bounds(df: DataFrame, lon: str, lat: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, west, south, east, north) of points; all unknown if one point is null, not finite or outside the globe."""
    x, y = F.col(lon), F.col(lat)
    known = F.bool_and(F.coalesce(x.between(-180, 180) & y.between(-90, 90), F.lit(False)))
    ends = (("west", F.min(x)), ("south", F.min(y)), ("east", F.max(x)), ("north", F.max(y)))
    return df.groupBy(*by).agg(*(F.when(known, end).alias(name) for name, end in ends))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.when(a.isNotNull(), F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_RADIUS_KM))  # least() skips nulls


#: Steps of the inverse formula. Each one shrinks the error some 300 times, but for nearly antipodal points.
INVERSE_STEPS = 8


def geodesic_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the WGS84 ellipsoid; null if a coordinate is null or not finite.

    Vincenty's inverse formula: the longitude on the auxiliary sphere is folded over a fixed number of steps inside
    Spark's own functions. Where the last step still moves it by 1e-9 or more, as near antipodes, the great-circle
    distance is the answer. Longitudes differ by the shorter way round.
    """
    known = F.lit(True)
    for c in (lon1, lat1, lon2, lat2):
        known = known & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e9)
    around = F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180
    flat = 1 - FLATTENING
    t1, t2 = F.lit(flat) * F.tan(F.radians(lat1)), F.lit(flat) * F.tan(F.radians(lat2))
    c1, c2 = 1 / F.sqrt(1 + t1 * t1), 1 / F.sqrt(1 + t2 * t2)
    start = F.struct(F.radians(around).alias("dlon"), c1.alias("c1"), (t1 * c1).alias("s1"), c2.alias("c2"), (t2 * c2).alias("s2"))

    def sphere(p: Column, lam: Column) -> dict[str, Column]:
        """Arc, azimuth and middle for a longitude on the auxiliary sphere."""
        x, y = p["c2"] * F.sin(lam), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam)
        return {"ss": F.sqrt(x * x + y * y), "cs": p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam), "x": p["c1"] * x}

    def shape(v: Column) -> Column:
        sin_a = F.when(v["ss"] == 0, F.lit(0.0)).otherwise(v["x"] / v["ss"])
        return F.struct(v["ss"].alias("ss"), v["cs"].alias("cs"), F.atan2(v["ss"], v["cs"]).alias("sigma"), sin_a.alias("sa"), (1 - sin_a * sin_a).alias("ca2"))

    def bound(value: Column, use) -> Column:  # noqa: ANN001
        """``use`` of a value that is computed once."""
        return F.transform(F.array(value), use)[0]

    def arc(p: Column, lam: Column, use) -> Column:  # noqa: ANN001
        """``use`` of (arc, middle) at a longitude."""
        def middle(v: Column) -> Column:
            cm = F.when(v["ca2"] < 1e-15, F.lit(0.0)).otherwise(v["cs"] - 2 * p["s1"] * p["s2"] / v["ca2"])
            return bound(F.struct(*(v[n].alias(n) for n in ("ss", "cs", "sigma", "sa", "ca2")), cm.alias("cm")), use)

        return bound(F.struct(*(c.alias(n) for n, c in sphere(p, lam).items())), lambda v: bound(shape(v), middle))

    def longitude(p: Column, lam: Column) -> Column:
        def further(v: Column) -> Column:
            c = FLATTENING / 16 * v["ca2"] * (4 + FLATTENING * (4 - 3 * v["ca2"]))
            return p["dlon"] + (1 - c) * FLATTENING * v["sa"] * (v["sigma"] + c * v["ss"] * (v["cm"] + c * v["cs"] * (2 * v["cm"] * v["cm"] - 1)))

        return arc(p, lam, further)

    def distance(p: Column, lam: Column) -> Column:
        b = SEMI_MAJOR * flat

        def km(v: Column) -> Column:
            u = v["ca2"] * ((SEMI_MAJOR**2 - b**2) / b**2)
            big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            delta = big_b * v["ss"] * (v["cm"] + big_b / 4 * (v["cs"] * (2 * v["cm"] * v["cm"] - 1) - big_b / 6 * v["cm"] * (4 * v["ss"] * v["ss"] - 3) * (4 * v["cm"] * v["cm"] - 3)))
            return F.lit(b / 1000) * big_a * (v["sigma"] - delta)

        return arc(p, lam, km)

    def folded(p: Column) -> Column:
        first = F.struct(p["dlon"].alias("now"), F.lit(1.0).alias("moved"))
        steps = F.aggregate(F.sequence(F.lit(1), F.lit(INVERSE_STEPS)), first, lambda s, _: bound(longitude(p, s["now"]), lambda new: F.struct(new.alias("now"), F.abs(new - s["now"]).alias("moved"))))
        return bound(steps, lambda s: F.when(s["moved"] < 1e-9, distance(p, s["now"])).otherwise(haversine_km(lon1, lat1, lon2, lat2)))

    return F.when(known, bound(start, folded))


def segment_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Length of a short segment, flat at its middle latitude."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * KM_PER_DEGREE_X
    return F.sqrt(dx * dx + F.pow((lat2 - lat1) * KM_PER_DEGREE_Y, 2))


def edges_of(rings: Column) -> Column:
    """Array of rings of (x, y) -> array of edges (x1, y1, x2, y2)."""
    def of_ring(ring: Column) -> Column:
        ends = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
        starts = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))

    return F.flatten(F.transform(rings, of_ring))


def _in_edges(x: Column, y: Column, edges: Column) -> Column:
    def on_edge(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    def crosses(n: Column, e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        return n + F.when(spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]), 1).otherwise(0)

    return F.exists(edges, on_edge) | (F.aggregate(edges, F.lit(0), crosses) % 2 == 1)


def point_in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    """Whether rings (shells and holes of one or more polygons) hold a point; boundaries are inside, null is unknown."""
    return F.when(lon.isNotNull() & lat.isNotNull() & rings.isNotNull(), _in_edges(lon, lat, edges_of(rings)))


def inside_fraction(x1: Column, y1: Column, x2: Column, y2: Column, rings: Column) -> Column:
    """Share of a segment inside rings: it is cut where it meets edges, and each part's middle is tested.

    A segment of no length counts by its point.
    """
    edges = edges_of(rings)
    dx, dy = x2 - x1, y2 - y1

    def meets(e: Column) -> Column:
        ex, ey = e["x2"] - e["x1"], e["y2"] - e["y1"]
        det = dx * ey - dy * ex
        t = ((e["x1"] - x1) * ey - (e["y1"] - y1) * ex) / det
        u = ((e["x1"] - x1) * dy - (e["y1"] - y1) * dx) / det
        return F.when((det != 0) & t.between(0, 1) & u.between(0, 1), t)

    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(F.transform(edges, meets), lambda t: t.isNotNull()))))
    parts = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def add(total: Column, part: Column) -> Column:
        middle = (part["a"] + part["b"]) / 2
        return total + F.when(_in_edges(x1 + dx * middle, y1 + dy * middle, edges), part["b"] - part["a"]).otherwise(0.0)

    return F.aggregate(parts, F.lit(0.0), add)


def bbox_contains(outer: tuple[Column, ...], inner: tuple[Column, ...]) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def bbox_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether boxes (west, south, east, north) share a point; west > east wraps over the antimeridian."""
    def parts(box: tuple[Column, ...]) -> list[tuple[Column, Column]]:
        wraps = box[0] > box[2]
        return [(box[0], F.when(wraps, F.lit(180.0)).otherwise(box[2])), (F.when(wraps, F.lit(-180.0)).otherwise(box[0]), box[2])]

    across = F.lit(False)
    for w1, e1 in parts(a):
        for w2, e2 in parts(b):
            across = across | ((w1 <= e2) & (w2 <= e1))
    return across & (a[1] <= b[3]) & (b[1] <= a[3])


def bbox_share(part: tuple[Column, ...], whole: tuple[Column, ...]) -> Column:
    """Share of ``whole``'s area that ``part`` covers; a whole without area counts 1 if part meets it, else 0."""
    width = F.greatest(F.least(part[2], whole[2]) - F.greatest(part[0], whole[0]), F.lit(0.0))
    height = F.greatest(F.least(part[3], whole[3]) - F.greatest(part[1], whole[1]), F.lit(0.0))
    area = (whole[2] - whole[0]) * (whole[3] - whole[1])
    return F.when(area > 0, width * height / area).otherwise(bbox_overlap(part, whole).cast("double"))


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Rings of a box."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south)))


def pixel_xy(origin_x: Column, origin_y: Column, size: Column, row: Column, col: Column) -> tuple[Column, Column]:
    """Centre of a pixel of a north-up raster."""
    return origin_x + (col + 0.5) * size, origin_y - (row + 0.5) * size


def pixel_area(a: Column, b: Column, d: Column, e: Column) -> Column:
    """Area of a pixel from the linear part of an affine transform."""
    return F.abs(a * e - b * d)
