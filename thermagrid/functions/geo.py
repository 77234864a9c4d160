"""Distances, the transverse Mercator projection and polygon measures as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, let

# Mean Earth radius, GRS80 ellipsoid, UTM constants.
EARTH_RADIUS_M = 6_371_008.8
SEMI_MAJOR_M = 6_378_137.0
INVERSE_FLATTENING = 298.257222101
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500_000.0
# End of fixed values.


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres, arctangent form with the cosine side kept >= 0."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(col(lon2) - col(lon1)) / 2)
    h = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_M) * F.atan2(
        F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - h)))


def scaled_degrees_sq(lat, lon, other_lat, other_lon) -> Column:
    """Squared degrees with longitude shrunk by the cosine of ``lat``."""
    dy = col(lat) - col(other_lat)
    dx = (col(lon) - col(other_lon)) * F.cos(F.radians(col(lat)))
    return dy * dy + dx * dx


def planar_m(x1, y1, x2, y2) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)


def _series():
    """Krüger series to fourth order in the third flattening."""
    f = 1.0 / INVERSE_FLATTENING
    n = f / (2.0 - f)
    n2, n3, n4 = n * n, n ** 3, n ** 4
    radius = SEMI_MAJOR_M / (1 + n) * (1 + n2 / 4 + n4 / 64)
    forward = [
        n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180,
        13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440,
        61 * n3 / 240 - 103 * n4 / 140,
        49561 * n4 / 161280,
    ]
    inverse = [
        n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360,
        n2 / 48 + n3 / 15 - 437 * n4 / 1440,
        17 * n3 / 480 - 37 * n4 / 840,
        4397 * n4 / 161280,
    ]
    latitude = [
        2 * n - 2 * n2 / 3 - 2 * n3 + 116 * n4 / 45,
        7 * n2 / 3 - 8 * n3 / 5 - 227 * n4 / 45,
        56 * n3 / 15 - 136 * n4 / 35,
        4279 * n4 / 630,
    ]
    return 2 * math.sqrt(n) / (1 + n), radius, forward, inverse, latitude


ECC, RECTIFYING_RADIUS, ALPHA, BETA, DELTA = _series()


def central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def utm_forward(lat, lon, zone: int = 30) -> tuple[Column, Column]:
    """Easting and northing in metres (northern hemisphere)."""
    t, dl = _conformal_tangent(lat), _off_meridian(lon, zone)
    return _forward_sums(F.atan2(t, F.cos(dl)), _forward_eta(t, dl))


# The steps of the projection one by one: inside a lambda an expression is computed again wherever it stands, so
# the rings below bind each step (``let``) instead of nesting all of them.

def _off_meridian(lon, zone: int) -> Column:
    return F.radians(col(lon) - F.lit(central_meridian(zone)))


def _conformal_tangent(lat) -> Column:
    s = F.sin(F.radians(col(lat)))
    return F.sinh(F.atanh(s) - F.lit(ECC) * F.atanh(s * F.lit(ECC)))


def _forward_eta(t: Column, dl: Column) -> Column:
    return F.atanh(F.sin(dl) / F.sqrt(t * t + F.lit(1.0)))


def _forward_angles(lat, lon, zone: int) -> Column:
    start = F.struct(_conformal_tangent(lat).alias("t"), _off_meridian(lon, zone).alias("dl"))
    return let(start, lambda a: F.struct(F.atan2(a["t"], F.cos(a["dl"])).alias("xi"), _forward_eta(a["t"], a["dl"]).alias("eta")))


def _forward_sums(xi: Column, eta: Column) -> tuple[Column, Column]:
    east, north = eta, xi
    for j, a in enumerate(ALPHA, start=1):
        k = F.lit(2.0 * j)
        east = east + F.lit(a) * F.cos(k * xi) * F.sinh(k * eta)
        north = north + F.lit(a) * F.sin(k * xi) * F.cosh(k * eta)
    scale = F.lit(UTM_SCALE * RECTIFYING_RADIUS)
    return F.lit(UTM_FALSE_EASTING) + scale * east, scale * north


def utm_inverse(x, y, zone: int = 30) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    scale = F.lit(UTM_SCALE * RECTIFYING_RADIUS)
    xi, eta = _inverse_sums(col(y) / scale, (col(x) - F.lit(UTM_FALSE_EASTING)) / scale)
    return _latitude(_conformal(xi, eta)), _longitude(xi, eta, zone)


def _inverse_angles(x, y) -> Column:
    scale = F.lit(UTM_SCALE * RECTIFYING_RADIUS)
    start = F.struct((col(y) / scale).alias("xi"), ((col(x) - F.lit(UTM_FALSE_EASTING)) / scale).alias("eta"))

    def sums(a: Column) -> Column:
        xi, eta = _inverse_sums(a["xi"], a["eta"])
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    return let(start, sums)


def _inverse_sums(xi0: Column, eta0: Column) -> tuple[Column, Column]:
    xi, eta = xi0, eta0
    for j, b in enumerate(BETA, start=1):
        k = F.lit(2.0 * j)
        xi = xi - F.lit(b) * F.sin(k * xi0) * F.cosh(k * eta0)
        eta = eta - F.lit(b) * F.cos(k * xi0) * F.sinh(k * eta0)
    return xi, eta


def _conformal(xi: Column, eta: Column) -> Column:
    return F.asin(F.sin(xi) / F.cosh(eta))


def _latitude(chi: Column) -> Column:
    phi = chi
    for j, d in enumerate(DELTA, start=1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    return F.degrees(phi)


def _longitude(xi: Column, eta: Column, zone: int) -> Column:
    return F.lit(central_meridian(zone)) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))


def half_side_from_area(area_km2) -> Column:
    return F.sqrt(col(area_km2) * F.lit(1_000_000.0)) / F.lit(2.0)


def square_area_km2(half_side_m) -> Column:
    side = col(half_side_m) * F.lit(2.0)
    return side * side / F.lit(1_000_000.0)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def rotated_square(x, y, half_side, rotation_deg) -> Column:
    """Closed ring of a square about its centre, counter-clockwise rotation."""
    x, y, h = col(x), col(y), col(half_side)
    angle = F.radians(col(rotation_deg))
    c, s = F.cos(angle), F.sin(angle)

    def corner(sx: int, sy: int) -> Column:
        dx, dy = h * F.lit(float(sx)), h * F.lit(float(sy))
        return point(x + dx * c - dy * s, y + dx * s + dy * c)

    start = corner(1, -1)
    return F.array(start, corner(1, 1), corner(-1, 1), corner(-1, -1), start)


def edges(ring: Column) -> Column:
    """Array of (start, end) pairs of a ring; an open ring is closed."""
    def closed(v: Column) -> Column:
        return F.when(F.element_at(v, 1) == F.element_at(v, -1), v).otherwise(
            F.concat(v, F.slice(v, 1, 1)))

    def pairs(v: Column) -> Column:
        return F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1),
                          lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(let(ring, closed), pairs)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _cross(e: Column, o: Column) -> Column:
    """Cross product of an edge's ends about ``o``."""
    return ((e["a"]["x"] - o["x"]) * (e["b"]["y"] - o["y"])
            - (e["b"]["x"] - o["x"]) * (e["a"]["y"] - o["y"]))


def ring_area(ring: str | Column) -> Column:
    """Shoelace area about the first vertex, so large coordinates do not cancel."""
    return let(col(ring), lambda v: let(F.element_at(v, 1), lambda o: F.abs(
        _sum(F.transform(edges(v), lambda e: _cross(e, o)))) / F.lit(2.0)))


def ring_centroid(ring: str | Column) -> tuple[Column, Column]:
    def moment(v: Column, o: Column, axis: str) -> Column:
        twice = _sum(F.transform(edges(v), lambda e: _cross(e, o)))
        m = _sum(F.transform(edges(v), lambda e: (
            e["a"][axis] + e["b"][axis] - o[axis] * F.lit(2.0)) * _cross(e, o)))
        return o[axis] + F.try_divide(m, twice * F.lit(3.0))

    def along(axis: str) -> Column:
        return let(col(ring), lambda v: let(
            F.element_at(v, 1), lambda o: moment(v, o, axis)))

    return along("x"), along("y")


def clipped_area(ring: str | Column, xmin, ymin, xmax, ymax) -> Column:
    """Area of a simple polygon inside an axis-aligned box.

    Green's theorem: along every edge, integrate x, bounded to the box, over
    the part of the edge that lies in the box's y range. The signed sum over
    the ring is the shared area; no clipped ring is built.
    """
    ring = col(ring)
    xmin, ymin, xmax, ymax = (col(c) if isinstance(c, (str, Column)) else F.lit(float(c))
                              for c in (xmin, ymin, xmax, ymax))
    width, height = xmax - xmin, ymax - ymin

    def bounded(v: Column, top: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), top)

    def antiderivative(v: Column) -> Column:
        return (F.when(v < 0, F.lit(0.0)).when(v <= width, v * v / F.lit(2.0))
                .otherwise(width * v - width * width / F.lit(2.0)))

    def mean_x(v: Column) -> Column:
        """Mean of the bounded x between two x values."""
        flat = F.abs(v["x1"] - v["x0"]) <= F.lit(1e-9) * width
        return F.when(flat, bounded((v["x0"] + v["x1"]) / F.lit(2.0), width)).otherwise(
            F.try_divide(antiderivative(v["x1"]) - antiderivative(v["x0"]), v["x1"] - v["x0"]))

    def crossing(v: Column) -> Column:
        slope = (v["bx"] - v["ax"]) / (v["by"] - v["ay"])
        ends = F.struct((v["ax"] + slope * (v["y0"] - v["ay"])).alias("x0"),
                        (v["ax"] + slope * (v["y1"] - v["ay"])).alias("x1"))
        # A level edge, or one above or below the box, adds nothing.
        return F.when(v["y0"] == v["y1"], F.lit(0.0)).otherwise(
            (v["y1"] - v["y0"]) * let(ends, mean_x))

    def contribution(e: Column) -> Column:
        ay, by = e["a"]["y"] - ymin, e["b"]["y"] - ymin
        return let(F.struct(
            (e["a"]["x"] - xmin).alias("ax"), ay.alias("ay"), (e["b"]["x"] - xmin).alias("bx"),
            by.alias("by"), bounded(ay, height).alias("y0"), bounded(by, height).alias("y1")),
            crossing)

    return F.abs(_sum(F.transform(edges(ring), contribution)))


def ring_bounds(ring: str | Column) -> dict[str, Column]:
    ring = col(ring)
    xs, ys = ring["x"], ring["y"]
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys),
            "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def ring_to_utm(ring: str | Column, zone: int = 30) -> Column:
    """Ring of (x = longitude, y = latitude) to metres."""
    return F.transform(col(ring), lambda p: let(_forward_angles(p["y"], p["x"], zone), lambda a: point(*_forward_sums(a["xi"], a["eta"]))))


def ring_to_degrees(ring: str | Column, zone: int = 30) -> Column:
    def degrees(a: Column) -> Column:
        return let(_conformal(a["xi"], a["eta"]), lambda chi: point(_longitude(a["xi"], a["eta"], zone), _latitude(chi)))

    return F.transform(col(ring), lambda p: let(_inverse_angles(p["x"], p["y"]), degrees))


def edge_rotation_deg(ring: str | Column) -> Column:
    """Direction of the first edge longer than a micrometre, folded to [0, 90)."""
    def turn(e: Column) -> Column:
        return F.pmod(F.degrees(F.atan2(e["b"]["y"] - e["a"]["y"], e["b"]["x"] - e["a"]["x"])),
                      F.lit(90.0))

    def folded(t: Column) -> Column:
        return F.when(F.abs(t - F.lit(90.0)) <= F.lit(1e-6), F.lit(0.0)).otherwise(t)

    long_edges = F.filter(edges(col(ring)), lambda e: F.hypot(
        e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]) > F.lit(1e-6))
    return let(let(F.try_element_at(long_edges, F.lit(1)), turn), folded)


def raster_cells(span_a: Column, span_b: Column, step: float = 0.1) -> Column:
    """Cells of a regular ``step`` degree raster that two spans touch."""
    def count(span: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.abs(span) / F.lit(step)).cast("int") + 1)
    return count(span_a) * count(span_b)


def expanded_box(west, south, east, north, margin: float = 0.15) -> dict[str, Column]:
    m = F.lit(margin)
    return {"west": col(west) - m, "south": col(south) - m,
            "east": col(east) + m, "north": col(north) + m}
