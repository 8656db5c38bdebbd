"""Map projections as Column expressions of doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid's axis and squared eccentricity, the zone's scale and central meridian.
AXIS, E2, SCALE, MERIDIAN = 6_378_137.0, 0.0066943799901413165, 0.9996, -123.0
#: The flattening of the ellipsoid that state planes are defined on, and from it its squared eccentricity.
FLATTENING = 1 / 298.257222101
GRS80 = FLATTENING * (2 - FLATTENING)
#: The guarded region in degrees and the local origin in mm.
LON, LAT, ORIGIN = (-122.3, -122.0), (37.3, 37.6), (573_200_000, 4_142_200_000)
#: Mm of a survey foot and the heights in mm that are taken.
FOOT, HEIGHTS = 304.8006096012192, (-1_000_000, 10_000_000)
#: Fixed values of the state plane zone: parallels and latitude of origin and meridian in degrees, false easting and
#: northing in metres.
PARALLELS, ORIGIN_LAT, ORIGIN_LON, FALSE = (38.0 + 26.0 / 60.0, 37.0 + 4.0 / 60.0), 36.5, -120.5, (2_000_000.0001016, 500_000.0001016)


def utm10(lon: Column, lat: Column, e2: float = E2) -> Column:
    """struct(easting, northing) in metres of a point in degrees: the transverse Mercator series of zone 10, on the ellipsoid
    of a squared eccentricity."""
    prime = e2 / (1 - e2)
    phi = F.radians(lat)
    sine, cosine, t = F.sin(phi), F.cos(phi), F.pow(F.tan(phi), F.lit(2))
    n = AXIS / F.sqrt(1 - e2 * sine * sine)
    c = prime * cosine * cosine
    a = cosine * F.radians(lon - MERIDIAN)
    k = [1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, -(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024), 15 * e2**2 / 256 + 45 * e2**3 / 1024, -35 * e2**3 / 3072]
    arc = k[0] * phi
    for i in (1, 2, 3):
        arc = arc + k[i] * F.sin(2.0 * i * phi)
    power = lambda p: F.pow(a, F.lit(p))
    east = a + (1 - t + c) * power(3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * prime) * power(5) / 120
    north = power(2) / 2 + (5 - t + 9 * c + 4 * c * c) * power(4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * prime) * power(6) / 720
    return F.struct((500_000.0 + SCALE * n * east).alias("easting"), (SCALE * (AXIS * arc + n * F.tan(phi) * north)).alias("northing"))


def local(lon: Column, lat: Column) -> Column:
    """struct(x, y): local mm of a point in degrees; null outside the guarded region."""
    at = utm10(lon, lat)
    mm = lambda v, o: F.round(v * 1000).cast("bigint") - o
    return F.when(lon.between(*LON) & lat.between(*LAT), F.struct(mm(at["easting"], ORIGIN[0]).alias("x"), mm(at["northing"], ORIGIN[1]).alias("y")))


def foot_height(feet: Column) -> Column:
    """Survey feet in whole mm; null outside the heights that are taken."""
    mm = F.round(feet * FOOT).cast("bigint")
    return F.when(mm.between(*HEIGHTS), mm)


#: Rounds of the inverse latitude: a fourth one moves nothing by a micrometre.
ROUNDS = 7


def cone_constants() -> tuple[float, float, float]:
    """(n, f, radius at the origin in metres) of the two-parallel conic. n is a quotient of two small differences, so its last
    digits differ from one logarithm to the next, and metres with them: it is worked out once, here."""
    e = math.sqrt(GRS80)
    scale = lambda p: math.cos(p) / math.sqrt(1 - GRS80 * math.sin(p) ** 2)
    cone = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    one, two, zero = (math.radians(v) for v in (*PARALLELS, ORIGIN_LAT))
    n = (math.log(scale(one)) - math.log(scale(two))) / (math.log(cone(one)) - math.log(cone(two)))
    f = scale(one) / (n * cone(one) ** n)
    return n, f, AXIS * f * cone(zero) ** n


def state_plane_degrees(x: Column, y: Column) -> Column:
    """struct(lon, lat) in degrees of state plane survey feet: the inverse of the two-parallel Lambert conic."""
    e = math.sqrt(GRS80)
    n, f, top = cone_constants()
    east, north = x * (FOOT / 1000) - FALSE[0], top - (y * (FOOT / 1000) - FALSE[1])
    t = F.pow(F.sqrt(east * east + north * north) / (AXIS * f), F.lit(1 / n))
    first = math.pi / 2 - 2 * F.atan(t)
    # The latitude as the projection defines it: each round brings the eccentricity's part one order nearer.
    closer = lambda p: math.pi / 2 - 2 * F.atan(t * F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2)))
    phi = F.aggregate(F.expr(f"sequence(1, {ROUNDS})"), first, lambda p, _: closer(p))
    return F.struct((F.degrees(F.atan2(east, north)) / n + ORIGIN_LON).alias("lon"), F.degrees(phi).alias("lat"))


def state_plane_utm10(points, x: str = "x", y: str = "y"):
    """Adds easting and northing (metres) to points in state plane survey feet; the two steps are columns of their own."""
    at = points.withColumn("_at", state_plane_degrees(F.col(x), F.col(y)))
    return at.withColumn("_utm", utm10(F.col("_at.lon"), F.col("_at.lat"), GRS80)).withColumns({"easting": F.col("_utm.easting"), "northing": F.col("_utm.northing")}).drop("_at", "_utm")
