"""Exact integer geometry on rings: arrays of (x, y) points, closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.intmath import div

#: Points of a ring, the largest coordinate in mm, and planes of a hip roof at most.
POINTS, COORDINATE, PLANES = (4, 2049), 10_000_000_000, 32


def wide(v: Column) -> Column:
    return v.cast("decimal(18,0)")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))


def edges(ring: Column) -> Column:
    """The ring's edges in order as structs of both end points and the number i of the edge."""
    n = F.size(ring)
    ends = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(ends, lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), i.alias("i")))


def doubled_area(ring: Column) -> Column:
    """Twice the signed area, exact."""
    return F.aggregate(edges(ring), F.lit(0).cast("decimal(38,0)"), lambda s, e: (s + wide(e["a"]["x"]) * wide(e["b"]["y"]) - wide(e["b"]["x"]) * wide(e["a"]["y"])).cast("decimal(38,0)"))


def turn(a: Column, b: Column, p: Column) -> Column:
    """Above 0 if p lies left of the way from a to b, below 0 right of it, 0 on its line."""
    return wide(b["x"] - a["x"]) * wide(p["y"] - a["y"]) - wide(b["y"] - a["y"]) * wide(p["x"] - a["x"])


def in_box(p: Column, a: Column, b: Column) -> Column:
    return p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two segments have a point in common; a touch and an overlap on one line count."""
    sides = [turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)]
    touch = [(sides[0] == 0) & in_box(c, a, b), (sides[1] == 0) & in_box(d, a, b), (sides[2] == 0) & in_box(a, c, d), (sides[3] == 0) & in_box(b, c, d)]
    cross = (F.signum(sides[0]) * F.signum(sides[1]) < 0) & (F.signum(sides[2]) * F.signum(sides[3]) < 0)
    return touch[0] | touch[1] | touch[2] | touch[3] | cross


def even_odd(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in the ring by crossings; an edge counts from its lower end up to below its upper end."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        side = wide(b["x"] - a["x"]) * wide(y - a["y"]) - wide(x - a["x"]) * wide(b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & F.when(b["y"] > a["y"], side > 0).otherwise(side < 0)

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def winding(ring: Column, p: Column) -> Column:
    """How often the ring goes round a point; another rule than even_odd() on borders and for rings that cross themselves."""

    def step(total: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        side = turn(a, b, p)
        return total + F.when((a["y"] <= p["y"]) & (b["y"] > p["y"]) & (side > 0), 1).when((a["y"] > p["y"]) & (b["y"] <= p["y"]) & (side < 0), -1).otherwise(0)

    return F.aggregate(edges(ring), F.lit(0), step)


def in_polygon(rings: Column, p: Column) -> Column:
    """Whether a point lies in the first ring and in no other, by winding()."""
    return (winding(rings[0], p) != 0) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1))), lambda r: winding(r, p) != 0)


def in_parts(parts: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in any part, each an array of rings, the first one without the others, by even_odd()."""
    inside = lambda rings: even_odd(rings[0], x, y) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1))), lambda r: even_odd(r, x, y))
    return F.exists(parts, inside)


def rings_meet(one: Column, two: Column) -> Column:
    return F.exists(edges(one), lambda e: F.exists(edges(two), lambda f: meet(e["a"], e["b"], f["a"], f["b"])))


def crosses_itself(ring: Column) -> Column:
    """Whether two edges that are no neighbours have a point in common. At most POINTS[1] edges meet each other in a row."""
    last = F.size(ring) - 2
    apart = lambda e, f: (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == last))
    return F.exists(edges(ring), lambda e: F.exists(edges(ring), lambda f: apart(e, f) & meet(e["a"], e["b"], f["a"], f["b"])))


def ring_rules(ring: Column) -> dict[str, Column]:
    """What must hold of a ring, in the order in which it is asked; each is null-safe only if those before it hold."""
    small = lambda v: F.abs(v) <= COORDINATE
    return {
        "count": F.size(ring).between(*POINTS), "closed": ring[0] == F.element_at(ring, -1), "repeated": ~F.exists(edges(ring), lambda e: e["a"] == e["b"]),
        "range": ~F.exists(ring, lambda p: ~(small(p["x"]) & small(p["y"]))), "area": doubled_area(ring) != 0, "simple": ~crosses_itself(ring),
    }


def first_broken(rules: dict[str, Column]) -> Column:
    """The name of the first rule that does not hold, null if all do."""
    out = None
    for name, ok in rules.items():
        out = F.when(~ok, name) if out is None else out.when(~ok, name)
    return out


def polygon_problem(rings: Column) -> Column:
    """'hole' if a hole does not lie strictly inside the shell, 'overlap' if two holes meet or hold each other, else null."""
    shell, holes = rings[0], F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1)))
    outside = F.exists(holes, lambda h: rings_meet(shell, h) | (winding(shell, h[0]) == 0))
    numbered = F.transform(holes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    both = F.exists(numbered, lambda a: F.exists(numbered, lambda b: (a["i"] < b["i"]) & (rings_meet(a["h"], b["h"]) | (winding(b["h"], a["h"][0]) != 0) | (winding(a["h"], b["h"][0]) != 0))))
    return F.when(outside, "hole").when(both, "overlap")


def closed_path(points: Column) -> Column:
    """The points without repeats of the one before, closed if three or more remain and the ends differ."""
    apart = F.filter(points, lambda p, i: (i == 0) | (p != F.element_at(points, F.greatest(i, F.lit(1)))))
    return F.when((F.size(apart) >= 3) & (apart[0] != F.element_at(apart, -1)), F.concat(apart, F.slice(apart, 1, 1))).otherwise(apart)


def bounds(parts: Column, height: Column) -> Column:
    """The box of all points of the parts; height goes on top of z, which is 0 on the ground."""
    every = F.flatten(F.flatten(parts))
    low = lambda c: F.array_min(F.transform(every, lambda p: p[c]))
    high = lambda c: F.array_max(F.transform(every, lambda p: p[c]))
    return F.struct(low("x").alias("min_x"), low("y").alias("min_y"), high("x").alias("max_x"), high("y").alias("max_y"), height.alias("max_z"))


def centre(ring: Column) -> Column:
    """The mean of the ring's points without the closing one, truncated towards zero."""
    open_ = F.slice(ring, 1, F.size(ring) - 1)
    mean = lambda c: div(F.aggregate(open_, F.lit(0).cast("bigint"), lambda s, p: s + p[c]), F.size(open_).cast("bigint"))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def rectangle(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """The closed counter-clockwise ring of a rectangle."""
    return F.array(point(min_x, min_y), point(max_x, min_y), point(max_x, max_y), point(min_x, max_y), point(min_x, min_y))


def buffered(a: Column, b: Column, width: Column) -> Column:
    """The rectangle of a width along a segment, closed; null for a segment under 1 mm."""
    dx, dy = (b["x"] - a["x"]).cast("double"), (b["y"] - a["y"]).cast("double")
    length = F.hypot(dx, dy)
    ox, oy = F.round(-dy / length * (width / 2)).cast("bigint"), F.round(dx / length * (width / 2)).cast("bigint")
    ring = F.array(point(a["x"] + ox, a["y"] + oy), point(b["x"] + ox, b["y"] + oy), point(b["x"] - ox, b["y"] - oy), point(a["x"] - ox, a["y"] - oy), point(a["x"] + ox, a["y"] + oy))
    return F.when(length >= 1, ring)


def convex(ring: Column) -> Column:
    """Whether the ring never turns both ways; points on a line are allowed."""
    n = F.size(ring) - 1
    at = lambda i: F.element_at(ring, (i % n).cast("int") + 1)
    signs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.signum(turn(at(i), at(i + 1), at(i + 2))))
    return ~(F.exists(signs, lambda s: s > 0) & F.exists(signs, lambda s: s < 0))


def segments(paths: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each edge of path, in order: the columns of keep, i, a and b."""
    return paths.select(*keep, F.explode(edges(F.col("path"))).alias("_e")).select(*keep, F.col("_e.i").cast("bigint").alias("i"), "_e.a", "_e.b")


def road_pieces(ways: DataFrame) -> DataFrame:
    """way_id, piece and ring of the rectangles of ways (way_id, path, width); too short segments take no number away."""
    return segments(ways, ["way_id", "width"]).withColumn("ring", buffered(F.col("a"), F.col("b"), F.col("width"))).where("ring is not null").select("way_id", F.col("i").alias("piece"), "ring")


def longest_edge(rings: DataFrame, key: str) -> DataFrame:
    """key, i and squared length of the longest edge of each ring, the last one of those."""
    e = rings.select(key, F.explode(edges(F.col("ring"))).alias("_e"))
    dx, dy = F.col("_e.b.x") - F.col("_e.a.x"), F.col("_e.b.y") - F.col("_e.a.y")
    best = e.groupBy(key).agg(F.max(F.struct((dx * dx + dy * dy).alias("squared"), F.col("_e.i").cast("bigint").alias("i"))).alias("m"))
    return best.select(key, "m.i", "m.squared")


def crossing_pairs(rings: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Pairs of edges that cross the strip between low and high, left to right: key, pair (from 1), left and right.

    Edges that reach from low or below to high or above count; their order is that of the sum of their x at low and
    at high, then their number. An odd count leaves right null.
    """
    e = rings.select(key, low, high, F.explode(edges(F.col("ring"))).alias("_e"))
    a, b = F.col("_e.a"), F.col("_e.b")
    bottom, top = F.when(a["y"] <= b["y"], a).otherwise(b), F.when(a["y"] <= b["y"], b).otherwise(a)
    cut = e.select(key, low, high, F.col("_e.i").alias("i"), bottom.alias("p"), top.alias("q")).where((F.col("p.y") <= F.col(low)) & (F.col("q.y") >= F.col(high)) & (F.col("p.y") < F.col("q.y")))
    at = lambda y: F.col("p.x") + div((F.col("q.x") - F.col("p.x")) * (y - F.col("p.y")), F.col("q.y") - F.col("p.y"))
    order = Window.partitionBy(key, low).orderBy(at(F.col(low)) + at(F.col(high)), "i")
    ranked = cut.withColumn("_n", F.row_number().over(order)).withColumn("pair", F.expr("(_n + 1) div 2"))
    return ranked.groupBy(key, low, high, "pair").agg(F.max(F.when(F.col("_n") % 2 == 1, F.col("i"))).cast("bigint").alias("left"), F.max(F.when(F.col("_n") % 2 == 0, F.col("i"))).cast("bigint").alias("right"))
