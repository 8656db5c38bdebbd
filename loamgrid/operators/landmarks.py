"""Landmarks from templates: solids in local coordinates, a row each, set up at anchors by a join.

No landmark has code of its own: what it consists of is a table of templates, and where it stands a table of anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.intmath import div

#: Local axes are given in thousandths.
AXIS = 1_000
#: Corners of a solid's outline, by halves of its width and length, closed.
CORNERS = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))


def oriented(u: Column, v: Column, z: Column) -> Column:
    """struct(x, y, z): a local point of a row with x, y, z and the axes ux, uy, vx, vy; each sum is truncated once."""
    at = lambda c: F.col(c) + div(F.col(f"u{c}") * u + F.col(f"v{c}") * v, AXIS)
    return F.struct(at("x").alias("x"), at("y").alias("y"), (F.col("z") + z).alias("z"))


def outline(u: Column, v: Column, half_u: Column, half_v: Column, z: Column) -> Column:
    """The closed ring of an oriented rectangle round a local point."""
    return F.array(*[oriented(u + half_u * a, v + half_v * b, z) for a, b in CORNERS])


def set_up(anchors: DataFrame, templates: DataFrame) -> DataFrame:
    """id, part, face, a, b, c (x, y, z) and v of the triangles of every landmark.

    anchors: id, template, x, y, z and the axes ux, uy, vx, vy in thousandths. templates: template, part, kind, u, v,
    half_u, half_v, low, high, wall and roof, colours. kind: 'prism' has four walls of two triangles and a roof of two,
    'pyramid' four triangles that meet at its top, 'panel' one upright face of two along its u axis. Faces are numbered
    over a landmark's parts in order. Other kinds and templates without an anchor, or without parts, give nothing.
    """
    parts = anchors.join(templates, "template").where(F.col("kind").isin("prism", "pyramid", "panel"))
    rings = {end: outline(F.col("u"), F.col("v"), F.col("half_u"), F.when(F.col("kind") == "panel", 0).otherwise(F.col("half_v")), F.col(end)) for end in ("low", "high")}
    made = parts.withColumns({"_low": rings["low"], "_high": rings["high"], "_top": oriented(F.col("u"), F.col("v"), F.col("high"))})
    low, high = (lambda i: F.col("_low")[i]), (lambda i: F.col("_high")[i])
    face = lambda a, b, c, v: F.struct(a.alias("a"), b.alias("b"), c.alias("c"), F.col(v).alias("v"))
    wall = lambda i: [face(low(i), low(i + 1), high(i + 1), "wall"), face(low(i), high(i + 1), high(i), "wall")]
    walls = F.array(*[f for i in range(4) for f in wall(i)], face(high(0), high(1), high(2), "roof"), face(high(0), high(2), high(3), "roof"))
    slopes = F.array(*[face(low(i), low(i + 1), F.col("_top"), "roof") for i in range(4)])
    faces = F.when(F.col("kind") == "prism", walls).when(F.col("kind") == "pyramid", slopes).otherwise(F.array(*wall(0)))
    each = made.select("id", "part", F.posexplode(faces).alias("_i", "_f"))
    order = Window.partitionBy("id").orderBy("part", "_i")  # a template's faces
    return each.select("id", "part", (F.row_number().over(order) - 1).cast("bigint").alias("face"), "_f.*")
