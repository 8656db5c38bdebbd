"""Images as long tables (image_id, y, x, v): triangles, shapes, shadows, outlines, patterns and palettes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import intmath
from loamgrid.functions.durable import fanned_out
from loamgrid.functions.intmath import div, floor_div
from loamgrid.operators.checks import violations
from loamgrid.operators.geometry import edges, wide

#: Subpixels of a pixel, where in it it is sampled, and the largest vertex coordinate.
SUBPIXELS, SAMPLE, VERTEX = 256, 128, 10**12
#: Colours of classes for the reference painter; two classes have two by variation.
COLOURS = {"terrain": 1, "water": 4, "road": 9, "parking": 9, "path": 8, "athletic-surface": 12, "building": 5, "vegetation": 2, "unknown": 15}
VARIED = ("terrain", "vegetation")


def corner(c: str, i: int) -> Column:
    return F.col(f"{c}{i}")


def side(a: int, b: int, x: Column, y: Column) -> Column:
    """Twice the area between the edge from corner a to b and a point, exact."""
    return wide(corner("x", b) - corner("x", a)) * wide(y - corner("y", a)) - wide(corner("y", b) - corner("y", a)) * wide(x - corner("x", a))


def triangle_rules(triangles: DataFrame, colours: int, image: str = "image_id") -> DataFrame:
    """The broken rules of triangles (key, x0 .. y2, v): keys are unique and not 0, colours in the palette, corners in
    range and not on one line."""
    most = F.greatest(*[F.abs(corner(c, i)) for c in "xy" for i in range(3)])
    counted = triangles.withColumn("_n", F.count("*").over(Window.partitionBy(image, "key")))
    return violations(counted, F.concat_ws(":", F.col(image).cast("string"), F.col("key").cast("string")), {"key": (F.col("key") != 0) & (F.col("_n") == 1), "palette": F.col("v").between(0, colours - 1), "vertex": most <= VERTEX, "area": side(0, 1, corner("x", 2), corner("y", 2)) != 0})


def turned(triangles: DataFrame) -> DataFrame:
    """triangles that all turn left, with _area, twice their area (decimal), those without area left out."""
    back = side(0, 1, corner("x", 2), corner("y", 2)) < 0
    swap = lambda c, i: F.when(F.col("_t"), corner(c, 3 - i)).otherwise(corner(c, i))
    t = triangles.withColumn("_t", back).select("image_id", "key", "v", *[corner(c, 0) for c in "xyd"], *[swap(c, i).alias(f"{c}{i}") for c in "xyd" for i in (1, 2)])
    return t.withColumn("_area", side(0, 1, corner("x", 2), corner("y", 2))).where(F.col("_area") != 0)


def row_spans(t: DataFrame, width: int, height: int, exact) -> DataFrame:
    """turned() triangles with y and _left and _right, the first and last pixel of each row whose samples they cover.

    A sample is on the inner side of an edge where c - dy * 256 * x reaches 0 (1 for edges whose own points do not
    count), so each edge bounds x by one division. exact: how numbers are multiplied, in BIGINT or in wide decimals.
    """
    low = F.greatest(floor_div(F.least(*[corner("y", i) for i in range(3)]) - SAMPLE, SUBPIXELS), F.lit(0))
    high = F.least(floor_div(F.greatest(*[corner("y", i) for i in range(3)]) - SAMPLE, SUBPIXELS), F.lit(height - 1))
    rows = t.withColumn("y", F.explode(F.when(low <= high, F.sequence(low, high))))
    py = F.col("y") * SUBPIXELS + SAMPLE
    lefts, rights = [F.lit(0).cast("bigint")], [F.lit(width - 1).cast("bigint")]
    for a, b in ((0, 1), (1, 2), (2, 0)):
        dx, dy = corner("x", b) - corner("x", a), corner("y", b) - corner("y", a)
        least = F.when((dy > 0) | ((dy == 0) & (dx > 0)), 0).otherwise(1)
        c = exact(dx) * exact(py - corner("y", a)) + exact(dy) * exact(corner("x", a) - SAMPLE) - least
        step = exact(F.greatest(F.abs(dy), F.lit(1)) * SUBPIXELS)
        rights.append(F.when(dy > 0, floor_div(c, step)).when((dy == 0) & (c < 0), F.lit(-1).cast("bigint")))
        lefts.append(F.when(dy < 0, -floor_div(c, step)))
    # Out of an array the span is finished: the test below does not meet the divisions that made it.
    span = F.explode(F.array(F.struct(F.greatest(*lefts).alias("left"), F.least(*rights).alias("right"))))
    return rows.withColumn("_s", span).where("_s.left <= _s.right")


def covered_pixels(triangles: DataFrame, width: int, height: int) -> DataFrame:
    """A row for each triangle and pixel whose sample lies in it: image_id, y, x, v, key and depth.

    Points on an edge belong to the triangle on one side of it only: an edge counts if, turning left round the triangle, it
    goes up, or to the right. Depth is the weighted mean of the corners', truncated. Rows of triangles are solved for their
    spans, so only covered pixels are made; in BIGINT, but for triangles whose products would leave it.
    """
    t = turned(triangles)
    most = F.greatest(*[F.abs(corner(c, i)) for c in "xy" for i in range(3)])
    deep = F.greatest(*[F.abs(corner("d", i)) for i in range(3)]).cast("double")
    small = (most < 2**29) & (F.col("_area").cast("double") * deep < 2.0**59)

    def pixels(some: DataFrame, exact) -> DataFrame:
        each = row_spans(some, width, height, exact).withColumn("x", F.explode(F.sequence("_s.left", "_s.right")))
        px, py = F.col("x") * SUBPIXELS + SAMPLE, F.col("y") * SUBPIXELS + SAMPLE
        weight = lambda a, b: exact(corner("x", b) - corner("x", a)) * exact(py - corner("y", a)) - exact(corner("y", b) - corner("y", a)) * exact(px - corner("x", a))
        return each.withColumns({"_w0": weight(1, 2), "_w1": weight(2, 0), "_w2": weight(0, 1)})

    kept = ["image_id", "y", "x", "v", "key"]
    narrow = pixels(t.where(small).withColumn("_area", F.col("_area").cast("bigint")), lambda c: c)
    depth = div(F.col("_w0") * corner("d", 0) + F.col("_w1") * corner("d", 1) + F.col("_w2") * corner("d", 2), F.col("_area"))
    far = pixels(t.where(~small), wide)
    total = sum((F.col(f"_w{i}").cast("decimal(27,0)") * corner("d", i).cast("decimal(11,0)") for i in (1, 2)), F.col("_w0").cast("decimal(27,0)") * corner("d", 0).cast("decimal(11,0)"))
    area = F.col("_area").cast("decimal(27,0)")
    return narrow.select(*kept, depth.alias("depth")).unionByName(far.select(*kept, ((total - total % area) / area).cast("bigint").alias("depth")))


#: An order of depth, key and colour in one BIGINT: triangles of an image and colours at most.
TRIANGLES, COLOURS_MOST = 2**23, 2**8


def drawn(triangles: DataFrame, width: int, height: int, order: str | None = None) -> DataFrame:
    """image_id, y, x, v: the colour of the greatest depth at each pixel, of the lower key among equals.

    Keys should differ. Among equal ones the first by the column order is seen; without it the greater colour.

    Depth, the key's place among the image's and the colour are packed into one number, so that pixels are put together
    before they are shuffled, in hash tables of plain numbers. Images of more than TRIANGLES triangles, depths beyond 32
    bits and colours beyond 255 raise an error.
    """
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("key"), F.desc(order) if order else "v"))
    placed = triangles.withColumn("_v", F.col("v")).withColumn("v", place * COLOURS_MOST + F.col("v"))
    fits = F.assert_true(F.col("_v").between(0, COLOURS_MOST - 1) & (F.col("v") < TRIANGLES * COLOURS_MOST) & (F.greatest(*[F.abs(corner("d", i)) for i in range(3)]) < 2**31), "too many triangles, or a depth or colour out of range")
    pixels = covered_pixels(fanned_out(placed.where(fits.isNull()).drop("_v"), "image_id", "v"), width, height)
    top = pixels.groupBy("image_id", "y", "x").agg(F.max(F.col("depth") * (TRIANGLES * COLOURS_MOST) + F.col("v")).alias("_top"))
    return top.select("image_id", "y", "x", F.pmod(F.col("_top"), F.lit(COLOURS_MOST)).cast("bigint").alias("v"))


def on_top(pixels: DataFrame) -> DataFrame:
    """The colour of the greatest depth at each pixel of covered_pixels(), of the lower key among equals; any numbers."""
    return pixels.groupBy("image_id", "y", "x").agg(F.max_by("v", F.struct("depth", -F.col("key"))).alias("v"))


def semantic_colour(cls: Column, variation: Column) -> Column:
    base = F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), cls)
    return (base + F.when(cls.isin(*VARIED), variation).otherwise(0)).cast("bigint")


def spans(objects: DataFrame) -> DataFrame:
    """The rows of shapes(): image_id, y, id, part, cx and _from and _to, the first and last pixel from cx on; v and shade, the
    colours from cx on and to the left of it."""
    half = F.col("radius") - F.abs("_y")
    rows = objects.withColumn("_y", F.explode(F.sequence(-F.col("radius"), F.col("radius"))))
    diamond = rows.select("image_id", (F.col("cy") + div(F.col("_y"), 2)).alias("y"), "id", F.lit(0).alias("part"), "cx", (-half).alias("_from"), half.alias("_to"), "v", F.col("v").alias("shade"))
    tall = objects.where("height > 0").withColumn("_y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height") - 1)))
    wide_ = div(F.col("radius"), 2)
    column = tall.select("image_id", (F.col("cy") - F.col("_y")).alias("y"), "id", F.lit(1).alias("part"), "cx", (-wide_).alias("_from"), wide_.alias("_to"), "v", F.least(F.col("v") + 1, F.lit(15)).alias("shade"))
    return diamond.unionByName(column)


def filled(rows: DataFrame) -> DataFrame:
    """The pixels of spans()."""
    each = rows.withColumn("_x", F.explode(F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to"))))
    return each.select("image_id", "y", (F.col("cx") + F.col("_x")).alias("x"), F.when(F.col("_x") < 0, F.col("shade")).otherwise(F.col("v")).alias("v"), "id", "part")


def shapes(objects: DataFrame) -> DataFrame:
    """Pixels of a diamond and, for heights above 0, a column at each object (image_id, id, cx, cy, radius, height, v).

    Later objects cover earlier ones, and an object's column its diamond. The left half of a column is a shade darker.
    """
    return filled(spans(objects))


#: Objects that a task makes the rows of, and rows that a task fills, on the average: what bounds a task's memory, whatever the table's size.
OBJECTS_OF_A_TASK, ROWS_OF_A_TASK = 20_000, 250_000


def painted(objects: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, y, x, v of the pixels inside the image that shapes() fill.

    Rows of shapes are shuffled, by image and row, not pixels; a task then holds the pixels of its rows of images only, in a
    hash table of plain numbers, but for ids that do not fit in one with part and colour. The number of tasks grows with the
    objects.
    """
    least = int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = F.bool_and(F.col("id").between(0, 2**54 - 1) & F.col("v").between(0, 254))
    n, rows, plain = objects.agg(F.count("*"), F.sum(2 * F.col("radius") + 1 + F.greatest("height", F.lit(0))), small).first()
    dealt = objects.repartition(max(least, n // OBJECTS_OF_A_TASK), "image_id", "id")
    inside = spans(dealt).withColumns({"_from": F.greatest("_from", -F.col("cx")), "_to": F.least("_to", width - 1 - F.col("cx"))}).where(F.col("y").between(0, height - 1) & (F.col("_from") <= F.col("_to")))
    pixels = filled(inside.repartition(max(least, (rows or 0) // ROWS_OF_A_TASK), "image_id", "y")).groupBy("image_id", "y", "x")
    if not plain:
        return pixels.agg(F.max_by("v", F.struct("id", "part")).alias("v"))
    top = pixels.agg(F.max((F.col("id") * 2 + F.col("part")) * 256 + F.col("v")).alias("_top"))
    return top.select("image_id", "y", "x", F.pmod("_top", F.lit(256)).cast("bigint").alias("v"))


def shaded(image: DataFrame, shadows: DataFrame, eligible: list[int], shadow: int) -> DataFrame:
    """image with the shadow's colour where shadows (image_id, y, x) fall on an eligible colour."""
    both = image.join(shadows.select("image_id", "y", "x", F.lit(True).alias("_s")), ["image_id", "y", "x"], "left")
    return both.select("image_id", "y", "x", F.when(F.col("_s") & F.col("v").isin(eligible), shadow).otherwise(F.col("v")).alias("v"))


def outlined(image: DataFrame, families: dict[int, int], outline: int, width: int, height: int) -> DataFrame:
    """image with the outline's colour at pixels of a family next to one of another or of none; borders stay."""
    family = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in families.items() for x in kv]), F.col("v").cast("int")), F.lit(0))
    rows, columns = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    known = image.withColumn("_f", family)
    near = known.withColumns({"_l": F.lag("_f").over(rows), "_r": F.lead("_f").over(rows)}).withColumns({"_u": F.lag("_f").over(columns), "_d": F.lead("_f").over(columns)})
    inner = F.col("x").between(1, width - 2) & F.col("y").between(1, height - 2)
    other = (F.col("_l") != F.col("_f")) | (F.col("_r") != F.col("_f")) | (F.col("_u") != F.col("_f")) | (F.col("_d") != F.col("_f"))
    return near.select("image_id", "y", "x", F.when(inner & (F.col("_f") != 0) & F.coalesce(other, F.lit(False)), outline).otherwise(F.col("v")).alias("v"))


def patterned(image: DataFrame, style: dict, offset_x: int, offset_y: int) -> DataFrame:
    """image with patterns that lie still in the world: the first rule that fits recolours a pixel.

    style: subpixels, roofs (colours), roof_pattern, roof_period, road, marking, path, highlight, way_period, terrain and
    athletic (a pair and a period of dither each), parking (a pair and a period of lines).
    """
    s, v = style["subpixels"], F.col("v")
    ax, ay = F.col("x") * s - offset_x, F.col("y") * s - offset_y
    lx, ly = floor_div(ax, s), floor_div(ay, s)
    image = image.withColumn("_dither", intmath.mix64(intmath.rotated(ax, 13).bitwiseXOR(ay)))
    down, up = lx - ly, lx + ly
    at = lambda line, n: F.pmod(line, F.lit(n))
    rare = lambda n: intmath.umod(F.col("_dither"), n) == 0
    out = F.when(v.isin(style["roofs"]) & (at(down, style["roof_period"]) == 0) & (at(up, 4) < 2), style["roof_pattern"])
    out = out.when((v == style["road"]) & (at(up, style["way_period"] * 2) == 0) & (at(down, 8) < 4), style["marking"]).when((v == style["path"]) & (at(down, style["way_period"]) == 0) & (at(up, 6) < 2), style["highlight"])
    for pair, period in (style["terrain"], style["athletic"]):
        out = out.when((v == pair[0]) & rare(period), pair[1])
    pair, period = style["parking"]
    return image.select("image_id", "y", "x", out.when((v == pair[0]) & (at(up, period) == 0), pair[1]).otherwise(v).alias("v"))


def masked(image: DataFrame, ground: list[int], outline: int) -> DataFrame:
    """1 where a pixel is neither ground nor shadow, as the outline's colour; else 0."""
    return image.select("image_id", "y", "x", F.when(F.col("v").isin(ground), 0).otherwise(outline).alias("v"))


def coloured(image: DataFrame, palette: DataFrame) -> DataFrame:
    """image with rgb of the palette (v, rgb); rgb is null where the palette lacks the index, which is an error of the image."""
    return image.join(F.broadcast(palette.where(F.col("v").between(0, 255)).dropDuplicates(["v"])), "v", "left")  # 256 rows at most


def walls(objects: DataFrame) -> DataFrame:
    """Two triangles for each edge of an object's ring (id, ring, height): id, ordinal, part and corners a, b, c of (x, y, z).

    light: whether the edge goes at least as far in x as in y. Edges of no length take no ordinal.
    """
    e = objects.select("id", "height", F.explode(edges(F.col("ring"))).alias("_e")).where("_e.a <> _e.b")
    low, high = F.lit(0).cast("bigint"), F.col("height")
    at = lambda p, z: F.struct(F.col(f"_e.{p}.x").alias("x"), F.col(f"_e.{p}.y").alias("y"), z.cast("bigint").alias("z"))
    pair = F.array(F.struct(F.lit(0).alias("part"), at("a", low).alias("a"), at("b", low).alias("b"), at("b", high).alias("c")), F.struct(F.lit(1).alias("part"), at("a", low).alias("a"), at("b", high).alias("b"), at("a", high).alias("c")))
    light = (F.col("_e.b.x") - F.col("_e.a.x")) >= (F.col("_e.b.y") - F.col("_e.a.y"))
    each = e.select("id", "_e.i", light.alias("light"), F.explode(pair).alias("_t")).select("id", "i", "light", "_t.*")
    order = Window.partitionBy("id").orderBy("i", "part")
    return each.withColumn("ordinal", (F.row_number().over(order) - 1).cast("bigint"))


def shifted(rings: DataFrame, height: str, x_per_mm: int, y_per_mm: int, scale: int = 1000) -> DataFrame:
    """rings with their shadow: every point moved by a share of the height, in thousandths, truncated."""
    dx, dy = div(F.col(height) * x_per_mm, scale), div(F.col(height) * y_per_mm, scale)
    return rings.withColumn("shadow", F.transform("ring", lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))))


def core_coverage(coverage: DataFrame, guard: int, width: int, height: int) -> DataFrame:
    """image_id and the share of pixels inside the guard with coverage of 128 or more, in hundredths of a percent."""
    core = coverage.where(F.col("x").between(guard, guard + width - 1) & F.col("y").between(guard, guard + height - 1))
    return core.groupBy("image_id").agg(floor_div(F.count_if(F.col("v") >= 128) * 10_000, width * height).alias("coverage_bp"))


def depth_tones(depth: DataFrame) -> DataFrame:
    """A preview tone of every depth: 255 for the least above 0 down to 35 for the greatest; 0 stays 0."""
    whole = Window.partitionBy("image_id")
    low, high = F.min(F.when(F.col("v") > 0, F.col("v"))).over(whole), F.max("v").over(whole)
    tone = 255 - F.floor((F.col("v") - F.col("_lo")) * 220.0 / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)) + 0.5)
    return depth.withColumns({"_lo": low, "_hi": high}).select("image_id", "y", "x", F.when(F.col("v") > 0, tone).otherwise(0).cast("bigint").alias("tone"))


def colour_changes(image: DataFrame) -> DataFrame:
    """Distinct colours and changes of colour to the right and down, in millionths of the pairs, of each image."""
    rows, columns = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    marks = image.withColumn("_r", (F.lead("v").over(rows) != F.col("v")).cast("bigint")).withColumn("_d", (F.lead("v").over(columns) != F.col("v")).cast("bigint"))
    n = marks.groupBy("image_id").agg(F.countDistinct("v").alias("colours"), F.coalesce(F.sum("_r"), F.lit(0)).alias("_a"), F.coalesce(F.sum("_d"), F.lit(0)).alias("_b"), (F.count("_r") + F.count("_d")).alias("_pairs"))
    return n.select("image_id", "colours", F.when(F.col("_pairs") > 0, floor_div((F.col("_a") + F.col("_b")) * 1_000_000, F.col("_pairs"))).otherwise(0).alias("changes_ppm"))
