"""The scene renderer, published pyramids, triangle spans and exact integers against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import intmath
from loamgrid.operators import paint, publish, render
from loamgrid.plans import registry
from loamgrid.plans.render_queries import STYLE, world

SF = "/root/testdata/sf0.001"


def ring(*points, depth=0):
    return [{"x": x, "y": y, "depth": depth} for x, y in (*points, points[0])]


RINGS = "struct<rings:array<array<struct<x:bigint,y:bigint,depth:bigint>>>>"
#: Slopes of one keep all crossings whole, so areas are exact.
SHAPES = {
    "square": [ring((0, 0), (1024, 0), (1024, 1024), (0, 1024))],
    "hole": [ring((0, 0), (2048, 0), (2048, 2048), (0, 2048)), ring((512, 512), (1024, 512), (1024, 1024), (512, 1024))],
    "diamond in a bar": [ring((0, 0), (4096, 0), (4096, 1024), (0, 1024)), ring((2048, 128), (2304, 384), (2048, 640), (1792, 384))],
    "comb": [ring((0, 0), (4096, 0), (4096, 2048), (3072, 2048), (3072, 1024), (2048, 1024), (2048, 2048), (1024, 2048), (1024, 1024), (0, 1024))],
    "hourglass": [ring((0, 0), (2048, 0), (1024, 1024), (2048, 2048), (0, 2048), (1024, 1024))],
    "flat": [ring((0, 0), (1024, 0), (2048, 0))],
}


def area(r):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r, r[1:], strict=False))


@pytest.mark.parametrize("name", SHAPES)
def test_fill_has_the_area_of_its_rings(spark, name):
    rings = SHAPES[name]
    df = spark.createDataFrame([(rings,)], RINGS)
    faces = df.select(F.expr(render.solid(render.filled("rings", 7))).alias("f")).first()["f"]
    assert sum(abs(area([f["a"], f["b"], f["c"], f["a"]])) for f in faces) == abs(area(rings[0])) - sum(abs(area(r)) for r in rings[1:])
    assert {f["v"] for f in faces} <= {7}


def even_odd(rings, x, y):
    inside = False
    for r in rings:
        for a, b in zip(r, r[1:], strict=False):
            if (a["y"] > y) != (b["y"] > y):
                side = (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])
                inside ^= side > 0 if b["y"] > a["y"] else side < 0
    return inside


@pytest.mark.parametrize("name", SHAPES)
def test_fill_covers_what_points_say(spark, name):
    rings = [[{**p, "x": p["x"] + 300, "y": p["y"] + 100} for p in r] for r in SHAPES[name]]
    faces = spark.createDataFrame([(rings,)], RINGS).select(F.posexplode(F.expr(render.solid(render.filled("rings", 7)))).alias("key", "f"))
    flat = faces.select(F.lit(0).alias("image_id"), (F.col("key") + 1).cast("bigint").alias("key"), F.lit(7).cast("bigint").alias("v"), *[F.col(f"f.{p}.{c}").alias(f"{'d' if c == 'depth' else c}{i}") for i, p in enumerate("abc") for c in ("x", "y", "depth")])
    got = {(r["y"], r["x"]) for r in paint.drawn(flat, 24, 16).collect()}
    assert got == {(y, x) for y in range(16) for x in range(24) if even_odd(rings, x * 256 + 128, y * 256 + 128)}


def test_open_ring_fills_nothing_of_odd_strips(spark):
    rings = [[{"x": 0, "y": 0, "depth": 0}, {"x": 1000, "y": 1000, "depth": 0}]]
    df = spark.createDataFrame([(rings,), ([[]],), ([],)], RINGS)
    assert [r["n"] for r in df.select(F.size(F.expr(render.filled("rings", 1))).alias("n")).collect()] == [0, 0, 0]


def whole(tiles):
    """The picture of all tiles as one array."""
    rows = tiles.collect()
    height = sum(r["height"] for r in rows if r["col"] == 0)
    width = sum(r["width"] for r in rows if r["row"] == 0)
    out = np.zeros((height, width), np.uint8)
    side = max(r["width"] for r in rows)
    for r in rows:
        out[r["row"] * side : r["row"] * side + r["height"], r["col"] * side : r["col"] * side + r["width"]] = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"])
    return out


def test_tiles_are_pieces_of_one_picture(spark):
    """No seams for any tile, guard and split of a tile's triangles; and the picture holds all kinds of things."""
    lawn = [[[{"x": x, "y": y, "z": 0} for x, y in ((0, 0), (600_000, 0), (600_000, 600_000), (0, 600_000), (0, 0))]]]
    few = world(spark, SF).where("id < 60")
    objects = few.unionByName(spark.createDataFrame([(10**6, "terrain", 0, lawn)], few.schema))
    one = whole(render.render(objects, STYLE, 4096))
    assert (whole(render.render(objects, STYLE, 64)) == one).all()
    assert (whole(render.render(objects, STYLE, 96, guard=5, piece=40)) == one).all()
    assert {STYLE.outline, STYLE.shadow, STYLE.terrain[1], STYLE.water, *STYLE.canopy} <= set(np.unique(one).tolist())


def test_scene_of_odd_objects(spark):
    """Null and empty parts, unknown classes, null heights; one object alone; none at all."""
    square = [[[{"x": 0, "y": 0, "z": 0}, {"x": 8000, "y": 0, "z": 0}, {"x": 8000, "y": 8000, "z": 0}, {"x": 0, "y": 8000, "z": 0}, {"x": 0, "y": 0, "z": 0}]]]
    shape = "id bigint, class string, height bigint, parts array<array<array<struct<x:bigint,y:bigint,z:bigint>>>>"
    rows = [(1, "building", 6000, square), (2, "castle", 5, square), (3, "road", None, square), (4, "water", 0, None), (5, "water", 0, []), (6, None, 1, square), (7, "path", 0, [[]])]
    got = render.triangles(spark.createDataFrame(rows, shape), STYLE, (0, 0)).collect()
    assert {r["id"] for r in got} == {1, 3}
    ordinals = sorted(r["ordinal"] for r in got if r["id"] == 1 and r["stage"] != render.SHADOW)
    assert ordinals == list(range(len(ordinals)))
    assert render.render(spark.createDataFrame([], shape), STYLE).count() == 0
    alone = render.render(spark.createDataFrame(rows[:1], shape), STYLE, 128).collect()
    assert len(alone) == 1 and alone[0]["drawn"] > 10


def test_guard_of_a_style():
    assert render.required_guard(STYLE) == 2 + -(-max(abs(v) for p in ((3000, -2000, 0), (2500, -2500, 0), (2500, 2500, 6000), (-2500, -2500, 6000)) for v in render.projected(*p, STYLE)) // 256)


def test_keys_equal_those_of_columns(spark):
    rows = [(i, s, o) for i in (1, 2**40, -5) for s in (1, 5) for o in (0, 3, 500)]
    df = spark.createDataFrame(rows, "i bigint, s bigint, o bigint").select("i", "s", "o", intmath.primitive_key(F.col("i"), F.col("s"), F.col("o")).alias("k"))
    got = df.collect()
    want = render.keys(*(np.array([r[c] for r in got]) for c in "iso"))
    assert [int(r["k"]) for r in got] == [int(k) for k in want]


def plain_pixels(t, width, height):
    """Every pixel against every edge, in Python's integers."""
    (x0, y0, d0), (x1, y1, d1), (x2, y2, d2) = t
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    a, b, c = (x0, y0, d0), (x1, y1, d1), (x2, y2, d2)
    whole_ = side(a, b, c)
    if whole_ == 0:
        return {}
    if whole_ < 0:
        b, c, whole_ = c, b, -whole_
    out = {}
    for y in range(height):
        for x in range(width):
            p = (x * 256 + 128, y * 256 + 128)
            w = [side(b, c, p), side(c, a, p), side(a, b, p)]
            counts = [s[1] < e[1] or (s[1] == e[1] and s[0] < e[0]) for s, e in ((b, c), (c, a), (a, b))]
            if all(v > 0 or (v == 0 and k) for v, k in zip(w, counts, strict=True)):
                total = w[0] * a[2] + w[1] * b[2] + w[2] * c[2]
                out[y, x] = abs(total) // whole_ * (1 if total >= 0 else -1)
    return out


def test_spans_cover_what_edges_say(spark):
    rng = random.Random(4)
    near = lambda: (rng.randrange(-6, 30) * 128, rng.randrange(-6, 24) * 128, rng.randrange(-900, 900))
    far = lambda: (rng.randrange(-(10**11), 10**11), rng.randrange(-(10**11), 10**11), rng.randrange(-(2**30), 2**30))
    shapes = [[near() for _ in range(3)] for _ in range(60)] + [[far() for _ in range(3)] for _ in range(20)] + [[near(), near(), far()] for _ in range(20)]
    rows = [(0, i + 1, i % 200, *[v for p in t for v in p]) for i, t in enumerate(shapes)]
    df = spark.createDataFrame(rows, "image_id bigint, key bigint, v bigint, x0 bigint, y0 bigint, d0 bigint, x1 bigint, y1 bigint, d1 bigint, x2 bigint, y2 bigint, d2 bigint")
    got = {}
    for r in paint.covered_pixels(df, 12, 9).collect():
        got.setdefault(r["key"], {})[r["y"], r["x"]] = r["depth"]
    assert got == {i + 1: p for i, t in enumerate(shapes) if (p := plain_pixels(t, 12, 9))}
    top = {}
    for key, pixels in got.items():
        for at, depth in pixels.items():
            top[at] = max(top.get(at, (-(2**62), 0, 0)), (depth, -key, (key - 1) % 200))
    assert {(r["y"], r["x"]): r["v"] for r in paint.drawn(df, 12, 9).collect()} == {at: t[2] for at, t in top.items()}
    assert {(r["y"], r["x"]): r["v"] for r in paint.on_top(paint.covered_pixels(df, 12, 9)).collect()} == {at: t[2] for at, t in top.items()}


def test_surface_draws_the_same(spark):
    """The buffer of a tile and the columns agree, also where products leave 64 bits."""
    rng = random.Random(8)
    point = lambda big: (rng.randrange(-600, 3600) * (1000 if big else 1), rng.randrange(-600, 2600) * (1000 if big else 1), rng.randrange(-(2**31), 2**31))
    shapes = [[point(i % 5 == 0) for _ in range(3)] for i in range(120)]
    s = render.Surface(0, 0, 12, 9)
    s.draw(np.array(shapes), np.arange(1, 121).astype(np.uint64), np.arange(120).astype(np.uint8), np.zeros(120, bool))
    top = {}
    for i, t in enumerate(shapes):
        for at, depth in plain_pixels(t, 12, 9).items():
            top[at] = max(top.get(at, (-(2**62), 0, 0)), (depth, -i, i))
    assert {divmod(int(i), 12): (int(s.depth[i]), int(s.colour[i])) for i in np.flatnonzero(s.depth > -(2**62))} == {at: (t[0], t[2]) for at, t in top.items()}


def test_out_of_range_depths_are_refused(spark):
    df = spark.createDataFrame([(0, 1, 5, 0, 0, 2**40, 900, 0, 0, 0, 900, 0)], "image_id bigint, key bigint, v bigint, x0 bigint, y0 bigint, d0 bigint, x1 bigint, y1 bigint, d1 bigint, x2 bigint, y2 bigint, d2 bigint")
    with pytest.raises(Exception, match="out of range"):
        paint.drawn(df, 4, 4).collect()


def test_pyramid_goes_on_from_the_last_finished_level(spark, tmp_path):
    rng = np.random.default_rng(3)
    pictures = {1: rng.integers(0, 255, (37, 70), np.uint8), 2: rng.integers(0, 255, (5, 3), np.uint8), 3: rng.integers(0, 255, (1, 1), np.uint8)}
    side = 8
    cut = [(i, c, r, *p[r * side : r * side + side, c * side : c * side + side].shape[::-1], bytes(p[r * side : r * side + side, c * side : c * side + side].tobytes())) for i, p in pictures.items() for r in range(-(-p.shape[0] // side)) for c in range(-(-p.shape[1] // side))]
    tiles = spark.createDataFrame(cut, "id bigint, col bigint, row bigint, width bigint, height bigint, pixels binary")
    sizes = spark.createDataFrame([(i, p.shape[1], p.shape[0]) for i, p in pictures.items()], "id bigint, width bigint, height bigint")
    path = f"file://{tmp_path}/pyramid"
    got = publish.publish(tiles, sizes, side, path)

    def levels(df):
        rows = df.collect()
        out = {}
        for i in pictures:
            for level in {r["level"] for r in rows if r["id"] == i}:
                out[i, level] = whole(df.where(f"id = {i} and level = {level}"))
        return out

    want = {}
    for i, p in pictures.items():
        level = (max(p.shape) - 1).bit_length()
        while level >= 0:
            want[i, level], p, level = p, p[::2, ::2], level - 1
    have = levels(got)
    assert have.keys() == want.keys() and all((have[k] == want[k]).all() for k in want)
    head = publish.encoded(got).where("id = 2 and level = 3").first()
    assert bytes(head["file"])[:16] == b"ISIDX1\0\0" + (3).to_bytes(4, "little") + (5).to_bytes(4, "little") and head["bytes"] == 16 + 15
    stamp = (tmp_path / "pyramid" / "level=6").stat().st_mtime_ns
    (tmp_path / "pyramid" / "level=3" / "_SUCCESS").unlink()  # as if the run had been cut off in level 3
    again = levels(publish.publish(tiles, sizes, side, path))
    assert all((again[k] == want[k]).all() for k in want) and (tmp_path / "pyramid" / "level=6").stat().st_mtime_ns == stamp
    with pytest.raises(ValueError, match="even"):
        publish.publish(tiles, sizes, 7, path)
    none = publish.publish(tiles.where("id = 9"), sizes.where("id = 9"), side, f"{path}-none")
    assert none.count() == 0


def test_division_is_exact(spark):
    values = [2**62, -(2**62), 2**60 + 12345, 2**53 + 3, -(2**61) - 5, 7, -7, 0, 2**63 - 1]
    rows = [(a, b) for a in values for b in (1, 3, 7, 2**40)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", intmath.div(F.col("a"), F.col("b")).alias("q"), intmath.floor_div(F.col("a"), F.col("b")).alias("f"))
    for r in df.collect():
        assert r["q"] == (abs(r["a"]) // r["b"]) * (1 if r["a"] >= 0 else -1) and r["f"] == r["a"] // r["b"]


def test_products_and_remainders_of_bit_patterns(spark):
    values = [0, 1, -1, 2**62, -(2**62), 2**63 - 1, -(2**63), 123456789123456789, 2**32 - 1, 2**32]
    signed = lambda v: (v + 2**63) % 2**64 - 2**63
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for constant in (0xBF58476D1CE4E5B9, 1, 2**64 - 1, 1099511628211):
        got = df.select("v", intmath.times(F.col("v"), constant).alias("p"), intmath.umod(F.col("v"), 361).alias("m")).collect()
        assert all(r["p"] == signed(r["v"] * constant) and r["m"] == r["v"] % 2**64 % 361 for r in got)


def test_names_are_registered_once():
    with pytest.raises(ValueError, match="already"):
        registry.query("sg12_sg1_scene_tiles")(None)


def test_fills_of_batches_are_those_of_rows(spark):
    rng = random.Random(5)
    star = lambda: ring(*[(rng.randrange(-900, 900), rng.randrange(-9, 9) * 100 + rng.randrange(2)) for _ in range(rng.randrange(1, 9))], depth=rng.randrange(-99, 99))
    rows = [(rings,) for rings in SHAPES.values()] + [([star() for _ in range(rng.randrange(4))],) for _ in range(80)] + [([[]],), ([star()[:-1]],)]
    df = spark.createDataFrame([(i, i % 3, *r) for i, r in enumerate(rows)], "id bigint, part int, " + RINGS[7:-1].replace("rings:", "rings ", 1))
    got = render.filled_rows(df, 0, "0L", 1, "rings", "id + 1").select("id", "faces")
    want = df.select("id", F.expr(render.solid(render.filled("rings", "id + 1"))).alias("faces")).where("size(faces) > 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_faces_are_made_once_and_after_rows_are_dealt_out(spark):
    plan = render.triangles(world(spark, SF), STYLE, (0, 0))._jdf.queryExecution().executedPlan().toString()
    assert not any("Filter" in line and "lambdafunction(named_struct(a" in line for line in plan.split("\n"))
