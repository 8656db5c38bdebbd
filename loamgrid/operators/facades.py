"""Openings of walls: a table function from a polygon to its windows, accents and door, bounded by definition."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: The least height of a wall with openings, of which so much is no floor; the first sill, what stays free
#: below the eaves, and the openings' own lift; floors, bays and quads of a polygon at most; the least half width.
LEAST_HEIGHT, PLINTH, SILL, EAVES, LIFT = 4_500, 2_000, 1_500, 750, 50
FLOORS, BAYS, QUADS, HALF_WIDTH = 8, 16, 512, 250
#: Every so many-th variant is left blank, or has an accent above, from and to so far over the opening; the
#: door's sill and what stays free above it.
BLANK, ACCENT, ACCENT_FROM, ACCENT_TO, DOOR_SILL, DOOR_FREE = 13, 5, 200, 450, 100, 500
MASK = 2**64 - 1
QUAD = "n bigint, kind string, ring int, edge int, floor int, bay int, x0 bigint, y0 bigint, x1 bigint, y1 bigint, z bigint, low bigint, high bigint, v int"


@dataclass(frozen=True)
class Facade:
    """Measures in mm (window and door: width, height) and palette indexes. varied: colours, blanks, accents and doors by hash."""

    floor: int = 3_000
    bay: int = 1_500
    window: tuple[int, int] = (800, 1_400)
    door: tuple[int, int] = (1_200, 2_200)
    windows: tuple[int, int] = (20, 21)
    door_colour: int = 22
    accent: int = 23
    varied: bool = True


def mix(x: int) -> int:
    for by, multiplier in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> by) * multiplier & MASK
    return x ^ x >> 31


def variant(object_id: int, *parts: int) -> int:
    """intmath.facade_variant of ring, edge, floor and bay."""
    x = object_id & MASK
    for part, by in zip(parts, (11, 23, 37, 49), strict=True):
        x ^= (part << by | part >> 64 - by) & MASK
    return mix(x)


def choice(object_id: int, n: int) -> int:
    """intmath.variation."""
    x = object_id & MASK
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & MASK
    return (x ^ x >> 33) % n


def cut(a: int, b: int) -> int:
    return abs(a) // b * (1 if a >= 0 else -1)


def openings(object_id: int, rings: list[list[Row]], height: int, style: Facade) -> Iterator[tuple]:
    """The quads of a polygon's walls, in order; windows and accents end at QUADS, and the door comes last."""
    if height < LEAST_HEIGHT or not rings:
        return
    floors = min(max((height - PLINTH) // style.floor, 1), FLOORS)
    n = 0

    def quad(kind: str, place: tuple, a: Row, b: Row, share: tuple[int, int], half: int, low: int, high: int, colour: int) -> tuple:
        dx, dy, dz = b.x - a.x, b.y - a.y, b.z - a.z
        length = max(abs(dx), abs(dy))
        x, y, z = (s + cut(d * share[0], share[1]) for s, d in ((a.x, dx), (a.y, dy), (a.z, dz)))
        ax, ay = cut(dx * half, length), cut(dy * half, length)
        return (n, kind, *place, x - ax, y - ay, x + ax, y + ay, z, low, high, colour)

    for r, ring in enumerate(rings):
        for e, (a, b) in enumerate(zip(ring, ring[1:], strict=False)):
            length = max(abs(b.x - a.x), abs(b.y - a.y))
            if length < style.window[0] * 2:
                continue
            bays = min(max(length // style.bay, 1), BAYS)
            half = max(min(style.window[0] // 2, length // (bays + 1) // 3), HALF_WIDTH)
            for floor in range(floors):
                low = SILL + floor * style.floor
                high = min(low + style.window[1], height - EAVES)
                if high <= low:
                    continue
                for bay in range(bays):
                    if n == QUADS:
                        break
                    way = variant(object_id, r, e, floor, bay)
                    if style.varied and way % BLANK == 0:
                        continue
                    share, place = (bay + 1, bays + 1), (r, e, floor, bay)
                    colour = style.windows[way % 2 if style.varied else int(b.x - a.x < b.y - a.y)]
                    yield quad("window", place, a, b, share, half, low + LIFT, high + LIFT, colour)
                    n += 1
                    if style.varied and way % ACCENT == 0 and n < QUADS and high + ACCENT_TO < height:
                        yield quad("accent", place, a, b, share, half, high + ACCENT_FROM, high + ACCENT_TO, style.accent)
                        n += 1
    ends = [(max(abs(b.x - a.x), abs(b.y - a.y)), e, a, b) for e, (a, b) in enumerate(zip(rings[0], rings[0][1:], strict=False))]
    if not ends:
        return
    length, e, a, b = max(ends, key=lambda x: x[:2])
    if length >= style.door[0] * 2:
        share = (choice(object_id, 3) + 1, 4) if style.varied else (1, 2)
        yield quad("door", (0, e, 0, 0), a, b, share, style.door[0] // 2, DOOR_SILL, min(style.door[1], height - DOOR_FREE), style.door_colour)


def facades(objects: DataFrame, style: Facade, keep: tuple[str, ...] = ("id", "part")) -> DataFrame:
    """The columns of keep and the openings of polygons (id, rings of points x, y, z, height): n, kind, ring, edge, floor,
    bay, both ends x0, y0, x1, y1 and their z, low, high and v.

    A polygon has QUADS windows and accents at most, by definition, and one door on its longest edge, of equals the last.
    Low walls, short edges, and null or empty polygons have none.
    """

    class Openings:
        def eval(self, object_id: int, rings: list, height: int):
            if object_id is not None and rings and height is not None:
                yield from openings(object_id, [r for r in rings if r is not None], height, style)

    cut_off = F.udtf(Openings, returnType=QUAD)
    return objects.lateralJoin(cut_off(F.col("id").outer(), F.col("rings").outer(), F.col("height").outer())).select(*keep, *[c.split()[0] for c in QUAD.split(", ")])
