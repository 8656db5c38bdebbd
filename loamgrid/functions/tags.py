"""Map-feature tags (MAP<STRING, STRING>) to typed values."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: Default widths in mm by kind of highway; other kinds have WIDTH.
WIDTHS = {"tertiary": 10_000, "residential": 7_000, "unclassified": 7_000, "service": 5_000, "living_street": 5_000, "pedestrian": 4_000, "cycleway": 2_500, "steps": 2_000}
WIDTH = 2_200
#: Roof kinds by roof:shape; other shapes are unknown.
ROOFS = {"gabled": "gabled", "hipped": "hipped", "pyramidal": "pyramidal", "skillion": "shed", "flat": "flat"}
#: A storey's height and that of a building without evidence, mm.
STOREY, UNKNOWN_HEIGHT = 3_600, 9_000


def first_part(value: Column) -> Column:
    """The text before the first semicolon, trimmed."""
    return F.trim(F.split_part(value, F.lit(";"), F.lit(1)))


def number(value: Column) -> Column:
    """The value as a double, null where it is no plain number; Spark's own cast takes '5d' too."""
    text = first_part(value)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def small_count(value: Column) -> Column:
    """The value as a whole number of 0 to 65535, else null."""
    text = first_part(value)
    n = F.when(text.rlike("^[+]?[0-9]+$"), text.try_cast("bigint"))
    return F.when(n <= 65_535, n)


def millimetres(metres: Column) -> Column:
    """Metres of 0 to 1000 in mm, rounded half away from zero; null beyond."""
    return F.when(metres.between(0.0, 1000.0), F.round(metres * 1000).cast("bigint"))


def way_id(record: Column) -> Column:
    """123 of 'w123@4'; null for other records and beyond 64 bits."""
    digits = F.regexp_extract(record, "^w[+]?([0-9]+)(@|$)", 1)
    n = F.when(digits != "", digits.try_cast("decimal(38,0)"))
    return F.when(n < F.lit(Decimal(2**64)), n).cast("decimal(20,0)")


def road_width(tags: Column) -> Column:
    """The width tag in mm where it is a width, else the default of the kind of highway."""
    kind = tags["highway"]
    default = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WIDTHS.items() for x in kv]), kind), F.lit(WIDTH)).cast("bigint")
    return F.when(kind.isNotNull(), F.coalesce(millimetres(number(tags["width"])), default))


def surface(tags: Column) -> Column:
    """struct(class, material) of a surface, the first rule that fits; null for none."""
    rules = [
        (tags["natural"] == "water", "water", "water"), (tags["natural"] == "wood", "vegetation", "broadleaf"), (tags["amenity"] == "parking", "parking", "asphalt"),
        (tags["leisure"] == "pitch", "athletic-surface", "athletic-turf"), (tags["landuse"].isNotNull() | tags["leisure"].isin("park", "common", "garden"), "terrain", "grass"),
    ]
    out = None
    for holds, cls, material in rules:
        value = F.struct(F.lit(cls).alias("class"), F.lit(material).alias("material"))
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out


def roof(tags: Column) -> Column:
    """struct(kind, direction in thousandths of a degree, 0 to 360000) of the roof tags; null without a shape."""
    shape = tags["roof:shape"]
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROOFS.items() for x in kv]), shape), F.lit("unknown"))
    turn = F.coalesce(F.round(F.pmod(number(tags["roof:direction"]), F.lit(360.0)) * 1000).cast("bigint"), F.lit(0))
    return F.when(shape.isNotNull(), F.struct(kind.alias("kind"), turn.alias("direction")))


def height(metres: Column, floors: Column, sure: int, guessed: int) -> Column:
    """struct(height_mm, confidence_bp, wrong): the explicit height, else floors, else a default of lower confidence.

    A height that is there but outside 0 to 1000 m is wrong, not passed over: height_mm is then null.
    """
    wrong = F.coalesce(metres.isNotNull() & millimetres(metres).isNull(), F.lit(False))
    mm = F.coalesce(millimetres(metres), floors * STOREY, F.lit(UNKNOWN_HEIGHT)).cast("bigint")
    bp = F.when(metres.isNull() & floors.isNull(), guessed).otherwise(sure).cast("bigint")
    return F.struct(F.when(~wrong, mm).alias("height_mm"), bp.alias("confidence_bp"), wrong.alias("wrong"))
