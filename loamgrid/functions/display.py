"""Small values of captures and viewers: tones, fingerprints, paths, crops and limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of red, green and blue in 256ths.
LUMA = (54, 183, 19)
#: Decoded image budgets in MiB of small and large devices, share kept, bytes of a tile, widest small screen.
BUDGETS, HEADROOM, TILE_BYTES, SMALL_SCREEN = (96, 256), 2, 1 << 20, 640
#: Fixed value: query keys whose values are secrets; shorter literals than LITERAL are left alone.
SECRET_KEYS, LITERAL = r"(?i)([?&](?:key|token|api_key)=)[^&\s]+", 6


def luma(red: Column, green: Column, blue: Column) -> Column:
    """The grey value 0 to 255, rounded half up."""
    return F.expr("0L") + F.floor((red * LUMA[0] + green * LUMA[1] + blue * LUMA[2] + 128) / 256).cast("bigint")


def unpacked_depth(low: Column, middle: Column, high: Column) -> Column:
    return (low + middle * 256 + high * 65536).cast("bigint")


def fingerprint(*values: Column) -> Column:
    """All values joined by colons."""
    return F.concat_ws(":", *[v.cast("string") for v in values])


def redacted(message: Column, secrets: list[str]) -> Column:
    """The message without values of secret query keys and without the secrets themselves."""
    out = F.regexp_replace(message, SECRET_KEYS, "$1[REDACTED]")
    for secret in secrets:
        if len(secret) >= LITERAL:
            out = F.replace(out, F.lit(secret), F.lit("[REDACTED]"))
    return out


def cached_tiles(width: Column, memory_gb: Column, coarse: Column) -> Column:
    """struct(small, tiles): whether a device counts as small, and how many decoded tiles it may keep."""
    small = (width <= SMALL_SCREEN) | (F.coalesce(memory_gb, F.lit(8)) <= 4) | coarse
    tiles = F.floor(F.when(small, BUDGETS[0]).otherwise(BUDGETS[1]) * F.lit(1 << 20).cast("bigint") / HEADROOM / TILE_BYTES).cast("bigint")
    return F.struct(small.alias("small"), tiles.alias("tiles"))


def view_of(fragment: Column, known: list[str], fallback: str) -> Column:
    """The view named by a fragment like '#view=tower', the fallback where it names none that is known."""
    value = F.regexp_extract(fragment, r"(?:^#?|&)view=([^&]*)", 1)
    return F.when(value.isin(*known), value).otherwise(fallback)


def crop(x: Column, y: Column, width: Column, height: Column, whole: int) -> Column:
    """The rectangle in millionths of the image's width."""
    part = lambda v: F.floor(v * F.lit(1_000_000).cast("bigint") / whole).cast("bigint")
    return F.struct(part(x).alias("x"), part(y).alias("y"), part(width).alias("width"), part(height).alias("height"))


def tile_path(folder: str, level: Column, col: Column, row: Column, suffix: str) -> Column:
    return F.format_string(f"{folder}/%d/%d_%d.{suffix}", level, col, row)


def zoom(factor: Column) -> Column:
    return F.least(F.greatest(factor, F.lit(1 / 32)), F.lit(32.0))


def between(start: Column, end: Column, at: Column, parts: Column) -> Column:
    """The point at / parts of the way from start to end, truncated towards zero; parts must not be 0."""
    delta = (end - start) * at
    return start + ((delta - delta % parts) / parts).cast("bigint")


def resident_bytes(text: Column) -> Column:
    """The peak resident size in the report of either common time tool; null where there is none."""
    kib = F.regexp_extract(text, r"Maximum resident set size \(kbytes\):\s*([0-9]+)", 1)
    plain = F.regexp_extract(text, r"([0-9]+)\s+maximum resident set size", 1)
    return F.when(kib != "", kib.try_cast("bigint") * 1024).when(plain != "", plain.try_cast("bigint"))
