"""Binary layers: masks, depth grids, indexed tiles and image headers, read from and written to BINARY columns.

Headers are checked by Column expressions on the first bytes. Records of a file become rows in Arrow batches; a file is
bounded by the side its header may state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Magic bytes, bytes of a mask header and record, and the largest side.
MASK, DEPTH, TILE, PNG = "ISOMSKV1", "ISOD32V1", "ISIDX1", "89504E470D0A1A0A"
HEADER, RECORD, SIDE = 20, 8, 16_384
#: PNG colour types by name.
PNG_KINDS = {"rgba": 6, "grey": 0}


def little(content: Column, at: int, size: int = 4) -> Column:
    """The unsigned little-endian number of so many bytes at an offset."""
    byte = lambda i: F.conv(F.hex(F.substring(content, at + i + 1, 1)), 16, 10).cast("bigint") * 256**i
    return sum((byte(i) for i in range(1, size)), byte(0))


def little_hex(value: Column, size: int = 4) -> Column:
    byte = lambda i: F.lpad(F.hex((F.shiftright(value.cast("bigint"), 8 * i)).bitwiseAND(255)), 2, "0")
    return F.concat(*[byte(i) for i in range(size)])


def begins(content: Column, magic: str, size: int) -> Column:
    return F.hex(F.substring(content, 1, size)) == magic.encode().hex().upper().ljust(2 * size, "0")


def grid_header(content: Column, magic: str, header: int, record: int) -> Column:
    """struct(width, height, valid): valid if the magic, the sides and the length of what follows agree."""
    width, height = little(content, 8), little(content, 12)
    sides = width.between(1, SIDE) & height.between(1, SIDE)
    return F.struct(width.alias("width"), height.alias("height"), F.coalesce(begins(content, magic, 8) & sides & (F.octet_length(content) == header + width * height * record), F.lit(False)).alias("valid"))


def depth_header(content: Column) -> Column:
    return grid_header(content, DEPTH, 16, 4)


def mask_header(content: Column) -> Column:
    """grid_header() of a mask; the record size and two zero bytes must be right too."""
    at = grid_header(content, MASK, HEADER, RECORD)
    return F.struct(at["width"].alias("width"), at["height"].alias("height"), (at["valid"] & (little(content, 16, 2) == RECORD) & (little(content, 18, 2) == 0)).alias("valid"))


def tile_header(content: Column, colours: Column) -> Column:
    """grid_header() of an indexed tile; every byte after the header must be below the number of colours."""
    at = grid_header(content, TILE, 16, 1)
    body = F.hex(F.substring(content, 17, SIDE * SIDE))
    worst = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(body) - 1, F.lit(1)), F.lit(2)), F.lit(0).cast("bigint"), lambda m, i: F.greatest(m, F.conv(F.substring(body, i, F.lit(2)), 16, 10).cast("bigint")))
    return F.struct(at["width"].alias("width"), at["height"].alias("height"), (at["valid"] & (worst < colours)).alias("valid"))


def png_header(content: Column, kind: str) -> Column:
    """Whether content begins like an 8-bit PNG of the kind: signature, header length and name, depth and colour type."""
    part = lambda at, size: F.hex(F.substring(content, at + 1, size))
    ok = (part(0, 8) == PNG) & (part(8, 4) == "0000000D") & (part(12, 4) == b"IHDR".hex().upper()) & (part(24, 1) == "08") & (part(25, 1) == f"{PNG_KINDS[kind]:02X}")
    return F.coalesce(ok, F.lit(False))


def mask_pixels(files: DataFrame) -> DataFrame:
    """file_id, y, x, class, confidence, evidence and instance of every record of files (file_id, content).

    Files with a wrong header give no rows; mask_header() tells which they are.
    """
    kind = np.dtype([("class", "u1"), ("confidence", "u1"), ("evidence", "<u2"), ("instance", "<u4")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, width in zip(batch.column("file_id").to_pylist(), batch.column("content"), batch.column("width").to_pylist(), strict=True):
                records = np.frombuffer(content.as_buffer(), kind, offset=HEADER)
                at = np.arange(len(records))
                yield pa.RecordBatch.from_pydict({"file_id": np.full(len(records), file, np.int64), "y": at // width, "x": at % width} | {c: records[c].astype(np.int64) for c in kind.names})

    good = files.withColumn("_h", mask_header(F.col("content"))).where("_h.valid").select(F.col("file_id").cast("bigint").alias("file_id"), "content", F.col("_h.width").alias("width"))
    return good.mapInArrow(read, "file_id bigint, y bigint, x bigint, class bigint, confidence bigint, evidence bigint, instance bigint")


def mask_files(pixels: DataFrame) -> DataFrame:
    """file_id and content of masks, from mask_pixels(). First lines are put together, then files from their lines."""
    record = F.concat(little_hex(F.col("class"), 1), little_hex(F.col("confidence"), 1), little_hex(F.col("evidence"), 2), little_hex(F.col("instance"), 4))
    line = F.array_sort(F.collect_list(F.struct("x", record.alias("r"))))  # SIDE pixels at most
    lines = pixels.groupBy("file_id", "y").agg(F.array_join(F.transform(line, lambda p: p["r"]), "").alias("line"), F.count("*").alias("width"))
    whole = F.array_sort(F.collect_list(F.struct("y", "line")))  # SIDE lines at most
    files = lines.groupBy("file_id").agg(whole.alias("_l"), F.max("width").alias("_w"))
    header = F.concat(F.lit(MASK.encode().hex()), little_hex(F.col("_w")), little_hex(F.size("_l")), little_hex(F.lit(RECORD), 2), F.lit("0000"))
    return files.select("file_id", F.unhex(F.concat(header, F.array_join(F.transform("_l", lambda r: r["line"]), ""))).alias("content"))
