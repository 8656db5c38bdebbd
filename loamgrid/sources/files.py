"""Folders of binary files: a data source that writes and reads them, and manifests held against what a folder holds.

The data source plans partitions by bytes, reads a header before the payload behind it, and writes in two steps: tasks
stage their files, and only the commit moves them to their places. Whole folders are scanned by Spark's own reader,
which drops files by their length before it opens them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from loamgrid.sources.binary import DEPTH, HEADER, MASK, RECORD, SIDE, TILE

#: Bytes of the files of a partition.
PARTITION = 32 << 20
#: Bytes of a manifest, a descriptor and a tile at most.
CAPS = {"manifest": 8 << 20, "descriptor": 4 << 10, "tile": 4 << 20}
#: By kind: magic, bytes of the header and of a pixel.
KINDS = {"mask": (MASK, HEADER, RECORD), "depth": (DEPTH, 16, 4), "tile": (TILE, 16, 1)}
STAGING = "_staging"
SAFE = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9._-]{0,95}(/[A-Za-z0-9_-][A-Za-z0-9._-]{0,95})*")


def header_problem(head: bytes, size: int, kind: str) -> str | None:
    """What is wrong with a file's first bytes and its size: 'magic', 'record', 'side' or 'length'."""
    magic, header, pixel = KINDS[kind]
    if len(head) < header or head[:8] != magic.encode().ljust(8, b"\0"):
        return "magic"
    if kind == "mask" and head[16:20] != RECORD.to_bytes(2, "little") + b"\0\0":
        return "record"
    width, height = (int.from_bytes(head[a : a + 4], "little") for a in (8, 12))
    if not (1 <= width <= SIDE and 1 <= height <= SIDE):
        return "side"
    return None if size == header + width * height * pixel else "length"


@dataclass
class Files(InputPartition):
    """Paths and sizes of the files of a partition."""

    found: list[tuple[str, int]]


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind")
        self.most, self.colours = int(options.get("most", 2**62)), int(options.get("colours", 256))
        self.partition = int(options.get("partition", PARTITION))

    def partitions(self) -> list[Files]:
        fs, root = arrow_fs.FileSystem.from_uri(self.path)
        found = sorted((f.path[len(root) :].lstrip("/"), f.size) for f in fs.get_file_info(arrow_fs.FileSelector(root, recursive=True)) if f.is_file)
        out, held = [[]], 0
        for path, size in found:
            if path.startswith(f"{STAGING}/"):
                continue
            if out[-1] and held + size > self.partition:
                out.append([])
                held = 0
            out[-1].append((path, size))
            held += size
        return [Files(x) for x in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, root = arrow_fs.FileSystem.from_uri(self.path)
        for path, size in partition.found:
            if size > self.most:
                yield path, size, None, "oversized"
                continue
            with fs.open_input_stream(f"{root}/{path}", compression=None) as f:
                head = f.read(KINDS[self.kind][1]) if self.kind else b""
                if self.kind and (problem := header_problem(head, size, self.kind)):
                    yield path, size, None, problem
                    continue
                content = head + f.read()
            if self.kind == "tile" and np.frombuffer(content, np.uint8, offset=16).max(initial=0) >= self.colours:
                yield path, size, None, "palette"
            else:
                yield path, size, content, None


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Staged:
        fs, root = arrow_fs.FileSystem.from_uri(self.path)
        folder = f"{root}/{STAGING}/{self.run}/{uuid.uuid4().hex}"  # of this attempt
        fs.create_dir(folder, recursive=True)
        for row in rows:
            if not SAFE.fullmatch(row["path"] or ""):
                raise ValueError(f"{row['path']!r} is no safe path")
            at = f"{folder}/{row['path']}"
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(at, compression=None) as f:
                f.write(bytes(row["content"] or b""))
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        """Moves what the tasks have staged, folder by folder, to its place; a file that is there already is refused."""
        fs, root = arrow_fs.FileSystem.from_uri(self.path)
        for message in filter(None, messages):
            for f in fs.get_file_info(arrow_fs.FileSelector(message.folder, recursive=True)):
                to = f"{root}/{f.path[len(message.folder) :].lstrip('/')}"
                if not f.is_file:
                    continue
                if not self.overwrite and fs.get_file_info(to).type != arrow_fs.FileType.NotFound:
                    raise FileExistsError(to)
                fs.create_dir(to.rpartition("/")[0], recursive=True)
                fs.move(f.path, to)
        fs.delete_dir(f"{root}/{STAGING}/{self.run}")

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = arrow_fs.FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{root}/{STAGING}/{self.run}").type != arrow_fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{STAGING}/{self.run}")


class BinaryFiles(DataSource):
    """format('loamgrid_files'): rows path and content are files under a folder.

    Reading gives path, length, content and problem; content is null, and was not read, where there is a problem: 'oversized'
    (option most), a broken header ('magic', 'record', 'side', 'length'; option kind: mask, depth or tile) or a colour outside
    the palette ('palette', found in the payload; option colours).
    """

    @classmethod
    def name(cls) -> str:
        return "loamgrid_files"

    def schema(self) -> str:
        return "path string, length bigint, content binary, problem string"

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(dict(self.options), overwrite)


def write_files(files: DataFrame, path: str) -> None:
    """Writes files (path, content) under a folder; none must be there yet."""
    files.sparkSession.dataSource.register(BinaryFiles)
    files.select("path", "content").write.format(BinaryFiles.name()).mode("append").save(path)


def read_files(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(BinaryFiles)
    return spark.read.format(BinaryFiles.name()).options(**options).load(path)


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """path (under the folder), length and content of all files of a folder, by Spark's own reader of binary files.

    That reader passes over empty files; read_files() with most=-1 lists them too, without opening any.
    """
    root = re.sub(r"^[a-z0-9]+:/+", "", path).strip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", f"^[a-z0-9]+:/+{re.escape(root)}/", "").alias("path"), "length", "content")


def held_against(layers: DataFrame, files: DataFrame, cap: Column | int) -> DataFrame:
    """path and problem of what a manifest (path, byte_length, sha256) and a folder (scanned()) do not agree on.

    'missing' files, 'extra' ones, 'oversized' ones (beyond cap, a number or a column of the file's path and length; they
    are never opened), those of another 'length' than stated, and 'altered' ones. Paths stated twice are 'repeated'.
    """
    most = cap if isinstance(cap, Column) else F.lit(cap)
    named = layers.groupBy("path").agg(F.count("*").alias("_n"), F.max("byte_length").alias("byte_length"), F.max("sha256").alias("sha256"))
    lengths = files.select("path", "length", most.alias("_most"))
    digests = files.where(F.col("length") <= most).select("path", F.sha2("content", 256).alias("_digest"))
    both = named.join(lengths, "path", "full_outer").join(digests, "path", "left")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("_n").isNull(), "extra").when(F.col("_n") > 1, "repeated").when(F.col("length") > F.col("_most"), "oversized").when(~F.col("length").eqNullSafe(F.col("byte_length")), "length").when(~F.col("_digest").eqNullSafe(F.col("sha256")), "altered")
    return both.select("path", problem.alias("problem")).where("problem is not null")
