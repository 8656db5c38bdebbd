"""Folders of files, manifests against them, openings of walls and digest chains on small fixtures."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loamgrid.operators import contracts, facades
from loamgrid.sources import files


def header(magic, width, height, tail=b""):
    return magic.ljust(8, b"\0") + width.to_bytes(4, "little") + height.to_bytes(4, "little") + tail


GOOD = header(b"ISIDX1", 3, 2) + bytes([0, 1, 2, 3, 4, 5])
CONTENT = {
    "a/good.idx": GOOD, "a/palette.idx": header(b"ISIDX1", 1, 1) + b"\x09", "b/magic.idx": b"X" + GOOD[1:], "b/short.idx": GOOD[:-1], "b/long.idx": GOOD + b"\0", "b/side.idx": header(b"ISIDX1", 0, 2), "empty.idx": b"", "big.idx": header(b"ISIDX1", 100, 100) + bytes(10_000),
}


def frame(spark, content):
    return spark.createDataFrame([(p, c) for p, c in content.items()], "path string, content binary")


def test_files_go_and_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/folder"
    files.write_files(frame(spark, CONTENT).repartition(3), path)
    assert sorted(str(p.relative_to(tmp_path / "folder")) for p in (tmp_path / "folder").rglob("*") if p.is_file()) == sorted(CONTENT)
    got = {r["path"]: r for r in files.read_files(spark, path, kind="tile", colours=6, most=5000, partition=30).collect()}
    assert {p: r["problem"] for p, r in got.items()} == {"a/good.idx": None, "a/palette.idx": "palette", "b/magic.idx": "magic", "b/short.idx": "length", "b/long.idx": "length", "b/side.idx": "side", "empty.idx": "magic", "big.idx": "oversized"}
    assert bytes(got["a/good.idx"]["content"]) == GOOD and all(r["length"] == len(CONTENT[p]) for p, r in got.items())
    assert files.read_files(spark, path).where("problem is null").count() == len(CONTENT)
    with pytest.raises(Exception, match="a/good.idx"):  # what is there already is refused, and nothing is left behind
        files.write_files(frame(spark, {"a/good.idx": b"new"}), path)
    assert (tmp_path / "folder" / "a" / "good.idx").read_bytes() == GOOD
    with pytest.raises(Exception, match="no safe path"):
        files.write_files(frame(spark, {"../evil": b"x"}), path)
    assert not (tmp_path / "evil").exists()


def test_manifest_against_folder(spark, tmp_path):
    path = f"file://{tmp_path}/held"
    files.write_files(frame(spark, CONTENT), path)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    stated = [(p, len(c), sha(c)) for p, c in CONTENT.items() if p != "empty.idx"] + [("lost", 1, sha(b""))]
    stated = [(p, n + (p == "b/long.idx"), sha(b"other") if p == "b/short.idx" else h) for p, n, h in stated] + [stated[0]]
    got = files.held_against(spark.createDataFrame(stated, "path string, byte_length bigint, sha256 string"), files.scanned(spark, path), 5000)
    assert {tuple(r) for r in got.collect()} == {("lost", "missing"), ("big.idx", "oversized"), ("b/long.idx", "length"), ("b/short.idx", "altered"), (stated[0][0], "repeated")}
    assert {tuple(r) for r in files.read_files(spark, path, most=-1).select("path", "length", "content").collect()} == {(p, len(c), None) for p, c in CONTENT.items()}
    plan = files.scanned(spark, path).where("length <= 5000").select(F.sha2("content", 256))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), LessThanOr" in plan  # the listing drops files before they are opened


def test_openings_end_at_their_cap(spark):
    side = 60_000
    ring = [(0, 0, 0), (side, 0, 0), (side, side, 0), (0, side, 0), (0, 0, 0)]
    rings = [[{"x": x, "y": y, "z": z} for x, y, z in ring]]
    rows = [(1, 40_000, [*rings, *rings, *rings]), (2, 4_000, rings), (3, 9_000, []), (4, None, rings), (5, 30_000, None)]
    got = facades.facades(spark.createDataFrame(rows, "id bigint, height bigint, rings array<array<struct<x:bigint,y:bigint,z:bigint>>>"), facades.Facade(), ("id",)).collect()
    assert {r["id"] for r in got} == {1}
    assert [r["n"] for r in got if r["kind"] != "door"] == list(range(facades.QUADS)) and [r["n"] for r in got if r["kind"] == "door"] == [facades.QUADS]
    assert max(r["floor"] for r in got) == facades.FLOORS - 1 and max(r["bay"] for r in got) == facades.BAYS - 1


def test_chains(spark):
    docs = [("c", "root", "1"), ("c", "x", "2"), ("c", "y", "3"), ("c", "z", "4"), ("c", "island", "5"), ("d", "root", "1")]
    links = [("c", "root", "x", "2"), ("c", "x", "y", "wrong"), ("c", "y", "x", "2"), ("c", "y", "gone", "9"), ("c", "island", "z", "4")]
    shape = "chain string, path string, "
    got = contracts.chains(spark.createDataFrame(docs, shape + "sha256 string"), spark.createDataFrame(links, shape + "target string, sha256 string"), spark.createDataFrame([("c", "root"), ("d", "root"), ("e", "root")], "chain string, path string"))
    assert sorted(tuple(r) for r in got.collect()) == [("c", "gone", "missing"), ("c", "island", "orphan"), ("c", "y", "altered"), ("c", "z", "orphan"), ("e", "root", "missing")]


def test_documents_that_are_none(spark):
    rows = [(1, None), (2, ""), (3, "[]"), (4, "{"), (5, "7"), (6, '{"license":"CC-BY-4.0"}')]
    got = {r["id"]: r["code"] for r in contracts.fixtures(spark.createDataFrame(rows, "id bigint, json string")).collect()}
    assert got == {1: "invalid_root", 2: "invalid_root", 3: "invalid_root", 4: "invalid_root", 5: "invalid_root", 6: "source_pixels"}
    assert {r["code"] for r in contracts.captures(spark.createDataFrame(rows[:5], "id bigint, json string")).collect()} == {"object"}
    assert [r["valid"] for r in contracts.releases(spark.createDataFrame(rows, "id bigint, json string")).collect()] == [False] * 6
