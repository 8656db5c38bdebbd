"""What only larger or odder tables show: what goes through the driver, borders that few points hit, ties."""

import contextlib
import io
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamgrid.operators import contracts, kernels, paint
from loamgrid.plans import contract_queries, inputs, kernel_queries, paint_queries
from loamgrid.plans.queries import QUERIES, SQL
from loamgrid.streaming import readiness

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["ge2_winding", "ge3_holes"])
def test_probes_are_made_beside_their_rings_and_sent_nowhere(spark, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, SF))


def both(spark, tmp_path, name, **tables):
    """The rows of a query and of its SQL over tables given as DuckDB SQL, one file each, rows in order."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    return sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns).collect())), sorted(cursor.fetchall())


PARTS = "CAST(r AS BIGINT) AS p_partkey, 'a b' AS p_name, CAST(1 + r % 50 AS INT) AS p_size"


def test_records_of_one_id_come_in_the_order_of_their_bytes(spark, tmp_path):
    # Beyond 999,999 lpad() to six digits cuts keys, so that ten records share an id.
    got, want = both(spark, tmp_path, "ag16_ag24_sync_report", part=f"SELECT {PARTS} FROM range(999980, 1000060) t(r)")
    assert got == want and max(len(set(row[4].split("\n"))) for row in got) == 20


def test_points_on_all_borders_of_the_box(spark, tmp_path):
    # x = 7919 * partkey + 104729 + 1299709 (order 1, line 1) and y = 50021 * partkey + 6151 + 3079 * suppkey, mod 620000.
    at = lambda x, y: ((p := (x - 104729 - 1299709) * pow(7919, -1, 620000) % 620000), (y - 6151 - 50021 * p) * pow(3079, -1, 620000) % 620000)
    spots = [(x, y) for x in (99999, 100000, 100001, 399999, 400000, 400001) for y in (99999, 100000, 100001, 299999, 300000, 300001)]
    lines = " UNION ALL ".join(f"SELECT 1::BIGINT AS l_orderkey, {p}::BIGINT AS l_partkey, {s}::BIGINT AS l_suppkey, 1::INT AS l_linenumber, 5.0::DOUBLE AS l_quantity" for p, s in (at(*spot) for spot in spots))
    got, want = both(spark, tmp_path, "ge3_even_odd", lineitem=lines, part=f"SELECT {PARTS} FROM range(1) t(r)")
    assert got == want and [row[:2] for row in got] == sorted(spots)


def test_of_triangles_with_one_key_and_depth_the_first_is_seen(spark, tmp_path):
    # 5540 has the key of 5539, and both have depth 359 at one pixel.
    got, want = both(spark, tmp_path, "rk17_jn13_raster", part=f"SELECT {PARTS} FROM range(5500, 5550) t(r)")
    assert got == want


def test_documents_are_made_in_all_tasks_however_small_their_table_is(spark):
    made = contract_queries.documents(spark, SF, contract_queries.FIXTURE, contract_queries.MISTAKES)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_no_side_of_a_join_of_components_is_sent_whole(spark):
    labelled = kernels.labelled_runs(inputs.rasters(spark, SF).where("v > 1100").select("raster_id", "y", "x"))
    each = kernels.hysteresis(kernels.gradient(kernel_queries.covered(spark, SF)), kernel_queries.LOW, kernel_queries.HIGH)
    assert not any("Broadcast" in plan(df) for df in (labelled, kernels.labelled_pixels(labelled), each))


@pytest.mark.parametrize("name", ["jn1_sf23_buildings", "hp2_vector_world"])
def test_tags_made_of_few_bytes_are_not_sent_whole(spark, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["vl14_capture_requests", "vl19_hp21_fixtures", "io14_vl9_evidence"])
def test_documents_are_not_judged_before_they_are_dealt_out(spark, name):
    # What stands below the last exchange reads keys and makes no documents.
    assert "parse_json" not in plan(QUERIES[name](spark, SF)).rsplit("Exchange", 1)[1].lower()


class Kept:
    """One value or list of state, in memory."""

    def __init__(self):
        self.value = None

    get = lambda self: self.value
    exists = lambda self: self.value is not None
    update = put = lambda self, value: setattr(self, "value", value)
    appendList = lambda self, more: setattr(self, "value", (self.value or []) + list(more))  # noqa: E731, N815
    clear = lambda self: setattr(self, "value", None)


class Handle:
    def __init__(self):
        self.timers, self.lists = set(), []

    def getValueState(self, *_):  # noqa: N802
        return Kept()

    def getListState(self, *_):  # noqa: N802
        self.lists.append(Kept())
        return self.lists[-1]

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


def test_a_scene_has_one_timer_and_keeps_no_event_beyond_its_deadline():
    # 3,000 events in a month, a hundred of them on the first day, none of which makes the scene ready.
    ats = [i * 864_000_000 for i in range(3000)]
    came = pd.DataFrame({"ts": pd.to_datetime(ats, unit="us"), "at": ats, "event_id": range(3000), "event_type": "click", "value": 0.0})
    handle, outcomes = Handle(), readiness.Outcomes(86_400, 86_400)
    outcomes.init(handle)
    list(outcomes.handleInputRows((1,), iter([came]), None))
    assert len(handle.timers) == 1 and len(handle.lists[0].value) == 101
    watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: ats[-1] // 1000)
    (row,) = outcomes.handleExpiredTimer((1,), watermark, SimpleNamespace(getExpiryTimeInMs=lambda: min(handle.timers)))
    assert row["late"].tolist() == [True] and row["ready_after"].isna().all() and len(handle.timers) == 2  # and one for the mark to go


def test_each_reached_document_is_written_once(spark, monkeypatch):
    rows, was = [], contracts.written
    monkeypatch.setattr(contracts, "written", lambda df, name: (out := was(df, name), rows.append((name, out.count())))[0])
    docs = spark.range(1, 11).selectExpr("7L AS chain", "CAST(id AS string) AS path", "repeat('ab', 32) AS sha256")
    links = spark.range(1, 12).selectExpr("7L AS chain", "CAST(id AS string) AS path", "CAST(id + 1 AS string) AS target", "repeat(IF(id = 3, 'AB', 'ab'), 32) AS sha256").where("path <> '7'")
    links = links.unionByName(spark.sql("SELECT 7L AS chain, '6' AS path, '2' AS target, repeat('ab', 32) AS sha256"))  # back to where it came from
    got = contracts.chains(docs, links, spark.sql("SELECT 7L AS chain, '1' AS path"))
    assert sorted((r.path, r.problem) for r in got.collect()) == [("10", "orphan"), ("11", "missing"), ("12", "missing"), ("4", "altered"), ("8", "orphan"), ("9", "orphan")]
    assert sum(n for name, n in rows if name in ("seen", "reached")) == 7


def test_rows_of_shapes_are_shuffled_and_pixels_are_not(spark, monkeypatch):
    got = QUERIES["rk18_sf30_painted"](spark, SF)
    above, _, below = plan(got).partition("Exchange")
    assert "HashAggregate" in above and "SortAggregate" not in above and "_x" not in below
    monkeypatch.setattr(paint, "ROWS_OF_A_TASK", 50)
    assert QUERIES["rk18_sf30_painted"](spark, SF).rdd.getNumPartitions() > 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ids_of_all_sizes_are_painted_alike(spark):
    some = paint_queries.objects(spark, SF)
    want = sorted(map(tuple, paint.painted(some, 64, 48).collect()))
    far = some.withColumn("id", F.col("id") + F.lit(2**62))
    assert sorted(map(tuple, paint.painted(far, 64, 48).collect())) == want
