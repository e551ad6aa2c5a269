"""The panel as a named data source: the rows of ``scan_panel``, pushed filters, row groups, streams."""

import os
import random
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from retentia.sources import panel_source
from retentia.sources.panel import scan_panel
from retentia.sources.schemas import PANEL

FILTERS = [
    "sessions_per_week > 3", "sessions_per_week >= 3 AND platform = 'PC'", "platform IN ('PC', 'Mobile', NULL)", "date < timestamp_ntz'2024-01-10 00:00:00'",
    "win_rate IS NULL", "win_rate IS NOT NULL", "win_rate > 0.5", "platform IS NULL", "NOT (platform = 'PC')", "platform <=> NULL", "win_rate = double('NaN')",
    "platform LIKE 'P%'", "player_id = 7 OR sessions_per_week < 2", "monthly_spent <= 1.5 AND win_rate < 0.9", "sessions_per_week + 1 > 4", "player_id IN (1, 2, 3)"]


def data(seed, n):
    rng = random.Random(seed)
    return {"player_id": [rng.randrange(20) for _ in range(n)], "date": [datetime(2024, 1, rng.randrange(1, 29), 3, 4, 5, 678) for _ in range(n)],
            "sessions_per_week": sorted(rng.randrange(8) for _ in range(n)), "platform": [rng.choice(["PC", "Mobile", "Console", None]) for _ in range(n)],
            "win_rate": [rng.choice([None, float("nan"), rng.random()]) for _ in range(n)], "monthly_spent": [rng.random() * 3 for _ in range(n)], "not_declared": ["x"] * n}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("panel")
    for k in range(3):
        pq.write_table(pa.table(data(k, 60)), path / f"part-{k}.parquet", row_group_size=10)
    (path / "_hidden.parquet").write_text("no panel")
    return str(path)


@pytest.fixture
def source(spark):
    panel_source.register(spark)
    return lambda path, **o: spark.read.format("retentia_panel").options(**o).load(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("condition", ["true", *FILTERS])
def test_equal_to_scan_panel(spark, source, folder, condition):
    cols = ["player_id", "date", "sessions_per_week", "platform", "win_rate", "monthly_spent"]
    got = source(folder).filter(condition)
    assert got.columns == PANEL.fieldNames()
    assert rows_of(got.select(*cols)) == rows_of(scan_panel(spark, folder).select(*cols).filter(condition))
    assert got.filter("kd_ratio IS NOT NULL OR churned IS NOT NULL").count() == 0  # absent in the files


def test_pushed_filters_leave_no_filter_in_the_plan(source, folder):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan(source(folder).filter("sessions_per_week > 3 AND platform = 'PC'")).replace("RuntimeFilters", "")
    assert "Filter" in plan(source(folder).filter("sessions_per_week + 1 > 3")).replace("RuntimeFilters", "")


def test_row_groups_are_ruled_out_and_columns_left_alone(spark, source, folder):
    assert source(folder, rows=10).rdd.getNumPartitions() == 18
    assert source(folder, rows=10).filter("sessions_per_week >= 7").rdd.getNumPartitions() < 9
    assert source(folder).filter("sessions_per_week > 100").count() == 0
    few = spark.read.format("retentia_panel").schema("sessions_per_week long, player_id string").load(folder)
    assert few.columns == ["sessions_per_week", "player_id"] and few.count() == 180
    assert {r.player_id for r in few.collect()} <= {str(k) for k in range(20)}


def write_csv(path, rows, header="date,player_id,sessions_per_week,platform,win_rate,extra"):
    tmp = f"{path}.tmp"
    with open(tmp, "w") as f:
        f.write("\n".join([header, *rows]) + "\n")
    os.rename(tmp, path)


def test_csv_by_header_with_missing_words(spark, source, tmp_path):
    folder = str(tmp_path)
    write_csv(f"{folder}/a.csv", ["2024-01-05T00:00:00.000250,P1,3.0, PC ,NaN,z", "2024-01-06 00:00:00,P2,,N/A,0.25,z", '2024-01-07,P3,null,"a, b",none,z'])
    cols = ["player_id", "date", "sessions_per_week", "platform", "win_rate", "churned"]
    got = rows_of(source(folder).select(*cols))
    assert got == rows_of(scan_panel(spark, folder, "csv").select(*cols))
    assert got[0] == ("P1", datetime(2024, 1, 5, 0, 0, 0, 250), 3, "PC", None, None)
    assert rows_of(source(folder).filter("sessions_per_week = 3").select("player_id")) == [("P1",)]
    write_csv(f"{folder}/b.csv", ["2024-01-05,P9,2.5,PC,1,z"])
    with pytest.raises(Exception, match="not a whole number in column sessions_per_week"):
        source(folder).collect()


def test_bad_options(source, tmp_path):
    for bad in ({"files": "orc"}, {"path": ""}):
        with pytest.raises(Exception):
            source(str(tmp_path) if "path" not in bad else None, **bad).collect()
    with pytest.raises(Exception):
        source(str(tmp_path / "nowhere")).collect()


def test_an_empty_folder_and_sql(spark, source, folder, tmp_path):
    assert source(str(tmp_path)).collect() == []
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW by_name USING retentia_panel OPTIONS (path '{folder}')")
    assert spark.sql("SELECT count(*) FROM by_name WHERE platform = 'PC'").first()[0] == source(folder).filter("platform = 'PC'").count()


def test_a_stream_takes_each_file_once(spark, source, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(folder)

    def run():
        stream = spark.readStream.format("retentia_panel").option("path", folder).schema("player_id string, sessions_per_week long").load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        q.awaitTermination()
        return rows_of(spark.read.schema("player_id string, sessions_per_week long").parquet(out))

    write_csv(f"{folder}/b.csv", ["2024-01-05,P1,1,PC,1,z", "2024-01-05,P2,2,PC,1,z"])
    assert run() == [("P1", 1), ("P2", 2)]
    write_csv(f"{folder}/a.csv", ["2024-01-05,P3,,PC,1,z"])
    assert run() == [("P1", 1), ("P2", 2), ("P3", None)]
    assert run() == [("P1", 1), ("P2", 2), ("P3", None)]
