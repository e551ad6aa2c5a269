"""Plan-shape checks: shuffles, take-ordered limits, no Python evaluation in any registered query."""

import os

import pytest

import __spark_entry__ as E
from conftest import SMALL
from retentia.operators.features import engineer_all
from retentia.operators.snapshot import latest_snapshot
from retentia.plans import frames
from retentia.plans.catalog import REGISTRY


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_one_exchange_on_player(spark, tmp_path):
    path = str(tmp_path / "panel")
    frames.panel(spark, SMALL).write.parquet(path)
    p = spark.read.parquet(path)
    plan = _plan(latest_snapshot(engineer_all(p)))
    assert plan.count("Exchange hashpartitioning(player_id") == 1
    assert "Exchange" not in plan.replace("Exchange hashpartitioning(player_id", "")


def test_panel_two_shuffles_at_most(spark):
    """events → (player, week) aggregate → per-player windows → snapshot: two shuffles, nation broadcast."""
    frames.release(spark)  # otherwise the cache manager substitutes the persisted snapshot
    plan = _plan(frames.build_latest(spark, SMALL))
    shuffles = plan.count("Exchange") - plan.count("BroadcastExchange")
    assert shuffles == 2
    assert plan.count("Exchange hashpartitioning(player_id") == 2


def test_top_n_is_take_ordered(spark):
    df = E.queries()["priority_queue"](spark, SMALL)
    df.explain()  # plan builds
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", sorted(name for name, e in REGISTRY.items() if e.sql))
def test_no_python_udfs(spark, name):
    plan = REGISTRY[name].build(spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_window_functions_evaluated_once(spark):
    """Every window function of the panel and feature chain appears once, over one sort."""
    import re

    frames.release(spark)  # otherwise the cache manager substitutes the persisted feature table
    plan = _plan(frames.build_features(spark, SMALL))
    assert plan.count("Sort [") == 1
    for m in re.finditer(r"Window \[(.*?)\], \[player_id", plan):
        exprs = re.findall(r"(\w+\([^()]*\)) windowspecdefinition\(([^)]*\)[^)]*)\)", m.group(1))
        assert len(exprs) == len(set(exprs)), exprs


def test_shared_frames_match_fresh_plans(spark):
    """Nothing is persisted unless asked for; if so, the rows are those of plans built from the raw tables."""
    fresh = sorted(map(tuple, frames.build_latest(spark, SMALL).collect()))
    assert frames.latest(spark, SMALL) is not frames.latest(spark, SMALL)
    spark.conf.set("retentia.cache.frames", "true")
    try:
        shared = frames.latest(spark, SMALL)
        assert sorted(map(tuple, shared.collect())) == fresh and frames.latest(spark, SMALL) is shared
    finally:
        spark.conf.set("retentia.cache.frames", "false")
        frames.release(spark)


def test_event_aggregate_is_a_hash_aggregate(spark):
    """The (player, week) aggregate over the event log stays a code-generated hash aggregate."""
    import re

    plan = _plan(frames.panel(spark, SMALL))
    aggs = re.findall(r"(\w*Aggregate)\(keys=\[player_id#\d+L, week#\d+\]", plan)
    assert aggs and set(aggs) == {"HashAggregate"}, aggs


def test_bucketed_feature_table_needs_no_shuffle(spark, tmp_path):
    """A feature table bucketed by player_id and sorted by (player_id, date) is aggregated per player in place."""
    from retentia.operators.snapshot import latest_snapshot
    from retentia.sources.sinks import write_bucketed

    write_bucketed(frames.build_features(spark, SMALL), "pf_bucketed_test", str(tmp_path / "pf"), buckets=4)
    plan = _plan(latest_snapshot(spark.table("pf_bucketed_test")))
    assert "Exchange" not in plan, plan
    assert "Bucketed: true" in plan
    files = [f for f in os.listdir(tmp_path / "pf") if f.endswith(".parquet")]
    assert len(files) <= 4  # one file per bucket


def test_cluster_conf_sizing():
    from retentia.session import cluster_conf
    big = cluster_conf(100 * 1024 ** 4, executors=1000)
    assert int(big["spark.sql.files.maxPartitionBytes"]) == 1024 ** 3
    assert 8000 <= int(big["spark.sql.shuffle.partitions"]) <= 100_000
    small = cluster_conf(1024 ** 3, executors=2)
    assert int(small["spark.sql.shuffle.partitions"]) == 16  # at least twice the cores
    assert int(small["spark.sql.files.maxPartitionBytes"]) == 128 * 1024 ** 2
    assert big["spark.sql.adaptive.enabled"] == "true"
