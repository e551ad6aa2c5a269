"""A hot player holding half of all events: the plan stays balanced and results stay whole.

The skewed input is derived from the given table: every event is copied once
more with its user replaced by user 0.
"""

from pyspark.sql import functions as F

from conftest import MEDIUM
from retentia.operators.features import engineer_all
from retentia.operators.snapshot import latest_snapshot
from retentia.sources.panel import events_panel, table


def test_hot_player_collapses_before_the_windows(spark):
    ev = table(spark, MEDIUM, "events")
    hot = ev.withColumn("user_id", F.lit(0).cast("long"))
    skewed = ev.unionByName(hot)
    panel = events_panel(skewed, table(spark, MEDIUM, "nation"))
    total_hot = skewed.filter(F.col("user_id") == 0).count()
    assert total_hot > skewed.count() / 2 - 1
    # the hot player reaches the per-player windows as one row per week, not as its events
    rows = panel.filter(F.col("player_id") == 0).collect()
    weeks = ev.select(F.date_sub(F.to_date("ts"), F.weekday("ts"))).distinct().count()
    assert len(rows) == weeks
    assert sum(r.sessions_per_week for r in rows) == total_hot
    # the snapshot keeps every player, the hot one included
    lat = latest_snapshot(engineer_all(panel))
    assert lat.count() == ev.select("user_id").distinct().count()
    # the aggregate is partial before the shuffle (map-side combine of the hot key)
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan or "partial_max" in plan
