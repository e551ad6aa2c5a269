"""Player-period panel: readers (S1, S2) and the panel built from ``events``.

The panel is one row per ``(player_id, date)``.  Built from the event log it
takes one partial/final hash aggregate on ``(user_id, week)`` and one
exchange on ``player_id`` for the per-player sequence columns; the country
lookup joins the nation dimension, which the planner broadcasts only under its
size threshold.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions.columns import nan_to_null, safe_div
from retentia.operators.joins import lookup_join
from retentia.sources.schemas import PANEL, PROFILE_PAYLOAD

# Archetype and platform names of the player profile.
ARCHETYPES = ("hardcore", "casual", "whale", "social", "at_risk")
PLATFORMS = ("PC", "Console", "Mobile")

EVENT_TYPES = ("view", "click", "purchase", "signup", "error")
NO_PURCHASE_DAYS = 180


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- S1 / S2
_MISSING_TEXT = ("", "nan", "null", "none", "na", "n/a", "<na>")


def _from_text(name: str, kind: T.DataType) -> Column:
    """A CSV field as its declared type: the usual words for "missing" are null, anything else must be readable.

    Whole numbers may be written with a fraction of zero (``3.0``), as tools do for columns that have gaps.
    """
    c = F.col(f"`{name}`")
    c = F.when(~F.lower(F.trim(c)).isin(*_MISSING_TEXT), F.trim(c))
    if isinstance(kind, (T.LongType, T.IntegerType)):
        whole = c.cast("decimal(38,6)")
        c = F.when(whole == F.floor(whole), whole).otherwise(F.when(whole.isNotNull(), F.raise_error(
            F.concat(F.lit(f"not a whole number in column {name}: "), c)).cast("decimal(38,6)")))
    return c.cast(kind).alias(name)


def scan_panel(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read a stored panel with its declared types (no inference pass).

    CSV columns are found by their names in the header, in any order; a declared column that is absent is a typed
    null, an undeclared one stays as text, and so do player ids.  NaN in a Parquet panel becomes null, so that
    comparisons with it are false as they are with a missing value.
    """
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
        declared = [f for f in PANEL.fields if f.name != "player_id"]
        if "player_id" not in raw.columns:
            raise ValueError(f"no player_id column in the header of {path}")
        cols = [_from_text(f.name, f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in declared]
        others = [F.col(f"`{c}`") for c in raw.columns if c not in PANEL.fieldNames()]
        return raw.select(F.col("player_id"), *cols, *others)
    df = spark.read.format(fmt).load(path)
    floats = {f.name: nan_to_null(f.name) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    dates = {c: F.col(c).cast("timestamp_ntz") for c in ("date", "registration_date") if c in df.columns}
    return df.withColumns(floats | dates) if floats or dates else df


def ingest(spark: SparkSession, source: str, **kw) -> DataFrame:
    """Pick a reader by source name; unknown names and missing arguments raise."""
    if source in ("csv", "parquet", "json", "orc"):
        if "path" not in kw:
            raise ValueError(f"source {source!r} needs path=")
        if source in ("csv", "parquet"):
            return scan_panel(spark, kw["path"], source)
        # Declared schema rather than inference (a full extra pass over the input).
        return spark.read.schema(kw.get("schema", PANEL)).format(source).load(kw["path"])
    if source == "events":
        if "sf_dir" not in kw:
            raise ValueError("source 'events' needs sf_dir=")
        return events_panel(table(spark, kw["sf_dir"], "events"), table(spark, kw["sf_dir"], "nation"))
    if source == "profiles_json":
        if "path" not in kw or "app_id" not in kw:
            raise ValueError("source 'profiles_json' needs path= and app_id=")
        return flatten_profiles(spark.read.schema(PROFILE_PAYLOAD).json(kw["path"]), kw["app_id"])
    raise ValueError(f"unknown source {source!r}")


# ---------------------------------------------------------------- panel from events
def _pick(values: tuple[str, ...], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


# ``{"k": <int>`` as the first top-level key: a match means the JSON path $.k has that value.
_K_FIRST_KEY = r'^\{\s*"k"\s*:\s*(-?[0-9]{1,9})\s*[,}]'


def props_k() -> Column:
    """``$.k`` of the ``props`` JSON as an int.

    JSON parsing dominates the event scan (about 2x the cost of reading the
    columns).  An anchored pattern reads the common layout, ``k`` as the first
    top-level key, without parsing; every other layout (nested objects, other
    key order) falls back to ``get_json_object``; a value that is no integer, or
    too large for one, is null and fails nothing.
    """
    fast = F.regexp_extract("props", _K_FIRST_KEY, 1)
    return F.when(fast != "", fast.cast("int")).otherwise(F.get_json_object("props", "$.k").try_cast("int"))


def player_week_measures(events: DataFrame) -> DataFrame:
    """Per ``(player_id, week)`` aggregates of the event log (one partial/final hash aggregate)."""
    k = props_k()
    # Events without a user or a time cannot be placed in the panel (the filter reaches the scan).
    # The last event of a week is that of the largest (ts, event_id); its k may be null.  Both as one decimal number:
    # a struct would make the aggregate sort all events.
    last = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(17,0)")
    if "event_id" in events.columns:
        last = last * F.lit(Decimal(10) ** 19) + F.col("event_id").cast("decimal(19,0)")
    ev = events.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select(
        F.col("user_id").alias("player_id"), "ts", "event_type", "value", k.alias("k"), last.alias("_last"),
        F.date_sub(F.to_date("ts"), F.weekday("ts")).alias("week"),
    )
    et = F.col("event_type")
    counts = [F.count_if(et == t).alias(f"n_{t}") for t in EVENT_TYPES]
    return ev.groupBy("player_id", "week").agg(
        F.to_date(F.max("ts")).cast("timestamp_ntz").alias("date"),
        F.min("ts").alias("first_ts"),
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("avg_value"),
        F.max_by("k", "_last").alias("last_k"),
        F.sum("k").alias("sum_k"),
        F.max("k").alias("max_k"),
        F.count_if(F.col("k") >= 95).alias("n_k95"),
        F.sum(F.when(et == "purchase", F.col("value"))).alias("purchase_value"),
        F.min(F.when(et == "purchase", F.col("k"))).alias("min_purchase_k"),
        *counts,
    ).withColumn(
        # Distinct types among the known five, from the per-type counts: keeps the aggregate a plain
        # hash aggregate (collect_set would make it an object aggregate that falls back to sorting
        # once a task holds more than a handful of keys).
        "n_types", sum((F.col(f"n_{t}") > 0).cast("int") for t in EVENT_TYPES),
    )


def events_panel(events: DataFrame, nation: DataFrame) -> DataFrame:
    """The player panel derived from the event log (mapping documented in FIXTURES.md §6).

    Plan: partial/final aggregate on (player, week) → broadcast nation lookup
    (25 rows, under the planner's size threshold) → one Window/Sort pass on
    ``player_id`` for every sequence column.
    """
    g = player_week_measures(events).withColumn("_nationkey", F.col("player_id") % 25)
    countries = nation.select(F.col("n_nationkey").cast("long").alias("_nationkey"), F.col("n_name").alias("country"))
    g = lookup_join(g, countries, "_nationkey")
    w = Window.partitionBy("player_id").orderBy("date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank_mod = F.col("sum_k") % 100
    # Window values once (each occurrence of a window expression is evaluated separately) ...
    g = g.select(
        "*", F.min("first_ts").over(whole).alias("_first"), F.lag("n").over(w).alias("_prev_n"),
        F.lag(rank_mod).over(w).alias("_prev_rank"), F.sum("n").over(running).alias("_running_n"),
        F.last("n").over(whole).alias("_last_n"),
    )
    # ... then every panel column in one typed projection.
    n, prev_n = F.col("n"), F.col("_prev_n")
    cols = {
        "player_id": F.col("player_id"),
        "date": F.col("date"),
        "registration_date": F.col("_first"),
        "archetype": _pick(ARCHETYPES, F.col("player_id") % 5),
        "platform": _pick(PLATFORMS, F.col("player_id") % 3),
        "country": F.col("country"),
        "sessions_per_week": n,
        "avg_session_length_mins": F.col("avg_value"),
        "days_since_last_login": F.col("last_k") % 31,
        "session_decay_rate": F.coalesce(safe_div(prev_n - n, F.greatest(prev_n, F.lit(1))), F.lit(0.0)),
        "win_rate": safe_div("n_click", F.col("n_click") + F.col("n_error")),
        "kd_ratio": safe_div("n_view", F.greatest(F.col("n_error"), F.lit(1))),
        "current_rank": rank_mod + 1,
        "rank_change": F.coalesce(rank_mod - F.col("_prev_rank"), F.lit(0)),
        "friends_online": F.col("n_signup"),
        "party_play_percentage": safe_div("n_view", n),
        "toxicity_reports_received": F.col("n_k95"),
        "monthly_spent": F.coalesce("purchase_value", F.lit(0.0)),
        "days_since_last_purchase": F.coalesce(F.col("min_purchase_k").cast("long") * 2,
                                               F.lit(NO_PURCHASE_DAYS).cast("long")),
        "purchase_frequency": F.col("n_purchase"),
        "achievements_unlocked": F.col("_running_n"),
        "content_completion_pct": F.col("max_k") / F.lit(99.0),
        "feature_adoption_pct": F.col("n_types") / F.lit(5.0),
        "churned": F.col("_last_n") <= 3,
    }
    return g.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in PANEL.fields])


def profiles_from_events(events: DataFrame, nation: DataFrame) -> DataFrame:
    """Profile dimension straight from the event log: one partial/final aggregate on the user id."""
    first = events.filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull()) \
        .groupBy(F.col("user_id").alias("player_id")).agg(F.min("ts").alias("registration_date"))
    prof = first.select(
        "player_id", "registration_date",
        _pick(ARCHETYPES, F.col("player_id") % 5).alias("archetype"),
        _pick(PLATFORMS, F.col("player_id") % 3).alias("platform"),
        (F.col("player_id") % 25).alias("_nationkey"),
    )
    countries = nation.select(F.col("n_nationkey").cast("long").alias("_nationkey"), F.col("n_name").alias("country"))
    return lookup_join(prof, countries, "_nationkey").drop("_nationkey")


# ---------------------------------------------------------------- S3
def flatten_profiles(payloads: DataFrame, app_id: int, extracted: str | None = None) -> DataFrame:
    """Landed store-API payloads → one row per player (no network I/O here).

    Expects ``PROFILE_PAYLOAD``: summary, friends, games and player statistics.  An absent list counts 0; play times
    are null where the target game is absent; every listed achievement counts, achieved or not; ``stats`` is the
    statistics as JSON.  ``extracted`` is the extraction time (now, if none is given).
    """
    target = F.get(F.filter("games", lambda g: g["appid"] == F.lit(app_id)), 0)
    count = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c))
    seconds = lambda c: F.timestamp_seconds(F.col(c)).cast("timestamp_ntz")
    return payloads.select(
        F.col("steamid").alias("player_id"),
        seconds("summary.timecreated").alias("account_created"),
        seconds("summary.lastlogoff").alias("last_logoff"),
        F.col("summary.communityvisibilitystate").cast("int").alias("profile_visibility"),
        count("friends").alias("friend_count"),
        count("games").alias("owned_games"),
        target["playtime_forever"].alias("target_playtime_total"),
        target["playtime_2weeks"].alias("target_playtime_2weeks"),
        count("playerstats.achievements").alias("achievements"),
        F.to_json("playerstats.stats").alias("stats"),
        (F.lit(extracted).cast("timestamp_ntz") if extracted else F.localtimestamp()).alias("extraction_date"),
    )
