"""Registered queries: loads, upserts, key-value snapshots, batch jobs and streams (S2-S12, M5, M6, ST1, ST2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.operators import model as ml
from retentia.operators.features import serve_features
from retentia.operators.snapshot import latest_snapshot, prepare_model_data
from retentia.plans import frames, jobs
from retentia.plans import oracle as O
from retentia.plans.catalog_features import served_rows_sql
from retentia.plans.catalog_model import CARD, card_model, card_scores, with_factor_count
from retentia.plans.registry import query
from retentia.sources import panel_source, sinks
from retentia.sources.buckets import BucketedTable
from retentia.sources.panel import ingest
from retentia.sources.schemas import PANEL, PLAYER_FEATURES
from retentia.streaming import streams

NOW = "2024-02-01 00:00:00"
SPLIT_OLD, SPLIT_NEW = "2024-01-22", "2024-01-15"


@query("upsert_panel", "S5", O.with_panel(f"""
, tgt AS (SELECT *, 'base' AS source FROM panel WHERE date < TIMESTAMP '{SPLIT_OLD}'),
upd AS (SELECT *, 'update' AS source FROM panel WHERE date >= TIMESTAMP '{SPLIT_NEW}')
SELECT player_id, date, sessions_per_week, {O.r6('monthly_spent')} AS monthly_spent, source FROM upd
UNION ALL
SELECT t.player_id, t.date, t.sessions_per_week, {O.r6('t.monthly_spent')}, t.source FROM tgt t
WHERE NOT EXISTS (SELECT 1 FROM upd u WHERE u.player_id = t.player_id AND u.date = t.date)"""))
def q_upsert(spark, sf):
    """Earlier weeks upserted with a later extract that overlaps one week: overlapping keys take the update."""
    p = frames.features(spark, sf).select("player_id", "date", "sessions_per_week", "monthly_spent")
    target = p.filter(F.col("date") < F.lit(SPLIT_OLD).cast("timestamp_ntz")).withColumn("source", F.lit("base"))
    updates = p.filter(F.col("date") >= F.lit(SPLIT_NEW).cast("timestamp_ntz")).withColumn("source", F.lit("update"))
    return sinks.upsert(target, updates, ["player_id", "date"])


@query("upsert_buckets", "S5 M5", O.with_features(f"""
, tgt AS (SELECT * FROM feat WHERE date < TIMESTAMP '{SPLIT_OLD}'), upd AS (SELECT * FROM feat WHERE date >= TIMESTAMP '{SPLIT_NEW}')
SELECT {O.select_rounded(O.ALL_FEATURE_TABLE)}, 'update' AS source FROM upd
UNION ALL
SELECT {O.select_rounded(O.ALL_FEATURE_TABLE)}, 'base' FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM upd u WHERE u.player_id = t.player_id AND u.date = t.date)"""))
def q_upsert_buckets(spark, sf):
    """The feature table loaded in two runs into one bucketed table: earlier weeks, then a later extract that overlaps one week."""
    feats = frames.features(spark, sf)
    path = sinks.stage_path(spark, "features-by-bucket")
    base = feats.filter(F.col("date") < F.lit(SPLIT_OLD).cast("timestamp_ntz")).withColumn("source", F.lit("base"))
    later = feats.filter(F.col("date") >= F.lit(SPLIT_NEW).cast("timestamp_ntz")).withColumn("source", F.lit("update"))
    jobs.etl_load(spark, base, path, "base", buckets=16)
    jobs.etl_load(spark, later, path, "later")
    return BucketedTable.open(spark, path).rows().select(*O.ALL_FEATURE_TABLE, "source")


@query("risk_summary_refresh", "A1", O.with_features(f"""
SELECT player_id, max(date) AS last_update, {O.r6('max(overall_risk_score)')} AS risk_score,
  {O.r6('avg(sessions_per_week)')} AS avg_sessions, {O.r6('avg(monthly_spent)')} AS avg_spent,
  {O.r6('max(total_spent)')} AS total_spent, max(friends_online) AS friends_count, max(platform) AS platform,
  max(archetype) AS archetype, {O.band(O.score9('max(overall_risk_score)'))} AS risk_category
FROM feat GROUP BY player_id"""))
def q_risk_summary_refresh(spark, sf):
    """The risk summary kept up in three batches, the middle weeks last, from stored states of each player."""
    feats = sinks.materialize(frames.features(spark, sf))
    path = sinks.stage_path(spark, "summary-states")
    first, last = (F.lit(d).cast("timestamp_ntz") for d in (SPLIT_NEW, SPLIT_OLD))
    early, late = F.col("date") < first, F.col("date") >= last
    jobs.refresh_summary(spark, path, feats.filter(early), "early", buckets=16)
    jobs.refresh_summary(spark, path, feats.filter(late), "late")
    return jobs.refresh_summary(spark, path, feats.filter(~early & ~late), "between")


_SQL_TYPES = {"StringType()": "VARCHAR", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
              "TimestampNTZType()": "TIMESTAMP", "LongType()": "BIGINT", "BooleanType()": "BOOLEAN"}


def _conform_sql() -> str:
    items = []
    for f in PLAYER_FEATURES.fields:
        t = _SQL_TYPES[repr(f.dataType)]
        e = f"TRY_CAST({f.name} AS {t})" if f.name in O.ALL_FEATURE_TABLE else f"CAST(NULL AS {t})"
        items.append((O.r6(e) if t == "DOUBLE" else e) + f" AS {f.name}")
    return O.with_features(f"SELECT {', '.join(items)} FROM feat")


@query("conform_features", "S6 S13", _conform_sql())
def q_conform(spark, sf):
    """The engineered panel cast to the declared player_features table (absent columns typed null)."""
    out = sinks.conform(frames.features(spark, sf), PLAYER_FEATURES)
    return out.select(*PLAYER_FEATURES.fieldNames())


_KV_FIELDS = [(c, t) for c, t in O.ALL_FEATURE_TABLE.items()]
_SPARK_TYPES = {O.DOUBLE: "double", O.BIGINT: "bigint", O.INT: "int", O.TEXT: "string", O.TS: "timestamp_ntz"}


@query("feature_kv_snapshot", "S7", O.with_latest(
    "SELECT 'player:' || CAST(player_id AS VARCHAR) AS key, " + O.select_rounded({c: t for c, t in _KV_FIELDS})
    + f", TIMESTAMP '{NOW}' + INTERVAL 7 DAY AS expires_at FROM latest"))
def q_kv(spark, sf):
    """Latest features per player as cache entries (JSON, nulls kept, 7-day expiry), read back from their JSON."""
    kv = sinks.feature_kv_snapshot(frames.latest(spark, sf), now=NOW)
    schema = ", ".join(f"{c} {_SPARK_TYPES[t]}" for c, t in _KV_FIELDS)
    back = kv.select("key", F.from_json("value", schema, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}).alias("v"), "expires_at")
    return back.select("key", "v.*", "expires_at")


@query("prediction_kv_lookup", "S8", O.with_scored(f"""
SELECT 'player:' || CAST(player_id AS VARCHAR) || ':prediction' AS key, {O.r6('churn_risk_score')} AS churn_probability,
  risk_category, '2024-02-01T00:00:00' AS timestamp, TIMESTAMP '{NOW}' + INTERVAL 1 HOUR AS expires_at
FROM scored WHERE risk_category = 'High'"""))
def q_pred_kv(spark, sf):
    """Prediction cache entries (1-hour expiry) of the High band, found while unexpired and read back from their JSON."""
    pred = frames.scored(spark, sf).select("player_id", F.col("churn_risk_score").alias("churn_probability"),
                                           "risk_category")
    kv = sinks.prediction_kv(pred, now=NOW)
    wanted = pred.filter(F.col("risk_category") == "High").select(
        F.concat(F.lit("player:"), F.col("player_id").cast("string"), F.lit(":prediction")).alias("key"))
    found = sinks.lookup(kv, wanted, now="2024-02-01 00:30:00")
    record = F.from_json("value", "churn_probability double, risk_category string, timestamp string")
    return found.select("key", record.alias("v"), "expires_at").select("key", "v.*", "expires_at")


@query("etl_run", "M5 S2 S4 S7 K0d", O.with_features(f"SELECT {O.select_rounded(O.ALL_FEATURE_TABLE)} FROM feat"))
def q_etl(spark, sf):
    """Extract → transform → load into a table bucketed by player; returns the written table read back."""
    import hashlib
    name = "player_features_" + hashlib.md5(sf.encode()).hexdigest()[:8]  # one table a source, replaced by each run
    out = jobs.etl_run(spark, sf, now=NOW, bucketed=True, table_name=name)
    return spark.table(out["features_table"]).select(*O.ALL_FEATURE_TABLE)


@query("daily_run_rules", "M6 S9 S10 M1 K1b", O.with_scored(f"""
, b AS (SELECT churn_risk_score, {O.band_cut('churn_risk_score')} AS band FROM scored)
SELECT count(*) AS total_predictions, count(*) FILTER (WHERE band = 'High') AS high_risk,
  count(*) FILTER (WHERE band = 'Medium') AS medium_risk, count(*) FILTER (WHERE band = 'Low') AS low_risk,
  {O.r6('avg(churn_risk_score)')} AS avg_churn_probability,
  {O.r6("CAST(count(*) FILTER (WHERE band = 'High') AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0) * 100.0")} AS high_risk_pct,
  '2024-02-01' AS run_date FROM b"""))
def q_daily_rules(spark, sf):
    """The staged daily job without a model: the rule-based risk score in right-closed bands; its metrics log."""
    return jobs.daily_run(spark, sf, run_date="2024-02-01")


def _train_rf(spark, sf):
    data, cols = prepare_model_data(frames.features(spark, sf))
    return ml.fit(data, cols, ml.random_forest()), cols


@query("daily_run", "M6 S9 S10 M1 K1b")
def q_daily(spark, sf):
    """The staged daily job (ingest, features, load, score with the forest, monitor); returns the metrics log."""
    model, cols = _train_rf(spark, sf)
    return jobs.daily_run(spark, sf, model, cols, run_date="2024-02-01")


@query("batch_score_file", "S12 S1 S11 L11")
def q_batch_score(spark, sf):
    """A stored panel file scored end to end; the model goes through save / load first."""
    model, cols = _train_rf(spark, sf)
    mpath = sinks.stage_path(spark, "model")
    ml.save_model(model, mpath)
    ppath = sinks.write_table(frames.panel(spark, sf), sinks.stage_path(spark, "panel-file"))
    return jobs.batch_score_file(spark, ppath, ml.load_model(mpath), cols)


@query("batch_score_card", "S12 S1 S9 S11 L11", O.with_latest(card_scores("player_id", "latest")))
def q_batch_card(spark, sf):
    """A stored panel file scored end to end by the scorecard, which goes through save / load first."""
    mpath = sinks.stage_path(spark, "card")
    ml.save_model(card_model(), mpath, features=list(CARD))
    ppath = sinks.write_table(frames.panel(spark, sf), sinks.stage_path(spark, "panel-file"))
    return with_factor_count(jobs.batch_score_file(spark, ppath, ml.load_model(mpath), ml.load_features(mpath)))


# ---------------------------------------------------------------- streams
def _weekly_files(spark, sf, src: str) -> None:
    """Write the panel into ``src`` as files that each mix a few weeks and players.

    Hash-partitioning on (week, player) over a parallelism-sized number of
    tasks spreads the write (no task holds a whole week) and leaves each
    player's weeks scattered over files, so the file stream's micro-batches see
    them out of order (late data).  An explicit count keeps adaptive execution
    from merging the files into one.
    """
    p = frames.features(spark, sf).select(*PANEL.fieldNames())
    n = max(8, 2 * spark.sparkContext.defaultParallelism)
    p.repartition(n, F.date_trunc("week", "date"), F.col("player_id")).write.mode("append").parquet(src)


TTL_DAYS = 14


@query("stream_latest", "ST2", O.with_panel(f"""
, newest AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY date DESC) = 1)
SELECT {O.select_rounded(O.PANEL_COLUMNS)} FROM newest
WHERE date + INTERVAL {TTL_DAYS} DAY > TIMESTAMP '{NOW}'"""))
def q_stream_latest(spark, sf):
    """Newest record per player from a file stream whose weeks arrive out of order; expired (14 days) dropped."""
    base = sinks.stage_path(spark, "stream-latest")
    _weekly_files(spark, sf, f"{base}/source")
    return streams.run_latest_stream(spark, f"{base}/source", PANEL, f"{base}/state", f"{base}/checkpoint",
                                     ttl_days=TTL_DAYS, now=NOW, max_files_per_trigger=4, compact_every=2)


@query("stream_state", "ST2", O.with_panel(f"""
, newest AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY date DESC) = 1)
SELECT {O.select_rounded(O.PANEL_COLUMNS)} FROM newest
WHERE date + INTERVAL {TTL_DAYS} DAY > TIMESTAMP '{NOW}'"""))
def q_stream_state(spark, sf):
    """Newest record per player kept in the state store (one value state, timers), read back from the state."""
    base = sinks.stage_path(spark, "stream-state")
    _weekly_files(spark, sf, f"{base}/source")
    return streams.run_newest_stream(spark, f"{base}/source", PANEL, f"{base}/checkpoint", ttl_days=TTL_DAYS, now=NOW,
                                     max_files_per_trigger=8)


@query("stream_score", "ST1 F31")
def q_stream_score(spark, sf):
    """Arriving rows scored without history by a forest trained on the request-time feature set."""
    lat = serve_features(latest_snapshot(frames.panel(spark, sf)))
    names = [c for c in lat.columns if c not in ("player_id", "date", "registration_date", "archetype", "platform",
                                                 "country", "churned")]
    model = ml.fit(ml.stratified_split(lat, features=names).filter(F.col("split") == "train"), names,
                   ml.random_forest())
    base = sinks.stage_path(spark, "stream-score")
    _weekly_files(spark, sf, f"{base}/source")
    streams.run_score_stream(spark, f"{base}/source", PANEL, model, names, f"{base}/sink", f"{base}/checkpoint",
                             max_files_per_trigger=4)
    return spark.read.parquet(f"{base}/sink")


@query("stream_score_card", "ST1 F31 S11", O.with_panel(f"""
, {served_rows_sql("panel", "srv")}
{card_scores("player_id, date", "(SELECT *, NULL AS win_rate_std FROM srv)")}"""))
def q_stream_card(spark, sf):
    """Arriving rows scored without history by a loaded pipeline of request-time features and the scorecard."""
    base = sinks.stage_path(spark, "stream-card")
    _weekly_files(spark, sf, f"{base}/source")
    streams.run_score_stream(spark, f"{base}/source", PANEL, card_model(), list(CARD), f"{base}/sink", f"{base}/checkpoint",
                             max_files_per_trigger=8)
    return with_factor_count(spark.read.parquet(f"{base}/sink"))


@query("ingest_sources", "S2 S1", O.with_panel(
    f"SELECT CAST(player_id AS VARCHAR) AS player_id, {O.select_rounded({c: t for c, t in O.PANEL_COLUMNS.items() if c != 'player_id'})} FROM panel"))
def q_ingest(spark, sf):
    """Reader chosen by source name: the panel from events, written as CSV with its columns turned round, read back by name."""
    panel = ingest(spark, "events", sf_dir=sf)
    path = sinks.write_table(panel.select(*reversed(panel.columns)), sinks.stage_path(spark, "panel-csv"), fmt="csv")
    return ingest(spark, "csv", path=path)


@query("panel_source", "S2 S1", O.with_panel(f"SELECT {O.select_rounded(O.PANEL_COLUMNS)} FROM panel WHERE sessions_per_week >= 2 AND archetype IN ('casual', 'whale')"))
def q_panel_source(spark, sf):
    """The stored panel read by the name of its data source, with a comparison and a list pushed into the reader."""
    panel_source.register(spark)
    path = sinks.write_table(frames.panel(spark, sf), sinks.stage_path(spark, "panel-files"))
    panel = spark.read.format(panel_source.NAME).load(path)
    return panel.filter((F.col("sessions_per_week") >= 2) & F.col("archetype").isin("casual", "whale"))


@query("panel_source_stream", "S2 S1", O.with_panel(
    f"SELECT CAST(player_id AS VARCHAR) AS player_id, {O.select_rounded({c: t for c, t in O.PANEL_COLUMNS.items() if c != 'player_id'})} FROM panel"))
def q_panel_source_stream(spark, sf):
    """CSV files of the panel, their columns turned round, read by header as a stream of the named data source."""
    panel_source.register(spark)
    base = sinks.stage_path(spark, "panel-stream")
    panel = frames.panel(spark, sf)
    sinks.write_table(panel.select(*reversed(panel.columns)), f"{base}/source", fmt="csv")
    stream = spark.readStream.format(panel_source.NAME).option("path", f"{base}/source").load()
    done = stream.writeStream.format("parquet").option("path", f"{base}/sink").option("checkpointLocation", f"{base}/checkpoint").trigger(once=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{base}/sink")


def _intervention_log_sql() -> str:
    from retentia.operators.risk import INTERVENTIONS as CAMPAIGNS
    conds = ["sessions_per_week < 2", "friends_online < 2", "monthly_spent = 0", "content_completion_pct > 0.8"]
    parts = " UNION ALL ".join(
        f"SELECT player_id, '{n}' AS intervention, '{i}' AS expected_impact FROM scored "
        f"WHERE risk_category = 'High' AND {c}" for (n, i, _), c in zip(CAMPAIGNS, conds))
    ident = "CAST(player_id AS VARCHAR) || ':' || intervention || ':' || '2024-02-01'"
    return O.with_scored(f""", tg AS ({parts})
SELECT md5({ident}) AS intervention_id, CAST(player_id AS VARCHAR) AS player_id,
  TIMESTAMP '2024-02-01' AS intervention_date, intervention AS intervention_type, CAST(5.0 AS DOUBLE) AS intervention_cost,
  'planned' AS status, CAST(NULL AS VARCHAR) AS result, expected_impact AS notes FROM tg""")


@query("intervention_log", "K5 S13", _intervention_log_sql())
def q_intervention_log(spark, sf):
    """Planned campaign rows in the interventions table shape (cost 5 per player)."""
    from retentia.operators.risk import intervention_targets
    return sinks.to_intervention_log(intervention_targets(frames.scored(spark, sf)), "2024-02-01", 5.0)


def _ab_record_sql() -> str:
    from retentia.plans.catalog_experiment import ab_sql
    r = O.r6
    return ab_sql(f"""
SELECT md5('retention_test:2024-01-01') AS test_id, 'retention_test' AS test_name, TIMESTAMP '2024-01-01' AS start_date,
  TIMESTAMP '2024-01-31' AS end_date, 'discount_offer' AS intervention_type, CAST(control_n AS DOUBLE) AS control_size,
  CAST(treatment_n AS DOUBLE) AS treatment_size, {r('control_churn_rate')} AS control_churn_rate,
  {r('treatment_churn_rate')} AS treatment_churn_rate, {r('relative_lift * 100.0')} AS lift_percentage,
  {r('z_p_value')} AS p_value, significant AS is_significant, 'completed' AS status,
  {r('z_score')} AS results_z_score, {r('chi2_statistic')} AS results_chi2_statistic FROM res""")


@query("ab_test_record", "B8 S13", _ab_record_sql())
def q_ab_record(spark, sf):
    """The experiment result as an ab_tests row; two figures are read back from its JSON of the whole result."""
    from retentia.operators import experiment as ab
    res = ab.run_ab_test(ab.prepare_ab_input(frames.scored(spark, sf)), "retention_test", "discount_offer")
    row = sinks.to_ab_test_record(res, "2024-01-01", "2024-01-31")
    inside = [F.get_json_object("results", f"$.{c}").cast("double").alias(f"results_{c}") for c in ("z_score", "chi2_statistic")]
    return row.select(*[c for c in row.columns if c != "results"], *inside)


@query("model_monitoring", "S13 M2", O.with_scored(f"""
, w AS (SELECT CAST(count(*) FILTER (WHERE risk_category = 'High') AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0) * 100.0
          AS high_pct, avg(CAST(churned AS DOUBLE)) AS actual, avg(churn_risk_score) AS predicted FROM scored),
m AS (SELECT 'high_risk_pct' AS metric_name, high_pct AS v, CAST(40.0 AS DOUBLE) AS t, coalesce(high_pct > 40.0, false) AS a FROM w
      UNION ALL SELECT 'actual_churn_rate', actual, predicted * 1.5, coalesce(actual > predicted * 1.5, false) FROM w)
SELECT md5('2024-02-01:' || metric_name) AS monitor_id, TIMESTAMP '2024-02-01' AS monitor_date, metric_name,
  {O.r6('v')} AS metric_value, {O.r6('t')} AS threshold_value, a AS alert_triggered, 'daily run' AS notes FROM m"""))
def q_monitoring(spark, sf):
    """The daily alerts as rows of the model_monitoring table."""
    from retentia.operators import monitor
    return sinks.to_model_monitoring(monitor.alerts(frames.scored(spark, sf)), "2024-02-01", "daily run")


@query("flatten_profiles", "S3", """
WITH u AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS bought
           FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS player_id, date_trunc('second', t0) AS account_created,
  CASE WHEN user_id % 3 <> 0 THEN date_trunc('second', t1) END AS last_logoff, 3 AS profile_visibility,
  CAST(CASE WHEN user_id % 4 = 0 THEN 0 ELSE n % 5 END AS INTEGER) AS friend_count,
  CAST(CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS owned_games,
  CASE WHEN user_id % 2 = 0 THEN n * 10 END AS target_playtime_total, CASE WHEN user_id % 2 = 0 THEN n END AS target_playtime_2weeks,
  CAST(bought AS INTEGER) AS achievements, '[{"name":"events","value":' || CAST(n AS VARCHAR) || '.0}]' AS stats,
  TIMESTAMP '2024-02-01' AS extraction_date FROM u""")
def q_flatten(spark, sf):
    """Profile payloads derived from the event log, landed as JSON and flattened for one game (missing parts included)."""
    from retentia.sources.panel import flatten_profiles, table
    from retentia.sources.schemas import PROFILE_PAYLOAD

    e = table(spark, sf, "events").filter("user_id IS NOT NULL AND ts IS NOT NULL").groupBy("user_id").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("n"),
        F.count_if(F.col("event_type") == "purchase").alias("bought"))
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    game = lambda app, total, weeks: F.struct(F.lit(app).alias("appid"), total.alias("playtime_forever"), weeks.alias("playtime_2weeks"))
    other, mine = game(1, F.col("n"), F.lit(None).cast("long")), game(730, F.col("n") * 10, F.col("n"))
    payload = e.select(
        F.col("user_id").cast("string").alias("steamid"),
        F.struct(seconds("t0").alias("timecreated"), F.when(F.col("user_id") % 3 != 0, seconds("t1")).alias("lastlogoff"),
                 F.lit(3).alias("communityvisibilitystate")).alias("summary"),
        F.when(F.col("user_id") % 4 != 0, F.array_repeat(F.struct(F.lit("x").alias("steamid")), (F.col("n") % 5).cast("int"))).alias("friends"),
        F.when(F.col("user_id") % 2 == 0, F.array(other, mine)).otherwise(F.array(other)).alias("games"),
        F.struct(F.array_repeat(F.struct(F.lit("a").alias("apiname"), F.lit(0).alias("achieved")), F.col("bought").cast("int")).alias("achievements"),
                 F.array(F.struct(F.lit("events").alias("name"), F.col("n").cast("double").alias("value"))).alias("stats")).alias("playerstats"))
    path = sinks.write_table(payload, sinks.stage_path(spark, "profiles"), fmt="json")
    return flatten_profiles(spark.read.schema(PROFILE_PAYLOAD).json(path), 730, extracted="2024-02-01 00:00:00")
