"""Queries over event streams: batch twins of streaming operators, and the streams themselves."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from ..streaming import folds, progress, timers
from .registry import LOG, SQL, log, query, table

RACE = LOG + """, race AS (SELECT id AS race, 'L' || (k % 4) AS lane, event_id AS seq, value AS t, k,
  CASE WHEN k % 10 = 0 THEN 'restart' WHEN lane = 'click' THEN 'reasoning' WHEN lane = 'error' THEN 'error' WHEN lane = 'purchase' THEN 'graded' ELSE 'content' END AS type,
  repeat('x', k) AS text FROM log)"""


def race(events):
    """Race events from the events table, for batches and streams."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(k % 10 == 0, "restart").when(F.col("event_type") == "click", "reasoning").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "graded").otherwise("content")
    return events.select(F.col("user_id").cast("string").alias("race"), F.concat(F.lit("L"), k % 4).alias("lane"), F.col("event_id").alias("seq"), F.col("value").alias("t"), kind.alias("type"), F.repeat(F.lit("x"), k).alias("text"))


def stream(spark, d):
    """The events table as a stream of files."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event[s].parquet")


@query(f"""WITH {RACE} SELECT CAST(race AS VARCHAR) AS race, lane, min(t) FILTER (WHERE type IN ('reasoning', 'content')) AS ttft, count(*) FILTER (WHERE type IN ('reasoning', 'content')) AS n_deltas, max(t) AS t_end FROM race GROUP BY ALL""")
def ttft_fold(spark, d):
    return folds.first_delta(race(table(spark, d, "events")), ["race", "lane"])


@query(f"""WITH {RACE}, last AS (SELECT race, lane, max(seq) AS l FROM race WHERE type = 'restart' GROUP BY ALL)
SELECT CAST(race AS VARCHAR) AS race, lane, count(*) AS n, sum(length(text))::BIGINT AS chars FROM race LEFT JOIN last USING (race, lane) WHERE l IS NULL OR seq > l GROUP BY ALL""")
def restart_fold(spark, d):
    live = folds.after_last_restart(race(table(spark, d, "events")), ["race", "lane"])
    return live.groupBy("race", "lane").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {RACE}, first AS (SELECT race, min(seq) AS f FROM race WHERE type = 'error' AND k > 50 GROUP BY race)
SELECT CAST(race AS VARCHAR) AS race, count(*) AS n, max(seq) AS last FROM race LEFT JOIN first USING (race) WHERE f IS NULL OR seq <= f GROUP BY race""")
def abort_after_fatal(spark, d):
    events = race(table(spark, d, "events"))
    return folds.until_fatal(events, ["race"], (F.col("type") == "error") & (F.length("text") > 50)).groupBy("race").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


LANE_STATE = f"""WITH {RACE}, f AS (SELECT *, max(seq) FILTER (WHERE type = 'restart') OVER (PARTITION BY race, lane) AS l FROM race), live AS (SELECT *, l IS NULL OR seq > l AS live, type IN ('reasoning', 'content') AS delta FROM f)
SELECT CAST(race AS VARCHAR) AS race, lane, coalesce(max_by(CASE WHEN delta THEN 'writing' ELSE type END, seq) FILTER (WHERE live AND type <> 'restart'), 'waiting') AS status,
  coalesce(sum(length(text)) FILTER (WHERE live AND delta), 0)::BIGINT AS chars, count(*) AS n_events, min_by(t, seq) FILTER (WHERE live AND delta) AS ttft, count(*) FILTER (WHERE type = 'restart')::INT AS restarts FROM live GROUP BY ALL"""


@query(LANE_STATE)
def lane_state_fold(spark, d):
    return folds.fold_batch(race(table(spark, d, "events")))


@query(f"WITH {RACE} SELECT CAST(race AS VARCHAR) AS race, row_number() OVER (PARTITION BY race ORDER BY t, seq) AS at, seq, lane, type FROM race")
def race_event_order(spark, d):
    from pyspark.sql import Window

    events = race(table(spark, d, "events"))
    return events.select("race", F.row_number().over(Window.partitionBy("race").orderBy("t", "seq")).cast("long").alias("at"), "seq", "lane", "type")


@query(f"""WITH {LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY value, event_id) - 1 AS i FROM log)
SELECT event_id, lane, round(max(value - i * 0.05) OVER (PARTITION BY lane ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + i * 0.05, 6) AS start FROM n""")
def rate_limiter(spark, d):
    return folds.paced(log(spark, d), ["lane"], "value", ["value", "event_id"], 0.05).select("event_id", "lane", F.round("start", 6).alias("start"))


@query("""SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling(spark, d):
    events = folds.with_time(table(spark, d, "events"))
    return folds.tumbling(events, "6 hours", ["event_type"], "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 3 HOURS, ts), time_bucket(INTERVAL 3 HOURS, ts) - INTERVAL 3 HOURS]) AS start FROM events) GROUP BY ALL""")
def sliding(spark, d):
    events = folds.with_time(table(spark, d, "events"))
    return folds.tumbling(events, "6 hours", ["event_type"], "value", slide="3 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 4 HOURS, true) AS fresh FROM events), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, sid""")
def session(spark, d):
    events = folds.with_time(table(spark, d, "events"))
    found = folds.sessions(events, "4 hours", ["user_id"])
    return found.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("SELECT CAST(race AS VARCHAR) AS race, count(*) AS n, max(last) AS t_end FROM (SELECT user_id AS race, event_type, max(value) AS last FROM events GROUP BY ALL) GROUP BY race")
def terminal_event(spark, d):
    """One closing row for each race: how many producers ended, and when the last did."""
    ends = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("race"), "event_type").agg(F.max("value").alias("last"))
    return ends.groupBy("race").agg(F.count("*").alias("n"), F.max("last").alias("t_end"))


def place_for(spark, name: str) -> str:
    """A folder of its own beside the others in the shared folder; where none is set, only a local session gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="assaykit-stream-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("""SELECT * FROM (SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
WHERE start + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_tumbling(spark, d):
    """Tumbling windows of the event stream in append mode: windows that the last watermark closes."""
    events = folds.with_time(stream(spark, d)).withWatermark("ts", "1 hour")
    told = folds.run_once(folds.tumbling(events, "6 hours", ["event_type"], "value"), place_for(spark, "tumbling"))
    return told.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def stream_distinct(spark, d):
    """Event ids that the watermark's duplicate filter lets through."""
    events = folds.with_time(stream(spark, d)).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return folds.run_once(events.select("event_id", "user_id", "event_type"), place_for(spark, "distinct"))


@contextmanager
def rocksdb(spark):
    """State in RocksDB, which stateful processors need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query(LANE_STATE)
def stream_fold(spark, d):
    """The lane states of the event stream, by a stateful processor over RocksDB."""
    with rocksdb(spark):
        return folds.run_once(folds.fold_stream(race(stream(spark, d))), place_for(spark, "fold"), ["race", "lane"])


@query(SQL["rate_limiter"])
def stream_pacing(spark, d):
    """Starts that keep the interval, by state and timers; equal to the batch form."""
    requests = stream(spark, d).select("event_id", F.col("event_type").alias("lane"), "value")
    with rocksdb(spark):
        return folds.run_once(timers.paced_stream(requests, "lane", "value", "event_id", 0.05), place_for(spark, "pacing")).select("event_id", "lane", F.round("start", 6).alias("start"))


@query("""WITH p AS (SELECT CAST(user_id AS VARCHAR) AS race, event_type, max(value) AS last FROM events GROUP BY ALL)
SELECT race, count(*) AS n, max(last) AS t_end, CASE WHEN CAST(race AS BIGINT) % 10 = 0 AND bool_or(event_type = 'purchase') THEN 'timeout' ELSE 'ended' END AS how FROM p GROUP BY race""")
def stream_terminal(spark, d):
    """One closing row for each race, told by the end of its last producer, or by a timer where the purchases of a race never end."""
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("race"), F.col("event_type").alias("producer"), F.col("value").alias("t"), "event_id")
    last = events.groupBy("race", "producer").agg(F.max(F.struct("t", "event_id"))["event_id"].alias("last"))
    known = last.groupBy("race").agg(F.count("*").alias("producers"))
    endless = (F.col("race").cast("long") % 10 == 0) & (F.col("producer") == "purchase")
    marked = events.join(last, ["race", "producer"]).join(known, "race").select("race", "producer", "t", ((F.col("event_id") == F.col("last")) & ~endless).alias("ended"), "producers")
    place = place_for(spark, "races")
    marked.write.parquet(place)
    # what comes later moves the watermark on
    marked.agg(F.lit("clock").alias("race"), F.lit("clock").alias("producer"), (F.max("t") + 3600).alias("t"), F.lit(True).alias("ended"), F.lit(1).cast("long").alias("producers")).write.mode("append").parquet(place)
    with rocksdb(spark):
        told = folds.run_once(timers.closing_rows(spark.readStream.schema(marked.schema).parquet(place), patience=30), place_for(spark, "closing"))
    return told.where("race <> 'clock'")


@query("""SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM events UNION ALL SELECT 'counts.errors', count(*) FILTER (WHERE event_type = 'error') FROM events
UNION ALL SELECT 'counts.users', sum(user_id) FROM events UNION ALL SELECT 'batches', 6 FROM events LIMIT 4""")
def stream_progress(spark, d):
    """Rows and observed metrics of all batches of a stream, from the table its listener writes."""
    source, place = place_for(spark, "progress-events"), place_for(spark, "progress")
    table(spark, d, "events").repartition(6).write.parquet(source)
    events = spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(source)
    watched = events.observe("counts", F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("user_id").alias("users"))
    listener = progress.ProgressTable(spark, place)
    spark.streams.addListener(listener)
    try:
        run = watched.writeStream.format("noop").option("checkpointLocation", place_for(spark, "progress-state")).queryName("progress").trigger(availableNow=True).start()
        run.awaitTermination()
        listener.wait(run.runId)
    finally:
        spark.streams.removeListener(listener)
    told = progress.progress(spark, place)
    batches = told.where("metric is null and rows > 0").select(F.inline(F.array(F.struct(F.lit("rows").alias("metric"), F.col("rows").cast("double").alias("value")), F.struct(F.lit("batches").alias("metric"), F.lit(1.0).alias("value")))))
    return batches.unionByName(told.where("metric is not null").select("metric", "value")).groupBy("metric").agg(F.sum("value").alias("value"))


@query("""SELECT event_id, user_id, CAST(ceil(value * 0.5 * 1000 / 250) AS BIGINT) * 250 AS out_ms FROM events""")
def stream_replay(spark, d):
    """Events replayed at half their recorded times, against a clock that hands out 40 ticks of 250 ms in each batch."""
    every, per_batch = 250, 40
    recorded = table(spark, d, "events").select("event_id", "user_id", F.col("value").alias("t"))
    told = timers.replayed(timers.ticks(spark, every, per_batch), recorded, "t", 0.5, every)
    last = math.ceil((recorded.agg(F.max("t")).first()[0] or 0) * 0.5 * 1000 / every)
    return folds.run_until(told, place_for(spark, "replay"), last // per_batch).select("event_id", "user_id", "out_ms")
