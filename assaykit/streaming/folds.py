"""Race events: batch folds, and their Structured Streaming forms.

Events have race, lane, seq (a total order within a race), t (seconds), type and text.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.stats import in_ranges, settled

DELTAS = ["reasoning", "content"]


def after_last_restart(events: DataFrame, keys: list[str], seq: str = "seq", kind: str = "type") -> DataFrame:
    """The events that a restart of their key doesn't clear."""
    last = events.where(F.col(kind) == "restart").groupBy(*keys).agg(F.max(seq).alias("_last"))
    return events.join(last, keys, "left").where(F.col("_last").isNull() | (F.col(seq) > F.col("_last"))).drop("_last")


def first_delta(events: DataFrame, keys: list[str], t: str = "t", kind: str = "type", deltas: list[str] = DELTAS) -> DataFrame:
    """keys, ttft (time of the first delta, null without one), n_deltas and the end time."""
    is_delta = F.col(kind).isin(deltas)
    return events.groupBy(*keys).agg(F.min(F.when(is_delta, F.col(t))).alias("ttft"), F.count_if(is_delta).alias("n_deltas"), F.max(t).alias("t_end"))


def until_fatal(events: DataFrame, keys: list[str], fatal: Column, seq: str = "seq") -> DataFrame:
    """The events up to and with the first fatal one of their key."""
    first = events.where(fatal).groupBy(*keys).agg(F.min(seq).alias("_first"))
    return events.join(first, keys, "left").where(F.col("_first").isNull() | (F.col(seq) <= F.col("_first"))).drop("_first")


def paced(requests: DataFrame, keys: list[str], now: str, order: list[str], interval: float) -> DataFrame:
    """requests with start: the time from now on that keeps the interval to the start before.

    start_i = max over j <= i of (now_j - j*interval) + i*interval, a running maximum. order begins
    with now; a key's requests are spread over ranges of it, with the counts and maxima of the ranges before.
    """
    ranged = in_ranges(settled(requests), now)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_i", F.row_number().over(inside) - 1).withColumn("_x", F.col(now) - F.col("_i") * interval)
    local = local.withColumn("_x", F.max("_x").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = local.groupBy(*keys, "_range").agg(F.count("*").alias("_c"), F.max("_x").alias("_m"))
    counted = sizes.withColumn("_off", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    held = counted.withColumn("_top", F.max(F.col("_m") - F.col("_off") * interval).over(earlier)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_at"), "_off", "_top")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_range") == F.col("_at"))
    best = F.greatest(F.col("_x") - F.col("_off") * interval, "_top")  # greatest passes over nulls
    return local.join(held, same).select(*requests.columns, (best + (F.col("_i") + F.col("_off")) * interval).alias("start"))


def with_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a timestamp with a zone, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, width: str, keys: list[str], value: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """keys, start, n and total for each window; sliding windows if slide is given. For batches and streams."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(*keys, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """keys, start, end of the last event plus the gap, and n for each session."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class LaneFold(StatefulProcessor):
    """The state of a lane over its events: deltas gathered, first-delta time, restarts, outcome.

    State is one row for each (race, lane). A restart clears the text; the first time of a delta
    stays if keep_first is set, as a viewer shows it, and is taken anew otherwise.
    """

    SCHEMA = "race string, lane string, status string, chars long, n_events long, ttft double, restarts int"

    def __init__(self, keep_first: bool = False):
        self.keep_first = keep_first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lane", "status string, chars long, n_events long, ttft double, restarts int")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        status, chars, n, ttft, restarts = self.state.get() or ("waiting", 0, 0, None, 0)
        for _, kind, t, size in sorted(((r.seq, r.type, r.t, r.size) for r in rows), key=itemgetter(0)):
            n += 1
            if kind in DELTAS:
                status, chars = "writing", chars + size
                ttft = t if ttft is None else ttft
            elif kind == "restart":
                status, chars, restarts = "waiting", 0, restarts + 1
                ttft = ttft if self.keep_first else None
            elif kind in ("generated", "graded", "error"):
                status = kind
        self.state.update((status, chars, n, ttft, restarts))
        yield Row(race=key[0], lane=key[1], status=status, chars=chars, n_events=n, ttft=ttft, restarts=restarts)

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, keep_first: bool = False) -> DataFrame:
    """A stream of lane states, one row for each key in each batch that touches it."""
    sized = events.select("race", "lane", "seq", "type", "t", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return sized.groupBy("race", "lane").transformWithState(LaneFold(keep_first), LaneFold.SCHEMA, "Update", "None")


def fold_batch(events: DataFrame, keep_first: bool = False) -> DataFrame:
    """The same states from a finished log, with built-in aggregates."""
    keys = ["race", "lane"]
    last = events.where("type = 'restart'").groupBy(*keys).agg(F.max("seq").alias("_last"), F.count("*").cast("int").alias("restarts"))
    joined = events.join(last, keys, "left")
    live = F.col("_last").isNull() | (F.col("seq") > F.col("_last"))
    delta = F.col("type").isin(DELTAS)
    told = live & F.col("type").isin(*DELTAS, "generated", "graded", "error")
    status = F.max_by(F.when(delta, "writing").otherwise(F.col("type")), F.when(told, F.col("seq")))
    return joined.groupBy(*keys).agg(
        F.coalesce(status, F.lit("waiting")).alias("status"),
        F.coalesce(F.sum(F.when(live & delta, F.length(F.coalesce("text", F.lit(""))))), F.lit(0)).cast("long").alias("chars"),
        F.count("*").alias("n_events"),
        F.min_by("t", F.when(delta & (F.lit(keep_first) | live), F.col("seq"))).alias("ttft"),
        F.coalesce(F.max("restarts"), F.lit(0)).alias("restarts"),
    )


def merged(*streams: DataFrame) -> DataFrame:
    """Several producers' events as one."""
    first, *rest = streams
    for x in rest:
        first = first.unionByName(x, allowMissingColumns=True)
    return first


def run_once(stream: DataFrame, place: str, keys: list[str] | None = None) -> DataFrame:
    """All that is there now, through Parquet files in a shared folder; nothing passes the driver.

    With keys the stream tells updates, and the last row of each key counts; else it appends.
    """
    spark, out = stream.sparkSession, f"{place}/rows"
    writer = stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if not keys:
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")  # written again as a whole if a batch is taken up again

    writer.foreachBatch(keep).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    told = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(out)
    return told.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*").select(*stream.columns)


def run_until(stream: DataFrame, place: str, batch: int, seconds: float = 600) -> DataFrame:
    """What a stream without an end gives up to and with a batch, through Parquet files in a shared folder."""
    out = f"{place}/rows"
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{place}/state").outputMode("append").start()
    end = time.time() + seconds
    try:
        while not ((last := running.lastProgress) and last["batchId"] >= batch):
            if not running.isActive or time.time() > end:
                raise running.exception() or TimeoutError(f"batch {batch} didn't end in {seconds} s")
            time.sleep(0.2)
    finally:
        running.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """A replayable event log: Parquet files with the offsets t."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
