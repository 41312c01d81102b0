"""Stateful operators over several batches, against plain versions."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from assaykit.plans.streams import rocksdb
from assaykit.streaming import folds, progress, timers


def files(spark, path, batches, schema):
    """A stream that reads each list of rows as a batch of its own."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_paced_over_batches_and_out_of_order(spark, tmp_path):
    pick = random.Random(4)
    rows = sorted((round(pick.uniform(0, 60), 3), k, f"L{pick.randint(0, 2)}") for k in range(300))
    late = sorted(rows, key=lambda r: r[0] + pick.uniform(0, 4))  # up to four seconds out of order
    batches = [[(n, k, lane) for n, k, lane in late[a : a + 60]] for a in range(0, 300, 60)]
    batches.append([(10_000.0, 10_000, "clock")])  # moves the watermark past all others
    stream = files(spark, str(tmp_path / "in"), batches, "now double, id long, lane string")
    with rocksdb(spark):
        told = folds.run_once(timers.paced_stream(stream, "lane", "now", "id", 0.7, late="5 seconds"), f"file://{tmp_path}/out")
    got = {r.id: r.start for r in told.where("lane <> 'clock'").collect()}
    want, free = {}, {}
    for now, k, lane in rows:
        want[k] = max(now, free.get(lane, now))
        free[lane] = want[k] + 0.7
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_closing_rows_are_told_once(spark, tmp_path):
    schema = "race string, producer string, t double, ended boolean, producers long"
    batches = [
        [("a", "x", 1.0, False, 2), ("a", "x", 2.0, True, 2), ("b", "x", 1.0, True, 2), ("c", "x", 1.0, True, 1)],
        [("a", "y", 3.0, True, 2), ("b", "y", 4.0, False, 2), ("c", "x", 5.0, True, 1)],  # c was told already
        [("b", "y", 20.0, False, 2)],  # later than the first timer would have been set for
        [("clock", "x", 500.0, True, 1)],
    ]
    stream = files(spark, str(tmp_path / "in"), batches, schema)
    with rocksdb(spark):
        told = folds.run_once(timers.closing_rows(stream, patience=30), f"file://{tmp_path}/out")
    assert sorted(tuple(r) for r in told.where("race <> 'clock'").collect()) == [("a", 2, 3.0, "ended"), ("b", 2, 20.0, "timeout"), ("c", 1, 1.0, "ended")]


def test_replay_keeps_order_and_times(spark, tmp_path):
    recorded = spark.createDataFrame([(k, k * 0.13) for k in range(40)], "id long, t double")
    told = folds.run_until(timers.replayed(timers.ticks(spark, 100, 10), recorded, "t", 2.0, 100), f"file://{tmp_path}/out", 11)
    got = {r.id: r.out_ms for r in told.collect()}
    assert len(got) == 40 and all(0 <= got[k] - k * 260 < 100 + 1e-6 for k in got) and [got[k] for k in range(40)] == sorted(got.values())


def test_progress_files_are_one_for_each_batch(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), [[(k,)] * (k + 1) for k in range(3)], "v long").observe("seen", F.sum("v").alias("total"))
    listener = progress.ProgressTable(spark, f"file://{tmp_path}/progress")
    spark.streams.addListener(listener)
    try:
        run = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        listener.wait(run.runId)
    finally:
        spark.streams.removeListener(listener)
    told = progress.progress(spark, f"file://{tmp_path}/progress").where("rows > 0")
    assert {(r.batch, r.rows) for r in told.where("metric is null").collect()} == {(0, 1), (1, 2), (2, 3)}
    assert told.where("metric = 'seen.total'").agg(F.sum("value")).first()[0] == 0 + 2 + 6
    with pytest.raises(TimeoutError):
        listener.wait("none", seconds=0.01)


def test_duplicates_within_the_watermark(spark, data):
    """stream_distinct reads its table in one batch, so it is the batch that drops duplicates: one event of each key."""
    from assaykit import plans

    got = plans.QUERIES["stream_distinct"](spark, data).collect()
    events = spark.read.parquet(f"{data}/events.parquet")
    keys = {(r.user_id, r.event_type) for r in events.collect()}
    assert len(got) == len(keys) and {(r.user_id, r.event_type) for r in got} == keys
    assert {(r.event_id, r.user_id, r.event_type) for r in got} <= {(r.event_id, r.user_id, r.event_type) for r in events.collect()}


def test_a_request_at_time_zero_is_paced_without_drift(spark, tmp_path):
    """The first watermark is the epoch; a request there isn't late, and starts are multiples of the interval, not sums of it."""
    rows = [(0.0, k, "a") for k in range(20_000)] + [(-3.0, 20_000, "b"), (50_000.0, 20_001, "b")]
    stream = files(spark, str(tmp_path / "in"), [rows], "now double, id long, lane string")
    with rocksdb(spark):
        told = folds.run_once(timers.paced_stream(stream, "lane", "now", "id", 0.05), f"file://{tmp_path}/out")
    got = {r.id: r.start for r in told.collect()}
    assert len(got) == 20_002 and got[20_000] == -3.0 and all(got[k] == k * 0.05 for k in range(20_000))


def test_replay_leaves_the_recorded_rows_where_they_are(spark, tmp_path):
    """A batch of the clock is broadcast: what is replayed isn't shuffled once for each batch."""
    spark.range(2_000).select("id", (F.col("id") * 0.01).alias("t")).write.parquet(str(tmp_path / "in"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the recorded rows are larger than that
    try:
        told = timers.replayed(timers.ticks(spark, 100, 10), spark.read.parquet(str(tmp_path / "in")), "t", 1.0, 100)
        run = told.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).start()
        while not ((last := run.lastProgress) and last["batchId"] >= 1):
            assert run.isActive
        plan = run._jsq.explainInternal(False)
        run.stop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


class Calls:
    """A handle of a stateful processor with one value of state; it counts the calls."""

    def __init__(self):
        self.n, self.value = 0, None

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        raise AssertionError("each look into a map is a call")

    def _called(self, *args):
        self.n += 1
        if args:
            self.value = args[0]
        return self.value

    exists = get = _called

    def update(self, value):
        self._called(value)

    def registerTimer(self, ms):
        self.n += 1

    deleteTimer = registerTimer


def test_a_lane_costs_two_calls_of_state_for_each_batch():
    fold, calls = folds.LaneFold(), Calls()
    fold.init(calls)
    said = [Row(seq=k, type=t, t=float(k), size=5) for k, t in ((3, "content"), (1, "content"), (2, "restart"), (4, "error"))]
    assert [tuple(r) for r in fold.handleInputRows(("r", "l"), iter(said), None)] == [("r", "l", "error", 5, 4, 3.0, 1)] and calls.n == 2


def test_a_race_costs_few_calls_of_state_for_any_number_of_producers():
    closing, calls = timers.Closing(30), Calls()
    closing.init(calls)
    said = [Row(producer=f"p{k}", t=float(k), ended=k > 0, producers=50) for k in range(50)]
    assert not list(closing.handleInputRows(("r",), iter(said), None)) and calls.n <= 3
    assert [tuple(r) for r in closing.handleInputRows(("r",), iter([Row(producer="p0", t=99.0, ended=True, producers=50)]), None)] == [("r", 50, 99.0, "ended")]
    assert calls.n <= 6 and not list(closing.handleExpiredTimer(("r",), None, None))
