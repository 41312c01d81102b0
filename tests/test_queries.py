"""Every registered query against its SQL; those without SQL must give rows."""

import pytest
from pyspark.sql import functions as F

from assaykit import plans

from .compare import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, data, name):
    assert rows_of(plans.QUERIES[name](spark, data)) == rows_of_sql(plans.SQL[name], data)


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.SQL.keys()))
def test_query_without_sql_gives_rows(spark, data, name):
    assert plans.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_greedy_dedup_is_the_sequential_scan(spark, data):
    rows = [(r.p_partkey, f"{r.p_brand}/{r.p_size}", f"{r.p_type}/{int(r.p_retailprice)}") for r in spark.read.parquet(f"{data}/part.parquet").collect()]
    a, b, kept = set(), set(), set()
    for key, x, y in sorted(rows):
        if x not in a and y not in b:
            a.add(x), b.add(y), kept.add(key)
    assert {r.p_partkey for r in plans.QUERIES["greedy_two_key_dedup"](spark, data).collect()} == kept


def test_exact_bootstrap_brackets_the_mean(spark, data):
    summary = {r.lane: r for r in plans.QUERIES["bootstrap_ci_exact"](spark, data).collect()}
    closed = {r.lane: r for r in plans.QUERIES["bootstrap_ci_binomial"](spark, data).collect()}
    assert all(r.lo <= r.hi for r in summary.values()) and all(r.lo <= r.k / r.n <= r.hi for r in closed.values())


def test_stream_fold_equals_batch_fold(spark, data):
    stream = plans.QUERIES["stream_fold"](spark, data)
    batch = plans.QUERIES["lane_state_fold"](spark, data)
    assert rows_of(stream.select(*batch.columns)) == rows_of(batch)


def test_stream_windows_are_batch_windows(spark, data):
    stream = {(r.event_type, r.start): (r.n, r.total) for r in plans.QUERIES["stream_tumbling"](spark, data).collect()}
    batch = {(r.event_type, r.start): (r.n, r.total) for r in plans.QUERIES["tumbling"](spark, data).collect()}
    assert stream and all(batch[(k, s.replace(tzinfo=None))] == v for (k, s), v in stream.items())


def test_contains_at_any_edge(spark, tmp_path):
    items = ["To be or not to be that is", "five words are just here", "two words", "one", "tab\tand\nlines of some more words", "a  b   c  d e f"]
    texts = ['He said "To be or not to be that is", twice', "xfive words are just here.", "(two words)", "someone", "a tab\tand\nlines of some more wordsy", "a  b   c  d e f", "To be or not", "", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: n for k, t in enumerate(texts) if (n := sum(i in (t or "") for i in items))}
    assert {r.doc_id: r.n_items for r in plans.QUERIES["contamination_contains"](spark, str(tmp_path)).collect()} == want


def test_split_bootstrap_is_the_exact_one_but_for_chance(spark, data):
    import pandas as pd

    from assaykit.functions import stats
    from assaykit.plans.registry import log

    rows = log(spark, data)
    moments = {r[0]: (r[1], r[2], r[3]) for r in rows.groupBy("lane").agg(F.avg("value"), F.stddev_samp("value"), F.count("*")).collect()}
    exact = {r.lane: r for r in stats.bootstrap(rows, ["lane"], "value", "event_id").collect()}
    split = {r.lane: r for r in plans.QUERIES["bootstrap_ci_split"](spark, data).collect()}
    whole = {r.lane: r for r in stats.split_bootstrap(rows, ["lane"], "value", most=10**6).collect()}
    assert exact.keys() == split.keys()
    for lane, (mean, spread, n) in moments.items():
        error = spread / n**0.5
        for got in (split[lane], whole[lane]):  # over many blocks, and in one
            assert got.n == n and abs(got.lo - exact[lane].lo) < 0.35 * error and abs(got.hi - exact[lane].hi) < 0.35 * error and got.lo < mean < got.hi
    # blocks agree on how many rows they take: with equal values each resample's mean is that value
    same = stats.split_bootstrap(spark.createDataFrame(pd.DataFrame({"k": ["a"] * 90, "v": [2.0] * 90})), ["k"], "v", most=1).first()
    assert (same.n, same.lo, same.hi) == (90, 2.0, 2.0)
    counted = stats.split_bootstrap(spark.range(4000).selectExpr("'a' as k", "double(id) as v"), ["k"], "v", iters=200, most=50).first()
    assert abs(counted.lo - (1999.5 - 1.96 * 1154.7 / 4000**0.5)) < 12 and counted.n == 4000


def test_binomial_interval_is_as_wide_as_the_exact_one(spark, data):
    from assaykit.functions import stats
    from assaykit.plans.registry import log

    rows = log(spark, data).withColumn("ok", (F.col("value") >= 20).cast("double"))
    exact = {r.lane: r for r in stats.bootstrap(rows, ["lane"], "ok", "event_id").collect()}
    for r in plans.QUERIES["bootstrap_ci_binomial"](spark, data).collect():
        error = (r.k / r.n * (1 - r.k / r.n) / r.n) ** 0.5
        assert abs(r.lo - exact[r.lane].lo) < 0.35 * error + 1 / r.n and abs(r.hi - exact[r.lane].hi) < 0.35 * error + 1 / r.n


def exchanges(df):
    """The keys of each shuffle of a plan, and its broadcasts."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [x.split("hashpartitioning(")[1].split("#")[0] for x in lines if " Exchange hashpartitioning(" in x], sum(" BroadcastExchange " in x for x in lines)


def test_whole_rows_shuffle_calls_and_parts_once_and_no_rows_by_lane(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for large tables
    try:
        shuffles, broadcasts = exchanges(plans.QUERIES["whole_result_rows"](spark, data))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(shuffles) == ["id", "l_orderkey"] and broadcasts == 2  # orders and line items; the lanes


def test_lane_summary_of_calls_makes_its_rows_once(spark, data):
    plan = plans.QUERIES["lane_summary_of_calls"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
