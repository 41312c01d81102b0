"""Queries over the results log: summaries, percentiles, boards, costs, lanes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import curate, results
from ..sources import writers
from .registry import LOG, log, query, table

NEWEST = LOG + """, newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lane, id ORDER BY created DESC, event_id DESC) AS rn
                 FROM log WHERE lane <> 'error') WHERE rn = 1)"""
TIERS = "(VALUES ('all', 0, 1000000), ('simple', 0, 6), ('medium', 7, 12), ('complex', 13, 1000000)) AS t(tier, lo, hi)"


def newest(spark, d):
    return results.newest_wins(log(spark, d).where("lane <> 'error'"), ["lane", "id"], ["created", "event_id"])


@query(f"""WITH {NEWEST}, tiered AS (
  SELECT lane, tier, value FROM newest JOIN part ON id = p_partkey JOIN {TIERS} ON p_size BETWEEN lo AND hi)
SELECT lane, tier, count(*) AS n, round(avg(CASE WHEN value >= 20 THEN 1.0 ELSE 0.0 END), 6) AS success,
  list_sort(list(value))[CAST(least(count(*) - 1, floor(0.5 * count(*))) AS BIGINT) + 1] AS latency_p50,
  list_sort(list(value))[CAST(least(count(*) - 1, floor(0.95 * count(*))) AS BIGINT) + 1] AS latency_p95
FROM tiered GROUP BY ALL""")
def lane_summary_tiered(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    rows = newest(spark, d).join(parts, "id").select("lane", "value", F.explode(results.tiers(F.col("p_size"))).alias("tier"))
    rates = rows.groupBy("lane", "tier").agg(F.count("*").alias("n"), F.round(stats.share(F.col("value") >= 20), 6).alias("success"))
    return rates.join(stats.index_percentile(rows, ["lane", "tier"], "value", {"latency_p50": 0.5, "latency_p95": 0.95}), ["lane", "tier"]).orderBy(F.desc("success"), "lane", "tier")


ANSWERS = LOG + """, answers AS (
  SELECT 'L' || (k % 4) AS lane, CASE WHEN lane = 'error' THEN 'api: 500' END AS error, CASE WHEN lane = 'error' THEN 0 ELSE k + 1 END AS output_tokens,
    value > 2 AS runs, CASE WHEN k % 10 <> 0 THEN least(value / 50, 1.0) END AS iou, value / 1000 AS chamfer,
    CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS n_parts, value AS e2e_s, value / 10 AS ttft_s, 1 + k % 2 AS attempts,
    CASE WHEN k % 7 <> 0 THEN value / 10000 END AS cost_usd
  FROM log), live AS (SELECT *, runs AND coalesce(iou, 0) >= 0.9 AS success FROM answers WHERE error IS NULL)"""


def answers(spark, d):
    k, v = F.col("k"), F.col("value")
    failed = F.col("lane") == "error"
    made = log(spark, d).select(
        F.concat(F.lit("L"), k % 4).alias("lane"), F.when(failed, "api: 500").alias("error"), F.when(failed, 0).otherwise(k + 1).alias("output_tokens"),
        (v > 2).alias("runs"), F.when(k % 10 != 0, F.least(v / 50, F.lit(1.0))).alias("iou_aligned"), (v / 1000).alias("chamfer"),
        F.when(F.col("id") % 3 == 0, 2).otherwise(1).alias("n_parts"), v.alias("e2e_s"), (v / 10).alias("ttft_s"), (1 + k % 2).alias("attempts"),
        F.when(k % 7 != 0, v / 10000).alias("cost_usd"),
    )
    return made.withColumn("success", results.succeeded(F.col("runs"), F.col("iou_aligned"))).withColumn("oracle_iou", F.col("iou_aligned"))


@query(f"""WITH {ANSWERS}, failed AS (SELECT lane, count(*) AS n_infra_failed FROM answers WHERE error IS NOT NULL GROUP BY lane)
SELECT lane, count(*) AS n, any_value(n_infra_failed) AS n_infra_failed, round(avg(success::INT), 6) AS success,
  round(avg((runs AND coalesce(iou, 0) >= 0.95)::INT), 6) AS success_iou95, round(avg(runs::INT), 6) AS run_rate,
  round(avg(CASE WHEN runs THEN coalesce(iou, 0) ELSE 0 END), 6) AS mean_iou_aligned, round(median(chamfer) FILTER (WHERE runs), 8) AS median_chamfer,
  count(*) FILTER (WHERE n_parts = 1) AS n_single, round(avg(success::INT) FILTER (WHERE n_parts = 1), 6) AS single_success,
  count(*) FILTER (WHERE n_parts > 1) AS n_multi, round(avg(success::INT) FILTER (WHERE n_parts > 1), 6) AS multi_success,
  round(quantile_cont(e2e_s, 0.5), 6) AS latency_p50, round(quantile_cont(e2e_s, 0.95), 6) AS latency_p95, round(quantile_cont(ttft_s, 0.5), 6) AS ttft_p50,
  round(avg(output_tokens), 6) AS output_tokens_mean, round(avg(attempts), 6) AS attempts_mean, round(avg((coalesce(iou, 0) >= 0.9)::INT), 6) AS oracle_success,
  round(avg(cost_usd) * 1000, 6) AS cost_per_1k_usd
FROM live LEFT JOIN failed USING (lane) GROUP BY lane""")
def lane_summary(spark, d):
    s = results.lane_summary(answers(spark, d), ["lane"])
    r = lambda c, n=6: F.round(c, n).alias(c)
    return s.select(
        "lane", "n", "n_infra_failed", r("success"), r("success_iou95"), r("run_rate"), r("mean_iou_aligned"), r("median_chamfer", 8), F.col("single_part.n").alias("n_single"),
        F.round("single_part.success", 6).alias("single_success"), F.col("multi_part.n").alias("n_multi"), F.round("multi_part.success", 6).alias("multi_success"),
        r("latency_p50"), r("latency_p95"), r("ttft_p50"), r("output_tokens_mean"), r("attempts_mean"), r("oracle_success"), r("cost_per_1k_usd"),
    )


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95
FROM lineitem GROUP BY l_returnflag""")
def percentile_linear(spark, d):
    found = stats.linear_percentiles(table(spark, d, "lineitem"), ["l_returnflag"], {"price": F.col("l_extendedprice")}, {"p50": ("price", 0.5), "p95": ("price", 0.95)})
    return found.select("l_returnflag", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@query("""SELECT l_returnflag, list_sort(list(l_extendedprice))[CAST(least(count(*) - 1, floor(0.5 * count(*))) AS BIGINT) + 1] AS p50,
  list_sort(list(l_extendedprice))[CAST(least(count(*) - 1, floor(0.95 * count(*))) AS BIGINT) + 1] AS p95 FROM lineitem GROUP BY l_returnflag""")
def percentile_index(spark, d):
    return stats.index_percentile(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95})


@query("""SELECT l_returnflag, list_sort(list(l_quantity))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median,
  list_sort(list(l_quantity))[CAST(floor(0.9 * count(*)) AS BIGINT) + 1] AS p90 FROM lineitem GROUP BY l_returnflag""")
def upper_median(spark, d):
    return stats.index_percentile(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", {"upper_median": 0.5, "p90": 0.9})


@query(f"WITH {NEWEST} SELECT lane, id, event_id, k, value FROM newest")
def newest_wins_dedup(spark, d):
    return newest(spark, d).select("lane", "id", "event_id", "k", "value")


@query(f"WITH {LOG} SELECT lane AS tag, max(strftime(created, '%Y%m%d-%H%M%S') || '_' || lane) AS run FROM log GROUP BY lane")
def latest_run_per_tag(spark, d):
    runs = log(spark, d).select(F.col("lane").alias("tag"), F.concat(F.date_format("created", "yyyyMMdd-HHmmss"), F.lit("_"), "lane").alias("run"))
    return results.latest_run(runs, "tag", "run")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def best_of_n_pick(spark, d):
    picked = results.best_of(table(spark, d, "lineitem").drop("l_shipdate"), ["l_orderkey"], "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return picked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT l_orderkey, max(l_discount) AS oracle, count(*) FILTER (WHERE l_discount >= 0.05) AS n_correct FROM lineitem GROUP BY l_orderkey")
def oracle_at_n(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("oracle"), F.count_if(F.col("l_discount") >= 0.05).alias("n_correct"))


@query(f"""WITH {NEWEST}, subset AS (SELECT * FROM newest WHERE (id + k) % 5 <> 0), common AS (
  SELECT id FROM subset GROUP BY id HAVING count(DISTINCT lane) = (SELECT count(DISTINCT lane) FROM subset))
SELECT lane, count(*) AS n, round(avg((value >= 20)::INT), 6) AS success FROM subset WHERE id IN (SELECT id FROM common) GROUP BY lane""")
def common_parts_board(spark, d):
    rows = results.common_items(newest(spark, d).where("(id + k) % 5 <> 0"), "id", "lane")
    return rows.groupBy("lane").agg(F.count("*").alias("n"), F.round(stats.share(F.col("value") >= 20), 6).alias("success"))


@query(f"""WITH {NEWEST}, j AS (SELECT lane, id, value, created, coalesce(p_size, -1) AS n_faces FROM newest LEFT JOIN part ON id = p_partkey)
SELECT lane, count(*) AS n, sum(n_faces)::BIGINT AS faces, count(*) FILTER (WHERE n_faces = -1) AS n_unknown FROM j GROUP BY lane""")
def relabelled_results(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n_faces"))
    rows = results.relabel(newest(spark, d).withColumn("n_faces", F.lit(-1)), parts, "id", ["n_faces"])
    return rows.groupBy("lane").agg(F.count("*").alias("n"), F.sum("n_faces").alias("faces"), F.count_if(F.col("n_faces") == -1).alias("n_unknown"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def only_filter(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(done, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def exclude_filter(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'A') AS n_others, coalesce(bool_or(l_discount >= 0.05) FILTER (WHERE l_returnflag = 'A'), false) AS ours_ok,
  bool_and(l_discount >= 0.05) FILTER (WHERE l_returnflag <> 'A') AS all_others_ok, bool_or(l_discount >= 0.05) FILTER (WHERE l_returnflag <> 'A') AS any_other_ok
FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag <> 'A') >= 2""")
def success_quantifiers(spark, d):
    rows = table(spark, d, "lineitem").withColumn("ok", F.col("l_discount") >= 0.05)
    return results.quantified(rows, "l_orderkey", "l_returnflag", "ok", ["A"])


@query("""WITH q AS (SELECT l_orderkey, sum(l_quantity) / 10 AS faces, bool_or(l_discount >= 0.05) FILTER (WHERE l_returnflag = 'A') AS ours, bool_or(l_discount >= 0.05) FILTER (WHERE l_returnflag <> 'A') AS any_other,
  bool_and(l_discount >= 0.05) FILTER (WHERE l_returnflag <> 'A') AS all_others FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag <> 'A') >= 2 AND count(*) FILTER (WHERE l_returnflag = 'A') > 0),
 r AS (SELECT 'win' AS section, *, row_number() OVER (ORDER BY (faces <= 6)::INT, abs(faces - 14), l_orderkey) AS place, 6 AS most FROM q WHERE ours AND NOT any_other
  UNION ALL SELECT 'easy', *, row_number() OVER (ORDER BY l_orderkey), 1 FROM q WHERE ours AND all_others AND faces <= 6 UNION ALL SELECT 'miss', *, row_number() OVER (ORDER BY l_orderkey), 1 FROM q WHERE NOT ours AND any_other)
SELECT section, place::INT AS place, l_orderkey, faces FROM r WHERE place <= most""")
def demo_picks(spark, d):
    """A top-k report in three sections: only ours right, all right, ours wrong and another right."""
    rows = table(spark, d, "lineitem").withColumn("ok", F.col("l_discount") >= 0.05)
    told = results.quantified(rows, "l_orderkey", "l_returnflag", "ok", ["A"])
    faces = rows.groupBy("l_orderkey").agg((F.sum("l_quantity") / 10).alias("faces"), F.count_if(F.col("l_returnflag") == "A").alias("n_ours")).where("n_ours > 0").drop("n_ours")
    return results.demo_picks(told.join(faces, "l_orderkey"), "l_orderkey", "faces").select("section", "place", "l_orderkey", "faces")


CALLS = "calls AS (SELECT l_orderkey AS id, l_linenumber AS no, l_quantity AS e2e_s, l_tax * 10 AS ttft_s, l_partkey AS output_tokens, CASE WHEN l_discount > 0 THEN l_extendedprice END AS cost_usd, l_suppkey AS reasoning_chars, l_orderkey % 2 = 0 AS parallel, l_linestatus, l_shipdate FROM lineitem)"


@query(f"""WITH {CALLS} SELECT id, bool_or(parallel) AS parallel, count(*) AS n_calls, min_by(ttft_s, (no, output_tokens, reasoning_chars, e2e_s)) AS ttft_s, CASE WHEN bool_or(parallel) THEN max(e2e_s) ELSE sum(e2e_s) END AS e2e_s,
  sum(output_tokens)::BIGINT AS output_tokens, sum(reasoning_chars)::BIGINT AS reasoning_chars, CASE WHEN count(*) = count(cost_usd) THEN round(sum(cost_usd), 2) END AS cost_usd FROM calls GROUP BY id""")
def result_rows(spark, d):
    """One result row for each item from its calls; samples of one item run in parallel or one after another."""
    calls = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("no"), F.col("l_quantity").alias("e2e_s"), (F.col("l_tax") * 10).alias("ttft_s"), F.col("l_partkey").alias("output_tokens"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("cost_usd"), F.col("l_suppkey").alias("reasoning_chars"), (F.col("l_orderkey") % 2 == 0).alias("parallel"),
    )
    return results.result_rows(calls, ["id"], ["no", "output_tokens", "reasoning_chars", "e2e_s"], "parallel").withColumn("cost_usd", F.round("cost_usd", 2))


@query(f"""WITH {LOG}, b AS (SELECT lane, CASE WHEN lane IN ('click', 'view', 'error') THEN 'image' ELSE 'text' END AS modality, count(*) AS n, avg((value >= 20)::INT) AS success FROM log GROUP BY lane)
SELECT lane, n, round(success, 6) AS success, row_number() OVER (ORDER BY (lane <> 'view')::INT, success DESC, lane)::INT AS place FROM b WHERE modality = 'image' AND lane <> 'error' AND n >= 100""")
def chart_lanes(spark, d):
    """The lanes of a chart: of one modality, no text-only model, enough rows; ours first, then by success."""
    board = log(spark, d).groupBy("lane").agg(F.count("*").alias("n"), stats.share(F.col("value") >= 20).alias("success")).withColumn("modality", F.when(F.col("lane").isin("click", "view", "error"), "image").otherwise("text"))
    return results.chart_lanes(board, "image", "lane", ["view"], skip=["error"], least=100).select("lane", "n", F.round("success", 6).alias("success"), "place")


@query(f"""WITH {ANSWERS} SELECT lane, count(*) AS n, round(avg((runs AND coalesce(iou, 0) >= 0.9)::INT), 6) AS success, round(avg((coalesce(iou, 0) >= 0.95)::INT), 6) AS success_iou95, round(avg(runs::INT), 6) AS run_rate,
  round(avg(coalesce(iou, 0)), 6) AS mean_iou_aligned, count(*) FILTER (WHERE n_parts = 1) AS n_single, count(*) FILTER (WHERE n_parts > 1) AS n_multi FROM answers GROUP BY lane""")
def imported_summary(spark, d):
    """An evaluation from elsewhere: no failed calls are taken out, and means don't ask whether a program ran."""
    s = results.imported_summary(answers(spark, d), ["lane"])
    r = lambda c: F.round(c, 6).alias(c)
    return s.select("lane", "n", r("success"), r("success_iou95"), r("run_rate"), r("mean_iou_aligned"), "n_single", "n_multi")


@query("""SELECT CASE WHEN p_partkey % 7 = 0 THEN 'multi' WHEN p_size <= 6 THEN 'simple' WHEN p_size <= 12 THEN 'medium' ELSE 'complex' END AS tier,
  count(*) AS n, round(avg(p_retailprice), 4) AS mean_price FROM part GROUP BY ALL""")
def tier_exclusive_case(spark, d):
    n_parts = F.when(F.col("p_partkey") % 7 == 0, 2).otherwise(1)
    return table(spark, d, "part").groupBy(results.exclusive_tier(F.col("p_size"), n_parts).alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))


@query(f"""SELECT tier, count(*) AS n, round(avg(p_retailprice), 4) AS mean_price FROM (
  SELECT tier, p_retailprice FROM part JOIN {TIERS} ON p_size BETWEEN lo AND hi
  UNION ALL SELECT 'multi', p_retailprice FROM part WHERE p_partkey % 7 = 0) GROUP BY tier""")
def tier_overlapping(spark, d):
    n_parts = F.when(F.col("p_partkey") % 7 == 0, 2).otherwise(1)
    rows = table(spark, d, "part").select("p_retailprice", F.explode(results.tiers(F.col("p_size"), n_parts)).alias("tier"))
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))


@query("""SELECT tier, count(*) AS n FROM (SELECT 'simple' AS tier FROM part WHERE p_partkey % 7 <> 0 AND p_size <= 6
  UNION ALL SELECT 'medium' FROM part WHERE p_partkey % 7 <> 0 AND p_size BETWEEN 7 AND 12 UNION ALL SELECT 'complex' FROM part WHERE p_size >= 13 OR p_partkey % 7 = 0) GROUP BY tier""")
def tier_examples(spark, d):
    n_parts = F.when(F.col("p_partkey") % 7 == 0, 2).otherwise(1)
    return table(spark, d, "part").select(F.explode(results.example_tiers(F.col("p_size"), n_parts)).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@query("""WITH runs AS (SELECT l_suppkey % 5 AS lane, l_suppkey AS run, count(*) AS n, CASE WHEN l_suppkey % 3 <> 0 THEN avg(l_extendedprice) END AS cost FROM lineitem GROUP BY l_suppkey)
SELECT lane, round(sum(cost * n) / nullif(sum(n) FILTER (WHERE cost IS NOT NULL), 0), 4) AS cost_per_1k_usd FROM runs GROUP BY lane""")
def weighted_cost(spark, d):
    runs = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("c"))
    runs = runs.select((F.col("l_suppkey") % 5).alias("lane"), "n", F.when(F.col("l_suppkey") % 3 != 0, F.col("c")).alias("cost_per_1k_usd"))
    return results.run_cost(runs, ["lane"]).withColumn("cost_per_1k_usd", F.round("cost_per_1k_usd", 4))


@query("""SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_discount = 0) = 0 THEN round(sum(l_extendedprice), 2) END AS cost FROM lineitem GROUP BY l_orderkey""")
def sum_or_null(spark, d):
    cost = F.when(F.col("l_discount") != 0, F.col("l_extendedprice"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(stats.sum_or_null(cost), 2).alias("cost"))


@query("""SELECT l_suppkey, round((6.5 / 3600) * sum(l_quantity) / count(*) * 1000, 6) AS cost_per_1k_usd FROM lineitem GROUP BY l_suppkey""")
def amortized_gpu_cost(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(results.amortized_cost(F.lit(6.5), F.sum("l_quantity"), F.count("*")), 6).alias("cost_per_1k_usd"))


@query("""WITH price AS (SELECT s_suppkey, 1.0 + s_nationkey AS i, 0.1 * s_nationkey AS c, 3.0 AS o FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT l_suppkey AS model, count(*) AS n, round(sum((greatest(l_partkey - l_linenumber * 100, 0) * i + l_linenumber * 100 * c + l_quantity * o) / 1e6), 6) AS cost_usd
FROM lineitem LEFT JOIN price ON l_suppkey = s_suppkey GROUP BY l_suppkey""")
def token_price_join(spark, d):
    prices = table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("model"), (1.0 + F.col("s_nationkey")).alias("input"), (0.1 * F.col("s_nationkey")).alias("cached"), F.lit(3.0).alias("output"))
    calls = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("model"), F.col("l_partkey").alias("prompt_tokens"), (F.col("l_linenumber") * 100).alias("cached_tokens"), F.col("l_quantity").alias("output_tokens"))
    return results.token_cost(calls, prices).groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > l_tax * 100 THEN round(l_partkey / (l_quantity - l_tax * 100), 6) END AS tps
FROM lineitem""")
def token_rate(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(results.tokens_per_second(F.col("l_partkey"), F.col("l_quantity"), F.col("l_tax") * 100), 6).alias("tps"))


@query(f"""WITH {LOG} SELECT lane, count(*) AS n, round((p + 1.959963984540054^2 / (2 * n1) - 1.959963984540054 * sqrt(p * (1 - p) / n1 + 1.959963984540054^2 / (4 * n1 * n1))) / (1 + 1.959963984540054^2 / n1), 6) AS low,
  round((p + 1.959963984540054^2 / (2 * n1) + 1.959963984540054 * sqrt(p * (1 - p) / n1 + 1.959963984540054^2 / (4 * n1 * n1))) / (1 + 1.959963984540054^2 / n1), 6) AS high
FROM (SELECT *, count(*) OVER (PARTITION BY lane) AS n1, avg((value >= 20)::INT) OVER (PARTITION BY lane) AS p FROM log) GROUP BY lane, p, n1""")
def wilson_ci(spark, d):
    low, high = stats.wilson(F.count_if(F.col("value") >= 20), F.count("*"))
    return log(spark, d).groupBy("lane").agg(F.count("*").alias("n"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query()
def bootstrap_ci_exact(spark, d):
    """Seeded resampling of each lane's newest answers, in the order of their ids."""
    return stats.bootstrap(newest(spark, d).withColumn("ok", (F.col("value") >= 20).cast("double")), ["lane"], "ok", "id")


@query()
def bootstrap_ci_split(spark, d):
    """The interval of the mean value of all answers of each lane, from resamples drawn over many tasks."""
    return stats.split_bootstrap(log(spark, d), ["lane"], "value", most=100)


@query()
def bootstrap_ci_binomial(spark, d):
    return stats.binomial_bootstrap(log(spark, d), ["lane"], F.col("value") >= 20)


@query("""SELECT 'n_chars' AS signal, * FROM (WITH x AS (SELECT n_chars AS s, quality FROM documents JOIN labels USING (doc_id)), c AS (SELECT s, sum(quality) AS p, sum(1 - quality) AS n FROM x GROUP BY s),
  w AS (SELECT p, n, p * (coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS w FROM c) SELECT round(sum(w) / (sum(p) * sum(n)), 6) AS auc FROM w)""")
def verifier_auc(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.lit("n_chars").alias("signal"), F.col("n_chars").cast("double").alias("s"), (F.col("quality") == 1).alias("ok"))
    return stats.auc(rows, ["signal"], "s", "ok").withColumn("auc", F.round("auc", 6))


@query("""WITH b AS (SELECT n_chars * 1.0 AS x, length(source) * 1.0 AS y, quality FROM documents JOIN labels USING (doc_id)),
  u AS (SELECT 'chars' AS signal, x AS s, quality FROM b UNION ALL SELECT 'source', y, quality FROM b UNION ALL SELECT 'product', x * y, quality FROM b),
  c AS (SELECT signal, s, sum(quality) AS p, sum(1 - quality) AS n FROM u GROUP BY ALL),
  w AS (SELECT signal, p, n, p * (coalesce(sum(n) OVER (PARTITION BY signal ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS w FROM c)
SELECT signal, round(sum(w) / (sum(p) * sum(n)), 6) AS auc FROM w GROUP BY signal""")
def auc_by_signal(spark, d):
    x, y = F.col("n_chars").cast("double"), F.length("source").cast("double")
    base = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.col("quality") == 1).alias("ok"), x.alias("chars"), y.alias("source"), (x * y).alias("product"))
    rows = base.unpivot("ok", ["chars", "source", "product"], "signal", "s")
    return stats.auc(rows, ["signal"], "s", "ok").withColumn("auc", F.round("auc", 6))


@query("""WITH g AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2 AND bool_or(l_discount >= 0.05)),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem JOIN g USING (l_orderkey)),
  per AS (SELECT l_orderkey, avg((l_discount >= 0.05)::INT) AS base, max((l_discount >= 0.05)::INT) FILTER (WHERE rn = 1) AS picked FROM r GROUP BY l_orderkey)
SELECT count(*) AS n, round(avg(base), 6) AS random_rate, round(avg(picked), 6) AS pick_rate FROM per""")
def selection_test(spark, d):
    ok = F.col("l_discount") >= 0.05
    rows = table(spark, d, "lineitem")
    base = rows.groupBy("l_orderkey").agg(F.count("*").alias("c"), F.bool_or(ok).alias("any"), F.avg(ok.cast("double")).alias("base")).where("c >= 2 and any")
    picked = results.best_of(rows.drop("l_shipdate"), ["l_orderkey"], "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", ok.cast("double").alias("picked"))
    return base.join(picked, "l_orderkey").agg(F.count("*").alias("n"), F.round(F.avg("base"), 6).alias("random_rate"), F.round(F.avg("picked"), 6).alias("pick_rate"))


@query("""SELECT CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' WHEN abs(a.o_totalprice - b.o_totalprice) >= 1e-9 THEN 'o_totalprice' ELSE 'same' END AS status, count(*) AS n
FROM orders a LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 17 <> 0) b USING (o_orderkey) GROUP BY 1""")
def compare_reconcile(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    b = a.where("o_orderkey % 17 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return results.reconcile(a, b, ["o_orderkey"], ["o_orderstatus"], ["o_totalprice"]).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, coalesce(a.s_name, b.s_name, 'default') AS answer FROM customer LEFT JOIN supplier a ON c_custkey = a.s_suppkey
LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY s_nationkey) b ON c_nationkey = b.s_nationkey""")
def lookup_fallback(spark, d):
    s = table(spark, d, "supplier")
    exact = s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("a"))
    derived = s.where("s_nationkey % 3 = 0").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_name").alias("b"))
    return table(spark, d, "customer").join(exact, "c_custkey", "left").join(derived, "c_nationkey", "left").select("c_custkey", F.coalesce("a", "b", F.lit("default")).alias("answer"))


@query(f"""WITH {LOG}, dim AS (SELECT * FROM (VALUES ('click', 'Click lane', 'low'), ('view', 'View lane', NULL)) AS t(lane, name, effort))
SELECT lane, coalesce(name, lane) || coalesce(' (' || effort || ')', '') || CASE WHEN max(k) > 98 THEN ' best of 8' ELSE '' END AS label, count(*) AS n FROM log LEFT JOIN dim USING (lane) GROUP BY lane, name, effort""")
def lane_dim_label(spark, d):
    dim = spark.createDataFrame([("click", "Click lane", "low"), ("view", "View lane", None)], "lane string, name string, effort string")
    rows = log(spark, d).groupBy("lane").agg(F.count("*").alias("n"), F.max("k").alias("k")).join(F.broadcast(dim), "lane", "left")
    label = F.concat(F.coalesce("name", "lane"), F.coalesce(F.concat(F.lit(" ("), "effort", F.lit(")")), F.lit("")), F.when(F.col("k") > 98, " best of 8").otherwise(""))
    return rows.select("lane", label.alias("label"), "n")


@query("""WITH t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS pos, count(*) AS n FROM part GROUP BY p_type)
SELECT pos::INT AS pos, CASE WHEN p_type LIKE 'ECONOMY%' THEN lower(p_type) ELSE lower(p_type) || CASE WHEN n % 2 = 0 THEN '@high' ELSE '' END END AS key,
  CASE WHEN p_type LIKE 'ECONOMY%' THEN 'Known ' || p_type ELSE p_type || CASE WHEN n % 2 = 0 THEN ' (high)' ELSE '' END END AS label, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'org/' || p_type ELSE 'org/' || p_type END AS model,
  CASE WHEN p_type LIKE 'ECONOMY%' THEN 'low' WHEN n % 2 = 0 THEN 'high' END AS effort FROM t WHERE p_type LIKE 'ECONOMY%' OR p_type NOT LIKE 'PROMO%'""")
def lane_spec(spark, d):
    """The lanes of a specification text made of the parts' types: some known by key, others by owner, those without one left out."""
    types = table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    kind = F.col("p_type")
    item = F.when(kind.startswith("ECONOMY"), F.lower(kind)).when(kind.startswith("PROMO"), kind).otherwise(F.concat(F.lit("org/"), kind, F.when(F.col("n") % 2 == 0, ":high").otherwise("")))
    spec = types.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_type", item.alias("item")))), lambda x: x["item"]), ",").alias("spec"))
    known = types.where(kind.startswith("ECONOMY")).select(F.lower(kind).alias("key"), F.concat(F.lit("Known "), kind).alias("label"), F.concat(F.lit("org/"), kind).alias("model"), F.lit("low").alias("effort"))
    pretty = types.select(F.concat(F.lit("org/"), kind).alias("model"), kind.alias("name"))
    return results.resolve_lanes(spec, known, pretty)


@query(f"""WITH {NEWEST}, r AS (SELECT lane, tier, avg((value >= 20)::INT) AS s FROM newest JOIN part ON id = p_partkey JOIN {TIERS} ON p_size BETWEEN lo AND hi GROUP BY ALL)
SELECT lane, round(max(s) FILTER (WHERE tier = 'all'), 6) AS "all", round(max(s) FILTER (WHERE tier = 'simple'), 6) AS simple, round(max(s) FILTER (WHERE tier = 'medium'), 6) AS medium, round(max(s) FILTER (WHERE tier = 'complex'), 6) AS complex FROM r GROUP BY lane""")
def pivot_board(spark, d):
    names = ["all", "simple", "medium", "complex"]
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    rates = results.tiered_rates(newest(spark, d).join(parts, "id"), ["lane"], results.tiers(F.col("p_size")), F.col("value") >= 20)
    return rates.groupBy("lane").pivot("tier", names).agg(F.round(F.first("success"), 6))


@query(f"""WITH {ANSWERS}, s AS (SELECT lane, count(*) AS n, avg(success::INT) AS p, avg(runs::INT) AS r, quantile_cont(e2e_s, 0.5) AS l, avg(output_tokens) AS o FROM live GROUP BY lane),
 c AS (SELECT *, 1.959963984540054 AS z FROM s), w AS (SELECT *, p + z * z / (2 * n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) AS h, 1 + z * z / n AS q FROM c)
SELECT '| ' || lane || ' | **' || printf('%.1f%%', round(p * 100, 1)) || '** [' || printf('%.1f%%', round((m - h) / q * 100, 1)) || ', ' || printf('%.1f%%', round((m + h) / q * 100, 1)) || '] | ' || printf('%.1f%%', round(r * 100, 1)) || ' | ' || printf('%.1f', round(l, 1)) || ' | ' || printf('%.0f', round(o, 0)) || ' |' AS value FROM w""")
def markdown_report(spark, d):
    return writers.markdown(results.lane_summary(answers(spark, d), ["lane"]))


@query(f"""WITH {LOG}, c AS (SELECT lane, least(k // 20, 3) AS step, avg((value >= 20)::INT) AS s, avg((value >= 20)::INT) FILTER (WHERE id % 3 = 0) AS h FROM log GROUP BY ALL)
SELECT lane, step, round(s, 6) AS success, round(h, 6) AS hard_success FROM c""")
def learning_curve(spark, d):
    rows = log(spark, d).withColumn("step", F.least(F.expr("k div 20"), F.lit(3)).cast("int"))
    ok = F.col("value") >= 20
    return rows.groupBy("lane", "step").agg(F.round(stats.share(ok), 6).alias("success"), F.round(stats.share_where(ok, F.col("id") % 3 == 0), 6).alias("hard_success"))


@query("""SELECT c_custkey, coalesce(lag(c_custkey) OVER w, last_value(c_custkey) OVER f) AS prev, coalesce(lead(c_custkey) OVER w, first_value(c_custkey) OVER f) AS next FROM customer
WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey), f AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def cyclic_neighbours(spark, d):
    return curate.cyclic_neighbours(table(spark, d, "customer"), "c_nationkey", "c_custkey").select("c_custkey", "prev", "next")


@query(f"""WITH {LOG}, g AS (SELECT k % 5 AS modality, lane, max(strftime(created, '%Y%m%d-%H') || '_r' || (k % 3)) AS run FROM log WHERE lane <> 'error' GROUP BY ALL),
 m AS (SELECT k % 5 AS modality, lane, strftime(created, '%Y%m%d-%H') || '_r' || (k % 3) AS run, max(k) AS shots FROM log GROUP BY ALL) SELECT modality, lane, run, shots FROM g JOIN m USING (modality, lane, run)""")
def newest_lane_metadata(spark, d):
    rows = log(spark, d).select((F.col("k") % 5).alias("modality"), "lane", F.concat(F.date_format("created", "yyyyMMdd-HH"), F.lit("_r"), F.col("k") % 3).alias("run"), "k", F.when(F.col("lane") == "error", "api: 500").alias("error"), F.when(F.col("lane") != "error", F.col("k") + 1).alias("output_tokens"))
    runs = rows.groupBy("modality", "lane", "run").agg(F.max("k").alias("shots"))
    return results.newest_metadata(rows, runs, ["modality", "lane"]).select("modality", "lane", "run", "shots")


@query("""SELECT source, n_clean FROM (SELECT source, count(*) FILTER (WHERE n_chars > 20) AS n_clean FROM documents GROUP BY source) WHERE n_clean > 30""")
def report_rows(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 20).alias("n_clean"))
    return results.report_rows(counts, least=30)


@query(f"""WITH {LOG}, r AS (SELECT value, CASE k % 4 WHEN 0 THEN 'x_base' WHEN 1 THEN 'x_ckpt' || k || '-img' WHEN 2 THEN 'x_final' ELSE 'x_ckpt' || k END AS run FROM log),
 s AS (SELECT value, CASE WHEN run LIKE '%-img' THEN CAST(regexp_extract(run, '_ckpt([0-9]+)-img$', 1) AS INT) WHEN run LIKE '%_base' THEN 0 WHEN run LIKE '%_final' THEN 500 END AS step FROM r)
SELECT step, count(*) AS n, round(avg((value >= 20)::INT), 6) AS success FROM s WHERE step IS NOT NULL GROUP BY step""")
def checkpoint_curve(spark, d):
    """Success by training step, which the names of the runs tell."""
    k = F.col("k")
    name = F.when(k % 4 == 0, "x_base").when(k % 4 == 1, F.concat(F.lit("x_ckpt"), k, F.lit("-img"))).when(k % 4 == 2, "x_final").otherwise(F.concat(F.lit("x_ckpt"), k))
    points = results.learning_points(log(spark, d).withColumn("run", name), "run", F.col("value") >= 20, final=("final", 500))
    return points.select("step", "n", F.round("success", 6).alias("success"))


@query("""SELECT 'cad-' || event_type || '-' || (event_id % 4) AS session, count(*) AS n, count(DISTINCT user_id) AS n_items FROM events GROUP BY 1""")
def session_affinity(spark, d):
    session = text.session_key(F.col("event_type"), F.col("event_id"))
    return table(spark, d, "events").groupBy(session.alias("session")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_items"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') || '_' || event_type AS run, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created, date_trunc('second', ts) AS parsed FROM events""")
def run_times(spark, d):
    """Names of runs from their times, and times written and read in ISO form."""
    created = text.iso_seconds(F.col("ts"))
    return table(spark, d, "events").select("event_id", text.run_name(F.col("ts"), F.col("event_type")).alias("run"), created.alias("created"), F.to_timestamp_ntz(created).alias("parsed"))


WHOLE = """calls AS (SELECT l_orderkey AS id, 'L' || (l_orderkey % 3) AS lane, l_linenumber * 1000000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_discount) AS no, l_orderkey % 2 = 0 AS parallel,
  l_discount > 0.02 AS runs, least(l_quantity / 40, 1.0)::DOUBLE AS iou, CASE WHEN l_tax > 0.01 THEN least(l_quantity / 45, 1.0)::DOUBLE END AS iou_aligned, (l_tax / 10)::DOUBLE AS chamfer, CASE WHEN l_discount <= 0.02 THEN 'failed' END AS error,
  'c' || l_partkey AS code, l_tax::DOUBLE AS ttft_s, l_quantity::DOUBLE AS e2e_s, l_partkey AS output_tokens, l_suppkey AS reasoning_chars, CASE WHEN l_discount > 0 THEN l_extendedprice::DOUBLE END AS cost_usd FROM lineitem),
 g AS (SELECT id, lane, bool_or(parallel) AS p, max_by({'runs': runs, 'iou': iou, 'iou_aligned': iou_aligned, 'chamfer': chamfer, 'error': error, 'code': code}, (CASE WHEN parallel THEN coalesce(iou_aligned, 0) ELSE 0 END, CASE WHEN parallel THEN -no ELSE no END)) AS b, count(*) AS n, count(*) FILTER (WHERE runs) AS r,
  max(CASE WHEN runs THEN coalesce(iou_aligned, 0) ELSE 0 END) AS oracle_iou, min_by(ttft_s, no) AS ttft_s, max(e2e_s) AS longest, sum(e2e_s) AS total, sum(output_tokens)::BIGINT AS output_tokens, sum(reasoning_chars)::BIGINT AS reasoning_chars, CASE WHEN count(*) = count(cost_usd) THEN sum(cost_usd) END AS cost FROM calls GROUP BY id, lane),
 whole AS (SELECT id, lane, 'org/' || lane AS model, b.runs AS runs, b.iou AS iou, b.iou_aligned AS iou_aligned, b.chamfer AS chamfer, b.error AS error, b.code AS code, CASE WHEN p THEN 1 ELSE n END AS attempts, CASE WHEN p THEN n END AS samples, CASE WHEN p THEN r END AS samples_run, oracle_iou, ttft_s,
  CASE WHEN p THEN longest ELSE total END AS e2e_s, output_tokens, reasoning_chars, round(cost, 2) AS cost_usd, o_custkey % 3 + 1 AS n_parts, o_orderkey % 20 AS n_faces, b.runs AND coalesce(b.iou_aligned, 0) >= 0.9 AS success FROM g JOIN orders ON id = o_orderkey WHERE lane <> 'L2')"""


def whole(spark, d):
    """Whole result rows of calls made of line items; one lane has no description, so its rows are left out.

    Numbers come first and names after them, so that the line items are shuffled once, by order, with their own columns only."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount")
    line = table(spark, d, "lineitem").drop("l_returnflag", "l_linestatus", "l_shipdate").withColumn("place", F.row_number().over(order))
    double = lambda c: F.col(c).cast("double")
    calls = line.select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("L"), F.col("l_orderkey") % 3).alias("lane"), (F.col("l_linenumber") * 1_000_000 + F.col("place")).alias("no"), (F.col("l_orderkey") % 2 == 0).alias("parallel"),
        (F.col("l_discount") > 0.02).alias("runs"), F.least(double("l_quantity") / 40, F.lit(1.0)).alias("iou"), F.when(F.col("l_tax") > 0.01, F.least(double("l_quantity") / 45, F.lit(1.0))).alias("iou_aligned"), (double("l_tax") / 10).alias("chamfer"),
        F.when(F.col("l_discount") <= 0.02, "failed").alias("error"), F.concat(F.lit("c"), "l_partkey").alias("code"), double("l_tax").alias("ttft_s"), double("l_quantity").alias("e2e_s"), F.col("l_partkey").alias("output_tokens"), F.col("l_suppkey").alias("reasoning_chars"),
        F.when(F.col("l_discount") > 0, double("l_extendedprice")).alias("cost_usd"),
    )
    parts = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3 + 1).alias("n_parts"), (F.col("o_orderkey") % 20).alias("n_faces"))
    lanes = spark.createDataFrame([("L0", "org/L0"), ("L1", "org/L1")], "lane string, model string")
    return results.whole_rows(calls, parts, lanes)


@query(f"""WITH {WHOLE} SELECT * FROM whole""")
def whole_result_rows(spark, d):
    return whole(spark, d).withColumn("cost_usd", F.round("cost_usd", 2))


@query(f"""WITH {WHOLE} SELECT lane, count(*) AS n, round(avg(success::INT), 6) AS success, round(avg(runs::INT), 6) AS run_rate, round(quantile_cont(e2e_s, 0.95), 6) AS latency_p95, round(median(chamfer) FILTER (WHERE runs), 8) AS median_chamfer,
  round(avg(attempts), 6) AS attempts_mean, round(avg((coalesce(oracle_iou, 0) >= 0.9)::INT), 6) AS oracle_success FROM whole GROUP BY lane""")
def lane_summary_of_calls(spark, d):
    """The lane summary of whole result rows, which it reads twice, so they are settled first with the columns that it needs."""
    rounded = lambda c, n=6: F.round(c, n).alias(c)
    rows = stats.settled(whole(spark, d).select("lane", "error", "output_tokens", "runs", "success", "iou_aligned", "chamfer", "n_parts", "e2e_s", "ttft_s", "attempts", "cost_usd", "oracle_iou"))
    return results.lane_summary(rows, ["lane"]).select("lane", "n", rounded("success"), rounded("run_rate"), rounded("latency_p95"), rounded("median_chamfer", 8), rounded("attempts_mean"), rounded("oracle_success"))


@query(f"""WITH {LOG}, r AS (SELECT id, lane, k % 5 AS modality, strftime(created, '%Y%m%d') AS run, created, event_id, value, k FROM log WHERE lane <> 'error'), s AS (SELECT strftime(created, '%Y%m%d') AS run, lane, count(*) AS n, max(k) AS shots FROM log WHERE k > 3 GROUP BY ALL),
 w AS (SELECT r.*, s.n AS run_n, s.shots AS run_shots, row_number() OVER (PARTITION BY modality, lane, id ORDER BY created DESC, run DESC, event_id DESC) AS p FROM r JOIN s USING (run, lane))
SELECT modality, lane, id, run, event_id, run_n, run_shots, CASE WHEN p_partkey IS NULL THEN 1 ELSE p_size % 3 + 1 END AS n_parts, CASE WHEN p_partkey IS NULL THEN k % 20 ELSE p_size END AS n_faces FROM w LEFT JOIN part ON p_partkey = id AND id % 4 <> 0 WHERE p = 1""")
def pooled_result_rows(spark, d):
    """The newest answer of each part and lane with its run's summary of the lane, under the parts' labels of today."""
    rows = log(spark, d).select("id", "lane", (F.col("k") % 5).alias("modality"), F.date_format("created", "yyyyMMdd").alias("run"), F.struct("created", F.date_format("created", "yyyyMMdd"), "event_id").alias("created"), "event_id", F.when(F.col("lane") == "error", "api: 500").alias("error"), F.when(F.col("lane") != "error", 5).alias("output_tokens"), F.lit(1).alias("n_parts"), (F.col("k") % 20).alias("n_faces"))
    summaries = log(spark, d).where("k > 3").groupBy(F.date_format("created", "yyyyMMdd").alias("run"), "lane").agg(F.count("*").alias("n"), F.max("k").alias("shots"))
    parts = table(spark, d, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3 + 1).alias("n_parts"), F.col("p_size").alias("n_faces"))
    return results.pooled_rows(rows, summaries, parts, ["modality", "lane"]).select("modality", "lane", "id", "run", "event_id", "run_n", "run_shots", "n_parts", "n_faces")
