"""Queries of the viewer: part lists, filters, comparisons, replay timing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate, serve
from .board import NEWEST, newest
from .registry import LOG, log, query, table

PARTS = f"""{NEWEST}, a AS (SELECT id, lane, value >= 20 AS success FROM newest),
 g AS (SELECT id, count(DISTINCT lane) AS n_models, count(*) FILTER (WHERE lane NOT IN ('click', 'view') AND success) AS n_correct_others,
   min(CASE lane WHEN 'view' THEN '1view' WHEN 'click' THEN '2click' END) AS own, coalesce(bool_or(success) FILTER (WHERE lane IN ('click', 'view')), false) AS own_correct FROM a GROUP BY id HAVING count(DISTINCT lane) >= 2),
 parts AS (SELECT id, n_models, n_correct_others, substr(own, 2) AS own_lane, own_correct, p_size AS n_faces, p_name AS title, p_retailprice,
   CASE WHEN id % 7 = 0 THEN 'multi' WHEN p_size <= 6 THEN 'simple' WHEN p_size <= 12 THEN 'medium' ELSE 'complex' END AS tier
   FROM g JOIN part ON id = p_partkey WHERE id IN (SELECT s_suppkey FROM supplier))"""


def listed(spark, d):
    lanes = newest(spark, d).select("id", "lane", F.when(F.col("lane") == "view", 8).otherwise(1).alias("best_of"), (F.col("value") >= 20).alias("success"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n_faces"), F.when(F.col("p_partkey") % 7 == 0, 2).otherwise(1).alias("n_parts"), F.col("p_name").alias("title"), "p_retailprice")
    return serve.part_list(lanes, parts, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), ["click", "view"])


@query(f"WITH {PARTS} SELECT id, n_models, n_correct_others, own_lane, own_correct, n_faces, tier FROM parts")
def viewer_parts(spark, d):
    found = listed(spark, d).select("id", "n_models", "n_correct_others", "own_lane", "own_correct", "n_faces", "tier")
    return found.orderBy(serve.display_order(F.col("tier")), F.desc("n_faces"), "id")


@query(f"WITH {PARTS} SELECT id, title FROM parts WHERE contains(lower(title), 'ring') AND n_correct_others = 0")
def viewer_search(spark, d):
    return serve.searched(listed(spark, d), "RING", "hard").select("id", "title")


@query(f"""WITH {PARTS} SELECT id FROM parts ORDER BY (own_correct AND n_correct_others = 0) DESC, own_correct DESC, (greatest(p_retailprice / 100, 2) / greatest(least(p_retailprice / 100, 2), 1e-9) < 5) DESC, n_faces DESC, id LIMIT 1""")
def viewer_default(spark, d):
    return serve.default_part(listed(spark, d).withColumn("extents", F.array(F.col("p_retailprice") / 100, F.lit(2.0))), slender=5.0).select("id")


@query(f"""WITH {NEWEST} SELECT id, string_agg(lane, ',' ORDER BY lane NOT IN ('click', 'view'), CASE WHEN lane = 'view' THEN -8 ELSE -1 END, lane) AS lanes FROM newest GROUP BY id""")
def viewer_comparison(spark, d):
    lanes = newest(spark, d).select("id", "lane", F.col("lane").alias("label"), F.when(F.col("lane") == "view", 8).otherwise(1).alias("best_of"), (F.col("value") >= 20).alias("success"))
    return serve.comparison(lanes, ["click", "view"]).select("id", F.array_join(F.transform("lanes", lambda x: x["lane"]), ",").alias("lanes"))


@query(f"""WITH {LOG}, t AS (SELECT id, event_id, greatest(coalesce(value, 0), 0.6) AS e, k FROM log), u AS (SELECT *, least(coalesce(CASE WHEN k % 3 <> 0 THEN k / 5 END, e * 0.3), e - 0.1) AS f FROM t)
SELECT event_id, round(f, 6) AS ttft, round(e, 6) AS e2e, round(least(1.0, 9 / max(e) OVER (PARTITION BY id)), 8) AS speed FROM u""")
def replay_timing(spark, d):
    ttft, e2e = serve.replay_times(F.when(F.col("k") % 3 != 0, F.col("k") / 5), F.col("value"))
    rows = serve.replay_speed(log(spark, d).withColumn("e2e", e2e).withColumn("ttft", ttft), ["id"], "e2e")
    return rows.select("event_id", F.round("ttft", 6).alias("ttft"), F.round("e2e", 6).alias("e2e"), F.round("speed", 8).alias("speed"))


@query(f"""WITH {LOG}, r AS (SELECT *, CASE lane WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS at, row_number() OVER (PARTITION BY k, id ORDER BY CASE lane WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END DESC, event_id DESC) AS rn FROM log WHERE lane IN ('view', 'click'))
SELECT k AS lane, id, lane AS tag, event_id FROM r WHERE rn = 1""")
def saved_answer_lookup(spark, d):
    rows = log(spark, d).select(F.col("k").alias("lane"), "id", F.col("lane").alias("tag"), "event_id")
    return serve.saved_answers(rows.select("lane", "id", "event_id", "tag"), ["view", "click"]).select("lane", "id", "tag", "event_id")


@query(f"""WITH {PARTS}, o AS (SELECT *, row_number() OVER (ORDER BY n_faces DESC, id) AS spot FROM parts), sizes AS (SELECT tier, min(spot) AS group_at, count(*) AS n FROM o GROUP BY tier)
SELECT tier || ' (' || n || ')' AS "group", group_at, id, title || ' · ' || n_faces || ' faces' || CASE WHEN id % 7 = 0 THEN ', 2 parts' ELSE '' END AS label FROM o JOIN sizes USING (tier)""")
def viewer_picker(spark, d):
    """The parts of the picker in their groups."""
    ranked = curate.with_rank(listed(spark, d).withColumn("_down", -F.col("n_faces")), ["_down", "id"]).withColumnRenamed("_rank", "at")
    return serve.picker_rows(ranked).select("group", "group_at", "id", "label")


@query(f"""WITH {NEWEST}, a AS (SELECT id, lane, lane NOT IN ('click', 'view') AS other, k % 7 <> 0 AS coded, greatest(CASE WHEN k % 5 = 0 OR value = 0 THEN 1.0 ELSE value END, 0.6) AS e, CASE WHEN k % 3 = 0 OR value = 0 THEN 0.5 ELSE value / 10 END AS f FROM newest),
 b AS (SELECT *, round(least(f, e - 0.1), 3) AS u FROM a),
 ev AS (SELECT id, lane, other, 1 AS no, u AS t, 'reasoning' AS type FROM b UNION ALL SELECT id, lane, other, 2, u, 'status' FROM b UNION ALL SELECT id, lane, other, 3, round(e, 3), 'content' FROM b WHERE coded
  UNION ALL SELECT id, lane, other, 4, round(e, 3), 'generated' FROM b UNION ALL SELECT id, lane, other, 5, round(e + 0.4, 3), 'graded' FROM b UNION ALL SELECT DISTINCT id, NULL, false, 0, 0.0, 'target' FROM b)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY t, no > 0, other, lane, no) AS at, t, lane, type FROM ev""")
def replay_events(spark, d):
    """The events that replay each part's newest answers at their measured times."""
    rows = newest(spark, d)
    k = F.col("k")
    answers = rows.select("id", "lane", F.col("lane").isin("click", "view").alias("dedicated"), F.when(k % 3 != 0, F.col("value") / 10).alias("ttft_s"), F.when(k % 5 != 0, F.col("value")).alias("e2e_s"), F.when(k % 7 != 0, "x").alias("code"))
    return serve.replay_events(answers, "id", "lane", "dedicated").withColumn("at", F.col("at").cast("long"))
