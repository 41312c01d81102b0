"""What a viewer asks for: lists, filters, default picks, comparisons, and replay timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import results

TIER_ORDER = ["simple", "medium", "complex", "multi"]  # fixed value


def part_list(lanes: DataFrame, parts: DataFrame, sheets: DataFrame, ours: list[str], least_models: int = 2) -> DataFrame:
    """Parts with a sheet and answers of enough models: tier, correct others, and the first own lane.

    lanes: id, lane, best_of, success. parts: id, n_faces, n_parts. sheets: id.
    """
    mine = F.col("lane").isin(ours)
    answered = lanes.groupBy("id").agg(
        F.count_distinct("lane").alias("n_models"),
        F.count_if(~mine & F.col("success")).alias("n_correct_others"),
        F.min_by("lane", F.when(mine, F.struct((-F.col("best_of")).alias("b"), F.col("lane")))).alias("own_lane"),
        F.coalesce(F.bool_or(F.when(mine, F.col("success"))), F.lit(False)).alias("own_correct"),
    )
    kept = answered.where(F.col("n_models") >= least_models).join(sheets.select("id").distinct(), "id", "left_semi").join(parts, "id")
    return kept.withColumn("tier", results.exclusive_tier(F.col("n_faces"), F.col("n_parts")))


def display_order(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIER_ORDER]), tier)


def picker_rows(parts: DataFrame) -> DataFrame:
    """group ("tier (n)"), group_at (place of the tier's first part), at, id and label of each part, in display order.

    parts: at, id, title, n_faces, n_parts, tier. A tier is as many rows as it has parts; only its size is folded.
    """
    several = F.when(F.col("n_parts") > 1, F.concat(F.lit(", "), F.col("n_parts").cast("string"), F.lit(" parts"))).otherwise("")
    label = F.concat("title", F.lit(" · "), F.col("n_faces").cast("string"), F.lit(" faces"), several)
    sizes = parts.groupBy("tier").agg(F.min("at").alias("group_at"), F.concat("tier", F.lit(" ("), F.count("*").cast("string"), F.lit(")")).alias("group"))
    return parts.join(sizes, "tier").select("group", "group_at", "at", "id", label.alias("label")).orderBy("group_at", "at")


def searched(parts: DataFrame, needle: str = "", which: str = "all") -> DataFrame:
    """Parts whose title holds the text in any case: all, wins (only ours correct), missed (ours wrong), hard (no other correct)."""
    tests = {
        "all": F.lit(True),
        "wins": F.col("own_correct") & (F.col("n_correct_others") == 0),
        "missed": ~F.col("own_correct"),
        "hard": F.col("n_correct_others") == 0,
    }
    return parts.where(F.lower("title").contains(needle.lower()) & tests[which])


def default_part(parts: DataFrame, extents: str = "extents", slender: float = 8.0) -> DataFrame:
    """The one part shown first: ours alone correct before all others, compact before slender, most faces, least id."""
    compact = F.array_max(extents) / F.greatest(F.array_min(extents), F.lit(1e-9)) < slender
    alone = F.col("own_correct") & (F.col("n_correct_others") == 0)
    return parts.orderBy(F.desc(alone), F.desc(F.col("own_correct")), F.desc(compact), F.desc("n_faces"), "id").limit(1)


def comparison(lanes: DataFrame, ours: list[str]) -> DataFrame:
    """id and its lanes in display order: ours first, more samples first, then by label."""
    key = F.struct((~F.col("lane").isin(ours)).alias("other"), (-F.col("best_of")).alias("b"), "label", "lane", "success")
    return lanes.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: F.struct(x["label"].alias("label"), x["lane"].alias("lane"), x["success"].alias("success"))).alias("lanes"))


def short_label(label: Column, replacements: list[tuple[str, str]]) -> Column:
    for a, b in replacements:
        label = F.replace(label, F.lit(a), F.lit(b))
    return label


def replay_times(ttft: Column, e2e: Column) -> tuple[Column, Column]:
    """Times that a replay can show: at least 0.6 s in all, the first text at least 0.1 s before the end."""
    end = F.greatest(F.coalesce(e2e, F.lit(0.0)), F.lit(0.6))
    return F.least(F.coalesce(ttft, end * 0.3), end - 0.1), end


def replay_events(answers: DataFrame, race: str, lane: str, dedicated: str) -> DataFrame:
    """race, at (place from 1), t, lane and type of the events that replay each race's answers at their measured times.

    answers: race, lane, dedicated, ttft_s, e2e_s, code; one for each race and lane. Events of one time keep the
    lanes' order (dedicated ones first, then by name) and their own.
    """
    end = F.greatest(F.coalesce(F.nullif("e2e_s", F.lit(0.0)), F.lit(1.0)), F.lit(0.6))
    first = F.round(F.least(F.coalesce(F.nullif("ttft_s", F.lit(0.0)), F.lit(0.5)), end - 0.1), 3)
    event = lambda no, t, kind: F.struct(F.lit(no).alias("no"), t.alias("t"), F.lit(kind).alias("type"))
    made = F.array(event(1, first, "reasoning"), event(2, first, "status"), F.when(F.coalesce("code", F.lit("")) != "", event(3, F.round(end, 3), "content")), event(4, F.round(end, 3), "generated"), event(5, F.round(end + 0.4, 3), "graded"))
    told = answers.select(race, lane, (~F.col(dedicated)).alias("_other"), F.explode(F.array_compact(made)).alias("e"))
    target = answers.select(race).distinct().select(race, F.lit(None).cast("string").alias(lane), F.lit(False).alias("_other"), event(0, F.lit(0.0), "target").alias("e"))
    both = told.select(race, lane, "_other", "e.*").unionByName(target.select(race, lane, "_other", "e.*"))
    # a race has six rows a lane at most
    order = Window.partitionBy(race).orderBy("t", F.expr("no > 0"), "_other", lane, "no")
    return both.withColumn("at", F.row_number().over(order)).select(race, "at", "t", lane, "type")


def replay_speed(df: DataFrame, keys: list[str], e2e: str, seconds: float = 9.0) -> DataFrame:
    """df with speed: a factor of at most 1 that brings each race's slowest lane to the given length."""
    slowest = F.max(e2e).over(Window.partitionBy(*keys))
    return df.withColumn("speed", F.least(F.lit(1.0), F.when(slowest > 0, seconds / slowest).otherwise(1.0)))


def backoff(attempt: Column, draw: Column, most: float = 30.0) -> Column:
    return F.least(F.lit(most), F.pow(F.lit(2.0), attempt) + draw)


def progress(done: Column, total: Column, steps: Column) -> tuple[Column, Column]:
    """Seconds for a step and seconds left, from the elapsed seconds so far."""
    per_step = done / F.when(steps > 0, steps)
    return per_step, per_step * (total - steps)


def saved_answers(answers: DataFrame, tags: list[str]) -> DataFrame:
    """The answer of each lane and part from the last of the tags that has one."""
    at = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    ranked = answers.withColumn("_at", at).where("_at > 0")
    rest = [c for c in answers.columns if c not in ("lane", "id")]
    return ranked.groupBy("lane", "id").agg(F.max(F.struct("_at", *rest)).alias("_r")).select("lane", "id", *[F.col(f"_r.{c}") for c in rest])


def cached(spark, path: str, job: str, make, schema: str) -> DataFrame:
    """The saved rows if they are of this job, else what make() gives."""
    from ..sources.readers import jsonl

    saved = jsonl(spark, path, f"job string, {schema}").where(F.col("job") == job).drop("job")
    return make() if saved.isEmpty() else saved
