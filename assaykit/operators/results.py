"""Results of runs: failures, tiers, newest-wins, best-of-N, common parts, lane summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

SUCCESS_IOU, STRICT_IOU = 0.9, 0.95  # fixed values
NO_CODE = "no candidate produced code"  # fixed value


def infra_failed(error: Column, output_tokens: Column) -> Column:
    """No output, and an error of the service or no candidate with code."""
    said = F.coalesce(error, F.lit(""))
    return (F.coalesce(output_tokens, F.lit(0)) == 0) & (said.startswith("api:") | (said == NO_CODE))


def succeeded(runs: Column, iou_aligned: Column, least: float = SUCCESS_IOU) -> Column:
    return F.coalesce(runs, F.lit(False)) & (F.coalesce(iou_aligned, F.lit(0.0)) >= least)


def tiers(n_faces: Column, n_parts: Column | None = None) -> Column:
    """All tiers a part is in, which may overlap; missing faces count as 0."""
    faces = F.coalesce(n_faces, F.lit(0))
    named = [("all", F.lit(True)), ("simple", faces <= 6), ("medium", (faces > 6) & (faces <= 12)), ("complex", faces >= 13)]
    if n_parts is not None:
        named.append(("multi", n_parts > 1))
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))


def exclusive_tier(n_faces: Column, n_parts: Column) -> Column:
    faces = F.coalesce(n_faces, F.lit(0))
    return F.when(n_parts > 1, "multi").when(faces <= 6, "simple").when(faces <= 12, "medium").otherwise("complex")


def example_tiers(n_faces: Column, n_parts: Column) -> Column:
    """Simple and medium need a single part; complex is 13 faces or more, or several parts."""
    single = n_parts == 1
    named = [("simple", single & (n_faces <= 6)), ("medium", single & (n_faces > 6) & (n_faces <= 12)), ("complex", (n_faces >= 13) | (n_parts > 1))]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))


def is_hard(n_faces: Column, n_parts: Column, faces: int = 7) -> Column:
    return (F.coalesce(n_faces, F.lit(0)) >= faces) | (F.coalesce(n_parts, F.lit(1)) > 1)


def newest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order. One partial aggregate: each task sends one row for a key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def best_of(df: DataFrame, keys: list[str], score: str, index: list[str]) -> DataFrame:
    """The row with the highest score of each key, missing as 0, the first by index among equals."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min(F.struct((-F.coalesce(F.col(score), F.lit(0.0))).alias("_s"), *[F.col(c).alias(f"_i{k}") for k, c in enumerate(index)], F.struct(*rest).alias("_row"))).alias("_r"))
    return picked.select(*keys, "_r._row.*").select(*df.columns)


def common_items(df: DataFrame, item: str, lane: str, lanes: DataFrame | None = None) -> DataFrame:
    """The rows whose item every lane has (of the lanes in `lanes`, if given)."""
    pairs = df.select(item, lane).distinct()
    if lanes is not None:
        pairs = pairs.join(lanes, lane, "left_semi")
    total = pairs.select(lane).distinct().agg(F.count("*").alias("_total"))
    whole = pairs.groupBy(item).agg(F.count("*").alias("_n")).join(F.broadcast(total)).where("_n = _total").select(item)  # total is one row
    return df.join(whole, item, "left_semi")


def relabel(results: DataFrame, parts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The labels of parts override those of the results; a part that isn't there leaves them.

    A null in parts overrides too: only a missing row falls back.
    """
    new = parts.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = results.join(new, key, "left")
    return joined.select(*[F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in results.columns])


def lane_summary(df: DataFrame, lane: list[str]) -> DataFrame:
    """One row for each lane from results (error, output_tokens, runs, success, iou_aligned, chamfer,
    n_parts, e2e_s, ttft_s, attempts, cost_usd, oracle_iou); failed calls are only counted.

    Percentiles are ranked over many tasks, so a lane may hold any share of the rows.
    """
    failed = infra_failed(F.col("error"), F.col("output_tokens"))
    live = df.withColumn("_failed", failed)
    ok = ~F.col("_failed")
    kept = lambda c: F.when(ok, F.col(c))
    ran = ok & F.coalesce("runs", F.lit(False))
    rate = lambda cond, part=ok: F.avg(F.when(part, F.coalesce(cond, F.lit(False)).cast("double")))
    n = F.count_if(ok)
    low, high = stats.wilson(F.count_if(ok & F.col("success")), F.when(n > 0, n))
    rates = live.groupBy(*lane).agg(
        n.alias("n"),
        F.count_if("_failed").alias("n_infra_failed"),
        rate(F.col("success")).alias("success"),
        low.alias("success_low"),
        high.alias("success_high"),
        rate(succeeded(F.col("runs"), F.col("iou_aligned"), STRICT_IOU)).alias("success_iou95"),
        rate(F.col("runs")).alias("run_rate"),
        stats.zero_filled_mean(kept("iou_aligned"), F.when(ok, F.coalesce("runs", F.lit(False)))).alias("mean_iou_aligned"),
        F.struct(F.count_if(ok & (F.col("n_parts") == 1)).alias("n"), rate(F.col("success"), ok & (F.col("n_parts") == 1)).alias("success")).alias("single_part"),
        F.struct(F.count_if(ok & (F.col("n_parts") > 1)).alias("n"), rate(F.col("success"), ok & (F.col("n_parts") > 1)).alias("success")).alias("multi_part"),
        F.avg(kept("output_tokens")).alias("output_tokens_mean"),
        F.avg(kept("attempts")).alias("attempts_mean"),
        F.avg(F.when(ok, (F.coalesce("oracle_iou", F.lit(0.0)) >= SUCCESS_IOU).cast("double"))).alias("oracle_success"),
        (F.avg(kept("cost_usd")) * 1000).alias("cost_per_1k_usd"),
    )
    values = {"chamfer": F.when(ran, F.col("chamfer")), "e2e_s": kept("e2e_s"), "ttft_s": kept("ttft_s")}
    qs = {"median_chamfer": ("chamfer", 0.5), "latency_p50": ("e2e_s", 0.5), "latency_p95": ("e2e_s", 0.95), "ttft_p50": ("ttft_s", 0.5)}
    return _beside(rates, stats.linear_percentiles(live, lane, values, qs), lane)


def _beside(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """df with the further columns of more, which has a row for each key at most; null keys are equal."""
    named = more.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(named, same, "left").drop(*[f"_k_{k}" for k in keys])


def tiered_rates(df: DataFrame, keys: list[str], tier: Column, success: Column) -> DataFrame:
    """keys, tier, n, success and its interval; a row counts in each tier of the array `tier`."""
    n, k = F.count("*"), F.count_if(success)
    low, high = stats.wilson(k, n)
    return df.select(*keys, success.alias("_ok"), F.explode(tier).alias("tier")).groupBy(*keys, "tier").agg(n.alias("n"), stats.share(F.col("_ok")).alias("success"), *[x.alias(a) for x, a in zip(stats.wilson(F.count_if("_ok"), F.count("*")), ("low", "high"))])


def pooled_board(results: DataFrame, parts: DataFrame, key: list[str], common: bool = False) -> DataFrame:
    """The leaderboard: newest answer for each part, current labels, tiers, index percentiles.

    results: key columns, id, created, run, runs, success, e2e_s, n_parts, n_faces, error, output_tokens.
    """
    live = results.where(~infra_failed(F.col("error"), F.col("output_tokens")))
    rows = relabel(newest_wins(live, [*key, "id"], ["created", "run"]), parts, "id", ["n_parts", "n_faces"])
    if common:
        rows = common_items(rows.withColumn("_lane", F.to_json(F.struct(*key))), "id", "_lane").drop("_lane")
    rates = tiered_rates(rows, key, tiers(F.col("n_faces"), F.col("n_parts")), F.col("success"))
    wide = rates.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("tier", F.struct("n", "success", "low", "high")))).alias("tiers"))
    return wide.join(stats.index_percentile(rows, key, "e2e_s", {"latency_p50": 0.5, "latency_p95": 0.95}), key, "left")


def run_cost(per_run: DataFrame, key: list[str]) -> DataFrame:
    """Cost per 1k over runs, weighted by the rows each run gave; runs without a cost take no part."""
    return per_run.groupBy(*key).agg(stats.weighted_mean(F.col("cost_per_1k_usd"), F.col("n")).alias("cost_per_1k_usd"))


def amortized_cost(hourly_usd: Column, wall_s: Column, n: Column) -> Column:
    """Dollars per 1,000 answers of a machine that is paid by the hour."""
    return hourly_usd / 3600 * wall_s / F.when(n > 0, n) * 1000


def token_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with cost_usd: prices (model, input, cached, output per million); null for unknown models."""
    known = calls.join(prices, "model", "left")
    fresh = F.greatest(F.col("prompt_tokens") - F.col("cached_tokens"), F.lit(0))
    cost = (fresh * F.col("input") + F.col("cached_tokens") * F.col("cached") + F.col("output_tokens") * F.col("output")) / 1e6
    return known.withColumn("cost_usd", cost).select(*calls.columns, "cost_usd")


def tokens_per_second(output_tokens: Column, e2e_s: Column, ttft_s: Column) -> Column:
    return F.when(e2e_s > ttft_s, output_tokens / F.when(e2e_s > ttft_s, e2e_s - ttft_s))


def newest_metadata(rows: DataFrame, runs: DataFrame, group: list[str], run: str = "run") -> DataFrame:
    """group and the columns of runs (run, group and what is told of both) from the last run that answered for the group."""
    last = rows.where(~infra_failed(F.col("error"), F.col("output_tokens"))).groupBy(*group).agg(F.max(run).alias(run))
    return runs.join(last, [*group, run])


def latest_run(runs: DataFrame, tag: str, name: str) -> DataFrame:
    """The last name of each tag."""
    return runs.groupBy(tag).agg(F.max(name).alias(name))


def quantified(df: DataFrame, item: str, lane: str, success: str, ours: list[str], least_others: int = 2) -> DataFrame:
    """item, n_others, ours_ok, all_others_ok, any_other_ok for items with enough other answers."""
    mine = F.col(lane).isin(ours)
    return df.groupBy(item).agg(
        F.count_if(~mine).alias("n_others"),
        F.coalesce(F.bool_or(F.when(mine, F.col(success))), F.lit(False)).alias("ours_ok"),
        F.bool_and(F.when(~mine, F.col(success))).alias("all_others_ok"),
        F.bool_or(F.when(~mine, F.col(success))).alias("any_other_ok"),
    ).where(F.col("n_others") >= least_others)


def demo_picks(told: DataFrame, item: str, faces: str, wins: int = 6) -> DataFrame:
    """section, place, item, faces: what only ours gets right (middling sizes first), one easy part that all get
    right and one that ours misses. told: item, ours_ok, all_others_ok, any_other_ok of quantified(), and faces."""
    size = F.coalesce(faces, F.lit(0))
    sections = [
        ("win", F.col("ours_ok") & ~F.col("any_other_ok"), [size <= 6, F.abs(size - 14), F.col(item)], wins),
        ("easy", F.col("ours_ok") & F.col("all_others_ok") & (size <= 6), [F.col(item)], 1),
        ("miss", ~F.col("ours_ok") & F.col("any_other_ok"), [F.col(item)], 1),
    ]
    out = []
    for name, test, order, most in sections:
        top = told.where(test).orderBy(*order).limit(most)  # few rows, which one window can number
        out.append(top.select(F.lit(name).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("place"), item, faces))
    return reduce(DataFrame.unionByName, out)


def _sums(order: list[str], parallel: str) -> list[Column]:
    """Aggregates over the calls of a result row: times, tokens and cost."""
    return [
        F.min_by("ttft_s", F.struct(*order)).alias("ttft_s"),
        F.when(F.bool_or(parallel), F.max("e2e_s")).otherwise(F.sum("e2e_s")).alias("e2e_s"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("reasoning_chars").alias("reasoning_chars"),
        stats.sum_or_null(F.col("cost_usd")).alias("cost_usd"),
    ]


def result_rows(calls: DataFrame, keys: list[str], order: list[str], parallel: str) -> DataFrame:
    """One row for each key from its calls: samples in parallel take as long as the slowest, attempts one after another add up.

    The first call tells the first-text time; a missing price makes the cost unknown.
    """
    return calls.groupBy(*keys).agg(F.bool_or(parallel).alias(parallel), F.count("*").alias("n_calls"), *_sums(order, parallel))


def whole_rows(calls: DataFrame, parts: DataFrame, lanes: DataFrame) -> DataFrame:
    """One whole result row for each part and lane: identity, the grade that counts, latencies, sums and best-of fields.

    calls: id, lane, no, parallel, runs, iou, iou_aligned, chamfer, error, code, ttft_s, e2e_s, output_tokens, reasoning_chars,
    cost_usd; nos are distinct within a part and lane. parts: id, n_parts, n_faces. lanes: lane, model. Attempts one after another are graded by the last;
    samples in parallel by the one with the highest likeness, the first of equals, and they are one attempt. Rows without their part or lane are left out.

    One aggregate takes all; lanes, a small dimension, is broadcast, since a shuffle by lane would send all rows of a lane to one task.
    """
    keys, grade = ["id", "lane"], ["runs", "iou", "iou_aligned", "chamfer", "error", "code"]
    iou, together = F.coalesce("iou_aligned", F.lit(0.0)), F.bool_or("parallel")
    known = F.broadcast(lanes.select("lane", "model"))
    graded = calls.join(known, "lane", "left_semi").groupBy(*keys).agg(
        F.max_by(F.struct(*grade), F.struct(F.when(F.col("parallel"), iou).otherwise(0.0), F.when(F.col("parallel"), -F.col("no")).otherwise(F.col("no")))).alias("_g"),
        F.when(together, 1).otherwise(F.count("*")).cast("long").alias("attempts"),
        F.when(together, F.count("*")).alias("samples"),
        F.when(together, F.count_if("runs")).alias("samples_run"),
        F.max(F.when(F.coalesce("runs", F.lit(False)), iou).otherwise(0.0)).alias("oracle_iou"),
        *_sums(["no"], "parallel"),
    )
    rows = graded.join(parts.select("id", "n_parts", "n_faces"), "id").join(known, "lane")
    rest = [c for c in graded.columns if c not in (*keys, "_g")]
    runs = F.coalesce("runs", F.lit(False))
    return rows.select("lane", "id", "_g.*", *rest, "n_parts", "n_faces", "model").withColumns({"runs": runs, "success": succeeded(runs, F.col("iou_aligned"))})


def pooled_rows(rows: DataFrame, summaries: DataFrame, parts: DataFrame, group: list[str]) -> DataFrame:
    """The newest row of each part and group, with its run's summary of the lane and the parts' labels of today.

    rows: group, id, run, created, error, output_tokens, n_parts, n_faces. summaries: run and lane, with further columns, which come in as
    `run_` ones; a row without its lane's summary is left out, as is a failed call.
    """
    rest = [c for c in summaries.columns if c not in ("run", "lane")]
    live = rows.where(~infra_failed(F.col("error"), F.col("output_tokens")))
    joined = live.join(summaries.select("run", "lane", *[F.col(c).alias(f"run_{c}") for c in rest]), ["run", "lane"])
    return relabel(newest_wins(joined, [*group, "id"], ["created", "run"]), parts, "id", ["n_parts", "n_faces"])


def chart_lanes(board: DataFrame, modality: str, lane: str, ours: list[str], skip: list[str] = (), least: int = 100) -> DataFrame:
    """The board's lanes of a modality (text if it has none) with enough rows, without those to skip; place: ours first, then by success.

    A board has a row for each lane, so one window numbers it.
    """
    kept = board.where((F.coalesce("modality", F.lit("text")) == modality) & ~F.col(lane).isin(list(skip)) & (F.col("n") >= least))
    return kept.withColumn("place", F.row_number().over(Window.orderBy(~F.col(lane).isin(ours), F.desc(F.coalesce("success", F.lit(0.0))), lane)))


def report_rows(df: DataFrame, least: int = 300, n: str = "n_clean") -> DataFrame:
    """The rows of a report that rest on more than `least` clean answers."""
    return df.where(F.col(n) > least)


def learning_points(df: DataFrame, run: str, success: Column, base: int = 0, final: tuple[str, int] | None = None) -> DataFrame:
    """step, n and success of the runs of a training, in order: `…_ckpt<step>-img`, the base run as step `base`, and the final run (its tag, its step)."""
    said = F.regexp_extract(run, r"_ckpt(\d+)-img$", 1)
    step = F.when(said != "", F.nullif(said, F.lit("")).cast("int")).when(F.col(run).endswith("_base"), base)
    if final:
        step = step.when(F.col(run).endswith(f"_{final[0]}"), final[1])
    return df.withColumn("step", step).where("step is not null").groupBy("step").agg(F.count("*").alias("n"), stats.share(success).alias("success")).orderBy("step")


def imported_summary(df: DataFrame, lane: list[str]) -> DataFrame:
    """Rates of an evaluation that was made elsewhere: every row counts, and a missing likeness is 0 whether or not the program ran."""
    iou = F.coalesce("iou_aligned", F.lit(0.0))
    ok = succeeded(F.col("runs"), F.col("iou_aligned"))
    return df.groupBy(*lane).agg(
        F.count("*").alias("n"),
        stats.share(ok).alias("success"),
        stats.share(iou >= STRICT_IOU).alias("success_iou95"),
        stats.share(F.col("runs")).alias("run_rate"),
        F.avg(iou).alias("mean_iou_aligned"),
        F.count_if(F.col("n_parts") == 1).alias("n_single"),
        F.count_if(F.col("n_parts") > 1).alias("n_multi"),
    )


def reconcile(published: DataFrame, source: DataFrame, keys: list[str], exact: list[str], near: list[str], tolerance: float = 1e-9) -> DataFrame:
    """keys and status: same, missing, or the first column that differs; texts are compared trimmed."""
    other = source.select(*keys, F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in exact + near])
    joined = published.join(other, keys, "left")
    status = F.lit("same")
    for c in reversed(near):
        same = F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) < tolerance, F.col(c).isNull() & F.col(f"_{c}").isNull())
        status = F.when(~same, c).otherwise(status)
    for c in reversed(exact):
        status = F.when(~F.trim(F.col(c).cast("string")).eqNullSafe(F.trim(F.col(f"_{c}").cast("string"))), c).otherwise(status)
    return joined.select(*keys, F.when(F.col("_there").isNull(), "missing").otherwise(status).alias("status"))


def resolve_lanes(spec: DataFrame, known: DataFrame, pretty: DataFrame) -> DataFrame:
    """Lanes of a text `slug:effort,…` (column spec): known ones by key, others from their slug; the rest is skipped.

    known: key, label, model, effort. pretty: model, name.
    """
    items = spec.select(F.posexplode(F.split("spec", ",")).alias("pos", "item")).select("pos", F.trim("item").alias("item")).where("item <> ''")
    slug, effort = F.split_part("item", F.lit(":"), F.lit(1)), F.nullif(F.split_part("item", F.lit(":"), F.lit(2)), F.lit(""))
    last = F.element_at(F.split(slug, "/"), -1)
    joined = items.withColumn("slug", slug).withColumn("asked", effort).withColumn("last", last).join(known.withColumn("_k", F.lit(True)), F.col("item") == F.col("key"), "left").join(pretty.withColumnRenamed("model", "_m"), F.col("slug") == F.col("_m"), "left")
    new_key = F.concat(F.lower("last"), F.coalesce(F.concat(F.lit("@"), "asked"), F.lit("")))
    new_label = F.concat(F.coalesce("name", "last"), F.coalesce(F.concat(F.lit(" ("), "asked", F.lit(")")), F.lit("")))
    out = joined.where(F.col("_k") | F.col("slug").contains("/"))
    pick = lambda old, new: F.when(F.col("_k"), F.col(old)).otherwise(new)
    return out.select("pos", pick("key", new_key).alias("key"), pick("label", new_label).alias("label"), pick("model", F.col("slug")).alias("model"), pick("effort", F.col("asked")).alias("effort"))


def repeat_last(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """As-of form: the last known value of each key up to each row, by the columns after keys."""
    rest = [c for c in df.columns if c not in (*keys, value)]
    w = Window.partitionBy(*keys).orderBy(*rest).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))
