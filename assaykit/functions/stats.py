"""Statistics over groups: three percentiles, rates, intervals, AUC, bootstrap."""

from __future__ import annotations

import math
import random
import tempfile
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DRAWS = 1 << 16  # of a resample at a time
RANGE_ROWS = 250_000  # rows of a range of values, which one task ranks
Z95 = 1.959963984540054  # fixed value: the two-sided 95 % quantile of the normal distribution


def share(condition: Column) -> Column:
    """Mean of a boolean; null counts as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def share_where(condition: Column, part: Column) -> Column:
    """Share of condition within part; null if the part is empty."""
    return F.avg(F.when(part, F.coalesce(condition, F.lit(False)).cast("double")))


def zero_filled_mean(value: Column, ran: Column) -> Column:
    """Rows that didn't run, and missing values, count as 0; rows with a null in ran don't count."""
    return F.avg(F.when(ran, F.coalesce(value, F.lit(0.0))).when(~ran, F.lit(0.0)))


def sum_or_null(value: Column) -> Column:
    """Null if any value is missing, unlike sum."""
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Rows without a value take no part, nor does their weight; null if no weight is left."""
    left = F.sum(F.when(value.isNotNull(), weight))
    return F.when(left != 0, F.sum(value * weight) / left)


def linear_percentile(value: Column, q: float) -> Column:
    """Interpolated between the two nearest ranks; nulls dropped. For groups that fit into one buffer; linear_percentiles takes any."""
    return F.percentile(value, F.lit(q))


def settled(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster can't."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not place and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="assaykit-checkpoint-"))
    return df.checkpoint(eager=True)


def in_ranges(df: DataFrame, value: str) -> DataFrame:
    """df with _range: which of some ranges of about RANGE_ROWS rows the value is in; as many as the rows ask for.

    df should be settled, since it is counted and its quantiles are taken. The ends are fixed numbers, so every reader sees the same ranges.
    """
    n = math.ceil(df.count() / RANGE_ROWS)
    if n <= 1:
        return df.withColumn("_range", F.lit(0.0))
    ends = df.agg(F.percentile_approx(F.col(value).cast("double"), [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0]
    splits = sorted({x for x in ends or [] if math.isfinite(x)})
    if not splits:
        return df.withColumn("_range", F.lit(0.0))
    double = df.withColumn("_as_double", F.col(value).cast("double"))
    return Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="_as_double", outputCol="_range", handleInvalid="keep").transform(double).drop("_as_double")


def same_keys(keys: list[str], prefix: str) -> Column:
    """Keys equal those of another side that have the prefix; nulls are equal."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys], F.lit(True))


def running(df: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """df with _before_x for each x in sums: its sum over the key's rows of smaller values, which have to be distinct.

    A key's rows are spread over ranges of the value; sums run within a range, and are offset by those
    of the ranges before it, a table with a row for each key and range. df is settled first and read three times.
    """
    ranged = in_ranges(settled(df), value)
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_at")).agg(*[F.sum(x).alias(f"_sum_{x}") for x in sums])
    offsets = sizes.select(*[f"_{k}" for k in keys], "_at", *[F.coalesce(F.sum(f"_sum_{x}").over(earlier), F.lit(0)).alias(f"_off_{x}") for x in sums])
    local = ranged.withColumns({f"_loc_{x}": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums})
    return local.join(offsets, same_keys(keys, "_") & (F.col("_range") == F.col("_at"))).select(*df.columns, *[(F.col(f"_loc_{x}") + F.col(f"_off_{x}")).alias(f"_before_{x}") for x in sums])


def _places(df: DataFrame, keys: list[str], values: dict[str, Column], places: dict[str, tuple[str, Column]]) -> DataFrame:
    """keys, and for each name in places the element at an index of one of the values, sorted, and that value's number of rows, n_<value>.

    values: columns, null where a row takes no part. places: the value's name and the index in terms of _n, its rows.
    Equal values are counted once for all; a histogram by key and range tells which ranges hold the
    indexes, and only these are ranked.
    """
    names = list(values)
    each = F.array(*[F.struct(F.lit(k).alias("_w"), v.alias("_v")) for k, v in enumerate(values.values())])
    counts = settled(df.select(*keys, F.inline(each)).where(F.col("_v").isNotNull()).groupBy(*keys, "_w", "_v").agg(F.count("*").alias("_c")))
    ranged = in_ranges(counts, "_v") if len(names) == 1 else reduce(DataFrame.unionByName, [in_ranges(counts.where(F.col("_w") == k), "_v") for k in range(len(names))])
    group = [*keys, "_w"]
    steps = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bars = ranged.groupBy(*group, "_range").agg(F.sum("_c").alias("_s")).withColumn("_off", F.coalesce(F.sum("_s").over(steps), F.lit(0))).withColumn("_n", F.sum("_s").over(Window.partitionBy(*group)))
    asked = F.array(*[F.struct(F.lit(name).alias("_name"), F.lit(names.index(value)).alias("_of"), at.cast("long").alias("_at")) for name, (value, at) in places.items()])
    targets = bars.select("*", F.inline(asked)).where("_of = _w and _at >= _off and _at < _off + _s")
    targets = targets.select(*[F.col(c).alias(f"_t_{c}") for c in [*group, "_range"]], "_name", "_at", "_off", "_n")
    on = same_keys([*group, "_range"], "_t_")
    inside = Window.partitionBy(*group, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.join(targets, on, "left_semi").withColumn("_loc", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    found = local.join(targets, on).where("_at >= _off + _loc and _at < _off + _loc + _c")
    pick = lambda name: F.max(F.when(F.col("_name") == name, F.col("_v")))
    return found.groupBy(*keys).agg(*[pick(name).alias(name) for name in places], *[F.max(F.when(F.col("_w") == k, F.col("_n"))).alias(f"n_{v}") for k, v in enumerate(names)])


def index_percentile(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """keys and, for each name in qs, the element at index min(n-1, floor(q*n)) of the sorted values."""
    at = lambda q: F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))
    return _places(df, keys, {value: F.col(value)}, {name: (value, at(q)) for name, q in qs.items()}).select(*keys, *qs)


def linear_percentiles(df: DataFrame, keys: list[str], values: dict[str, Column], qs: dict[str, tuple[str, float]]) -> DataFrame:
    """keys and, for each name in qs, a percentile of one of the values between the two nearest ranks, for groups of any size.

    values: columns, null where a row takes no part. All percentiles come from one count of the values.
    """
    places = {f"{f}_{name}": (value, g(F.lit(q) * (F.col("_n") - 1))) for name, (value, q) in qs.items() for f, g in (("_low", F.floor), ("_high", F.ceil))}
    found = _places(df, keys, values, places)

    def between(name: str, value: str, q: float) -> Column:
        place = F.lit(q) * (F.col(f"n_{value}") - 1)
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return found.select(*keys, *[between(name, value, q) for name, (value, q) in qs.items()])


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Closed-form 95 % interval of a share."""
    p = successes / n
    middle, spread = p + Z95 * Z95 / (2 * n), Z95 * F.sqrt(p * (1 - p) / n + Z95 * Z95 / (4 * n * n))
    return (middle - spread) / (1 + Z95 * Z95 / n), (middle + spread) / (1 + Z95 * Z95 / n)


def resampled_sums(xs: np.ndarray, iters: int, seed: int) -> Iterator[float]:
    """The sum of each of iters resamples of xs, as by sum(random.Random(seed).choices(xs, k=len(xs))).

    A choice is the element at floor(random() * n). numpy's generator of the same kind gives the same numbers from the same
    state, DRAWS at a time. Whole numbers add up alike in any order; others are added one by one, as sum does.
    """
    *words, at = random.Random(seed).getstate()[1]
    rng, n = np.random.RandomState(), len(xs)
    rng.set_state(("MT19937", np.array(words, np.uint32), at))
    flags = bool(np.isin(xs, (0.0, 1.0)).all())
    whole = bool(np.isfinite(xs).all() and (xs == np.floor(xs)).all() and np.abs(xs).max() * n <= 2**53)
    known = xs.astype(bool) if flags else xs  # a byte for each
    for _ in range(iters):
        drawn = (known[(rng.random_sample(min(DRAWS, n - k)) * n).astype(np.int64)] for k in range(0, n, DRAWS))
        if flags:
            yield float(sum(np.count_nonzero(x) for x in drawn))
        elif whole:
            yield float(sum(x.sum() for x in drawn))
        else:
            yield sum(chain.from_iterable(x.tolist() for x in drawn))


def bootstrap(df: DataFrame, keys: list[str], value: str, order: str, iters: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """keys, lo, hi: percentile interval of the mean over seeded resamples.

    The draws depend on the order of the rows, so `order` fixes it. Each group is one task's, since a resample begins where the
    generator's last one ended; for unbounded groups use split_bootstrap, or binomial_bootstrap for 0/1 values.
    """

    def interval(group: pd.DataFrame) -> pd.DataFrame:
        xs = group.sort_values(order)[value].to_numpy(float)
        means = sorted(x / len(xs) for x in resampled_sums(xs, iters, seed))
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "lo": [means[int(iters * alpha / 2)]], "hi": [means[int(iters * (1 - alpha / 2)) - 1]]})

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, value, order).groupBy(*keys).applyInPandas(interval, f"{kinds}, lo double, hi double")


def binomial_bootstrap(df: DataFrame, keys: list[str], success: Column, iters: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """The same interval for 0/1 values from counts alone: a resample's sum is binomial. Any group is two numbers."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(success).alias("k"))

    @F.pandas_udf("struct<lo:double,hi:double>")
    def interval(n: pd.Series, k: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(n, k):
            means = np.sort(np.random.default_rng(seed).binomial(a, b / a, iters) / a)
            rows.append((means[int(iters * alpha / 2)], means[int(iters * (1 - alpha / 2)) - 1]))
        return pd.DataFrame(rows, columns=["lo", "hi"])

    return counts.withColumn("_ci", interval("n", "k")).select(*keys, "n", "k", "_ci.lo", "_ci.hi")


def split_bootstrap(df: DataFrame, keys: list[str], value: str, iters: int = 2000, alpha: float = 0.05, seed: int = 0, most: int = 1_000) -> DataFrame:
    """keys, n, lo, hi: percentile interval of the mean over resamples, for groups of any size.

    A resample of n rows is a multinomial draw of how often each row is taken. Equal values are
    counted first. Values are then spread over blocks by a hash, of which the number is a power of two. A
    block walks down the binary tree of hash bits: at each node a seeded binomial draw, the
    same for all that pass it, says how many rows of each resample lie to the left. So blocks agree without
    seeing each other. Within its block, a task draws how often each value is taken, and sums them.
    The ends differ from those of any other draw of as many resamples by chance alone, a standard deviation of
    0.06 standard errors of the mean for 2,000 and 95 %.

    No task holds more than about `most` different values or some numbers for each resample.
    """
    names = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    counts = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    largest = counts.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, largest / most))))
    code = F.shiftrightunsigned(F.xxhash64("_v"), 64 - depth) if depth else F.lit(0)
    blocks = counts.withColumn("_b", code.cast("long"))
    # rows of each node of the tree; level l has the first l bits of the hash
    nodes = blocks.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    each = nodes.select(*keys, "_b", "_n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("_l"))
    sizes = each.groupBy(*keys, "_l", F.expr(f"shiftright(_b, {depth} - _l)").alias("_p")).agg(F.sum("_n").alias("_n"))
    # of each block's way down: a node's rows and those of its left child
    way = each.where(F.col("_l") < depth).select(*keys, "_b", "_l", F.expr(f"shiftright(_b, {depth} - _l)").alias("_p"), F.expr(f"shiftright(_b, {depth} - _l - 1)").alias("_to"))
    rows = lambda n: sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_l").alias("_m"), F.col("_p").alias("_q"), F.col("_n").alias(n))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))
    whole = way.join(rows("_n"), same & (F.col("_m") == F.col("_l")) & (F.col("_q") == F.col("_p"))).select(*way.columns, "_n")
    left = whole.join(rows("_left"), same & (F.col("_m") == F.col("_l") + 1) & (F.col("_q") == F.col("_p") * 2), "left")
    path = left.select(*keys, "_b", "_l", "_to", "_n", F.coalesce("_left", F.lit(0)).alias("_left"))
    total = sizes.where("_l = 0").select(*keys, F.col("_n").alias("_total"))

    def drawn(group: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        first = way[way["_l"] == -1].iloc[0]
        taken = np.full(iters, int(first["_n"]))
        name = [str(first[k]) for k in keys]
        for r in way[way["_l"] >= 0].sort_values("_l").itertuples(index=False):
            level, to, n, at_left = (int(x) for x in r[-4:])
            rng = np.random.default_rng([seed, zlib.crc32("\x1f".join(name).encode()), level, to >> 1])
            lefts = rng.binomial(taken, at_left / n)
            taken = taken - lefts if to & 1 else lefts
        rng = np.random.default_rng([seed, zlib.crc32("\x1f".join(name).encode()), 63, int(first["_to"])])
        group = group.sort_values("_v")
        sums = rng.multinomial(taken, group["_c"] / group["_c"].sum()) @ group["_v"].to_numpy()
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "_sums": [sums.tolist()]})

    ends = nodes.join(total.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_total"), same).select(*keys, "_b", F.lit(-1).alias("_l"), F.col("_b").alias("_to"), F.col("_total").alias("_n"), F.lit(0).cast("long").alias("_left"))
    steps = path.unionByName(ends)
    steps = steps.toDF(*steps.columns)  # columns of its own, which the other side doesn't share
    sums = blocks.groupBy(*keys, "_b").cogroup(steps.groupBy(*keys, "_b")).applyInPandas(drawn, f"{names}, _sums array<double>")
    means = sums.select(*keys, F.posexplode("_sums").alias("_i", "_s")).groupBy(*keys, "_i").agg(F.sum("_s").alias("_s"))
    sorted_sums = means.groupBy(*keys).agg(F.sort_array(F.collect_list("_s")).alias("_s"))  # iters numbers
    pick = lambda at: F.get("_s", F.lit(at)) / F.col("_total")
    out = sorted_sums.join(total.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_total"), same)
    return out.select(*keys, F.col("_total").alias("n"), pick(int(iters * alpha / 2)).alias("lo"), pick(int(iters * (1 - alpha / 2)) - 1).alias("hi"))


def auc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """keys, auc: the chance that a positive scores above a negative, ties at one half; NaN if a side is empty.

    Rows are folded to counts by score first; a running count of lower negatives does the rest.
    """
    counts = df.groupBy(*keys, score).agg(F.count_if(F.col(positive)).cast("double").alias("_p"), F.count_if(~F.col(positive)).cast("double").alias("_n"))
    wins = running(counts, keys, score, ["_n"]).withColumn("_w", F.col("_p") * (F.col("_before__n") + F.col("_n") / 2))
    pairs = F.sum("_p") * F.sum("_n")
    return wins.groupBy(*keys).agg(F.when(pairs > 0, F.sum("_w") / pairs).otherwise(F.lit(float("nan"))).alias("auc"))
