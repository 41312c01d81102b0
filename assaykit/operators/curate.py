"""Curation: audits, leakage-safe splits, deduplication, samples.

Random choices are orders by md5 of the id and a seed: the same on every engine and every
partitioning, and a row's place never depends on other rows.
"""

from __future__ import annotations

import math
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.stats import settled


def hash_order(item: Column, seed: int = 0) -> Column:
    return F.md5(F.concat(item.cast("string"), F.lit(f":{seed}")))


def passes_audit(runs: Column, dims_ok: Column) -> Column:
    """An unknown size check passes."""
    return F.coalesce(runs, F.lit(False)) & ~F.coalesce(~dims_ok, F.lit(False))


def audited(rows: DataFrame, audit: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """The kept columns of the rows that have an audit which they pass, with the audit's n_faces, extents and dims_ok."""
    found = audit.where(passes_audit(F.col("runs"), F.col("dims_ok"))).select(key, "n_faces", "extents", "dims_ok")
    return rows.select(*dict.fromkeys([key, *keep])).join(found, key)


def verified(n_parts: Column, dims_ok: Column) -> Column:
    return (n_parts == 1) & F.coalesce(dims_ok, F.lit(False))


def without(df: DataFrame, *others: tuple[DataFrame, str | list[str]]) -> DataFrame:
    """The rows that share none of the keys with the others; each key is an anti-join."""
    for other, on in others:
        df = df.join(other.select(on).distinct(), on, "left_anti")
    return df


def overlap_counts(a: DataFrame, b: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row: for each name, how many distinct values of the column a and b share."""
    out = None
    for name, column in columns.items():
        n = a.select(column.alias("v")).intersect(b.select(column.alias("v"))).agg(F.count("*").alias(name))
        out = n if out is None else out.join(F.broadcast(n))  # single rows
    return out


def running_in_hash_order(df: DataFrame, item: Column, seed: int, value: Column, by: list[str] = ()) -> DataFrame:
    """df with _before: the sum of value over the rows before, in hash order of item, within each `by`.

    The first three hex digits of the hash make 4,096 even buckets. Sums run within a bucket, and
    are offset by the sums of the buckets before it, a table of at most 4,096 rows for each `by`.
    """
    marked = df.withColumn("_h", hash_order(item, seed)).withColumn("_b", F.substring("_h", 1, 3)).withColumn("_v", value)
    inside = Window.partitionBy(*by, "_b").orderBy("_h", item).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy(*by, "_b").agg(F.sum("_v").alias("_size"))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    local = marked.withColumn("_local", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return local.join(F.broadcast(offsets), [*by, "_b"]).withColumn("_before", F.col("_local") + F.col("_offset")).drop("_h", "_b", "_v", "_local", "_offset")


def source_holdout(df: DataFrame, source: str, fraction: float, seed: int = 0) -> DataFrame:
    """df with held_out: whole sources, max(1, round(n*fraction)) of them in hash order, none if there is only one."""
    sources = df.select(source).distinct()
    n = sources.agg(F.count("*").alias("_n"))
    quota = F.when(F.col("_n") <= 1, 0).otherwise(F.greatest(F.lit(1), F.bround(F.col("_n") * fraction).cast("long")))
    ranked = running_in_hash_order(sources, F.col(source), seed, F.lit(1)).join(F.broadcast(n))  # n is one row
    chosen = ranked.where(F.col("_before") < quota).select(source).withColumn("held_out", F.lit(True))
    return df.join(chosen, source, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def with_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _rank from 1 in a total order: range partitions are sorted, and offset by the rows before them.

    The partitioning is settled first, so that both readers see the same ranges.
    """
    parts = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    local = parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    # one row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return local.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def cyclic_neighbours(df: DataFrame, group: str, key: str) -> DataFrame:
    """group, key, prev and next in the order of the keys, which are distinct; the ends of a group adjoin each other.

    Ranks over all groups tell the neighbours, by equality joins; so a group may span many tasks.
    """
    ranked = settled(with_rank(df.select(group, key), [group, key]))
    ends = ranked.groupBy(F.col(group).alias("_g")).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    side = lambda step, name: ranked.select((F.col("_rank") + step).alias("_rank"), F.col(group).alias(f"_g{name}"), F.col(key).alias(f"_{name}"))
    joined = ranked.join(side(1, "prev"), "_rank", "left").join(side(-1, "next"), "_rank", "left").join(ends, F.col(group).eqNullSafe(F.col("_g")))
    pick = lambda name, end: F.when(F.col(f"_{name}").isNotNull() & F.col(f"_g{name}").eqNullSafe(F.col(group)), F.col(f"_{name}")).otherwise(F.col(end)).alias(name)
    return joined.select(group, key, pick("prev", "_high"), pick("next", "_low"))


def group_prefix_fill(df: DataFrame, group: str, size: int, seed: int = 0) -> DataFrame:
    """Whole groups in hash order until at least size rows are taken."""
    counts = df.groupBy(group).agg(F.count("*").alias("_c"))
    taken = running_in_hash_order(counts, F.col(group), seed, F.col("_c")).where(F.col("_before") < size)
    return df.join(taken.select(group), group, "left_semi")


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, *order)]
    return df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(key, "_r.*").select(*df.columns)


def stratified_sample(df: DataFrame, item: str, stratum: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows with the file's share of the two strata (true and false), the first in hash order of each."""
    marked = df.withColumn("_s", F.coalesce(stratum, F.lit(False)))
    total = marked.agg(F.count("*").alias("_n"), F.count_if("_s").alias("_m"))
    ranked = running_in_hash_order(marked, F.col(item), seed, F.lit(1), ["_s"]).join(F.broadcast(total))  # total is one row
    yes = F.least(F.bround(F.lit(n) * F.col("_m") / F.col("_n")).cast("long"), F.col("_m"))
    quota = F.when(F.col("_n") <= n, F.col("_n")).when(F.col("_s"), yes).otherwise(F.lit(n) - yes)
    return ranked.where(F.col("_before") < quota).select(*df.columns)


def quota_sample(df: DataFrame, item: str, hard: Column, size: int, share: float, seed: int = 0) -> DataFrame:
    """floor(size*share) hard rows and easy ones up to size; a short stratum isn't filled from the other way round."""
    marked = df.withColumn("_s", F.coalesce(hard, F.lit(False)))
    total = marked.agg(F.count_if("_s").alias("_m"))
    ranked = running_in_hash_order(marked, F.col(item), seed, F.lit(1), ["_s"]).join(F.broadcast(total))  # total is one row
    k_hard = F.least(F.col("_m"), F.lit(int(size * share)))
    return ranked.where(F.col("_before") < F.when(F.col("_s"), k_hard).otherwise(F.lit(size) - k_hard)).select(*df.columns)


def seeded_sample(df: DataFrame, item: str, n: int, seed: int = 11) -> DataFrame:
    """The first n rows in hash order: each task sends its first n."""
    return df.orderBy(hash_order(F.col(item), seed), item).limit(n)


def shuffled(df: DataFrame, item: str, seed: int = 0) -> DataFrame:
    """df with place: its rows' places, from 1, in the hash order of item."""
    return running_in_hash_order(df, F.col(item), seed, F.lit(1)).withColumn("place", F.col("_before") + 1).drop("_before")


def bench_records(records: DataFrame, sheets: DataFrame | None = None, multi_only: bool = False, min_faces: int = 0, item: str = "id") -> DataFrame:
    """The records a run asks for: those with a sheet, of several parts, with faces enough (missing faces are none)."""
    if sheets is not None:
        records = records.join(sheets.select(item).distinct(), item, "left_semi")
    if multi_only:
        records = records.where("n_parts > 1")
    if min_faces:
        records = records.where(F.coalesce("n_faces", F.lit(0)) >= min_faces)
    return records


def provenance(df: DataFrame, split: str, splits: list[str], shares: dict[str, Column], of: str) -> DataFrame:
    """One row: total, the rows of each split (n_<split>), and the shares of conditions among the rows of one split, to four digits."""
    inside = F.col(split) == of
    among = lambda c: F.round(F.count_if(inside & c) / F.nullif(F.count_if(inside), F.lit(0)), 4)
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(split) == x).alias(f"n_{x}") for x in splits], *[among(c).alias(name) for name, c in shares.items()])


def even_picks(df: DataFrame, tier: str, order: list[str], picks: int = 4) -> DataFrame:
    """Rows at index floor(i*(n-1)/(picks-1)) of each sorted tier, first to last.

    Ranks are taken over all tiers at once and offset by the tiers before, so a tier may span many tasks.
    """
    sizes = df.groupBy(tier).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy(tier).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each tier
    ranked = with_rank(df, [tier, *order]).join(sizes, tier).withColumn("_k", F.col("_rank") - 1 - F.col("_first"))
    wanted = F.array(*[F.floor(F.lit(i) * (F.col("_n") - 1) / (picks - 1)) for i in range(picks)])
    return ranked.where(F.array_contains(wanted, F.col("_k"))).select(*df.columns)


def modulo_shard(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    return with_rank(df, order).withColumn("shard", F.pmod(F.col("_rank") - 1, F.lit(shards)).cast("int")).drop("_rank")


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, or null."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        out = F.when(condition, name).otherwise(out)
    return out


def greedy_two_key_dedup(df: DataFrame, order: str, a: str, b: str) -> DataFrame:
    """In order, keep a row if neither its a nor its b is held by a row kept before.

    Rounds: a row that is first among the open rows by both its keys is kept; open rows that share a
    key with a kept row go. A row waits only for earlier rows of its own keys, so each round settles
    at least the first row of every connected group, and the result is that of the sequential scan.
    Each round is two partial aggregates and equality joins; a null key is a value like others.
    """
    open_rows = settled(df.select(F.col(order).alias("_o"), F.struct(F.col(a)).alias("_a"), F.struct(F.col(b)).alias("_b")))
    kept = None
    while not open_rows.isEmpty():
        first_a = open_rows.groupBy("_a").agg(F.min("_o").alias("_fa"))
        first_b = open_rows.groupBy("_b").agg(F.min("_o").alias("_fb"))
        won = settled(open_rows.join(first_a, "_a").join(first_b, "_b").where("_o = _fa and _o = _fb").select("_o", "_a", "_b"))
        kept = won if kept is None else kept.unionByName(won)
        open_rows = settled(open_rows.join(won.select("_a"), "_a", "left_anti").join(won.select("_b"), "_b", "left_anti"))
    if kept is None:
        return df
    return df.join(kept.select(F.col("_o").alias(order)), order, "left_semi")


def nearest_relative(bench: DataFrame, train: DataFrame, key: str, bucket: list[str], extents: str) -> DataFrame:
    """key, distance: the smallest over train rows in the same bucket of the largest relative difference
    of an axis; 1.0 if the bucket is empty. Training rows with equal extents count once."""
    from ..functions.geometry import relative_difference

    other = train.select(*bucket, F.col(extents).alias("_e")).distinct()
    joined = bench.join(other, bucket, "left")
    return joined.groupBy(key).agg(F.round(F.coalesce(F.min(relative_difference(F.col(extents), F.col("_e"))), F.lit(1.0)), 9).alias("distance"))


def threshold_ladder(distances: DataFrame, column: str, steps: list[float]) -> DataFrame:
    """threshold, n: how many distances are at most each step."""
    counts = distances.agg(*[F.count_if(F.col(column) <= s).alias(f"c{k}") for k, s in enumerate(steps)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("threshold"), F.col(f"c{k}").alias("n")) for k, s in enumerate(steps)])))


def flagged(df: DataFrame, catalog: DataFrame, key: str, flag: str) -> DataFrame:
    """df with a boolean: whether the catalog has the row's key; a null key is in no catalog."""
    there = catalog.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(there, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def key_union(*tables: DataFrame, on: str) -> DataFrame:
    """The distinct keys of all tables."""
    return reduce(DataFrame.unionByName, [t.select(on).distinct() for t in tables]).distinct()


def disjoint(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """df, or an error that names a key which both sides have."""
    shared = df.join(other.select(on).distinct(), on, "left_semi").select(on).limit(1).collect()
    if shared:
        raise ValueError(f"both sides have {on} {shared[0][0]!r}")
    return df


def distinct_flatten(df: DataFrame, keys: list[str], lists: str) -> DataFrame:
    """keys and the sorted distinct elements of all their lists; elements are folded before they are gathered."""
    flat = df.select(*keys, F.explode(lists).alias(lists)).distinct()
    return flat.groupBy(*keys).agg(F.array_sort(F.collect_set(lists)).alias(lists))


QUERIES_HELD, ROWS_HELD = 4096, 65_536


def nearest_vectors(queries: DataFrame, rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and best: the highest cosine of each query with a row of another key, over all rows.

    Queries are dealt in blocks and rows in parts of a bounded size; each pair of them is one matrix
    product, which sends on one number for each query. Null vectors take no part.
    """
    queries, rows = (x.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")) for x in (queries, rows))
    n_blocks, n_parts = (max(1, -(-x.count() // most)) for x, most in ((queries, QUERIES_HELD), (rows, ROWS_HELD)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.select("id", "v", place(n_blocks).alias("block"), every(n_parts).alias("part"))
    given = rows.select("id", "v", every(n_blocks).alias("block"), place(n_parts).alias("part"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "best": []})
        x, y = (np.stack(t["v"].to_list()) for t in (a, b))
        x, y = (t / np.linalg.norm(t, axis=1, keepdims=True) for t in (x, y))
        out = np.full(len(x), -np.inf)
        for at in range(0, len(y), 4096):
            likeness = x @ y[at : at + 4096].T
            likeness[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, at : at + 4096]] = -np.inf
            out = np.maximum(out, likeness.max(1))
        return pd.DataFrame({"id": a["id"], "best": out})[np.isfinite(out)]

    found = asked.groupBy("block", "part").cogroup(given.groupBy("block", "part")).applyInPandas(best, "id long, best double")
    return found.groupBy(F.col("id").alias(key)).agg(F.max("best").alias("best"))


ITEM_BYTES = 16 << 20  # of the items that one scan looks for


def holding(texts: DataFrame, items: DataFrame, text: str, item_id: str, item: str) -> DataFrame:
    """The columns of texts but the text itself, and item_id, for each text and each item that it holds as it stands.

    Items are a stated query set. They are looked for in blocks of bounded bytes; a task scans each of its texts once for all items of
    a block, with an automaton of their strings, so any edge and any length will do. An empty item is in every text; null texts hold none.
    """
    sized = with_rank(items.where(F.col(item).isNotNull()).select(item_id, item), [item, item_id])
    total = sized.agg(F.sum(F.octet_length(item))).first()[0] or 0
    blocks = max(1, math.ceil(total / ITEM_BYTES))
    keep = [c for c in texts.columns if c != text]
    schema = T.StructType([texts.schema[c] for c in keep] + [items.schema[item_id]])
    found = None
    for k in range(blocks):
        rows = sized.where(F.pmod(F.col("_rank"), F.lit(blocks)) == k).select(item_id, item).collect()  # about ITEM_BYTES
        strings: dict[str, list] = {}
        for r in rows:
            strings.setdefault(r[1], []).append(r[0])

        def scan(batches, strings=strings):
            everywhere = strings.get("", [])
            finder = ahocorasick.Automaton()
            for s, ids in strings.items():
                if s:
                    finder.add_word(s, ids)
            finder.make_automaton()
            for batch in batches:
                at, ids = [], []
                for n, t in enumerate(batch.column(text).to_pylist()):
                    if t is not None:
                        held = {i for _, x in finder.iter(t) for i in x} if len(finder) else set()
                        held.update(everywhere)
                        at += [n] * len(held)
                        ids += sorted(held, key=repr)
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in keep] + [pa.array(ids, to_arrow_type(schema[item_id].dataType))], names=[*keep, item_id])

        part = texts.mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    return found
