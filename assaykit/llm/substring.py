"""Exact removal of repeated passages, with a count-min prefilter.

A window is 35 consecutive words. Every window holds an anchor, the smallest hash among its
word groups of eight, so a window can't repeat unless its anchor does. Anchors are ten times
fewer than windows. Neighbouring windows with one anchor are one unit. The first pass writes the
units' keys, in slices by a hash of the anchor, and counts the anchors of a slice in count-min
sketches, one for each partition, which are merged; the estimate of an anchor's count is never
below the count of any of its windows. The second pass groups only windows whose estimate says
repeated, and does so exactly:

1. Equal units are counted; those found
   twice or more have all their windows repeated.
2. For anchors with several different units, one occurrence of each is read again and its single
   windows are grouped. That finds what a unit that differs at its edge still shares.

Scale: there are as many slices as four cells for each anchor take, so the sketch filters alike at
every size, and what is broadcast for a slice is bounded: two rows of cells_most cells, one bit
each once merged. Each slice reads its own files only, of which there are SLICE_FILES at most. Sketch blocks are merged by streaming over
sorted rows, in constant memory. All counts are partial aggregates and all joins are equality
joins, so a passage in a third of all texts is folded before the shuffle or split at run time.
Whole texts are handled, and read three times: for the units, for the windows of units that share
their anchor with others (which an exact join names), and to take words out. Occurrences in equal texts are folded by a
128-bit key of the text before they are gathered for each text.

Edge cases: null and empty texts have no words; texts shorter than a window keep all; repeated
rows repeat each other's windows; further columns pass through, but for those with the name of a
result or helper, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget, held, lists, new_table, small_batches, text_or_empty, utf8

WINDOW = 35
GROUP = 8
ROWS = 2
CELLS_MOST = 1 << 28
SLICE_FILES = 16  # files of a slice
BLOCK = 1 << 16
WORDS_HELD = 250_000
PLACES = np.uint64(26)  # bits for a position; longer texts are taken in parts
PART = 1 << 25

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh64_intdigest(word, 7)
        if len(self) >= WORDS_HELD:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each group of width words, from prefix sums of powers."""
    out = np.zeros(len(h) - width + 1, np.uint64)
    done, step, part = 0, 1, h
    # doubling: part holds hashes of step words; bits of width say which to take
    while True:
        if width & step:
            out = out * power(step) + part[done : done + len(out)]
            done += step
        if done == width:
            return mixed(out)
        part = part[:-step] * power(step) + part[step:]
        step *= 2


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(A), n, 1 << 64))


def units(text: bytes):
    """Yields (first window, windows in the unit, anchor, unit hash, window hashes) arrays of a text's units."""
    words = text.split()
    h = np.fromiter(map(held("words", WordHashes).__getitem__, words), np.uint64, len(words))
    for at in range(0, max(len(words) - WINDOW + 1, 0), PART):
        part = h[at : at + PART + WINDOW - 1]
        win, group = rolling(part, WINDOW), rolling(part, GROUP)
        low = np.uint64((1 << int(PLACES)) - 1)
        least, span, all_of = (group & ~low) | np.arange(len(group), dtype=np.uint64), 1, WINDOW - GROUP + 1
        while span < all_of:
            step = min(span, all_of - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[first, len(win)])
        order = (np.arange(len(win)) - np.repeat(first, count)).astype(np.uint64)
        unit = mixed(np.add.reduceat(mixed(win + order * A), first) + count.astype(np.uint64))
        yield at + first, count, group[place[first]], unit, win


def cells(keys: np.ndarray, row: int, n_cells: int) -> np.ndarray:
    return (mixed(keys + np.uint64((row + 1) * int(A) % 2**64)) & np.uint64(n_cells - 1)).astype(np.int64)


class Bits:
    """Merged sketch rows as one bit for each cell: counted least times or more."""

    def __init__(self, rows: list[np.ndarray], n_cells: int):
        self.rows, self.n_cells = rows, n_cells

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for r, bits in enumerate(self.rows):
            c = cells(keys, r, self.n_cells)
            out &= (bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
        return out


def cells_for(expected: int, most: int = CELLS_MOST) -> tuple[int, int]:
    """Cells of a sketch row and number of slices, for four cells for each key at least."""
    n = BLOCK
    while n < min(4 * expected, most):
        n *= 2
    return n, max(1, -(-4 * expected // n))


def _blocks(keys: np.ndarray, n_cells: int):
    """(row, block, cells counted once, cells counted more often) of one partition's sketch."""
    for row in range(ROWS):
        cell, seen = np.unique(cells(keys, row, n_cells), return_counts=True)
        block = cell // BLOCK
        ends = np.searchsorted(block, np.arange(n_cells // BLOCK + 1))
        within = (cell % BLOCK).astype(np.uint16)
        for k in np.flatnonzero(np.diff(ends)).tolist():
            part, n = within[ends[k] : ends[k + 1]], seen[ends[k] : ends[k + 1]]
            yield row, k, part[n == 1].tobytes(), part[n > 1].tobytes()


SKETCH = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
FLUSH = 4_000_000  # keys counted in memory before their blocks are sent on


def sketch(keys_of, df: DataFrame, n_cells: int, least: int) -> Bits:
    """Count-min sketches of each partition's keys, merged; keys_of(batch) gives a batch's keys (uint64)."""

    def count(batches):
        keys_held, n = [], 0

        def send():
            rows = list(_blocks(np.concatenate(keys_held), n_cells))
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 1000]), SKETCH.types)], schema=SKETCH)

        for batch in batches:
            keys = keys_of(batch)
            keys_held.append(keys)
            n += len(keys)
            if n >= FLUSH:
                yield from send()
                keys_held, n = [], 0
        if n:
            yield from send()

    def merge(batches):
        at, seen = None, None
        schema = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())])

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(seen >= least, bitorder="little").tobytes()])], schema=schema)

        for batch in batches:
            for row, block, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                if (row, block) != at:
                    if at is not None:
                        yield out()
                    at, seen = (row, block), np.zeros(BLOCK, np.uint8)
                cell = np.frombuffer(once, np.uint16)
                seen[cell] = np.minimum(seen[cell] + 1, 2)
                seen[np.frombuffer(more, np.uint16)] = 2
        if at is not None:
            yield out()

    parts = df.mapInArrow(count, "row int, block int, once binary, more binary")
    dealt = parts.repartition("row", "block").sortWithinPartitions("row", "block")
    merged = dealt.mapInArrow(merge, "row int, block int, bits binary")
    rows = [np.zeros(n_cells // 8, np.uint8) for _ in range(ROWS)]
    for r in merged.collect():  # n_cells / 8 bytes for each row at most
        at = r["block"] * BLOCK // 8
        rows[r["row"]][at : at + BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return Bits(rows, n_cells)


def occurrence(k1: np.ndarray, k2: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mixed(mixed(k1.view(np.uint64) * A + first.astype(np.uint64)) + k2.view(np.uint64))


UNIT = "anchor long, unit long, n int, k1 long, k2 long, first int"
OCC = pa.schema([("anchor", pa.int64()), ("unit", pa.int64()), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()), ("occ", pa.int64())])


def _unit_columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of UNIT for each unit of a batch of texts."""
    parts = []
    for x, k1, k2 in zip(utf8(batch.column("text")), batch.column("k1").to_pylist(), batch.column("k2").to_pylist()):
        for first, n, anchor, unit, _ in units(x):
            parts.append((anchor.view(np.int64), unit.view(np.int64), n, np.full(len(n), k1), np.full(len(n), k2), first))
    if not parts:
        return [np.empty(0, np.int64)] * 6
    anchor, unit, n, k1, k2, first = (np.concatenate(x) for x in zip(*parts))
    return [anchor, unit, n.astype(np.int32), k1, k2, first.astype(np.int32)]


def repeated(df: DataFrame, text: str = "text", cells_most: int = CELLS_MOST) -> DataFrame:
    """(k1, k2, spans): for the key of each text with repeats, its (first word, number of words) spans, sorted.

    cells_most bounds the memory of a worker: a quarter of a byte for each cell; the more, the fewer slices.
    """
    spark = df.sparkSession
    small_batches(spark)
    keyed = df.select(*_keys(text), text_or_empty(text).alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_cells, slices = cells_for(size // 60, cells_most)

    def first(batches):
        schema = pa.schema([*list(OCC)[:6], ("slice", pa.int32())])
        for batch in batches:
            columns = _unit_columns(batch)
            part = (columns[0].view(np.uint64) >> np.uint64(32)) % np.uint64(slices)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, part.astype(np.int32)], schema.types)], schema=schema)

    units_of = keyed.mapInArrow(first, f"{UNIT}, slice int")
    if slices > 1:  # so that files follow the slices, not tasks times slices
        units_of = units_of.repartition("slice", F.pmod(F.xxhash64("unit"), F.lit(SLICE_FILES)))
    found = cut(units_of, "repeat-all-units", by="slice" if slices > 1 else None, tidy=True)
    kept = new_table(spark, "repeat-units")
    for k in range(slices):
        part = found.where(F.col("slice") == k).drop("slice")
        often = spark.sparkContext.broadcast(sketch(lambda b: b.column("anchor").to_numpy().view(np.uint64), part.select("anchor"), n_cells, 2))

        def second(batches, often=often):
            for batch in batches:
                batch = batch.filter(pa.array(often.value(batch.column("anchor").to_numpy().view(np.uint64))))
                occ = occurrence(*(batch.column(c).to_numpy() for c in ("k1", "k2", "first"))).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(occ)], schema=OCC)

        part.mapInArrow(second, f"{UNIT}, occ long").write.parquet(f"{kept}/slice={k}")
        often.unpersist()
    forget(found)
    occ = spark.read.schema(f"{UNIT}, occ long, slice int").parquet(kept).drop("slice")
    # one occurrence stands for each unit: the one with the smallest hash
    seen = cut(occ.groupBy("anchor", "unit").agg(F.count("*").alias("c"), F.min("occ").alias("occ")), "repeat-counts", tidy=True)
    several = seen.groupBy("anchor").count().where("count > 1").select("anchor")
    chosen = seen.join(several, "anchor")
    # where that occurrence stands; equal texts show it several times
    places = occ.join(chosen, ["anchor", "unit", "occ"]).groupBy("anchor", "unit", "occ").agg(*[F.min(F.struct("k1", "k2", "first", "c")).alias("p")])
    asked = places.select("p.*", "anchor").groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "anchor", "c")).alias("units"))
    asked = cut(asked, "repeat-chosen", tidy=True)

    def third(batches):
        schema = pa.schema([("anchor", pa.int64()), ("c", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()), ("windows", pa.list_(pa.int64()))])
        for batch in batches:
            rows, wins = [], []
            for text_, k1, k2, wanted in zip(utf8(batch.column("text")), *(batch.column(c).to_pylist() for c in ("k1", "k2", "units"))):
                at = {u["first"]: u for u in wanted}
                for start, n, _, _, win in units(text_):
                    edges = np.cumsum(n)
                    for k in np.flatnonzero(np.isin(start, list(at))).tolist():
                        u = at[int(start[k])]
                        rows.append((u["anchor"], u["c"], k1, k2, u["first"]))
                        wins.append(win[edges[k] - n[k] : edges[k]].view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), schema.types)), lists(wins, pa.int64())], schema=schema)

    texts = keyed.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "units")
    read = texts.mapInArrow(third, "anchor long, c long, k1 long, k2 long, first int, windows array<long>")
    read = read.groupBy("k1", "k2", "first").agg(*[F.first(c).alias(c) for c in ("anchor", "c", "windows")])
    single = read.select("anchor", "c", "k1", "k2", "first", F.posexplode("windows").alias("at", "win"))
    single = cut(single, "repeat-windows", tidy=True)
    more = single.groupBy("anchor", "win").agg(F.sum("c").alias("total")).where("total > 1").select("anchor", "win")
    alone = single.where("c = 1").join(more, ["anchor", "win"]).select("k1", "k2", (F.col("first") + F.col("at")).alias("first"), F.lit(WINDOW).alias("words"))
    whole = occ.join(seen.where("c > 1").select("anchor", "unit"), ["anchor", "unit"]).select("k1", "k2", "first", (F.col("n") + WINDOW - 1).alias("words"))
    # a set, since equal texts tell the same spans; each task sends a span of a text once
    return whole.unionByName(alone).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("first", "words"))).alias("spans"))


def _keys(text: str) -> list[Column]:
    whole = text_or_empty(text)
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit("text"), whole).alias("k2")]


KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def remove_repeats(df: DataFrame, text: str = "text", cells_most: int = CELLS_MOST) -> DataFrame:
    """df with n_words, n_removed and kept, the text's words outside repeated windows joined by a space."""

    df = df.drop("n_words", "n_removed", "kept", "_k1", "_k2", "_spans", "_out")

    @F.arrow_udf(KEPT)
    def of(column: pa.Array, first: pa.Array, n: pa.Array) -> pa.Array:
        total, removed, kept = [], [], []
        for x, a, b in zip(utf8(column), first.to_pylist(), n.to_pylist()):
            words = x.split()
            if a:
                edge = np.zeros(len(words) + 1, np.int64)
                a = np.array(a)
                np.add.at(edge, a, 1)
                np.add.at(edge, a + np.array(b), -1)
                left = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
            else:
                left = range(len(words))
            total.append(len(words))
            removed.append(len(words) - len(left))
            kept.append(b" ".join([words[k] for k in left]))
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [f.name for f in KEPT])

    keys = [k.alias(f"_{n}") for k, n in zip(_keys(text), ("k1", "k2"))]
    found = repeated(df, text, cells_most).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("spans").alias("_spans"))
    joined = df.select("*", *keys).join(found, ["_k1", "_k2"], "left")
    out = joined.withColumn("_out", of(text_or_empty(text), F.col("_spans.first"), F.col("_spans.words")))
    return out.select(*[F.col(c) for c in df.columns], "_out.*")
