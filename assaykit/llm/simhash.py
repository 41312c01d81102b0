"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits are cut into two segments of 32 bits.
Either the upper segments differ in at most one bit, or the lower ones are equal. So each
distinct fingerprint is indexed under its 32 one-wildcard variants of the upper segment and
under its lower segment as it is: 33 rows. An equality join on these keys finds each link, and
the candidates are verified on the whole fingerprint.

Scale: equal fingerprints are folded before anything else, so a group of copies is one row.
Index rows are dealt by key and read in sorted blocks. A key with more than BUCKET distinct
fingerprints isn't compared pair by pair: its members instead look for the at most 2,080
fingerprints within two bits by an equality join on the whole fingerprint, whose keys are unique.
The work is therefore linear in the number of fingerprints, and no link is lost.

Edge cases: null texts count as empty; texts without words have fingerprint 0 and are linked
like any others; rows without an id get a fingerprint and the smallest id reachable, null if
there is none; repeated rows and further columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches, text_or_empty, utf8
from .components import connected_components

SHINGLE = 3
SEED = 42
BUCKET = 256
BLOCK = 1 << 16


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if there are fewer words."""
    words = text.lower().split()  # on bytes: only A-Z is lower-cased, only ASCII white space splits
    if len(words) < width:
        grams, n = ([b" ".join(words)], 1) if words else ([], 0)
    else:
        grams, n = map(b" ".join, zip(*(words[k:] for k in range(width)))), len(words) - width + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """Bit i is set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = np.ascontiguousarray(hashes[at : at + BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """df with the SimHash of the column text, as a long of the same bits."""
    small_batches(df.sparkSession)

    @F.arrow_udf(T.LongType())
    def of(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(shingle_hashes(x)) for x in utf8(column)], np.uint64).view(np.int64))

    return df.withColumn(out, of(text_or_empty(text)))


def _index(fps: DataFrame) -> DataFrame:
    """33 rows (key, fp) for each fingerprint; key = wildcard position and the rest of the segment."""
    upper = F.shiftrightunsigned("fp", 32)
    p = F.col("p")
    key = F.when(p == 32, F.lit(32 << 32).bitwiseOR(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(
        F.expr("shiftleft(cast(p as bigint), 32)").bitwiseOR(upper.bitwiseAND(F.expr("~shiftleft(1L, p)")))
    )
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("p")).select(key.alias("key"), "fp")


def _pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within blocks of equal keys, each from the one key that has to report it."""
    out_a, out_b = [], []
    place = (key >> np.uint64(32)).astype(np.int64)
    for d in range(1, len(key)):
        same = np.flatnonzero(key[d:] == key[:-d])
        if not len(same):
            break
        x, y, p = fp[same], fp[same + d], place[same]
        diff = x ^ y
        upper, lower = np.bitwise_count(diff >> np.uint64(32)), np.bitwise_count(diff & np.uint64(0xFFFFFFFF))
        told = np.where(p == 32, (lower == 0) & (upper == 2), ((upper == 1) | (p == 0)) & (upper + lower <= 2))
        out_a.append(x[told])
        out_b.append(y[told])
    none = np.empty(0, np.uint64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def _scan(batches):
    """Links of rows sorted by key; members of keys over BUCKET come out with a null partner."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held_key, held_fp = np.empty(0, np.uint64), np.empty(0, np.uint64)
    hot = None  # the key being passed on as hot

    def rows(a, b=None):
        a = pa.array(a.view(np.int64))
        return pa.RecordBatch.from_arrays([a, pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))], schema=schema)

    def settle(key, fp):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(key)])
        big = np.repeat(sizes > BUCKET, sizes) if len(key) else np.empty(0, bool)
        if big.any():
            yield rows(fp[big])
        a, b = _pairs(key[~big], fp[~big])
        if len(a):
            yield rows(a, b)

    for batch in batches:
        key = np.concatenate([held_key, batch.column(0).to_numpy().view(np.uint64)])
        fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
        if hot is not None and len(key):
            on = key == hot
            if on.any():
                yield rows(fp[on])
            key, fp = key[~on], fp[~on]
        if not len(key):
            held_key, held_fp = key, fp
            continue
        hot = None
        done = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        yield from settle(key[:done], fp[:done])
        held_key, held_fp = key[done:], fp[done:]
        if len(held_key) > BUCKET:
            hot = held_key[0]
            yield rows(held_fp)
            held_key, held_fp = held_key[:0], held_fp[:0]
    yield from settle(held_key, held_fp)


def links(fps: DataFrame) -> DataFrame:
    """All pairs a, b of the distinct fingerprints in the column fp that differ in one or two bits.

    A pair may come twice; joins and components don't mind.
    """
    # keys are compared as unsigned numbers; all are below 2^38, so the sort order is the same
    dealt = _index(fps).repartition("key").sortWithinPartitions("key", "fp")
    told = cut(dealt.mapInArrow(_scan, "a long, b long"), "simhash-links")
    hot = told.where(F.col("b").isNull()).select(F.col("a").alias("x")).distinct()
    masks = [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    probes = hot.select("x", F.explode(F.array(*[F.lit(m) for m in signed])).alias("m")).select("x", F.col("x").bitwiseXOR(F.col("m")).alias("fp")).where("fp > x")
    found = probes.join(fps, "fp").select(F.col("x").alias("a"), F.col("fp").alias("b"))
    return told.where(F.col("b").isNotNull()).unionByName(found)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df's id, with fp (long) and component_id: the smallest id reachable over links of at most two bits."""
    marked = cut(with_fingerprint(df.select(F.col(doc_id), F.col(text)), text).select(doc_id, "fp"), "simhash-fp")
    first = cut(marked.groupBy("fp").agg(F.min(doc_id).alias("first")), "simhash-distinct")
    parts = connected_components(links(first.select("fp")))
    named = first.join(parts, first.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    least = named.groupBy("part").agg(F.min("first").alias("component_id"))
    by_fp = named.join(least, "part").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(doc_id, "fp", "component_id")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """The rows of df with one document for each component: the one with the smallest id.

    groups has the ids with their component_id, if they aren't those of near_duplicates.

    Of several rows with that id the first in the order of the other columns stays; rows without an id stay, since they can't be told apart.
    """
    groups = near_duplicates(df, doc_id, text) if groups is None else groups
    kept = cut(groups.where(F.col(doc_id) == F.col("component_id")).groupBy(doc_id).count(), "simhash-kept")
    # the kept ids grow with the corpus, so they are never broadcast: texts are dealt by id at every size
    named = df.where(F.col(doc_id).isNotNull()).join(kept.select(doc_id).hint("shuffle_hash"), doc_id, "left_semi").select(*df.columns)
    unnamed = df.where(F.col(doc_id).isNull())
    twice = kept.where("count > 1").select(doc_id)
    if not twice.limit(1).count():
        return named.unionByName(unnamed)
    rest = [c for c in df.columns if c != doc_id]
    again = named.join(twice, doc_id, "left_semi").groupBy(doc_id).agg(F.min(F.struct(*rest)).alias("_row")).select(doc_id, "_row.*").select(*df.columns)
    return named.join(twice, doc_id, "left_anti").select(*df.columns).unionByName(again).unionByName(unnamed)
