"""Near-duplicates by the exact Jaccard similarity of the texts' shingle sets.

Candidates come from SimHashes of the same shingles that differ in two bits or fewer, by the deletion
variants of `simhash`, and from what these can't reach, min-hashes: BANDS keys of ROWS minima each. Two texts of similarity s share
no key with a chance of (1 - s^5)^36, which is 6e-7 at 0.8 and less above. Texts that hang
together by keys are a family; links within it are decided on whole sets, so no text is merged
for a likeness of its sketch only:

1. Each text is compared with one head, the first text of most of its keys.
2. What hangs together by these links needs no more of them. The texts outside the family's
   largest such group are compared with all texts of the family, in blocks.

Fingerprints of few bits can't stand in for this: at a similarity of 0.8, 64-bit SimHashes differ
in 10 bits on average, which no index of one-wildcard segments finds without listing most pairs.

Scale: equal texts are folded first. Only texts with a key in common with another one are read
again. Keys are counted before they are joined, a key or head with very many texts is split at
run time by the joins, and a family of m texts, all but u of which hang together by their heads,
costs m comparisons and m * u / BLOCK rows. No unit of work is larger than a block and a part.

Edge cases: null texts count as empty; texts without words are copies of one another; a text with
fewer words than a shingle is one shingle; rows without an id are given the smallest id reachable.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget, lists, small_batches, text_or_empty, utf8
from .components import connected_components
from .simhash import fingerprint, shingle_hashes
from .simhash import links as simhash_links

BANDS, ROWS = 36, 5
BLOCK, BLOCK_SHINGLES = 512, 1_000_000  # of a family's rest that are held together
OTHERS, OTHERS_SHINGLES = 4096, 4_000_000  # of the family that pass by a block in one unit
PART = 1 << 14  # shingles of a text that are hashed together
_RNG = np.random.default_rng(42)
_TIMES = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_FLIP = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band."""
    low = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(shingles), PART):
        x = ((shingles[at : at + PART] >> np.uint64(32)).astype(np.uint32)[None, :] ^ _FLIP) * _TIMES
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        low = np.minimum(low, x.min(axis=1))
    key = (low.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND
    return key ^ (key >> np.uint64(31))


class Block:
    """Some sets, with the places of each shingle, and which of the texts seen so far hang together."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.shingles, self.begin = np.unique(flat[order], return_index=True)
        self.begin = np.r_[self.begin, len(flat)]
        self.owner = np.repeat(np.arange(len(sets)), self.size)[order]
        self.nodes = nodes
        self.root = np.arange(len(sets))  # texts of the block that a common partner links

    def linked(self, node: int, one: np.ndarray, similarity: float) -> list[int]:
        """The nodes of the block that are linked with a set, one for each group that no set before has linked."""
        at = np.searchsorted(self.shingles, one)
        at = at[at < len(self.shingles)] if len(at) else at
        mine = at[self.shingles[at] == one[: len(at)]]
        n = self.begin[mine + 1] - self.begin[mine]
        spots = np.repeat(self.begin[mine] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(self.owner[spots], minlength=len(self.size))
        told = np.flatnonzero((both > 0) & (both >= similarity * (self.size + len(one) - both) - 1e-9))
        out = []
        for root in np.unique(self.root[told]).tolist():
            out.append(self.nodes[int(told[self.root[told] == root][0])])
        if len(told):
            self.root[np.isin(self.root, self.root[told])] = self.root[told[0]]
        return [x for x in out if x != node]


def _compare(similarity: float):
    """Links of the texts of each unit with its block; rows come sorted, the block's first."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(batches):
        unit, nodes, sets, block = None, [], [], None
        for batch in batches:
            a, b = [], []
            column = batch.column(5)
            for k, (family, part, at, other, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                if (family, part, at) != unit:
                    unit, nodes, sets, block = (family, part, at), [], [], None
                one = column[k].values.to_numpy(zero_copy_only=False)
                if not other:
                    nodes.append(node)
                    sets.append(np.array(one))
                    continue
                if not nodes:  # no text of the rest fell into this block
                    continue
                block = block or Block(nodes, sets)
                for x in block.linked(node, one, similarity):
                    a.append(node)
                    b.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return of


def _by_fingerprint(marked: DataFrame) -> DataFrame:
    """Candidates a, b, n of texts (node, fp) whose SimHashes differ in two bits or fewer, by deletion variants; a fingerprint's texts go to its first."""
    heads = cut(marked.groupBy("fp").agg(F.min("node").alias("b")), "near-fp")
    copies = marked.join(heads, "fp").select(F.col("node").alias("a"), "b")
    pairs = simhash_links(heads.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    near = pairs.join(heads.select(F.col("fp").alias("x"), F.col("b").alias("a")), "x").join(heads.select(F.col("fp").alias("y"), "b"), "y").select("a", "b")
    return copies.unionByName(near).where("a <> b").select("a", "b", F.lit(1).cast("long").alias("n"))


def links(df: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """Edges a, b of node hashes of texts that connect whatever links of at least that similarity connect."""
    small_batches(df.sparkSession)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys(column: pa.Array) -> pa.Array:
        # texts without words are equal as sets, and one key does for them
        return lists([band_keys(shingle_set(x, width)).view(np.int64) for x in utf8(column)], pa.int64())

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def whole(column: pa.Array) -> pa.Array:
        return lists([np.sort(x.view(np.int64)) if len(x := shingle_set(t, width)) else np.zeros(1, np.int64) for t in utf8(column)], pa.int64())

    texts = df.select(F.xxhash64(text_or_empty(text)).alias("node"), text_or_empty(text).alias("t"))
    @F.arrow_udf(T.LongType())
    def fingerprints(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(shingle_hashes(x, width)) for x in utf8(column)], np.uint64).view(np.int64))

    found = texts.select("node", keys("t").alias("keys"), fingerprints("t").alias("fp"))
    marked = cut(found.groupBy("node").agg(F.any_value("keys").alias("keys"), F.any_value("fp").alias("fp")), "near-keys")
    uses = marked.select(F.explode("keys").alias("key"), F.col("node").alias("a"))
    first = uses.groupBy("key").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = uses.join(first, "key").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    stars = cut(shared.unionByName(_by_fingerprint(marked)).groupBy("a", "b").agg(F.sum("n").alias("n")), "near-stars")
    families = cut(connected_components(stars), "near-families")
    forget(marked)
    again = texts.join(families.hint("shuffle_hash"), "node").groupBy("node", "component").agg(F.any_value("t").alias("t"))
    sets = cut(again.select("node", "component", whole("t").alias("s")), "near-sets")

    heads = stars.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    pairs = heads.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    near = cut(pairs.where(both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b"), "near-heads")
    groups = connected_components(near).withColumnRenamed("component", "part")
    placed = cut(families.join(groups, "node", "left").select("node", "component", F.coalesce("part", "node").alias("part")), "near-groups")
    sizes = placed.groupBy("component", "part").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("component").agg(F.max_by("part", F.struct("m", "part")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    left = placed.join(largest, "component").select("node", (F.col("part") != F.col("largest")).alias("rest"))
    named = cut(sets.join(left, "node"), "near-rest")
    chunks = lambda rows, most, most_shingles: F.greatest(F.lit(1), F.ceil(F.count(rows) / most), F.ceil(F.sum(F.when(rows, F.size("s"))) / most_shingles)).cast("long")
    rest = F.when(F.col("rest"), F.lit(True))
    blocks = named.groupBy("component").agg(chunks(rest, BLOCK, BLOCK_SHINGLES).alias("n_parts"), chunks(F.lit(True), OTHERS, OTHERS_SHINGLES).alias("n_others"))
    dealt = named.join(blocks, "component").withColumn("h", F.xxhash64("node", F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = dealt.where("rest").select("component", F.pmod("h", "n_parts").alias("part"), every("n_others").alias("at"), F.lit(False).alias("other"), "node", "s")
    passing = dealt.select("component", every("n_parts").alias("part"), F.pmod("h", "n_others").alias("at"), F.lit(True).alias("other"), "node", "s")
    units = held.unionByName(passing).repartition("component", "part", "at").sortWithinPartitions("component", "part", "at", "other", "node")
    more = cut(units.mapInArrow(_compare(similarity), "a long, b long"), "near-links")
    out = cut(near.unionByName(more), "near-all-links")
    forget(stars, families, sets, near, placed, named, more)
    return out


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """df's id, with component_id: the smallest id reachable over links of texts of at least that similarity."""
    marked = cut(df.select(F.col(doc_id), F.xxhash64(text_or_empty(text)).alias("node")), "near-nodes")
    first = cut(marked.groupBy("node").agg(F.min(doc_id).alias("first")), "near-distinct")
    parts = connected_components(links(df, text, width, similarity)).withColumnRenamed("component", "part")
    named = first.join(parts, "node", "left").select("node", "first", F.coalesce("part", "node").alias("part"))
    least = named.groupBy("part").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(least, "part").select("node", "component_id"), "node").select(doc_id, "component_id")
