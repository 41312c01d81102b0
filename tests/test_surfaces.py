"""Nearest points, candidates, distance transforms, stores and scans against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.functions import rasters
from assaykit.operators import curate, surfaces
from assaykit.sources import writers


def clouds(seed, n, spread):
    pick = np.random.default_rng(seed)
    return [(int(k), "ab"[k % 2], *map(float, pick.normal(0, spread, 3))) for k in range(n)]


@pytest.mark.parametrize("far", [1.0, 1000.0])
def test_nearest_points_equal_all_pairs(spark, far):
    kinds = "id long, k string, x double, y double, z double"
    a = clouds(1, 60, 1) + [(500, "a", far, far, -far), (501, "b", None, 0.0, 0.0), (502, "none", 0.0, 0.0, 0.0), (503, None, 0.5, 0.5, 0.5)]
    b = clouds(2, 300, 1) + [(900, "a", 0.0, 0.0, 0.0)] * 50 + [(901, None, 0.0, 0.5, 0.5)]
    got = {(r.k, r.id): r.distance for r in surfaces.nearest_points(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), "id", ["k"], ["x", "y", "z"]).collect()}
    assert len(got) == len(a)
    for i, k, *p in a:
        near = [np.linalg.norm(np.array(p) - np.array(q)) for _, other, *q in b if other == k] if None not in p else []
        assert got[k, i] == (pytest.approx(min(near)) if near else None)
    none = surfaces.nearest_points(spark.createDataFrame(a[:2], kinds), spark.createDataFrame([], kinds), "id", ["k"], ["x", "y", "z"]).collect()
    assert [r.distance for r in none] == [None, None]


def test_surface_distance_is_symmetric(spark):
    kinds = "id long, k string, x double, y double, z double"
    a, b = clouds(3, 40, 1), clouds(4, 50, 1)
    got = {r.k: r for r in surfaces.surface_distance(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), "id", ["k"], ["x", "y", "z"]).collect()}
    for k in "ab":
        p, q = (np.array([r[2:] for r in side if r[1] == k]) for side in (a, b))
        table = np.linalg.norm(p[:, None] - q[None], axis=2)
        assert (got[k].there, got[k].back) == pytest.approx((table.min(1).mean(), table.min(0).mean()))


def test_every_solid_has_a_candidate(spark):
    rows = [(1, [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]), (2, [1.0, 1.0, 1.0], [1.0, 1.0, 1.0]), (3, [1.0, 1.0, 1.0], [9.0, 9.0, 9.0]), (4, None, [1.0, 1.0, 1.0])]
    got = surfaces.aligned_candidates(spark.createDataFrame(rows, "id int, e array<double>, g array<double>"), "e", "g", 0.1).collect()
    count = {k: [r for r in got if r.id == k] for k in (1, 2, 3, 4)}
    assert [len(count[k]) for k in (1, 2, 3, 4)] == [4, 24, 1, 1]
    assert all((r.x, r.y, r.z, r.fits) == (3.0, 2.0, 1.0, True) for r in count[1]) and len({r.rotation for r in count[2]}) == 24
    assert (count[3][0].rotation, count[3][0].fits, count[3][0].x) == (0, False, 1.0) and not count[4][0].fits


def test_distances_are_exact():
    pick = np.random.default_rng(5)
    for shape in ((1, 1), (1, 9), (9, 1), (13, 17), (40, 31)):
        for share in (0.0, 0.02, 0.3, 1.0):
            mask = pick.random(shape) < share
            got = rasters.squared_distance(mask)
            spots = np.argwhere(mask)
            want = np.full(shape, np.inf)
            for y, x in np.ndindex(shape):
                if len(spots):
                    want[y, x] = ((spots - (y, x)) ** 2).sum(1).min()
            assert np.array_equal(got, want)


def test_a_store_holds_what_was_used_last(spark):
    pick = random.Random(2)
    log = [(f"k{pick.randrange(30)}", t // 3) for t in range(200)]
    contents = spark.createDataFrame([(f"k{k}", k) for k in range(25)], "key string, v int")
    got = {r.key for r in writers.bounded_store(contents, spark.createDataFrame(log, "key string, at int"), "key", "at", 10).collect()}
    last = {}
    for key, at in log:
        last[key] = max(at, last.get(key, -1))
    want = sorted((k for k in last if int(k[1:]) < 25), key=lambda k: (-last[k], k))[:10]
    assert got == set(want)


def test_scans_find_items_at_any_edge_in_any_block(spark, monkeypatch):
    items = [(1, "one"), (2, "two words"), (3, "one"), (4, "é\n"), (5, ""), (6, None), (7, "a  b")]
    texts = [(1, "someone"), (2, "two words, é\nxone"), (3, None), (4, ""), (5, "a  b  a  b")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = {(d, i) for d, t in texts for i, x in items if t is not None and x is not None and x in t}
    for most in (1 << 20, 5):
        monkeypatch.setattr(curate, "ITEM_BYTES", most)
        found = curate.holding(df, spark.createDataFrame(items, "item_id long, text string"), "text", "item_id", "text")
        assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert curate.holding(df, spark.createDataFrame([], "item_id long, text string"), "text", "item_id", "text").count() == 0


def test_neighbours_of_groups_of_one_and_two(spark):
    rows = spark.createDataFrame([(1, 5), (2, 7), (2, 9), (None, 1), (None, 3), (None, 2)], "g int, k int")
    got = {(r.g, r.k): (r.prev, r.next) for r in curate.cyclic_neighbours(rows, "g", "k").collect()}
    assert got == {(1, 5): (5, 5), (2, 7): (9, 9), (2, 9): (7, 7), (None, 1): (3, 2), (None, 2): (1, 3), (None, 3): (2, 1)}


def test_distances_of_many_rasters_at_a_time(spark, data, monkeypatch):
    """Rasters of several shapes, empty and null ones; and the query deals its rows to many tasks."""
    from assaykit import plans

    rng = np.random.default_rng(2)
    masks = [rng.random(shape) < share for shape in ((3, 4), (5, 70), (4, 3), (3, 4)) for share in (0.0, 0.1, 0.5)]
    rows = [(k, m.tolist()) for k, m in enumerate(masks)] + [(90, None), (91, [])]
    got = {r.k: r.q for r in spark.createDataFrame(rows, "k int, m array<array<boolean>>").coalesce(1).select("k", rasters.distances(F.col("m")).alias("q")).collect()}
    for k, m in enumerate(masks):
        assert got[k] == [[None if np.isinf(v) else v for v in r] for r in rasters.squared_distance(m).tolist()]
    assert got[90] is None and got[91] is None
    df = plans.QUERIES["distance_transform"](spark, data)
    assert df.rdd.getNumPartitions() >= 4
    many = np.random.default_rng(1).random((7, 20, 20)) < 0.05
    monkeypatch.setattr(rasters, "squared_distance", None)
    assert rasters.squared_distances(many).shape == many.shape
