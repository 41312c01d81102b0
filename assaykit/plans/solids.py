"""Queries over points, solids and rasters made of the given tables."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from ..functions import rasters
from ..operators import surfaces
from .registry import query, table

POINT = "l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 + l_tax * 100 AS z"


def points(spark, d):
    made = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).cast("double").alias("y"), (F.col("l_discount") * 100 + F.col("l_tax") * 100).cast("double").alias("z"))
    return made.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query(f"""WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_returnflag AS flag, {POINT} FROM lineitem)
SELECT a.id, a.flag, round(sqrt(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) AS distance FROM p a JOIN p b ON a.flag = b.flag AND b.l_orderkey % 20 <> 0 WHERE a.l_orderkey % 20 = 0 GROUP BY a.id, a.flag""")
def nearest_surface(spark, d):
    """The distance from each stated point to the nearest of all others with its flag."""
    p = points(spark, d)
    found = surfaces.nearest_points(p.where("l_orderkey % 20 = 0"), p.where("l_orderkey % 20 <> 0"), "id", ["l_returnflag"], ["x", "y", "z"])
    return found.where("distance is not null").select("id", F.col("l_returnflag").alias("flag"), F.round("distance", 6).alias("distance"))


ORDERS = ", ".join(f"({4 * k + turn}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(permutations((1, 2, 3))) for turn in range(4))


@query(f"""WITH s AS (SELECT p_partkey, [p_size / 10.0::DOUBLE, (p_partkey % 7 + 1) / 2.0, p_retailprice / 500] AS e, [(p_partkey % 7 + 1) / 2.0, p_size / 9.0::DOUBLE, p_retailprice / 510] AS g FROM part),
 t AS (SELECT p_partkey, rotation, e[a] AS x, e[b] AS y, e[c] AS z, greatest(abs(e[a] - g[1]), abs(e[b] - g[2]), abs(e[c] - g[3])) <= 0.25 * greatest(list_max(g), 1e-9) + 1e-9 AS fits FROM s, (VALUES {ORDERS}) AS o(rotation, a, b, c))
SELECT p_partkey, rotation, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, fits FROM t WHERE fits
UNION ALL SELECT p_partkey, 0, round(e[1], 6), round(e[2], 6), round(e[3], 6), false FROM s WHERE p_partkey NOT IN (SELECT p_partkey FROM t WHERE fits)""")
def aligned_candidates(spark, d):
    """The rotations that bring each part's extents near another's, by a table function; a row that doesn't fit for parts without one."""
    size, turn, price = F.col("p_size").cast("double"), (F.col("p_partkey") % 7 + 1) / F.lit(2.0), F.col("p_retailprice").cast("double")
    solids = table(spark, d, "part").select("p_partkey", F.array(size / 10, turn, price / 500).alias("e"), F.array(turn, size / 9, price / 510).alias("g"))
    return surfaces.aligned_candidates(solids, "e", "g").select("p_partkey", "rotation", *[F.round(c, 6).alias(c) for c in "xyz"], "fits")


SIDE = 20
PARTS_OF_A_TASK = 50_000


@query(f"""WITH c AS (SELECT p_partkey, p_size, y, x, (x * 7 + y * 13 + p_partkey) % (p_size + 9) = 0 AS on_ FROM part, range({SIDE}) AS r(y), range({SIDE}) AS s(x)),
 n AS (SELECT a.p_partkey, a.y, a.x, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2)::BIGINT AS q FROM c a JOIN c b ON a.p_partkey = b.p_partkey AND b.on_ GROUP BY ALL)
SELECT p_partkey, sum(q)::BIGINT AS total, max(q) AS farthest, count(*) FILTER (WHERE q <= 4) AS n_near FROM n GROUP BY p_partkey""")
def distance_transform(spark, d):
    """Squared distances to the nearest set cell of a raster for each part."""
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts.count() // PARTS_OF_A_TASK)  # a small file holds much work
    cell = lambda y, x: (F.lit(x * 7 + y * 13) + F.col("p_partkey")) % (F.col("p_size") + 9) == 0
    mask = F.array(*[F.array(*[cell(y, x) for x in range(SIDE)]) for y in range(SIDE)])
    flat = parts.repartition(n, "p_partkey").select("p_partkey", F.flatten(rasters.distances(mask)).alias("q")).where("q[0] is not null")
    return flat.select("p_partkey", F.aggregate("q", F.lit(0.0), lambda s, v: s + v).cast("long").alias("total"), F.array_max("q").cast("long").alias("farthest"), F.size(F.filter("q", lambda v: v <= 4)).cast("long").alias("n_near"))
