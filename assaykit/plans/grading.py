"""Queries that grade programs; the programs are made from the parts table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grade
from .registry import query, table


def programs(spark, d):
    """A sound program for each size; some parts have a blocked, a broken or no program."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    sound = F.concat(F.lit("import math\nr = box("), F.col("p_size").cast("string"), F.lit(", 2, 3)"))
    code = F.when(F.col("p_partkey") % 50 == 1, "import os\nr = 1").when(F.col("p_partkey") % 50 == 2, "r = (").when(F.col("p_partkey") % 50 == 3, F.lit(None).cast("string")).otherwise(sound)
    return p.withColumn("gold_code", sound).withColumn("code", code).withColumn("gold_extents", F.array(F.lit(3.0), F.lit(2.0), F.col("p_size").cast("double")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 50 = 1 THEN 'import of os is not allowed' WHEN p_partkey % 50 = 2 THEN 'SyntaxError' END AS finding FROM part WHERE p_partkey % 50 <> 3""")
def ast_screen(spark, d):
    rows = programs(spark, d).where("code is not null").withColumn("finding", grade.screened(F.col("code")))
    return rows.select("p_partkey", F.regexp_replace("finding", "^SyntaxError.*$", "SyntaxError").alias("finding"))


@query("""SELECT p_partkey, p_partkey % 50 NOT IN (1, 2, 3) AS runs, CASE WHEN p_partkey % 50 = 3 THEN -0.5 WHEN p_partkey % 50 IN (1, 2) THEN -0.2 ELSE 1.5 END::DOUBLE AS reward FROM part""")
def sandbox_grade(spark, d):
    graded = grade.with_reward(grade.grade(programs(spark, d)))
    return graded.select("p_partkey", "runs", F.round("reward", 4).alias("reward"))


@query()
def repair_loop(spark, d):
    """A mock model that fails for a hashed share of the parts, anew in each attempt."""
    rows = programs(spark, d).drop("code")
    return grade.repair_loop(rows, lambda left, attempt: left.withColumn("code", grade.mock_answer(left, "", "p_partkey", 0.3, attempt)), 2).select("p_partkey", "runs", "attempts")
