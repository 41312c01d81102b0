"""Single expressions on hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from assaykit.functions import geometry, stats, text
from assaykit.operators import curate, grade, results


def one(spark, column, **values):
    rows = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for x in v]).alias(k) for k, v in values.items()])
    return rows.select(column.alias("x")).first()["x"]


def test_percentiles(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "g int, v double")
    assert rows.agg(stats.linear_percentile(F.col("v"), 0.5)).first()[0] == 2.5
    assert stats.index_percentile(rows, ["g"], "v", {"p": 0.5}).first()["p"] == 3.0


def test_bootstrap_brackets(spark):
    rows = spark.createDataFrame([(1, k, float(k < 8)) for k in range(10)], "g int, k int, v double")
    r = stats.bootstrap(rows, ["g"], "v", "k").first()
    assert r.lo < 0.8 < r.hi


def test_auc_counts_ties_half(spark):
    rows = spark.createDataFrame([(1, 1.0, True), (1, 1.0, False), (1, 2.0, True), (1, 0.0, False), (2, 1.0, True)], "g int, s double, ok boolean")
    got = {r.g: r.auc for r in stats.auc(rows, ["g"], "s", "ok").collect()}
    assert got[1] == 0.875 and got[2] != got[2]


def test_sum_or_null(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0)], "g int, v double")
    assert {r.g: r.s for r in rows.groupBy("g").agg(stats.sum_or_null(F.col("v")).alias("s")).collect()} == {1: None, 2: 3.0}


def test_spec_parsing(spark):
    spec = "first part with length of 2 and width 3. Second part, height about 4.5, length 9. Euler angles are [0, 0, -90.5]; translation vector (1, 2 , 3)."
    c = F.col("t")
    assert one(spark, text.stated_dims(c), t=spec) == [[2.0, 3.0, 4.5]]
    assert one(spark, text.stated_dims(c), t="none") == []
    assert one(spark, text.triples(c, text.EULER), t=spec) == [[0.0, 0.0, -90.5]]
    assert one(spark, text.triples(c, text.TRANSLATION), t=spec) == [[1.0, 2.0, 3.0]]
    assert one(spark, text.part_count(c), t=spec) == 2
    assert one(spark, text.part_count(c), t="") == 1
    assert one(spark, text.all_near_zero(text.triples(c, text.EULER)), t="Euler angles [0, 0, 0]") is True
    assert one(spark, text.numbers(c), t="a -2.5 and x3 7, 2.5 w1.5") == [2.5, 7.0]
    assert one(spark, text.spec_coverage(F.col("a"), F.col("b")), a="7 by 3", b="box(7, 3.001, 90, 5)") == pytest.approx(2 / 3)


def test_program_cleaning(spark):
    c = F.col("t")
    code = "import cadquery as cq\n\n\n\nr = cq.box(1)\nshow_object(r)\nr.exportStl('x')\nexporters.export(r)\n"
    assert one(spark, text.clean_program(c), t=code) == "import cadquery as cq\n\nr = cq.box(1)\n"
    assert one(spark, text.clean_program(c), t="print(1)") is None
    assert one(spark, text.clean_program(c), t="cq.部") is None
    assert one(spark, text.normalized_program(c), t=" a = 1 # x\n\n#y\n  b\n") == "a = 1\nb"
    assert one(spark, text.tidy(c), t="r = 1\nprint(r)\n# done\nr\n") == "r = 1\n"
    assert one(spark, text.last_program(c), t="<think>```python\ncq.a\n```</think>x ```\ncq.b\n``` y ```py\ncq.c\n``` z ```\nno\n```") == "cq.c\n"
    assert one(spark, text.last_program(c), t="try: import cadquery as cq\nr = 1  ") == "import cadquery as cq\nr = 1\n"
    assert one(spark, text.last_program(c), t="no code") is None


def test_names(spark):
    c = F.col("t")
    assert one(spark, text.stem(c), t="a/b/x.y.step") == "x.y"
    assert one(spark, text.stem(c), t="plain") == "plain"
    assert one(spark, text.file_name(c), t="train:00/1") == "train_00_1"
    assert one(spark, text.title(c, F.lit(2)), t="The final mounting plate will be. the final round bar is") == "Round bar (2 parts)"
    assert one(spark, text.token_estimate(c), t="abc") == 1
    assert one(spark, text.money(F.col("v")), v=0.005) == "$0.0050"


def test_predicates(spark):
    rows = spark.createDataFrame([("api: 500", 0), ("api: 500", 5), (None, 0), (results.NO_CODE, None)], "e string, n int")
    assert [r[0] for r in rows.select(results.infra_failed(F.col("e"), F.col("n"))).collect()] == [True, False, False, True]
    rows = spark.createDataFrame([(True, None), (True, False), (True, True), (None, True)], "r boolean, d boolean")
    assert [r[0] for r in rows.select(curate.passes_audit(F.col("r"), F.col("d"))).collect()] == [True, False, True, False]
    assert [r[0] for r in rows.select(curate.verified(F.lit(1), F.col("d"))).collect()] == [False, False, True, True]


def test_tiers(spark):
    assert one(spark, results.tiers(F.col("f"), F.col("p")), f=13, p=2) == ["all", "complex", "multi"]
    assert one(spark, results.exclusive_tier(F.col("f"), F.col("p")), f=13, p=2) == "multi"
    assert one(spark, results.tiers(F.lit(None).cast("int")), f=1) == ["all", "simple"]


def test_boxes(spark):
    pairs = lambda *p: spark.createDataFrame([p], "a array<double>, b array<double>")
    score = lambda a, b: geometry.aligned_box_iou(pairs(a, b), "a", "b").first()["iou_aligned"]
    plate = [0.6, 0.375, 0.075]
    assert score(plate, plate) == pytest.approx(1.0)
    assert score([0.6, 0.075, 0.375], plate) == pytest.approx(1.0)
    assert score([0.6, 0.375, 0.09], plate) == pytest.approx(0.075 / 0.09)
    assert score([x * 1.1 for x in plate], plate) == pytest.approx(0.7513, abs=1e-4)
    assert geometry.rotations(spark).count() == 24
    cloud = spark.createDataFrame([([[0.0, 0.0, 0.0], [1.0, 0.0, 0.0]], [[0.0, 0.0, 0.0], [3.0, 0.0, 0.0]])], "a array<array<double>>, b array<array<double>>")
    assert geometry.chamfer(cloud).first()["chamfer"] == pytest.approx((0.5 + 1.0) / 2 / 3)


def test_dims_and_masks(spark):
    f = geometry.dims_consistent(F.col("s"), F.col("e"))
    assert one(spark, f, s=[[1.0, 2.0, 3.0]], e=[3.0, 1.0, 2.01]) is True
    assert one(spark, f, s=[[1.0, 2.0, 3.0]], e=[3.0, 1.0, 2.5]) is False
    assert one(spark, f, s=[[1.0, 2.0, 3.0], [1.0, 2.0, 3.0]], e=[3.0, 1.0, 2.0]) is None
    assert one(spark, geometry.mask_iou(F.col("a"), F.col("b")), a=[True, False], b=[True, True]) == 0.5
    assert one(spark, geometry.mask_iou(F.col("a"), F.col("b")), a=[False], b=[False]) == 1.0
    assert one(spark, geometry.size_agreement(F.col("a"), F.col("b")), a=[1.0, 2.0, 4.0], b=[2.0, 2.0, 4.0]) == pytest.approx(2.5 / 3)


def test_rasters(spark):
    from assaykit.functions import rasters

    blank, dot, other = [[False] * 5] * 5, [[False] * 5] * 2 + [[False, True, False, False, False]] + [[False] * 5] * 2, [[False] * 5] * 2 + [[False, False, False, True, False]] + [[False] * 5] * 2
    df = spark.createDataFrame([(1, dot, other), (2, blank, blank), (3, dot, blank)], "id int, a array<array<boolean>>, b array<array<boolean>>")
    got = {r.id: (r.i, r.near, r.far) for r in df.select("id", rasters.silhouette_iou(F.col("a"), F.col("b")).alias("i"), rasters.edge_f1(F.col("a"), F.col("b"), 2.0).alias("near"), rasters.edge_f1(F.col("a"), F.col("b"), 1.0).alias("far")).collect()}
    assert got == {1: (0.0, 1.0, 0.0), 2: (1.0, 1.0, 1.0), 3: (0.0, 0.0, 0.0)}
    scored = rasters.scored(df.withColumn("e", F.array(F.lit(1.0), F.lit(0.0))).withColumn("x", F.array(F.lit(2.0), F.lit(0.0))), "a", "a", "a", "b", "e", "x")
    assert scored.where("id = 1").first()["render_score"] == pytest.approx(0.75)
    assert rasters.signals(scored, ["id"]).count() == 15


def test_typos_and_fits(spark):
    words = " ".join(["perturbation"] * 200) + "\n\nb one\n\nc two"
    df = spark.createDataFrame([(1, words), (2, None)], "id int, t string")
    a, b = ([r.x for r in df.select(text.with_typos(F.col("t"), F.col("id"), 1).alias("x")).collect()] for _ in range(2))
    assert a == b and a[0] != words and sorted(a[0]) == sorted(words) and a[1] == ""
    m = spark.sql("select array(struct('user' as role, 'abcde' as content)) as m, array('x.png') as i")
    assert m.select(text.fits(F.col("m"), F.col("i"), 258)).first()[0] is True and m.select(text.fits(F.col("m"), F.col("i"), 257)).first()[0] is False


def test_rewards(spark):
    rows = spark.createDataFrame([("x", True, 1.0), ("x", True, 0.5), ("x", False, None), (None, None, None)], "c string, r boolean, i double")
    assert [r[0] for r in rows.select(geometry.reward(F.col("c"), F.col("r"), F.col("i"))).collect()] == [1.5, 0.5, -0.2, -0.5]


def test_screen():
    for bad in ("import os", "x.__class__", "open('f')", "r.exportStl('x')", "from os import path", "getattr(a, 'b')"):
        assert "not allowed" in grade.screen(bad)
    assert grade.screen("r = (").startswith("SyntaxError")
    assert grade.screen("import math\nr = math.pi") is None


def _dies(code):
    import os

    os._exit(1)


def _hangs(code):
    import time

    time.sleep(30)


def test_isolated_runs():
    assert grade.run_isolated(_dies, "", 5)["error"] == "worker crashed"
    assert grade.run_isolated(_hangs, "", 0.3)["error"] == "timed out after 0.3s"
    assert grade.run_isolated(grade.box_program, "r = box(1, 2, 3)", 5)["extents"] == [1.0, 2.0, 3.0]
    assert grade.run_isolated(grade.box_program, "r = 1 / 0", 5)["error"].startswith("ZeroDivisionError")


def test_relabel_keeps_nulls_of_known_parts(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id int, n int")
    parts = spark.createDataFrame([(1, 9), (2, None)], "id int, n int")
    assert {r.id: r.n for r in results.relabel(rows, parts, "id", ["n"]).collect()} == {1: 9, 2: None, 3: 7}


def test_greedy_dedup_differs_from_two_distincts(spark):
    rows = spark.createDataFrame([(1, "s1", "g1"), (2, "s2", "g1"), (3, "s2", "g2"), (4, None, "g9"), (5, None, "g8")], "o int, a string, b string")
    assert sorted(r.o for r in curate.greedy_two_key_dedup(rows, "o", "a", "b").collect()) == [1, 3, 4]


def test_pooled_board(spark):
    rows = spark.createDataFrame(
        [("a", 1, "2024-01-01", "r1", True, True, 1.0, 1, 5, None, 3), ("a", 1, "2024-01-02", "r2", True, False, 2.0, 1, 5, None, 3), ("b", 1, "2024-01-01", "r1", True, True, 3.0, 1, 5, None, 3), ("b", 2, "2024-01-01", "r1", True, True, 3.0, 1, 20, "api: 1", 0)],
        "lane string, id int, created string, run string, runs boolean, success boolean, e2e_s double, n_parts int, n_faces int, error string, output_tokens int",
    )
    parts = spark.createDataFrame([(1, 1, 13)], "id int, n_parts int, n_faces int")
    board = {r.lane: r for r in results.pooled_board(rows, parts, ["lane"], common=True).collect()}
    assert board["a"].tiers["complex"].success == 0.0 and board["b"].tiers["all"].n == 1 and board["a"].latency_p50 == 2.0
