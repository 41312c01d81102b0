"""Helpers that no registered query calls, on hand-made inputs."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.functions import geometry, stats, text
from assaykit.operators import curate, grade, results, serve
from assaykit.sources import readers, versions, writers
from assaykit.streaming import folds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_titles_fall_back_to_a_noun(spark):
    t = lambda s, n=1: one(spark, text.title(F.lit(s), F.lit(n)))
    assert t("Draw a small round Washer with a hole") == "Small round washer"
    assert t("The final part is ready. A flat plate with ribs", 2) == "Flat plate (2 parts)"
    assert t("The final mounting bracket will be flat") == "Mounting bracket"
    assert t("nothing known here") == "Part"


def test_unknown_content_types_are_rejected(spark):
    parts = lambda *kinds: F.array(*[F.struct(F.lit(k).alias("type"), F.lit("t").alias("text")) for k in kinds])
    assert [p.type for p in one(spark, text.checked_parts(parts("text", "image")))] == ["text", "image"]
    with pytest.raises(Exception, match="unsupported content part type audio"):
        one(spark, text.checked_parts(parts("text", "audio")))


def test_text_helpers(spark):
    assert one(spark, text.short_error(F.lit("abcdef"), "api: ", 3)) == "api: abc"
    assert one(spark, text.is_fatal(F.lit("HTTP 402 now"))) is True and one(spark, text.is_fatal(F.lit(None).cast("string"))) is False
    assert one(spark, text.session_key(F.lit("fast"), F.lit(7))) == "cad-fast-3"
    shots = F.array(F.struct(F.lit("s").alias("spec"), F.lit(" x \n").alias("gold_code")))
    said = one(spark, text.chat_messages("sys", F.lit("spec"), shots))
    assert [(m.role, m.content) for m in said] == [("system", "sys"), ("user", "s"), ("assistant", "```python\nx\n```"), ("user", "spec")]
    assert [m.role for m in one(spark, text.chat_messages("sys", F.lit("spec")))] == ["system", "user"]


def test_serve_helpers(spark):
    assert one(spark, serve.short_label(F.lit("Big Model (high)"), [("Big ", "B"), (" (high)", "")])) == "BModel"
    assert one(spark, serve.backoff(F.lit(2), F.lit(0.5))) == 4.5 and one(spark, serve.backoff(F.lit(9), F.lit(0.5))) == 30.0
    per_step, left = serve.progress(F.lit(30.0), F.lit(10), F.lit(6))
    assert one(spark, per_step) == 5.0 and one(spark, left) == 20.0
    rows = spark.createDataFrame([(1, "a", "A", 3, 1, "simple"), (2, "b", "B", 9, 2, "medium"), (3, "c", "C", 4, 1, "simple")], "at int, id string, title string, n_faces int, n_parts int, tier string")
    assert [(r.group, r.id, r.label) for r in serve.picker_rows(rows).collect()] == [("simple (2)", "a", "A · 3 faces"), ("simple (2)", "c", "C · 4 faces"), ("medium (1)", "b", "B · 9 faces, 2 parts")]


def test_repeat_last_is_the_value_so_far(spark):
    rows = spark.createDataFrame([("k", 1, 5.0), ("k", 2, None), ("k", 3, 7.0), ("j", 1, None)], "k string, t int, v double")
    assert sorted((r.k, r.t, r.v) for r in results.repeat_last(rows, ["k"], "v").collect() if r.k == "k") == [("k", 1, 5.0), ("k", 2, 5.0), ("k", 3, 7.0)]


def test_sides_that_share_a_key_are_refused(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    with pytest.raises(ValueError, match="both sides have k 2"):
        curate.disjoint(a, b, "k")
    assert curate.disjoint(a, b.where("k = 3"), "k").count() == 2


def test_runs_documents_and_logs_go_to_disk_and_back(spark, tmp_path):
    import json

    rows = spark.createDataFrame([("L1", 0, None, 1, True, True, 0.95, 0.1, 1, 2.0, 0.5, 1, 0.01, 0.95)], "lane string, output_tokens_ int, error string, output_tokens int, runs boolean, success boolean, iou_aligned double, chamfer double, n_parts int, e2e_s double, ttft_s double, attempts int, cost_usd double, oracle_iou double")
    writers.commit_run(rows, results.lane_summary(rows, ["lane"]), str(tmp_path), "20260101-000000_x")
    run = f"{tmp_path}/20260101-000000_x"
    assert versions.table(spark, run, "results", form="json").count() == 1 and versions.table(spark, run, "report", form="text").count() >= 1
    size = readers.folder_size(spark, f"{tmp_path}/20260101-000000_x").first()
    assert size.n_files >= 3 and size.n_bytes > 0
    (tmp_path / "doc.json").write_text(json.dumps({"id": "a", "title": "T", "tier_faces": 3, "n_parts": 1, "bbox": [1.0], "spec": "s", "lanes": [{"lane": "x", "success": True}, {"lane": "y", "success": False}]}))
    assert [(r.id, r.lane, r.success) for r in readers.compare_documents(spark, f"{tmp_path}/doc.json", "lane: string, success: boolean").orderBy("lane").collect()] == [("a", "x", True), ("a", "y", False)]


def test_merged_streams_and_the_event_log(spark, tmp_path):
    for name in ("a", "b"):
        spark.createDataFrame([(name, 1.0)], "lane string, t double").write.parquet(f"{tmp_path}/{name}")
    streams = [spark.readStream.schema("lane string, t double").parquet(f"{tmp_path}/{name}") for name in ("a", "b")]
    folds.append_log(folds.merged(*streams), f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.lane for r in spark.read.parquet(f"{tmp_path}/log").collect()) == ["a", "b"]


def test_updates_keep_the_last_row_of_each_key(spark, tmp_path):
    for n, rows in enumerate(([("r", "L", 1, 0.5, "content", "ab")], [("r", "L", 2, 0.7, "content", "cde"), ("q", "L", 3, 0.1, "error", None)])):
        spark.createDataFrame(rows, "race string, lane string, seq long, t double, type string, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("race string, lane string, seq long, t double, type string, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {r.race: (r.status, r.chars, r.n_events) for r in folds.run_once(folds.fold_stream(stream), f"{tmp_path}/place", ["race", "lane"]).collect()}
    assert got == {"r": ("writing", 5, 2), "q": ("error", 0, 1)}


def test_bootstrap_draws_as_a_seeded_generator(spark):
    xs = [1.0] * 8 + [0.0] * 2
    rng = random.Random(0)
    means = sorted(sum(rng.choices(xs, k=10)) / 10 for _ in range(2000))
    got = stats.bootstrap(spark.createDataFrame([("g", x, k) for k, x in enumerate(xs)], "g string, x double, k int").repartition(3), ["g"], "x", "k").first()
    assert (got.lo, got.hi) == (means[50], means[1949]) and got.lo < 0.8 < got.hi


@pytest.mark.parametrize("draws", [7, 1 << 16])
def test_resampled_sums_are_those_of_choices(monkeypatch, draws):
    monkeypatch.setattr(stats, "DRAWS", draws)
    pick = random.Random(5)
    kinds = [[1.0], [float(pick.random() < 0.3) for _ in range(700)], [float(pick.randrange(-9, 9)) for _ in range(700)], [pick.gauss(0, 1e6) for _ in range(700)], [0.1] * 20, [1e300, -1e300, 1.0, 0.5], [math.inf, 1.0]]
    for seed, xs in enumerate(kinds):
        rng = random.Random(seed)
        assert list(stats.resampled_sums(np.array(xs), 40, seed)) == [sum(rng.choices(xs, k=len(xs))) for _ in range(40)]


def test_resamples_are_drawn_many_at_a_time():
    xs, rng = [1.0, 0.0] * 50_000, random.Random(0)
    began = time.process_time()
    one_by_one = [sum(rng.choices(xs, k=len(xs))) for _ in range(20)]
    middle = time.process_time()
    assert list(stats.resampled_sums(np.array(xs), 20, 0)) == one_by_one
    assert time.process_time() - middle < (middle - began) / 3


@pytest.mark.parametrize("ranges", [1, 4])
def test_ranks_and_areas_over_many_ranges(spark, monkeypatch, ranges):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), float(rng.randrange(40)), rng.random() < 0.4) for _ in range(500)] + [(None, 1.0, True), (None, 2.0, False), ("c", None, True)]
    df = spark.createDataFrame(rows, "g string, v double, ok boolean")
    monkeypatch.setattr(stats, "RANGE_ROWS", 1000 if ranges == 1 else 20)
    index = {r.g: (r.p, r.q) for r in stats.index_percentile(df, ["g"], "v", {"p": 0.5, "q": 0.95}).collect()}
    linear = {r.g: (r.p, r.q) for r in stats.linear_percentiles(df, ["g"], {"v": F.col("v"), "w": -F.col("v")}, {"p": ("v", 0.5), "q": ("v", 0.95), "low": ("w", 0.05)}).collect()}
    turned = {r.g: r.low for r in stats.linear_percentiles(df, ["g"], {"v": F.col("v"), "w": -F.col("v")}, {"low": ("w", 0.05)}).collect()}
    area = {r.g: r.auc for r in stats.auc(df.where("v is not null"), ["g"], "v", "ok").collect()}
    for g in ("a", "b", None):
        xs = sorted(v for k, v, _ in rows if k == g and v is not None)
        assert index[g] == tuple(xs[min(len(xs) - 1, int(q * len(xs)))] for q in (0.5, 0.95))
        want = [xs[int(p)] + (xs[min(int(p) + 1, len(xs) - 1)] - xs[int(p)]) * (p - int(p)) for p in (0.5 * (len(xs) - 1), 0.95 * (len(xs) - 1))]
        assert linear[g] == pytest.approx(want) and turned[g] == pytest.approx(-want[1])
        yes, no = [v for k, v, ok in rows if k == g and ok], [v for k, v, ok in rows if k == g and not ok]
        assert area[g] == pytest.approx(sum((y > n) + (y == n) / 2 for y in yes for n in no) / len(yes) / len(no))


def test_the_outermost_finding_comes_first():
    assert grade.screen("x = f(open('a').b)\nimport os") == "import of os is not allowed"


def test_extents_turn_with_the_axes(spark):
    assert one(spark, geometry.rotated_extents(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.array(F.lit(2), F.lit(0), F.lit(1)))) == [3.0, 1.0, 2.0]


def test_all_rows_are_asked_for_neighbours(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(curate, "QUERIES_HELD", 3)
    monkeypatch.setattr(curate, "ROWS_HELD", 7)
    x = np.random.default_rng(0).normal(size=(40, 5))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    got = {r.id: r.best for r in curate.nearest_vectors(df.where("id % 4 = 0"), df, "id", "v").collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = unit @ unit.T - 9 * np.eye(40)
    assert got.keys() == set(range(0, 40, 4)) and all(got[k] == pytest.approx(like[k].max()) for k in got)


def test_summary_of_no_answers_and_of_a_lane_without_a_name(spark):
    kinds = "lane string, error string, output_tokens int, runs boolean, success boolean, iou_aligned double, chamfer double, n_parts int, e2e_s double, ttft_s double, attempts int, cost_usd double, oracle_iou double"
    rows = [(None, None, 5, True, True, 0.96, 0.1, 1, float(k), None, 1, None, None) for k in range(1, 5)] + [("a", "api: 500", 0, None, None, None, None, 1, None, None, 1, None, None)]
    got = {r.lane: r for r in results.lane_summary(spark.createDataFrame(rows, kinds), ["lane"]).collect()}
    assert (got[None].n, got[None].latency_p50, got[None].median_chamfer, got[None].ttft_p50) == (4, 2.5, 0.1, None)
    assert (got["a"].n, got["a"].n_infra_failed, got["a"].latency_p95) == (0, 1, None)
    assert results.lane_summary(spark.createDataFrame([], kinds), ["lane"]).count() == 0


def test_bench_records_pass_without_filters(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, 9, 2)], "id int, n_faces int, n_parts int")
    assert curate.bench_records(rows).count() == 2 and [r.id for r in curate.bench_records(rows, min_faces=1).collect()] == [2]


def test_tokens_are_counted_by_a_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["", "Hello there, world", "é😀 " * 200, None]
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.token_count(F.col("t"), path).alias("n")).orderBy("k").collect()]
    assert got == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    rows = spark.sql("select array(named_struct('role', 'user', 'content', 'one two three')) as m, array('a.png') as i")
    n = len(library.encode("user\none two three", add_special_tokens=False).ids)
    fits = lambda most: rows.select(text.fits_tokens(F.col("m"), F.col("i"), most, path).alias("x")).first().x
    assert fits(256 + n) and not fits(256 + n - 1)
