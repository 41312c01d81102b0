"""Readers and writers on files written here."""

import json
import pathlib
import pickle
import random
import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaykit.sources import exports, json_files, readers, versions, writers


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "t": "é"}\n\n{"id": 2}\n')
    assert sorted((r.id, r.t) for r in readers.jsonl(spark, str(tmp_path / "x.jsonl"), "id int, t string").collect() if r.id) == [(1, "é"), (2, None)]
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl"), "id int, t string").count() == 0
    writers.jsonl(spark.range(2), str(tmp_path / "out"))
    writers.jsonl(spark.range(1), str(tmp_path / "out"), append=True)
    assert readers.jsonl(spark, str(tmp_path / "out"), "id long").count() == 3


def test_split_file(spark, tmp_path):
    def row(user, code, path):
        return {"messages": [{"role": "user", "content": user}, {"role": "assistant", "content": code}], "model_path": path}

    rows = [row("x\ndescription:\n length 1 width 2 height 3 ", "import cadquery as cq\nr=1", "a/m1.step"), row("y", "nothing", "a/m2.step"), row("z", "cq.box", None)]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    got = readers.split_file(spark, str(tmp_path / "s.json"), "test").orderBy("id").collect()
    assert [(r.id, r.source_id, r.spec) for r in got] == [("test:00000", "m1", "length 1 width 2 height 3"), ("test:00002", "test-2", "z")]
    assert got[0].stated_dims == [[1.0, 2.0, 3.0]] and got[0].identity_transforms
    assert readers.split_file(spark, str(tmp_path / "s.json"), "test", limit=2).count() == 1


def test_maps_runs_and_logs(spark, tmp_path):
    (tmp_path / "index.json").write_text('{"a": {"bbox": [1.0, 2.0]}, "b": {"bbox": null}}')
    assert {r.id: r.bbox for r in readers.id_map(spark, str(tmp_path / "index.json")).collect()} == {"a": [1.0, 2.0], "b": None}
    for run, extra in (("20240101-000000_x", {}), ("20240102-000000_x", {"modality": "image", "best_of": 8})):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "summary.json").write_text(json.dumps({"created": "2024-01-01T00:00:00", "n": 1, "lanes": [{"lane": "a", "success": 0.5}], **extra}))
    runs = readers.run_summaries(spark, str(tmp_path / "runs/*/summary.json"))
    assert sorted((r.run, r.modality, r.best_of, r.success) for r in runs.select("run", "modality", "best_of", "success").collect()) == [("20240101-000000_x", "text", 1, 0.5), ("20240102-000000_x", "image", 8, 0.5)]
    assert readers.newest_of_tags(runs, ["x"]).first()["run"] == "20240102-000000_x"
    (tmp_path / "log.txt").write_text('noise\n[sweep] a {"n": 1}\n[sweep] b {"n": 2}\n[sweep] a {"n": 3}\n\n')
    assert {r.name: r.n for r in readers.log_records(spark, str(tmp_path / "log.txt"), "sweep", "n int").collect()} == {"a": 3, "b": 2}
    assert readers.line_counts(spark, str(tmp_path / "log.txt")).first()["n"] == 4
    assert readers.newest_file(spark, str(tmp_path / "log.txt")).count() == 1


def test_checkpoints_and_images(spark, tmp_path):
    for name in ("checkpoint-5", "checkpoint-20"):
        (tmp_path / "run" / name).mkdir(parents=True)
        (tmp_path / "run" / name / "w.bin").write_bytes(b"x")
    assert readers.checkpoints(spark, str(tmp_path / "run")).first()["folder"].endswith("checkpoint-20")
    (tmp_path / "i.png").write_bytes(b"\x89PNG")
    assert readers.images(spark, str(tmp_path)).first()["data_url"] == "data:image/png;base64,iVBORw=="


def test_mesh(spark, tmp_path):
    triangle = struct.pack("<12fH", *([0.0] * 3), 0, 0, 0, 1, 0, 0, 0, 2, 3, 0)
    (tmp_path / "m.stl").write_bytes(b" " * 80 + struct.pack("<I", 1) + triangle)
    r = readers.meshes(spark, str(tmp_path / "m.stl")).first()
    assert (r.n_triangles, r.low, r.high) == (1, [0, 0, 0], [1, 2, 3])


def test_events_and_rows(spark, tmp_path):
    raw = spark.createDataFrame([("r", 'data: {"type": "a"}\n\ndata: {"type": "b"}\n\n: ping')], "race string, body string")
    assert [(r.seq, r.type) for r in readers.server_sent_events(raw, "body", "type string").orderBy("seq").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "t.jsonl").write_text(json.dumps({"images": ["a.png", "/b.png"], "prompt": [{"role": "user", "content": "hi"}], "completion": []}))
    r = readers.training_rows(spark, str(tmp_path / "t.jsonl"), "/data").first()
    assert r.images == ["/data/a.png", "/b.png"] and r.prompt[0].content[0].text == "hi"


def test_staged_result(spark, tmp_path):
    (tmp_path / "job").mkdir()
    for name, n in (("b_eval.json", 2), ("a_eval.json", 1), ("a_log.json", 3)):
        (tmp_path / "job" / name).write_text(json.dumps({"n": n}))
    assert [r.n for r in readers.staged_result(spark, str(tmp_path), "_eval.json", "n int").collect()] == [1]


def test_upsert_swaps_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), "id", path)
    writers.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), "id", path)
    assert {r.id: r.v for r in versions.table(spark, path).collect()} == {1: "a", 2: "c", 3: "d"}
    assert {r.id: r.v for r in versions.table(spark, path, version=1).collect()} == {1: "a", 2: "b"}
    maps = spark.sql("select map('a', 1, 'b', 2) as o, map('b', 3) as n")
    assert maps.select(writers.merged_stats(F.col("o"), F.col("n")).alias("m")).first()["m"] == {"a": 1, "b": 3}


def test_documents_and_keys(spark, tmp_path):
    rows = spark.createDataFrame([("x:1", 2, b"png"), ("y/2", 3, None)], "id string, n int, sheet binary")
    writers.documents(rows, "id", str(tmp_path / "docs"), {"sheet": ("sheet", ".png")})
    folder = versions.part(spark, str(tmp_path / "docs"), "files")
    found = {str(p.relative_to(folder)): p.read_bytes() for p in pathlib.Path(folder).rglob("*") if p.is_file() and p.suffix != ".crc"}
    assert found == {"compare/x_1.json": b'{"id":"x:1","n":2}', "compare/y_2.json": b'{"id":"y/2","n":3}', "sheet/x_1.png": b"png"}
    made = writers.content_addressed(spark.createDataFrame([(b"a",), (b"a",)], "content binary"), "content").collect()
    assert [r.key for r in made] == ["86f7e437faa5a7fc"]


def test_pixels(spark, tmp_path):
    def png(name, kind, rows):
        chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
        lines = b"".join(b"\0" + bytes(r) for r in rows)
        width = len(rows[0]) // {0: 1, 2: 3, 6: 4}[kind]
        (tmp_path / name).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))

    png("rgb.png", 2, [[1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12]])
    png("rgba.png", 6, [[1, 2, 3, 255, 4, 5, 6, 255]])
    png("grey.png", 0, [[9, 8]])
    got = {r.path.rsplit("/", 1)[1]: (r.height, r.width, list(r.rgb)) for r in readers.pixels(spark, str(tmp_path)).collect()}
    assert got == {"rgb.png": (2, 2, list(range(1, 13))), "rgba.png": (1, 2, [1, 2, 3, 4, 5, 6]), "grey.png": (1, 2, [9, 9, 9, 8, 8, 8])}


def pieces(raw, step):
    """The records that byte ranges of that size give, with their positions."""
    f, inside, depth, pos, out = pa.BufferReader(raw), 0, 0, 0, []
    for at in range(0, len(raw), step):
        end = min(at + step, len(raw))
        out += enumerate(json_files.records(f, at, end, len(raw), inside, depth), pos)
        odd, states = json_files.noted(f, at, end)
        moved, separators = states[inside]
        pos, inside, depth = pos + separators.get(1 - depth, 0), (inside + odd) % 2, depth + moved
    return out


@pytest.mark.parametrize("chunk", [1, 5, 64, 4096])
def test_any_byte_range_finds_its_records(monkeypatch, chunk):
    monkeypatch.setattr(json_files, "CHUNK", chunk)
    pick = random.Random(chunk)

    def value(depth=0):
        k = pick.random()
        if depth < 3 and k < 0.3:
            return {pick.choice(["a", 'b"\\', "[x", ","]): value(depth + 1) for _ in range(pick.randint(0, 3))}
        if depth < 3 and k < 0.5:
            return [value(depth + 1) for _ in range(pick.randint(0, 3))]
        return pick.choice([1, None, "", '"', "\\", '\\\\"', "[{,", "é", "x" * 50, True])

    for n in range(60):
        said = [value() for _ in range(pick.randint(0, 8))] if n % 2 else {f'{k}"{{': value() for k in range(pick.randint(0, 8))}
        raw = json.dumps(said, ensure_ascii=n % 3 == 0, indent=pick.choice([None, 1])).encode() + b"\n"
        for step in (1, 3, 7, 50, 1000):
            out = pieces(raw, step)
            assert [p for p, _ in out] == list(range(len(said)))
            assert said == ([json.loads(r) for _, r in out] if n % 2 else json.loads("{" + ",".join(r.decode() for _, r in out) + "}"))


def test_a_file_that_ends_inside_a_record_is_told():
    with pytest.raises(ValueError, match="inside a record"):
        pieces(b'[{"a": 1}, {"b": "x', 4)


def test_split_files_in_many_ranges(spark, tmp_path):
    rows = [{"messages": [{"role": "user", "content": f"[{k}, \"{{"}, {"role": "assistant", "content": "cq.box" if k % 3 else "none"}], "model_path": None} for k in range(200)]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    whole, many = (readers.split_file(spark, str(tmp_path / "s.json"), "t", range_bytes=n) for n in (1 << 20, 700))
    assert many.rdd.getNumPartitions() > 10 and sorted(map(repr, many.collect())) == sorted(map(repr, whole.collect()))
    assert {r.id for r in many.collect()} == {f"t:{k:05d}" for k in range(200) if k % 3}
    (tmp_path / "m.json").write_text(json.dumps({f"k{k}": {"bbox": [k, 0.5]} for k in range(100)}))
    assert {r.id: r.bbox for r in readers.id_map(spark, str(tmp_path / "m.json"), range_bytes=64).collect()} == {f"k{k}": [k, 0.5] for k in range(100)}
    (tmp_path / "none.json").write_text(" [ ]")
    assert readers.split_file(spark, str(tmp_path / "none.json"), "t").count() == 0


def test_positions_go_on_from_file_to_file(spark, tmp_path):
    said = {"a": [{"k": 'x,[\\"' * n} for n in range(9)], "b": [], "c": [[1, [2]], "]", {}], "d": [7]}
    for name, rows in said.items():
        (tmp_path / f"{name}.json").write_text("[ \n\n ]" if not rows else json.dumps(rows))
    for step in (7, 1000):
        rows = sorted((r.pos, json.loads(r.value)) for r in json_files.read(spark, str(tmp_path), step, through=True).collect())
        assert rows == list(enumerate(x for rows in said.values() for x in rows))
    df = spark.range(500).repartition(3).select(F.to_json(F.struct("id")).alias("value"))
    json_files.write(df, str(tmp_path / "out"))
    assert sorted(r.pos for r in json_files.read(spark, str(tmp_path / "out"), 900, through=True).collect()) == list(range(500))


def test_a_range_reads_little_beyond_its_end():
    class Counted(pa.BufferReader):
        n = 0

        def read_at(self, n, at):
            Counted.n += n
            return super().read_at(n, at)

    raw = json.dumps([{"k": "x" * 900}] * 20_000).encode()
    f = Counted(raw)
    assert sum(1 for _ in json_files.records(f, 0, 1 << 20, len(raw), 0, 0)) > 1_000
    assert Counted.n < (1 << 20) + (1 << 17)
    # a task is sent its own range, not the numbers of all
    assert len(pickle.dumps(json_files._Records({"states": "x" * 100_000}))) < 1_000


def test_the_size_of_ranges_follows_the_files(monkeypatch):
    for total, size in ((1_000, 1 << 20), (1 << 30, 8 << 20), (1 << 40, json_files.RANGE)):
        monkeypatch.setattr(json_files, "files", lambda path: [("a", total - 1), ("b", 1)])
        assert json_files.range_for("x", 1 << 20) == size


def test_json_parts_are_written_whole_or_not(spark, tmp_path):
    df = spark.range(50).repartition(3).select(F.to_json(F.struct("id")).alias("value"))
    json_files.write(df, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*.json"))) == 3 and not list((tmp_path / "out").glob(".attempt*"))
    assert sorted(json.loads(r.value)["id"] for r in json_files.read(spark, str(tmp_path / "out"), 40).collect()) == list(range(50))
    broken = spark.range(50).repartition(3).select(F.expr("if(id = 7, raise_error('stop'), string(id))").alias("value"))
    with pytest.raises(Exception, match="stop"):
        json_files.write(broken, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or not [p for p in (tmp_path / "bad").iterdir() if not p.name.startswith(".")]


def test_a_stopped_writer_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    row = lambda k, v: spark.createDataFrame([(k, v)], "id int, v string")
    writers.upsert(row(1, "a"), "id", path)

    def stop(*_):
        raise RuntimeError("killed")

    for step in ("publish", "commit"):
        with monkeypatch.context() as m:
            if step == "publish":  # data is written, nothing is published
                m.setattr(versions, "publish", stop)
                with pytest.raises(RuntimeError):
                    writers.upsert(row(1, "b"), "id", path)
            else:  # a task fails while data is written
                bad = spark.range(3).select(F.lit(1).alias("id"), F.expr("if(id = 1, raise_error('disk'), 'c')").alias("v"))
                with pytest.raises(Exception, match="disk"):
                    writers.upsert(bad, "id", path)
        assert [(r.id, r.v) for r in versions.table(spark, path).collect()] == [(1, "a")] and versions.versions(spark, path) == [1]
    writers.upsert(row(2, "d"), "id", path)
    assert {r.id: r.v for r in versions.table(spark, path).collect()} == {1: "a", 2: "d"}
    gone = versions.vacuum(spark, path)
    assert gone and all(n.startswith("data-") for n in gone) and versions.table(spark, path, version=1).count() == 1


def test_of_two_writers_each_is_merged(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    row = lambda k, v: spark.createDataFrame([(k, v)], "id int, v string")
    publish, calls = versions.publish, []

    def late(spark, path, parts, after):
        if not calls:  # another writer comes in between
            calls.append(after)
            writers.upsert(row(9, "other"), "id", path)
        return publish(spark, path, parts, after)

    monkeypatch.setattr(versions, "publish", late)
    assert writers.upsert(row(1, "mine"), "id", path) == 2
    assert {r.id: r.v for r in versions.table(spark, path).collect()} == {9: "other", 1: "mine"}
    with pytest.raises(versions.Conflict):
        publish(spark, path, {"data": "x"}, 1)
    with pytest.raises(FileNotFoundError):
        versions.table(spark, str(tmp_path / "none"))


def test_exported_files_are_read_by_name_and_not_listed(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"part:{k}", "x" * 10, "y" if k % 2 else None) for k in range(50)], "id string, v string, sheet string")
    writers.documents(rows, "id", f"file://{tmp_path}/docs", {"sheet": ("sheet", ".svg")})
    monkeypatch.setattr(exports, "BATCH_BYTES", 100)
    found = writers.written(spark, f"file://{tmp_path}/docs")
    got = {r.name: bytes(r.content) for r in found.collect()}
    assert len(got) == 75 and got["sheet/part_3.svg"] == b"y" and got["compare/part_2.json"] == b'{"id":"part:2","v":"xxxxxxxxxx"}'
    assert all(f.endswith(".parquet") for f in found.inputFiles())  # the table of names is all that Spark lists
