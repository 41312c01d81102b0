"""JSON arrays and maps in single files of any size, read in byte ranges and written in parts.

A range may begin anywhere, inside a string or many levels deep, so one pass notes for each range
what it would do from either start: whether quotes leave it inside a string, how far the depth moves,
and how many separators it has at each depth. A scan over these few numbers gives every range its
true start and the position of its first record; a second pass reads the records that begin in each range. Backslashes
before a range are looked up in the bytes before it. No file is ever whole in one task.

Files are opened by pyarrow's file systems, so paths are local (or on a shared mount), hdfs, s3 or gs.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE = 64 << 20  # bytes of a task
CHUNK = 4 << 20  # bytes in memory at a time
AHEAD = 64 << 10  # bytes read at first beyond a range, to the end of its last record
ROWS = 1_000
KIND, MOVE = np.zeros(256, np.uint8), np.array([0, 1, -1, 0])  # 1: opens, 2: closes, 3: comma
KIND[list(b"{[}],")] = 1, 1, 2, 2, 3


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the .json files of a folder by name."""
    where, inner = store(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = where.get_file_info(fs.FileSelector(inner, recursive=True))
    head = path[: len(path) - len(inner.rstrip("/"))] if path.endswith(inner) else path.split("://")[0] + "://"
    return sorted((head + x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name.endswith(".json") and "/." not in x.path)


def range_for(path: str, least: int, tasks: int = 128) -> int:
    """Bytes of a range that give the files of path about as many ranges as `tasks`: `least` or more, RANGE at most."""
    return min(max(least, sum(size for _, size in files(path)) // tasks), max(least, RANGE))


def quotes(b: np.ndarray, run: int) -> tuple[np.ndarray, int]:
    """Places of quotes that no backslash escapes, and the number of backslashes at the end. run: those right before."""
    place, slash = np.flatnonzero(b == ord('"')), np.flatnonzero(b == ord("\\"))
    before = np.where(place == 0, run, 0)
    if not len(slash):
        return place[before % 2 == 0], 0 if len(b) else run
    each = np.arange(len(slash))
    first = np.maximum.accumulate(np.where(np.diff(slash, prepend=-2) > 1, each, 0))
    length = each - first + 1 + np.where(slash[first] == 0, run, 0)  # of the run up to each backslash
    last = np.searchsorted(slash, place) - 1
    before = np.where((last >= 0) & (slash[last] == place - 1), length[last], before)
    return place[before % 2 == 0], int(length[-1]) if slash[-1] == len(b) - 1 else 0


def brackets(b: np.ndarray, quote: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, depth after it relative to the start, separator?) of brackets and commas outside strings, for a start outside and inside one.
    Opening brackets begin a record too."""
    place = np.flatnonzero(KIND[b])
    odd, kind = np.searchsorted(quote, place) % 2, KIND[b[place]]
    return [(place[x], np.cumsum(MOVE[kind[x]]), kind[x] != 2) for x in (odd == 0, odd == 1)]


def slashes_before(f, at: int) -> int:
    n = 0
    while at - n > 0:
        take = min(4096, at - n)
        back = f.read_at(take, at - n - take)
        n += len(back) - len(back.rstrip(b"\\"))
        if not back.endswith(b"\\" * take):
            break
    return n


def noted(f, start: int, end: int) -> tuple[int, list[tuple[int, dict]]]:
    """Whether quotes leave a range on the other side, and for a start outside and inside a string: the depth's move and the separators at each depth."""
    run, odd, found = slashes_before(f, start), 0, [[0, Counter()], [0, Counter()]]
    for at in range(start, end, CHUNK):
        b = np.frombuffer(f.read_at(min(CHUNK, end - at), at), np.uint8)
        quote, run = quotes(b, run)
        told = brackets(b, quote)
        for inside, state in enumerate(found):
            _, depth, begins = told[(inside + odd) % 2]
            for level, n in zip(*np.unique(depth[begins] + state[0], return_counts=True)):
                state[1][int(level)] += int(n)
            state[0] += int(depth[-1]) if len(depth) else 0
        odd = (odd + len(quote)) % 2
    return odd, [(d, dict(c)) for d, c in found]


def written(f, start: int, end: int) -> int:
    """The number of bytes of a range that are no white space."""
    return sum(len(f.read_at(min(CHUNK, end - at), at).translate(None, b" \t\r\n")) for at in range(start, end, CHUNK))


def records(f, start: int, end: int, size: int, inside: int, depth: int) -> Iterator[bytes]:
    """The records whose separator lies in [start, end), each read to its end."""
    run, at, held, ahead = slashes_before(f, start), start, None, AHEAD
    while at < size and (held is not None or at < end):
        if at < end:
            raw = f.read_at(min(CHUNK, end - at), at)
        else:
            raw = f.read_at(min(CHUNK, ahead, size - at), at)
            ahead *= 2
        b = np.frombuffer(raw, np.uint8)
        quote, run = quotes(b, run)
        place, level, begins = brackets(b, quote)[inside]
        top = (level + depth == 1) & begins | (level + depth == 0) & ~begins
        first = 0
        for k, opens in zip(place[top].tolist(), begins[top].tolist()):
            if held is not None:
                held.append(raw[first:k])
                if (said := b"".join(held)).strip():
                    yield said
                held = None
            if opens and at + k >= end:
                return
            held, first = ([], k + 1) if opens else (None, k + 1)
        if held is not None:
            held.append(raw[first:])
        inside = (inside + len(quote)) % 2
        depth += int(level[-1]) if len(level) else 0
        at += len(raw)
    if held is not None:
        raise ValueError("a JSON file ends inside a record")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int
    inside: int = 0
    depth: int = 0
    pos: int = 0


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        if "states" in self.options:
            return [Range(*x) for x in json.loads(self.options["states"])]
        step = int(self.options.get("range", RANGE))
        return [Range(path, at, min(at + step, size), size) for path, size in files(self.options["path"]) for at in range(0, size, step)] or [Range("", 0, 0, 0)]


class _Notes(_Reader):
    def read(self, partition):
        if partition.path:
            where, inner = store(partition.path)
            with where.open_input_file(inner) as f:
                odd, states = noted(f, partition.start, partition.end)
                few = sum(n for _, levels in states for n in levels.values()) <= 1  # so it may be of an empty file
                said = written(f, partition.start, partition.end) if few else None
            yield partition.path, partition.start, partition.end, partition.size, odd, json.dumps(states), said


class _Records(_Reader):
    def __getstate__(self):
        return {}  # a task gets its own range, not the numbers of all

    def read(self, partition):
        schema = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("value", pa.string())])
        where, inner = store(partition.path)
        with where.open_input_file(inner) as f:
            pos, waiting, n = partition.pos, [], 0
            for said in records(f, partition.start, partition.end, partition.size, partition.inside, partition.depth):
                waiting.append(said)
                n += len(said)
                if len(waiting) == ROWS or n >= CHUNK:
                    yield self.batch(schema, partition.path, pos, waiting)
                    pos, waiting, n = pos + len(waiting), [], 0
            if waiting:
                yield self.batch(schema, partition.path, pos, waiting)

    def batch(self, schema, path, pos, said):
        return pa.RecordBatch.from_arrays([pa.array([path] * len(said)), pa.array(range(pos, pos + len(said)), pa.int64()), pa.array(said, pa.binary()).cast(pa.string())], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """Each attempt writes a hidden file of its own; commit gives those of finished tasks their names."""

    def __init__(self, options):
        self.path = options["path"]
        self.edges = "{}" if options.get("kind") == "map" else "[]"

    def write(self, iterator):
        task = TaskContext.get()
        name = f".attempt-{task.partitionId()}-{uuid.uuid4().hex}"
        where, inner = store(self.path)
        where.create_dir(inner, recursive=True)
        rows = 0
        with where.open_output_stream(f"{inner}/{name}") as f:
            for batch in iterator:
                for at in range(0, batch.num_rows, ROWS):
                    said = batch.column(0).slice(at, ROWS).to_pylist()
                    f.write(f"{',' if rows else self.edges[0]}\n{',\n'.join(map(str, said))}".encode())
                    rows += len(said)
            if rows:
                f.write(f"\n{self.edges[1]}\n".encode())
        return Written(task.partitionId(), name, rows)

    def commit(self, messages):
        where, inner = store(self.path)
        for m in messages:
            if m is not None and m.rows:
                where.move(f"{inner}/{m.name}", f"{inner}/part-{m.partition:05d}.json")
        self.clear(where, inner)

    def abort(self, messages):
        self.clear(*store(self.path))

    def clear(self, where, inner):
        for x in where.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if x.base_name.startswith(".attempt-"):
                where.delete_file(x.path)


class JsonNotes(DataSource):
    @classmethod
    def name(cls):
        return "json_notes"

    def schema(self):
        return "path string, start long, end long, size long, odd int, states string, said long"

    def reader(self, schema):
        return _Notes(self.options)


class JsonRecords(DataSource):
    @classmethod
    def name(cls):
        return "json_records"

    def schema(self):
        return "file string, pos long, value string"

    def reader(self, schema):
        return _Records(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE, through: bool = False) -> DataFrame:
    """file, pos and value (its text) of each record of a JSON array or map file, or of all such files of a folder.

    Of a map, a record is a `"key": value` entry. pos is the place in the file or, with through, in all files in the order of their names.
    The driver holds some numbers for each range.
    """
    for source in (JsonNotes, JsonRecords):
        spark.dataSource.register(source)
    notes = spark.read.format("json_notes").option("path", path).option("range", range_bytes).load().collect()
    ranges, first = [], 0
    for name, found in groupby(sorted(notes, key=lambda r: (r.path, r.start)), lambda r: r.path):
        inside, depth, pos, told = 0, 0, first, []
        for r in found:
            ranges.append((name, r.start, r.end, r.size, inside, depth, pos))
            moved, separators = json.loads(r.states)[inside]
            pos += separators.get(str(1 - depth), 0)
            inside, depth = (inside + r.odd) % 2, depth + moved
            told.append(r.said)
        if through and (None in told or sum(told) > 2):  # else an empty file: its brackets alone
            first = pos
    if not ranges:
        return spark.createDataFrame([], JsonRecords({}).schema())
    return spark.read.format("json_records").option("states", json.dumps(ranges)).load()


def write(df: DataFrame, path: str, kind: str = "array") -> None:
    """One JSON array (or map) file for each partition of df's only column, which holds the records' text. path must be new."""
    df.sparkSession.dataSource.register(JsonRecords)
    (name,) = df.columns
    df.select(F.col(name).cast("string")).write.format("json_records").option("path", path).option("kind", kind).mode("append").save()
