"""Versioned folders: data is written beside what is there, and one atomic rename of a manifest publishes it.

A folder holds `_versions/00000001.json`, ... and the data folders they name. Readers take the manifest with
the highest number, so they find the version before or the one after, whole, and never a mixture,
whenever a writer is stopped. A number is given once: of two writers that publish the same one
the second is refused and starts again from the version that won. Data that no manifest names is
left by stopped writers; vacuum() takes it away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_versions"


class Conflict(Exception):
    """Another writer has published this version."""


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, store = _at(spark, path)
    return [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers that are published, in order."""
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/{MANIFESTS}") if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version (the newest, if none is given) holds: its number and the folder of each part; None without one."""
    known = versions(spark, path)
    if not known:
        return None
    where, store = _at(spark, f"{path}/{MANIFESTS}/{version or known[-1]:08d}.json")
    stream = store.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, parts: dict[str, str], after: int) -> int:
    """Make version after + 1 of the named folders; raises Conflict if it is there."""
    version = after + 1
    hidden, store = _at(spark, f"{path}/{MANIFESTS}/.{uuid.uuid4().hex}")
    shown, _ = _at(spark, f"{path}/{MANIFESTS}/{version:08d}.json")
    stream = store.create(hidden)
    stream.write(json.dumps({"version": version, "parts": parts}).encode())
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    try:  # unlike a file system's, a context's rename never replaces what is there
        context.rename(hidden, shown, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        store.delete(hidden, False)
        if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
            raise Conflict(f"{path}: version {version}") from None
        raise
    return version


def commit(spark: SparkSession, path: str, make: Callable[[dict | None], dict[str, Callable[[str], None]]], tries: int = 5) -> int:
    """Write and publish a version. make(newest manifest or None) gives a writer for each part, which gets the folder to write.

    If another writer is first, all is made again from its version.
    """
    for left in reversed(range(tries)):
        was = manifest(spark, path)
        folder = f"data-{uuid.uuid4().hex}"
        writers = make(was)
        for name, write in writers.items():
            write(f"{path}/{folder}/{name}")
        try:
            return publish(spark, path, {name: f"{folder}/{name}" for name in writers}, was["version"] if was else 0)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be positive")


def part(spark: SparkSession, path: str, name: str = "data", version: int | None = None) -> str:
    """The folder of a part."""
    found = manifest(spark, path, version)
    if found is None:
        raise FileNotFoundError(f"{path} has no version")
    return f"{path}/{found['parts'][name]}"


def table(spark: SparkSession, path: str, name: str = "data", version: int | None = None, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).load(part(spark, path, name, version))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the manifests before the last `keep` and the data folders that no other names; gives their names. No writer may be under way."""
    known = versions(spark, path)
    held = {f.split("/")[0] for v in known[-keep:] for f in manifest(spark, path, v)["parts"].values()}
    gone = [f"{MANIFESTS}/{v:08d}.json" for v in known[:-keep]] + [n for n in _names(spark, path) if n.startswith("data-") and n not in held]
    for name in gone:
        where, store = _at(spark, f"{path}/{name}")
        store.delete(where, True)
    return gone
