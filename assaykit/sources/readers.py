"""Sources: JSON lines, arrays and maps, run folders, logs, event streams, images and meshes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from . import json_files


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped and a missing file is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("x")).schema["x"].dataType if isinstance(schema, str) else schema)


RAW = "struct<messages: array<struct<role: string, content: string>>, model_path: string>"


def split_file(spark: SparkSession, path: str, split: str, limit: int | None = None, range_bytes: int = json_files.RANGE) -> DataFrame:
    """Records of one JSON-array file of any size; ids hold the position before any row is dropped, and limit comes first."""
    rows = json_files.read(spark, path, range_bytes).select("pos", F.from_json("value", RAW).alias("row"))
    if limit is not None:
        rows = rows.where(F.col("pos") < limit)
    said = lambda role: F.get(F.filter("row.messages", lambda m: m["role"] == role), F.lit(0))["content"]
    spec, code = text.spec_text(said("user")), text.clean_program(said("assistant"))
    name = F.coalesce(text.stem(F.col("row.model_path")), F.concat(F.lit(f"{split}-"), F.col("pos").cast("string")))
    made = rows.select(F.format_string(f"{split}:%05d", "pos").alias("id"), name.alias("source_id"), F.lit(split).alias("split"), spec.alias("spec"), code.alias("gold_code")).where("gold_code is not null")
    turned, moved = text.triples(F.col("spec"), text.EULER), text.triples(F.col("spec"), text.TRANSLATION)
    parsed = made.withColumns({"n_parts": text.part_count(F.col("spec")), "stated_dims": text.stated_dims(F.col("spec")), "eulers": turned, "translations": moved})
    return parsed.withColumn("identity_transforms", text.all_near_zero(F.concat("eulers", "translations")))


def id_map(spark: SparkSession, path: str, value: str = "struct<bbox: array<double>>", range_bytes: int = json_files.RANGE) -> DataFrame:
    """id and the fields of its struct from one JSON object file of any size."""
    entries = json_files.read(spark, path, range_bytes).select(F.concat(F.lit("{"), "value", F.lit("}")).alias("value"))
    rows = entries.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("id", "v"))
    return rows.select("id", "v.*")


LANE_SUMMARY = (
    "lane string, label string, model string, reasoning_effort string, n int, n_infra_failed int, success double, success_ci95 array<double>, success_iou95 double, run_rate double, "
    "mean_iou_aligned double, median_chamfer double, single_part struct<n: int, success: double>, multi_part struct<n: int, success: double>, latency_p50 double, latency_p95 double, "
    "ttft_p50 double, output_tokens_mean double, attempts_mean double, oracle_success double, cost_per_1k_usd double, cost_note string, wall_s double"
)


def _fields(schema: str) -> list[str]:
    """The top-level fields of a schema text."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """One row for each run and lane of run folders' summary.json; fields that older runs lack get their defaults."""
    lanes = ", ".join(x.replace(" ", ": ", 1) for x in _fields(LANE_SUMMARY))
    kind = f"data string, modality string, created string, source string, aborted string, n int, shots int, retries int, best_of int, seed int, lanes array<struct<{lanes}>>"
    raw = spark.read.schema(kind).option("multiLine", True).json(path).withColumn("run", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))
    made = raw.withColumn("modality", F.coalesce("modality", F.lit("text"))).withColumn("best_of", F.coalesce("best_of", F.lit(1)))
    return made.select("run", "data", "modality", F.to_timestamp("created").alias("created"), "aborted", F.col("n").alias("n_parts"), "shots", "retries", "best_of", "seed", F.explode("lanes").alias("lane")).select("*", "lane.*")


def newest_of_tags(runs: DataFrame, tags: list[str], run: str = "run") -> DataFrame:
    """The newest run folder `<time>_<tag>` of each tag."""
    tag = F.regexp_extract(run, r"^\d{8}-\d{6}_(.+)$", 1)
    return runs.select(run, tag.alias("tag")).where(F.col("tag").isin(tags)).groupBy("tag").agg(F.max(run).alias(run))


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """n_files and n_bytes below a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """path of the file that was changed last."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def log_records(spark: SparkSession, path: str, label: str, schema: str) -> DataFrame:
    """name and fields of the lines `[label] name {json}`; the last line of a name counts."""
    lines = spark.read.text(path).withColumn("at", F.struct("_metadata.file_path", F.monotonically_increasing_id().alias("n")))
    found = lines.select("at", F.regexp_extract("value", rf"\[{label}\] (\S+) (\{{.*\}})", 1).alias("name"), F.regexp_extract("value", rf"\[{label}\] (\S+) (\{{.*\}})", 2).alias("json")).where("name <> ''")
    return found.groupBy("name").agg(F.max_by("json", "at").alias("json")).select("name", F.from_json("json", schema).alias("v")).select("name", "v.*")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """file and its number of lines that aren't blank."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.groupBy(text.stem(F.col("_metadata.file_path")).alias("file")).agg(F.count("*").alias("n"))


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """The newest checkpoint of each parent folder; a folder without a step number comes last."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")).distinct()
    step = F.regexp_extract("folder", r"checkpoint-(\d+)$", 1)
    stepped = files.withColumn("step", F.when(step == "", F.lit(10**9)).otherwise(F.nullif(step, F.lit("")).cast("long"))).withColumn("parent", F.regexp_extract("folder", r"^(.*)/[^/]+$", 1))
    return stepped.groupBy("parent").agg(F.max_by("folder", F.struct("step", "folder")).alias("folder"), F.max("step").alias("step"))


def server_sent_events(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """Events of texts in the event-stream format: blocks between blank lines, each `data: {json}`."""
    blocks = raw.select(*[c for c in raw.columns if c != column], F.posexplode(F.split(column, "\n\n")).alias("seq", "_b")).where(F.col("_b").startswith("data: "))
    return blocks.withColumn("_e", F.from_json(F.substr("_b", F.lit(7)), schema)).select(*[c for c in raw.columns if c != column], "seq", "_e.*")


def compare_documents(spark: SparkSession, path: str, lane_schema: str) -> DataFrame:
    """One row for each document and lane."""
    docs = spark.read.schema(f"id string, title string, tier_faces int, n_parts int, bbox array<double>, spec string, lanes array<struct<{lane_schema}>>").option("multiLine", True).json(path)
    own = ["id", "title", "tier_faces", "n_parts", "bbox"]
    return docs.select(*own, F.explode("lanes").alias("_l")).select(*own, "_l.*")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path and data_url of PNG files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64("content"), "[\r\n]", "")).alias("data_url"))


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width and rgb (height x width x 3 bytes) of images, by Spark's own image source; grey and alpha become RGB."""

    @F.pandas_udf("binary")
    def turned(data: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for x, n in zip(data, channels):
            bands = np.frombuffer(x, np.uint8).reshape(-1, n)
            out.append((bands[:, [2, 1, 0]] if n > 1 else np.repeat(bands, 3, axis=1)).tobytes())
        return pd.Series(out)

    files = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    return files.select(F.col("origin").alias("path"), "height", "width", turned("data", "nChannels").alias("rgb"))


def meshes(spark: SparkSession, path: str) -> DataFrame:
    """path, n_triangles, low and high of binary STL files."""

    @F.pandas_udf("struct<n_triangles:long, low:array<double>, high:array<double>>")
    def of(content: pd.Series) -> pd.DataFrame:
        record = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("rest", "<u2")])
        rows = []
        for x in content:
            n = int(np.frombuffer(x, "<u4", 1, 80)[0])
            points = np.frombuffer(x, record, n, 84)["corners"].reshape(-1, 3)
            rows.append((n, points.min(0).astype(float).tolist() if n else None, points.max(0).astype(float).tolist() if n else None))
        return pd.DataFrame(rows, columns=["n_triangles", "low", "high"])

    return spark.read.format("binaryFile").load(path).select("path", of("content").alias("m")).select("path", "m.*")


def staged_result(spark: SparkSession, path: str, suffix: str, schema: str) -> DataFrame:
    """The first file, by name, whose name ends with suffix, as JSON."""
    files = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", "true").json(path).withColumn("_file", F.col("_metadata.file_path"))
    named = files.where(F.col("_file").endswith(suffix))
    return named.join(F.broadcast(named.agg(F.min("_file").alias("_file"))), "_file", "left_semi").drop("_file")


def training_rows(spark: SparkSession, path: str, root: str) -> DataFrame:
    """images (paths under root), prompt and completion with typed content parts."""
    plain = "array<struct<role: string, content: string>>"
    rows = spark.read.schema(f"images array<string>, prompt {plain}, completion {plain}").json(path)
    parts = lambda c: F.transform(c, lambda m: F.struct(m["role"].alias("role"), text.content_parts(m["content"]).alias("content")))
    return rows.select(F.transform("images", lambda x: F.when(x.startswith("/"), x).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), x))).alias("images"), parts("prompt").alias("prompt"), parts("completion").alias("completion"))
