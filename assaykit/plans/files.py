"""Queries that write a table in one of the file forms and read it back: arrays and maps of any size, versions, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import json_files, readers, versions, writers
from .registry import query, table
from .streams import place_for

RANGE = 1 << 20  # least bytes of a task, so that small tables too are read in many ranges


@query("""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, lang, n_chars, md5(coalesce(text, '')) AS md5 FROM documents""")
def json_array_roundtrip(spark, d):
    """Documents in order of their id as JSON arrays, one for each partition, read in byte ranges; positions go on from file to file."""
    place = place_for(spark, "array")
    json_files.write(table(spark, d, "documents").orderBy("doc_id").select(F.to_json(F.struct("doc_id", "lang", "n_chars", "text")).alias("value")), place)
    rows = json_files.read(spark, place, json_files.range_for(place, RANGE), through=True)
    found = rows.select("pos", F.from_json("value", "doc_id long, lang string, n_chars long, text string").alias("r"))
    return found.select("pos", "r.doc_id", "r.lang", "r.n_chars", F.md5(F.coalesce("r.text", F.lit(""))).alias("md5"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, lang, source, n_chars FROM documents""")
def json_map_roundtrip(spark, d):
    """Documents as JSON maps from id to struct, read in byte ranges."""
    place = place_for(spark, "map")
    entry = F.concat(F.lit('"'), "doc_id", F.lit('": '), F.to_json(F.struct("lang", "source", "n_chars")))
    json_files.write(table(spark, d, "documents").select(entry.alias("value")), place, kind="map")
    return readers.id_map(spark, place, "struct<lang: string, source: string, n_chars: bigint>", json_files.range_for(place, RANGE))


@query("""SELECT '/data/' || conv_id || '/' || turn || '.png' AS image, role, 'text' AS type, md5(text) AS md5 FROM conversations""")
def training_rows_roundtrip(spark, d):
    """Turns as training rows in JSON lines, with paths under a root and typed content."""
    place = place_for(spark, "rows")
    said = F.array(F.struct("role", F.col("text").alias("content")))
    image = F.concat(F.col("conv_id"), F.lit("/"), F.col("turn"), F.lit(".png"))
    writers.jsonl(table(spark, d, "conversations").select(F.array(image).alias("images"), said.alias("prompt"), F.slice(said, 1, 0).alias("completion")), place)
    rows = readers.training_rows(spark, place, "/data").select(F.col("images")[0].alias("image"), F.inline("prompt"))
    return rows.select("image", "role", F.inline("content")).select("image", "role", "type", F.md5("text").alias("md5"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'second' WHEN c_custkey % 3 = 0 THEN 'first' ELSE c_mktsegment END AS segment FROM customer
UNION ALL SELECT c_custkey + 10000000, 'new' FROM customer WHERE c_custkey % 7 = 0""")
def versioned_upsert(spark, d):
    """A keyed table after two upserts, each published as a version."""
    place = place_for(spark, "upsert")
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    writers.upsert(rows, "c_custkey", place)
    writers.upsert(rows.where("c_custkey % 3 = 0").withColumn("segment", F.lit("first")), "c_custkey", place)
    more = rows.where("c_custkey % 7 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), F.lit("new").alias("segment"))
    writers.upsert(rows.where("c_custkey % 5 = 0").withColumn("segment", F.lit("second")).unionByName(more), "c_custkey", place)
    return versions.table(spark, place)


@query("""WITH r AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % 4 AS m FROM events)
SELECT 'L' || m AS lane, count(*) AS n_results, count(*) FILTER (WHERE event_type <> 'error') AS n, count(*) FILTER (WHERE event_type = 'error') AS n_infra_failed, 1 AS n_lines FROM r GROUP BY m""")
def committed_run(spark, d):
    """Results, summary and report of a run, committed together and read back."""
    from .board import answers
    from ..operators.results import lane_summary

    place, rows = place_for(spark, "run"), answers(spark, d)
    writers.commit_run(rows, lane_summary(rows, ["lane"]), place, "20260101-000000_all")
    run = f"{place}/20260101-000000_all"
    counts = versions.table(spark, run, "results", form="json").groupBy("lane").agg(F.count("*").alias("n_results"))
    lanes = versions.table(spark, run, "summary", form="json").select("lane", "n", "n_infra_failed")
    lines = versions.table(spark, run, "report", form="text").groupBy(F.regexp_extract("value", r"^\| (\S+) ", 1).alias("lane")).agg(F.count("*").cast("int").alias("n_lines"))
    return counts.join(lanes, "lane").join(lines, "lane")


@query("""SELECT 'compare/part_' || p_partkey || '.json' AS name, sha256('{"id":"part:' || p_partkey || '","p_name":"' || p_name || '","p_size":' || p_size || '}') AS sha256 FROM part
UNION ALL SELECT 'sheet/part_' || p_partkey || '.svg', sha256('<svg>' || p_type || '</svg>') FROM part WHERE p_size % 2 = 0""")
def exported_parts(spark, d):
    """A document for each part and a sheet for every second one, exported as files and read back."""
    place = place_for(spark, "export")
    rows = table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), "p_name", "p_size", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<svg>"), "p_type", F.lit("</svg>"))).alias("sheet"))
    writers.documents(rows, "id", place, {"sheet": ("sheet", ".svg")})
    return writers.written(spark, place).select("name", F.sha2("content", 256).alias("sha256"))
