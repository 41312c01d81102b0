"""Queries over texts, pages, conversations and JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from .registry import LOG, log, query, table


@query("""SELECT norm AS text, count(*) AS n FROM (SELECT array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '#.*$', ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), lambda x: x <> ''), chr(10)) AS norm FROM documents) GROUP BY norm HAVING count(*) > 1""")
def normalized_text_dups(spark, d):
    return table(spark, d, "documents").groupBy(text.normalized_program(F.col("text")).alias("text")).agg(F.count("*").alias("n")).where("n > 1")


@query(r"""SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '\b[0-9]+\b'), lambda x: x::DOUBLE))) AS n_numbers, list_max(list_transform(regexp_extract_all(text, '\b[0-9]+\b'), lambda x: x::DOUBLE)) AS largest FROM documents""")
def regex_number_extract(spark, d):
    found = F.transform(F.regexp_extract_all("text", F.lit(r"\b[0-9]+\b"), F.lit(0)), lambda x: x.cast("double"))
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(found)).cast("long").alias("n_numbers"), F.array_max(found).alias("largest"))


@query("""WITH s AS (SELECT p_partkey, [p_size * 1.0, p_retailprice] AS given, list_distinct([p_size * 1.001, 7.25, p_retailprice]) AS needed FROM part)
SELECT p_partkey, round(len(list_filter(list_transform(needed, lambda x: round(x, 4)), lambda a: a NOT IN (0, 1, 2, 90, 180, 270, 360) AND len(list_filter(given, lambda b: abs(a - round(b, 4)) <= greatest(1e-4, 0.002 * abs(a)))) > 0)) / len(list_filter(list_transform(needed, lambda x: round(x, 4)), lambda a: a NOT IN (0, 1, 2, 90, 180, 270, 360))), 6) AS coverage FROM s""")
def spec_coverage(spark, d):
    p = table(spark, d, "part")
    size, price = F.format_string("%.4f", F.col("p_size") * 1.001), F.format_string("%.4f", "p_retailprice")
    spec = F.concat(F.lit("a part of "), F.col("p_size").cast("string"), F.lit(" by "), price, F.lit(" units"))
    code = F.concat(F.lit("r = box("), size, F.lit(", 7.25, "), price, F.lit(")"))
    return p.select("p_partkey", F.round(text.spec_coverage(spec, code), 6).alias("coverage"))



@query(r"""WITH t AS (SELECT doc_id, trim(coalesce(text, ''), e' \t\n\r\x0b\x0c') AS t, rtrim('import cadquery as cq' || chr(10) || coalesce(text, ''), e' \t\n\r\x0b\x0c') AS bare FROM documents)
SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN 'import cadquery as cq' || chr(10) || '# ' || t || ';' || chr(10) WHEN doc_id % 3 = 1 THEN bare || chr(10) END) AS md5 FROM t""")
def fence_extract(spark, d):
    """Replies that hold each text in the second of two fenced programs, after a bare import, or as it is."""
    whole, trimmed = F.coalesce("text", F.lit("")), text.strip(F.coalesce("text", F.lit("")))
    two = F.concat(F.lit("<think>\n```python\ncq bad```</think>so: ```python\nimport cadquery as cq\nfirst\n``` and ```\nimport cadquery as cq\n# "), trimmed, F.lit(";\n``` done"))
    reply = F.when(F.col("doc_id") % 3 == 0, two).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here: import cadquery as cq\n"), whole)).otherwise(whole)
    return table(spark, d, "documents").select("doc_id", F.md5(text.last_program(reply)).alias("md5"))


@query(r"""SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ') AS t FROM pages)""")
def html_strip_text(spark, d):
    """Markup cleaned away by patterns alone."""
    bare = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    t = F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))
    return table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


@query(r"""SELECT page_id, translate(page_id || ':' || regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), ':/', '__') AS file, regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1) AS stem FROM pages""")
def url_route(spark, d):
    route = F.concat(F.col("page_id").cast("string"), F.lit(":"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1))
    return table(spark, d, "pages").select("page_id", text.file_name(route).alias("file"), F.regexp_extract("url", r"([^/?#]+)/?(?:[?#].*)?$", 1).alias("stem"))


@query("""SELECT conv_id, count(*) + 1 AS n_messages, md5('system:You are helpful.' || chr(10) || string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def chat_messages_build(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit("You are helpful.").alias("text")))
    said = F.concat(system, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    return rows.select("conv_id", F.size(said).cast("long").alias("n_messages"), F.md5(F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")).alias("digest"))


@query("SELECT conv_id, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id HAVING sum(length(text)) <= 3000")
def message_lengths(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n_chars")).where("n_chars <= 3000")


@query("""SELECT conv_id, turn, md5(text) AS prompt, md5(answer) AS completion FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def prompt_completion_pairs(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.md5("text").alias("prompt"), F.md5("answer").alias("completion"))


@query(f"WITH {LOG} SELECT event_id, k, k % 2 = 0 AS even FROM log")
def json_props_extract(spark, d):
    return log(spark, d).select("event_id", "k", (F.col("k") % 2 == 0).alias("even"))


@query("SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY p_brand")
def map_roundtrip(spark, d):
    """Rows folded into JSON maps of a brand, and read again from them; a map holds a thousand keys at most, however many a brand has."""
    pairs = table(spark, d, "part").groupBy("p_brand", F.expr("p_partkey div 1000")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), F.struct("p_retailprice"))))).alias("json"))
    rows = pairs.select("p_brand", F.explode(F.from_json("json", "map<string, struct<p_retailprice: double>>")).alias("id", "v"))
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("v.p_retailprice"), 2).alias("total"))


@query("""SELECT source, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, count(*) FILTER (WHERE length(text) > 4000) AS n_long FROM documents GROUP BY source""")
def token_estimates(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(text.token_estimate(F.col("text"))).alias("tokens"), F.count_if(F.length("text") > 4000).alias("n_long"))


@query("""SELECT doc_id, length(e) AS n_chars, md5(e) AS digest FROM (SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS e FROM documents)""")
def html_escaped(spark, d):
    """Length and digest of every whole text, escaped."""
    escaped = text.html_escape(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(escaped).cast("long").alias("n_chars"), F.md5(escaped).alias("digest"))


@query("""SELECT o_orderkey, printf('Bounding box: X %.4f, Y %.4f, Z %.4f. Write the CadQuery program for this part.', o_totalprice, o_orderkey / 8, 1.5) AS request, substr(sha1(o_orderpriority), 1, 16) AS key FROM orders""")
def formatted_requests(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", text.box_request(F.col("o_totalprice"), F.col("o_orderkey") / 8, F.lit(1.5)).alias("request"), F.substring(F.sha1("o_orderpriority"), 1, 16).alias("key"))
