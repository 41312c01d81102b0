"""Queries over parts, documents and items: splits, samples, leakage, near-duplicates, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, stats
from ..operators import curate, results
from ..sources import writers
from .registry import query, table

EXTENTS = "[p_retailprice / 1000, p_size * 1.0, (p_partkey % 97) + 1.0]"


def parts(spark, d):
    return table(spark, d, "part").withColumn("extents", F.array(F.col("p_retailprice") / 1000, F.col("p_size") * 1.0, F.col("p_partkey") % 97 + 1.0))


@query("""WITH s AS (SELECT source, row_number() OVER (ORDER BY md5(source || ':0'), source) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, rk <= CASE WHEN n <= 1 THEN 0 ELSE greatest(1, round_even(n * 0.2, 0)) END AS held_out FROM documents JOIN s USING (source)""")
def source_holdout_split(spark, d):
    return curate.source_holdout(table(spark, d, "documents").select("doc_id", "source"), "source", 0.2)


@query("""WITH g AS (SELECT p_brand, count(*) AS c FROM part GROUP BY p_brand), b AS (SELECT p_brand, coalesce(sum(c) OVER (ORDER BY md5(p_brand || ':0'), p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM b WHERE before < 500)""")
def group_prefix_fill(spark, d):
    return curate.group_prefix_fill(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 500)


@query("""WITH r AS (SELECT p_partkey, p_size, p_size > 40 AS s, row_number() OVER (PARTITION BY p_size > 40 ORDER BY md5(p_partkey::VARCHAR || ':0'), p_partkey) AS k, count(*) OVER () AS n, count(*) FILTER (WHERE p_size > 40) OVER () AS m FROM part)
SELECT p_partkey, p_size FROM r WHERE k <= CASE WHEN n <= 300 THEN n WHEN s THEN least(round_even(300 * m / n, 0), m) ELSE 300 - least(round_even(300 * m / n, 0), m) END""")
def stratified_sample(spark, d):
    return curate.stratified_sample(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", F.col("p_size") > 40, 300)


@query("""WITH r AS (SELECT p_partkey, p_size, p_size >= 7 AS s, row_number() OVER (PARTITION BY p_size >= 7 ORDER BY md5(p_partkey::VARCHAR || ':0'), p_partkey) AS k, count(*) FILTER (WHERE p_size >= 7) OVER () AS m FROM part)
SELECT p_partkey, p_size FROM r WHERE CASE WHEN s THEN k <= least(m, 210) ELSE k <= 300 - least(m, 210) END""")
def quota_sample(spark, d):
    return curate.quota_sample(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", results.is_hard(F.col("p_size"), F.lit(1)), 300, 0.7)


@query("""WITH r AS (SELECT p_type, p_partkey, p_size, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_type) AS n FROM part)
SELECT p_type, p_partkey, p_size FROM r WHERE k IN (0, floor((n - 1) / 3), floor(2 * (n - 1) / 3), n - 1)""")
def even_spaced_picks(spark, d):
    return curate.even_picks(table(spark, d, "part").select("p_type", "p_partkey", "p_size"), "p_type", ["p_size", "p_partkey"])


@query("SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_name, p_partkey) - 1) % 8 AS INT) AS shard FROM part")
def modulo_shards(spark, d):
    return curate.modulo_shard(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 8).select("p_partkey", "shard")


@query("""SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""")
def first_row_per_source(spark, d):
    return curate.first_of_each(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", ["p_partkey"])


@query("""WITH held AS (SELECT doc_id % 50 AS src, md5(text) AS sig FROM documents WHERE doc_id % 50 < 10)
SELECT doc_id FROM documents WHERE doc_id % 50 NOT IN (SELECT src FROM held) AND md5(text) NOT IN (SELECT sig FROM held)""")
def leak_antijoin(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("src"), F.md5("text").alias("sig"))
    held = docs.where("src < 10")
    return curate.without(docs, (held, "src"), (held, "sig")).select("doc_id")


@query("SELECT doc_id, count(*) AS n_items FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY doc_id")
def contamination_contains(spark, d):
    """Texts that hold a benchmark text as it stands, by one scan of each text for all items."""
    items = table(spark, d, "benchmark").where("text is not null").select("item_id", "text")
    found = curate.holding(table(spark, d, "documents").select("doc_id", "text"), items, "text", "item_id", "text")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"))


@query(f"""WITH s AS (SELECT p_partkey, round(p_retailprice / 1000, 3) AS a, p_size AS b, p_partkey % 10 = 0 AS held FROM part)
SELECT (SELECT count(*) FROM (SELECT a, b FROM s WHERE held INTERSECT SELECT a, b FROM s WHERE NOT held)) AS shared, count(DISTINCT (a, b)) AS n_signatures FROM s""")
def signature_overlap(spark, d):
    rows = parts(spark, d).select((F.col("p_partkey") % 10 == 0).alias("held"), geometry.signature(F.array(F.col("p_retailprice") / 1000), F.col("p_size")).alias("sig"))
    shared = curate.overlap_counts(rows.where("held"), rows.where("not held"), {"shared": F.col("sig")})
    return shared.join(F.broadcast(rows.select("sig").distinct().agg(F.count("*").alias("n_signatures"))))


NEAR = f"""p AS (SELECT p_partkey, p_size, p_brand, {EXTENTS} AS e FROM part), near AS (
 SELECT a.p_partkey, round(coalesce(min(list_max([abs(a.e[1] - b.e[1]) / greatest(a.e[1], b.e[1], 1e-9), abs(a.e[2] - b.e[2]) / greatest(a.e[2], b.e[2], 1e-9), abs(a.e[3] - b.e[3]) / greatest(a.e[3], b.e[3], 1e-9)])), 1.0), 9) AS distance
 FROM (SELECT * FROM p WHERE p_partkey % 20 = 0) a LEFT JOIN (SELECT * FROM p WHERE p_partkey % 20 <> 0) b ON a.p_size = b.p_size AND a.p_brand = b.p_brand GROUP BY a.p_partkey)"""


def near(spark, d):
    p = parts(spark, d).select("p_partkey", "p_size", "p_brand", "extents")
    return curate.nearest_relative(p.where("p_partkey % 20 = 0"), p.where("p_partkey % 20 <> 0"), "p_partkey", ["p_size", "p_brand"], "extents")


@query(f"WITH {NEAR} SELECT * FROM near")
def near_duplicate_min_dist(spark, d):
    """A stated set of parts against all others, by bucket."""
    return near(spark, d)


@query(f"WITH {NEAR} SELECT t AS threshold, count(*) FILTER (WHERE distance <= t) AS n FROM near, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) AS v(t) GROUP BY t")
def threshold_ladder(spark, d):
    return curate.threshold_ladder(near(spark, d), "distance", [0.0, 0.1, 0.25, 0.5])


@query(f"""WITH {NEAR}, j AS (SELECT p_brand, distance <= 0.25 AS near_dup, p_retailprice > 950 AS ok FROM near JOIN part USING (p_partkey)),
 g AS (SELECT p_brand, avg(ok::INT) FILTER (WHERE near_dup) AS a, avg(ok::INT) FILTER (WHERE NOT near_dup) AS b, count(*) FILTER (WHERE near_dup) AS na, count(*) FILTER (WHERE NOT near_dup) AS nb FROM j GROUP BY p_brand)
SELECT p_brand, round(a, 6) AS near_dup, round(b, 6) AS clean, round(a - b, 6) AS gap, na AS n_near_dup, nb AS n_clean FROM g WHERE na > 0 AND nb > 0""")
def near_dup_slice_rates(spark, d):
    rows = near(spark, d).join(table(spark, d, "part"), "p_partkey").withColumn("dup", F.col("distance") <= 0.25).withColumn("ok", F.col("p_retailprice") > 950)
    a, b = stats.share_where(F.col("ok"), F.col("dup")), stats.share_where(F.col("ok"), ~F.col("dup"))
    g = rows.groupBy("p_brand").agg(F.round(a, 6).alias("near_dup"), F.round(b, 6).alias("clean"), F.round(a - b, 6).alias("gap"), F.count_if("dup").alias("n_near_dup"), F.count_if(~F.col("dup")).alias("n_clean"))
    return g.where("n_near_dup > 0 and n_clean > 0")


@query("""WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT a.vec_id, round(max(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e))), 5) AS best
FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id""")
def embedding_near_dup(spark, d):
    """The nearest other vector of the whole table, for the stated queries whose id 20 divides."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return curate.nearest_vectors(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding").withColumn("best", F.round("best", 5))


REASON = """CASE WHEN source = 'src0' THEN 'leak' WHEN lang = 'de' THEN 'shot' WHEN n_chars > 4000 THEN 'too long' END"""


@query(f"SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def drop_reasons(spark, d):
    reason = curate.first_reason([("leak", F.col("source") == "src0"), ("shot", F.col("lang") == "de"), ("too long", F.col("n_chars") > 4000)])
    return table(spark, d, "documents").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE n_chars > 100) AS ran, count(*) FILTER (WHERE n_chars > 100 AND lang = 'en') AS single, count(quality) FILTER (WHERE n_chars > 100 AND lang = 'en') AS checked,
 count(*) FILTER (WHERE n_chars > 100 AND lang = 'en' AND quality = 1) AS ok, round(count(*) FILTER (WHERE n_chars > 100 AND lang = 'en' AND quality = 1) / greatest(count(quality) FILTER (WHERE n_chars > 100 AND lang = 'en'), 1), 4) AS ok_share
FROM documents LEFT JOIN labels USING (doc_id)""")
def audit_funnel(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    ran = F.col("n_chars") > 100
    single, checked = ran & (F.col("lang") == "en"), ran & (F.col("lang") == "en") & F.col("quality").isNotNull()
    ok = checked & (F.col("quality") == 1)
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(F.count("*").alias("n"), n(ran, "ran"), n(single, "single"), n(checked, "checked"), n(ok, "ok"), F.round(F.count_if(ok) / F.greatest(F.count_if(checked), F.lit(1)), 4).alias("ok_share"))


@query("SELECT least(c, 5) AS n_candidates, count(*) AS n FROM (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def capped_hist(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c"))
    return counts.groupBy(F.least("c", F.lit(5)).alias("n_candidates")).agg(F.count("*").alias("n"))


@query("SELECT left(text, 60) AS error, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_error_prefix(spark, d):
    """A top-5 report of the commonest beginnings."""
    return table(spark, d, "documents").groupBy(F.substring("text", 1, 60).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(5)


@query("""SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN abs(p_size - (p_size + (p_partkey % 5) * 0.1)) <= 0.02 * greatest(p_size, p_size + (p_partkey % 5) * 0.1) + 1e-4 END AS dims_ok FROM part""")
def dims_consistent_check(spark, d):
    """The stated triple has its axes in another order; every third part states none."""
    s = F.col("p_size").cast("double")
    stated = F.when(F.col("p_size") % 3 != 0, F.array(F.array(F.lit(1000.0), s, F.lit(0.5)))).otherwise(F.array().cast("array<array<double>>"))
    found = F.array(F.lit(0.5), s + F.col("p_partkey") % 5 * 0.1, F.lit(1000.0))
    return table(spark, d, "part").select("p_partkey", geometry.dims_consistent(stated, found).alias("dims_ok"))


@query(r"""SELECT (SELECT count(*) FROM (SELECT source FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT source FROM documents WHERE doc_id % 2 = 1)) AS sources,
 (SELECT count(*) FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)) AS texts,
 (SELECT count(*) FROM (SELECT regexp_replace(text, '[ \t\r\n]+', ' ', 'g') FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT regexp_replace(text, '[ \t\r\n]+', ' ', 'g') FROM documents WHERE doc_id % 2 = 1)) AS normalized""")
def set_overlap_counts(spark, d):
    docs = table(spark, d, "documents")
    return curate.overlap_counts(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), {"sources": F.col("source"), "texts": F.col("text"), "normalized": F.regexp_replace("text", r"[ \t\r\n]+", " ")})


@query("""SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources, round(avg(n_chars), 4) AS mean_chars, max(n_chars) AS max_chars, round(count(*) FILTER (WHERE n_chars > 1000) / count(*), 4) AS long_share FROM documents GROUP BY lang""")
def dataset_statistics(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.max("n_chars").alias("max_chars"), F.round(F.count_if(F.col("n_chars") > 1000) / F.count("*"), 4).alias("long_share")
    )


@query("""SELECT s_suppkey, coalesce(b.name, a.s_name) AS name FROM supplier a LEFT JOIN (SELECT s_suppkey, 'new ' || s_name AS name FROM supplier WHERE s_suppkey % 3 = 0) b USING (s_suppkey)
UNION ALL SELECT s_suppkey + 1000000, 'new' FROM supplier WHERE s_suppkey < 3""")
def keyed_upsert(spark, d):
    old = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    new = old.where("s_suppkey % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name")).unionByName(old.where("s_suppkey < 3").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), F.lit("new").alias("name")))
    return writers.upserted(old, new, "s_suppkey")


@query()
def greedy_two_key_dedup(spark, d):
    """Parts in order of their key, kept if neither brand-and-size nor type-and-price was kept before."""
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("source"), F.concat_ws("/", "p_type", F.floor("p_retailprice")).alias("signature"))
    return curate.greedy_two_key_dedup(rows, "p_partkey", "source", "signature")


@query(f"""WITH o AS (SELECT p_partkey, [p_size * 1.0, p_retailprice / 100, 5.0] AS a, [p_retailprice / 100 * 1.05, 5.0, p_size * 1.0 + 0.2] AS g FROM part),
 r AS (SELECT p_partkey, g, unnest([[a[1], a[2], a[3]], [a[1], a[3], a[2]], [a[2], a[1], a[3]], [a[2], a[3], a[1]], [a[3], a[1], a[2]], [a[3], a[2], a[1]]]) AS x FROM o),
 v AS (SELECT *, least(x[1], g[1]) * least(x[2], g[2]) * least(x[3], g[3]) AS i, x[1] * x[2] * x[3] AS va, g[1] * g[2] * g[3] AS vb,
   abs(x[1] - g[1]) <= 0.25 * greatest(g[1], g[2], g[3]) + 1e-9 AND abs(x[2] - g[2]) <= 0.25 * greatest(g[1], g[2], g[3]) + 1e-9 AND abs(x[3] - g[3]) <= 0.25 * greatest(g[1], g[2], g[3]) + 1e-9 AS ok FROM r)
SELECT p_partkey, round(max(i / (va + vb - i)) FILTER (WHERE ok), 6) AS iou_aligned FROM v GROUP BY p_partkey""")
def box_iou_aligned(spark, d):
    pairs = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size") * 1.0, F.col("p_retailprice") / 100, F.lit(5.0)).alias("a"), F.array(F.col("p_retailprice") / 100 * 1.05, F.lit(5.0), F.col("p_size") * 1.0 + 0.2).alias("g"))
    return geometry.aligned_box_iou(pairs, "a", "g").select("p_partkey", F.round("iou_aligned", 6).alias("iou_aligned"))


@query("""SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN -0.5 WHEN l_linestatus = 'O' THEN -0.2 ELSE l_discount * 10 + CASE WHEN l_discount * 10 >= 0.9 THEN 0.5 ELSE 0 END END), 4) + 0.0 AS reward FROM lineitem GROUP BY l_orderkey""")
def reward_case(spark, d):
    code = F.when(F.col("l_returnflag") != "R", F.lit("x"))
    r = geometry.reward(code, F.col("l_linestatus") != "O", F.col("l_discount") * 10)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.round(F.sum(r), 4) + 0.0).alias("reward"))


@query("""SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AS live FROM supplier""")
def membership_flags(spark, d):
    """Which listed suppliers the catalog of the day holds."""
    catalog = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return curate.flagged(table(spark, d, "supplier").select("s_suppkey"), catalog, "s_suppkey", "live")


@query("""SELECT count(*) AS n_keys FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' UNION SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)""")
def key_union(spark, d):
    used, near = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("k")), table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("k"))
    return curate.key_union(used, near, on="k").agg(F.count("*").alias("n_keys"))


@query("""SELECT count(*) AS n FROM documents WHERE doc_id % 50 >= 10""")
def disjoint_split(spark, d):
    """The training side of a split, once it is known to share no key with the held-out side."""
    docs = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("src"))
    train, held = docs.where("src >= 10"), docs.where("src < 10")
    return curate.disjoint(train, held, "src").agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) AS n_langs, string_agg(lang, ',' ORDER BY lang) AS langs FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source""")
def distinct_flatten(spark, d):
    """The lists of several groups, flattened to their distinct elements."""
    lists = table(spark, d, "documents").groupBy("source", (F.col("doc_id") % 7).alias("part")).agg(F.collect_set("lang").alias("langs"))
    out = curate.distinct_flatten(lists, ["source"], "langs")
    return out.select("source", F.size("langs").cast("long").alias("n_langs"), F.array_join("langs", ",").alias("langs"))


@query("""SELECT p_partkey AS id, p_size AS n_faces FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier) AND p_partkey % 3 = 0 AND p_size >= 7""")
def bench_filters(spark, d):
    """The parts of a run: with a sheet, of several parts, with faces enough."""
    records = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n_faces"), F.when(F.col("p_partkey") % 3 == 0, 2).otherwise(1).alias("n_parts"))
    return curate.bench_records(records, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), multi_only=True, min_faces=7).select("id", "n_faces")


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE lang = 'de') AS n_de, count(*) FILTER (WHERE lang = 'fr') AS n_fr,
 round(count(*) FILTER (WHERE lang = 'en' AND n_chars > 400) / count(*) FILTER (WHERE lang = 'en'), 4) AS share_long, round(count(*) FILTER (WHERE lang = 'en' AND source = 'src0') / count(*) FILTER (WHERE lang = 'en'), 4) AS share_src0 FROM documents""")
def provenance_rollup(spark, d):
    shares = {"share_long": F.col("n_chars") > 400, "share_src0": F.col("source") == "src0"}
    return curate.provenance(table(spark, d, "documents"), "lang", ["en", "de", "fr"], shares, of="en")


@query("SELECT doc_id, source FROM documents ORDER BY md5(doc_id || ':11'), doc_id LIMIT 40")
def reverify_sample(spark, d):
    """A seeded sample of 40 rows to verify again."""
    return curate.seeded_sample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 40)


@query("SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey || ':13'), p_partkey) AS place FROM part")
def shuffled_rows(spark, d):
    return curate.shuffled(table(spark, d, "part").select("p_partkey"), "p_partkey", 13)


@query("SELECT substr(sha1(text), 1, 16) AS key, any_value(length(text)) AS n_chars FROM documents GROUP BY 1")
def content_keys(spark, d):
    """Texts stored once under a key of their content."""
    return writers.content_addressed(table(spark, d, "documents"), "text").select("key", F.length("text").cast("long").alias("n_chars"))


@query("""WITH k AS (SELECT substr(sha1(text), 1, 16) AS key, any_value(length(text)) AS n_chars, min(doc_id) AS doc_id FROM documents GROUP BY 1),
 u AS (SELECT key, max(ts) AS last_use FROM events JOIN documents ON doc_id = (user_id * 37 + event_id) % 1000 JOIN (SELECT doc_id AS d2, substr(sha1(text), 1, 16) AS key FROM documents) ON d2 = doc_id GROUP BY key)
SELECT key, n_chars, last_use FROM u JOIN k USING (key) ORDER BY last_use DESC, key LIMIT 300""")
def bounded_content_store(spark, d):
    """The 300 texts that a store which evicts the longest unused holds after the log of events."""
    docs = table(spark, d, "documents")
    keyed = docs.select("doc_id", F.substring(F.sha1("text"), 1, 16).alias("key"))
    uses = table(spark, d, "events").select(((F.col("user_id") * 37 + F.col("event_id")) % 1000).alias("doc_id"), "ts").join(keyed, "doc_id").select("key", "ts")
    contents = writers.content_addressed(docs, "text").select("key", F.length("text").cast("long").alias("n_chars"))
    return writers.bounded_store(contents, uses, "key", "ts").select("key", "n_chars", "last_use")


@query("""SELECT doc_id, lang, source, length(text) % 20 AS n_faces, [n_chars * 1.0::DOUBLE] AS extents, CASE WHEN toxic = 1 THEN NULL ELSE quality = 1 END AS dims_ok FROM documents JOIN labels USING (doc_id) WHERE n_chars > 100 AND (toxic = 1 OR quality = 1)""")
def audited_rows(spark, d):
    """The rows with an audit that they pass; those without one, with a failed run or a wrong size are left out."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", (F.length("text") % 20).alias("n_faces"))  # no text goes through the joins
    checks = docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", (F.col("n_chars") > 100).alias("runs"), "n_faces", F.array(F.col("n_chars").cast("double")).alias("extents"), F.when(F.col("toxic") != 1, F.col("quality") == 1).alias("dims_ok"))
    return curate.audited(docs, checks, "doc_id", ["lang", "source"])
