"""Secret scans judged by corpus-wide ownership frequency.

A scan of each text yields candidate values. Their hashes are counted over the whole corpus by
distinct owners and repositories. A value that many owners carry is a widely copied example; one
that stays with few owners looks like a live credential, unless these have copied it into many
repositories, as they do with the placeholder of a template. Candidates of the three base kinds are
always reported; those of the further kinds only when they look live.

Scale: one map pass, in which spans are compared by one sweep in their order; only candidates are shuffled. Counts are pre-aggregated in three levels
(value, owner, repository; value, owner; value), so a value in a third of all rows is a handful
of rows after the first level. Equal texts are judged once, by a 128-bit key of the text, and
verdicts are joined to texts by equality, which run-time skew splitting can divide.

Edge cases: null and empty texts have no spans; a null owner or repository counts as one of its
own; repeated rows count their owner once; an empty table gives no rows; the input's columns
pass through, but for those with the name of a result or helper, which are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget, small_batches, text_or_empty, utf8

# The base patterns, and well-known shapes of further credentials.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?")
WEB_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")
ASSIGN_MIN, ACCESS_MIN = 12, 18

KINDS = ["assign", "access", "hex", "key_block", "web_token", "prefixed", "random"]
BASE = 3  # the first kinds of KINDS
ENTROPY = 3.8  # bits for each character of a random string, at least
OWNERS = 2  # a value with more owners is a widely copied example
REPOSITORIES = 8  # so is one in more repositories, whoever owns them

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind_no", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.LongType())]))


def looks_random(value: str) -> bool:
    if not (re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= ENTROPY


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, value) of every candidate, by start and then kind; code points, end exclusive."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    more = []
    if "-----BEGIN " in text:
        more += [(m.start(), 3, m.end(), m[0]) for m in KEY_BLOCK.finditer(text)]
    if "eyJ" in text:
        more += [(m.start(), 4, m.end(), m[0]) for m in WEB_TOKEN.finditer(text)]
    more += [(m.start(), 5, m.end(), m[0]) for m in PREFIXED.finditer(text)]
    more += [(m.start(), 6, m.end(), m[0]) for m in RANDOM.finditer(text) if looks_random(m[0])]
    out.sort()
    starts, ends = [x[0] for x in out], [*accumulate((x[2] for x in out), max)]
    covered = 0
    for x in sorted(more):  # what a base span or one before it already covers isn't told again
        k = bisect_left(starts, x[2])
        if covered <= x[0] and not (k and ends[k - 1] > x[0]):
            covered = x[2]
            out.append(x)
    return sorted(out)


def _found(text: Column) -> Column:
    @F.arrow_udf(SPAN)
    def of(column: pa.Array) -> pa.Array:
        rows = [scan(x.decode("utf-8", "replace")) for x in utf8(column)]
        flat = [x for row in rows for x in row]
        values = np.array([xxhash.xxh64_intdigest(x[3].encode()) for x in flat], np.uint64).view(np.int64)
        fields = [pa.array([x[k] for x in flat], pa.int32()) for k in range(3)] + [pa.array(values, pa.int64())]
        offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "kind_no", "end", "value"]))

    return of(text)


def _keys(text: str) -> list[Column]:
    whole = text_or_empty(text)
    return [F.xxhash64(whole).alias("_k1"), F.xxhash64(F.lit("text"), whole).alias("_k2")]


def ownership(uses: DataFrame) -> DataFrame:
    """value, owners, repositories from rows (value, owner, repo); a repository belongs to its owner."""
    return uses.distinct().groupBy("value", "owner").agg(F.count("*").alias("repos")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repositories"))


def annotate(df: DataFrame, text: str = "text", owner: str = "source", repo: str = "lang", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """df with spans: array of (start, kind_no, end, kind, owners, repositories, live), in order.

    owner: the column whose distinct values count as owners. repo: a column that tells the
    repositories of one owner apart. Candidates of the further kinds that aren't live are left out.
    """
    small_batches(df.sparkSession)
    df = df.drop("spans", "_k1", "_k2")
    seen = df.select(*_keys(text), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), _found(text_or_empty(text)).alias("found"))
    seen = cut(seen.where(F.size("found") > 0), "secret-candidates")
    counts = ownership(seen.select(F.explode("found.value").alias("value"), "owner", "repo"))
    texts = seen.select("_k1", "_k2", "found").groupBy("_k1", "_k2").agg(F.first("found").alias("found"))
    spans = texts.select("_k1", "_k2", F.explode("found").alias("x")).select("_k1", "_k2", "x.*").join(counts, "value")
    live = (F.col("owners") <= owners) & (F.col("repositories") <= repositories)
    told = spans.where((F.col("kind_no") < BASE) | live).withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind_no") + 1))
    marks = told.groupBy("_k1", "_k2").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "kind", "owners", "repositories", live.alias("live")))).alias("spans")
    )
    marks = cut(marks, "secret-spans")  # of a known size for the join's planning
    forget(seen)
    keyed = df.select("*", *_keys(text))
    none = F.array().cast(marks.schema["spans"].dataType)
    return keyed.join(marks, ["_k1", "_k2"], "left").withColumn("spans", F.coalesce("spans", none)).drop("_k1", "_k2")


def mask(df: DataFrame, text: str = "text", spans: str = "spans", by: str = "[secret]") -> DataFrame:
    """df whose live spans are replaced in the text; widely copied examples stay. Null texts stay null."""

    @F.arrow_udf(T.StringType())
    def of(column: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for x, a, b in zip(column.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            if x is not None and a:
                parts, at = [], 0
                for s, e in sorted(zip(a, b)):
                    if s >= at:
                        parts += [x[at:s], by]
                    at = max(at, e)
                x = "".join([*parts, x[at:]])
            out.append(x)
        return pa.array(out, pa.string())

    live = F.filter(F.col(spans), lambda s: s["live"])
    return df.withColumn(text, of(F.col(text), live["start"], live["end"]))
