"""Fill-in-the-middle texts, cut at boundaries that are indexed once for each distinct text.

Identical texts are grouped by their whole content, so equal hashes alone never join two texts.
Each distinct text is cut into tokens once, and the ends of its tokens are kept as an Elias-Fano
list: the low bits of each end side by side, the high bits in unary. The lists, a tenth of the
texts' size, are joined back to all documents by the SHA-256 of the text; each document selects
the two ends that its seed names, without looking at its tokens again.

Scale: grouping folds copies within each task before its shuffle. The join back moves every text
once, and its equality join is split at run time where one text has very many copies. The rest is
map-only. A text must fit in a task; nothing is collected or broadcast but by Spark's own size check.

Edge cases: a null text counts as empty, has no tokens and stays plain; so do texts that hold a
mark. A null doc_id seeds as an empty one. White space at the end of a text is a token of its own;
other white space belongs to the token after it. Repeated rows give repeated results. Further columns
pass through, but for those with the name of a result or helper, which are replaced; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches, text_or_empty, utf8

# The marks of the three parts, and in how many of a hundred texts each choice is made.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT, SUFFIX_FIRST = 50, 80
SEED = 42


def token_ends(raw: bytes) -> np.ndarray:
    """Ends of the tokens of a UTF-8 text, in code points."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    space = (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))
    ends = np.flatnonzero(~space & np.r_[space[1:], True])
    if space[-1]:
        ends = np.r_[ends, len(b) - 1]
    points = np.cumsum((b & 0xC0) != 0x80)
    return points[ends]


def pack(ends: np.ndarray) -> tuple[int, bytes, bytes]:
    """Elias-Fano form of an ascending list: width of the low bits, low bits, high bits."""
    n = len(ends)
    if not n:
        return 0, b"", b""
    width = max(int(ends[-1]) // n, 1).bit_length() - 1
    low = (ends[:, None] >> np.arange(width)) & 1
    high = np.zeros((int(ends[-1]) >> width) + n, np.uint8)
    high[(ends >> width) + np.arange(n)] = 1
    return width, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


def select(places: list[int], width: int, low: bytes, high: bytes) -> list[int]:
    """The ends at the given places (from 0) of a packed list."""
    stack = np.frombuffer(high, np.uint8)
    upto = np.cumsum(np.bitwise_count(stack), dtype=np.int64)
    out = []
    for k in places:
        at = int(np.searchsorted(upto, k, "right"))
        left = k - (int(upto[at - 1]) if at else 0)
        bit = np.flatnonzero(np.unpackbits(stack[at : at + 1], bitorder="little"))[left]
        first = k * width
        held = int.from_bytes(low[first // 8 : (first + width + 7) // 8], "little") >> first % 8
        out.append((at * 8 + int(bit) - k) << width | held & ((1 << width) - 1))
    return out


def arrange(text: str, form: str, a: int, b: int) -> str:
    """The text with its parts [0, a), [a, b) and [b, end) marked and ordered as the form says."""
    if form == "psm":
        return f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
    if form == "spm":
        return f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return text


def restore(output: str, form: str) -> str:
    """The text that arrange() was given, from its output and form alone."""
    if form == "plain":
        return output
    first, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = first.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = first.removeprefix(SUFFIX).split(PREFIX)
    return prefix + middle + suffix


INDEX = T.StructType([T.StructField("n", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType())])
OUT = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
)


def boundary_index(df: DataFrame, text: str = "text") -> DataFrame:
    """digest, copies, n, width, low, high: one row for each distinct text with the packed ends of its tokens."""
    small_batches(df.sparkSession)

    @F.arrow_udf(INDEX)
    def of(column: pa.Array) -> pa.Array:
        ends = [token_ends(x) for x in utf8(column)]
        width, low, high = zip(*map(pack, ends)) if ends else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(list(map(len, ends)), pa.int64()), pa.array(width, pa.int32()), pa.array(low, pa.binary()), pa.array(high, pa.binary())], INDEX.names)

    distinct = df.select(text_or_empty(text).alias("t")).groupBy("t").agg(F.count("*").alias("copies"))
    found = distinct.select(F.unhex(F.sha2("t", 256)).alias("digest"), "copies", of("t").alias("i")).select("digest", "copies", "i.*")
    return cut(found, "infill-index", tidy=True)


def fill_in_middle(df: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, with_restored: bool = False) -> DataFrame:
    """df with n, form, prefix_chars, middle_chars and output; with_restored: also the text read back from output and form."""
    out = T.StructType([*OUT, *([T.StructField("restored", T.StringType())] if with_restored else [])])
    df = df.drop(*[c for c in (*OUT.names, "restored", "_digest", "_o", *(f"_{x}" for x in INDEX.names)) if c not in (text, doc_id)])
    index = boundary_index(df, text).select(F.col("digest").alias("_digest"), *[F.col(c).alias(f"_{c}") for c in INDEX.names])

    @F.arrow_udf(out)
    def of(column: pa.Array, n: pa.Array, width: pa.Array, low: pa.Array, high: pa.Array, h: pa.Array) -> pa.Array:
        rows = []
        for x, size, *packed, (h1, h2, h3, h4) in zip(column.to_pylist(), *(c.to_pylist() for c in (n, width, low, high, h))):
            form, a, b = "plain", None, None
            if x and h3 % 100 < CUT and not any(mark in x for mark in (PREFIX, SUFFIX, MIDDLE)):
                form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
                units = sorted((h1 % (size + 1), h2 % (size + 1)))
                ends = iter(select([k - 1 for k in units if k], *packed))
                a, b = (next(ends) if k else 0 for k in units)
            made = arrange(x, form, a, b)
            rows.append((size, form, a, None if a is None else b - a, made, *([restore(made, form)] if with_restored else [])))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds[: len(out)])], out.names)

    said = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.array(*[F.conv(F.substring(said, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])
    keyed = df.withColumn("_digest", F.unhex(F.sha2(text_or_empty(text), 256)))
    made = keyed.join(index, "_digest").withColumn("_o", of(text_or_empty(text), "_n", "_width", "_low", "_high", h))
    return made.select(*[F.col(c) for c in df.columns], "_o.*")
