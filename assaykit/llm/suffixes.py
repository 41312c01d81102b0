"""Removal of byte passages that an earlier document holds, by common-prefix intervals of suffix arrays.

A window is 50 bytes of one text. Its anchor is the smallest hash among its byte groups of 16, so
equal windows have equal anchors; neighbouring windows with one anchor form a segment, of up to 84
bytes. Only segments with an anchor in common can share a window, so each set of segments with one
anchor can be sorted by itself:

1. Texts are cut into segments, of which the hashes and places are dealt by anchor. Anchors of one
   document go. Where all segments of an anchor are equal they are one leaf of the tree: what isn't the
   smallest document's goes. Else of equal segments two stay, of the two smallest documents; further
   copies share the second one's fate, which is removal.
2. The bytes of those that stay are read and dealt by anchor. Each task builds enhanced suffix
   arrays: suffixes of 50 bytes or more in order, and the common prefix of each with the one before.
   A scan with a stack gives the tree of common-prefix intervals; an interval whose suffixes have
   different bytes on their left is a maximal repeat, and comes out with all its occurrences.
3. Every occurrence of a maximal repeat in another document than the smallest one's is removed.
   Each window has a maximal repeat around it with the same occurrences, so none is missed.

Scale: three equality shuffles, of 40 bytes for each 17 of text, of the segments that repeat, and of texts;
nothing is broadcast or collected. The first two of these are made for a share of all anchors at a time (SLICES), since their files are
larger than the texts; partitions follow the bytes of the texts, so that sorts fit in memory and don't spill. Copies are folded in each task before the first of these. An anchor
with many different segments, such as the edge of a line that a third of all texts hold, would
make one task's work: a task that meets 64 of one anchor sends a mark in place of them, and marked
anchors (or those of more than 4,096 segments) have their windows dealt by the window's own hash.
Every step is written to the shared folder, so a lost executor costs tasks, not steps.

Edge cases: null and empty texts and texts under 50 bytes keep all; so do rows with a null id, which no
document is smaller than. Rows that share an id are one document and don't take from each other;
different texts under one id are told apart by 26 bits of a hash. What is kept may cut characters in
two, so it is bytes. Further columns pass through, but for those with the name of a result
or helper, which are replaced; an empty table gives no rows. Ids are integers.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget, held, small_batches, text_or_empty, utf8
from .substring import A, mixed

LEAST = 50
GROUP = 16
PART = 1 << 20  # longer texts are taken in parts
FLUSH = 1 << 20  # segments folded at a time
LOCAL_HOT, HOT = 64, 4_096
SORTED = 1 << 21  # bytes of segments in one suffix array
ROWS = 20_000  # of a batch without texts
SLICES = 2  # of the anchors; the texts are cut up once for each
PART_BYTES = 8 << 20  # of text for each partition of a shuffle

UNIT, MARK, WINDOW, COPY, ASK = range(5)
LINE = [("kind", "int"), ("key", "long"), ("unit", "long"), ("doc", "long"), ("place", "long")]
KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _schema(fields) -> tuple[str, pa.Schema]:
    return ", ".join(f"{n} {t}" for n, t in fields), pa.schema([(n, KINDS[t]) for n, t in fields])


LINES, LINES_ARROW = _schema(LINE)
BYTES, BYTES_ARROW = _schema([x for x in LINE if x[0] != "unit"] + [("segment", "binary")])
GROUPS, GROUPS_ARROW = _schema([("group", "long"), ("bytes", "int"), ("doc", "long"), ("place", "long"), ("least", "long")])


def _rows(schema: pa.Schema, *columns):
    columns = [c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def place(tag, first, n):
    """One number for a text's tag (26 bits), a first byte (32 bits) and a number of windows (6 bits)."""
    return (np.uint64(tag) << np.uint64(38)) | (np.asarray(first).astype(np.uint64) << np.uint64(6)) | np.asarray(n).astype(np.uint64)


def tag_of(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw, 11) >> 38


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of A and of its inverse modulo 2^64."""
    make = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(PART + LEAST, x, np.uint64))])
    return make(int(A)), make(pow(int(A), -1, 1 << 64))


def segments(raw: bytes):
    """Yields (first window, number of windows, anchor, hash) arrays of a text's segments."""
    up, down = held("powers", _powers)
    for at in range(0, len(raw) - LEAST + 1, PART):
        b = np.frombuffer(raw, np.uint8, min(PART + LEAST - 1, len(raw) - at), at)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * up[: len(b)], out=sums[1:])
        group = mixed((sums[GROUP:] - sums[:-GROUP]) * down[: len(b) - GROUP + 1])
        low = np.uint64(2 * PART - 1)
        least, span, all_of = (group & ~low) | np.arange(len(group), dtype=np.uint64), 1, LEAST - GROUP + 1
        while span < all_of:
            step = min(span, all_of - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        where = (least & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        n = np.diff(np.r_[first, len(where)])
        whole = mixed((sums[first + n + LEAST - 1] - sums[first]) * down[first] + n.astype(np.uint64))
        yield at + first, n, group[where[first]], whole


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows with equal values begin."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _spread(starts: np.ndarray, n: int) -> np.ndarray:
    """The number of each row's run."""
    out = np.zeros(n, np.int64)
    out[starts] = 1
    return np.cumsum(out) - 1


def _folded(key, unit, doc, at):
    """Lines of one flush: of equal segments those of the smallest document stay, the rest are copies; anchors with many segments are marked."""
    order = np.argsort(key, kind="stable")
    single = np.diff(np.r_[starts := _starts(key[order]), len(key)]) == 1
    alone = order[starts[single]]
    yield _rows(LINES_ARROW, np.full(len(alone), UNIT), key[alone], unit[alone], doc[alone], at[alone])
    rest = np.setdiff1d(order, alone, assume_unique=True)
    rest = rest[np.lexsort((doc[rest], unit[rest], key[rest]))]
    key, unit, doc, at = key[rest], unit[rest], doc[rest], at[rest]
    pairs = _starts(key, unit)
    kind = np.where(doc > doc[pairs][_spread(pairs, len(doc))], COPY, UNIT) if len(doc) else np.empty(0, np.int64)
    keys = _starts(key)
    different = np.diff(np.searchsorted(pairs, np.r_[keys, len(key)]))
    hot = np.repeat(different >= LOCAL_HOT, np.diff(np.r_[keys, len(key)]))
    kind = np.where(hot & (kind == UNIT), WINDOW, kind)
    marked = key[keys[different >= LOCAL_HOT]]
    elsewhere = mixed(at ^ mixed(doc.view(np.uint64)))  # what is settled is dealt evenly
    yield _rows(LINES_ARROW, kind, np.where(kind == UNIT, key, elsewhere), unit, doc, at)
    none = np.zeros(len(marked), np.int64)
    yield _rows(LINES_ARROW, np.full(len(marked), MARK), marked, none, none, none)


def _cut_up(batches, share: int = 0, of: int = 1):
    """Lines of the segments of texts whose anchors fall into one share of several."""
    parts, n = [], 0
    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            tag = tag_of(raw) if len(raw) >= LEAST else 0
            for first, count, anchor, whole in segments(raw):
                mine = anchor % np.uint64(of) == share
                first, count = first[mine], count[mine]
                parts.append((anchor[mine], whole[mine], np.full(len(first), doc), place(tag, first, count)))
                n += len(first)
            if n >= FLUSH:
                yield from _folded(*(np.concatenate(x) for x in zip(*parts)))
                parts, n = [], 0
    if n:
        yield from _folded(*(np.concatenate(x) for x in zip(*parts)))


def _settled(kind, key, unit, doc, at):
    """Lines of whole anchors, sorted by key: those to compare, to take window by window, and copies."""
    marked = np.unique(key[kind == MARK])
    busy = (kind == UNIT) & np.isin(key, marked)
    known = (kind == COPY) | (kind == WINDOW) | busy
    yield _rows(LINES_ARROW, np.where(busy, WINDOW, kind)[known], key[known], unit[known], doc[known], at[known])
    rest = np.flatnonzero((kind == UNIT) & ~busy)
    sizes = np.diff(np.r_[_starts(key[rest]), len(rest)])
    rest = rest[np.repeat(sizes > 1, sizes)]  # a segment that is its anchor's only one shares nothing
    if not len(rest):
        return
    rest = rest[np.lexsort((doc[rest], unit[rest], key[rest]))]
    key, unit, doc, at = (x[rest] for x in (key, unit, doc, at))
    keys, pairs = _starts(key), _starts(key, unit)
    of_key, of_pair = _spread(keys, len(key)), _spread(pairs, len(key))
    different = np.diff(np.searchsorted(pairs, np.r_[keys, len(key)]))
    across = np.minimum.reduceat(doc, keys) < np.maximum.reduceat(doc, keys)
    docs = _starts(key, unit, doc)  # a document's place among those of its segment
    rank = _spread(docs, len(key)) - np.searchsorted(docs, pairs)[of_pair]
    asked = (across & (different > 1))[of_key] & (rank <= 1)
    many = np.maximum(different, np.add.reduceat(asked, keys) // 2) > HOT  # a document may hold a segment very often
    out = np.where(asked, np.where(many[of_key], WINDOW, ASK), np.where(rank > 0, COPY, UNIT))
    stays = out != UNIT
    yield _rows(LINES_ARROW, out[stays], key[stays], unit[stays], doc[stays], at[stays])


def _by_key(batches, settle, columns: int, most: int, over):
    """Hands whole keys to settle; over(rows) takes part of a key with more than `most` rows and gives what to keep of it.

    Keys are columns[1]; rows come sorted by it.
    """
    waiting, n, hot = [], 0, None

    def joined():
        return [np.concatenate([w[k] for w in waiting]) for k in range(columns)]

    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(rows[1]):
            continue
        waiting.append(rows)
        n += len(rows[1])
        if n < most:
            continue
        rows = joined()
        done = int(np.searchsorted(rows[1], rows[1][-1]))
        whole, left = [c[:done] for c in rows], [c[done:] for c in rows]
        if hot is not None and done and whole[1][0] == hot:
            end = int(np.searchsorted(whole[1], hot, "right"))
            made, _ = over([c[:end] for c in whole], True)
            yield from made
            whole = [c[end:] for c in whole]
        if done:
            hot = None
            yield from settle(*whole)
        if len(left[1]) >= most:
            made, left = over(left, False)
            hot = left[1][0] if len(left[1]) else rows[1][-1]
            yield from made
        waiting, n = [left], len(left[1])
    if n:
        rows = joined()
        if hot is not None and rows[1][0] == hot:
            end = int(np.searchsorted(rows[1], hot, "right"))
            made, _ = over([c[:end] for c in rows], True)
            yield from made
            rows = [c[end:] for c in rows]
        yield from settle(*rows)


def _gathered(batches):
    """Lines dealt by anchor, settled anchor by anchor; one with very many lines is taken window by window as it passes."""

    def over(rows, last):
        keep = rows[0] != MARK
        kind = np.where(rows[0] == UNIT, WINDOW, rows[0])
        return [_rows(LINES_ARROW, *(c[keep] for c in (kind, *rows[1:])))], [c[:0] for c in rows]

    yield from _by_key(batches, _settled, 5, 1 << 18, over)


def intervals(common: list[int], least: int):
    """(length, first, last) of every common-prefix interval; common[k] is what suffixes k and k + 1 share."""
    stack: list[tuple[int, int]] = []
    for k, c in enumerate([*common, 0]):
        first = k
        while stack and stack[-1][0] > c:
            length, first = stack.pop()
            yield length, first, k
        if c >= least and (not stack or stack[-1][0] < c):
            stack.append((c, first))


def maximal_repeats(parts: list[bytes], docs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(group, length, part, offset) arrays: all occurrences of each maximal repeat of `least` bytes or more.

    Repeats within one document only are left out. A part's first byte has nothing on its left, which counts
    as different from anything. Bytes 255, which UTF-8 never has, end the parts.
    """
    none = (np.empty(0, np.int64),) * 4
    sizes = np.array(list(map(len, parts)), np.int64)
    width = int(sizes.max(initial=0))
    if width < least:
        return none
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    flat = np.frombuffer(b"\xff".join(parts) + b"\xff" * width, np.uint8)
    many = np.maximum(sizes - least + 1, 0)
    part = np.repeat(np.arange(len(parts)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = begin[part] + offset
    suffix = np.lib.stride_tricks.sliding_window_view(flat, width)[at]
    order = np.argsort(suffix.view(f"S{width}").ravel())
    part, offset, at, suffix = part[order], offset[order], at[order], suffix[order]
    same = suffix[1:] == suffix[:-1]
    left_in = sizes[part] - offset
    common = np.minimum(np.where(same.all(1), width, same.argmin(1)), np.minimum(left_in[1:], left_in[:-1]))
    before = np.where(offset > 0, flat[at - 1], 255)
    # suffixes whose neighbours share enough, in runs; a run with one byte on all lefts, or of one document, has no maximal repeat
    linked = common >= least
    runs = _starts(linked)
    runs = runs[linked[runs]] if len(runs) else runs
    if not len(runs):
        return none
    ends = np.r_[_starts(linked), len(linked)]
    ends = ends[np.searchsorted(ends, runs) + 1]
    edges = np.stack([runs, ends + 1], 1).ravel()
    span = lambda f, x: f.reduceat(np.r_[x, x[-1:]], edges)[::2]
    doc = docs[part]
    worth = ((span(np.minimum, before) != span(np.maximum, before)) | (span(np.maximum, before) == 255)) & (span(np.minimum, doc) != span(np.maximum, doc))
    length, first, last = [], [], []
    for a, b in zip(runs[worth].tolist(), ends[worth].tolist()):
        for n, x, y in intervals(common[a:b].tolist(), least):
            lefts = before[a + x : a + y + 1]
            if lefts.max() == 255 or lefts.min() != lefts.max():
                length.append(n)
                first.append(a + x)
                last.append(a + y + 1)
    count = np.array(last, np.int64) - np.array(first, np.int64)
    group = np.repeat(np.arange(len(count)), count)
    member = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - np.array(first, np.int64), count)
    across = np.ones(0, bool)
    if len(count):
        heads = np.cumsum(count) - count
        across = (np.minimum.reduceat(doc[member], heads) < np.maximum.reduceat(doc[member], heads))[group]
    return group[across], np.repeat(np.array(length, np.int64), count)[across], part[member][across], offset[member][across]


def _compared(kind, key, doc, at, segment):
    """Rows of GROUPS for rows of BYTES with whole keys."""
    done = kind == COPY
    none = np.zeros(done.sum(), np.int64)
    yield _rows(GROUPS_ARROW, none, ((at[done] & 63) + LEAST - 1).astype(np.int32), doc[done], at[done], np.full(done.sum(), -(2**63)))
    doc, at, parts = doc[~done], at[~done], segment[~done]
    begin, size = 0, 0
    cuts = []
    for k, (x, same) in enumerate(zip(parts, np.r_[False, key[~done][1:] == key[~done][:-1]].tolist() if len(parts) else [])):
        if size >= SORTED and not same:
            cuts.append((begin, k))
            begin, size = k, 0
        size += len(x)
    for a, b in [*cuts, (begin, len(parts))]:
        some = list(parts[a:b])
        group, length, part, offset = maximal_repeats(some, doc[a:b])
        if not len(group):
            continue
        heads = _starts(group)
        texts = [some[p][o : o + n] for p, o, n in zip(part[heads].tolist(), offset[heads].tolist(), length[heads].tolist())]
        names = np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64)
        run = _spread(heads, len(group))
        own = doc[a:b][part]
        yield _rows(GROUPS_ARROW, names[run], length.astype(np.int32), own, (at[a:b][part] & ~np.int64(63)) + (offset << 6), np.minimum.reduceat(own, heads)[run])


def _sorted(batches):
    def over(rows, last):
        # only windows dealt by their own hash come in such numbers; all are equal, and the first one's document is the smallest
        made = list(_compared(*rows))
        return made, [c[:1] for c in rows] if not last else [c[:0] for c in rows]

    yield from _by_key(batches, _compared, 5, 1 << 15, over)


def _bytes_of(batches):
    """Rows of BYTES for texts and their lines; of equal windows in one batch those of the smallest document stay."""
    for batch in batches:
        raws, docs = utf8(batch.column("text")), batch.column("doc").to_pylist()
        lines = batch.column("lines")
        ends, flat = lines.offsets.to_numpy(), lines.values
        kinds, keys, places = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        out, windows = [], []
        for raw, doc, a, b in zip(raws, docs, ends[:-1].tolist(), ends[1:].tolist()):
            tag = tag_of(raw)
            for kind, key, x in zip(kinds[a:b].tolist(), keys[a:b].tolist(), places[a:b].tolist()):
                x &= (1 << 64) - 1
                if x >> 38 != tag:
                    continue
                first, n = x >> 6 & 0xFFFFFFFF, x & 63
                if kind == ASK:
                    out.append((ASK, key, doc, x, raw[first : first + n + LEAST - 1]))
                else:
                    for k in range(n):
                        piece = raw[first + k : first + k + LEAST]
                        windows.append((xxhash.xxh64_intdigest(piece), doc, (x & ~63) + (k << 6) | 1, piece))
        least: dict[bytes, int] = {}
        for _, doc, _, piece in windows:
            least[piece] = min(doc, least.get(piece, doc))
        for key, doc, x, piece in windows:
            out.append((WINDOW, key, doc, x, piece) if doc == least[piece] else (COPY, x * 0x9E3779B97F4A7C15 + doc, doc, x, None))
        for at in range(0, len(out), 20_000):
            kind, key, doc, x, piece = zip(*out[at : at + 20_000])
            signed = lambda v: np.array([y & (1 << 64) - 1 for y in v], np.uint64)
            yield _rows(BYTES_ARROW, kind, signed(key), doc, signed(x), piece)


def parts_for(df: DataFrame, text: str = "text") -> int:
    """How many partitions keep a shuffle of the texts, or of lines about them, within a task's memory."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def repeat_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """group, bytes, doc, place and least: occurrences of maximal repeats after the smallest document, and that document.

    group is a hash of the repeated bytes; place holds a tag of the text and the first byte (see place). Copies of
    segments have group 0 and the length of their segment; they repeat an earlier document's.
    """
    spark = df.sparkSession
    small_batches(spark)
    texts = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    parts = parts or parts_for(df, text)
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    few = spark.conf.get(records)
    spark.conf.set(records, str(ROWS))  # batches of texts are bounded by their bytes
    try:
        told = []
        for share in range(SLICES):
            lines = texts.where(F.octet_length("text") >= LEAST).mapInArrow(partial(_cut_up, share=share, of=SLICES), LINES)
            lines = cut(lines.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_gathered, LINES), "suffix-lines", tidy=True)
            asked = lines.where(F.col("kind") != COPY).repartition(parts, "doc").groupBy("doc").agg(F.collect_list(F.struct("kind", "key", "place")).alias("lines"))
            pieces = texts.repartition(parts, "doc").join(asked, "doc").select("doc", "text", "lines").mapInArrow(_bytes_of, BYTES)
            told.append(cut(pieces.repartition(parts, "key").sortWithinPartitions("key", "doc").mapInArrow(_sorted, GROUPS).where("doc > least"), "suffix-groups", tidy=True))
            copies = lines.where(F.col("kind") == COPY).select(F.lit(0).cast("long").alias("group"), (F.col("place").bitwiseAND(63) + LEAST - 1).cast("int").alias("bytes"), "doc", "place", F.lit(-(2**63)).alias("least"))
            told.append(cut(copies, "suffix-copies"))
            forget(lines)
    finally:
        spark.conf.set(records, few)
    return reduce(DataFrame.unionByName, told)


KEPT = T.StructType([T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())])


def remove_earlier(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with n_bytes, n_removed, n_spans and kept, the text's bytes that no maximal repeat with a smaller document covers."""
    df = df.drop(*[c for c in (*KEPT.names, "_doc", "_spans", "_out") if c not in (doc_id, text)])

    @F.arrow_udf(KEPT)
    def of(column: pa.Array, places: pa.Array, lengths: pa.Array) -> pa.Array:
        total, removed, spans, kept = [], [], [], []
        for raw, at, n in zip(utf8(column), places.to_pylist(), lengths.to_pylist()):
            runs = np.empty((0, 2), np.int64)
            if at:
                at, n, edge = np.array(at, np.int64).view(np.uint64), np.array(n), np.zeros(len(raw) + 1, np.int64)
                own = (at >> np.uint64(38)).astype(np.int64) == tag_of(raw)
                first = (at[own] >> np.uint64(6) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + n[own], -1)
                runs = np.flatnonzero(np.diff(np.r_[False, np.cumsum(edge[:-1]) > 0, False])).reshape(-1, 2)
            total.append(len(raw))
            removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
            spans.append(len(runs))
            bounds = [0, *runs.ravel().tolist(), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2])))
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], KEPT.names)

    parts = parts_for(df, text)
    spans = repeat_groups(df, doc_id, text, parts).select(F.col("doc").alias("_doc"), "place", "bytes").repartition(parts, "_doc")
    taken = spans.groupBy("_doc").agg(F.collect_list(F.struct("place", "bytes")).alias("_spans"))
    joined = df.repartition(parts, F.col(doc_id).cast("long")).join(taken, F.col(doc_id).cast("long") == F.col("_doc"), "left")
    return joined.withColumn("_out", of(text_or_empty(text), F.col("_spans.place"), F.col("_spans.bytes"))).select(*[F.col(c) for c in df.columns], "_out.*")
