"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers and names become typed placeholders, all else is lower-cased and
freed of punctuation. Names of several words, and numbers written in several, are one placeholder.
Windows of five such tokens are hashed and joined to the windows of the
benchmark by equality. A window with fewer than three other words is no template: it counts only
if its values are equal too. An item without a template, as short and numeric questions are, is one as a whole, if it
has two words that are no placeholders. Along each alignment of a text with an item, a slot value of the item must
mostly stand for the same value of the text. An item counts from a share of its windows, from a share of its tokens
that windows cover along one alignment, or from a
long run of its tokens, as a passage of it or an edited copy has; so a question that only had its values exchanged is
found, and a chance likeness of templates is not.

Scale: one map pass over whole texts; a window leaves its task only if a bitmap of the benchmark's
windows has two bits for it. The bitmap is folded in Spark and has BITS_MOST bits at most, 64 for
each window below that, so what the tasks get is bounded for any benchmark; what it lets
through goes into an exact join. The aggregates run on real hits only; equal texts are judged once and verdicts are joined
back by a 128-bit key of the text, which run-time skew splitting can divide.

Edge cases: null and empty texts are clean; items shorter than a window are one window of their
own length; items of numbers and names alone count only as they stand; items without a word are ignored; an item's id may be null; an empty benchmark
leaves all texts clean; repeated rows and further columns pass through, but for columns with the
name of a result or helper, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches, text_or_empty, utf8

WINDOW = 5
LITERALS = 3  # a window that is a template has at least so many words that are no placeholders
WHOLE = 2  # an item that is a template as a whole has at least so many
SHARE = 0.4  # of an item's windows, of those that are templates, or of its tokens along one alignment, that a leaking text holds
RUN = 13  # or so many of its tokens, next to each other but for gaps of one, along one alignment
CONSISTENT = 0.75  # of an item's slot values that keep to one value of the text
BITS_MOST = 1 << 27
STEP = np.uint64(0x9E3779B97F4A7C15)

# Unit names and number words of the benchmark's languages.
UNITS = set("mm cm m km in ft yd mi mg g kg t oz lb ml l gal s sec min h hr day days week weeks month months year years hz khz mhz ghz kb mb gb tb w kw mw v kv a ma j kj cal kcal pa kpa bar k c f usd eur gbp dollar dollars euro euros cent cents meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres hour hours minute minutes second seconds degree degrees percent".split())
NUMBER_WORDS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
ENDS = b".!?:"
EDGES = ".,;:!?\"'()[]{}<>*#&|_-/\\`~“”‘’«»…"

NAME, NUM, UNIT, AS_IT_STANDS = np.uint64(3), np.uint64(5), np.uint64(9), np.uint64(17)
CHUNK = 1 << 19  # bytes of text that are handled together


def _among(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_SPACE, IS_END, IS_DIGIT = _among(b" \t\n\r\x0b\x0c"), _among(ENDS), _among(b"0123456789")
IS_PUNCTUATION = _among(bytes(c for c in range(33, 127) if not chr(c).isalnum()))


class Powers:
    """Powers of STEP and of its inverse modulo 2^64, as far as they were asked for."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, STEP)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(pow(int(STEP), -1, 1 << 64)))])
        return self.up, self.down


_POWERS = Powers()


class Tokens:
    """The words of some texts after one another, by array operations over their bytes.

    word: hash of the bare lower-case word; token: the same, or a placeholder; slot: whether it is
    one; text: which text it is of; at and end: where it stands in raw. Words of punctuation only are left out.
    """

    def __init__(self, texts: list[bytes]):
        whole = b"\n".join(texts) + b"\n"
        low = whole.decode("utf-8", "replace").lower().encode()
        self.raw = raw = np.frombuffer(whole, np.uint8)
        low = np.frombuffer(low if len(low) == len(whole) else whole.lower(), np.uint8)
        space = IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.r_[True, space].view(np.int8)))  # word starts and ends by turns
        at, end = edge[::2], edge[1::2]
        kept = ~(space | IS_PUNCTUATION[raw])
        where = np.flatnonzero(kept)
        before = np.r_[0, np.cumsum(kept)]
        first, last = before[at], before[end]
        live = last > first
        at, end, first, last = at[live], end[live], first[live], last[live]
        up, down = _POWERS(len(where) + 1)
        sums = np.r_[np.uint64(0), np.cumsum((low[where].astype(np.uint64) + np.uint64(1)) * up[: len(where)])]
        word = _mixed((sums[last] - sums[first]) * down[first])
        changed = (raw != low)[where]
        n_changed = np.r_[0, np.cumsum(changed)]
        head = where[first]
        upper_head = (raw[head] != low[head]) | ((raw[head] >= 0xC3) & (raw[np.minimum(head + 1, len(raw) - 1)] != low[np.minimum(head + 1, len(raw) - 1)]))
        self.text = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), at, "right")
        starts = np.r_[True, self.text[1:] != self.text[:-1]] if len(at) else np.empty(0, bool)
        ends = IS_END[raw[end - 1]] | (IS_PUNCTUATION[raw[end - 1]] & IS_END[raw[np.maximum(end - 2, 0)]])
        number = IS_DIGIT[raw[head]] | _known(word, _NUMBER_WORDS)
        unit = _known(word, _UNITS) & np.r_[False, number[:-1]][: len(at)] & ~starts & ~number
        name = upper_head & (n_changed[last] - n_changed[first] == 1) & ~(starts | np.r_[True, ends[:-1]][: len(at)]) & ~number & ~unit
        self.word = word.copy()
        word[number], word[unit], word[name] = NUM, UNIT, NAME
        # a name or a number of several words is one slot, which ends with the last of them
        spelled = number & ~IS_DIGIT[raw[head]]
        bound = ~IS_PUNCTUATION[raw[end - 1]]  # no punctuation after it
        onward = np.r_[False, ((name[1:] & name[:-1]) | (spelled[1:] & spelled[:-1])) & bound[:-1] & ~starts[1:]][: len(at)]
        if onward.any():
            own = np.flatnonzero(~onward)
            self.word = np.where(np.r_[onward[1:], False] | onward, _joined(self.word, own), self.word)[own]
            self.text, word, end = self.text[own], word[own], end[np.r_[own[1:], len(at)] - 1]
            at, number, unit, name = at[own], number[own], unit[own], name[own]
        self.token, self.slot, self.at, self.end = word, number | unit | name, at, end

    def values(self, first: int, width: int) -> list[str]:
        """The texts of the slots in a window."""
        spots = [k for k in range(first, first + width) if self.slot[k]]
        return [self.raw[self.at[k] : self.end[k]].tobytes().decode("utf-8", "replace").strip(EDGES).lower() for k in spots]


def _joined(word: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of words in runs that begin at own, one hash for each run, at its first word."""
    out = word.copy()
    places = np.arange(len(word)) - np.repeat(own, np.diff(np.r_[own, len(word)]))
    out[own] = np.add.reduceat(_mixed(word + places.astype(np.uint64) * STEP), own)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _known(word: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Membership in a small set, looked for only where a table of 2^16 bits allows it."""
    bits, hashes = table
    out = bits[(word & np.uint64(0xFFFF)).astype(np.int64)]
    near = np.flatnonzero(out)
    out[near] = np.isin(word[near], hashes)
    return out


def _set(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    hashes = []
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8).astype(np.uint64) + np.uint64(1)
        hashes.append(_mixed((b * _POWERS(len(b))[0][: len(b)]).sum(keepdims=True))[0])
    hashes = np.array(hashes, np.uint64)
    bits = np.zeros(1 << 16, bool)
    bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    return bits, hashes


_NUMBER_WORDS, _UNITS = _set(sorted(NUMBER_WORDS)), _set(sorted(UNITS))


def chunks(texts: list[bytes]):
    """(index of the first text, texts) of groups of about CHUNK bytes."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size == 0 or size + len(texts[to]) <= CHUNK):
            size += len(texts[to]) + 1
            to += 1
        yield at, texts[at:to]
        at = to


def windows(found: Tokens, width: int = WINDOW, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each window (int64), whether it lies in one text, and whether it has words enough for a template.

    A window with fewer words is hashed with the values of its slots as they stand. whole: it stands for a whole item.
    """
    n = len(found.token) - width + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
    up, down = _POWERS(len(found.token) + 1)

    def rolled(x: np.ndarray) -> np.ndarray:
        sums = np.r_[np.uint64(0), np.cumsum(_mixed(x) * up[: len(x)])]
        return (sums[width:] - sums[:n]) * down[:n]

    out = rolled(found.token)
    words = np.cumsum(np.r_[0, ~found.slot])
    enough = words[width:] - words[:n] >= (WHOLE if whole else LITERALS)
    few = np.flatnonzero(~enough)
    if len(few):
        out[few] = rolled(found.word)[few] + AS_IT_STANDS
    return _mixed(out + np.uint64(width * int(STEP) % 2**64)).view(np.int64), found.text[:n] == found.text[width - 1 :], enough


HIT = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("slots", T.ArrayType(T.StringType())), T.StructField("template", T.BooleanType()), T.StructField("width", T.IntegerType())]))


def _column(rows: list[list[tuple[int, int, list[str], bool, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("slots", pa.list_(pa.string())), ("template", pa.bool_()), ("width", pa.int32())]))
    return pa.array([[{"h": h, "pos": p, "slots": s, "template": t, "width": w} for h, p, s, t, w in row] for row in rows], kind)


def _widths(item: Tokens) -> list[int]:
    """Widths of an item's windows: those of texts, and the whole item if it is short or has no template."""
    n = len(item.token)
    if n < WINDOW:
        return [n] if n else []
    return [WINDOW] if windows(item, WINDOW)[2].any() or n == WINDOW else [WINDOW, n]


def _item_windows(text: Column) -> Column:
    @F.arrow_udf(HIT)
    def of(column: pa.Array) -> pa.Array:
        rows = []
        for x in utf8(column):
            found = Tokens([x])
            row = []
            for width in _widths(found):
                h, within, enough = windows(found, width, whole=width != WINDOW)
                row += [(int(h[k]), k, found.values(k, width), bool(enough[k]), width) for k in np.flatnonzero(within).tolist()]
            rows.append(row)
        return _column(rows)

    return of(text)


class Filter:
    """A bitmap with two bits for each of the benchmark's window hashes."""

    def __init__(self, hashes: DataFrame, most: int = BITS_MOST):
        size = hashes.count()
        self.size = 1 << min(max(16, (64 * size).bit_length()), most.bit_length() - 1)
        places = hashes.select(F.explode(F.array(*[self._place(F.col("h"), k) for k in range(2)])).alias("p"))
        words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        bits = np.zeros(self.size >> 6, np.int64)
        for r in words.collect():  # one row for each 64 bits of the bitmap at most
            bits[r["w"]] = r["b"]
        self.bits = bits.view(np.uint8)

    def _place(self, h: Column, k: int) -> Column:
        return F.shiftrightunsigned(h, 31 * k).bitwiseAND(F.lit(self.size - 1))

    def among(self, h: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Indexes of the live hashes that the bitmap has."""
        spots = np.flatnonzero(live)
        for k in range(2):
            place = ((h[spots].view(np.uint64) >> np.uint64(31 * k)) & np.uint64(self.size - 1)).astype(np.int64)
            spots = spots[(self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0]
        return spots


def _text_windows(text: Column, wanted: Filter, widths: list[int]) -> Column:
    """Windows of a text that wanted lets through."""

    @F.arrow_udf(HIT)
    def of(column: pa.Array) -> pa.Array:
        texts = utf8(column)
        rows: list[list] = [[] for _ in texts]
        for first, part in chunks(texts):
            found = Tokens(part)
            begins = np.searchsorted(found.text, np.arange(len(part)))
            for width in widths:
                h, within, enough = windows(found, width, whole=width != WINDOW)
                for k in wanted.among(h, within).tolist():
                    t = int(found.text[k])
                    rows[first + t].append((int(h[k]), k - int(begins[t]), found.values(k, width), bool(enough[k]), width))
        return _column(rows)

    return of(text)


def _keys(text: str) -> list[Column]:
    whole = text_or_empty(text)
    return [F.xxhash64(whole).alias("_k1"), F.xxhash64(F.lit("text"), whole).alias("_k2")]


def _run(spots: Column) -> Column:
    """Most tokens that the windows at the places spots cover, in a stretch without a gap of more than one token."""
    state = lambda last, now, best: F.struct(last.alias("last"), now.alias("now"), best.alias("best"))

    def step(s, p):
        now = F.when(p - s["last"] <= WINDOW + 1, s["now"] + F.least(p - s["last"], F.lit(WINDOW))).otherwise(F.lit(WINDOW))
        return state(p, now, F.greatest(s["best"], now))

    return F.aggregate(F.array_sort(spots), state(F.lit(-9 * WINDOW), F.lit(0), F.lit(0)), step, lambda s: s["best"])


def _covered(spots: Column) -> Column:
    """Tokens that the windows at the places spots cover."""
    state = lambda last, n: F.struct(last.alias("last"), n.alias("n"))
    return F.aggregate(F.array_sort(spots), state(F.lit(-WINDOW), F.lit(0)), lambda s, p: state(p, s["n"] + F.least(p - s["last"], F.lit(WINDOW))), lambda s: s["n"])


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", most_bits: int = BITS_MOST) -> DataFrame:
    """Rows (_k1, _k2, item_id, share, consistent) for each text and benchmark item in it; the keys name the text."""
    small_batches(docs.sparkSession)
    items = benchmark.select("item_id", F.posexplode(_item_windows(text_or_empty("text"))).alias("_n", "w"))
    items = cut(items.select("item_id", F.col("w.h").alias("h"), F.col("w.pos").alias("item_pos"), F.col("w.slots").alias("item_slots"), F.col("w.template").alias("template"), F.col("w.width").alias("width")), "benchmark-windows")
    at = F.when(F.col("template"), F.col("item_pos"))
    sizes = items.groupBy("item_id").agg(F.countDistinct("item_pos").alias("item_windows"), F.countDistinct(at).alias("item_templates"), F.max(F.col("item_pos") + F.col("width")).alias("item_tokens"))
    wanted = Filter(items.select("h").distinct(), most_bits)
    # a width for each short length and each length of an item without a template: as many as items have tokens, at most
    widths = sorted(r["width"] for r in items.select("width").distinct().collect()) or [WINDOW]
    seen = docs.select(*_keys(text), _text_windows(text_or_empty(text), wanted, widths).alias("hits")).where(F.size("hits") > 0)
    seen = seen.dropDuplicates(["_k1", "_k2"])  # copies of a text leave each task as one row
    hits = seen.select("_k1", "_k2", F.explode("hits").alias("x")).select("_k1", "_k2", "x.h", "x.pos", "x.slots")
    matched = cut(hits.join(items, "h").select("_k1", "_k2", "item_id", (F.col("pos") - F.col("item_pos")).alias("lag"), "item_pos", "item_slots", "slots", "template", "width").distinct(), "benchmark-hits")
    share = matched.groupBy("_k1", "_k2", "item_id").agg(F.countDistinct("item_pos").alias("n"), F.countDistinct(at).alias("n_templates"))
    spots = F.collect_set(F.when(F.col("width") == WINDOW, F.col("item_pos")))
    runs = matched.groupBy("_k1", "_k2", "item_id", "lag").agg(_run(spots).alias("run"), F.greatest(_covered(spots), F.max(F.when(F.col("width") != WINDOW, F.col("width")))).alias("covered"))
    runs = runs.groupBy(F.col("_k1").alias("_r1"), F.col("_k2").alias("_r2"), F.col("item_id").alias("_held")).agg(F.max("run").alias("run"), F.max("covered").alias("covered"))
    same = lambda a, b: a["item_id"].eqNullSafe(b["item_id"])
    share = share.join(sizes.alias("z"), same(share, sizes)).select("_k1", "_k2", share.item_id, "item_tokens", F.greatest(F.col("n") / F.col("item_windows"), F.try_divide("n_templates", "item_templates")).alias("share"))
    pairs = matched.select("_k1", "_k2", "item_id", "lag", F.explode(F.arrays_zip("item_slots", "slots")).alias("z")).distinct()
    kept = pairs.groupBy("_k1", "_k2", "item_id", "lag", "z.item_slots").agg(F.count("*").alias("values"))
    kept = kept.groupBy("_k1", "_k2", "item_id").agg(F.avg((F.col("values") == 1).cast("double")).alias("consistent"))
    both = share.join(kept.select(F.col("_k1").alias("_j1"), F.col("_k2").alias("_j2"), F.col("item_id").alias("_item"), "consistent"), (F.col("_k1") == F.col("_j1")) & (F.col("_k2") == F.col("_j2")) & F.col("item_id").eqNullSafe(F.col("_item")), "left")
    both = both.join(runs, (F.col("_k1") == F.col("_r1")) & (F.col("_k2") == F.col("_r2")) & F.col("item_id").eqNullSafe(F.col("_held")), "left")
    both = both.withColumn("share", F.greatest("share", F.col("covered") / F.col("item_tokens")))
    found = (F.col("share") >= SHARE) | (F.col("run") >= RUN)
    return both.where(found).select("_k1", "_k2", "item_id", "share", F.coalesce("consistent", F.lit(1.0)).alias("consistent")).where(F.col("consistent") >= CONSISTENT)


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs with contaminated (boolean) and item_ids (sorted array of the items found)."""
    docs = docs.drop("contaminated", "item_ids", "_k1", "_k2")
    found = cut(leaks(docs, benchmark, text).groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.lit(True).alias("contaminated")), "leaking-texts")
    keyed = docs.select("*", *_keys(text)).join(found, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    return keyed.withColumn("contaminated", F.coalesce("contaminated", F.lit(False))).withColumn("item_ids", F.coalesce("item_ids", F.array().cast(found.schema["item_ids"].dataType)))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs without a leak; a column with the name of a helper is dropped."""
    docs = docs.drop("_k1", "_k2")
    found = cut(leaks(docs, benchmark, text).select("_k1", "_k2").distinct(), "leaking-texts")  # of a known size for the join's planning
    return docs.select("*", *_keys(text)).join(found, ["_k1", "_k2"], "left_anti").select(*docs.columns)
