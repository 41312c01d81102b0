"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once. Tokens keep their byte offsets, turns their
spans; both are sorted, so a binary search finds the tokens of each assistant turn. A token is
under the loss mask if it overlaps the text of an assistant turn; the control tokens around a
text are single ids, so no token reaches over its edge.

Template, for each turn:  <|im_start|>role<|im_sep|>text<|im_end|>  and a newline.
In roles and texts `<`, any backslashes and `|` get one more backslash in between, so that no
control string can stand in them; removing one again gives the text back.

Scale: one shuffle by conversation, which the ordered rendering needs; the rest is map-only. A
conversation is one document and must fit in a task, as a text does; nothing else is gathered.

Edge cases: null texts and roles count as empty; turns are ordered by turn, then role, then text,
null turns first; repeated rows are repeated turns; conversations with a null id form one of
their own; an empty table gives no rows; other columns of the input are dropped.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import load
from .common import lists, small_batches

# The control strings of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (START, SEP, END)
TRAINED = "assistant"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the byte spans of its trained texts, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        start = at + len(head.encode())
        end = start + len(body.encode())
        if role == TRAINED:
            spans.append((start, end))
        parts += [head, body, END, "\n"]
        at = end + len(END) + 1
    return "".join(parts), spans


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """What was rendered, read back."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def token_mask(ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap a span, given the sorted byte ends of consecutive tokens."""
    out = np.zeros(len(ends), bool)
    if spans:
        starts_at, ends_at = np.array(spans, np.int64).T
        first = np.searchsorted(ends, starts_at, "right")
        last = np.searchsorted(ends, ends_at, "left")
        for a, b, empty in zip(first.tolist(), last.tolist(), (starts_at == ends_at).tolist()):
            if not empty:
                out[a : b + 1] = True
    return out


def masked_text(formatted: str, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, in order, unescaped run by run."""
    raw = formatted.encode()
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    begin = np.r_[0, ends]
    return "".join(unescape(raw[begin[a] : begin[b]].decode("utf-8", "replace")) for a, b in edge.reshape(-1, 2).tolist())


OUT = T.StructType(
    [T.StructField("formatted", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("token_ends", T.ArrayType(T.LongType())), T.StructField("loss_mask", T.ArrayType(T.BooleanType()))]
)
READ = T.StructType(
    [T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))), T.StructField("loss_text", T.StringType())]
)


def _read(formatted: list[str], ends: list[np.ndarray], masks: list[np.ndarray]) -> list[pa.Array]:
    """The columns of READ."""
    turns = [turns_of(x) for x in formatted]
    offsets = pa.array(np.cumsum([0, *map(len, turns)]), pa.int32())
    pair = pa.StructArray.from_arrays([pa.array([t[k] for x in turns for t in x], pa.string()) for k in range(2)], ["role", "text"])
    return [pa.ListArray.from_arrays(offsets, pair), pa.array(list(map(masked_text, formatted, ends, masks)), pa.string())]


def format_conversations(df: DataFrame, path: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", with_read_back: bool = False) -> DataFrame:
    """conv_id, formatted, ids, token_ends (byte offsets) and loss_mask for each conversation.

    with_read_back: also what read_back adds, taken from the same outputs in the same pass.
    """
    small_batches(df.sparkSession)
    out = T.StructType([*OUT, *(READ if with_read_back else [])])

    @F.arrow_udf(out)
    def of(column: pa.Array) -> pa.Array:
        bpe = load(path, CONTROLS)
        formatted, ids, ends, masks = [], [], [], []
        for turns in column.to_pylist():
            said, spans = render([(x["role"], x["text"]) for x in turns])
            found = bpe.encode(said)
            end = np.cumsum(bpe.token_len[found])
            formatted.append(said)
            ids.append(found)
            ends.append(end)
            masks.append(token_mask(end, spans))
        columns = [pa.array(formatted, pa.string()), lists(ids, pa.int32()), lists(ends, pa.int64()), lists(masks, pa.bool_())]
        return pa.StructArray.from_arrays(columns + (_read(formatted, ends, masks) if with_read_back else []), out.names)

    turns = df.select(F.col(conv_id), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("_t"))
    whole = turns.groupBy(conv_id).agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    return whole.select(conv_id, of(F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias("_o")).select(conv_id, "_o.*")


def read_back(df: DataFrame) -> DataFrame:
    """Adds turns and loss_text, both taken from formatted, token_ends and loss_mask alone."""
    small_batches(df.sparkSession)

    def rows(column: pa.Array) -> list[np.ndarray]:
        at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        return [flat[a:b] for a, b in zip(at[:-1], at[1:])]

    @F.arrow_udf(READ)
    def of(formatted: pa.Array, ends: pa.Array, mask: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_read(formatted.to_pylist(), rows(ends), rows(mask)), READ.names)

    whole = F.when(F.length("formatted") >= 0, F.col("formatted"))  # keeps the two functions apart, so the first runs once
    return df.withColumn("_r", of(whole, F.when(F.size("token_ends") >= 0, F.col("token_ends")), F.when(F.size("loss_mask") >= 0, F.col("loss_mask")))).select(*df.columns, "_r.*")
