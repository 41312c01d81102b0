"""Conversation structure repair: the cheapest edits that make the roles read (s?(ua)+)?.

Conversations are hash-partitioned by id. Each task takes whole conversations in batches and runs
one recursive DuckDB query over a batch: every step of the recursion advances all its conversations
by one turn and keeps, for each state of the grammar, the smallest cost and its audit.

States: q0 nothing yet, q1 after system, q2 after user, q3 after assistant; q0 and q3 may end.
Edits: Keep (cost 0), Rerole to user or assistant (1), Delete (2, required for blank and duplicate
turns), Insert an empty user or assistant turn (5); a truncated turn that isn't deleted adds 5.
The audit holds the edits' initials. It fixes the state that it leads to and its cost, so of two
audits with equal cost and state neither is the start of the other: the ASCII-least whole audit
grows from the ASCII-least audit of each state, and one for each state is enough.

A turn's first fault counts: blank (no character but white space), duplicate (role and text seen
before in the conversation), truncated (its last such character isn't one of . ! ?).

Scale: one shuffle by conversation, sorted by Spark, streamed through the tasks in batches of
bounded rows and bytes. A conversation is one document and must fit in a task; a recursion takes
as many steps as the longest conversation in its batch has turns, and audits of n turns are
copied n times (20,000 turns: 16 s).

Edge cases: null roles and texts count as one space; turns are ordered by turn, then role, then text,
null turns first; a null conv_id is an id like any other; conversations without a turn that is there
give zeros and empty strings; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

ROWS, BYTES = 5_000, 16 << 20  # of a batch; its last conversation is taken whole
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

STEP = "create or replace temp macro step(q, k, edits) as case when q is not null then {'c': q.c + k, 'a': q.a || edits} end"
COSTS = """
with recursive marked as (
    select conv, pos, turn, role[1:1] as r, blank, unended, not blank and row_number() over (partition by conv, role, text order by pos) > 1 as again,
        lag(role[1:1]) over (partition by conv order by pos) || role[1:1] as pair
    from said
),
convs as (
    select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank, count_if(again) as duplicate,
        count_if(unended and not blank and not again) as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal,
        string_agg(case when blank or again then 'x' when r not in ('s', 'u', 'a') then if(unended, 'O', 'o') when unended then upper(r) else r end, '' order by pos) as codes
    from marked group by conv
),
-- a capital is a truncated turn, x one that must go, o one of another role; p2 and p3 allow inserts before the turn
walk(conv, i, codes, q0, q1, q2, q3) using key (conv) as (
    select conv, 0, codes, {'c': 0::bigint, 'a': ''}, null::struct(c bigint, a varchar), null::struct(c bigint, a varchar), null::struct(c bigint, a varchar) from convs
    union
    select conv, i + 1, codes,
        step(q0, 2, 'D'),
        least(step(q1, 2, 'D'), case when k = 's' then step(q0, t, 'K') end),
        least(step(p2, 2, 'D'), case when k = 'u' then step(least(q0, q1, p3), t, 'K') when k <> 'x' then step(least(q0, q1, p3), 1 + t, 'R') end),
        least(step(p3, 2, 'D'), case when k = 'a' then step(p2, t, 'K') when k <> 'x' then step(p2, 1 + t, 'R') end)
    from (
        select *, least(q3, step(p2, 5, 'I')) as p3
        from (
            select *, lower(codes[i + 1]) as k, if(codes[i + 1] = lower(codes[i + 1]), 0, 5) as t, least(q2, step(least(q0, q1, q3), 5, 'I')) as p2
            from walk where i < length(codes)
        )
    )
),
done as (select conv, least(q0, q3, step(q2, 5, 'I'), step(q1, 10, 'II')) as best from walk)
select conv, gaps, blank, duplicate, truncated, illegal, best.c as cost, best.a as audit from convs join done using (conv)
"""


def rewritten(audit: str, turns: list[tuple[str, str]]) -> str:
    """The repaired conversation, role:text joined by newlines, from its turns and the edits' initials."""
    out, left, user = [], iter(turns), True
    for edit in audit:
        role, text = next(left) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = "user" if user else "assistant"
        user = role[0] != "u"
        out.append(f"{role}:{text}")
    return "\n".join(out)


def _mended(con: duckdb.DuckDBPyConnection, table: pa.Table, start: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """One row for each conversation of a table of whole conversations; start: each one's first row."""
    conv = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(table)]))
    table = table.append_column("conv", pa.array(conv)).append_column("pos", pa.array(np.arange(len(table))))
    ids = table.column("conv_id").take(pa.array(start)).combine_chunks()
    said = table.drop_columns(["conv_id"]).filter(table.column("present"))
    con.register("said", said)
    found = {r[0]: r[1:] for r in con.execute(COSTS).fetchall()}
    con.unregister("said")
    turns: dict[int, list] = {}
    for k, role, text in zip(*(said.column(c).to_pylist() for c in ("conv", "role", "text"))):
        turns.setdefault(k, []).append((role, text))
    rows = [found.get(k, (0, 0, 0, 0, 0, 0, "")) for k in range(len(start))]
    columns = [[r[k] for r in rows] for k in range(len(COUNTS) + 1)] + [[rewritten(r[-1], turns.get(k, [])) for k, r in enumerate(rows)]]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, schema.types[1:]))], schema=schema)


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """conv_id, the COUNTS, audit and repaired (role:text lines) of each conversation.

    present: a boolean column; a row without it names its conversation and is no turn of it.
    """
    small_batches(df.sparkSession)
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), (F.col(present) if present else F.lit(True)).alias("present"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.withColumns({"blank": bare == "", "unended": ~F.substring(bare, -1, 1).isin(".", "!", "?")})
    dealt = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    out = T.StructType([T.StructField("conv_id", df.schema[conv_id].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired", T.StringType())])

    def of(batches):
        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        con.execute(STEP)
        schema, waiting = None, []

        def mended(last: bool):
            """Conversations that are complete, and the rows of the one that may not be."""
            table = pa.Table.from_batches(waiting)
            held = table.column("conv_id").combine_chunks().dictionary_encode("encode").indices.to_numpy()
            start = np.r_[0, np.flatnonzero(held[1:] != held[:-1]) + 1]
            if not last and len(start) > 1:
                table, rest, start = table.slice(0, start[-1]), table.slice(start[-1]).combine_chunks(), start[:-1]
            elif not last:
                return None, waiting
            else:
                rest = table.slice(len(table))
            return _mended(con, table, start, schema), rest.to_batches()

        for batch in batches:
            if schema is None:
                schema = pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *(pa.field(c, pa.int64()) for c in COUNTS), pa.field("audit", pa.string()), pa.field("repaired", pa.string())])
            if not batch.num_rows:
                continue
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= ROWS or sum(b.nbytes for b in waiting) >= BYTES:
                made, waiting = mended(last=False)
                if made is not None:
                    yield made
        if waiting:
            yield mended(last=True)[0]

    return dealt.mapInArrow(of, out)


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """df with seeded faults, for tests and measurements of repair(); rows that are dropped stay as not present."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    seed = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn))) % 20
    made = df.select(conv_id, turn, space(role).alias(role), space(text).alias(text), seed.alias("_s"))
    made = made.withColumns(
        {
            text: F.when(F.col("_s") == 1, "").when(F.col("_s") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text)),
            role: F.when(F.col("_s") == 4, "user").otherwise(F.col(role)),
            "present": F.col("_s") != 0,
        }
    )
    return made.withColumn("_s", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_s") == 3, 2).otherwise(1)))).drop("_s")
