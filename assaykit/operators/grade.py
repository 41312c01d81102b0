"""Grading of untrusted programs: a screen, a process per task with a timeout, and a repair loop.

The screen and the child process isolate faults; they are no security boundary.
"""

from __future__ import annotations

import ast
import multiprocessing as mp
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import settled

# What a program may import, and the names it may not use.
ALLOWED_IMPORTS = {"cadquery", "math", "numpy"}
BANNED_NAMES = {
    "open", "exec", "eval", "compile", "__import__", "globals", "locals", "vars", "input", "breakpoint",
    "getattr", "setattr", "delattr", "exit", "quit", "help", "memoryview", "__builtins__", "__loader__", "__spec__",
}
IO_ATTRIBUTES = {"exporters", "importers", "occ_impl", "vis", "jupyter_tools", "cq_directive", "save", "toSvg"}


class _Screen:
    """What single nodes have against them. The texts of the findings are fixed values."""

    def __init__(self):
        self.found: list[str] = []

    def visit_Import(self, node):
        self.found += [f"import of {x.name} is not allowed" for x in node.names if x.name.partition(".")[0] not in ALLOWED_IMPORTS]

    def visit_ImportFrom(self, node):
        if (node.module or "").partition(".")[0] not in ALLOWED_IMPORTS:
            self.found.append(f"import from {node.module} is not allowed")

    def visit_Name(self, node):
        if node.id in BANNED_NAMES:
            self.found.append(f"use of {node.id} is not allowed")

    def visit_Attribute(self, node):
        low = node.attr.lower()
        if node.attr.startswith("__"):
            self.found.append("dunder attribute access is not allowed")
        elif node.attr in IO_ATTRIBUTES or low.startswith("export") or low.startswith("import"):
            self.found.append(f"file access ({node.attr}) is not allowed")


def screen(code: str | None) -> str | None:
    """Why a program can't be run, or None."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError) as e:
        return f"SyntaxError: {getattr(e, 'msg', e)} (line {getattr(e, 'lineno', 0)})"
    seen = _Screen()
    for node in ast.walk(tree):  # outer nodes before inner ones, so the first finding is the outermost
        getattr(seen, f"visit_{type(node).__name__}", bool)(node)
        if seen.found:
            return seen.found[0]
    return None


def screened(code: Column) -> Column:
    """The screen's finding for each program, or null."""

    @F.pandas_udf("string")
    def of(programs: pd.Series) -> pd.Series:
        return programs.map(screen)

    return of(code)


def box_program(code: str) -> dict:
    """Runs a program that sets r to box extents; stands in for a modelling kernel."""
    import builtins
    import math

    problem = screen(code)
    if problem:
        return {"runs": False, "error": problem, "extents": None}
    safe = {k: getattr(builtins, k) for k in ("abs", "all", "any", "bool", "dict", "enumerate", "float", "int", "len", "list", "max", "min", "pow", "range", "round", "sorted", "sum", "tuple", "zip")}
    safe["__import__"] = lambda name, *_: {"math": math}[name]
    space = {"__builtins__": safe, "math": math, "box": lambda x, y, z: (float(x), float(y), float(z))}
    exec(compile(code, "program", "exec"), space)  # noqa: S102  in a child process of its own
    made = space.get("r")
    return {"runs": True, "error": None, "extents": list(made)} if made else {"runs": False, "error": "no solid was produced", "extents": None}


def _child(pipe, kernel, code):
    try:
        pipe.send(kernel(code))
    except BaseException as e:  # noqa: BLE001  whatever a program raises is its result
        pipe.send({"runs": False, "error": f"{type(e).__name__}: {e}"[:300], "extents": None})


def run_isolated(kernel: Callable[[str], dict], code: str, timeout: float) -> dict:
    """The kernel's result from a child process; a timeout or crash becomes an error value."""
    context = mp.get_context("fork")
    here, there = context.Pipe(duplex=False)
    child = context.Process(target=_child, args=(there, kernel, code), daemon=True)
    child.start()
    there.close()
    try:
        if here.poll(timeout):
            return here.recv()
        return {"runs": False, "error": f"timed out after {timeout:g}s", "extents": None}
    except EOFError:
        return {"runs": False, "error": "worker crashed", "extents": None}
    finally:
        child.kill()
        child.join()
        here.close()


GRADED = "runs boolean, error string, extents array<double>"


def grade(df: DataFrame, code: str = "code", kernel: Callable[[str], dict] = box_program, timeout: float = 5.0) -> DataFrame:
    """df with runs, error and extents of each program. Equal programs run once."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [run_isolated(kernel, x, timeout) for x in batch[code]]
            yield batch.assign(runs=[x["runs"] for x in found], error=[x["error"] for x in found], extents=[x["extents"] for x in found])

    done = df.select(code).where(F.col(code).isNotNull()).distinct().mapInPandas(each, f"{code} string, {GRADED}")
    return df.join(done, code, "left").withColumn("error", F.when(F.col(code).isNull(), "no code in the answer").otherwise(F.col("error"))).withColumn("runs", F.coalesce("runs", F.lit(False)))


def mock_answer(df: DataFrame, spec: str, item: str, wrong_rate: float, seed: int = 0) -> Column:
    """A deterministic model: the gold program (column gold_code), cut short for a hashed share of the items."""
    draw = F.pmod(F.conv(F.substring(F.md5(F.concat(F.col(item).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long"), F.lit(1000)) / 1000
    return F.when(draw < wrong_rate, F.concat(F.col("gold_code"), F.lit("\nr = ("))).otherwise(F.col("gold_code"))


def repair_loop(df: DataFrame, answer: Callable[[DataFrame, int], DataFrame], retries: int, code: str = "code", kernel: Callable[[str], dict] = box_program) -> DataFrame:
    """Ask, grade, and ask again for what failed, at most retries times more.

    answer(rows, attempt) adds the column code; later attempts see the columns runs and error. Only
    unresolved rows go on, and each attempt is materialised once. Adds attempts.
    """
    done, left = None, df
    for attempt in range(retries + 1):
        asked = answer(left, attempt).drop("runs", "error", "extents", "attempts")
        graded = grade(asked, code, kernel).withColumn("attempts", F.lit(attempt + 1))
        graded = settled(graded)
        over = graded if attempt == retries else graded.where("runs")
        done = over if done is None else done.unionByName(over)
        if attempt < retries:
            left = graded.where("not runs").drop(code)
    return done


def with_reward(df: DataFrame, gold: str = "gold_extents", code: str = "code", bonus: float = 0.5) -> DataFrame:
    """Graded rows with iou_aligned and reward."""
    from ..functions.geometry import aligned_box_iou, reward

    scored = aligned_box_iou(df, "extents", gold)
    return scored.withColumn("iou_aligned", F.when(F.col("runs"), F.col("iou_aligned"))).withColumn("reward", reward(F.col(code), F.col("runs"), F.col("iou_aligned"), bonus))
