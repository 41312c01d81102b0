"""Document quality by weak supervision.

Rules vote good, vote bad or abstain on each document. Expectation-maximisation over the votes
estimates how often each rule is right on good and on bad documents when it votes, and gives each
pattern of votes a posterior probability of quality; a document is kept by that probability, not
by passing all rules.

Scale: one map pass computes counts and votes. Votes are a base-3 number of ten digits, so the
whole corpus folds, by a partial aggregate, into at most 3^10 = 59,049 pattern counts; these are
a sufficient statistic, and the only thing the driver sees. The posteriors, as many rows at most,
are joined back to the documents by a broadcast that this bound keeps small.

Edge cases: null and empty texts have no words, get bad votes and fail the base rule; on an
empty table there is nothing to estimate and no row; ties of the probability with the threshold
keep the document; repeated rows are repeated documents; further
columns pass through, but for those with the name of a result or helper, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches, text_or_empty, utf8

# The characters that count as symbols, and frequent words of the corpus's languages.
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FREQUENT = {b"the", b"of", b"and", b"to", b"in", b"a", b"is", b"that", b"for", b"it", b"de", b"la", b"le", b"et", b"les", b"des", b"un", b"une", b"que", b"el", b"en", b"y", b"los", b"las", b"der", b"die", b"und", b"das", b"den", b"ein", b"eine", b"von", b"mit", b"zu"}
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["length", "symbols", "dup_lines", "repeats", "frequent_words", "capitals", "word_length", "exclamations", "variety", "table_lines"]
BAD, ABSTAIN, GOOD = 0, 1, 2
THRESHOLD = 0.5


def repeat_words(ids: np.ndarray) -> int:
    """Words covered by windows of five that occur at least twice, by exact numbering of pairs, fours and fives."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0

    def number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    two = number(ids[:-1], ids[1:])
    four = number(two[:-2], two[2:])
    _, five, count = np.unique(four[:n] * (int(ids.max()) + 1) + ids[4 : 4 + n], return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    again = np.flatnonzero(count[five] > 1)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[list[int], int]:
    """The five counts, and the votes as a base-3 number with the first rule in the lowest digit."""
    words = text.split()
    n = len(words)
    ids: dict[bytes, int] = {}
    numbers = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    held = b"".join(words)
    word_chars = len(held.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(numbers)
    upper = len(held) - len(held.translate(None, CAPITALS))
    frequent = sum(w in FREQUENT for w in words)
    bars = sum(x.count(b"|") > 1 for x in lines)
    m = max(n, 1)

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else ABSTAIN

    votes = [
        vote(n < 5, n >= 40),
        vote(symbols > 0.2 * m, symbols <= 0.05 * m),
        vote(3 * dup_lines > len(lines), dup_lines == 0 and len(lines) > 3),
        vote(repeats > 0.2 * m, repeats < 0.02 * m and n >= 40),
        vote(frequent < 0.01 * m and n >= 100, frequent > 0.08 * m),
        vote(upper > 0.4 * max(word_chars, 1), upper < 0.1 * max(word_chars, 1)),
        vote(word_chars < 2.5 * m or word_chars > 12 * m, 3.5 * m <= word_chars <= 9 * m),
        vote(text.count(b"!") > 0.1 * m, text.count(b"!") < 0.01 * m),
        vote(5 * len(ids) < n, 2 * len(ids) > n and n >= 40),
        vote(3 * bars > len(lines), bars == 0),
    ]
    return [n, word_chars, symbols, dup_lines, repeats], sum(v * 3**k for k, v in enumerate(votes))


def with_votes(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the five counts (long) and the vote pattern (int)."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("pattern", T.IntegerType())])

    df = df.drop(*COUNTS, "pattern", "_measured")
    small_batches(df.sparkSession)

    @F.arrow_udf(schema)
    def of(column: pa.Array) -> pa.Array:
        rows = [measure(x) for x in utf8(column)]
        counts = np.array([x[0] for x in rows], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([*(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array([x[1] for x in rows], pa.int32())], [*COUNTS, "pattern"])

    return df.withColumn("_measured", of(text_or_empty(text))).select(*df.columns, "_measured.*")


def digits(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(RULES)) % 3


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for two classes with rules that vote independently given the class; to abstain says nothing.

    Returns the posterior of quality for each pattern, the probability of a good vote [class, rule]
    and the share of good documents. It starts from the belief that a bad vote is seldom wrong,
    which also fixes which class is the good one.
    """
    votes = digits(patterns)
    good, bad = (votes == GOOD).astype(float), (votes == BAD).astype(float)
    post = 1 / (1 + np.exp(-(2 - 4 * bad.sum(1))))
    table, share = np.full((2, len(RULES)), 0.5), 0.5
    for _ in range(rounds):
        before = post
        for c, weight in enumerate(((1 - post) * counts, post * counts)):
            table[c] = (weight @ good + 1) / (weight @ (good + bad) + 2)
        share = float(np.clip((post * counts).sum() / counts.sum(), 0.01, 0.99))
        score = good @ np.log(table[1] / table[0]) + bad @ np.log((1 - table[1]) / (1 - table[0])) + np.log(share / (1 - share))
        post = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        if np.abs(post - before).max() < 1e-6:
            break
    return post, table, share


def assess(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without its text, with the five counts, quality (the posterior, to nine digits) and kept."""
    spark = df.sparkSession
    marked = cut(with_votes(df.drop("quality", "kept"), text).drop(text), "quality-votes")
    # at most 3^10 rows, whatever the size of the corpus
    seen = marked.groupBy("pattern").count().toPandas().sort_values("pattern")  # sums of floats follow their order
    patterns = seen["pattern"].to_numpy(np.int64)
    quality = np.round(fit(patterns, seen["count"].to_numpy(float))[0], 9) if len(seen) else np.empty(0)
    rows = spark.createDataFrame(list(zip(patterns.tolist(), quality.tolist())), "pattern int, quality double")
    return marked.join(F.broadcast(rows), "pattern").drop("pattern").withColumn("kept", F.col("quality") >= threshold)
