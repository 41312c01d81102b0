"""Byte-level BPE encoding and decoding with a public vocabulary.

Each word is merged in a contiguous rank array: two short lists hold the parts (a part is the id
of what lies between two boundaries) and, for every boundary, the rank of the pair that meets
there; the smallest rank is looked for by a scan, its boundary is deleted, and only the two
neighbouring ranks are refreshed. Words over SHORT bytes, for
which the scans would be quadratic, take a heap of the same ranks and give the same parts.

Scale: map-only. A text is cut into pieces at single spaces, each task keeps a bounded table
from piece to ids, so a frequent word is merged once for each task and not once for each use.
Nothing is shuffled, and the only state is that table.

Edge cases: a null or empty text has no ids and decodes to the empty text; tables without rows
give no rows; repeated rows and further columns pass through; a column with the name of a result
is replaced. The special token in a text is
one id, as in the public library's default.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, lists, small_batches, text_or_empty, utf8

# Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SHORT = 128
HELD = 120_000
NO_RANK = 1 << 60
SPACE_BEFORE_SPACE = re.compile(r"\s ")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that
    print as themselves keep their character, the others take the next free ones from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Held(dict):
    """What has been made from each text, for `most` texts at least and twice that at most.

    When it is full, the texts in use since it was last full stay. Long texts aren't held.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, text: str):
        out = self.old.get(text)
        if out is None:
            out = self.make(text)
        if len(text) <= SHORT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[text] = out
        return out


class ByteBpe:
    """A vocabulary in memory: about 50,000 entries, loaded once for each Python worker.

    extra: control strings that become single ids after the vocabulary's own. most: size of the
    tables from texts to ids.
    """

    def __init__(self, path: str, extra: tuple[str, ...] = (), most: int = HELD):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.token_bytes = {i: bytes(symbols[c] for c in token) for token, i in vocab.items()}
        self.byte_id = [0] * 256
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        #: rank_of[left][right] is the rank of merging two parts, merged[rank] the id it makes
        self.rank_of: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        self.merged: list[int] = []
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank_of[vocab[left]].setdefault(vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        top = max([*self.token_bytes, *self.special.values()])
        self.special |= {x: top + 1 + k for k, x in enumerate(extra)}
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.held, self.held_after_space, self.held_words = Held(self._piece, most), Held(lambda x: self._piece(" " + x), most), Held(self._word, most)
        size = max(self.token_bytes) + 1
        self.table = [self.token_bytes.get(i, b"") for i in range(size)]
        self.token_len = np.array([len(x) for x in self.table], np.int64)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self._scan(word) if len(word) <= SHORT else self._heap(word)

    def _scan(self, word: bytes) -> list[int]:
        rank_of, merged = self.rank_of, self.merged
        ids = [*map(self.byte_id.__getitem__, word)]
        ranks = [rank_of[left].get(right, NO_RANK) for left, right in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            ids[at] = new = merged[least]
            del ids[at + 1], ranks[at]  # the boundary between the two parts
            if at:
                ranks[at - 1] = rank_of[ids[at - 1]].get(new, NO_RANK)
            if at < len(ranks):
                ranks[at] = rank_of[new].get(ids[at + 1], NO_RANK)
        return ids

    def _heap(self, word: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in word]
        n = len(ids)

        def pair(x: tuple[int, int]) -> int:
            return self.rank_of[x[0]].get(x[1], NO_RANK)

        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(r, k) for k in range(n - 1) if (r := pair((ids[k], ids[k + 1]))) != NO_RANK]
        heapq.heapify(queue)
        while queue:
            rank, k = heapq.heappop(queue)
            right = after[k]
            if ids[k] < 0 or right < 0 or pair((ids[k], ids[right])) != rank:
                continue
            ids[k], ids[right] = self.merged[rank], -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left, here in ((before[k], k), (k, after[k])):
                if left >= 0 and here >= 0 and (r := pair((ids[left], ids[here]))) != NO_RANK:
                    heapq.heappush(queue, (r, left))
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        return array("i", self.merge(word.encode())).tobytes()

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.held_words.__getitem__, self.words.findall(piece)))

    def _plain(self, text: str) -> bytes:
        """Int32 ids of a text without special tokens.

        A space between two characters that are no white space always begins a pre-token, so
        the pieces between such spaces can be encoded one by one.
        """
        if SPACE_BEFORE_SPACE.search(text):
            return b"".join(map(self.held.__getitem__, pieces(text)))
        first, *rest = text.split(" ")
        return self.held[first] + b"".join(map(self.held_after_space.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        if self.split_special and "<" in text:
            parts = self.split_special.split(text)
            packed = b"".join(np.int32(self.special[x]).tobytes() if k % 2 else self._plain(x) for k, x in enumerate(parts))
        else:
            packed = self._plain(text)
        return np.frombuffer(packed, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def pieces(text: str) -> list[str]:
    """Cut before each space that stands between two characters that are no white space."""
    first, *rest = text.split(" ")
    out, open_piece = [], first
    for x in rest:
        # what str.isspace() calls space holds all that the pattern's \s does
        if x and open_piece and not x[0].isspace() and not open_piece[-1].isspace():
            out.append(open_piece)
            open_piece = " " + x
        else:
            open_piece += " " + x
    out.append(open_piece)
    return out


def load(path: str, extra: tuple[str, ...] = (), most: int = HELD) -> ByteBpe:
    """The worker's vocabulary."""
    return held(("bpe", path, extra, most), lambda: ByteBpe(path, extra, most))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", extra: tuple[str, ...] = ()) -> DataFrame:
    """df with the token ids of the column text, as array<int>."""
    small_batches(df.sparkSession)

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids_of(column: pa.Array) -> pa.Array:
        bpe = load(path, extra)
        return lists([bpe.encode(x.decode("utf-8", "replace")) for x in utf8(column)], pa.int32())

    return df.withColumn(ids, ids_of(text_or_empty(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", extra: tuple[str, ...] = ()) -> DataFrame:
    """df with the text of the token ids; bytes that are no UTF-8 become replacement characters. Null ids give null."""
    small_batches(df.sparkSession)

    @F.arrow_udf(T.StringType())
    def text_of(column: pa.Array) -> pa.Array:
        bpe = load(path, extra)
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        live = column.is_valid().to_pylist()
        return pa.array([bpe.decode(flat[offsets[k] : offsets[k + 1]]) if live[k] else None for k in range(len(column))], pa.string())

    # the condition stands between the functions: without it, ids made just before would be made twice, once to be decoded
    return df.withColumn(text, text_of(F.when(F.size(ids) >= 0, F.col(ids))))
