"""Byte-level BPE encoding and decoding.

A text is cut by a pattern; each match is merged by itself. A segment tree over the match's byte
positions holds the leftmost minimum pair rank; each merge takes the root and makes point updates of
logarithmic cost at the live neighbours. Long matches so cost O(n log n).

Defined cases: a null text counts as empty and has no ids; an empty text has no ids; repeated rows and
rows with equal ids are encoded alike, row by row; an empty table gives an empty table; other columns of
the input are kept unless they bear the name of an output column, which replaces them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.llm.arrow import add_columns, kept

#: A rank file may be broadcast up to this size; larger ones are refused.
MAX_RANK_FILE = 64 << 20
#: Distinct matches and words that a worker keeps at hand, and as many again of those used before.
MEMORY = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE + 1)
    if len(data) > MAX_RANK_FILE:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match: the pair of lowest rank merges first, the leftmost of equals."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece[i : i + 1]] for i in range(n)]
    size = 1 << (n - 2).bit_length()
    mask, none, get = size - 1, 1 << 62, ranks.get
    # a key is rank * size + position, so that the least key is the leftmost pair of the lowest rank
    leaves = [none if (rank := get(piece[i : i + 2])) is None else rank * size + i for i in range(n - 1)]
    level = leaves + [none] * (size - n + 1)
    levels = [level]
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        levels.append(level)
    tree = [none]
    for level in reversed(levels):
        tree += level
    follow, before = list(range(1, n + 2)), list(range(-1, n))
    while (key := tree[1]) != none:
        at = key & mask
        gone = follow[at]
        follow[at] = after = follow[gone]
        before[after] = at
        if after < n:  # the pair at `gone` goes
            i, key = size + gone, none
            tree[i] = none
            while i > 1:
                other = tree[i ^ 1]
                i >>= 1
                if other < key:
                    key = other
                if tree[i] == key:
                    break
                tree[i] = key
            rank = get(piece[at : follow[after]])
        else:
            rank = None
        i, key = size + at, none if rank is None else rank * size + at
        tree[i] = key
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            if other < key:
                key = other
            if tree[i] == key:
                break
            tree[i] = key
        if (left := before[at]) >= 0:
            rank = get(piece[left:after])
            i, key = size + left, none if rank is None else rank * size + left
            if tree[i] != key:
                tree[i] = key
                while i > 1:
                    other = tree[i ^ 1]
                    i >>= 1
                    if other < key:
                        key = other
                    if tree[i] == key:
                        break
                    tree[i] = key
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : follow[at]]])
        at = follow[at]
    return out


#: Fixed value: the pattern for which spaced() holds.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# Code points that are letters or numbers for module regex but came to Unicode after version
# 16.0, by which the rank files' library tells letters; to that library they are neither.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


class Coder:
    """Encodes and decodes in one process; remembers the ids of a bounded number of matches and words.

    Under SPACED no match goes on over a space that stands between two characters that aren't white space:
    such a space begins a match. So a text whose single spaces all stand so is encoded word by word, each
    with its space, and the ids of frequent words are looked up whole. Other texts go through the pattern.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.spaced = regex.compile(pattern), pattern == SPACED
        self.later = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER) + "]")
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k
        self.matches = _Known(lambda m: np.array(merge(m.encode(), ranks), "<u4").tobytes())
        self.words = _Known(self._word)

    def find(self, text: str) -> list[str]:
        """The pattern's matches; letters of later Unicode versions count as symbols."""
        if text.isascii() or not self.later.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.later.sub("\u00a4", text))]

    def _word(self, word: str) -> bytes:
        """The ids of a space and what stands up to the next space."""
        if word.isalpha():
            return self.matches[" " + word]
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Unspaced
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self.matches[" " + word[:-1]] + self.matches[word[-1]]
        return b"".join([self.matches[m] for m in self.find(" " + word)])

    def encode(self, text: str) -> bytes:
        """The ids, each as four little-endian bytes."""
        self.matches.age()
        self.words.age()
        if self.spaced:
            first, *words = text.split(" ")
            try:
                if not first[-1:].isspace():
                    return b"".join([*[self.matches[m] for m in self.find(first)], *map(self.words.__getitem__, words)])
            except _Unspaced:
                pass
        return b"".join([self.matches[m] for m in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Unspaced(Exception):
    """A space does not stand between two characters that aren't white space."""


class _Known(dict):
    """Remembers what make() gave; of more than MEMORY keys, those that were not used lately are forgotten."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        made = self[key] = self.old.pop(key, None) or self.make(key)
        return made

    def age(self) -> None:
        if len(self) > MEMORY:
            self.old = dict(self)
            self.clear()


def coder(shared, pattern: str) -> Coder:
    """This worker's coder for broadcast ranks; it lives until another operator's task begins."""
    key = (shared._id if hasattr(shared, "_id") else id(shared), pattern)
    return kept(key, lambda: Coder(shared.value, pattern))


def share_ranks(spark: SparkSession, path: str):
    """Broadcasts the ranks, at most MAX_RANK_FILE bytes, so that executors need no copy of the file."""
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", digests: bool = False) -> DataFrame:
    """Adds the ids of the whole text.

    With digests, adds instead n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers)
    and decoded_sha256 (of the bytes that decoding the ids gives), so that ids need not leave the worker.
    """
    shared = share_ranks(df.sparkSession, ranks_path)

    def start():
        c = coder(shared, pattern)

        def make(texts: list) -> list:
            got = [c.encode(t or "") for t in texts]
            if digests:
                return [
                    pa.array([len(x) // 4 for x in got], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in got], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in got], pa.string()),
                ]
            ends = np.cumsum([0, *[len(x) // 4 for x in got]])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32)))]

        return make

    digest = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return add_columns(df, text, digest if digests else [(out, T.ArrayType(T.IntegerType(), False))], start)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for (binary: cut ids need not be UTF-8). Null ids give null."""
    shared = share_ranks(df.sparkSession, ranks_path)
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(shared, "")
        for batch in batches:
            got = [None if x is None else b"".join(map(c.bytes_of.__getitem__, x)) for x in batch.column(rest.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=schema.names)

    return df.select(*[df[c] for c in rest]).mapInArrow(run, schema)
