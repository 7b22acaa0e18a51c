"""Benchmark decontamination by a distributed positional inverted index.

build_index() stores, for segments of documents, every term's positions. search() looks up windows of the
test items by the term of each that the fewest windows share, so that only windows of terms that a segment
has are seen. Of these it takes the rarest term in the segment first, shifts its position list by its place
in the window and intersects the lists of the other terms, from rare to frequent, all windows at once; so it
returns exact phrases. proximity() returns places where all terms of a window stand close together in
any order. Segments are bounded, so an index row is; the index needs no shuffle.

Words: A-Z in lower case, then runs of digits, a-z and characters beyond ASCII. An item's windows are its
runs of `width` words, or all its words if it has fewer.

Items are taken in blocks of at most BLOCK_BYTES of text (a longer item in several, which overlap by a
window), each broadcast as arrays of about ten bytes a byte of text, and the blocks' hits joined, so a large
benchmark costs more passes over the index, not more memory.

Defined cases: null and empty texts have no words, are never hit, and an item without words has no window;
items with equal ids count once, with all their windows; items with a null id are searched and count as one
more item, which the digest of ids leaves out; repeated documents are hit alike; an empty item
table hits nothing; an empty document table gives an empty table; other columns are not read; a very long
text is a segment by itself, held in one worker.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.arrow import slices, small_batches, tidy
from quern.runtime import stage

#: Words of a window; bytes of text in a segment; bytes of item text that are broadcast at once.
WIDTH, SEGMENT_BYTES, BLOCK_BYTES = 10, 1 << 20, 4 << 20
#: Candidate places that are intersected at once.
CANDIDATES = 1 << 20
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def index_of(docs: list[tuple]) -> dict:
    """One segment: its documents, the place of each one's first word, terms, and the terms' sorted positions."""
    numbers = _Numbers()
    terms, starts = [], [0]
    for _, text in docs:
        terms += map(numbers.__getitem__, words_of(text))
        starts.append(len(terms))
    at = np.array(terms, np.int32)
    positions = np.argsort(at, kind="stable").astype(np.int32)
    counts = np.bincount(at, minlength=len(numbers)).astype(np.int32)
    gaps = np.diff(positions, prepend=np.int32(0))
    return {"doc_ids": [d for d, _ in docs], "starts": starts, "terms": list(numbers), "counts": counts.tolist(), "positions": zlib.compress(gaps.astype("<i4").tobytes(), 1)}


INDEX = T.StructType([
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("terms", T.ArrayType(T.BinaryType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("positions", T.BinaryType()),
])
_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("positions", pa.binary())])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores the index in the shared folder: a numbered row for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        as_row = lambda x: pa.RecordBatch.from_pylist([index_of(x)], schema=_ARROW)
        for batch in batches:
            for part in slices(batch, 1):
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.append((d, t))
                    size += len(t or "")
                    if size >= SEGMENT_BYTES or len(held) >= 16384:
                        yield as_row(held)
                        held, size = [], 0
        if held:
            yield as_row(held)

    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), INDEX)
    return stage(rows.withColumn("segment", F.monotonically_increasing_id()), "postings")  # stored, so equal segments keep their own numbers


class Windows:
    """The distinct windows of a block of items, as arrays: terms by number, and the items that have each window.

    A window is found by its key, the one of its terms that the fewest windows have.
    """

    def __init__(self, items: list[tuple], width: int):
        numbers = _Numbers()
        names: dict = {}
        rows, owners = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)]
        for item, words in items:
            own = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            if 0 < len(own) < width:
                own = np.concatenate([own, np.full(width - len(own), -1, np.int32)])
            if len(own):
                made = np.lib.stride_tricks.sliding_window_view(own, width)
                rows.append(made)
                owners.append(np.full(len(made), names.setdefault(None if item is None else str(item), len(names))))
        every, owner = np.ascontiguousarray(np.concatenate(rows)), np.concatenate(owners)
        order = np.lexsort((owner, *every.T[::-1]))
        every, owner = every[order], owner[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]).any(axis=1)
        again = np.zeros(len(every), bool)
        again[1:] = ~new[1:] & (owner[1:] == owner[:-1])
        window = np.cumsum(new) - 1
        self.names, self.vocabulary = list(names), list(numbers)
        self.terms = every[new]
        self.lengths = (self.terms >= 0).sum(axis=1)
        self.owners = owner[~again]
        self.owner_starts = np.concatenate([[0], np.cumsum(np.bincount(window[~again], minlength=len(self.terms)))]).astype(np.int64)
        spread = np.bincount(self.terms[self.terms >= 0], minlength=len(self.vocabulary))
        share = np.where(self.terms >= 0, spread[self.terms], np.iinfo(np.int64).max) if len(self.terms) else np.zeros((0, width), np.int64)
        key = self.terms[np.arange(len(self.terms)), share.argmin(axis=1)] if len(self.terms) else np.zeros(0, np.int32)
        self.by_key = np.argsort(key, kind="stable")
        self.key_starts = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=len(self.vocabulary)))]).astype(np.int64)

    def items_of(self, window: int) -> list:
        return [self.names[i] for i in self.owners[self.owner_starts[window] : self.owner_starts[window + 1]]]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start, so many as its count, one after another."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Segment:
    """A stored segment, opened."""

    def __init__(self, row: dict):
        self.doc_ids, self.starts = row["doc_ids"], np.array(row["starts"], np.int64)
        self.terms, self.counts = row["terms"], np.array(row["counts"], np.int64)
        self.ends = np.cumsum(self.counts)
        self.positions = np.cumsum(np.frombuffer(zlib.decompress(row["positions"]), "<i4"), dtype=np.int32)
        self.size = int(self.starts[-1])
        #: Every list after another, as term * size + position, so that all lists are searched at once.
        self.places = np.repeat(np.arange(len(self.counts)) * self.size, self.counts) + self.positions

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.ends[term] - self.counts[term] : self.ends[term]]

    def has(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each term and position, whether the position is in the term's list."""
        sought = terms * self.size + at
        i = np.searchsorted(self.places, sought)
        return self.places[np.minimum(i, len(self.places) - 1)] == sought

    def known(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Windows all of whose terms occur here, and their terms' numbers here, -1 after the last."""
        number = dict(zip(self.terms, range(len(self.terms))))
        own = np.fromiter((number.get(x, -1) for x in w.vocabulary), np.int64, len(w.vocabulary))
        present = np.flatnonzero(own >= 0)
        some = w.by_key[ranges(w.key_starts[present], w.key_starts[present + 1] - w.key_starts[present])]
        terms = np.where(w.terms[some] >= 0, own[w.terms[some]], -2) if len(some) else np.zeros((0, w.terms.shape[1]), np.int64)
        good = (terms != -1).all(axis=1)
        return some[good], terms[good]

    def phrases(self, w: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, starts), in parts: where a window occurs whole in one document."""
        some, terms = self.known(w)
        if not len(some):
            return
        counts = np.where(terms >= 0, self.counts[terms], np.iinfo(np.int64).max)
        order = np.argsort(counts, axis=1, kind="stable")
        rarest = order[:, 0]
        first = terms[np.arange(len(some)), rarest]
        ends = np.cumsum(self.counts[first])
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], CANDIDATES), "right"))
        for lo, hi in zip(cuts, [*cuts[1:], len(some)]):
            n = self.counts[first[lo:hi]]
            row = np.repeat(np.arange(lo, hi), n)
            start = self.positions[ranges(self.ends[first[lo:hi]] - n, n)].astype(np.int64) - rarest[row]
            doc = np.searchsorted(self.starts, np.maximum(start, 0), "right")
            good = (start >= 0) & (start + w.lengths[some[row]] <= self.starts[np.minimum(doc, len(self.starts) - 1)])
            row, start = row[good], start[good]
            for k in range(1, terms.shape[1]):
                if not len(row):
                    break
                place = order[row, k]
                term = terms[row, place]
                good = term < 0
                good[~good] = self.has(term[~good], start[~good] + place[~good])
                row, start = row[good], start[good]
            if len(row):
                yield some[row], start

    def close(self, w: Windows, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, places of their rarest terms) with every term within `reach` words, in the same document."""
        for window, terms in zip(*self.known(w)):
            order = sorted(set(terms[terms >= 0].tolist()), key=lambda t: self.counts[t])
            places = self.list_of(order[0]).astype(np.int64)
            doc = np.searchsorted(self.starts, places, "right") - 1
            lo, hi = np.maximum(places - reach, self.starts[doc]), np.minimum(places + reach + 1, self.starts[doc + 1])
            good = np.ones(len(places), bool)
            for t in order[1:]:
                own = self.list_of(t)
                good &= np.searchsorted(own, lo) < np.searchsorted(own, hi)
            if good.any():
                yield np.full(int(good.sum()), window), places[good]


def blocks_of(items: DataFrame, item: str, text: str, width: int) -> Iterator[list[tuple]]:
    """The items' words in blocks of bounded text; parts of a longer item overlap, so that no window is lost."""
    held, size = [], 0
    for r in items.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        words, at = words_of(r["t"]), 0
        while at < len(words):
            end, start = at, size
            while end < len(words) and (size < BLOCK_BYTES or end - at < width):
                size += len(words[end]) + 1
                end += 1
            held.append((r["i"], words[at:end]))
            if size >= BLOCK_BYTES:
                yield held
                held, size = [], 0
            at = end if end == len(words) else end - width + 1
    if held:
        yield held


MATCH = "segment long, ordinal int, doc_id long, n_words long, starts array<int>, lengths array<int>, items array<string>"


def search(index: DataFrame, items: list[tuple], width: int = WIDTH, reach: int | None = None) -> DataFrame:
    """For each document, the places where windows of one block of items occur: (start, length) and the items.

    With reach: places of proximity matches instead (length 1, at the window's rarest term).
    """
    shared = index.sparkSession.sparkContext.broadcast(Windows(items, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                segment = Segment(one)
                n = len(segment.doc_ids)
                starts, lengths, names = [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)]
                for found, places in segment.phrases(w) if reach is None else segment.close(w, reach):
                    docs = np.searchsorted(segment.starts, places, "right") - 1
                    for d, p, size in zip(docs.tolist(), (places - segment.starts[docs]).tolist(), w.lengths[found].tolist()):
                        starts[d].append(p)
                        lengths[d].append(size if reach is None else 1)
                    for d, window in sorted(set(zip(docs.tolist(), found.tolist()))):
                        names[d].update(w.items_of(window))
                yield pa.RecordBatch.from_arrays([
                    pa.array([one["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(segment.doc_ids, pa.int64()), pa.array(np.diff(segment.starts)),
                    pa.array(starts, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32())), pa.array([sorted(x, key=lambda i: (i is None, i or "")) for x in names], pa.list_(pa.string())),
                ], names=["segment", "ordinal", "doc_id", "n_words", "starts", "lengths", "items"])

    return index.mapInArrow(tidy(run), MATCH)


def covered(starts, lengths) -> int:
    """Words inside at least one span."""
    total, end = 0, 0
    for s, n in sorted(zip(starts, lengths)):
        total += max(0, s + n - max(s, end))
        end = max(end, s + n)
    return total


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document: n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined ids), contaminated."""
    index = build_index(docs, key, text)
    found, more = None, []
    for block in blocks_of(items, item, item_text, width):
        if found is None:
            found = search(index, block, width)
        else:  # of further blocks only the hits go on
            more.append(stage(search(index, block, width).where("size(starts) > 0"), "hits"))
    if found is None:
        found = search(index, [], width)
    if more:
        every = reduce(DataFrame.unionByName, [found, *more])
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "lengths")]
        found = every.groupBy("segment", "ordinal", "doc_id", "n_words").agg(*lists, F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [covered(s, n) for s, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            names = batch.column(4).to_pylist()
            known = [",".join(sorted(i for i in x if i is not None)) for x in names]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in known], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()),
            ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.select("doc_id", "n_words", "starts", "lengths", "items").mapInArrow(tidy(run), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def proximity(docs: DataFrame, items: DataFrame, width: int = WIDTH, reach: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, place, items) of proximity matches; a benchmark of several blocks gives each block's rows."""
    index = build_index(docs, key, text)
    parts = [search(index, block, width, reach) for block in blocks_of(items, item, item_text, width)] or [search(index, [], width, reach)]
    return reduce(DataFrame.unionByName, parts).where("size(starts) > 0").select("doc_id", F.explode("starts").alias("place"), "items")
