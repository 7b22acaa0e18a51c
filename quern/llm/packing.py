"""Token-ID output: best-fit-decreasing packing into rows of fixed length.

A document of more tokens than a row is cut into full rows and a rest, so nothing is lost. The pieces of a
window of documents are placed from the longest to the shortest, each into the row with the least room that
suffices; a segment tree over the amounts of room finds it in logarithmic time. Each window is written as
one .npz file: ids (rows x length), cumulative segment lengths of each row, bits where positions reset to
0, and which piece each segment is. A window is bounded in documents and tokens, so memory is too.

Files go to the shared folder by pyarrow.fs under names of the task's own; only files that successful
tasks returned are read.

Defined cases: null and empty texts have no tokens and take no room, but are recorded; repeated rows are
packed again; a null id is kept as null; an empty table writes nothing; other columns are not read. Texts
with a run of LONG_RUN white or other characters, on which the library's pattern overflows its stack or its
merges grow quadratic, are encoded by this package's own coder, which gives the same ids; a text is held
whole in one worker.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import open_fs, slices, small_batches
from quern.llm.bpe import Coder, share_ranks
from quern.runtime import new_path, stage

#: Tokens of a row; documents and tokens from which a window is written.
LENGTH, WINDOW_DOCS, WINDOW_TOKENS = 2048, 8192, 2 << 20
#: A run of so many characters without (or of nothing but) white space goes to the coder of bpe.
LONG_RUN = 4096
_RUN = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")


class Room:
    """Bins by the room they have left; finds the least room that suffices."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.base)  # whether any bin below this node has this room
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        i = self.base + room
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of a bin with the least room of at least `need`, which leaves; None if there is none."""
        i = self.base + need
        while not self.some[i]:
            while i & 1:
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.base:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.base
        found = self.bins[room].pop()
        if not self.bins[room]:
            self.some[i] = 0
            i >>= 1
            while i:
                self.some[i] = self.some[2 * i] | self.some[2 * i + 1]
                i >>= 1
        return room, found


def best_fit(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int]], int]:
    """(row, start) of each piece and the number of rows; longest first, equals in their order."""
    room, places, rows = Room(capacity), [(0, 0)] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = room.take(lengths[k])
        left, row = found or (capacity, rows)
        rows += found is None
        places[k] = (row, capacity - left)
        if left > lengths[k]:
            room.put(left - lengths[k], row)
    return places, rows


def packed(docs: list[tuple[int | None, np.ndarray]], length: int, pad: int) -> dict[str, np.ndarray]:
    """The arrays of one file. Segments are listed by row and start."""
    pieces = [(d, p, ids[p * length : (p + 1) * length]) for d, (_, ids) in enumerate(docs) for p in range(-(-len(ids) // length))]
    places, rows = best_fit([len(x) for _, _, x in pieces], length)
    kind = np.uint16 if pad < 1 << 16 else np.uint32
    ids = np.full((rows, length), pad, kind)
    resets = np.zeros((rows, length), bool)
    for (_, _, x), (row, start) in zip(pieces, places):
        ids[row, start : start + len(x)] = x
        resets[row, start] = True
    order = sorted(range(len(pieces)), key=lambda k: places[k])
    per_row = np.bincount([places[k][0] for k in order], minlength=rows) if order else np.zeros(0, np.int64)
    ends = [places[k][1] + len(pieces[k][2]) for k in order]
    return {
        "ids": ids, "resets": np.packbits(resets, axis=1), "row_splits": np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64), "cu_seqlens": np.array(ends, np.int32),
        "segment_doc": np.array([pieces[k][0] for k in order], np.int32), "segment_piece": np.array([pieces[k][1] for k in order], np.int32),
        "doc_id": np.array([d if d is not None else 0 for d, _ in docs], np.int64), "doc_null": np.array([d is None for d, _ in docs], bool), "length": np.array(length),
    }


def unpacked(a: dict) -> Iterator[tuple[int | None, int, int, int, np.ndarray]]:
    """(doc_id, pieces, first row, positions that reset, ids) of each document of a file, put together again."""
    where: dict[int, list] = {d: [] for d in range(len(a["doc_id"]))}
    length = int(a["length"])
    resets = np.unpackbits(a["resets"], axis=1, count=length) if len(a["ids"]) else a["resets"]
    for row in range(len(a["ids"])):
        start = 0
        for s in range(a["row_splits"][row], a["row_splits"][row + 1]):
            end = int(a["cu_seqlens"][s])
            if not resets[row, start] or resets[row, start + 1 : end].any():
                raise ValueError("positions don't reset at a segment's start alone")
            where[int(a["segment_doc"][s])].append((int(a["segment_piece"][s]), row, start, end))
            start = end
    for d, parts in where.items():
        parts.sort()
        ids = np.concatenate([a["ids"][row, start:end] for _, row, start, end in parts]) if parts else np.zeros(0, a["ids"].dtype)
        yield None if a["doc_null"][d] else int(a["doc_id"][d]), len(parts), parts[0][1] if parts else -1, len(parts), ids


class Encoder:
    """The ids of a text: by the library, or by bpe's coder where the library can't."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.library = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.make_own, self.own = lambda: Coder(ranks, pattern), None

    def ids(self, text: str) -> np.ndarray:
        if len(text) < LONG_RUN or not _RUN.search(text):
            return np.asarray(self.library.encode_ordinary(text), np.uint32)
        self.own = self.own or self.make_own()
        return np.frombuffer(self.own.encode(text), "<u4").astype(np.uint32)


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encoder(shared, pattern: str) -> Encoder:
    """This worker's encoder for broadcast ranks: here tokens are only the input of packing."""
    key = (shared._id if hasattr(shared, "_id") else id(shared), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value, pattern)
    return _ENCODERS[key]


def write(docs: DataFrame, folder: str, ranks_path: str, pattern: str, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, packs and writes; a row (path, documents, rows, tokens) for each file."""
    shared = share_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        c = encoder(shared, pattern)
        pad, held, tokens, done = max(shared.value.values()) + 1, [], 0, []

        def flush() -> None:
            arrays, out = packed(held, length, pad), io.BytesIO()
            np.savez(out, **arrays)
            path = f"{root}/{uuid.uuid4().hex}.npz"
            with fs.open_output_stream(path, compression=None) as f:
                f.write(out.getbuffer())
            done.append((path, len(held), len(arrays["ids"]), tokens))

        for batch in batches:
            for part in slices(batch, 1):
                for doc_id, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = c.ids(t or "")
                    held.append((doc_id, ids))
                    tokens += len(ids)
                    if len(held) >= WINDOW_DOCS or tokens >= WINDOW_TOKENS:
                        flush()
                        held, tokens = [], 0
        if held:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "documents", "rows", "tokens"])

    return small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "path string, documents long, rows long, tokens long")


def read_back(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_tokens, n_pieces, first_row, shard, ids_sha256) of each document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    arrays = dict(np.load(io.BytesIO(f.read())))
                rows = [(d, len(ids), n, first, path.rpartition("/")[2], hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()) for d, n, first, _, ids in unpacked(arrays)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "n_tokens", "n_pieces", "first_row", "shard", "ids_sha256"])

    return files.select("path").mapInArrow(run, "doc_id long, n_tokens long, n_pieces int, first_row int, shard string, ids_sha256 string")


def pack_and_read(docs: DataFrame, ranks_path: str, pattern: str, length: int = LENGTH) -> DataFrame:
    folder = new_path(docs.sparkSession, "packed")
    files = stage(write(docs, folder, ranks_path, pattern, length), "packed-files")
    return read_back(files.repartition(max(1, files.count())), folder)
