"""Arrow passes over documents: whole texts, in parts of bounded size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.runtime import BATCH, small_batches  # noqa: F401


def slices(batch: pa.RecordBatch, at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes in column `at` each (one row at least)."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


_KEPT: dict = {}
_ASKED: list = []


def kept(key, make: Callable[[], object]):
    """What a worker keeps from one task to the next: one thing, until a task asks for another, or begin() meets one that asks for none."""
    _ASKED.append(key)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def begin(start: Callable[[], Callable]) -> Callable:
    """What start() gives; lets go of what the worker keeps for other tasks."""
    _ASKED.clear()
    made = start()
    if not _ASKED:
        _KEPT.clear()
    return made


def give_back() -> None:
    """Gives free memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps free pages between pieces that stay
        trim(0)


def tidy(run: Callable) -> Callable:
    """A pass that, when its task ends, gives what the worker has left free back to the system, so that an idle worker holds little."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def add_columns(df: DataFrame, text: str, new: list[tuple[str, T.DataType]], start: Callable[[], Callable[[list], list]], keep: list[str] | None = None) -> DataFrame:
    """Adds columns made from the whole text of each row.

    start() runs once in each task and gives a function from a list of texts (null: None) to a list of
    Arrow arrays, one for each new column. keep: the columns that stay (all but those that a new one replaces).
    """
    names = {n for n, _ in new}
    rest = [c for c in (df.columns if keep is None else keep) if c not in names]
    carried = list(dict.fromkeys([*rest, text]))
    schema = T.StructType([*[df.schema[c] for c in rest], *[T.StructField(n, t) for n, t in new]])
    at, places = carried.index(text), [carried.index(c) for c in rest]
    out_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = begin(start)
        for batch in batches:
            for part in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in places], *make(part.column(at).to_pylist())], names=out_names)

    return small_batches(df).select(*[df[c] for c in carried]).mapInArrow(tidy(run), schema)


def open_fs(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there; Spark's names for a store count as Arrow's."""
    scheme, found, rest = folder.partition("://")
    if not found:
        folder = f"file://{folder}" if folder.startswith("/") else folder
    elif scheme in ("s3a", "s3n"):
        folder = f"s3://{rest}"
    return pafs.FileSystem.from_uri(folder)
