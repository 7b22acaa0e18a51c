"""Chunking: fixed windows as expressions, stateful chunkers as Arrow passes; offsets are in characters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quern.runtime import small_batches

#: Characters of chunks, about, that leave a worker together.
PART = 2 << 20
SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", "; ", ": ", " "]


def fixed(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """(key, at, start_offset, content): windows of `size` characters, `size - overlap` apart."""
    step = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    each = docs.select(key, text, F.posexplode(starts).alias("at", "start_offset"))
    return each.select(key, F.col("at").cast("long").alias("at"), F.col("start_offset").cast("long").alias("start_offset"), F.substring(F.col(text), F.col("start_offset") + 1, F.lit(size)).alias("content"))


def cut_text(text: str, size: int = 1000, overlap: int = 200, tail: int = 200) -> list[tuple[int, int]]:
    """Spans of about `size`, ended at the last sentence end in their last `tail` characters, else at a word's end."""
    spans, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            found = max((m.end() for m in re.finditer(r"[.!?]\s", text[max(start, end - tail) : end])), default=0)
            if found:
                end = max(start, end - tail) + found
            else:
                space = text.rfind(" ", start, end)
                end = space if space > start else end
        if text[start:end].strip():
            spans.append((start, end))
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return spans


def cut_hierarchical(text: str, size: int = 1000, overlap: int = 100, least: int = 50) -> list[tuple[int, int]]:
    """Spans ended at the last of the coarsest separator that lies beyond a quarter of the window; true offsets."""
    spans, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            for s in SEPARATORS:
                at = text.rfind(s, start, end)
                if at > start + size // 4:
                    end = at + len(s)
                    break
        if end - start >= least:
            spans.append((start, end))
        if end >= len(text):
            break
        step = max(start + 1, end - overlap)
        space = text.rfind(" ", start + 1, step)
        start = space + 1 if space > start else step
    return spans


def pack_sentences(text: str, target: int = 500, most: int = 1000, least: int = 100) -> list[tuple[int, int]]:
    """Sentences packed greedily, one sentence of overlap; a tail shorter than `least` is dropped."""
    bounds = [0, *[m.end() for m in re.finditer(r"[.!?]+\s+", text)]]
    if bounds[-1] != len(text):
        bounds.append(len(text))
    spans, i = [], 0
    while i < len(bounds) - 1:
        j = i + 1
        while j < len(bounds) - 1 and bounds[j] - bounds[i] < target and bounds[j + 1] - bounds[i] <= most:
            j += 1
        if bounds[j] - bounds[i] >= least:
            spans.append((bounds[i], bounds[j]))
        i = j if j >= len(bounds) - 1 else max(i + 1, j - 1)
    return spans


def chunk(docs: DataFrame, cut, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, start_offset, end_offset, content) by a cutter from a text to spans, document by document."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in ("at", "start_offset", "end_offset")], T.StructField("content", T.StringType())])

    def made(keys, places, spans, contents):
        return pa.RecordBatch.from_arrays([pa.array(keys, to_arrow_type(kind)), pa.array(places, pa.int64()), *[pa.array(x, pa.int64()) for x in (list(zip(*spans)) or [(), ()])], pa.array(contents, pa.string())], names=schema.names)

    def run(batches):
        rows, held = ([], [], [], []), 0
        for batch in batches:
            for k, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = whole.as_py()  # one text at a time
                for i, (a, b) in enumerate(cut(whole) if whole else []):
                    for column, value in zip(rows, (k, i, (a, b), whole[a:b])):
                        column.append(value)
                    held += b - a
                    if held >= PART:
                        yield made(*rows)
                        rows, held = ([], [], [], []), 0
        yield made(*rows)

    return small_batches(docs).select(key, text).mapInArrow(run, schema)
