"""Embedding whitening by TSQR: QR of each part, a tree of merged R factors, the SVD of the last R.

Vectors are taken as whole numbers, floor(256 c) for an entry c, and each distinct vector is fitted once. Rows are
centred by exact sums, so the covariance is never formed: the right vectors of the last R are the components and
its singular values their standard deviations, both to double precision.

Defined cases: a vector that is null or holds a null, NaN or infinite entry is dropped; entries beyond the range of
a long count as its ends; shorter vectors count as filled with zeros to the longest (an empty one is all zeros);
repeated vectors are fitted once and each of their rows is returned, rows of one id too; an empty table gives an
empty table; a component without variance has whitened null and stands outside identity_error, explained is 0 (null
if no component has any); a deviation beyond a long is null, deviation_exact (decimal(38,0)) has it up to 10^38.
Columns of the input other than key and vector aren't carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import small_batches
from quern.runtime import discard, stage

#: Steps to a unit; components returned; R factors that one task merges; rows that are taken up at a time.
SCALE, COMPONENTS, FAN, ROWS = 256, 4, 8, 4096
#: Entries of a vector at most: R, which each task holds, has their square.
DIMENSIONS = 4096
_LOW = (1 << 32) - 1


def whole(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of an Arrow column remain, and their entries as longs, a row each."""
    lists = column.cast(pa.list_(pa.float64()))
    flat, lengths = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    entries = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    kept = lists.is_valid().to_numpy(zero_copy_only=False)
    kept[row[~np.isfinite(entries)]] = False
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x = np.zeros((len(lengths), width), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        steps = np.floor(entries * SCALE)
        fits = np.abs(steps) < 2.0**63
        value = np.where(fits, steps, 0).astype(np.int64)
    value[~fits] = np.where(steps[~fits] > 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min)
    x[row, place] = value
    return kept, x[kept]


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a binary column of packed longs."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def distinct_vectors(df: DataFrame, vector: str, width: int) -> DataFrame:
    """The fit list, staged: each distinct vector once, as packed longs; repeats are put together before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column(0), width)[1]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], names=["x"])

    return stage(small_batches(df).select(vector).mapInArrow(run, "x binary").distinct(), "vectors")


def exact_sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of vectors and the sums of their entries, without rounding: halves of 32 bits are summed apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = unpacked(batch.column(0), width)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & _LOW).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([n, *high.tolist()], pa.int64()), pa.array([0, *low.tolist()], pa.int64())], names=["place", "high", "low"])

    parts = vectors.mapInArrow(run, "place int, high long, low long").groupBy("place").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    found = {r["place"]: (int(r["high"]), int(r["low"])) for r in parts.collect()}  # a row for each dimension
    return found.get(-1, (0, 0))[0], [(h << 32) + low for h, low in (found.get(i, (0, 0)) for i in range(width))]


@dataclass
class Centre:
    """Count and exact sums of the fitted vectors: what centres a row."""

    n: int
    sums: list[int]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: as longs where every one fits, else as Python's whole numbers."""
        most = max(map(abs, self.sums), default=0) + self.n * int(max(x.max(initial=0), -int(x.min(initial=0))))
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        d = self.scaled(x)
        most = int(np.abs(d).max(initial=0))
        d = d if most * most * d.shape[1] < 1 << 63 else d.astype(object)
        return (d * d).sum(axis=1).tolist()


def triangle(parts: Iterator[np.ndarray], width: int) -> np.ndarray:
    """R of rows that come in parts."""
    r = np.zeros((0, width))
    for x in parts:
        r = np.linalg.qr(np.concatenate([r, x]), mode="r")
    return r


def packed(at: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["at", "r"])


def factor(vectors: DataFrame, centre: Centre) -> np.ndarray:
    """R of all centred vectors: one of each part, then FAN of them merged by a task, level by level, until one is left."""
    width = len(centre.sums)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (unpacked(batch.column(0), width) for batch in batches if batch.num_rows)
        r = triangle((centre.centred(x[i : i + ROWS]) for x in rows for i in range(0, len(x), ROWS)), width)
        if len(r):
            yield packed(TaskContext.get().partitionId(), r)

    def merge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, "<f8").reshape(-1, width) for b in table.sort_by("at").column("r").to_pylist()]
        return pa.Table.from_batches([packed(table.column("at")[0].as_py() // FAN, triangle(iter(parts), width))])

    now = stage(vectors.mapInArrow(first, "at int, r binary"), "factors")
    while now.count() > 1:
        last, now = now, stage(now.groupBy(F.floor(F.col("at") / FAN).alias("group")).applyInArrow(merge, "at int, r binary"), "factors")
        discard(last)
    held = [np.frombuffer(bytes(r["r"]), "<f8").reshape(-1, width) for r in now.collect()]
    discard(now)
    return held[0] if held else np.zeros((0, width))


@dataclass
class Whitening:
    """Components by falling variance: a row each, its eigenvalue, and the share of the whole variance."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float | None]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, over their deviations; NaN for components without variance."""
        scale = np.sqrt(self.values)
        out = self.centre.centred(x) @ self.vectors.T
        return np.divide(out, scale, out=np.full_like(out, np.nan), where=scale > 0)


def fit(vectors: DataFrame, width: int, most: int = COMPONENTS) -> Whitening:
    """Fits the distinct vectors (see distinct_vectors); `most` components are kept. The driver holds one R of width^2 numbers."""
    centre = Centre(*exact_sums(vectors, width))
    r = factor(vectors, centre)
    _, s, v = np.linalg.svd(r, full_matrices=False) if len(r) else (None, np.zeros(0), np.zeros((0, width)))
    s = np.where(s > s.max(initial=0) * max(r.shape) * np.finfo(float).eps, s, 0.0)
    total, some = float((s * s).sum()), min(most, width)
    v = np.concatenate([v, np.zeros((max(0, some - len(v)), width))])[:some]
    e = np.concatenate([s * s, np.zeros(max(0, some - len(s)))])[:some]
    sign = np.sign(v[np.arange(some), np.abs(v).argmax(axis=1)]) if width else np.ones(0)
    return Whitening(centre, v * np.where(sign == 0, 1, sign)[:, None], e / max(1, centre.n), [float(x / total) if total else None for x in e])


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over components with variance."""
    width, live = len(model.centre.sums), np.flatnonzero(model.values > 0)
    k = len(live)
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whiten(unpacked(batch.column(0), width))[:, live]
            total, products = total + w.sum(axis=0), products + w.T @ w
        every = np.concatenate([products.ravel(), total])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(every)), pa.int32()), pa.array(every)], names=["place", "part"])

    sums = vectors.mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).orderBy("place").collect()  # k * (k + 1) rows
    every = np.array([r["part"] for r in sums]) / model.centre.n
    mean = every[k * k :]
    return float(np.abs(every[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, deviation_exact, whitened, explained, identity_error): a row for each remaining
    row and component up to `most`; the parameters are those of whole()."""
    width = df.agg(F.max(F.size(vector))).collect()[0][0] or 0
    if width > DIMENSIONS:
        raise ValueError(f"vectors of {width} entries; at most {DIMENSIONS} are taken")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"
    if width < 1:
        return df.sparkSession.createDataFrame([], schema)
    fitted = distinct_vectors(df, vector, width)
    model = fit(fitted, width, most)
    error = identity_error(fitted, model)
    discard(fitted)
    shared = df.sparkSession.sparkContext.broadcast(model)  # width * (most + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for batch in batches:
            kept, x = whole(batch.column(1), width)
            if not len(x):
                continue
            deviations = [d for d in m.centre.deviations(x) for _ in range(k)]
            ids = batch.column(0).filter(pa.array(kept)).take(pa.array(np.repeat(np.arange(len(x)), k)))
            white = m.whiten(x).ravel()
            rows = len(white)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(rows, m.centre.n)), pa.array([d if d < 1 << 63 else None for d in deviations], pa.int64()),
                    pa.array([d if d < 10**38 else None for d in deviations], pa.decimal128(38, 0)), pa.array(white, mask=np.isnan(white)), pa.array(list(m.explained) * len(x), pa.float64()), pa.array([error] * rows, pa.float64()),
                ],
                names=[key, "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"],
            )

    return small_batches(df).select(key, vector).mapInArrow(run, schema)
