"""Stores over DataFrames: vectors with batch changes, and entities, documents and chunks by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import retrieval
from quern.runtime import stage


class VectorStore:
    """Vectors by id. Each change gives a new store and leaves the old one as it was; commit() writes what is pending."""

    def __init__(self, spark: SparkSession, key: str = "id", vector: str = "embedding", rows: DataFrame | None = None):
        self.spark, self.key, self.vector, self._rows = spark, key, vector, rows

    def _with(self, rows: DataFrame) -> VectorStore:
        return VectorStore(self.spark, self.key, self.vector, rows)

    def rows(self) -> DataFrame:
        return self._rows if self._rows is not None else self.spark.createDataFrame([], f"{self.key} long, {self.vector} array<float>")

    def add(self, batch: DataFrame) -> VectorStore:
        """Adds rows; an id that is there gets the new vector."""
        if self._rows is None:
            return self._with(batch.select(self.key, self.vector))
        return self._with(self._rows.join(batch.select(self.key), self.key, "left_anti").unionByName(batch.select(self.key, self.vector)))

    def remove(self, ids: DataFrame) -> VectorStore:
        return self._with(self.rows().join(ids.select(self.key), self.key, "left_anti"))

    def commit(self) -> VectorStore:
        return self._with(stage(self.rows(), "vectors"))

    def contains(self, one) -> bool:
        return not self.rows().where(F.col(self.key) == one).isEmpty()

    def get(self, one):
        row = self.rows().where(F.col(self.key) == one).select(self.vector).head()
        return None if row is None else list(row[0])

    def ids(self) -> DataFrame:
        return self.rows().select(self.key)

    def search(self, query: list[float], k: int = 10, least: float | None = None) -> DataFrame:
        return retrieval.vector_search(self.rows(), query, self.key, self.vector, k, least)


class MemoryStore:
    """Tables of entities, documents and chunks by id, in one place."""

    def __init__(self, **tables: DataFrame):
        self.tables = dict(tables)

    def put(self, name: str, rows: DataFrame, key: str = "id") -> None:
        old = self.tables.get(name)
        self.tables[name] = rows if old is None else old.join(rows.select(key), key, "left_anti").unionByName(rows.select(*old.columns))

    def get(self, name: str, one, key: str = "id"):
        return self.tables[name].where(F.col(key) == one).head()

    def stats(self) -> dict[str, int]:
        return {n: t.count() for n, t in self.tables.items()}
