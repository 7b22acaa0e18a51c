"""Where models plug in. Each has a deterministic default, so nothing needs a network."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx


def overlap_score(query: pd.Series, text: pd.Series) -> pd.Series:
    """The share of the query's words that the text has."""
    words = [(set(q.lower().split()), set(t.lower().split())) for q, t in zip(query.fillna(""), text.fillna(""))]
    return pd.Series([len(a & b) / len(a) if a else 0.0 for a, b in words])


def rerank(pairs: DataFrame, query: str, text: str, model: Callable[[pd.Series, pd.Series], pd.Series] = overlap_score, least: float = 0.0, k: int = 10, score: str = "score") -> DataFrame:
    """Scores (query, text) pairs by a model in Arrow batches; delta is new minus old score."""
    scorer = F.pandas_udf(model, "double")
    new = pairs.withColumn("new_score", F.round(scorer(F.col(query), F.col(text)), 6))
    return new.where(F.col("new_score") >= least).withColumn("delta", F.round(F.col("new_score") - F.col(score), 6)).orderBy(F.desc("new_score"), text).limit(k)


@dataclass
class Tool:
    name: str
    parameters: dict[str, type]
    call: Callable

    def definition(self) -> dict:
        return {"name": self.name, "parameters": {k: v.__name__ for k, v in self.parameters.items()}}


@dataclass
class Tools:
    """Functions that a planner may call by name."""

    tools: dict[str, Tool] = field(default_factory=dict)

    def register(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"{tool.name} is registered")
        self.tools[tool.name] = tool

    def call(self, name: str, **arguments):
        tool = self.tools[name]
        for k, kind in tool.parameters.items():
            if k not in arguments:
                raise ValueError(f"{name} needs {k}")
            if not isinstance(arguments[k], kind):
                raise TypeError(f"{k} of {name} is a {kind.__name__}")
        return tool.call(**arguments)


def fallback_keywords(text: Column, most: int = 10) -> Column:
    return F.slice(F.filter(tx.words(F.lower(text)), lambda w: F.length(w) > 3), 1, most)
