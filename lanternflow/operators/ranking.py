"""The best rows of each query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Best:
    """The k best chunks of each query so far; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.size = k, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, chunk, score))
        self.size += len(query)
        if self.size > 400_000:
            self.parts = [self.best()]
            self.size = len(self.parts[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, chunk, score = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((chunk, -score, query))
        query, chunk, score = query[order], chunk[order], score[order]
        begin = np.searchsorted(query, query)
        keep = np.arange(len(query)) - begin < self.k
        return query[keep], chunk[keep], score[keep]


def top_k(scores: DataFrame, score: str, k: int, rank: str = "rank") -> DataFrame:
    """The k highest rows of each query, ties by chunk_id; none if k is not positive."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("chunk_id"))
    return scores.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)
