"""Bounded samples of labelled rows and a small logistic calibrator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import whole_text


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`; a null doc_id is in fold 0."""
    return F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(modulus)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, usable: Column) -> DataFrame:
    """(doc_id, text, label, half) of at most `per_class` labelled ids of each class.

    Only ids that satisfy `usable` (a condition on doc_id) are drawn. Ids come in the order of
    a hash, so the same table gives the same sample; an id labelled twice counts with its
    larger label. The ids, 2 * per_class at most, are broadcast; the texts stay distributed.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    order = F.xxhash64("doc_id", F.lit(label))
    drawn = known.where("label = 1").orderBy(order, "doc_id").limit(per_class).unionAll(
        known.where("label = 0").orderBy(order, "doc_id").limit(per_class)
    )
    drawn = drawn.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(drawn), "doc_id")


class Logistic:
    """Logistic regression on a few standardised inputs, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0):
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        self.weights: np.ndarray | None = None
        self.base = (y.sum() + 1) / (len(y) + 2)  # the answer where a class is missing
        if len(y) == 0 or y.min() == y.max():
            return
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-12
        rows = self._rows(x)
        balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        ridge = penalty * np.eye(rows.shape[1])
        ridge[0, 0] = 1e-6
        weights = np.zeros(rows.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(rows @ weights, -35, 35)))
            slope = rows.T @ (balance * (y - p)) - ridge @ weights
            curve = (rows * (balance * p * (1 - p))[:, None]).T @ rows + ridge
            change = np.linalg.solve(curve, slope)
            weights = weights + change
            if np.abs(change).max() < 1e-9:
                break
        self.weights = weights

    def _rows(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.spread, -20, 20)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of inputs, strictly between 0 and 1."""
        x = np.asarray(x, dtype=float)
        if self.weights is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self._rows(x) @ self.weights, -35, 35)))
