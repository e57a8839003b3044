"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are native columns, so texts never leave the JVM.  Training bins each
statistic once and grows each tree from histograms of gradients; the trees are
flattened into arrays that a vectorised loop walks for all rows at once, level by
level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .statistics import FEATURES, labelled, with_statistics


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    depth: int
    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - len(f)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def train(rows: list[tuple], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Boosting on log loss with second-order gains; label 1 raises the score.

    Without rows the score is 0.5 for all; with one label only, near that label.
    """
    if not rows:
        return Trees(1, 0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    got = np.array(rows, float)
    y, x = got[:, 0], got[:, 1:]
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    cuts = []
    for j in range(x.shape[1]):  # quantiles of all rows and of each label, so that rare values get cuts too
        parts = [np.quantile(v, np.linspace(0, 1, bins // 2 + 1)[1:-1]) for v in (x[:, j], x[y == 0, j], x[y == 1, j]) if len(v)]
        cuts.append(np.unique(np.concatenate(parts)))
    width = max(map(len, cuts)) + 1
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    n_inner, n_features = 2**depth - 1, x.shape[1]
    feature, threshold, leaf = np.zeros((trees, n_inner), np.int64), np.full((trees, n_inner), np.inf), np.zeros((trees, 2**depth))
    z = np.full(len(y), base)
    for k in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            here = node - first
            sums = []
            for v in (g, h):
                flat = [np.bincount(here * width + binned[:, j], weights=v, minlength=count * width) for j in range(n_features)]
                sums.append(np.stack(flat).reshape(n_features, count, width))
            gl, hl = np.cumsum(sums[0], axis=2), np.cumsum(sums[1], axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = -1
            for j, c in enumerate(cuts):
                gain[j, :, len(c) :] = -1
            best = gain.transpose(1, 0, 2).reshape(count, -1)
            at = best.argmax(axis=1)
            for i in range(count):
                if best[i, at[i]] > 1e-6:
                    j, b = divmod(int(at[i]), width)
                    feature[k, first + i], threshold[k, first + i] = j, cuts[j][b]
            split = threshold[k][node]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[k][node]] > split)
        place = node - n_inner
        gs, hs = np.bincount(place, g, 2**depth), np.bincount(place, h, 2**depth)
        leaf[k] = -rate * gs / (hs + ridge)
        z += leaf[k][place]
    return Trees(depth, base, feature, threshold, leaf)


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """doc (all columns of ``docs``, whatever their names), base, stats and score of each row.

    Null texts count as empty, which has a score like any other; equal texts score
    alike; an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(model.score(np.stack([c.to_numpy(float) for c in columns], axis=1)))

    stats = with_statistics(docs)
    return stats.withColumn("score", score(*[F.col("stats")[k] for k in FEATURES]))


def held_out() -> Column:
    """Rows that training may not use."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def op9_quality_trees(spark: SparkSession, sf_dir: str, sample: int = 12_000) -> DataFrame:
    """A quality score for every document, learned from ``sample`` labelled rows at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(labelled(docs, table(spark, sf_dir, "labels"), "quality", sample, ~held_out()))
    got = scored(docs, model).select("doc.doc_id", "score").withColumn("held_out", held_out())
    return got.select("doc_id", "held_out", "score").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
