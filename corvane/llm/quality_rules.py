"""Quality rules: a decision list learned by sequential covering.

Each rule is a conjunction of thresholds on document statistics.  It is grown on
two thirds of a labelled sample, condition by condition, by information gain, and
pruned on the last third; the rows that it covers are then set aside and the next
rule is grown on the rest.  The list becomes one ordered Spark conditional
expression, so scoring is a projection over the scan: no shuffle, no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .statistics import FEATURES, labelled, with_statistics


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, "<=" or ">", threshold) must hold for a text to be bad."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, way, at in self.conditions:
            out = out & ((stats[name] <= at) if way == "<=" else (stats[name] > at))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {w} {t:.6g}" for n, w, t in self.conditions)


def _holds(conditions, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, way, at in conditions:
        out &= (x[:, j] <= at) if way == "<=" else (x[:, j] > at)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], most: int) -> list[tuple[int, str, float]]:
    rule: list[tuple[int, str, float]] = []
    here = np.ones(len(x), bool)
    while len(rule) < most:
        p, n = int((here & bad).sum()), int((here & ~bad).sum())
        if not n or not p:
            break
        old, best = math.log2(p / (p + n)), (0.0, None)
        for j, at in enumerate(cuts):
            # below[k]: rows at or under the k-th cut
            place = np.searchsorted(at, x[here, j], "left")
            b = np.cumsum(np.bincount(place[bad[here]], minlength=len(at) + 1))[: len(at)]
            a = np.cumsum(np.bincount(place, minlength=len(at) + 1))[: len(at)]
            for way, pp, tt in (("<=", b, a), (">", p - b, p + n - a)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / np.maximum(tt, 1)) - old), 0)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    best = (float(gain.max()), (j, way, float(at[int(gain.argmax())])))
        if best[1] is None:
            break
        rule.append(best[1])
        here &= _holds([best[1]], x)
    return rule


def learn(rows: list[tuple], max_rules: int = 16, max_conditions: int = 4, min_precision: float = 0.9, min_cover: int = 3) -> list[Rule]:
    """Decision list from (label, FEATURES...) rows; label 0 is what the rules catch.

    A rule stays if, on the rows it was pruned with and all rows together, at
    least ``min_precision`` of what it covers is bad, ``min_cover`` rows at least.
    """
    if not rows:
        return []
    got = np.array(rows, float)
    bad, x = got[:, 0] == 0, got[:, 1:]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65))) for j in range(x.shape[1])]
    for j in range(x.shape[1]):  # and between the two labels' own quantiles
        own = [np.quantile(x[m, j], np.linspace(0, 1, 33)) for m in (bad, ~bad) if m.any()]
        cuts[j] = np.unique(np.concatenate([cuts[j], *own]))
    prune_row = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while len(rules) < max_rules and (left & bad & ~prune_row).sum() >= min_cover:
        g, q = left & ~prune_row, left & prune_row
        rule = _grow(x[g], bad[g], cuts, max_conditions)

        def worth(r) -> float:
            c = _holds(r, x[q])
            p, n = int((c & bad[q]).sum()), int((c & ~bad[q]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _holds(rule, x) & left if rule else np.zeros(len(x), bool)
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        if not rule or p < min_cover or p / (p + n) < min_precision:
            break
        rules.append(Rule(tuple((FEATURES[j], way, at) for j, way, at in rule)))
        left &= ~c
    return rules


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The number (from 1) of the first rule that holds, else null."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(stats), F.lit(i)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc (all columns of ``docs``, whatever their names), base, stats, base_failed, rule and kept of each row.

    Null and empty texts have no words and fail the base rule; equal rows get equal
    verdicts; an empty table gives no rows; a very long text is one row's arrays of its
    words.
    """
    out = with_statistics(docs)
    b = F.col("base")
    out = out.withColumn("base_failed", (b["n_words"] < 10) | (100 * b["n_repeat_words"] > 20 * b["n_words"]))
    out = out.withColumn("rule", verdict(rules, F.col("stats")))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op1_quality_rules(spark: SparkSession, sf_dir: str, sample: int = 12_000) -> DataFrame:
    """Base counts and the learned verdict for every document; the list is learned from ``sample`` labelled rows at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(labelled(docs, table(spark, sf_dir, "labels"), "quality", sample))
    b = F.col("base")
    counts = [b[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return apply_rules(docs, rules).select("doc.doc_id", *counts, "base_failed", "kept", "rule")


#: The counts by themselves; the verdict is learned, so SQL can't give it.
BASE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT k, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT k, i FROM g SEMI JOIN (SELECT k, g FROM g GROUP BY 1, 2 HAVING count(*) > 1) USING (k, g)),
c AS (SELECT k, count(DISTINCT i + j) AS n FROM r, range(5) x(j) GROUP BY 1),
l AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(ws) AS base_failed FROM w LEFT JOIN c USING (k) LEFT JOIN l USING (k)
"""
