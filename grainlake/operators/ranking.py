"""Window transforms of scored actions: ranks, z-scores, softmax, consensus of several scorers, the current action and its mask.

Every frame has a group column and `ord`, the place of an action in its group, which decides ties. One shuffle by group serves all
windows. Scores may be null: null ranks last, and has z-score 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def group(by: str = "qid"):
    return Window.partitionBy(by)


def rank_first(score: str, by: str = "qid") -> Column:
    """Descending rank from 1; of equal scores the earlier action comes first."""
    return F.row_number().over(group(by).orderBy(F.col(score).desc_nulls_last(), "ord"))


def dense_grade(score: str, by: str = "qid") -> Column:
    """Ascending dense rank from 0: equal scores share a grade."""
    return F.dense_rank().over(group(by).orderBy(F.col(score).asc_nulls_first())) - 1


def zscore(score: str, by: str = "qid") -> Column:
    """Distance from the group's mean in sample standard deviations; 0 where these are 0 or undefined."""
    w = group(by)
    return F.coalesce((F.col(score) - F.avg(score).over(w)) / F.nullif(F.stddev_samp(score).over(w), F.lit(0.0)), F.lit(0.0))


def softmax(z: str, by: str = "qid") -> Column:
    """Share of exp(z) in its group, shifted by the group's maximum."""
    w = group(by)
    return F.exp(F.col(z) - F.max(z).over(w)) / F.sum(F.exp(F.col(z))).over(w) * F.exp(F.max(z).over(w))


def with_ranks(df: DataFrame, scores: Sequence[str], by: str = "qid") -> DataFrame:
    """df with rank__<s>, invrank__<s>, z__<s>, prob__<s> of each score."""
    df = df.withColumns({f"rank__{s}": rank_first(s, by) for s in scores} | {f"z__{s}": zscore(s, by) for s in scores})
    return df.withColumns({f"invrank__{s}": 1 / F.col(f"rank__{s}") for s in scores} | {f"prob__{s}": softmax(f"z__{s}", by) for s in scores})


def _mean(columns: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c)
    return total / len(columns)


def _std(columns: Sequence[str]) -> Column:
    if len(columns) < 2:
        return F.lit(0.0)
    mean, total = _mean(columns), F.lit(0.0)
    for c in columns:
        total = total + (F.col(c) - mean) * (F.col(c) - mean)
    return F.sqrt(total / (len(columns) - 1))


def _edge(columns: Sequence[str], f) -> Column:
    return f(*map(F.col, columns)) if len(columns) > 1 else F.col(columns[0])


def _votes(columns: Sequence[str], most: int) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.when(F.col(c) <= most, 1).otherwise(0)
    return total


def consensus(df: DataFrame, scores: Sequence[str], base: Sequence[str]) -> DataFrame:
    """df of with_ranks, with the agreement of the scorers and of the base scorers on each action."""
    of = lambda kind, names: [f"{kind}__{s}" for s in names]
    new = {}
    for kind, edges in (("rank", ("min", "max")), ("invrank", ()), ("z", ("max",)), ("prob", ("max",))):
        own = of(kind, scores)
        new |= {f"het_{kind}_mean": _mean(own), f"het_{kind}_std": _std(own)}
        new |= {f"het_{kind}_{e}": _edge(own, F.least if e == "min" else F.greatest) for e in edges}
    new |= {"het_top1_votes": _votes(of("rank", scores), 1), "het_top3_votes": _votes(of("rank", scores), 3)}
    own = of("rank", base)
    new |= {"base_rank_mean": _mean(own), "base_rank_std": _std(own), "base_rank_min": _edge(own, F.least), "base_rank_max": _edge(own, F.greatest), "base_top1_votes": _votes(own, 1)}
    new |= {"base_invrank_mean": _mean(of("invrank", base)), "base_invrank_std": _std(of("invrank", base))}
    return df.withColumns(new)


def with_current(df: DataFrame, by: str = "qid", measure: str = "base_rank_mean") -> DataFrame:
    """df with is_current: the first action of least `measure` in each group."""
    return df.withColumn("is_current", (F.row_number().over(group(by).orderBy(F.round(measure, 12), "ord")) == 1).cast("int"))


def of_current(c: str, by: str = "qid") -> Column:
    return F.max(F.when(F.col("is_current") == 1, F.col(c))).over(group(by))


def with_mask(df: DataFrame, by: str = "qid") -> DataFrame:
    """df with allowed: the current action, and those with its document and its article, if there is one."""
    same = (F.col("primary_doc") == of_current("primary_doc", by)) & (F.col("first_article") == of_current("first_article", by)) & (F.col("first_article") != "")
    return df.withColumn("allowed", F.coalesce(same, F.lit(False)) | (F.col("is_current") == 1))


def with_deltas(df: DataFrame, columns: Sequence[str], by: str = "qid") -> DataFrame:
    """df with delta_current__<c>: the difference to the current action."""
    return df.withColumns({f"delta_current__{c}": F.col(c) - of_current(c, by) for c in columns})


def masked_best(df: DataFrame, score: str, by: str = "qid") -> DataFrame:
    """The allowed action of the highest score (to nine places) in each group, the first of equal ones."""
    order = group(by).orderBy(F.round(score, 9).desc_nulls_last(), "ord")
    return df.filter("allowed").withColumn("at", F.row_number().over(order)).filter("at = 1").drop("at")
