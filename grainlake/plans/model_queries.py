"""Queries of learned scorers, on the orders and lines that stand for questions and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainlake.operators import models
from grainlake.operators import ranking as R
from grainlake.operators import selection as S
from grainlake.plans.ranking_queries import FEATURES, actions, masked
from grainlake.plans.registry import query
from grainlake.session import materialize

SCORERS = (("pair", "pairwise", {"regParam": 0.01}), ("linear", "linear", {"regParam": 0.01}))


@query()
def oof_stacking(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold scores of two level-0 scorers, each row once."""
    rows = materialize(actions(spark, d).withColumn("fold", F.pmod("qid", F.lit(5)) + 1), "actions")
    scored = models.out_of_fold(rows, FEATURES, SCORERS)
    return scored.select("qid", "ord", "fold", *(F.round(f"pred__{n}", 6).alias(f"pred__{n}") for n, _, _ in SCORERS))


@query()
def learned_selection(spark: SparkSession, d: str) -> DataFrame:
    """One action for each question by a pairwise model that was fitted on regret pairs."""
    rows = materialize(masked(spark, d).select("qid", "ord", "is_current", "allowed", "target", "het_prob_mean", *FEATURES), "masked")
    model = models.fit_pairwise(rows, FEATURES, regParam=0.01)
    return S.select_action(rows, "het_prob_mean", models.win_chance(model, FEATURES), FEATURES).select("qid", "final", "n_allowed")


@query()
def meta_ranker(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a second-level ranker over the consensus of the first level, targets as dense grades."""
    names = ("het_rank_mean", "het_z_mean", "het_prob_mean", "base_rank_mean")
    rows = masked(spark, d).withColumn("grade", R.dense_grade("target").cast("double")).select("qid", "ord", "grade", *names)
    rows = materialize(rows, "meta")
    return models.score(models.fit_pairwise(rows, names, "grade", regParam=0.01), rows, names, "meta").select("qid", "ord", F.round("meta", 6).alias("meta"))
