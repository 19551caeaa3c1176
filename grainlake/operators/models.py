"""Learned scorers of actions: rankers by pairwise differences, regressors, and out-of-fold stacking, on Spark ML.

A ranker learns from mirrored differences of two actions of a question; its weight vector scores a single action. Trees can't
score differences of one, so tree rankers are regressors on dense grades.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainlake.operators import ranking as R
from grainlake.operators import selection as S
from grainlake.session import materialize

SEEDS = (42, 10042, 20042, 30042, 40042)
#: Level-0 scorers: name, family, options. Options hold what differs; no score of another library is claimed.
LEVEL0 = (
    ("pair_s1", "pairwise", {"regParam": 0.01}), ("pair_s2", "pairwise", {"regParam": 0.1}), ("ndcg", "pairwise", {"regParam": 0.01, "top": 5}), ("gbt_reg", "gbt", {"maxDepth": 4, "seed": 1}),
    ("lambda_s1", "pairwise", {"regParam": 0.05, "top": 3}), ("deep", "gbt_grade", {"maxDepth": 5, "seed": 2}), ("linear_reg", "linear", {"regParam": 0.01}),
    ("yeti_s1", "pairwise", {"regParam": 0.2}), ("pair_logit", "pairwise", {"regParam": 0.02}), ("forest_reg", "forest", {"maxDepth": 6, "seed": 3}),
)


def filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Nulls and NaN as 0, which the trees take like any value."""
    return df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})


def pair_differences(df: DataFrame, features: Sequence[str], target: str, top: int | None = None) -> DataFrame:
    """Mirrored differences of all actions of a question; top: weights count only pairs that touch its `top` best."""
    rows = df.withColumn("allowed", F.lit(True))
    if top is not None:
        rows = rows.withColumn("best", (R.rank_first(target) <= top).cast("double"))
        pairs = S.regret_pairs(rows, [*features, "best"], target)
        return pairs.withColumn("weight", F.col("weight") * F.when(F.col("d_best") != 0, 2.0).otherwise(1.0)).drop("d_best")
    return S.regret_pairs(rows, features, target)


def fit_pairwise(df: DataFrame, features: Sequence[str], target: str = "target", top: int | None = None, **options: float) -> PipelineModel:
    """Weighted logistic regression on differences, without intercept, so that scores of single actions compare."""
    pairs = pair_differences(filled(df, features), features, target, top)
    pairs = pairs.select("label", "weight", *(F.col(f"d_{f}").alias(f) for f in features))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, LogisticRegression(weightCol="weight", fitIntercept=False, maxIter=50, **options)]).fit(pairs)


def fit_regressor(df: DataFrame, features: Sequence[str], family: str, target: str = "target", **options: float) -> PipelineModel:
    rows = filled(df, features).withColumn("label", (R.dense_grade(target) if family.endswith("_grade") else F.col(target)).cast("double"))
    model = {"gbt": GBTRegressor, "gbt_grade": GBTRegressor, "linear": LinearRegression, "forest": RandomForestRegressor}[family](**options)
    if family.startswith("gbt"):
        model.setMaxIter(10)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), model]).fit(rows)


def fit(df: DataFrame, features: Sequence[str], family: str, target: str = "target", **options: float) -> PipelineModel:
    """One scorer of a family: pairwise, gbt, gbt_grade, linear or forest."""
    if family == "pairwise":
        return fit_pairwise(df, features, target, **options)
    return fit_regressor(df, features, family, target, **options)


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """df with the model's score of each action."""
    own = [f"_{f}" for f in features]
    rows = df.withColumns({f"_{f}": F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})
    kept = rows.select(*(F.col(c) for c in df.columns if c not in features), *(F.col(f).alias(f"{f}__was") for f in features), *(F.col(o).alias(f) for o, f in zip(own, features, strict=True)))
    made = model.transform(kept)
    value = vector_to_array("rawPrediction")[1] if "rawPrediction" in made.columns else F.col("prediction")
    return made.select(*(F.col(f"{c}__was").alias(c) if c in features else F.col(c) for c in df.columns), value.alias(name))


def win_chance(model: PipelineModel, features: Sequence[str]):
    """The chance that left beats right as a column function of the differences, from a pairwise model's coefficients."""
    weights = dict(zip(features, model.stages[-1].coefficients.toArray().tolist(), strict=True))

    def chance(differences: Sequence[str]) -> Column:
        total = F.lit(0.0)
        for f, d in zip(features, differences, strict=True):
            total = total + F.lit(weights[f]) * F.col(d)
        return 1 / (1 + F.exp(-total))

    return chance


def out_of_fold(df: DataFrame, features: Sequence[str], scorers: Sequence[tuple[str, str, dict]] = LEVEL0, target: str = "target", fold: str = "fold", folds: int = 5) -> DataFrame:
    """df with pred__<name> of each scorer; every row is scored by models that haven't seen its fold."""
    out = None
    for k in range(1, folds + 1):
        training, held = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
        for name, family, options in scorers:
            held = score(fit(training, features, family, target, **options), held, features, f"pred__{name}")
        held = materialize(held, "oof")
        out = held if out is None else out.unionByName(held)
    return out


def fit_bundle(df: DataFrame, features: Sequence[str], scorers: Sequence[tuple[str, str, dict]] = LEVEL0, target: str = "target") -> dict[str, PipelineModel]:
    """All scorers fitted on all rows, and one base ranker for each seed on a bootstrap of the questions by hash."""
    models = {f"pred__{n}": fit(df, features, family, target, **options) for n, family, options in scorers}
    for seed in SEEDS:
        models[f"base_final_{seed}"] = fit_pairwise(df.filter(F.pmod(F.xxhash64(F.lit(seed), "qid"), F.lit(5)) != 0), features, target, regParam=0.01)
    return models


def save_bundle(models: dict[str, PipelineModel], folder: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/{name}")


def load_bundle(names: Sequence[str], folder: str) -> dict[str, PipelineModel]:
    return {n: PipelineModel.load(f"{folder}/{n}") for n in names}
