"""Pairwise learning data, Borda count, the confidence gate, and the selection of one action for every question at once.

Pairs of actions meet by an equi-join on the question, within its allowed actions: as many as a question has actions, squared.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainlake.operators import ranking as R

GATE = 0.55


def action_pairs(df: DataFrame, columns: Sequence[str], by: str = "qid") -> DataFrame:
    """Each two allowed actions of a group: by, l_<c>, r_<c>; the left one comes first."""
    own = ["ord", *columns]
    allowed = df.filter("allowed")
    left, right = (allowed.select(by, *(F.col(c).alias(f"{s}_{c}") for c in dict.fromkeys(own))) for s in "lr")
    return left.join(right, by).filter("l_ord < r_ord")


def regret_pairs(df: DataFrame, features: Sequence[str], target: str = "target", by: str = "qid") -> DataFrame:
    """Mirrored differences of two actions with label and weight: by, l_ord, r_ord, sign, label, weight, d_<feature>.

    Pairs of equal targets teach nothing and are left out. Weights are regrets over their mean, which is one aggregate of all pairs.
    """
    rows = action_pairs(df, [target, *features], by).withColumn("regret", F.abs(F.col(f"l_{target}") - F.col(f"r_{target}"))).filter("regret > 1e-12")
    mean = rows.agg(F.avg("regret")).first()[0]
    both = rows.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    better = (F.col(f"l_{target}") > F.col(f"r_{target}")).cast("int")
    label = F.when(F.col("sign") == 1, better).otherwise(1 - better)
    return both.select(by, "l_ord", "r_ord", "sign", label.alias("label"), (F.col("regret") / F.lit(mean or 1.0)).alias("weight"), *((F.col("sign") * (F.col(f"l_{x}") - F.col(f"r_{x}"))).alias(f"d_{x}") for x in features))


def borda(df: DataFrame, probability: Callable[[Sequence[str]], Column], features: Sequence[str], by: str = "qid") -> DataFrame:
    """by, ord, borda of the allowed actions; probability: the chance that left beats right, of the columns d_<feature>.

    Each pair gives its chance to the left and the rest to the right action; the current one has 1e-12 more.
    """
    rows = action_pairs(df, features, by).withColumns({f"d_{x}": F.col(f"l_{x}") - F.col(f"r_{x}") for x in features})
    rows = rows.withColumn("p", probability([f"d_{x}" for x in features]))
    votes = rows.select(by, F.explode(F.array(F.struct(F.col("l_ord").alias("ord"), F.col("p").alias("v")), F.struct(F.col("r_ord").alias("ord"), (1 - F.col("p")).alias("v")))).alias("x"))
    sums = votes.groupBy(by, F.col("x.ord").alias("ord")).agg(F.sum("x.v").alias("votes"))
    allowed = df.filter("allowed").select(by, "ord", "is_current")
    return allowed.join(sums, [by, "ord"], "left").select(by, "ord", "is_current", (F.coalesce("votes", F.lit(0.0)) + 1e-12 * F.col("is_current")).alias("borda"))


def gate(baseline: Column, pairwise: Column, chance: Column, threshold: float = GATE) -> Column:
    """The pairwise choice where it is another one and sure enough, else the baseline."""
    return F.when((baseline != pairwise) & (chance >= threshold), pairwise).otherwise(baseline)


def select_action(df: DataFrame, meta: str, probability: Callable[[Sequence[str]], Column], features: Sequence[str], by: str = "qid", threshold: float = GATE) -> DataFrame:
    """by, current, baseline, pairwise, chance, final, n_allowed: ord of the actions chosen; one row for each group.

    df: actions with is_current and allowed. baseline: the best allowed by `meta`; pairwise: the Borda winner; chance: that it
    beats the baseline.
    """
    w = R.group(by)
    base = R.masked_best(df, meta, by).select(by, F.col("ord").alias("baseline"), *(F.col(x).alias(f"b_{x}") for x in features))
    counts = borda(df, probability, features, by)
    winner = counts.withColumn("at", F.row_number().over(w.orderBy(F.round("borda", 13).desc(), "ord"))).filter("at = 1").select(by, F.col("ord").alias("pairwise"))
    facts = df.groupBy(by).agg(F.max(F.when(F.col("is_current") == 1, F.col("ord"))).alias("current"), F.count_if("allowed").alias("n_allowed"))
    values = df.select(by, F.col("ord").alias("pairwise"), *(F.col(x).alias(f"p_{x}") for x in features))
    rows = facts.join(base, by).join(winner, by).join(values, [by, "pairwise"])
    rows = rows.withColumns({f"d_{x}": F.col(f"p_{x}") - F.col(f"b_{x}") for x in features})
    rows = rows.withColumn("chance", F.when(F.col("baseline") == F.col("pairwise"), F.lit(0.5)).otherwise(probability([f"d_{x}" for x in features])))
    return rows.select(by, "current", "baseline", "pairwise", "chance", gate(F.col("baseline"), F.col("pairwise"), F.col("chance"), threshold).alias("final"), "n_allowed")
