"""Queries of ranks, consensus and selection. Orders stand for questions, their lines for actions with four scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainlake.operators import ranking as R
from grainlake.operators import selection as S
from grainlake.plans.registry import query
from grainlake.sources.tables import table

SCORES, BASE = ("p1", "p2", "p3", "p4"), ("p1", "p2")
FEATURES = ("p1", "p3", "p4")
DELTAS = ("het_rank_mean", "het_z_mean", "base_rank_mean", "p1")
_KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def actions(spark: SparkSession, d: str) -> DataFrame:
    """qid, ord, p1 to p4, target, primary_doc, first_article."""
    rows = table(spark, d, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_KEYS))
    return rows.select(
        F.col("l_orderkey").alias("qid"), place.alias("ord"), F.col("l_quantity").cast("double").alias("p1"), F.col("l_extendedprice").cast("double").alias("p2"), F.col("l_discount").cast("double").alias("p3"), F.col("l_tax").cast("double").alias("p4"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("target"), F.col("l_returnflag").alias("primary_doc"), F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus")).alias("first_article"),
    )


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return R.with_ranks(actions(spark, d), SCORES)


def masked(spark: SparkSession, d: str) -> DataFrame:
    return R.with_mask(R.with_current(R.consensus(ranked(spark, d), SCORES, BASE)))


def chance(differences: Sequence[str]) -> Column:
    """A formulaic scorer: the logistic of a weighted sum of differences."""
    return 1 / (1 + F.exp(-(0.05 * F.col(differences[0]) + 3 * F.col(differences[1]) - 2 * F.col(differences[2]))))


_ACTIONS = "actions AS (SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(_KEYS) + ") AS ord, CAST(l_quantity AS DOUBLE) AS p1, CAST(l_extendedprice AS DOUBLE) AS p2, CAST(l_discount AS DOUBLE) AS p3, CAST(l_tax AS DOUBLE) AS p4, CAST(l_extendedprice * (1 - l_discount) AS DOUBLE) AS target, l_returnflag AS primary_doc, CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END AS first_article FROM lineitem)"
_R1 = "ranks AS (SELECT *, " + ", ".join(f"row_number() OVER (PARTITION BY qid ORDER BY {s} DESC NULLS LAST, ord) AS rank__{s}, coalesce(({s} - avg({s}) OVER (PARTITION BY qid)) / nullif(stddev_samp({s}) OVER (PARTITION BY qid), 0), 0) AS z__{s}" for s in SCORES) + " FROM actions)"
_R2 = "ranked AS (SELECT *, " + ", ".join(f"1.0 / rank__{s} AS invrank__{s}, exp(z__{s} - max(z__{s}) OVER (PARTITION BY qid)) / sum(exp(z__{s})) OVER (PARTITION BY qid) * exp(max(z__{s}) OVER (PARTITION BY qid)) AS prob__{s}" for s in SCORES) + " FROM ranks)"
_RANKED = f"{_ACTIONS}, {_R1}, {_R2}"


def _of(kind: str, names: Sequence[str]) -> str:
    return ", ".join(f"{kind}__{s}" for s in names)


def _list(kind: str, names: Sequence[str], f: str) -> str:
    return f"list_aggregate([{_of(kind, names)}]::DOUBLE[], '{f}')"


_HET = ", ".join(f"{_list(k, SCORES, 'avg')} AS het_{k}_mean, coalesce({_list(k, SCORES, 'stddev_samp')}, 0) AS het_{k}_std" for k in ("rank", "invrank", "z", "prob"))
_HET += f", least({_of('rank', SCORES)}) AS het_rank_min, greatest({_of('rank', SCORES)}) AS het_rank_max, greatest({_of('z', SCORES)}) AS het_z_max, greatest({_of('prob', SCORES)}) AS het_prob_max"
_HET += "".join(f", {' + '.join(f'CAST(rank__{s} <= {k} AS INT)' for s in SCORES)} AS het_top{k}_votes" for k in (1, 3))
_HET += f", {_list('rank', BASE, 'avg')} AS base_rank_mean, coalesce({_list('rank', BASE, 'stddev_samp')}, 0) AS base_rank_std, least({_of('rank', BASE)}) AS base_rank_min, greatest({_of('rank', BASE)}) AS base_rank_max, {' + '.join(f'CAST(rank__{s} <= 1 AS INT)' for s in BASE)} AS base_top1_votes"
_HET += f", {_list('invrank', BASE, 'avg')} AS base_invrank_mean, coalesce({_list('invrank', BASE, 'stddev_samp')}, 0) AS base_invrank_std"
_CONSENSUS_NAMES = [x.rpartition(" AS ")[2] for x in _HET.replace("AS INT", "").replace("AS DOUBLE", "").split(", ") if " AS " in x]
_MASKED = f"""{_RANKED}, agreed AS (SELECT *, {_HET} FROM ranked), current AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(base_rank_mean, 12), ord) = 1 AS INT) AS is_current FROM agreed),
cur AS (SELECT qid, primary_doc AS cur_doc, first_article AS cur_article, {', '.join(f'{x} AS cur_{x}' for x in DELTAS)} FROM current WHERE is_current = 1),
masked AS (SELECT current.*, cur_doc, {', '.join(f'cur_{x}' for x in DELTAS)}, (primary_doc = cur_doc AND first_article = cur_article AND first_article <> '') OR is_current = 1 AS allowed FROM current JOIN cur USING (qid))"""
_PAIRED = f"{_MASKED}, pairs AS (SELECT l.qid, l.ord AS l_ord, r.ord AS r_ord, l.target AS l_target, r.target AS r_target, {', '.join(f'l.{x} - r.{x} AS d_{x}' for x in FEATURES)} FROM masked l JOIN masked r ON l.qid = r.qid AND l.ord < r.ord WHERE l.allowed AND r.allowed)"
_CHANCE = "1 / (1 + exp(-(0.05 * {0}p1 + 3 * {0}p3 - 2 * {0}p4)))"
_BORDA = f"""{_PAIRED}, votes AS (SELECT qid, l_ord AS ord, {_CHANCE.format('d_')} AS v FROM pairs UNION ALL SELECT qid, r_ord, 1 - {_CHANCE.format('d_')} FROM pairs),
sums AS (SELECT qid, ord, sum(v) AS v FROM votes GROUP BY ALL), borda AS (SELECT m.qid, m.ord, m.is_current, coalesce(v, 0) + 1e-12 * m.is_current AS borda FROM masked m LEFT JOIN sums USING (qid, ord) WHERE m.allowed)"""
_SELECT = f"""{_BORDA}, base AS (SELECT * FROM masked WHERE allowed QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(het_prob_mean, 9) DESC NULLS LAST, ord) = 1),
winner AS (SELECT qid, ord FROM borda QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(borda, 13) DESC, ord) = 1),
chosen AS (SELECT base.qid, base.ord AS baseline, w.ord AS pairwise, CASE WHEN base.ord = w.ord THEN 0.5 ELSE 1 / (1 + exp(-(0.05 * (v.p1 - base.p1) + 3 * (v.p3 - base.p3) - 2 * (v.p4 - base.p4)))) END AS chance FROM base JOIN winner w USING (qid) JOIN masked v ON v.qid = w.qid AND v.ord = w.ord)"""


def _round(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    return df.select(*keep, *(F.round(F.col(c).cast("double"), 6).alias(c) for c in columns))


def _sql_round(columns: Sequence[str]) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns)


def _all(*kinds: str) -> list[str]:
    return [f"{k}__{s}" for k in kinds for s in SCORES]


@query(f"WITH {_RANKED} SELECT qid, ord, {_sql_round(_all('rank', 'invrank'))} FROM ranked")
def group_rank_first(spark: SparkSession, d: str) -> DataFrame:
    """Descending ranks and their reciprocals."""
    return _round(ranked(spark, d), _all("rank", "invrank"), "qid", "ord")


@query(f"WITH {_RANKED} SELECT qid, ord, round((rank__p1 + rank__p2) / 2, 6) AS mean_rank FROM ranked")
def mean_rank(spark: SparkSession, d: str) -> DataFrame:
    """Mean rank by the base scorers."""
    return ranked(spark, d).select("qid", "ord", F.round((F.col("rank__p1") + F.col("rank__p2")) / 2, 6).alias("mean_rank"))


@query(f"WITH {_RANKED} SELECT qid, ord, {_sql_round(_all('z'))} FROM ranked")
def group_zscore(spark: SparkSession, d: str) -> DataFrame:
    """z-scores within a question."""
    return _round(ranked(spark, d), _all("z"), "qid", "ord")


@query(f"WITH {_RANKED} SELECT qid, ord, {_sql_round(_all('prob'))} FROM ranked")
def group_softmax(spark: SparkSession, d: str) -> DataFrame:
    """Softmax of the z-scores."""
    return _round(ranked(spark, d), _all("prob"), "qid", "ord")


@query(f"WITH {_MASKED} SELECT qid, ord, {_sql_round(_CONSENSUS_NAMES)} FROM masked")
def consensus_features(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the scorers."""
    return _round(masked(spark, d), _CONSENSUS_NAMES, "qid", "ord")


@query(f"WITH {_MASKED} SELECT qid, ord, is_current FROM masked")
def current_action(spark: SparkSession, d: str) -> DataFrame:
    """The action of the least mean base rank."""
    return masked(spark, d).select("qid", "ord", "is_current")


@query(f"WITH {_MASKED} SELECT qid, ord, allowed FROM masked")
def safety_mask(spark: SparkSession, d: str) -> DataFrame:
    """Actions that share document and article with the current one."""
    return masked(spark, d).select("qid", "ord", "allowed")


@query(f"WITH {_MASKED} SELECT qid, ord, " + ", ".join(f"round({x} - cur_{x}, 6) AS delta_current__{x}" for x in DELTAS) + " FROM masked")
def delta_current(spark: SparkSession, d: str) -> DataFrame:
    """Differences to the current action."""
    return _round(R.with_deltas(masked(spark, d), DELTAS), [f"delta_current__{x}" for x in DELTAS], "qid", "ord")


@query(f"WITH {_ACTIONS} SELECT qid, ord, dense_rank() OVER (PARTITION BY qid ORDER BY round(target, 6)) - 1 AS grade FROM actions")
def dense_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Grades of relevance from targets."""
    return actions(spark, d).withColumn("target", F.round("target", 6)).select("qid", "ord", R.dense_grade("target").alias("grade"))


@query(f"WITH {_MASKED} SELECT qid, ord FROM masked WHERE allowed QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(het_prob_mean, 9) DESC NULLS LAST, ord) = 1")
def masked_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The best allowed action."""
    return R.masked_best(masked(spark, d), "het_prob_mean").select("qid", "ord")


@query(
    f"""WITH {_PAIRED}, regrets AS (SELECT *, abs(l_target - r_target) AS regret FROM pairs WHERE abs(l_target - r_target) > 1e-12), mean AS (SELECT avg(regret) AS mean FROM regrets)
SELECT qid, l_ord, r_ord, sign, CASE WHEN sign = 1 THEN CAST(l_target > r_target AS INT) ELSE 1 - CAST(l_target > r_target AS INT) END AS label, round(regret / mean, 6) AS weight, {', '.join(f'round(sign * d_{x}, 6) AS d_{x}' for x in FEATURES)} FROM regrets, mean, (SELECT unnest([1, -1]) AS sign)"""
)
def regret_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Mirrored pairs for learning."""
    return _round(S.regret_pairs(masked(spark, d), FEATURES), ["weight", *(f"d_{x}" for x in FEATURES)], "qid", "l_ord", "r_ord", "sign", "label")


@query(f"WITH {_BORDA} SELECT qid, ord, round(borda, 6) AS borda FROM borda")
def borda_count(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise votes for each allowed action."""
    return _round(S.borda(masked(spark, d), chance, FEATURES), ["borda"], "qid", "ord")


@query(f"WITH {_SELECT} SELECT qid, baseline, pairwise, round(chance, 6) AS chance, CASE WHEN baseline <> pairwise AND chance >= 0.55 THEN pairwise ELSE baseline END AS final FROM chosen")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """The pairwise choice where it is sure enough."""
    return _round(S.select_action(masked(spark, d), "het_prob_mean", chance, FEATURES), ["chance"], "qid", "baseline", "pairwise", "final")


@query(
    f"WITH {_SELECT}, facts AS (SELECT qid, max(CASE WHEN is_current = 1 THEN ord END) AS current, count(*) FILTER (allowed) AS n_allowed FROM masked GROUP BY qid) SELECT qid, current, n_allowed, CASE WHEN baseline <> pairwise AND chance >= 0.55 THEN pairwise ELSE baseline END AS final FROM chosen JOIN facts USING (qid)"
)
def select_action(spark: SparkSession, d: str) -> DataFrame:
    """The action chosen for each question."""
    return S.select_action(masked(spark, d), "het_prob_mean", chance, FEATURES).select("qid", "current", "n_allowed", "final")


@query(f"WITH {_ACTIONS} SELECT qid, ord, round(0.5 * p1 + 0.001 * p2, 6) AS base_final_1, round(p3 - p4, 6) AS pred__linear FROM actions")
def level0_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of two linear scorers."""
    return actions(spark, d).select("qid", "ord", F.round(0.5 * F.col("p1") + 0.001 * F.col("p2"), 6).alias("base_final_1"), F.round(F.col("p3") - F.col("p4"), 6).alias("pred__linear"))
