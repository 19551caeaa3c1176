"""Queries of actions and features over the retrieved candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainlake.operators import actions as A
from grainlake.plans.registry import query
from grainlake.plans.retrieval_queries import CANDIDATES, top_candidates
from grainlake.plans.text_queries import body_sql, first_article_sql, token_set_sql
from grainlake.session import materialize


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return materialize(top_candidates(spark, d), "candidates")


def frame(spark: SparkSession, d: str) -> DataFrame:
    return A.action_frame(candidates(spark, d))


_LEN = lambda a: f"CAST(len({a}) AS DOUBLE)"
_IN = "list_intersect({0}, {1})"
_UNION = "list_distinct(list_concat({0}, {1}))"
_FEATURED = f"""{CANDIDATES}, parts AS (SELECT *, {token_set_sql('question')} AS q, {token_set_sql('text')} AS t, {first_article_sql('text')} AS article, length(text) AS len, length({body_sql('text')}) AS body_len FROM candidates),
featured AS (SELECT *, {_LEN(_IN.format('q', 't'))} / greatest(1, len(q)) AS q_overlap, {_LEN(_IN.format('q', 't'))} / greatest(1, len({_UNION.format('q', 't')})) AS q_jaccard, CAST(kind = 'parent' AS INT) AS is_parent, CAST(kind = 'child' AS INT) AS is_child, CAST(article <> '' AS INT) AS has_article FROM parts)"""
_C = lambda k, a: ", ".join(f"CAST({a}.{x} AS DOUBLE) AS c{k}_{x}" for x in A.MEMBER)
_NULLS = ", ".join(f"CAST(NULL AS DOUBLE) AS c2_{x}" for x in A.MEMBER)
_SINGLE = f"""SELECT qid, 'S' || ce_rank AS action_key, 1 AS action_size, ce_rank AS action_i, 0 AS action_j, doc_id AS primary_doc, article AS first_article, {_C(1, 'a')}, {_NULLS},
ce AS ce_sum, ce AS ce_mean, 0.0 AS ce_gap, emb AS emb_sum, emb AS emb_mean, 0.0 AS emb_gap, NULL AS same_doc, NULL AS same_kind, NULL AS same_article, NULL AS pair_text_jaccard, q_overlap AS pair_query_coverage, 0.0 AS incremental_q_cov_c2, q_overlap AS incremental_q_cov_c1,
len AS combined_len, NULL AS len_ratio, ce_rank AS rank_sum, NULL AS rank_gap, CAST(ce_rank = 1 AS INT) AS contains_rank1, CAST(ce_rank = 2 AS INT) AS contains_rank2 FROM featured a"""
_EXCEPT = "list_filter({0}, lambda x: NOT list_contains({1}, x))"
_PAIRS = f"""SELECT a.qid, 'P' || a.ce_rank || '_' || b.ce_rank AS action_key, 2 AS action_size, a.ce_rank AS action_i, b.ce_rank AS action_j, CASE WHEN a.ce >= b.ce THEN a.doc_id ELSE b.doc_id END AS primary_doc, CASE WHEN a.ce >= b.ce THEN a.article ELSE b.article END AS first_article, {_C(1, 'a')}, {_C(2, 'b')},
a.ce + b.ce AS ce_sum, (a.ce + b.ce) / 2 AS ce_mean, abs(a.ce - b.ce) AS ce_gap, a.emb + b.emb AS emb_sum, (a.emb + b.emb) / 2 AS emb_mean, abs(a.emb - b.emb) AS emb_gap, CAST(a.doc_id = b.doc_id AS INT) AS same_doc, CAST(a.kind = b.kind AS INT) AS same_kind, CAST(a.article <> '' AND a.article = b.article AS INT) AS same_article,
{_LEN(_IN.format('a.t', 'b.t'))} / greatest(1, len({_UNION.format('a.t', 'b.t')})) AS pair_text_jaccard, {_LEN(_IN.format('a.q', 'list_concat(a.t, b.t)'))} / greatest(1, len(a.q)) AS pair_query_coverage,
{_LEN(_EXCEPT.format(_IN.format('a.q', 'b.t'), 'a.t'))} / greatest(1, len(a.q)) AS incremental_q_cov_c2, {_LEN(_EXCEPT.format(_IN.format('a.q', 'a.t'), 'b.t'))} / greatest(1, len(a.q)) AS incremental_q_cov_c1,
a.len + b.len AS combined_len, 1.0 * greatest(a.len, b.len) / greatest(1, least(a.len, b.len)) AS len_ratio, a.ce_rank + b.ce_rank AS rank_sum, abs(a.ce_rank - b.ce_rank) AS rank_gap, CAST(1 IN (a.ce_rank, b.ce_rank) AS INT) AS contains_rank1, CAST(2 IN (a.ce_rank, b.ce_rank) AS INT) AS contains_rank2
FROM featured a JOIN featured b ON a.qid = b.qid AND a.ce_rank < b.ce_rank"""
_FRAME = f"{_FEATURED}, singles AS ({_SINGLE}), pairs AS ({_PAIRS}), frame AS (SELECT * FROM singles UNION ALL BY NAME SELECT * FROM pairs)"
_OUT = "qid, action_key, " + ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {x}" for x in A.PAIR)


def _out(df: DataFrame) -> DataFrame:
    return df.select("qid", "action_key", *(F.round(x, 6).alias(x) for x in A.PAIR))


@query(f"WITH {_FEATURED} SELECT qid, ce_rank, round(q_overlap, 6) AS q_overlap, round(q_jaccard, 6) AS q_jaccard FROM featured")
def jaccard_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Token overlap of question and candidate."""
    return A.with_features(candidates(spark, d)).select("qid", "ce_rank", F.round("q_overlap", 6).alias("q_overlap"), F.round("q_jaccard", 6).alias("q_jaccard"))


@query(f"WITH {_FEATURED} SELECT qid, {', '.join(f'round(CAST({x} AS DOUBLE), 6) AS {x}' for x in A.MEMBER)} FROM featured")
def candidate_features(spark: SparkSession, d: str) -> DataFrame:
    """Ten features of each candidate."""
    return A.with_features(candidates(spark, d)).select("qid", *(F.round(F.col(x).cast("double"), 6).alias(x) for x in A.MEMBER))


@query(f"WITH {_FRAME} SELECT {_OUT} FROM pairs")
def pair_features(spark: SparkSession, d: str) -> DataFrame:
    """39 features of each pair."""
    return _out(A.pairs(A.with_features(candidates(spark, d))))


@query(f"WITH {_FRAME} SELECT {_OUT} FROM singles")
def singleton_features(spark: SparkSession, d: str) -> DataFrame:
    """The same columns for each candidate alone."""
    return _out(A.singles(A.with_features(candidates(spark, d))))


@query(f"WITH {_FRAME} SELECT qid, action_key, action_size, action_i, action_j, primary_doc, first_article FROM frame")
def enumerate_actions(spark: SparkSession, d: str) -> DataFrame:
    """Singles and pairs with the document and article of their best member."""
    return frame(spark, d).select("qid", "action_key", "action_size", "action_i", "action_j", "primary_doc", "first_article")


@query(f"WITH {_FRAME} SELECT qid, action_key, row_number() OVER (PARTITION BY qid ORDER BY action_size, action_i, action_j) AS ord FROM frame")
def canonical_sort(spark: SparkSession, d: str) -> DataFrame:
    """The place of each action in its question."""
    from pyspark.sql import Window

    order = Window.partitionBy("qid").orderBy("action_size", "action_i", "action_j")
    return frame(spark, d).select("qid", "action_key", F.row_number().over(order).alias("ord"))


@query(f"WITH {_FRAME} SELECT qid, count(*) AS n_actions, count(DISTINCT action_key) AS n_keys, sum(action_size) AS members FROM frame GROUP BY qid")
def assemble_actions(spark: SparkSession, d: str) -> DataFrame:
    """Size of each question's action set."""
    return frame(spark, d).groupBy("qid").agg(F.count(F.lit(1)).alias("n_actions"), F.count_distinct("action_key").alias("n_keys"), F.sum("action_size").alias("members"))


@query(f"WITH {_FRAME}, sides AS (SELECT qid, c1_ce_rank AS r, c1_ce AS ce, c1_emb AS emb FROM pairs UNION ALL SELECT qid, c2_ce_rank, c2_ce, c2_emb FROM pairs) SELECT qid, CAST(r AS INT) AS ce_rank, round(min(ce), 6) AS ce, round(min(emb), 6) AS emb, max(ce) - min(ce) <= 1e-12 AND max(emb) - min(emb) <= 1e-12 AS constant FROM sides GROUP BY ALL")
def reconstruct_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the candidates recovered from their pairs."""
    return A.candidate_scores(A.pairs(A.with_features(candidates(spark, d)))).withColumns({"ce": F.round("ce", 6), "emb": F.round("emb", 6)})


@query(f"WITH {CANDIDATES} SELECT count(*) AS n, CAST(0 AS DOUBLE) AS drift FROM candidates WHERE qid IN (SELECT qid FROM candidates GROUP BY qid HAVING count(*) > 1)")
def score_drift(spark: SparkSession, d: str) -> DataFrame:
    """Greatest difference between scores computed now and those recovered from pairs."""
    own = candidates(spark, d)
    return A.score_drift(own, A.candidate_scores(A.pairs(A.with_features(own)))).withColumn("drift", F.round("drift", 9))


@query(f"WITH {_FRAME} SELECT qid, action_key FROM singles UNION ALL SELECT qid, action_key FROM pairs")
def union_actions(spark: SparkSession, d: str) -> DataFrame:
    """Both row sets under each other."""
    featured = A.with_features(candidates(spark, d))
    return A.singles(featured).unionByName(A.pairs(featured)).select("qid", "action_key")


@query(f"WITH {_FRAME} SELECT " + ", ".join(f"count({x}) AS {x}" for x in A.UNDEFINED_ALONE) + " FROM singles")
def null_policy_check(spark: SparkSession, d: str) -> DataFrame:
    """Values in columns that a single candidate must leave null; every count has to be 0."""
    return A.singles(A.with_features(candidates(spark, d))).agg(*(F.count(x).alias(x) for x in A.UNDEFINED_ALONE))


@query(f"WITH {_FRAME}, sized AS (SELECT qid, count(*) AS n FROM frame GROUP BY qid) SELECT qid, n FROM sized WHERE n <> 15")
def group_size_violations(spark: SparkSession, d: str) -> DataFrame:
    """Questions that haven't fifteen actions."""
    return frame(spark, d).groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter("n <> 15")


@query(f"WITH {_FRAME} SELECT qid, string_agg(action_key, ',' ORDER BY action_size, action_i, action_j) = 'S1,S2,S3,S4,S5,P1_2,P1_3,P1_4,P1_5,P2_3,P2_4,P2_5,P3_4,P3_5,P4_5' AS in_order FROM frame GROUP BY qid")
def action_key_order(spark: SparkSession, d: str) -> DataFrame:
    """Whether the keys of a question are the frozen sequence."""
    want = [f"S{i}" for i in range(1, 6)] + [f"P{i}_{j}" for i in range(1, 6) for j in range(i + 1, 6)]
    keys = F.transform(F.array_sort(F.collect_list(F.struct("action_size", "action_i", "action_j", "action_key"))), lambda x: x["action_key"])
    return frame(spark, d).groupBy("qid").agg((F.array_join(keys, ",") == ",".join(want)).alias("in_order"))


@query(f"WITH {CANDIDATES} SELECT count(DISTINCT qid) AS n_questions FROM candidates")
def distinct_qids(spark: SparkSession, d: str) -> DataFrame:
    """Number of questions."""
    return candidates(spark, d).agg(F.count_distinct("qid").alias("n_questions"))
