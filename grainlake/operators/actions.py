"""Actions: the evidence sets that can answer a question, one candidate or a pair, and their features.

A pair's features compare its members; a single candidate has null in the sixteen features that need a second one. Candidates
come as qid, question, ce_rank, doc_id, kind, text, emb, ce, ranked from 1; pairs join on qid with the smaller rank first, at
most `most` candidates a question.

Defined results: a null text counts as ''; a null question has no tokens; ties for the primary member go to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainlake.functions import text as T

MEMBER = ["ce", "emb", "ce_rank", "len", "body_len", "q_overlap", "q_jaccard", "is_parent", "is_child", "has_article"]
PAIR = [
    *(f"c1_{x}" for x in MEMBER), *(f"c2_{x}" for x in MEMBER), "ce_sum", "ce_mean", "ce_gap", "emb_sum", "emb_mean", "emb_gap", "same_doc", "same_kind", "same_article",
    "pair_text_jaccard", "pair_query_coverage", "incremental_q_cov_c2", "incremental_q_cov_c1", "combined_len", "len_ratio", "rank_sum", "rank_gap", "contains_rank1", "contains_rank2",
]
UNDEFINED_ALONE = [*(f"c2_{x}" for x in MEMBER), "same_doc", "same_kind", "same_article", "pair_text_jaccard", "len_ratio", "rank_gap"]


def size_of(c: Column) -> Column:
    return F.size(c).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    return size_of(F.array_intersect(a, b)) / F.greatest(F.lit(1.0), size_of(F.array_union(a, b)))


def recall(asked: Column, found: Column) -> Column:
    return size_of(F.array_intersect(asked, found)) / F.greatest(F.lit(1.0), size_of(asked))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def with_features(candidates: DataFrame) -> DataFrame:
    """Candidates with their ten features and the token sets behind them; tokens are taken once for each candidate."""
    rows = candidates.withColumns({"text": T.text_of(F.col("text")), "q_tokens": T.token_set(F.col("question"))})
    rows = rows.withColumns({"tokens": T.token_set(F.col("text")), "article": T.first_article(F.col("text")), "len": F.length("text"), "body_len": F.length(T.chunk_body(F.col("text")))})
    return rows.withColumns({
        "q_overlap": recall(F.col("q_tokens"), F.col("tokens")), "q_jaccard": jaccard(F.col("q_tokens"), F.col("tokens")),
        "is_parent": flag(F.col("kind") == "parent"), "is_child": flag(F.col("kind") == "child"), "has_article": flag(F.col("article") != ""),
    })


def singles(featured: DataFrame) -> DataFrame:
    """qid, action_key, action_size, action_i, action_j, primary_doc, first_article and the features of each candidate alone."""
    one = {f"c1_{x}": F.col(x) for x in MEMBER} | {x: F.lit(None) for x in UNDEFINED_ALONE}
    one |= {"ce_sum": F.col("ce"), "ce_mean": F.col("ce"), "ce_gap": F.lit(0.0), "emb_sum": F.col("emb"), "emb_mean": F.col("emb"), "emb_gap": F.lit(0.0)}
    one |= {"pair_query_coverage": F.col("q_overlap"), "incremental_q_cov_c2": F.lit(0.0), "incremental_q_cov_c1": F.col("q_overlap"), "combined_len": F.col("len"), "rank_sum": F.col("ce_rank")}
    one |= {"contains_rank1": flag(F.col("ce_rank") == 1), "contains_rank2": flag(F.col("ce_rank") == 2)}
    key = [F.concat(F.lit("S"), F.col("ce_rank")).alias("action_key"), F.lit(1).alias("action_size"), F.col("ce_rank").alias("action_i"), F.lit(0).alias("action_j")]
    return featured.select("qid", *key, F.col("doc_id").alias("primary_doc"), F.col("article").alias("first_article"), *(one[x].cast("double").alias(x) for x in PAIR))


def pairs(featured: DataFrame) -> DataFrame:
    """The same for each pair of candidates of a question."""
    columns = ["q_tokens", "tokens", "article", "doc_id", "kind", *MEMBER]
    a = featured.select("qid", *(F.col(x).alias(f"a_{x}") for x in columns))
    b = featured.select("qid", *(F.col(x).alias(f"b_{x}") for x in columns))
    rows = a.join(b, (a["qid"] == b["qid"]) & (F.col("a_ce_rank") < F.col("b_ce_rank"))).drop(b["qid"])
    x = lambda n: F.col(f"a_{n}")
    y = lambda n: F.col(f"b_{n}")
    q, t1, t2 = x("q_tokens"), x("tokens"), y("tokens")
    of = {f"c1_{n}": x(n) for n in MEMBER} | {f"c2_{n}": y(n) for n in MEMBER}
    for n in ("ce", "emb"):
        of |= {f"{n}_sum": x(n) + y(n), f"{n}_mean": (x(n) + y(n)) / 2, f"{n}_gap": F.abs(x(n) - y(n))}
    of |= {"same_doc": flag(x("doc_id") == y("doc_id")), "same_kind": flag(x("kind") == y("kind")), "same_article": flag((x("article") != "") & (x("article") == y("article")))}
    of |= {"pair_text_jaccard": jaccard(t1, t2), "pair_query_coverage": recall(q, F.array_union(t1, t2))}
    alone = lambda s, t: size_of(F.array_except(F.array_intersect(q, s), t)) / F.greatest(F.lit(1.0), size_of(q))
    of |= {"incremental_q_cov_c2": alone(t2, t1), "incremental_q_cov_c1": alone(t1, t2)}
    of |= {"combined_len": x("len") + y("len"), "len_ratio": F.greatest(x("len"), y("len")) / F.greatest(F.lit(1), F.least(x("len"), y("len")))}
    of |= {"rank_sum": x("ce_rank") + y("ce_rank"), "rank_gap": F.abs(x("ce_rank") - y("ce_rank"))}
    of |= {f"contains_rank{k}": flag((x("ce_rank") == k) | (y("ce_rank") == k)) for k in (1, 2)}
    first = x("ce") >= y("ce")
    key = [F.concat(F.lit("P"), x("ce_rank"), F.lit("_"), y("ce_rank")).alias("action_key"), F.lit(2).alias("action_size"), x("ce_rank").alias("action_i"), y("ce_rank").alias("action_j")]
    primary = [F.when(first, x("doc_id")).otherwise(y("doc_id")).alias("primary_doc"), F.when(first, x("article")).otherwise(y("article")).alias("first_article")]
    return rows.select(F.col("qid"), *key, *primary, *(of[n].cast("double").alias(n) for n in PAIR))


def action_frame(candidates: DataFrame) -> DataFrame:
    """Singles and pairs of every question: n + n (n - 1) / 2 actions of n candidates."""
    featured = with_features(candidates)
    return singles(featured).unionByName(pairs(featured))


def candidate_scores(pair_rows: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """qid, ce_rank, ce, emb, constant: the members' scores recovered from pairs, and whether all pairs agree on them."""
    sides = [pair_rows.select("qid", F.col(f"c{k}_ce_rank").cast("int").alias("ce_rank"), F.col(f"c{k}_ce").alias("ce"), F.col(f"c{k}_emb").alias("emb")) for k in (1, 2)]
    agg = sides[0].unionByName(sides[1]).groupBy("qid", "ce_rank").agg(F.min("ce").alias("ce"), F.min("emb").alias("emb"), (F.max("ce") - F.min("ce")).alias("d"), (F.max("emb") - F.min("emb")).alias("e"))
    return agg.select("qid", "ce_rank", "ce", "emb", ((F.col("d") <= tolerance) & (F.col("e") <= tolerance)).alias("constant"))


def score_drift(fresh: DataFrame, cached: DataFrame) -> DataFrame:
    """One row: candidates in both, and the greatest difference of either score."""
    both = fresh.select("qid", "ce_rank", F.col("ce").alias("a"), F.col("emb").alias("b")).join(cached.select("qid", "ce_rank", "ce", "emb"), ["qid", "ce_rank"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.greatest(F.abs(F.col("a") - F.col("ce")), F.abs(F.col("b") - F.col("emb")))), F.lit(0.0)).alias("drift"))
