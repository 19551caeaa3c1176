"""Queries of retrieval. The questions are the chunks whose id is divisible by 50: their text asks, their vector is the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainlake.operators import dense, lexical
from grainlake.plans import fixtures as X
from grainlake.plans.registry import query
from grainlake.plans.text_queries import body_sql, numbers_sql, token_set_sql, words_sql
from grainlake.session import materialize

ASKED = 200  # characters of a chunk that make a question


def units(spark: SparkSession, d: str) -> DataFrame:
    """The chunks with unit vectors."""
    return materialize(X.chunks(spark, d).withColumn("unit", dense.unit(F.col("vec"))).drop("vec"), "units")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, doc_id, vec of the chunks, written once for the steps that multiply; the texts stay where they are."""
    return materialize(X.chunk_parts(X.chunk_rows(spark, d), "doc_id", "vec"), "vectors")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """qid, question, unit, written once."""
    rows = X.chunk_parts(X.chunk_rows(spark, d).filter("chunk_id % 50 = 0"), "text", "vec")
    return materialize(rows.select(F.col("chunk_id").cast("string").alias("qid"), F.substring("text", 1, ASKED).alias("question"), dense.unit(F.col("vec")).alias("unit")), "asked")


def _lexical(spark: SparkSession, d: str, questions: DataFrame, boost: float = lexical.BOOST) -> DataFrame:
    return lexical.bm25_ranking(questions, X.corpus_unmoved(spark, d), boost=boost)


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return dense.dense_ranking(asked(spark, d), vectors(spark, d))


def _fused(spark: SparkSession, d: str, questions: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    questions = asked(spark, d) if questions is None else questions
    chunks = vectors(spark, d) if chunks is None else chunks
    return dense.fuse([_lexical(spark, d, questions), dense.dense_ranking(questions, chunks)])


def _pool(spark: SparkSession, d: str, questions: DataFrame, most: int | None = None) -> DataFrame:
    chunks = vectors(spark, d)
    return dense.candidate_pool(_fused(spark, d, questions, chunks), questions, chunks, most=most)


def _read_pool(spark: SparkSession, d: str, questions: DataFrame) -> DataFrame:
    """The best of the pool that the reranker sees, with kind, chunk_pos and text."""
    return _pool(spark, d, questions, dense.PRE).join(X.chunk_parts(X.chunk_rows(spark, d), "kind", "chunk_pos", "text"), "chunk_id")


def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The five candidates of each question."""
    questions = asked(spark, d)
    return dense.two_stage(_read_pool(spark, d, questions), questions.select("qid", "question"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_WORDS = f"words AS (SELECT doc_id, {words_sql('passage')} AS w FROM corpus), size_row AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words)"
_INDEX = f"{X.CORPUS}, {_WORDS}, postings AS (SELECT doc_id, term, doc_len, count(*) AS tf FROM (SELECT doc_id, len(w) AS doc_len, unnest(w) AS term FROM words) GROUP BY ALL), idf AS (SELECT term, count(*) AS df, ln((any_value(n) + 1) / count(*)) AS idf FROM postings, size_row GROUP BY term)"
_UNIT = f"{X.CHUNKS}, units AS (SELECT chunk_id, doc_id, kind, chunk_pos, text, list_transform(vec, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(vec, lambda y: y::DOUBLE * y::DOUBLE)))) AS unit FROM chunks), asked AS (SELECT CAST(chunk_id AS VARCHAR) AS qid, left(text, {ASKED}) AS question, unit FROM units WHERE chunk_id % 50 = 0)"


def _top(source: str, score: str, tie: str, most: int, rank: str = "rank", keep: str = "*") -> str:
    return f"(SELECT {keep}, row_number() OVER (PARTITION BY qid ORDER BY round({score}, 9) DESC, {tie}) AS {rank} FROM {source} QUALIFY {rank} <= {most})"


_BM25 = f"""{_INDEX}, {_UNIT}, terms AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({words_sql('question')}) AS term FROM asked) GROUP BY ALL),
base AS (SELECT qid, sum(qtf * idf) AS base FROM terms JOIN idf USING (term) GROUP BY qid),
gain AS (SELECT qid, doc_id, sum(qtf * idf * tf * 2.5 / (1.5 * (1 - 0.75 + 0.75 * doc_len / avgdl) + tf)) AS gain FROM terms JOIN idf USING (term) JOIN postings USING (term), size_row GROUP BY ALL),
scored AS (SELECT asked.qid, corpus.doc_id, coalesce(base, 0) + coalesce(gain, 0) AS score FROM asked CROSS JOIN corpus LEFT JOIN base USING (qid) LEFT JOIN gain ON gain.qid = asked.qid AND gain.doc_id = corpus.doc_id),
bm25 AS {_top('scored', 'score', 'doc_id', 400)}"""
_BOOST = f"""{_BM25}, boosted AS (SELECT qid, doc_id, score * (1 + 0.4 * len(list_intersect({numbers_sql('question')}, {numbers_sql('passage')}))) AS score FROM bm25 JOIN asked USING (qid) JOIN corpus USING (doc_id)),
lexical AS {_top('boosted', 'score', 'doc_id', 1000000)}"""
_DENSE = f"best AS (SELECT qid, doc_id, max(list_inner_product(asked.unit, units.unit)) AS score FROM asked, units GROUP BY ALL), dense AS {_top('best', 'score', 'doc_id', 250)}"
_NORM = "{0}_n AS (SELECT qid, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM {0} WINDOW w AS (PARTITION BY qid))"
_FUSED = f"{_BOOST}, {_DENSE}, {_NORM.format('lexical')}, {_NORM.format('dense')}, summed AS (SELECT qid, doc_id, sum(score) AS score FROM (SELECT qid, doc_id, 0.5 * score AS score FROM lexical_n UNION ALL SELECT qid, doc_id, score FROM dense_n) GROUP BY ALL), fused AS {_top('summed', 'score', 'doc_id', 30)}"
_POOL = f"{_FUSED}, pool AS (SELECT qid, rank AS doc_rank, chunk_id, doc_id, kind, chunk_pos, text, list_inner_product(asked.unit, units.unit) AS emb FROM fused JOIN asked USING (qid) JOIN units USING (doc_id) WHERE rank <= 3)"
_OVERLAP = f"(SELECT 1.0 * len(list_intersect({token_set_sql('question')}, {token_set_sql('scored_text')})) / greatest(1, len({token_set_sql('question')})))"
_RERANK = f"{_POOL}, pre AS {_top('pool', 'emb', 'chunk_id', 10, 'emb_rank')}, texts AS (SELECT pre.*, question, coalesce(nullif({body_sql('text')}, ''), text) AS scored_text FROM pre JOIN asked USING (qid)), reranked AS (SELECT *, 1 / (1 + exp(2 - 4 * {_OVERLAP})) AS ce FROM texts)"
CANDIDATES = f"{_RERANK}, candidates AS {_top('reranked', 'ce', 'chunk_id', 5, 'ce_rank', 'qid, question, chunk_id, doc_id, kind, text, emb, ce')}"


@query(f"WITH {_INDEX} SELECT doc_id, term, tf, doc_len FROM postings")
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    """The lexical index."""
    return lexical.postings(lexical.tokens(X.corpus(spark, d))).select("doc_id", "term", "tf", "doc_len")


@query(f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    """Term weights."""
    corpus = X.corpus(spark, d)
    return _rounded(lexical.term_weights(lexical.postings(lexical.tokens(corpus)), corpus.count()), "idf")


@query(f"WITH {_BM25} SELECT qid, doc_id, rank, round(score, 6) AS score FROM bm25")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 400 best documents by BM25+."""
    return _rounded(_lexical(spark, d, asked(spark, d), 0), "score").select("qid", "doc_id", "rank", "score")


@query(f"WITH {_BOOST} SELECT qid, doc_id, rank, round(score, 6) AS score FROM lexical")
def bm25_number_boost(spark: SparkSession, d: str) -> DataFrame:
    """The same after the boost for common numbers."""
    return _rounded(_lexical(spark, d, asked(spark, d)), "score").select("qid", "doc_id", "rank", "score")


@query(f"WITH {X.CHUNKS} SELECT chunk_id, list_transform(vec, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(vec, lambda y: y::DOUBLE * y::DOUBLE))), 6)) AS unit FROM chunks")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of length one."""
    return units(spark, d).select("chunk_id", F.transform("unit", lambda x: F.round(x, 6)).alias("unit"))


@query(f"WITH {_UNIT}, {_DENSE} SELECT qid, doc_id, rank, round(score, 6) AS score FROM dense")
def dense_doc_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 250 best documents by their best chunk."""
    return _rounded(_dense(spark, d), "score").select("qid", "doc_id", "rank", "score")


@query(f"WITH {_UNIT}, {_DENSE}, {_NORM.format('dense')} SELECT qid, doc_id, round(score, 6) AS score FROM dense_n")
def minmax_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each list between 0 and 1."""
    return _rounded(dense.minmax(_dense(spark, d)), "score")


@query(f"WITH {_FUSED} SELECT qid, doc_id, rank, round(score, 6) AS score FROM fused")
def score_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The 30 best documents of both lists together."""
    return _rounded(_fused(spark, d), "score").select("qid", "doc_id", "rank", "score")


@query(f"WITH {_FUSED} SELECT qid, rank, doc_id FROM fused WHERE rank <= 3")
def hybrid_topdocs(spark: SparkSession, d: str) -> DataFrame:
    """The three documents that evidence is taken from."""
    return _fused(spark, d).filter("rank <= 3").select("qid", "rank", "doc_id")


@query(f"WITH {_POOL} SELECT qid, doc_rank, chunk_id, round(emb, 6) AS emb FROM pool")
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of these documents."""
    return _rounded(_pool(spark, d, asked(spark, d)), "emb").select("qid", "doc_rank", "chunk_id", "emb")


@query(f"WITH {_POOL} SELECT qid, rank, chunk_id, round(emb, 6) AS emb FROM {_top('pool', 'emb', 'chunk_id', 50)}")
def audit_pool(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best of them by embedding."""
    return _rounded(dense.audit_pool(_pool(spark, d, asked(spark, d), dense.AUDIT)), "emb").select("qid", "rank", "chunk_id", "emb")


@query(f"WITH {_RERANK} SELECT qid, chunk_id, round(ce, 6) AS ce FROM reranked")
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the default reranker for the ten best."""
    questions = asked(spark, d)
    return _rounded(dense.lexical_rerank(_read_pool(spark, d, questions), questions.select("qid", "question")), "ce").select("qid", "chunk_id", "ce")


@query(f"WITH {CANDIDATES} SELECT qid, ce_rank, chunk_id, doc_id, kind, round(emb, 6) AS emb, round(ce, 6) AS ce FROM candidates")
def two_stage_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best by the reranker."""
    return _rounded(top_candidates(spark, d), "emb", "ce").select("qid", "ce_rank", "chunk_id", "doc_id", "kind", "emb", "ce")
