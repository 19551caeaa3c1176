"""Queries of chunkers and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainlake.functions import chunking as C
from grainlake.functions import patterns as P
from grainlake.functions import text as T
from grainlake.operators import answers as A
from grainlake.plans import fixtures as X
from grainlake.plans.action_queries import candidates
from grainlake.plans.registry import query
from grainlake.plans.text_queries import _TITLE, _lit, _strip, distinct_sql


@query(f"WITH {X.CORPUS}, starts AS (SELECT doc_id, passage, unnest(range(0, greatest(1, length(passage)), 800)) AS s FROM corpus WHERE length(passage) > 0) SELECT doc_id, s // 800 AS piece_no, substr(passage, s + 1, 1000) AS piece FROM starts")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 1,000 characters with a stride of 800."""
    return X.corpus(spark, d).select("doc_id", F.posexplode(C.windows(F.col("passage"), 1000)).alias("piece_no", "piece"))


@query()
def parent_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Parent chunks (the boundaries look ahead, which RE2 can't; tested against a plain version)."""
    return C.parent_chunks(X.corpus(spark, d))


@query()
def child_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Child chunks (the same)."""
    return C.child_chunks(X.corpus(spark, d))


_REFS = f"{X.CORPUS}, found AS (SELECT doc_id, name AS question, regexp_extract_all(passage, {_lit(P.ARTICLE)}, 1) AS a0, regexp_extract_all(passage, {_lit(P.CLAUSE)}, 1) AS c0, {_TITLE} AS t0, regexp_extract(passage, {_lit('(Nghị định [0-9]+/[0-9]{4}/NĐ-CP)')}, 1) AS title FROM corpus), refs AS (SELECT doc_id, question, title, {distinct_sql('a0')} AS a, {distinct_sql('c0')} AS c, CASE WHEN regexp_matches(t0, '^[0-9]') THEN '' ELSE {_strip('t0')} END AS t FROM found)"
_ASKED = _strip("regexp_replace(question, '[?]+$', '')")


def _refs(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("passage")
    return X.corpus(spark, d).select("doc_id", F.col("name").alias("question"), T.articles(p).alias("a"), T.clauses(p).alias("c"), T.article_title(p).alias("t"), F.regexp_extract(p, "(Nghị định [0-9]+/[0-9]{4}/NĐ-CP)", 1).alias("title"))


@query(
    f"""WITH {_REFS}, parts AS (SELECT *, CASE WHEN len(c) BETWEEN 1 AND 3 THEN 'khoản ' || array_to_string(c, ', khoản ') || ' ' ELSE '' END || 'Điều ' || a[1] || ' ' || title AS cited FROM refs)
SELECT doc_id, CASE WHEN len(a) > 0 AND title <> '' AND t <> '' THEN 'Căn cứ ' || cited || ' quy định về ' || t || ' như sau:' WHEN len(a) > 0 AND title <> '' THEN 'Căn cứ ' || cited || ' quy định như sau:' WHEN title <> '' THEN 'Căn cứ ' || title || ' quy định như sau:' ELSE 'Theo quy định của pháp luật về ' || {_ASKED} || ' như sau:' END AS header FROM parts"""
)
def answer_header(spark: SparkSession, d: str) -> DataFrame:
    """Opening sentences."""
    return _refs(spark, d).select("doc_id", A.header(F.col("title"), F.col("a"), F.col("c"), F.col("t"), F.col("question")).alias("header"))


@query(f"WITH {_REFS} SELECT doc_id, 'Như vậy, ' || {_ASKED} || ' được quy định' || CASE WHEN len(a) > 0 AND title <> '' THEN ' tại Điều ' || a[1] || ' ' || title WHEN title <> '' THEN ' tại ' || title ELSE '' END || '.' AS conclusion FROM refs")
def answer_conclusion(spark: SparkSession, d: str) -> DataFrame:
    """Closing sentences."""
    return _refs(spark, d).select("doc_id", A.conclusion(F.col("title"), F.col("a"), F.col("question")).alias("conclusion"))


def _answers(spark: SparkSession, d: str, kept: DataFrame | None = None) -> DataFrame:
    kept = candidates(spark, d) if kept is None else kept
    return A.assemble(kept, X.named_documents(spark, d, kept)).join(kept.select("qid", "question").distinct(), "qid")


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Names of laws by code, as far as the corpus tells them: the documents whose passage opens with the code of a law."""
    code = F.regexp_extract(F.substring("passage", 1, 500), f"({A.LAW_CODE})", 1)
    return X.documents(spark, d).filter("name <> ''").select(code.alias("code"), "name").filter("code <> ''").groupBy("code").agg(F.min("name").alias("name"))


@query()
def assemble_answer(spark: SparkSession, d: str) -> DataFrame:
    """Answers from the five candidates."""
    return _answers(spark, d).select("qid", "answer")


_SPLIT = f"""{X.TRAIN}, lined AS (SELECT qid, question, string_split(regexp_replace(coalesce(answer, ''), '\r\n?', chr(10), 'g'), chr(10)) AS l FROM train_rows),
counted AS (SELECT *, coalesce(list_max(list_transform(l, lambda x, i: CASE WHEN {_strip('x')} <> '' THEN i ELSE 0 END)), 0) AS n FROM lined),
ended AS (SELECT *, CASE WHEN n > 0 AND starts_with(lower({_strip('l[n]')}), 'như vậy') THEN {_strip('l[n]')} ELSE '' END AS c FROM counted),
parts AS (SELECT qid, question, {_strip('l[1]')} AS h, {_strip("array_to_string(l[2:CASE WHEN c <> '' THEN n - 1 ELSE len(l) END], chr(10))")} AS b, c FROM ended)"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return A.split_parts(X.train(spark, d))


@query(f"WITH {_SPLIT} SELECT qid, h AS header, b AS body, c AS conclusion FROM parts")
def split_answer(spark: SparkSession, d: str) -> DataFrame:
    """Header, body and conclusion of the training answers."""
    return _parts(spark, d).select("qid", F.col("h").alias("header"), F.col("b").alias("body"), F.col("c").alias("conclusion"))


_UPPER_LINE = f"(length({{0}}) BETWEEN 8 AND 180 AND NOT regexp_matches({{0}}, '(?i)^Điều([^\\p{{{{L}}}}\\p{{{{N}}}}_]|$)') AND length(regexp_replace({{0}}, '[^\\p{{{{L}}}}]', '', 'g')) >= 10 AND length(regexp_replace({{0}}, '[^\\p{{{{Lu}}}}]', '', 'g')) * 10 >= length(regexp_replace({{0}}, '[^\\p{{{{L}}}}]', '', 'g')) * 9)".format(_strip("x"))


@query(f"WITH {X.CORPUS} SELECT doc_id, {_strip(f'regexp_replace(array_to_string(list_filter(string_split(passage, chr(10)), lambda x: NOT {_UPPER_LINE}), chr(10)), {_lit(chr(10) + "{3,}")}, chr(10) || chr(10), {_lit("g")})')} AS passage FROM corpus")
def pp_upper_headings(spark: SparkSession, d: str) -> DataFrame:
    """Passages without headings in capitals."""
    _, body, _ = A.drop_upper_headings(F.lit(""), F.col("passage"), F.lit(""))
    return X.corpus(spark, d).select("doc_id", body.alias("passage"))


@query(f"WITH {X.TRAIN} SELECT qid, 'Như vậy, theo quy định trên thì ' || {_strip('regexp_replace(' + _strip('coalesce(question, {})'.format(_lit(''))) + ', {}, {})'.format(_lit('[ ?.]+$'), _lit('')))} || '.' AS conclusion FROM train_rows")
def pp_v87(spark: SparkSession, d: str) -> DataFrame:
    """Conclusions in their last form."""
    _, _, end = A.conclude(F.col("question"))(F.lit(""), F.lit(""), F.lit(""))
    return X.train(spark, d).select("qid", end.alias("conclusion"))


def _ruled(spark: SparkSession, d: str, *rules) -> DataFrame:
    rows = A.split_parts(_answers(spark, d))
    for rule in rules:
        rows = A.apply_rule(rows, rule)
    return rows.select("qid", A.joined(F.col("h"), F.col("b"), F.col("c")).alias("answer"))


@query()
def pp_v80(spark: SparkSession, d: str) -> DataFrame:
    """Headers that take the citation of the conclusion."""
    return _ruled(spark, d, A.cite_from_conclusion)


@query()
def pp_normalize_type(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the kind named before each code of a document (it looks behind, which RE2 can't)."""
    return X.train(spark, d).select("qid", A.name_kinds(T.text_of(F.col("question"))).alias("question"))


@query()
def pp_v81(spark: SparkSession, d: str) -> DataFrame:
    """Headers in the wording of citations."""
    return _ruled(spark, d, A.citation_wording)


@query()
def pp_canonical_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Headers that cite laws by name."""
    return A.cite_by_name(A.split_parts(_answers(spark, d)), _names(spark, d)).select("qid", F.col("h").alias("header"))


@query()
def pp_qh_complete(spark: SparkSession, d: str) -> DataFrame:
    """The same where only one code is named."""
    return A.cite_by_name(A.split_parts(_answers(spark, d)), _names(spark, d), only=True).select("qid", F.col("h").alias("header"))


@query()
def pp_cleanup_topic(spark: SparkSession, d: str) -> DataFrame:
    """Headers without the tail of a question."""
    return _ruled(spark, d, A.trim_topic)


@query()
def pp_add_clause(spark: SparkSession, d: str) -> DataFrame:
    """Headers with the clause that the evidence is."""
    return _ruled(spark, d, A.add_clause)


@query()
def pp_v83(spark: SparkSession, d: str) -> DataFrame:
    """Conclusions without the tail of a question."""
    return _ruled(spark, d, A.trim_conclusion)


@query()
def pp_v84(spark: SparkSession, d: str) -> DataFrame:
    """Bodies without the mark of the header's article."""
    return _ruled(spark, d, A.article_of_body)


@query()
def pp_override(spark: SparkSession, d: str) -> DataFrame:
    """Headers given for single questions."""
    kept = candidates(spark, d)
    given = kept.groupBy("qid").agg(F.min("doc_id").alias("d")).select("qid", F.concat(F.lit("Căn cứ văn bản "), "d", F.lit(" như sau:")).alias("header"))
    return A.override(A.split_parts(_answers(spark, d, kept)), given).select("qid", F.col("h").alias("header"))


@query()
def postprocess_chain(spark: SparkSession, d: str) -> DataFrame:
    """Answers after all rules."""
    return A.normalise(_answers(spark, d), _names(spark, d)).select("qid", "answer")
