"""Queries of the text functions over the passages, questions, chunks and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainlake.functions import patterns as P
from grainlake.functions import text as T
from grainlake.operators import answers
from grainlake.plans import fixtures as X
from grainlake.plans.registry import query
from grainlake.sources.tables import table


def _lit(text: str) -> str:
    """A text as a string constant of SQL."""
    return "'" + text.replace("'", "''") + "'"


_STOP = "[" + ", ".join(map(_lit, P.STOPWORDS)) + "]"
_STRIP = _lit(P.STRIP)


def _strip(sql: str) -> str:
    return f"regexp_replace({sql}, {_STRIP}, '', 'g')"


def _squeeze(sql: str) -> str:
    return _strip(f"regexp_replace({sql}, {_lit(P.SPACE + '+')}, ' ', 'g')")


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), {_lit(P.SPACE + '+')}), lambda w: w <> '' AND NOT list_contains({_STOP}, w))"


def numbers_sql(c: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), {_lit(P.NUMBER)})"


def distinct_sql(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def token_set_sql(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), {_lit(P.WORD + '+')}))"


def first_article_sql(c: str) -> str:
    return f"regexp_extract(coalesce({c}, ''), {_lit(P.ARTICLE)}, 1)"


def body_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {_lit(P.CHUNK_PREFIX)}) THEN {_strip(f'regexp_extract({c}, {_lit(P.CHUNK_PREFIX)}, 2)')} ELSE coalesce({c}, '') END"


@query(f"SELECT DISTINCT CAST(id AS VARCHAR) AS doc_id, coalesce(passage, '') AS passage, coalesce(name, '') AS name, coalesce(link, '') AS link FROM selected_contexts WHERE id IS NOT NULL")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with ids as strings and without nulls."""
    return X.corpus(spark, d).select("doc_id", "passage", "name", "link")


@query(f"WITH {X.TRAIN} SELECT qid, pos, question, answer FROM train_rows WHERE coalesce(answer, '') <> ''")
def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Question and gold answer."""
    return X.train(spark, d).filter("coalesce(answer, '') <> ''").select("qid", "pos", "question", "answer")


@query(f"SELECT count(*) AS n_blank FROM (SELECT DISTINCT qid, question FROM public_official) WHERE {_strip('coalesce(question, {})'.format(_lit('')))} = ''")
def validate_blank_questions(spark: SparkSession, d: str) -> DataFrame:
    """Number of blank evaluation questions; a strict reader refuses a table where it isn't 0."""
    rows = table(spark, d, "public_official").select("qid", "question").distinct()
    return rows.agg(F.count_if(T.strip(T.text_of(F.col("question"))) == "").alias("n_blank"))


@query(f"WITH {X.TRAIN} SELECT qid, array_to_string({words_sql('question')}, '|') AS tokens FROM train_rows")
def tokenize_clean(spark: SparkSession, d: str) -> DataFrame:
    """Words of the questions without stopwords."""
    return X.train(spark, d).select("qid", F.array_join(T.words(F.col("question")), "|").alias("tokens"))


@query(f"WITH {X.TRAIN} SELECT qid, array_to_string({numbers_sql('question')}, '|') AS numbers FROM train_rows")
def extract_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the questions."""
    return X.train(spark, d).select("qid", F.array_join(T.numbers(F.col("question")), "|").alias("numbers"))


@query(f"WITH {X.TRAIN} SELECT qid, array_to_string(list_sort({token_set_sql('question')}), '|') AS tokens FROM train_rows")
def token_set(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens of the questions, sorted."""
    return X.train(spark, d).select("qid", F.array_join(F.array_sort(T.token_set(F.col("question"))), "|").alias("tokens"))


@query(f"SELECT DISTINCT chunk_id, {_strip(f'regexp_extract(coalesce(text, {_lit("")}), {_lit(P.CHUNK_PREFIX)}, 1)')} AS prefix, {body_sql('text')} AS body FROM parent_embeddings WHERE chunk_id IS NOT NULL")
def chunk_prefix_body(spark: SparkSession, d: str) -> DataFrame:
    """Heading and body of the chunks."""
    rows = table(spark, d, "parent_embeddings").filter("chunk_id is not null")
    return rows.select("chunk_id", T.chunk_prefix(F.col("text")).alias("prefix"), T.chunk_body(F.col("text")).alias("body")).distinct()


_PLAIN_LINE = " AND ".join([f"NOT regexp_matches(l, {_lit('(?i)' + p)})" for p in P.BOILERPLATE_ANY_CASE] + [f"NOT regexp_matches(l, {_lit(p)})" for p in P.BOILERPLATE])
_KEPT_LINES = "array_to_string(list_filter(string_split(passage, chr(10)), lambda x: " + _PLAIN_LINE.replace("(l,", f"({_strip('x')},") + "), chr(10))"


@query(f"WITH {X.CORPUS} SELECT doc_id, {_strip(f'regexp_replace({_KEPT_LINES}, {_lit(chr(10) + "{3,}")}, chr(10) || chr(10), {_lit("g")})')} AS passage FROM corpus")
def strip_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Passages without letterhead lines."""
    return X.corpus(spark, d).select("doc_id", T.strip_boilerplate(F.col("passage")).alias("passage"))


_TITLE = f"regexp_extract(passage, {_lit(P.ARTICLE_TITLE)}, 1)"


@query(
    f"""WITH {X.CORPUS}, found AS (SELECT doc_id, regexp_extract_all(passage, {_lit(P.ARTICLE)}, 1) AS a, regexp_extract_all(passage, {_lit(P.CLAUSE)}, 1) AS c, {_TITLE} AS t FROM corpus)
SELECT doc_id, array_to_string({distinct_sql('a')}, '|') AS articles, array_to_string({distinct_sql('c')}, '|') AS clauses, CASE WHEN regexp_matches(t, '^[0-9]') THEN '' ELSE {_strip('t')} END AS title FROM found"""
)
def extract_refs(spark: SparkSession, d: str) -> DataFrame:
    """Articles, clauses and the first title of the passages."""
    p = F.col("passage")
    return X.corpus(spark, d).select("doc_id", F.array_join(T.articles(p), "|").alias("articles"), F.array_join(T.clauses(p), "|").alias("clauses"), T.article_title(p).alias("title"))


@query(f"SELECT DISTINCT chunk_id, {first_article_sql('text')} AS first_article FROM parent_embeddings WHERE chunk_id IS NOT NULL")
def first_article(spark: SparkSession, d: str) -> DataFrame:
    """First article number of the chunks."""
    return table(spark, d, "parent_embeddings").filter("chunk_id is not null").select("chunk_id", T.first_article(F.col("text")).alias("first_article")).distinct()


@query()
def extract_doc_name(spark: SparkSession, d: str) -> DataFrame:
    """First legal document named in a passage (the pattern for laws looks ahead, which RE2 can't)."""
    return X.corpus(spark, d).select("doc_id", T.document_name(F.col("passage")).alias("document_name"))


_SEGMENT = "list_extract(string_split(regexp_replace(link, '/+$', ''), '/'), -1)"


@query(
    f"WITH {X.CORPUS} SELECT doc_id, {_squeeze(f'replace(regexp_replace(regexp_replace({_SEGMENT}, {_lit(chr(40) + "?i)" + chr(92) + ".(?:html?|aspx?)$")}, {_lit("")}), {_lit("-[0-9]+$")}, {_lit("")}), {_lit("-")}, {_lit(" ")})')} AS slug FROM corpus"
)
def link_slug(spark: SparkSession, d: str) -> DataFrame:
    """Words of the last segment of the links."""
    return X.corpus(spark, d).select("doc_id", T.name_from_link(F.col("link")).alias("slug"))


@query(f"WITH {X.CORPUS} SELECT doc_id, replace(regexp_replace({_SEGMENT}, '-[0-9]+\\.aspx$', ''), '-', ' ') AS title FROM corpus")
def url_slug_name(spark: SparkSession, d: str) -> DataFrame:
    """Titles from links, as used where a document has no name."""
    return X.corpus(spark, d).select("doc_id", T.title_from_link(F.col("link")).alias("title"))


@query()
def doc_code(spark: SparkSession, d: str) -> DataFrame:
    """Code of the first legal document of a passage (its word borders are those of Unicode, which RE2 lacks)."""
    return X.corpus(spark, d).select("doc_id", T.document_code(F.col("passage")).alias("code"))


@query()
def doc_metadata(spark: SparkSession, d: str) -> DataFrame:
    """How each document is cited, from name, link, heading and text of its first chunk, and passage."""
    first = table(spark, d, "parent_embeddings").filter("chunk_pos is not null").groupBy("doc_id").agg(F.min_by("text", F.struct("chunk_pos", "chunk_id")).alias("evidence"))
    rows = X.corpus(spark, d).join(first, "doc_id", "left").withColumn("prefix", T.chunk_prefix(F.col("evidence")))
    return answers.with_titles(rows, "evidence").select("doc_id", "title")


@query()
def clean_passage(spark: SparkSession, d: str) -> DataFrame:
    """Passages in one layout (joining broken lines looks around, which RE2 can't)."""
    return X.corpus(spark, d).select("doc_id", T.clean_passage(F.col("passage")).alias("passage"))


_TIDY = f"regexp_replace(regexp_replace(regexp_replace(answer, {_lit(chr(10) + '{3,}')}, chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), {_lit(chr(10) + '[ ' + chr(92) + 't]+')}, chr(10), 'g')"


@query(
    f"""WITH {X.TRAIN}, tidy AS (SELECT qid, {_TIDY} AS t FROM train_rows WHERE answer IS NOT NULL),
cut AS (SELECT qid, t, left(t, 300) AS c, strpos(reverse(left(t, 300)), '.') AS p FROM tidy)
SELECT qid, {_strip('CASE WHEN length(t) > 300 THEN CASE WHEN p > 0 AND 300 - p > 300 * 0.7 THEN left(c, 301 - p) ELSE c END ELSE t END')} AS answer FROM cut"""
)
def truncate_answer(spark: SparkSession, d: str) -> DataFrame:
    """Answers tidied and cut at 300 characters."""
    return X.train(spark, d).filter("answer is not null").select("qid", T.tidy_answer(F.col("answer"), 300).alias("answer"))


@query(f"WITH {X.TRAIN} SELECT qid, array_to_string(list_filter(regexp_split_to_array(lower(coalesce(answer, '')), '{P.ROUGE_BREAK}'), lambda w: w <> ''), '|') AS tokens FROM train_rows")
def rouge_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the answers as the metrics count them."""
    return X.train(spark, d).select("qid", F.array_join(T.rouge_tokens(F.col("answer")), "|").alias("tokens"))
