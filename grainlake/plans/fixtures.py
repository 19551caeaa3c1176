"""The tables of one data directory in the roles that the operators expect, each row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainlake.session import materialize
from grainlake.sources.tables import table

USABLE = "size(vec) = 64 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)"
_BROADCAST = 500_000  # rows of keys that may be sent to all executors


def documents(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """doc_id, name, link, passage of every document, as often as it is given; nulls are ''. more: further columns."""
    rows = table(spark, d, "selected_contexts").filter("id is not null")
    return rows.select(F.col("id").cast("string").alias("doc_id"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "link", "passage")), *more)


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, name, link, passage of every document; nulls are ''."""
    return documents(spark, d).distinct()


def keys(rows: DataFrame) -> DataFrame:
    """Materialized keys to join with, broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= _BROADCAST else rows


def corpus_unmoved(spark: SparkSession, d: str) -> DataFrame:
    """The rows of corpus(); repeated rows are left out where they are read, so that only digests are shuffled."""
    rows = documents(spark, d, "_metadata.file_path", "_metadata.row_index")
    whole = F.concat_ws(" ", F.length("name"), F.length("link"), "name", "link", "passage")
    seen = rows.select("doc_id", F.unhex(F.md5(whole)).alias("digest"), "file_path", "row_index")
    place = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("file_path", "row_index"))
    repeated = materialize(seen.withColumn("k", place).filter("k > 1").select("file_path", "row_index"), "repeated")
    return rows.join(keys(repeated), ["file_path", "row_index"], "left_anti").drop("file_path", "row_index")


def named_documents(spark: SparkSession, d: str, named: DataFrame) -> DataFrame:
    """The rows of corpus() whose doc_id stands in `named`."""
    wanted = materialize(named.select("doc_id").distinct(), "named")
    return documents(spark, d).join(keys(wanted), "doc_id", "left_semi").distinct()


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, doc_id, kind, chunk_pos, text, vec of every usable chunk."""
    rows = table(spark, d, "parent_embeddings").filter("chunk_id is not null").select("chunk_id", "doc_id", "kind", "chunk_pos", "text", "vec").dropDuplicates(["chunk_id"])
    return rows.filter(USABLE)


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """The columns of chunks() as often as a chunk is given, and pick, a digest of the row."""
    rows = table(spark, d, "parent_embeddings").filter("chunk_id is not null").select("chunk_id", "doc_id", "kind", "chunk_pos", "text", "vec")
    return rows.filter(USABLE).withColumn("pick", F.xxhash64("doc_id", "kind", "chunk_pos", "text", "vec"))


def chunk_parts(rows: DataFrame, *columns: str) -> DataFrame:
    """chunk_id and these columns of chunk_rows(), each chunk once; of rows that differ always the same one, so that its parts can be read apart."""
    return rows.groupBy("chunk_id").agg(F.min_by(F.struct(*columns), "pick").alias("x")).select("chunk_id", *(f"x.{c}" for c in columns))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """qid, question of the evaluation, blank ones left out."""
    return table(spark, d, "public_official").filter("qid is not null and trim(question) <> ''").select("qid", "question").distinct()


def train(spark: SparkSession, d: str) -> DataFrame:
    """pos, qid, question, answer of the training questions."""
    return table(spark, d, "train").filter("qid is not null").select("pos", "qid", "question", "answer").distinct()


CORPUS = "corpus AS (SELECT DISTINCT CAST(id AS VARCHAR) AS doc_id, coalesce(name, '') AS name, coalesce(link, '') AS link, coalesce(passage, '') AS passage FROM selected_contexts WHERE id IS NOT NULL)"
CHUNKS = "chunks AS (SELECT DISTINCT chunk_id, doc_id, kind, chunk_pos, text, vec FROM parent_embeddings WHERE chunk_id IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0)"
QUESTIONS = "questions AS (SELECT DISTINCT qid, question FROM public_official WHERE qid IS NOT NULL AND trim(question) <> '')"
TRAIN = "train_rows AS (SELECT DISTINCT pos, qid, question, answer FROM train WHERE qid IS NOT NULL)"
