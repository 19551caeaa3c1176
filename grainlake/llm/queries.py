"""The training-data queries: name to (spark, sf_dir) -> DataFrame, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainlake.llm import grouped_split, leakage, lookalikes, neighbours, question_pairs, residues, site_lines, splitting, tokenizing
from grainlake.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Items longer than 1,200 characters."""
    return splitting.oversized_items(table(spark, d, "selected_contexts"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Their pieces."""
    return splitting.split_oversized(table(spark, d, "selected_contexts"))


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    contexts = lookalikes.signatures(table(spark, d, "selected_contexts"), "id", "passage", "selected_contexts")
    return contexts.unionByName(lookalikes.signatures(table(spark, d, "train"), "qid", "question", "train"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows that look the same but differ in characters."""
    return lookalikes.lookalike_pairs(_signatures(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each row with the class of rows that look the same."""
    return lookalikes.lookalike_classes(_signatures(spark, d))


def p2_one_form(spark: SparkSession, d: str) -> DataFrame:
    """tbl, key, text: passages of selected_contexts and questions of train in one form."""
    parts = (("selected_contexts", "id", "passage"), ("train", "qid", "question"))
    rows = [table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(k).cast("string").alias("key"), F.col(x).alias("text")).dropDuplicates() for t, k, x in parts]
    return lookalikes.one_form(rows[0].unionByName(rows[1]), ["text"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Questions that belong together."""
    return grouped_split.group_members(table(spark, d, "train"))


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    """Each question with its split."""
    return grouped_split.stratified_split(table(spark, d, "train"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks at least one of which is among the other's five most similar."""
    return neighbours.neighbour_pairs(table(spark, d, "parent_embeddings"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines repeated excessively within their site."""
    return site_lines.repeated_lines(table(spark, d, "selected_contexts"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Passages without those lines."""
    return site_lines.without_repeated_lines(table(spark, d, "selected_contexts"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Repeated lines when names are masked as well, with their passages."""
    return site_lines.repeated_classes(table(spark, d, "selected_contexts"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Questions of train and of the public evaluation that are the same."""
    return question_pairs.same_questions(table(spark, d, "train"), table(spark, d, "public_official"))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same as counts by eval_split and site."""
    return question_pairs.pair_counts(p7_found(spark, d), table(spark, d, "public_official"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizing.encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items that leaked into them."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "private_official"))


def p9_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The same with the longest stretch as offsets into the original text."""
    return leakage.leaked_stretches(table(spark, d, "documents"), table(spark, d, "private_official"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with left-over template marks, filler, an error page or a notice in place of content."""
    return residues.residue_documents(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_classes, p2_one_form, p3_found, p3_split, p4_found, p6_found, p6_clean, p6_classes, p7_found, p7_counts, p8_ids, p9_found, p9_stretches, p10_found)
}

#: No SQL: the texts need Unicode forms, regular expressions over folded text, or searches that SQL is too slow for. Tests in tests/llm.
SQL: dict[str, str] = {}
