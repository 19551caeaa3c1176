"""The queries of the core: name to (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainlake.operators import compaction
from grainlake.plans import action_queries, answer_queries, check_queries, model_queries, ranking_queries, retrieval_queries, text_queries  # noqa: F401
from grainlake.plans.registry import QUERIES, SQL, query
from grainlake.sources.tables import table

__all__ = ["QUERIES", "SQL"]


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document of the delivery with the file it is taken from, read back from the committed files."""
    return compaction.compact_delivery(table(spark, d, "context_files")).select("id", "file_id")


@query()
def p5_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The consolidated documents."""
    return compaction.compact_delivery(table(spark, d, "context_files"))
