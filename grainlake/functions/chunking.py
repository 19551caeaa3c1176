"""Chunkers: passages to parent chunks (articles, paragraphs, windows) and to child chunks (clauses). All in the JVM.

Boundaries are marked with a private-use character and split there, so that matches don't overlap.

Defined results: null and blank passages have no chunks; a null name adds nothing to the heading of a chunk; rows with the same
key are chunked each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainlake.functions import patterns as P
from grainlake.functions.text import clean_passage, squeeze, strip, text_of

MAX_CHARS, SHARED = 5117, 200
_MARK = "\ue001"

# The beginnings of articles and clauses.
ARTICLE_AT = P.spaced(r"(?=Điều~+[0-9]+[a-zA-Z]?~*(?:\([^)]*\))?~*[.:])")
ARTICLE_HEAD = rf"^{P.SPACE}*(Điều{P.SPACE}+[0-9]+[a-zA-Z]?{P.SPACE}*(?:\([^)]*\))?{P.SPACE}*[.:]{P.SPACE}*[^\n]{{0,120}})"
CLAUSE_AT = P.spaced(r"(?:\A|\n)~*[0-9]{1,2}\.~+")
PART_AT = P.spaced(r"(?=(?:\A|\n)~*[0-9]+[.)]~)")
SCOPE = P.spaced(r"(?iu)^~*Điều~+[0-9]+[a-zA-Z]?~*[.:]~*(Phạm~+vi~+điều~+chỉnh|Đối~+tượng~+áp~+dụng)")


def _cut(c: Column, at: str) -> Column:
    return F.split(F.regexp_replace(c, at, _MARK + "$0"), _MARK, -1)


def _not_blank(parts: Column) -> Column:
    return F.filter(parts, lambda p: strip(p) != "")


def article_head(c: Column) -> Column:
    return squeeze(F.regexp_extract(c, ARTICLE_HEAD, 1))


def windows(c: Column, size: int, shared: int = SHARED) -> Column:
    """Pieces of `size` characters, each beginning `size - shared` after the one before; the last ones may be short."""
    step = max(size - shared, 1)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(c) - 1), F.lit(step))
    return F.when(F.length(c) > 0, F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def by_clause(c: Column, size: int) -> Column:
    """Clauses of a text, the whole text where it has one at most; what is longer than `size` in windows."""
    parts = _not_blank(_cut(c, PART_AT))
    parts = F.when(F.size(parts) <= 1, F.array(c)).otherwise(parts)
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(windows(p, size))))


def parent_chunks(df: DataFrame, size: int = MAX_CHARS) -> DataFrame:
    """doc_id, chunk_pos, text of (doc_id, name, passage): articles, else paragraphs, else clauses; scope articles left out."""
    rows = df.select("doc_id", text_of(F.col("name")).alias("name"), clean_passage(F.col("passage")).alias("p")).filter("p <> ''")
    rows = rows.withColumns({"articles": _not_blank(_cut(F.col("p"), ARTICLE_AT)), "paragraphs": _not_blank(F.split("p", "\n\n", -1))})
    parts = F.when(F.size("articles") > 1, F.col("articles")).when(F.size("paragraphs") > 1, F.col("paragraphs")).otherwise(by_clause(F.col("p"), size))
    rows = rows.select("doc_id", "name", F.posexplode(F.filter(F.transform(parts, strip), lambda x: (x != "") & ~x.rlike(SCOPE))).alias("part_no", "part"))
    pieces = F.when(F.length("part") <= size, F.array("part")).otherwise(by_clause(F.col("part"), size))
    rows = rows.select("doc_id", "name", "part_no", article_head(F.col("part")).alias("title"), F.posexplode(pieces).alias("piece_no", "piece"))
    # the position counts blank pieces too; a document's pieces stay together, so the window is over one document
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("part_no", "piece_no")) - 1
    rows = rows.withColumn("chunk_pos", at).withColumn("piece", strip(F.col("piece"))).filter("piece <> ''")
    head = F.concat_ws(". ", F.nullif("name", F.lit("")), F.when((F.col("title") != "") & ~F.startswith(F.col("piece"), F.col("title")), F.col("title")))
    return rows.select("doc_id", "chunk_pos", F.when(head != "", F.concat(head, F.lit(".\n"), F.col("piece"))).otherwise(F.col("piece")).alias("text"))


def child_chunks(df: DataFrame) -> DataFrame:
    """doc_id, article_no, article, clause, text, raw_clause_text of (doc_id, name, passage).

    Works on the passage as it is. What stands before the first article, or before an article's first clause, is left out, and so
    are articles with fewer than two clauses.
    """
    rows = df.select("doc_id", text_of(F.col("name")).alias("name"), F.posexplode(F.slice(_cut(text_of(F.col("passage")), ARTICLE_AT), 2, 1 << 30)).alias("article_no", "part"))
    rows = rows.withColumn("part", strip(F.col("part"))).withColumn("clauses", F.slice(_cut(F.col("part"), CLAUSE_AT), 2, 1 << 30)).filter("size(clauses) >= 2")
    rows = rows.select("doc_id", "name", "article_no", F.regexp_extract("part", rf"^Điều{P.SPACE}+([0-9]+[a-zA-Z]?)", 1).alias("article"), article_head(F.col("part")).alias("title"), F.posexplode("clauses").alias("clause_no", "piece"))
    rows = rows.withColumns({"clause": F.regexp_extract("piece", rf"^{P.SPACE}*([0-9]{{1,2}})\.", 1), "raw_clause_text": strip(F.col("piece"))})
    head = F.concat_ws(". ", F.nullif("name", F.lit("")), F.nullif("title", F.lit("")), F.concat(F.lit("Khoản "), "clause"))
    return rows.select("doc_id", "article_no", "clause_no", "article", "clause", F.concat(head, F.lit(".\n"), "raw_clause_text").alias("text"), "raw_clause_text")
