"""Readers of the file formats that corpora, questions, stopwords and scored texts come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainlake.functions import text as T

DOCUMENT = "id string, name string, link string, passage string"
_QA = "map<string,struct<question:string,answer:string>>"


def exists(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file or folder, None if there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else None


def first_existing(spark: SparkSession, folder: str, names: list[str]) -> str:
    """The first of several files that is there and not empty."""
    for name in names:
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")


def context_folder(spark: SparkSession, folder: str, name: str = "selected-contexts") -> str:
    """The folder of the documents, which may lie one level deeper under the same name."""
    for path in (f"{folder}/{name}/{name}", f"{folder}/{name}"):
        if exists(spark, path) is not None:
            return path
    raise FileNotFoundError(f"no {name} in {folder}")


def read_corpus(spark: SparkSession, folder: str, names_from_links: bool = False) -> DataFrame:
    """doc_id, passage, name, link of all JSON files under a folder.

    A document without id takes its file's name without context_; of several with one id the last path wins; nulls are ''.
    names_from_links: a document without name takes it from its link.
    """
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", ""), "^context_", "")
    name = T.text_of(F.col("name"))
    if names_from_links:
        name = F.when(name != "", name).otherwise(T.title_from_link(F.col("link")))
    rows = rows.select(F.coalesce("id", stem).alias("doc_id"), T.text_of(F.col("passage")).alias("passage"), name.alias("name"), T.text_of(F.col("link")).alias("link"), "path")
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("path")))
    return rows.withColumn("_n", last).filter("_n = 1").drop("_n", "path")


def read_questions(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """pos, qid, question, answer of one JSON object of questions by id, in the order of the file.

    strict: a blank question is an error, as it is for evaluations. The file is one object, hence one task.
    """
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.map_entries(F.from_json("value", _QA))).alias("pos", "e"))
    rows = rows.select("pos", F.col("e.key").alias("qid"), F.col("e.value.question").alias("question"), F.col("e.value.answer").alias("answer"))
    if strict and (n := rows.filter(T.strip(T.text_of(F.col("question"))) == "").count()):
        raise ValueError(f"{n} blank questions in {path}")
    return rows


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """value: one word a line, blanks within as underscores, blank lines left out."""
    word = T.strip(F.col("value"))
    return spark.read.text(path).select(F.replace(word, F.lit(" "), F.lit("_")).alias("value")).filter("value <> ''").distinct()


def read_records(spark: SparkSession, paths: str | list[str], delimiter: str = "\n") -> DataFrame:
    """file, pos, value of texts separated by a delimiter; what follows the last delimiter is a record unless it is empty."""
    rows = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_name").alias("file"), F.split_part("value", F.lit(delimiter), F.lit(-1)).alias("tail"), F.split("value", r"\Q" + delimiter + r"\E", -1).alias("parts"))
    kept = F.when(F.col("tail") == "", F.slice("parts", F.lit(1), F.size("parts") - 1)).otherwise(F.col("parts"))
    return rows.select("file", F.posexplode(kept).alias("pos", "value"))


def paired_records(spark: SparkSession, targets: str, predictions: str, delimiter: str = "\n") -> DataFrame:
    """pos, target, prediction of two sets of files; as many files and as many records are required."""
    a, b = read_records(spark, targets, delimiter), read_records(spark, predictions, delimiter)
    if (n := a.select("file").distinct().count()) != (m := b.select("file").distinct().count()) or not n:
        raise ValueError(f"{n} target files, {m} prediction files")
    order = Window.orderBy("file")
    no = lambda df, c: df.join(df.select("file").distinct().withColumn("no", F.row_number().over(order)), "file").select("no", "pos", F.col("value").alias(c))
    rows = no(a, "target").join(no(b, "prediction"), ["no", "pos"], "full")
    if not rows.filter("target is null or prediction is null").isEmpty():
        raise ValueError("targets and predictions differ in number")
    return rows.select(F.struct("no", "pos").alias("pos"), "target", "prediction")
