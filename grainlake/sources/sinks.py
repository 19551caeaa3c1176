"""Writers: tables replaced at once, single JSON files, the submission archive, score reports and manifests.

Single files hold answers to questions or aggregates, one entry each; they are streamed through the driver row by row.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the path and rename, so that a failed write leaves the old table."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    to, staging, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"))
    df.write.parquet(staging.toString())
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(to)
    if had and not fs.rename(to, old):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(staging, to):
        if had:
            fs.rename(old, to)
        raise OSError(f"can't move the new table to {path}")
    if had:
        fs.delete(old, True)


def write_text(path: str, parts: Iterable[str]) -> None:
    """One local file, replaced at once."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.writelines(parts)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_json(path: str, value: object) -> None:
    write_text(path, [json.dumps(value, ensure_ascii=False, indent=2)])


def write_submission(df: DataFrame, path: str, key: str = "qid", answer: str = "answer") -> None:
    """{qid: {answer}} in the order of the keys; a repeated key is an error."""
    if df.count() != df.select(key).distinct().count():
        raise ValueError("a question has several answers")

    def parts() -> Iterable[str]:
        yield "{"
        for i, r in enumerate(df.select(key, answer).orderBy(key).toLocalIterator()):
            yield ("," if i else "") + f"\n  {json.dumps(str(r[0]), ensure_ascii=False)}: {{\n    \"answer\": {json.dumps(r[1] or '', ensure_ascii=False)}\n  }}"
        yield "\n}"

    write_text(path, parts())


def zip_submission(path: str, archive: str) -> None:
    """An archive that holds the file as submission.json and nothing else."""
    temporary = f"{archive}.{uuid.uuid4().hex}"
    with zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED) as out:
        out.write(path, "submission.json")
    with zipfile.ZipFile(temporary) as back:
        if back.namelist() != ["submission.json"] or back.testzip():
            raise OSError("the archive is damaged")
    os.replace(temporary, archive)


def artifact_names(split: str, smoke: bool) -> dict[str, str]:
    """Names of the files of one run, by split and by whether it is a trial."""
    if split not in ("public", "private"):
        raise ValueError(split)
    stem = f"{split}_smoke" if smoke else split
    return {"submission": f"{stem}_submission.json", "archive": f"{stem}_submission.zip", "log": f"{stem}_log.json"}


def write_aggregates(df: DataFrame, path: str) -> None:
    """score_type,low,mid,high with six places; df: score_type, low, mid, high."""
    rows = df.select("score_type", "low", "mid", "high").orderBy("score_type").toLocalIterator()
    write_text(path, ["score_type,low,mid,high\n", *(f"{t},{lo:f},{mid:f},{hi:f}\n" for t, lo, mid, hi in rows)])


def write_scores(scores: dict[str, DataFrame], path: str, key: str = "qid") -> None:
    """One folder of CSV with key and <type>-P, <type>-R, <type>-F of each type, written by all tasks."""
    out = None
    for kind, df in scores.items():
        part = df.select(key, *(F.format_string("%f", c).alias(f"{kind}-{n}") for c, n in (("precision", "P"), ("recall", "R"), ("fmeasure", "F"))))
        out = part if out is None else out.join(part, key)
    if out is None:
        raise ValueError("no scores")
    out.withColumnRenamed(key, "id").write.option("header", True).csv(path)


def write_score_json(scores: DataFrame, path: str) -> None:
    """{rouge, meteor} of a one-row frame."""
    write_json(path, {c: float(v or 0) for c, v in scores.first().asDict().items()})


def write_groups(df: DataFrame, path: str, lines: int = 4, order: str = "pos", value: str = "value") -> None:
    """Texts in files of `lines` lines each, one folder per group; df is numbered from 0 by `order`."""
    rows = df.select(F.floor(F.col(order) / lines).alias("part"), F.struct(order, value).alias("x")).groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x[value]), "\n").alias("value"))
    rows.write.partitionBy("part").text(path)


def manifest(spark: SparkSession, folder: str) -> list[dict[str, object]]:
    """name, size and SHA-256 of each file of a folder, read by the executors, by name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return [r.asDict() for r in rows.orderBy("name").toLocalIterator()]


def check_manifest(spark: SparkSession, folder: str, wanted: list[dict[str, object]]) -> None:
    """An error if a file of the manifest is missing, has another size or other content."""
    have = {f["name"]: f for f in manifest(spark, folder)}
    for f in wanted:
        if have.get(f["name"]) != f:
            raise ValueError(f"{f['name']} is missing or differs")


def content_digest(value: object) -> str:
    """SHA-256 of a value as canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
