"""Problem 5: documents delivered as very many tiny files come out in few files of good size, each once.

Method: adaptive REBALANCE. The rows of the latest complete states are shuffled under a rebalance hint; runtime statistics
merge or split the output partitions near the target size. The files are written to a staging folder and renamed to their
place only if the multiset checksum (count and sum of row hashes) of what was read back equals that of what went in.

Defined results: null, empty and damaged contents give no document; in a file with a damaged line the other lines count; of
several states the latest modified_at wins (null the earliest), then the smallest file_id, then the first in the file; an
object without id takes the number in the file name context_<id>.json, and without that is left out; a passage must be a
string and may be empty; repeated files count once; an empty delivery commits an empty table.
"""

from __future__ import annotations

import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from grainlake.session import materialize, scratch_dir

TARGET_BYTES = 128 << 20
_NAMED = re.compile(r"(?:^|[/\\])context_(\d+)\.json$")
_DOCS = pa.list_(pa.struct([("id", pa.int64()), ("name", pa.string()), ("link", pa.string()), ("passage", pa.string())]))


def _whole(value: object) -> int | None:
    """An id given as a whole number or as its digits."""
    if isinstance(value, str) and re.fullmatch(r"\s*[+-]?[0-9]{1,19}\s*", value):
        value = int(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 63 else None


def _objects(content: str) -> list[object]:
    """The JSON values of a file: one value (an array counts as its members), else each line that is readable by itself."""
    content = content.lstrip("﻿")
    try:
        value = json.loads(content)
        return value if isinstance(value, list) else [value]
    except (ValueError, RecursionError):
        pass
    found: list[object] = []
    for line in content.split("\n"):
        try:
            value = json.loads(line.lstrip("﻿"))
        except (ValueError, RecursionError):
            continue
        found += value if isinstance(value, list) else [value]
    return found


def parse_file(content: str | None, path: str | None) -> list[dict]:
    """The complete documents of one file, in their order."""
    named = _NAMED.search(path or "")
    docs = []
    for value in _objects(content) if content and content.strip() else []:
        if not isinstance(value, dict) or not isinstance(value.get("passage"), str):
            continue
        key = _whole(value["id"]) if value.get("id") is not None else _whole(named[1]) if named else None
        if key is not None:
            texts = {k: value[k] if isinstance(value.get(k), str) else None for k in ("name", "link", "passage")}
            docs.append({"id": key} | {k: v if v is None else v.encode("utf-8", "replace").decode() for k, v in texts.items()})
    return docs


@arrow_udf(ArrayType(StructType([StructField("id", LongType()), *(StructField(c, StringType()) for c in ("name", "link", "passage"))])))
def _parsed(content: pa.Array, path: pa.Array) -> pa.Array:
    return pa.array([parse_file(c, p) for c, p in zip(content.to_pylist(), path.to_pylist(), strict=True)], _DOCS)


def latest_documents(files: DataFrame) -> DataFrame:
    """id, file_id, name, link, passage: each document in its latest complete state. One shuffle, reduced before it."""
    rows = files.select("file_id", "modified_at", F.posexplode(_parsed("raw_json", "file_path")).alias("at", "d"))
    rank = F.struct("modified_at", (-F.col("file_id")).alias("f"), (-F.col("at")).alias("a"), "file_id", "d.name", "d.link", "d.passage")
    best = rows.groupBy(F.col("d.id").alias("id")).agg(F.max(rank).alias("best"))
    return best.select("id", "best.file_id", "best.name", "best.link", "best.passage")


def _checksum(df: DataFrame) -> list[Column]:
    row = F.xxhash64(*df.columns)
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total")]


def compact(df: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Write df to path in files near target_bytes and commit after the checksum comparison; returns the committed table."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(f"{path} exists already; nothing written")
    if spark.conf.get("spark.sql.adaptive.enabled") != "true":
        raise RuntimeError("the rebalance hint needs spark.sql.adaptive.enabled")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    held = materialize(df, "p5-in")  # what goes in is made once, so that both checksums are of the same rows
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(size, None)
    spark.conf.set(size, str(target_bytes))
    try:
        held.hint("rebalance").write.parquet(staging)
    finally:
        spark.conf.unset(size) if was is None else spark.conf.set(size, was)
    back = spark.read.schema(df.schema).parquet(staging)
    if back.agg(*_checksum(back)).first() != held.agg(*_checksum(held)).first():
        raise RuntimeError(f"checksum differs, nothing committed; staged files are in {staging}")
    if fs.exists(target) or not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise RuntimeError(f"could not commit {path}; staged files are in {staging}")
    return spark.read.schema(df.schema).parquet(path)


def compact_delivery(files: DataFrame, path: str | None = None, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The documents of a delivery of tiny files (file_id, file_path, modified_at, raw_json), consolidated under path."""
    path = path or f"{scratch_dir(files.sparkSession)}/grainlake/p5-contexts-{uuid.uuid4().hex}"
    return compact(latest_documents(files), path, target_bytes)
