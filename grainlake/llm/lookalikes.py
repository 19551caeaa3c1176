"""Problem 2: texts that look alike but differ in their characters come out in one form.

Method: confusables skeleton. Decompose, replace every character by its prototype, decompose again; originals with equal
skeletons look the same. Only digests of the skeletons are shuffled, never the texts.

Defined results: null and blank texts keep their value and are in no pair; a null key is in no pair; a repeated row counts
once; rows with the very same characters are no pair; extra columns are ignored or, in one_form, kept.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from grainlake.llm.charforms import canonical
from grainlake.session import materialize


@arrow_udf(StringType())
def _canonical(text: pa.Array) -> pa.Array:
    return pa.array([t if t is None else canonical(t) for t in text.to_pylist()], pa.string())


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


_SIGNATURE = pa.struct([("skel", pa.binary()), ("raw", pa.binary())])


@arrow_udf(StructType([StructField("skel", BinaryType()), StructField("raw", BinaryType())]))
def _signature(text: pa.Array) -> pa.Array:
    out = []
    for t in text.to_pylist():
        form = "" if t is None else canonical(t)
        if not form.strip():
            out.append(None)
            continue
        raw = _digest(t)
        out.append({"skel": raw if form == t else _digest(form), "raw": raw})
    return pa.array(out, _SIGNATURE)


def one_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each named text column in the one form; nulls stay null."""
    return df.withColumns({c: _canonical(F.col(c)) for c in columns})


def signatures(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """tbl, key, skel, raw of each distinct row whose text is neither null nor blank."""
    rows = df.select(F.col(key).cast("string").alias("key"), _signature(F.col(text)).alias("s"))
    return rows.filter("key is not null and s is not null").select(F.lit(name).alias("tbl"), "key", "s.skel", "s.raw").dropDuplicates()


def _unlike(signs: DataFrame) -> DataFrame:
    """The members of classes with at least two different character sequences."""
    classes = signs.groupBy("tbl", "skel").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo <> hi")
    return signs.join(classes.select("tbl", "skel"), ["tbl", "skel"])


def lookalike_pairs(signs: DataFrame) -> DataFrame:
    """tbl, key_a, key_b: rows of one table that look the same but are not the same sequence of characters."""
    members = materialize(_unlike(signs), "p2-members")
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col("a.tbl") == F.col("b.tbl")) & (F.col("a.skel") == F.col("b.skel")) & (F.col("a.raw") != F.col("b.raw")) & (F.col("a.key") < F.col("b.key")))
    return pairs.select("a.tbl", F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))


def lookalike_classes(signs: DataFrame) -> DataFrame:
    """tbl, key, class_key, n_rows, n_forms: each row with the smallest key that looks the same."""
    size: Column = F.count(F.lit(1))
    classes = signs.groupBy("tbl", "skel").agg(F.min("key").alias("class_key"), size.alias("n_rows"), F.count_distinct("raw").alias("n_forms"))
    return signs.join(classes, ["tbl", "skel"]).select("tbl", "key", "class_key", "n_rows", "n_forms")
