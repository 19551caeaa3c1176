"""Splits, folds and checks of tables against each other."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainlake.session import materialize


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with row numbers from 0 by a unique column, without a single task: ranges are numbered, then shifted by the counts before."""
    rows = materialize(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "numbered")
    before, upto = [], 0
    for r in rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect():
        before += [F.lit(r["_p"]), F.lit(upto)]
        upto += r["n"]
    if not before:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return rows.withColumn(name, (within + F.create_map(*before)[F.col("_p")]).cast("bigint")).drop("_p")


def seeded_split(df: DataFrame, sizes: Sequence[tuple[str, int]], key: str = "qid", order: str = "pos", seed: int = 42) -> DataFrame:
    """df with split and split_pos: the rows in a seeded shuffle of their order, cut into parts of fixed sizes.

    The shuffle is a permutation of row numbers on the driver, 8 bytes a row, as the sequence is a fixed value; the table itself
    stays distributed. More rows than the parts hold are in no part (null); fewer are an error.
    """
    rows = numbered(df, order, "_no")
    n = df.count()
    if n < sum(s for _, s in sizes):
        raise ValueError(f"{n} rows for {sum(s for _, s in sizes)}")
    numbers = list(range(n))
    random.Random(seed).shuffle(numbers)
    place = df.sparkSession.createDataFrame([(no, at) for at, no in enumerate(numbers)], "_no int, split_pos int")
    named, upto = F.lit(None).cast("string"), 0
    cuts = []
    for name, size in sizes:
        cuts.append((name, upto, upto + size))
        upto += size
    for name, lo, hi in reversed(cuts):
        named = F.when((F.col("split_pos") >= lo) & (F.col("split_pos") < hi), F.lit(name)).otherwise(named)
    return rows.join(place, "_no").drop("_no").withColumn("split", named)


def fold(pos: Column, folds: int = 5) -> Column:
    """Fold from 1 of a row by its position."""
    return F.pmod(pos, F.lit(folds)) + 1


def holdout(df: DataFrame, which: int, pos: str = "pos", folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows of one fold."""
    own = fold(F.col(pos), folds)
    return df.filter(own != which), df.filter(own == which)


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: keys of one table that the other lacks; no row if both have the same. null is a key like any other."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def table_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """column, n: values that differ, for each common column; NaN equals NaN, null equals null; a missing row differs in all."""
    columns = [c for c in a.columns if c in b.columns and c not in keys]
    kinds = dict(a.dtypes)
    x = a.select(*keys, F.struct(*columns).alias("x"))
    y = b.select(*keys, F.struct(*columns).alias("y"))
    both = x.join(y, list(keys), "full")

    def differs(c: str) -> Column:
        same = F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        if tolerance and kinds[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) <= tolerance, F.lit(False))
        return F.col("x").isNull() | F.col("y").isNull() | ~same

    one = both.agg(*(F.count_if(differs(c)).alias(c) for c in columns))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column", "n"))


def vector_faults(df: DataFrame, vec: str = "vec", dim: int = 64) -> DataFrame:
    """fault, n: vectors that are missing, of another length, not finite or all zeros; each under its first fault."""
    v = F.col(vec)
    fault = (
        F.when(v.isNull(), "missing").when(F.size(v) != dim, "length").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(~F.exists(v, lambda x: x != 0), "zeros").otherwise("none")
    )
    return df.groupBy(fault.alias("fault")).agg(F.count(F.lit(1)).alias("n"))


def signature(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with a SHA-256 over the given columns, nulls told apart from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return df.withColumn("signature", F.sha2(F.concat_ws("\x1f", *parts), 256))


def evenly_spaced(df: DataFrame, most: int = 20, order: str = "pos") -> DataFrame:
    """At most `most` rows at evenly spaced places of the order, first and last among them."""
    n = df.count()
    k = min(most, n)
    at = sorted({round_down(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(k)})
    rows = numbered(df, order, "_at")
    return rows.filter(F.col("_at").isin(at) if at else F.lit(False)).drop("_at")


def round_down(x: float) -> int:
    return int(x + 1e-9)


def output_faults(answers: DataFrame, expected: DataFrame, key: str = "qid", answer: str = "answer", error: str = "error") -> DataFrame:
    """missing, extra, empty, failed: counts that all must be 0 before answers are given out."""
    rows = expected.select(key).distinct().withColumn("_e", F.lit(1)).join(answers.withColumn("_a", F.lit(1)), key, "full")
    blank = F.trim(F.coalesce(F.col(answer), F.lit(""))) == ""
    return rows.agg(F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("extra"), F.count_if(F.col("_a").isNotNull() & blank).alias("empty"), F.count_if(F.col(error).isNotNull()).alias("failed"))


def pending(expected: DataFrame, done: DataFrame, key: str = "qid", answer: str = "answer", error: str = "error") -> DataFrame:
    """The expected rows that have no good answer yet: never tried, failed, or empty."""
    good = done.filter(F.col(error).isNull() & (F.trim(F.coalesce(F.col(answer), F.lit(""))) != "")).select(key)
    return expected.join(good, key, "left_anti")
