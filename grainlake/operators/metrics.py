"""Scores of texts against references: ROUGE-N as joins, ROUGE-L, ROUGE-Lsum and METEOR as Arrow functions, bootstrap intervals.

Defined results: null texts count as ''; where prediction or reference has no token every score is 0; of several references the
one of the best F counts, the first of equal ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from grainlake.functions.text import rouge_tokens

_SCORE = StructType([StructField(c, DoubleType()) for c in ("precision", "recall", "fmeasure")])
_SCORE_ARROW = pa.struct([(c, pa.float64()) for c in ("precision", "recall", "fmeasure")])
_BREAK = re.compile("[^a-z0-9]+")
_KIND = re.compile(r"rouge([1-9]|L|Lsum)")


def fmeasure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - n + 1))
    return F.when(F.size(tokens) >= n, F.transform(places, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def rouge_n(df: DataFrame, n: int, key: str = "qid", target: str = "target", prediction: str = "prediction") -> DataFrame:
    """key, precision, recall, fmeasure over the bags of n-grams. Grams are counted before they are shuffled."""
    if not 1 <= n <= 9:
        raise ValueError("n must be between 1 and 9")
    rows = df.select(key, ngrams(rouge_tokens(F.col(target)), n).alias("t"), ngrams(rouge_tokens(F.col(prediction)), n).alias("p"))
    marked = F.concat(F.transform("t", lambda g: F.struct(g.alias("g"), F.lit(1).alias("t"), F.lit(0).alias("p"))), F.transform("p", lambda g: F.struct(g.alias("g"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    grams = rows.select(key, F.explode_outer(marked).alias("x")).groupBy(key, F.col("x.g").alias("g")).agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"))
    sums = grams.groupBy(key).agg(F.sum(F.least("t", "p")).alias("both"), F.sum("t").alias("t"), F.sum("p").alias("p")).fillna(0)
    sums = sums.select(key, (F.col("both") / F.greatest(F.lit(1), "p")).alias("precision"), (F.col("both") / F.greatest(F.lit(1), "t")).alias("recall"))
    return sums.withColumn("fmeasure", fmeasure(F.col("precision"), F.col("recall")))


def tokens(text: str | None) -> list[str]:
    return [w for w in _BREAK.split((text or "").lower()) if w]


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = 0
    for w in b:
        x = row | places.get(w, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def lcs_places(ref: list[str], can: list[str]) -> set[int]:
    """Places in ref of one longest common subsequence; where two ways are as long, the one that leaves ref's last words out."""
    m, n = len(ref), len(can)
    codes = {w: k for k, w in enumerate(dict.fromkeys(ref))}
    other = np.array([codes.get(w, -1) for w in can], np.int64)
    table = np.zeros((m + 1, n + 1), np.int32)
    for i, w in enumerate(ref):
        step = np.maximum(table[i, 1:], np.where(other == codes[w], table[i, :-1] + 1, 0))
        table[i + 1, 1:] = np.maximum.accumulate(step)
    found: set[int] = set()
    i, j = m, n
    while i and j:
        if ref[i - 1] == can[j - 1]:
            i, j = i - 1, j - 1
            found.add(i)
        elif table[i, j - 1] > table[i - 1, j]:
            j -= 1
        else:
            i -= 1
    return found


def _score(hits: float, n_pred: int, n_ref: int) -> dict[str, float]:
    if not n_pred or not n_ref:
        return {"precision": 0.0, "recall": 0.0, "fmeasure": 0.0}
    p, r = hits / n_pred, hits / n_ref
    return {"precision": p, "recall": r, "fmeasure": 2 * p * r / (p + r) if p + r else 0.0}


def rouge_l(target: str | None, prediction: str | None) -> dict[str, float]:
    a, b = tokens(target), tokens(prediction)
    return _score(lcs_length(a, b) if a and b else 0, len(b), len(a))


def rouge_lsum(target: str | None, prediction: str | None) -> dict[str, float]:
    """Sentences are lines; a reference sentence's hits are the union of its subsequences with all sentences, each token once."""
    refs, cans = ([t for line in (x or "").split("\n") if (t := tokens(line))] for x in (target, prediction))
    free_ref, free_can = Counter(w for s in refs for w in s), Counter(w for s in cans for w in s)
    hits = 0
    for ref in refs:
        for i in sorted(set().union(*(lcs_places(ref, can) for can in cans))):
            if free_ref[ref[i]] > 0 and free_can[ref[i]] > 0:
                hits += 1
                free_ref[ref[i]] -= 1
                free_can[ref[i]] -= 1
    return _score(hits, sum(map(len, cans)), sum(map(len, refs)))


def meteor(target: str | None, prediction: str | None, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """METEOR over equal words between blanks (no stems, no synonyms): weighted mean of precision and recall, less a fragmentation penalty."""
    ref, hyp = (target or "").split(), (prediction or "").split()
    places: dict[str, list[int]] = {}
    for j, w in enumerate(ref):
        places.setdefault(w, []).append(j)
    matched = sorted((i, places[hyp[i]].pop()) for i in range(len(hyp) - 1, -1, -1) if places.get(hyp[i]))
    m = len(matched)
    if not m:
        return 0.0
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(matched, matched[1:]))  # noqa: B905
    p, r = m / len(hyp), m / len(ref)
    return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * (chunks / m) ** beta)


@arrow_udf(_SCORE)
def _rouge_l(target: pa.Array, prediction: pa.Array) -> pa.Array:
    return pa.array([rouge_l(a, b) for a, b in zip(target.to_pylist(), prediction.to_pylist(), strict=True)], _SCORE_ARROW)


@arrow_udf(_SCORE)
def _rouge_lsum(target: pa.Array, prediction: pa.Array) -> pa.Array:
    return pa.array([rouge_lsum(a, b) for a, b in zip(target.to_pylist(), prediction.to_pylist(), strict=True)], _SCORE_ARROW)


@arrow_udf(DoubleType())
def _meteor(target: pa.Array, prediction: pa.Array) -> pa.Array:
    return pa.array([meteor(a, b) for a, b in zip(target.to_pylist(), prediction.to_pylist(), strict=True)], pa.float64())


def rouge(df: DataFrame, kind: str, key: str = "qid", target: str = "target", prediction: str = "prediction") -> DataFrame:
    """key, precision, recall, fmeasure of rouge1 to rouge9, rougeL or rougeLsum; another kind is an error."""
    if not (found := _KIND.fullmatch(kind)):
        raise ValueError(f"no such score: {kind}")
    if found[1].isdigit():
        return rouge_n(df, int(found[1]), key, target, prediction)
    score = (_rouge_l if kind == "rougeL" else _rouge_lsum)(F.col(target), F.col(prediction))
    return df.select(key, score.alias("s")).select(key, "s.*")


def rouge_multi(df: DataFrame, kind: str, key: str = "qid", ref: str = "ref_no", target: str = "target", prediction: str = "prediction") -> DataFrame:
    """key, ref, precision, recall, fmeasure: the reference (numbered by `ref`) of the best F."""
    named = df.withColumn("_k", F.struct(key, ref))
    scores = rouge(named, kind, "_k", target, prediction)
    best = F.max_by(F.struct(F.col(f"_k.{ref}").alias(ref), "precision", "recall", "fmeasure"), F.struct(F.round("fmeasure", 12), (-F.col(f"_k.{ref}")).alias("o")))
    return scores.groupBy(F.col(f"_k.{key}").alias(key)).agg(best.alias("s")).select(key, "s.*")


def meteor_scores(df: DataFrame, key: str = "qid", target: str = "target", prediction: str = "prediction") -> DataFrame:
    return df.select(key, _meteor(F.col(target), F.col(prediction)).alias("meteor"))


def official(predictions: DataFrame, truth: DataFrame, key: str = "qid") -> DataFrame:
    """rouge, meteor: means over the predicted keys; as many predictions as references are required."""
    n, m = predictions.count(), truth.count()
    if n != m:
        raise ValueError(f"{n} predictions, {m} references")
    rows = predictions.join(truth, key)
    score = _rouge_l(F.col("target"), F.col("prediction"))
    return rows.select(score.alias("s"), _meteor(F.col("target"), F.col("prediction")).alias("m")).agg(F.avg("s.fmeasure").alias("rouge"), F.avg("m").alias("meteor"))


def bootstrap(df: DataFrame, key: str, values: list[str], samples: int = 1000, confidence: float = 0.95, seed: int = 123) -> DataFrame:
    """measure, low, mid, high: percentiles of the means of resampled rows.

    Each row enters each sample as often as a Poisson draw of mean 1 says, seeded by its key, so that the result doesn't depend on
    partitions; only sums for each sample are shuffled.
    """
    if not 0 <= confidence <= 1 or samples <= 0:
        raise ValueError("confidence must be within 0 and 1, samples positive")

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(samples), np.zeros((len(values), samples))
        for batch in batches:
            data = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]]
            for i, own in enumerate(batch.column(0).to_pylist()):
                w = np.random.default_rng([seed, own & 0xFFFFFFFFFFFFFFFF]).poisson(1.0, samples)
                n += w
                for v, x in enumerate(data):
                    total[v] += w * x[i]
        for v, name in enumerate(values):
            yield pa.RecordBatch.from_arrays([pa.array([name] * samples), pa.array(np.arange(samples, dtype=np.int32)), pa.array(n), pa.array(total[v])], names=["measure", "sample", "n", "total"])

    rows = df.select(F.xxhash64(key), *(F.col(v).cast("double") for v in values)).dropna()
    parts = rows.mapInArrow(resample, "measure string, sample int, n double, total double")
    means = parts.groupBy("measure", "sample").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0.0))).alias("mean"))
    edge = (1 - confidence) / 2
    got = means.groupBy("measure").agg(F.percentile("mean", F.array(F.lit(edge), F.lit(0.5), F.lit(1 - edge))).alias("q"))
    return got.select("measure", F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"))
