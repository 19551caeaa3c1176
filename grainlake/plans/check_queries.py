"""Queries of metrics, splits and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainlake.operators import metrics as M
from grainlake.operators import validation as V
from grainlake.plans import fixtures as X
from grainlake.plans.registry import query
from grainlake.sources.tables import table


def scored(spark: SparkSession, d: str) -> DataFrame:
    """qid, target, prediction: the question is held against its answer."""
    return X.train(spark, d).select("qid", F.col("answer").alias("target"), F.col("question").alias("prediction"))


_TOKENS = f"{X.TRAIN}, t AS (SELECT qid, list_filter(regexp_split_to_array(lower(coalesce(answer, '')), '[^a-z0-9]+'), lambda w: w <> '') AS a, list_filter(regexp_split_to_array(lower(coalesce(question, '')), '[^a-z0-9]+'), lambda w: w <> '') AS b FROM train_rows)"


def _rouge_sql(n: int) -> str:
    grams = lambda c: c if n == 1 else f"CASE WHEN len({c}) < {n} THEN [] ELSE list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i:i + {n - 1}], ' ')) END"
    return f"""WITH {_TOKENS}, g AS (SELECT qid, g, sum(x) AS x, sum(y) AS y FROM (SELECT qid, unnest({grams('a')}) AS g, 1 AS x, 0 AS y FROM t UNION ALL SELECT qid, unnest({grams('b')}), 0, 1 FROM t) GROUP BY ALL),
s AS (SELECT t.qid, coalesce(sum(least(x, y)), 0) AS hit, coalesce(sum(x), 0) AS x, coalesce(sum(y), 0) AS y FROM t LEFT JOIN g USING (qid) GROUP BY t.qid), pr AS (SELECT qid, hit / greatest(1, y) AS p, hit / greatest(1, x) AS r FROM s)
SELECT qid, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS fmeasure FROM pr"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("precision", "recall", "fmeasure")})


@query(_rouge_sql(1))
def rouge1(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-1."""
    return _rounded(M.rouge(scored(spark, d), "rouge1"))


@query(_rouge_sql(2))
def rouge2(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-2."""
    return _rounded(M.rouge(scored(spark, d), "rouge2"))


@query()
def rougeL(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-L."""
    return _rounded(M.rouge(scored(spark, d), "rougeL"))


@query()
def rougeLsum(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-Lsum."""
    return _rounded(M.rouge(scored(spark, d), "rougeLsum"))


@query()
def rouge_multi_ref(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-1 of the test questions against themselves and their reference answers, the better one."""
    rows = table(spark, d, "private_official").select("qid", F.col("question").alias("prediction"), F.posexplode(F.array("reference_answer", "question")).alias("ref_no", "target")).distinct()
    return _rounded(M.rouge_multi(rows, "rouge1"))


@query()
def meteor_exact(spark: SparkSession, d: str) -> DataFrame:
    """METEOR over equal words."""
    return _rounded(M.meteor_scores(scored(spark, d)), "meteor")


@query()
def eval_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean ROUGE-L and METEOR."""
    rows = scored(spark, d)
    return _rounded(M.official(rows.select("qid", "prediction"), rows.select("qid", "target")), "rouge", "meteor")


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Confidence intervals of the means of ROUGE-1."""
    return _rounded(M.bootstrap(M.rouge(scored(spark, d), "rouge1"), "qid", ["precision", "recall", "fmeasure"]), "low", "mid", "high")


@query()
def rouge_aggregate_report(spark: SparkSession, d: str) -> DataFrame:
    """The same as lines of a report."""
    rows = M.bootstrap(M.rouge(scored(spark, d), "rouge1"), "qid", ["precision", "recall", "fmeasure"])
    name = F.concat(F.lit("rouge1-"), F.upper(F.substring("measure", 1, 1)))
    return rows.select(name.alias("score_type"), *(F.format_string("%f", c).alias(c) for c in ("low", "mid", "high")))


def _split_sizes(n: int) -> list[tuple[str, int]]:
    return [("base", n // 7), ("holdout", n // 7), ("training", n - 2 * (n // 7))]


@query()
def seeded_split(spark: SparkSession, d: str) -> DataFrame:
    """Training questions in three parts by a seeded shuffle, a seventh, a seventh and the rest."""
    rows = X.train(spark, d).select("qid", "pos")
    return V.seeded_split(rows, _split_sizes(rows.count())).select("qid", "split", "split_pos")


@query(f"WITH {X.TRAIN} SELECT qid, pos % 5 + 1 AS fold FROM train_rows")
def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    """Folds by position."""
    return X.train(spark, d).select("qid", V.fold(F.col("pos")).alias("fold"))


@query(f"WITH {X.TRAIN} SELECT f AS fold, count(*) FILTER (pos % 5 + 1 <> f) AS n_training, count(*) FILTER (pos % 5 + 1 = f) AS n_held FROM train_rows, range(1, 6) AS t(f) GROUP BY f")
def kfold_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Rows on either side of each fold."""
    rows, out = X.train(spark, d), None
    for k in range(1, 6):
        kept, held = V.holdout(rows, k)
        part = kept.agg(F.count(F.lit(1)).alias("n_training")).join(held.agg(F.count(F.lit(1)).alias("n_held"))).select(F.lit(k).alias("fold"), "n_training", "n_held")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT key, side FROM (SELECT DISTINCT CAST(id AS VARCHAR) AS key, 'left' AS side FROM selected_contexts WHERE CAST(id AS VARCHAR) NOT IN (SELECT doc_id FROM parent_embeddings WHERE doc_id IS NOT NULL) UNION ALL SELECT DISTINCT doc_id, 'right' FROM parent_embeddings WHERE doc_id NOT IN (SELECT CAST(id AS VARCHAR) FROM selected_contexts WHERE id IS NOT NULL))")
def set_diff_ids(spark: SparkSession, d: str) -> DataFrame:
    """Documents without chunks, and chunks without documents."""
    a = table(spark, d, "selected_contexts").filter("id is not null").select(F.col("id").cast("string").alias("key"))
    return V.set_difference(a, table(spark, d, "parent_embeddings").filter("doc_id is not null").select(F.col("doc_id").alias("key")), "key")


@query("SELECT fault, count(*) AS n FROM (SELECT CASE WHEN vec IS NULL THEN 'missing' WHEN len(vec) <> 64 THEN 'length' WHEN len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not finite' WHEN len(list_filter(vec, lambda x: x <> 0)) = 0 THEN 'zeros' ELSE 'none' END AS fault FROM parent_embeddings) GROUP BY fault")
def vector_quality(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the chunk vectors."""
    return V.vector_faults(table(spark, d, "parent_embeddings"))


@query(
    f"""WITH {X.TRAIN}, a AS (SELECT qid, question, answer FROM train_rows), b AS (SELECT qid, trim(question) AS question, nullif(answer, '') AS answer FROM train_rows)
SELECT 'question' AS "column", count(*) FILTER (a.question IS DISTINCT FROM b.question) AS n FROM a JOIN b USING (qid) UNION ALL SELECT 'answer', count(*) FILTER (a.answer IS DISTINCT FROM b.answer) FROM a JOIN b USING (qid)"""
)
def table_equality(spark: SparkSession, d: str) -> DataFrame:
    """Values that trimming questions and emptying answers changes."""
    a = X.train(spark, d).select("qid", "question", "answer")
    return V.table_differences(a, a.select("qid", F.trim("question").alias("question"), F.nullif("answer", F.lit("")).alias("answer")), ["qid"])


@query(f"WITH {X.TRAIN} SELECT qid, sha256(coalesce('=' || qid, '-') || chr(31) || coalesce('=' || question, '-') || chr(31) || coalesce('=' || answer, '-')) AS signature FROM train_rows")
def row_signature(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of the training rows."""
    return V.signature(X.train(spark, d), ["qid", "question", "answer"]).select("qid", "signature")


@query(f"WITH {X.TRAIN}, placed AS (SELECT qid, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS n FROM train_rows) SELECT qid FROM placed WHERE i IN (SELECT CAST(floor(k * (n - 1) / (least(20, n) - 1) + 1e-9) AS BIGINT) FROM range(0, 20) AS r(k), (SELECT any_value(n) AS n FROM placed) WHERE k < least(20, n))")
def linspace_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty evenly spaced questions, for spot checks."""
    return V.evenly_spaced(X.train(spark, d)).select("qid")


_LOG = "log AS (SELECT DISTINCT event_id AS qid, CASE WHEN event_type = 'error' THEN 'failed' END AS error, CASE WHEN value > 0 THEN event_type ELSE '' END AS answer FROM events WHERE event_id % 7 <> 0), wanted AS (SELECT DISTINCT event_id AS qid FROM events)"


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "events")
    log = rows.filter("event_id % 7 <> 0").select(F.col("event_id").alias("qid"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.when(F.col("value") > 0, F.col("event_type")).otherwise("").alias("answer")).distinct()
    return rows.select(F.col("event_id").alias("qid")).distinct(), log


@query(f"WITH {_LOG} SELECT count(*) FILTER (l.qid IS NULL) AS missing, count(*) FILTER (w.qid IS NULL) AS extra, count(*) FILTER (l.qid IS NOT NULL AND trim(coalesce(answer, '')) = '') AS empty, count(*) FILTER (error IS NOT NULL) AS failed FROM wanted w FULL JOIN log l ON w.qid = l.qid")
def output_guard(spark: SparkSession, d: str) -> DataFrame:
    """Faults of a log of answers; the log lacks every seventh question."""
    wanted, log = _log(spark, d)
    return V.output_faults(log, wanted)


@query(f"WITH {_LOG} SELECT qid FROM wanted WHERE qid NOT IN (SELECT qid FROM log WHERE error IS NULL AND trim(coalesce(answer, '')) <> '')")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """Questions to be tried again."""
    wanted, log = _log(spark, d)
    return V.pending(wanted, log)
