"""Exact dense retrieval, fusion of ranked lists, and the candidates of a question.

The vectors of the chunks go to the shared folder; every task holds some queries, multiplies them with the vectors block by block
and keeps the best documents of each query. Nothing is broadcast, no pair of query and chunk leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainlake.functions import text as T
from grainlake.operators.lexical import AT_ONCE, HELD, PLACES, RANKING, Best, name_array, ranking_rows, spread, top_by
from grainlake.session import materialize, shared_batches, shared_files

TOP, FUSED, DOCS, AUDIT, PRE, FINAL = 250, 30, 3, 50, 10, 5
WEIGHTS = (0.5, 1.0)


def unit(vec: Column) -> Column:
    """The vector in doubles, of length one."""
    x = F.transform(vec, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: v / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(part: pa.RecordBatch) -> np.ndarray:
    """The column unit, or vec brought to length one."""
    if "unit" in part.schema.names:
        return _rows(part.column("unit"))
    x = _rows(part.column("vec")).astype(float)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def dense_ranking(queries: DataFrame, chunks: DataFrame, most: int = TOP, block: int = 8192) -> DataFrame:
    """qid, doc_id, score, rank: documents by their best chunk; queries: qid, unit; chunks: doc_id, unit or vec."""
    files, vector = shared_files(chunks, "dense-chunks"), "unit" if "unit" in chunks.columns else "vec"

    def ranked(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors, best = _rows(rows.column("unit")), [Best(most) for _ in range(rows.num_rows)]
        for part in shared_batches(files, block, ["doc_id", vector]):
            names = name_array(part.column("doc_id"))
            order = np.argsort(names, kind="stable")
            docs, start = np.unique(names[order], return_index=True)
            units = _units(part)[order].T
            for q in range(0, len(best), AT_ONCE):
                top = np.maximum.reduceat(vectors[q : q + AT_ONCE] @ units, start, axis=1)
                for own, scores in zip(best[q : q + AT_ONCE], top, strict=True):
                    own.add(scores, docs)
        for qid, own in zip(rows.column("qid").to_pylist(), best, strict=True):
            yield ranking_rows(qid, own.found())

    def ranking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                yield from ranked(batch.slice(at, HELD))

    return spread(materialize(queries.select("qid", "unit"), "dense-queries")).mapInArrow(ranking, RANKING)


def minmax(ranking: DataFrame, *by: str) -> DataFrame:
    """qid, doc_id, score between 0 and 1 within each list; 0.5 where all are equal. by: what tells the lists of a question apart."""
    w = Window.partitionBy("qid", *by)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return ranking.select("qid", "doc_id", *by, F.when(hi - lo < 1e-12, F.lit(0.5)).otherwise((F.col("score") - lo) / (hi - lo)).alias("score"))


def fuse(rankings: list[DataFrame], weights: tuple[float, ...] = WEIGHTS, most: int = FUSED) -> DataFrame:
    """qid, doc_id, score, rank: weighted sum of the normalised lists; a document missing from a list adds nothing. The lists are shuffled once."""
    every = None
    for ranking, weight in zip(rankings, weights, strict=True):
        part = ranking.select("qid", "doc_id", "score", F.lit(weight).alias("weight"))
        every = part if every is None else every.unionByName(part)
    scored = minmax(every.repartition("qid"), "weight")
    return top_by(scored.groupBy("qid", "doc_id").agg(F.sum(F.col("score") * F.col("weight")).alias("score")), "qid", "score", "doc_id", most)


POOL = "qid string, doc_rank int, chunk_id bigint, doc_id string, emb double"
_SENT = 100_000  # rows of the pool in one batch


def candidate_pool(fused: DataFrame, queries: DataFrame, chunks: DataFrame, docs: int = DOCS, most: int | None = None, block: int = 8192) -> DataFrame:
    """qid, doc_rank, chunk_id, doc_id, emb: all chunks of the best documents, or the `most` best of them by embedding, ties by chunk_id.

    queries: qid, unit; chunks: chunk_id, doc_id, vec. A document may have a large share of all chunks and be among the best of many
    questions, so the chunks are scored where the questions are, as in dense_ranking; of what isn't among the best nothing leaves a task.
    """
    files = shared_files(chunks, "dense-chunks")
    best = fused.filter(F.col("rank") <= docs).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("x"))
    best = materialize(best.select("qid", F.col("x.doc_id").alias("docs")).join(queries.select("qid", "unit"), "qid"), "best-docs")

    def batch(rows: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
        place, ids, emb = (np.concatenate([x[k] for x in parts]) for k in range(3))  # place: in the lists of documents
        of, rank, names = places(rows)
        columns = [rows.column("qid").take(pa.array(of[place])), pa.array(rank[place], pa.int32()), pa.array(ids, pa.int64()), names.take(pa.array(place)), pa.array(emb)]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in POOL.split(", ")])

    def places(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        length = pc.list_value_length(rows.column("docs")).to_numpy(zero_copy_only=False)
        begin = np.cumsum(length) - length
        return np.repeat(np.arange(len(rows)), length), np.arange(length.sum()) - np.repeat(begin, length) + 1, rows.column("docs").flatten()

    def scored(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Place of a document in the lists, chunks in their order, scores."""
        vectors, (of, _, names) = _rows(rows.column("unit")), places(rows)
        wanted = pc.unique(names)
        code = pc.index_in(names, wanted).to_numpy()
        order = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[order], np.arange(len(wanted) + 1))
        for part in shared_batches(files, block, ["chunk_id", "doc_id", "vec"]):
            doc = pc.index_in(part.column("doc_id"), wanted)
            here = pa.array(np.flatnonzero(doc.is_valid().to_numpy(zero_copy_only=False)))
            if not len(here):
                continue
            doc, ids, units = doc.take(here).to_numpy(), part.column("chunk_id").take(here).to_numpy(), _units(part.take(here))
            by = np.lexsort((ids, doc))
            doc, ids, units = doc[by], ids[by], units[by]
            found, start = np.unique(doc, return_index=True)
            for d, lo, hi in zip(found, start, np.append(start[1:], len(doc)), strict=True):
                at = order[bounds[d] : bounds[d + 1]]
                for place, emb in zip(at, vectors[of[at]] @ units[lo:hi].T, strict=True):
                    yield place, ids[lo:hi], emb

    def everything(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for place, ids, emb in scored(rows):
            held.append((np.full(len(ids), place), ids, emb))
            n += len(ids)
            if n >= _SENT:
                yield batch(rows, held)
                held, n = [], 0
        if held:
            yield batch(rows, held)

    def foremost(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of, top = places(rows)[0], {}
        for place, ids, emb in scored(rows):
            new = np.full(len(ids), place), ids, emb
            own = tuple(map(np.concatenate, zip(top[of[place]], new, strict=True))) if of[place] in top else new
            order = np.lexsort((own[1], -np.round(own[2], PLACES)))[:most]
            top[of[place]] = tuple(x[order] for x in own)
        if top:
            yield batch(rows, list(top.values()))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, HELD):
                yield from (everything if most is None else foremost)(b.slice(at, HELD))

    return spread(best).mapInArrow(pool, POOL)


def audit_pool(pool: DataFrame, most: int = AUDIT) -> DataFrame:
    """The pool's best chunks by embedding, with their rank."""
    return top_by(pool, "qid", "emb", "chunk_id", most)


def overlap(asked: Column, text: Column) -> Column:
    """Share of the question's tokens that a text has."""
    q, t = T.token_set(asked), T.token_set(text)
    return F.size(F.array_intersect(q, t)) / F.greatest(F.lit(1), F.size(q))


def lexical_rerank(pool: DataFrame, questions: DataFrame) -> DataFrame:
    """The pool with ce, a score of each chunk's body between 0 and 1; the default where no cross-encoder is given."""
    rows = pool.join(questions, "qid")
    body = T.chunk_body(F.col("text"))
    ce = 1 / (1 + F.exp(2 - 4 * overlap(F.col("question"), F.coalesce(F.nullif(body, F.lit("")), F.col("text")))))
    return rows.withColumn("ce", ce)


def two_stage(pool: DataFrame, questions: DataFrame, rerank=lexical_rerank, pre: int = PRE, final: int = FINAL) -> DataFrame:
    """qid, question, ce_rank, chunk_id, doc_id, kind, text, emb, ce: the best by embedding, then of these the best by `rerank`.

    A question with fewer candidates keeps those that it has. Only `pre` chunks a question are reranked.
    """
    first = top_by(pool, "qid", "emb", "chunk_id", pre).drop("rank")
    best = top_by(rerank(first, questions), "qid", "ce", "chunk_id", final)
    return best.select("qid", "question", F.col("rank").alias("ce_rank"), "chunk_id", "doc_id", "kind", "text", "emb", "ce")
