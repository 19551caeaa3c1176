"""Lexical retrieval: the BM25+ index as tables, and its ranking of documents for many questions at once.

Defined results: null and blank texts have no terms and length 0; a question without known terms scores every document alike;
equal scores (to nine places) are ordered by doc_id; questions and documents are given once each.

The ranking goes through blocks of documents in the shared folder: every task holds some questions and keeps the best documents of
each while it reads all blocks. No pair of question and document is shuffled; the work is questions times documents, the disk is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainlake.functions import text as T
from grainlake.session import materialize, shared_batches

K1, B, DELTA, TOP, BOOST = 1.5, 0.75, 1.0, 400, 0.4
PLACES = 9  # scores that agree so far are ties


def tokens(corpus: DataFrame) -> DataFrame:
    """doc_id, w: the words of each passage."""
    return corpus.select("doc_id", T.words(F.col("passage")).alias("w"))


def split(rows: DataFrame, text: str, numbers: bool = True) -> DataFrame:
    """The first column, w, named: words and distinct numbers of each text; nothing is kept."""
    named = F.array_distinct(T.numbers(F.col(text))) if numbers else F.array().cast("array<string>")
    return rows.select(rows.columns[0], T.words(F.col(text)).alias("w"), named.alias("named"))


def postings(words: DataFrame) -> DataFrame:
    """doc_id, term, tf, doc_len of the table of words."""
    rows = words.select("doc_id", F.size("w").alias("doc_len"), F.explode("w").alias("term"))
    return rows.groupBy("doc_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def term_weights(index: DataFrame, n: int) -> DataFrame:
    """term, df, idf."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((F.lit(n) + 1) / F.col("df")))


def top_by(df: DataFrame, group: str, score: str, tie: str, most: int) -> DataFrame:
    """The `most` best rows of each group, with their rank from 1; ties by the smaller `tie`."""
    order = Window.partitionBy(group).orderBy(F.round(score, PLACES).desc(), tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


_BLOCK_DOCS, _BLOCK_WORDS, HELD = 8192, 4_000_000, 1000  # documents and words of a block, questions of a task at a time
AT_ONCE = 128  # questions multiplied at a time, so that the products of a task stay small


def first_of(scores: np.ndarray, most: int, least: float) -> np.ndarray:
    """Places of the `most` greatest scores that reach `least`, of equal ones the first."""
    kept = np.flatnonzero(scores >= least)
    if len(kept) <= most:
        return kept
    own = scores[kept]
    bar = np.partition(own, len(own) - most)[len(own) - most]
    above = own > bar
    return kept[np.sort(np.concatenate([np.flatnonzero(above), np.flatnonzero(own == bar)[: most - above.sum()]]))]


def ordered(scores: np.ndarray, names: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` best in their order, each name once."""
    rounded = np.round(scores, PLACES)
    order = np.lexsort((-rounded, names))
    order = order[np.append(True, names[order][1:] != names[order][:-1])]
    top = order[np.argsort(-rounded[order], kind="stable")][:most]
    return scores[top], names[top]


NOTHING = np.empty(0), np.empty(0, "S1")


class Best:
    """Scores and names of the `most` best of a question, in their order, while blocks go by. Of a name given twice the better one counts.

    What is new waits until it is worth a sort.
    """

    def __init__(self, most: int, best: tuple[np.ndarray, np.ndarray] = NOTHING):
        self.most, self.new, self.waiting = most, [], 0
        self._keep(best)

    def _keep(self, best: tuple[np.ndarray, np.ndarray]) -> None:
        self.best, self.least = best, np.round(best[0][-1], PLACES) if len(best[0]) == self.most else -np.inf

    def add(self, scores: np.ndarray, names: np.ndarray) -> None:
        """One more block; names: in order."""
        near = np.flatnonzero(scores >= self.least - 10.0**-PLACES)  # rounding moves a score by less
        if len(near) > self.most:
            near = near[first_of(np.round(scores[near], PLACES), self.most, self.least)]
        if len(near):
            self.new.append((scores[near], names[near]))
            self.waiting += len(near)
            if self.waiting >= self.most / 2:
                self.found()

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            scores, names = (np.concatenate(x) for x in zip(self.best, *self.new, strict=True))
            self.new, self.waiting = [], 0
            self._keep(ordered(scores, names, self.most))
        return self.best


def merged(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, names: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same after one block."""
    own = Best(most, best)
    own.add(scores, names)
    return own.found()


RANKING = "qid string, doc_id string, score double, rank int"


def ranking_rows(qid: str, best: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    n = len(best[0])
    columns = [pa.array([qid] * n, pa.string()), pa.array([x.decode() for x in best[1].tolist()], pa.string()), pa.array(best[0]), pa.array(np.arange(1, n + 1), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["qid", "doc_id", "score", "rank"])


def spread(rows: DataFrame) -> DataFrame:
    """The questions in parts for the tasks: enough for all cores, few enough rows for one pass of a task."""
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // HELD)))


def name_array(names: pa.Array) -> np.ndarray:
    return np.array([x.encode() for x in names.to_pylist()], "S")


_OFTEN = 0.1  # terms in a larger share of a block are multiplied as dense rows

_BLOCK = "doc_ids array<string>, lengths array<int>, " + ", ".join(f"{x} array<int>" for x in ("terms", "starts", "docs", "tf", "found", "numbers", "number_starts", "number_docs"))


def _strings(files: list[str]) -> pa.Array:
    return pa.concat_arrays([pa.array([], pa.string()), *(b.column(0).cast(pa.string()) for b in shared_batches(files))])


def _coded(lists: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the known strings in lists: list and code, each once, by code; and how often it is there."""
    code = pc.index_in(lists.flatten(), known).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    asked = code == code  # null is NaN
    both, times = np.unique(code[asked].astype(np.int64) * len(lists) + of[asked], return_counts=True)
    return both % len(lists), both // len(lists), times


def _indexing(vocabulary: list[str], figures: list[str]):
    """A function for mapInArrow from the words and numbers of documents to blocks: the documents in their order, and for each term and number that is asked for its documents."""

    def block(rows: pa.Table, known: tuple[pa.Array, pa.Array]) -> pa.RecordBatch:
        rows = rows.take(pa.array(np.argsort(name_array(rows.column("doc_id").combine_chunks()), kind="stable")))
        words, named = (rows.column(c).combine_chunks() for c in ("w", "named"))
        docs, term, tf = _coded(words, known[0])
        terms, starts = np.unique(term, return_index=True)
        number_docs, number, _ = _coded(named, known[1])
        numbers, number_starts = np.unique(number, return_index=True)
        lists = [pc.list_value_length(words), terms, starts, docs, tf, np.diff(starts, append=len(docs)), numbers, number_starts, number_docs]
        lists = [rows.column("doc_id").combine_chunks(), *(pa.array(x, pa.int32()) for x in lists)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], names=[x.split()[0] for x in _BLOCK.split(", ")])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = (_strings(vocabulary), _strings(figures)), [], [0, 0]
        for batch in batches:
            words = np.cumsum(pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                room = int(np.searchsorted(words, (words[at - 1] if at else 0) + _BLOCK_WORDS - size[1], "right"))
                upto = min(max(room, at + (not held)), at + _BLOCK_DOCS - size[0], batch.num_rows)
                if upto > at:
                    held.append(batch.slice(at, upto - at))
                    size = [size[0] + upto - at, size[1] + int(words[upto - 1] - (words[at - 1] if at else 0))]
                    at = upto
                if at < batch.num_rows:  # full
                    yield block(pa.Table.from_batches(held), known)
                    held, size = [], [0, 0]
        if held:
            yield block(pa.Table.from_batches(held), known)

    return blocks


def _boosted(best: list[tuple[np.ndarray, np.ndarray]], asked: tuple[np.ndarray, np.ndarray], index: list[str], boost: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best documents of the questions after the boost, in their new order; asked: question and code of each number, by code."""
    of, number = asked
    numbers, first = np.unique(number, return_index=True)
    last = np.append(first[1:], len(number))
    shared = [np.zeros(len(scores), int) for scores, _ in best]
    known, code = np.unique(np.concatenate([names for _, names in best]), return_inverse=True)
    codes = np.split(code, np.cumsum([len(scores) for scores, _ in best])[:-1])
    for part in shared_batches(index, 1, ["doc_ids", "numbers", "number_starts", "number_docs"]):
        here, starts, docs = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("numbers", "number_starts", "number_docs"))
        ends = np.append(starts[1:], len(docs))
        _, i, j = np.intersect1d(numbers, here, assume_unique=True, return_indices=True)
        if not len(i):
            continue
        names = name_array(part.column("doc_ids").flatten())
        count = np.zeros((len(best), len(names)), np.int32)
        for x, y in zip(i, j, strict=True):
            count[np.ix_(of[first[x] : last[x]], docs[starts[y] : ends[y]])] += 1
        spot = np.minimum(np.searchsorted(known, names), max(len(known) - 1, 0))
        hit = np.flatnonzero(known[spot] == names)[::-1] if len(known) else spot[:0]
        place = np.full(len(known), -1)
        place[spot[hit]] = hit  # of a name given twice the first
        for q in np.unique(np.concatenate([of[first[x] : last[x]] for x in i])):
            at = place[codes[q]]
            own = at >= 0
            shared[q][own] = count[q, at[own]]
    out = []
    for (scores, names), n in zip(best, shared, strict=True):
        scores = scores * (1 + boost * n)
        order = np.lexsort((names, -np.round(scores, PLACES)))
        out.append((scores[order], names[order]))
    return out


def _ranking(vocabulary: list[str], figures: list[str], frequencies: list[str], index: list[str], n: int, avgdl: float, most: int, boost: float):
    """A function for mapInArrow from the words and numbers of questions to their best documents."""

    def ranked(rows: pa.Table, known: pa.Array, df: np.ndarray) -> Iterator[pa.RecordBatch]:
        of, term, qtf = _coded(rows.column("w").combine_chunks(), known)
        there = df[term] > 0
        of, term, weight = of[there], term[there], qtf[there] * np.log((n + 1) / df[term[there]])
        base = np.bincount(of, weight, len(rows)) * DELTA
        terms, first = np.unique(term, return_index=True)
        last = np.append(first[1:], len(term))
        best = [Best(most) for _ in range(len(rows))]
        for part in shared_batches(index, 1, ["doc_ids", "lengths", "terms", "starts", "docs", "tf"]):
            if not part.num_rows:
                continue
            names = name_array(part.column("doc_ids").flatten())
            lengths, here, starts, docs, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("lengths", "terms", "starts", "docs", "tf"))
            shares = tf * (K1 + 1) / (K1 * (1 - B + B * lengths[docs] / avgdl) + tf)
            ends = np.append(starts[1:], len(docs))
            _, i, j = np.intersect1d(terms, here, assume_unique=True, return_indices=True)
            often = ends[j] - starts[j] > _OFTEN * len(names)
            scores = np.zeros((len(rows), len(names)))
            for k in range(0, often.sum(), 256):
                left, right = i[often][k : k + 256], j[often][k : k + 256]
                dense, weights = np.zeros((len(left), len(names))), np.zeros((len(rows), len(left)))
                for m, (x, y) in enumerate(zip(left, right, strict=True)):
                    dense[m, docs[starts[y] : ends[y]]] = shares[starts[y] : ends[y]]
                    weights[of[first[x] : last[x]], m] = weight[first[x] : last[x]]
                for q in range(0, len(rows), AT_ONCE):
                    scores[q : q + AT_ONCE] += weights[q : q + AT_ONCE] @ dense
            for x, y in zip(i[~often], j[~often], strict=True):
                at, share = docs[starts[y] : ends[y]], shares[starts[y] : ends[y]]
                for q, w in zip(of[first[x] : last[x]], weight[first[x] : last[x]], strict=True):
                    scores[q, at] += w * share
            for q in range(len(rows)):
                best[q].add(base[q] + scores[q], names)
        best = [x.found() for x in best]
        if boost:
            best = _boosted(best, _coded(rows.column("named").combine_chunks(), _strings(figures))[:2], index, boost)
        for q, found in zip(rows.column("qid").to_pylist(), best, strict=True):
            yield ranking_rows(q, found)

    def ranking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _strings(vocabulary)
        df = np.zeros(len(known))
        for x in shared_batches(frequencies):
            df[x.column(0).to_numpy()] = x.column(1).to_numpy()
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                yield from ranked(pa.Table.from_batches([batch.slice(at, HELD)]), known, df)

    return ranking


def bm25_ranking(questions: DataFrame, corpus: DataFrame, most: int = TOP, boost: float = 0.0) -> DataFrame:
    """qid, doc_id, score, rank: the `most` best documents, then by their scores after number_boost if `boost` isn't 0.

    The passages are read once; only what the questions ask for is kept of them.
    """
    asked = materialize(split(questions.select("qid", "question"), "question", bool(boost)), "bm25-questions")
    vocabulary, figures = (sorted(materialize(asked.select(F.explode(c).alias("x")).distinct(), f"bm25-{c}").inputFiles()) for c in ("w", "named"))
    blocks = materialize(split(corpus.select("doc_id", "passage"), "passage", bool(boost)).mapInArrow(_indexing(vocabulary, figures), _BLOCK), "bm25-index")
    n, words = blocks.select(F.size("lengths").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("words")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("words")).first()
    found = blocks.select(F.explode(F.arrays_zip("terms", "found")).alias("x")).groupBy("x.terms").agg(F.sum("x.found").alias("df"))
    frequencies = sorted(materialize(found, "bm25-df").inputFiles())
    return spread(asked).mapInArrow(_ranking(vocabulary, figures, frequencies, sorted(blocks.inputFiles()), n, words / n if n else 0.0, most, boost), RANKING)


def number_boost(ranking: DataFrame, questions: DataFrame, corpus: DataFrame, boost: float = BOOST) -> DataFrame:
    """qid, doc_id, score, rank after the scores rise by `boost` for each number that question and passage share; for a ranking from elsewhere."""
    asked = questions.select("qid", F.array_distinct(T.numbers(F.col("question"))).alias("asked"))
    named = split(corpus.select("doc_id", "passage"), "passage").select("doc_id", "named")
    rows = ranking.hint("merge").join(asked, "qid").hint("merge").join(named.hint("merge"), "doc_id")  # the ranking comes from Python, its size is unknown
    scored = rows.select("qid", "doc_id", (F.col("score") * (1 + boost * F.size(F.array_intersect("asked", "named")))).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.round("score", PLACES).desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order))
