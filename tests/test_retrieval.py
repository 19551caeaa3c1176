"""Retrieval against plain versions on small tables with nulls, ties and empty texts."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from grainlake.operators import dense, lexical
from grainlake.plans import fixtures


def plain_bm25(docs, asked):
    from collections import Counter

    n, total = len(docs), {d: Counter(t.split()) for d, t in docs.items()}
    avg = sum(sum(c.values()) for c in total.values()) / n
    df = Counter(w for c in total.values() for w in c)
    out = {}
    for d, c in total.items():
        s = 0.0
        for w in asked.split():
            if w in df:
                s += math.log((n + 1) / df[w]) * (1 + c[w] * 2.5 / (1.5 * (0.25 + 0.75 * sum(c.values()) / avg) + c[w]))
        out[d] = s
    return out


def test_bm25_scores_every_document(spark):
    rng = random.Random(3)
    docs = {f"d{i:02d}": " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for i in range(30)}
    corpus = spark.createDataFrame([(d, t or None) for d, t in docs.items()], "doc_id string, passage string")
    asked = {"1": "a b b z", "2": "zz", "3": None, "4": "h"}
    questions = spark.createDataFrame(list(asked.items()), "qid string, question string")
    for most in (5, 30):
        got = {}
        for r in lexical.bm25_ranking(questions, corpus, most).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((r["doc_id"], round(r["score"], 9)))
        for q, text in asked.items():
            want = sorted(plain_bm25(docs, text or "").items(), key=lambda x: (-round(x[1], 9), x[0]))[:most]
            assert got[q] == [(d, round(s, 9)) for d, s in want]


def test_numbers_boost_after_the_cut(spark):
    corpus = spark.createDataFrame([("a", "x 5"), ("b", "x 7 5"), ("c", None)], "doc_id string, passage string")
    questions = spark.createDataFrame([("q", "x 5 7")], "qid string, question string")
    ranking = spark.createDataFrame([("q", "a", 2.0, 1), ("q", "b", 1.9, 2), ("q", "c", 1.0, 3)], "qid string, doc_id string, score double, rank int")
    got = {r["doc_id"]: (r["score"], r["rank"]) for r in lexical.number_boost(ranking, questions, corpus).collect()}
    assert got == {"a": (2.8, 2), "b": (1.9 * 1.8, 1), "c": (1.0, 3)}


def test_dense_takes_the_best_chunk(spark):
    rng = np.random.default_rng(1)
    chunks = [(f"d{i % 7}", (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(50, 8)))]
    queries = [(str(i), (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(9, 8)))]
    c = spark.createDataFrame(chunks, "doc_id string, unit array<double>").repartition(4)
    q = spark.createDataFrame(queries, "qid string, unit array<double>")
    got = {}
    for r in dense.dense_ranking(q, c, 3, block=4).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["doc_id"])
    for qid, v in queries:
        best = {}
        for d, u in chunks:
            best[d] = max(best.get(d, -9), float(np.dot(u, v)))
        assert got[qid] == sorted(best, key=lambda d: (-round(best[d], 9), d))[:3]
    assert dense.dense_ranking(q, c.limit(0), 3).isEmpty() and dense.dense_ranking(q.limit(0), c, 3).isEmpty()


def test_fusion_and_constant_lists(spark):
    make = lambda *rows: spark.createDataFrame([("q", d, float(s)) for d, s in rows], "qid string, doc_id string, score double")
    got = {r["doc_id"]: round(r["score"], 6) for r in dense.fuse([make(("a", 1), ("b", 1)), make(("b", 5), ("c", 1), ("d", 3))]).collect()}
    assert got == {"a": 0.25, "b": 1.25, "c": 0.0, "d": 0.5}


def test_two_stage_keeps_what_there_is(spark):
    rows = [("q", 1, i, "d", "parent", i, f"chunk a{i}", 10.0 - i) for i in range(6)] + [("s", 1, 9, "d", "child", 0, None, 1.0)]
    pool = spark.createDataFrame(rows, "qid string, doc_rank int, chunk_id int, doc_id string, kind string, chunk_pos int, text string, emb double")
    questions = spark.createDataFrame([("q", "a3 chunk"), ("s", None)], "qid string, question string")
    got = dense.two_stage(pool, questions).orderBy("qid", "ce_rank").collect()
    assert [r["chunk_id"] for r in got if r["qid"] == "q"] == [3, 0, 1, 2, 4] and sum(r["qid"] == "s" for r in got) == 1


def test_units(spark):
    v = spark.range(1).select(dense.unit(F.array(F.lit(3.0), F.lit(4.0)))).first()[0]
    assert v == [0.6, 0.8]


def test_rankings_shuffle_no_pairs(spark):
    corpus = spark.createDataFrame([(f"d{i}", "a b c") for i in range(6)], "doc_id string, passage string")
    questions = spark.createDataFrame([("1", "a b"), ("2", "c")], "qid string, question string")
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 1.0])], "id string, unit array<double>")
    rankings = lexical.bm25_ranking(questions, corpus, 2), dense.dense_ranking(vectors.withColumnRenamed("id", "qid"), vectors.withColumnRenamed("id", "doc_id"), 2)
    for ranking in rankings:
        plan = ranking._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Join", "Aggregate", "Window"))
        assert ranking.groupBy("qid").count().filter("count = 2").count() == 2


def test_best_of_blocks():
    rng = np.random.default_rng(5)
    names = np.array(sorted(rng.choice(200, 90, replace=False).astype("S")), "S")
    scores = rng.integers(0, 4, 90).astype(float)
    for most in (1, 7, 200):
        best = lexical.NOTHING
        for part in (slice(60, 90), slice(0, 25), slice(25, 60), slice(0, 10)):
            best = lexical.merged(best, scores[part], names[part], most)
        want = sorted(zip(-scores, names, strict=True))[:most]
        assert list(zip(-best[0], best[1], strict=True)) == want


def test_boost_where_the_ranking_is_made(spark):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(["a", "b", "c", "5", "7,5", "12/3", "2024"]) for _ in range(rng.randint(0, 9)))
    corpus = spark.createDataFrame([(f"d{i:02d}", text() or None) for i in range(40)], "doc_id string, passage string")
    questions = spark.createDataFrame([("1", "a 5 7,5 5"), ("2", "2024 c"), ("3", None), ("4", "99 b")], "qid string, question string")
    rows = lambda df: [(r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.orderBy("qid", "rank").collect()]
    got = lexical.bm25_ranking(questions, corpus, 15, boost=0.4)
    assert rows(got) == rows(lexical.number_boost(lexical.bm25_ranking(questions, corpus, 15), questions, corpus))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pool_is_scored_where_the_questions_are(spark):
    rng = np.random.default_rng(2)
    docs = ["hot"] * 40 + [f"d{i % 5}" for i in range(20)]
    chunks = [(100 - i, d, v.tolist()) for i, (d, v) in enumerate(zip(docs, rng.normal(size=(60, 4)), strict=True))] + [(200 + i, "hot", [1.0, 1.0, 0.0, 0.0]) for i in range(3)]
    queries = [(str(i), (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(5, 4)))]
    fused = [(q, d, 1.0, k) for q, _ in queries for k, d in enumerate(["hot", "d1", "none", "d2"], 1)][:-2] + [("9", "hot", 1.0, 1)]
    f = spark.createDataFrame(fused, "qid string, doc_id string, score double, rank int")
    q, c = spark.createDataFrame(queries, "qid string, unit array<double>"), spark.createDataFrame(chunks, "chunk_id bigint, doc_id string, vec array<float>").repartition(3)
    want = {}
    for qid, doc, _, rank in fused:
        for i, d, v in chunks:
            if d == doc and rank <= 3 and qid in dict(queries):
                v = np.array(v, np.float32).astype(float)
                want.setdefault(qid, []).append((-round(float(np.dot(dict(queries)[qid], v / np.linalg.norm(v))), 9), i, rank, d))
    for most in (None, 2, 10, 1000):
        got, df = {}, dense.candidate_pool(f, q, c, most=most, block=7)
        for r in df.collect():
            got.setdefault(r["qid"], []).append((-round(r["emb"], 9), r["chunk_id"], r["doc_rank"], r["doc_id"]))
        assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x)[:most] for k, x in want.items()}
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert dense.candidate_pool(f, q, c.limit(0)).isEmpty() and dense.candidate_pool(f.limit(0), q, c, most=3).isEmpty()


def test_lists_are_shuffled_once(spark):
    lists = [spark.createDataFrame([("q", d, s) for d, s in rows], "qid string, doc_id string, score double") for rows in ([("a", 1.0), ("b", 2.0)], [("b", 5.0), ("c", 1.0)])]
    assert dense.fuse(lists)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_repeated_documents_are_left_out_in_place(spark, tmp_path):
    rows = [(1, "n", "l", "x 1"), (1, "n", "l", "x 1"), (2, None, "", None), (2, "", None, ""), (3, "n m", "", "x"), (3, "n", "m", "x"), (3, "n", "", "m x"), (None, "n", "l", "x"), (4, "n", "l", "x")]
    df = spark.createDataFrame(rows * 3, "id bigint, name string, link string, passage string")
    df.repartition(3).write.parquet(str(tmp_path / "selected_contexts.parquet"))
    got = fixtures.corpus_unmoved(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fixtures.corpus(spark, str(tmp_path)).collect())) and got.count() == 6
    assert "BroadcastHashJoin" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning" not in plan
    named = fixtures.named_documents(spark, str(tmp_path), spark.createDataFrame([("3",), ("3",), ("9",)], "doc_id string"))
    assert named.count() == 3


def test_parts_of_a_chunk_are_of_one_row(spark, tmp_path):
    rows = [(i, f"d{i}{k}", "parent", k, f"{i} {k}", [float(i + k + 1)] + [0.5] * 63) for i in range(20) for k in (0, 1, 1)] + [(99, "d", "child", 0, "t", [0.0] * 64)]
    spark.createDataFrame(rows, "chunk_id bigint, doc_id string, kind string, chunk_pos int, text string, vec array<float>").repartition(3).write.parquet(str(tmp_path / "parent_embeddings.parquet"))
    chunks = fixtures.chunk_rows(spark, str(tmp_path))
    both = fixtures.chunk_parts(chunks, "doc_id", "vec").join(fixtures.chunk_parts(chunks, "text"), "chunk_id").collect()
    assert len(both) == 20 and all(r["doc_id"] == f"d{r['chunk_id']}{(k := int(r['text'][-1]))}" and r["vec"][0] == r["chunk_id"] + k + 1 for r in both)


def test_override_retrieves_once(spark, monkeypatch):
    from grainlake.plans import answer_queries

    calls, found = [], answer_queries.candidates
    monkeypatch.setattr(answer_queries, "candidates", lambda *x: calls.append(x) or found(*x))
    assert answer_queries.pp_override(spark, "/root/testdata/sf0.001").count() and len(calls) == 1


def test_many_questions_of_a_task(spark):
    n = 10 * lexical.AT_ONCE
    corpus = spark.createDataFrame([(f"d{i}", " ".join("abcdefg"[: i % 7 + 1])) for i in range(9)], "doc_id string, passage string")
    questions = spark.range(n).selectExpr("string(id) as qid", "substring('gfedcba', 1 + id % 7, 2) as w").selectExpr("qid", "concat_ws(' ', left(w, 1), right(w, 1)) as question")
    chunks = spark.range(9).selectExpr("concat('d', id) as doc_id", "array(cos(id), sin(id)) as unit")
    queries = spark.range(n).selectExpr("string(id) as qid", "array(cos(2.5 * (id % 7)), sin(2.5 * (id % 7))) as unit")
    for ranking in (lexical.bm25_ranking(questions, corpus, 4), dense.dense_ranking(queries, chunks, 4, block=4)):
        own = {}
        for r in ranking.collect():
            own.setdefault(r["qid"], {})[r["rank"]] = (r["doc_id"], round(r["score"], 9))
        assert len(own) == n and all(len(x) == 4 and x == own[str(int(q) % 7)] for q, x in own.items())
    assert {d for d, _ in own["1"].values()} == {f"d{i}" for i in sorted(range(9), key=lambda i: -np.cos(i - 2.5))[:4]}


def test_new_documents_wait_for_a_sort(monkeypatch):
    rng, sorts, sort = np.random.default_rng(9), [], lexical.ordered
    monkeypatch.setattr(lexical, "ordered", lambda *x: sorts.append(x) or sort(*x))
    names = np.array(sorted(f"d{i:04d}" for i in range(2000)), "S")
    for scores in (rng.integers(0, 9, 2000).astype(float), rng.normal(size=2000), np.zeros(2000)):
        best, blocks = lexical.Best(100), np.array_split(rng.permutation(2000), 80)
        sorts.clear()
        for part in (*map(np.sort, blocks), np.arange(30)):
            best.add(scores[part], names[part])
        want = sorted(zip(-np.round(scores, lexical.PLACES), names, strict=True))[:100]
        assert [(-round(s, lexical.PLACES), n) for s, n in zip(*best.found(), strict=True)] == want and len(sorts) < 50


def test_boost_of_documents_given_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "_BLOCK_DOCS", 3)
    rng = random.Random(8)
    corpus = spark.createDataFrame([(f"d{i:02d}", " ".join(rng.choice(["a", "b", "5", "7", "12"]) for _ in range(6))) for i in range(40)], "doc_id string, passage string").coalesce(1)
    questions = spark.createDataFrame([("1", "a 5 7"), ("2", "b"), ("3", "12 99")], "qid string, question string")
    rows = lambda df: [(r["qid"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.orderBy("qid", "rank").collect()]
    assert rows(lexical.bm25_ranking(questions, corpus, 15, boost=0.4)) == rows(lexical.number_boost(lexical.bm25_ranking(questions, corpus, 15), questions, corpus))
