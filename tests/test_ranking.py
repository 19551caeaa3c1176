"""Actions, ranks, mask, pairs, Borda, gate and learned scorers on small frames with known values."""

import pytest
from pyspark.sql import functions as F

from grainlake.operators import actions as A
from grainlake.operators import ranking as R
from grainlake.operators import selection as S

CANDIDATE = "qid string, question string, ce_rank int, doc_id string, kind string, text string, emb double, ce double"


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [("q", "Mức phạt năm 2020 là gì", r, f"d{r}", "parent" if r % 2 else "child", f"Điều {r}. Mức phạt chứng cứ {r}", 1 - r / 100, 1 - r / 10) for r in range(1, 6)]
    rows += [("n", None, 1, None, None, None, 0.5, 0.5)]
    return spark.createDataFrame(rows, CANDIDATE)


def test_action_frame(candidates):
    rows = A.action_frame(candidates).filter("qid = 'q'").orderBy("action_size", "action_i", "action_j").collect()
    assert [r["action_key"] for r in rows] == [f"S{i}" for i in range(1, 6)] + [f"P{i}_{j}" for i in range(1, 6) for j in range(i + 1, 6)]
    assert len(A.PAIR) == 39 and set(A.PAIR) <= set(rows[0].asDict())
    pair = next(r for r in rows if r["action_key"] == "P1_3")
    assert (pair["contains_rank1"], pair["contains_rank2"], pair["rank_sum"], pair["rank_gap"]) == (1, 0, 4, 2)
    assert pair["primary_doc"] == "d1" and pair["first_article"] == "1" and pair["same_kind"] == 1 and pair["same_doc"] == 0
    alone = rows[0]
    assert len(A.UNDEFINED_ALONE) == 16 and all(alone[c] is None for c in A.UNDEFINED_ALONE)
    assert alone["ce_gap"] == 0 and alone["incremental_q_cov_c2"] == 0 and alone["incremental_q_cov_c1"] == alone["c1_q_overlap"] > 0
    none = A.action_frame(candidates).filter("qid = 'n'").collect()
    assert len(none) == 1 and none[0]["c1_q_overlap"] == 0 and none[0]["c1_len"] == 0


def test_scores_come_back_from_pairs(candidates):
    own = candidates.filter("qid = 'q'")
    back = A.candidate_scores(A.pairs(A.with_features(own)))
    assert back.filter("constant").count() == 5
    assert A.score_drift(own, back).first().asDict() == {"n": 5, "drift": 0.0}


FRAME = "qid string, ord int, p1 double, p2 double, target double, primary_doc string, first_article string"


def frame(spark, scores, docs="aaabb", articles=("1", "1", "", "1", "1")):
    return spark.createDataFrame([("q", i + 1, float(s), -float(s), float(i), docs[i], articles[i]) for i, s in enumerate(scores)], FRAME)


def test_ranks_and_softmax(spark):
    rows = R.with_ranks(frame(spark, [3, 1, 3, 2, None or 0]), ["p1"]).orderBy("ord").collect()
    assert [r["rank__p1"] for r in rows] == [1, 4, 2, 3, 5]
    assert abs(sum(r["prob__p1"] for r in rows) - 1) < 1e-12 and abs(sum(r["z__p1"] for r in rows)) < 1e-12
    flat = R.with_ranks(frame(spark, [2, 2, 2, 2, 2]), ["p1"]).collect()
    assert {r["z__p1"] for r in flat} == {0.0} and {round(r["prob__p1"], 12) for r in flat} == {0.2}
    one = R.with_ranks(frame(spark, [2, 2, 2, 2, 2]).filter("ord = 1"), ["p1"]).first()
    assert (one["rank__p1"], one["z__p1"], one["prob__p1"]) == (1, 0.0, 1.0)


def masked(spark, scores, **more):
    return R.with_mask(R.with_current(R.consensus(R.with_ranks(frame(spark, scores, **more), ["p1", "p2"]), ["p1", "p2"], ["p1"])))


def test_mask_and_current(spark):
    rows = masked(spark, [5, 4, 3, 2, 1]).orderBy("ord").collect()
    assert [r["is_current"] for r in rows] == [1, 0, 0, 0, 0] and [r["allowed"] for r in rows] == [True, True, False, False, False]
    rows = masked(spark, [1, 2, 9, 2, 1]).orderBy("ord").collect()  # the current one has no article: only itself
    assert [r["allowed"] for r in rows] == [False, False, True, False, False]
    assert R.with_deltas(masked(spark, [5, 4, 3, 2, 1]), ["p1"]).filter("is_current = 1").first()["delta_current__p1"] == 0


def test_regret_pairs_are_mirrored(spark):
    rows = S.regret_pairs(masked(spark, [5, 4, 3, 2, 1], docs="aaaaa", articles=["1"] * 5), ["p1"]).collect()
    assert len(rows) == 20 and sum(r["label"] for r in rows) == 10
    assert abs(sum(r["weight"] for r in rows) / len(rows) - 1) < 1e-12
    both = {(r["l_ord"], r["r_ord"], r["sign"]): r for r in rows}
    assert all(r["d_p1"] == -both[(a, b, -s)]["d_p1"] and r["label"] == 1 - both[(a, b, -s)]["label"] for (a, b, s), r in both.items())
    same = frame(spark, [1, 1, 1, 1, 1]).withColumn("target", F.lit(1.0)).withColumn("allowed", F.lit(True))
    assert S.regret_pairs(same, ["p1"]).isEmpty()


def step(differences):
    return F.when(F.col(differences[0]) >= 0, 0.75).otherwise(0.25)


def test_borda_and_gate(spark):
    rows = {r["ord"]: r["borda"] for r in S.borda(masked(spark, [3, 2, 1, 0, 0], docs="aaabb", articles=["1"] * 5), step, ["p1"]).collect()}
    assert max(rows, key=rows.get) == 1 and abs(rows[1] - 1.5) < 1e-9 and abs(sum(rows.values()) - 3) < 1e-9
    one = lambda p: spark.range(1).select(S.gate(F.lit(1), F.lit(2), F.lit(p))).first()[0]
    assert [one(0.55 - 1e-9), one(0.55), one(0.55 + 1e-9)] == [1, 2, 2]
    final = S.select_action(masked(spark, [3, 2, 1, 0, 0], docs="aaabb", articles=["1"] * 5), "p2", step, ["p1"]).first()
    assert (final["current"], final["baseline"], final["pairwise"], final["final"], final["n_allowed"]) == (1, 3, 1, 1, 3)


def test_learned_scorers(spark, tmp_path):
    from grainlake.operators import models as M

    rows = spark.createDataFrame([(f"q{q}", o, float(o), float((q * o) % 3), float(o) + 0.1 * ((q * o) % 3), q % 5 + 1) for q in range(20) for o in range(1, 6)], "qid string, ord int, p1 double, p2 double, target double, fold int")
    scored = M.out_of_fold(rows, ["p1", "p2"], [("pair", "pairwise", {"regParam": 0.01}), ("lin", "linear", {})])
    assert scored.count() == 100 and scored.select("qid", "ord").distinct().count() == 100 and {"pred__pair", "pred__lin"} <= set(scored.columns)
    best = scored.groupBy("qid").agg(F.max_by("ord", "pred__pair").alias("o"))
    assert best.filter("o <> 5").isEmpty()
    model = M.fit(rows, ["p1", "p2"], "gbt_grade", maxDepth=2)
    M.save_bundle({"g": model}, str(tmp_path))
    again = M.load_bundle(["g"], str(tmp_path))["g"]
    a, b = (M.score(m, rows, ["p1", "p2"], "s").orderBy("qid", "ord").select("s").collect() for m in (model, again))
    assert a == b
