"""Metrics by hand-worked values, splits and checks by small tables."""

import pytest
from pyspark.sql import functions as F

from grainlake.operators import metrics as M
from grainlake.operators import validation as V


def pairs(spark, *rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "qid string, target string, prediction string")


def scores(spark, kind, *rows):
    got = M.rouge(pairs(spark, *rows), kind).orderBy("qid").collect()
    return [tuple(round(r[c], 4) for c in ("precision", "recall", "fmeasure")) for r in got]


def test_hand_values(spark):
    rows = [("testing one two", "testing"), ("testing one two", "testing one"), ("testing one two", ""), (None, "x"), ("a a b", "a a a")]
    assert scores(spark, "rouge1", *rows) == [(1, 0.3333, 0.5), (1, 0.6667, 0.8), (0, 0, 0), (0, 0, 0), (0.6667, 0.6667, 0.6667)]
    assert scores(spark, "rouge2", *rows[:3]) == [(0, 0, 0), (1, 0.5, 0.6667), (0, 0, 0)]
    assert scores(spark, "rougeL", rows[1], ("a b c d", "d a c"), (None, None)) == [(1, 0.6667, 0.8), (0.6667, 0.5, 0.5714), (0, 0, 0)]


def test_summary_level(spark):
    ref = "w1 w2 w3 w4 w5"
    assert M.rouge_lsum(ref, "w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5") == pytest.approx({"precision": 0.4, "recall": 0.8, "fmeasure": 2 * 0.4 * 0.8 / 1.2})
    assert M.rouge_lsum("a\nb", None)["fmeasure"] == 0
    assert scores(spark, "rougeLsum", (ref, ref)) == [(1, 1, 1)]


def test_lcs_against_the_table():
    import random

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in "xy")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert M.lcs_length(a, b) == t[-1][-1] == len(M.lcs_places(a, b))


def test_kinds_and_references(spark):
    for kind in ("rouge0", "rouge10", "rougeX"):
        with pytest.raises(ValueError):
            M.rouge(pairs(spark, ("a", "b")), kind)
    rows = spark.createDataFrame([("q", 0, "testing two", "testing one two"), ("q", 1, "testing one two", "testing one two"), ("q", 2, "two testing one", "testing one two")], "qid string, ref_no int, target string, prediction string")
    best = M.rouge_multi(rows, "rouge1").first()
    assert (best["ref_no"], best["fmeasure"]) == (1, 1.0)


def test_meteor_and_official(spark):
    assert M.meteor("the cat sat", "the cat sat") == pytest.approx(1 - 0.5 / 27)
    assert M.meteor("a b", "c") == 0 == M.meteor(None, None)
    assert M.meteor("a b c d", "c d a b") == pytest.approx(1 - 0.5 * (2 / 4) ** 3)
    p, t = (spark.createDataFrame([("1", "a b"), ("2", "c")], f"qid string, {c} string") for c in ("prediction", "target"))
    assert M.official(p, t).first()["rouge"] == 1
    with pytest.raises(ValueError):
        M.official(p, t.limit(1))


def test_bootstrap(spark):
    rows = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 2).cast("double").alias("x"))
    a = M.bootstrap(rows, "k", ["x"], samples=300).first()
    b = M.bootstrap(rows.repartition(5), "k", ["x"], samples=300).first()
    assert a["low"] < a["mid"] < a["high"] and abs(a["mid"] - 0.5) < 0.01 and 0.07 < a["high"] - a["low"] < 0.13
    assert all(abs(a[c] - b[c]) < 1e-9 for c in ("low", "mid", "high"))
    with pytest.raises(ValueError):
        M.bootstrap(rows, "k", ["x"], samples=0)


def test_seeded_split_is_the_known_shuffle(spark):
    import random

    n = 70
    rows = spark.range(n).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("qid")).repartition(4)
    got = {r["qid"]: (r["split"], r["split_pos"]) for r in V.seeded_split(rows, [("base", 10), ("holdout", 10), ("training", 50)]).collect()}
    order = list(range(n))
    random.Random(42).shuffle(order)
    assert got == {str(q): ("base" if i < 10 else "holdout" if i < 20 else "training", i) for i, q in enumerate(order)}
    with pytest.raises(ValueError):
        V.seeded_split(rows, [("base", 71)])


def test_tables_against_each_other(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, float("nan"), None), (3, 2.0, "y")], "k int, v double, t string")
    b = spark.createDataFrame([(1, 1.0 + 1e-13, "x"), (2, float("nan"), None), (4, 2.0, "y")], "k int, v double, t string")
    assert {r["column"]: r["n"] for r in V.table_differences(a, b, ["k"], 1e-12).collect()} == {"v": 2, "t": 2}
    assert {r["column"]: r["n"] for r in V.table_differences(a, a, ["k"]).collect()} == {"v": 0, "t": 0}
    assert {(r["k"], r["side"]) for r in V.set_difference(a, b, "k").collect()} == {(3, "left"), (4, "right")}
    one, two = (V.signature(spark.createDataFrame([r], "a string, b string"), ["a", "b"]).first()["signature"] for r in ((None, "x"), ("", "x")))
    assert one != two


def test_resume_and_guard(spark):
    wanted = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "qid string")
    done = spark.createDataFrame([("1", "good", None), ("2", "", None), ("3", "text", "failed"), ("9", "x", None)], "qid string, answer string, error string")
    assert sorted(r[0] for r in V.pending(wanted, done).collect()) == ["2", "3", "4"]
    assert V.output_faults(done, wanted).first().asDict() == {"missing": 1, "extra": 1, "empty": 1, "failed": 1}
    assert [r["pos"] for r in V.evenly_spaced(spark.range(100).withColumnRenamed("id", "pos"), 4).orderBy("pos").collect()] == [0, 33, 66, 99]
    assert V.evenly_spaced(spark.range(0).withColumnRenamed("id", "pos"), 4).isEmpty()
