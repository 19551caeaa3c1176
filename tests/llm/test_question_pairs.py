def test_same_questions(spark):
    from grainlake.llm.question_pairs import same_questions

    base = "nếu chủ tàu cá khai thác nước ngầm làm mất giấy phép con trong 12 ngày căn cứ Thông tư 3/2013 thì nộp ở đâu"
    train = [("1", base), ("1", base), ("2", "Hộ kinh doanh nộp thuế ở đâu?"), ("3", None), ("4", " ")]
    other = [
        ("a", "Xin hỏi " + base.upper() + "? Tôi xin cảm ơn nhiều."),
        ("b", base.replace("nước ngầm", "ngầm nước").replace("làm", "có làm")),
        ("c", base.replace("12", "13")),
        ("d", base.replace("Thông tư", "Nghị định")),
        ("e", base.replace("chủ tàu cá khai thác nước ngầm", "hộ dân nuôi gia cầm")),
        ("f", "Ho kinh doanh nop thue o dau"),
    ]
    schema = "qid string, question string"
    got = {tuple(r) for r in same_questions(spark.createDataFrame(train, schema), spark.createDataFrame(other, schema)).collect()}
    assert got == {("1", "a"), ("1", "b"), ("2", "f")}


def test_pairs_are_counted_where_they_are_joined(spark):
    from grainlake.llm.question_pairs import same_questions

    words = "một hai ba bốn năm sáu bảy tám chín mười".split()
    train = [(f"t{i}", " ".join(words + [chr(97 + i)] * 3)) for i in range(20)]
    other = [(f"p{i}", " ".join(words + [chr(97 + i)] * 3)) for i in range(20)]
    got = same_questions(*(spark.createDataFrame(x, "qid string, question string").repartition(3) for x in (train, other)))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(f"t{i}", f"p{i}") for i in range(20)}


def test_shared_keys_of_a_block(monkeypatch):
    import random

    import pyarrow as pa

    from grainlake.llm import question_pairs

    rng = random.Random(1)
    sides = [[rng.sample(range(30), rng.randint(1, 12)) for _ in range(n)] for n in (40, 25)]
    left = pa.table({"hs": pa.array(sides[0], pa.list_(pa.int64())), "need": pa.array([min(len(x), 6) for x in sides[0]], pa.int32())})
    right = pa.record_batch({"hs": pa.array(sides[1], pa.list_(pa.int64()))})
    want = {(i, j) for i, x in enumerate(sides[0]) for j, y in enumerate(sides[1]) if len({*x} & {*y}) >= min(len(x), 6)}
    for most in (1, 50, 10**6):
        monkeypatch.setattr(question_pairs, "_MOST_PAIRS", most)
        assert {(i, j) for x, y in question_pairs._joined(left, right) for i, j in zip(x.tolist(), y.tolist(), strict=True)} == want
