"""Answer templates and rules by worked examples."""

import pytest
from pyspark.sql import functions as F

from grainlake.operators import answers as A


def ruled(spark, rule, answer):
    rows = A.apply_rule(A.split_parts(spark.createDataFrame([(answer,)], "answer string")), rule)
    return rows.select(A.joined(F.col("h"), F.col("b"), F.col("c"))).first()[0]


CASES = [
    (A.cite_from_conclusion, "Theo quy định của pháp luật về thuế như sau:\nthân\nNhư vậy, thuế được quy định tại Điều 5 Luật Thuế.", "Căn cứ Điều 5 Luật Thuế quy định về thuế như sau:\nthân\nNhư vậy, thuế được quy định tại Điều 5 Luật Thuế."),
    (A.cite_from_conclusion, "Căn cứ Điều 1 như sau:\nx", "Căn cứ Điều 1 như sau:\nx"),
    (A.citation_wording, "Căn cứ Điều 5 12/2020/NĐ-CP quy định về thuế như sau:\nx", "Căn cứ theo quy định tại Điều 5 Nghị định 12/2020/NĐ-CP về thuế như sau:\nx"),
    (A.citation_wording, "Căn cứ Điều 5 Thông tư 1/2020/TT-BTC quy định về thuế như sau:\nx", "Căn cứ theo Điều 5 Thông tư 1/2020/TT-BTC quy định về thuế như sau:\nx"),
    (A.trim_topic, "Căn cứ Điều 5 quy định về mức thuế là bao nhiêu? như sau:\nx", "Căn cứ Điều 5 quy định về mức thuế như sau:\nx"),
    (A.add_clause, "Căn cứ Điều 5 về x như sau:\na\n...\n2. b", "Căn cứ khoản 2 Điều 5 về x như sau:\na\n...\n2. b"),
    (A.add_clause, "Căn cứ Điều 5 về x như sau:\n1. a\n2. b", "Căn cứ Điều 5 về x như sau:\n1. a\n2. b"),
    (A.add_clause, "Căn cứ khoản 1 Điều 5 như sau:\n3. a", "Căn cứ khoản 1 Điều 5 như sau:\n3. a"),
    (A.drop_upper_headings, "h\nQUYẾT ĐỊNH CỦA BỘ\nĐIỀU 5. VIẾT HOA CẢ\nthường", "h\nĐIỀU 5. VIẾT HOA CẢ\nthường"),
    (A.trim_conclusion, "h\nb\nNhư vậy, thuế là gì được quy định tại Điều 5.", "h\nb\nNhư vậy, thuế quy định tại Điều 5."),
    (A.article_of_body, "Theo quy định của pháp luật về x như sau:\nĐiều 7. abc\n...\nĐiều 7: d\n...\nĐiều 8. e", "Căn cứ theo Điều 7 quy định về x như sau:\nabc\n...\nd\n...\nĐiều 8. e"),
    (lambda h, b, c: A.conclude(F.lit("Thuế là gì ?. "))(h, b, c), "h\nb\nNhư vậy, cũ.", "h\nb\nNhư vậy, theo quy định trên thì Thuế là gì."),
    (A.drop_upper_headings, None, ""),
]


@pytest.mark.parametrize("rule, answer, want", CASES)
def test_rules(spark, rule, answer, want):
    assert ruled(spark, rule, answer) == want


def test_split_edges(spark):
    rows = spark.createDataFrame([(1, None), (2, "Như vậy, một dòng"), (3, "h\r\nb1\nb2\n\n"), (4, "h\n như vậy x \n ")], "i int, answer string")
    got = {r["i"]: (r["h"], r["b"], r["c"]) for r in A.split_parts(rows).collect()}
    assert got == {1: ("", "", ""), 2: ("Như vậy, một dòng", "", "Như vậy, một dòng"), 3: ("h", "b1\nb2", ""), 4: ("h", "", "như vậy x")}


def test_names_only_in_the_header(spark):
    names = spark.createDataFrame([("39/2019/QH14", "Luật Đầu tư công 2019")], "code string, name string")
    rows = A.split_parts(spark.createDataFrame([("1", "Căn cứ Điều 3 Luật 39/2019/QH14 quy định về x như sau:\nLuật 39/2019/QH14"), ("2", "Căn cứ Điều 3 Luật 1/2011/QH13 và 39/2019/QH14 về x như sau:\nb")], "qid string, answer string"))
    got = {r["qid"]: r["h"] for r in A.cite_by_name(rows, names, only=True).collect()}
    assert got == {"1": "Căn cứ Điều 3 Luật Đầu tư công 2019 quy định về x như sau:", "2": "Căn cứ Điều 3 Luật 1/2011/QH13 và 39/2019/QH14 về x như sau:"}


def test_assembled_answer_and_chain(spark):
    kept = spark.createDataFrame(
        [("q", "Thuế là gì?", 1, "d1", "Văn bản một.\nĐiều 4. Thuế suất cao\nBỘ TÀI CHÍNH\nNội dung một", 0.5), ("q", "Thuế là gì?", 2, "d2", "Văn bản hai.\nNội dung hai", 0.9), ("q", "Thuế là gì?", 3, "d2", "Văn bản hai.\nNội dung ba", 0.9), ("q", "Thuế là gì?", 4, "d1", "", 0.1)],
        "qid string, question string, ce_rank int, doc_id string, text string, ce double",
    )
    corpus = spark.createDataFrame([("d2", "Nghị định 1/2020/NĐ-CP", None, "Nghị định 1/2020/NĐ-CP ...", 0)], "doc_id string, name string, link string, passage string, ce int")
    answer = A.assemble(kept, corpus).first()["answer"]
    assert answer == "Căn cứ Nghị định 1/2020/NĐ-CP quy định như sau:\nNội dung hai\n...\nNội dung ba\n\nĐiều 4. Thuế suất cao\nNội dung một\nNhư vậy, Thuế là gì được quy định tại Nghị định 1/2020/NĐ-CP."
    headers = spark.createDataFrame([("q", "Đầu đề cho sẵn")], "qid string, header string")
    done = A.normalise(spark.createDataFrame([("q", answer, "Thuế là gì?")], "qid string, answer string, question string"), headers=headers).first()["answer"]
    assert done.startswith("Đầu đề cho sẵn\nNội dung hai") and done.endswith("\nNhư vậy, theo quy định trên thì Thuế là gì.") and done.count("Như vậy") == 1
    assert A.assemble(kept.limit(0), corpus).isEmpty()


def test_all_rules_are_not_one_plan(spark):
    """The driver plans the rules within 750 MB of heap."""
    answers = spark.createDataFrame([("1", "q?", "Điều 1 x\ny\nNhư vậy, z.")], "qid string, question string, answer string")
    names = spark.createDataFrame([("1/2014/QH13", "Luật x")], "code string, name string")
    got = A.normalise(answers, names)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 40_000 and got.count() == 1
