"""Text functions against plain Python, with nulls, empty and odd texts."""

import re

import pytest
from pyspark.sql import functions as F

from grainlake.functions import text as T

TEXTS = [None, "", " \t\n", "Điều 12a. Quy định chung\nTheo khoản 1 và Khoản 2, năm 2020, 1.500,5 đồng", "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc\n-----\nChương II\nMục 3.\nBỘ TÀI CHÍNH\nSố: 12/NĐ\n\n\n\nNội dung", "\xa0x　", "Tiêu đề dài.\nThân bài", "a" * 300 + ".\nb"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").coalesce(1)


def values(frame, f):
    return [r[0] for r in frame.orderBy("i").select(f(F.col("t"))).collect()]


def plain(f):
    return [f(t or "") for t in TEXTS]


def test_against_plain_python(frame):
    assert values(frame, lambda c: T.words(c, ())) == plain(lambda t: t.lower().split())
    assert values(frame, T.numbers) == plain(lambda t: re.findall(r"\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?", t))
    assert values(frame, T.token_set) == plain(lambda t: list(dict.fromkeys(re.findall(r"\w+", t.lower()))))
    assert values(frame, T.first_article) == plain(lambda t: (re.findall(r"Điều\s+(\d+[A-Za-z]?)", t) or [""])[0])
    assert values(frame, T.clauses) == plain(lambda t: list(dict.fromkeys(re.findall(r"[Kk]hoản\s+(\d+)", t))))
    assert values(frame, lambda c: T.strip(T.text_of(c))) == plain(str.strip)
    assert values(frame, T.rouge_tokens) == plain(lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w])


def test_numbers_keep_their_quirk(spark):
    assert spark.range(1).select(T.numbers(F.lit("năm 2020"))).first()[0] == ["202", "0"]


def test_boilerplate_prefix_and_title(frame):
    assert values(frame, T.strip_boilerplate)[4] == "Nội dung"
    assert values(frame, T.chunk_prefix)[6:] == ["Tiêu đề dài.", ""]
    assert values(frame, T.chunk_body)[6:] == ["Thân bài", TEXTS[7]]
    assert values(frame, T.chunk_body)[0] == ""
    assert values(frame, T.article_title)[3] == "Quy định chung"


def test_names_and_codes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.document_name(F.lit("theo Nghị  định 15/2020/NĐ-CP của"))) == "Nghị định 15/2020/NĐ-CP"
    assert one(T.document_name(F.lit("Luật này và Luật Báo chí 2016"))) == "Luật Báo chí 2016"
    assert one(T.document_code(F.lit("Số:\n 15 / 2020 / NĐ-CP ngày"))) == "15/2020/NĐ-CP"
    assert one(T.name_from_link(F.lit("https://a.vn/x/luat-dat-dai-45.aspx/"))) == "luat dat dai"
    assert one(T.clean_name(F.lit(" - Luật  A|.html"))) == "Luật A|"
    assert one(T.name_from_link(F.lit(None).cast("string"))) == ""


def test_titles_cascade(spark):
    from grainlake.operators.answers import with_titles

    rows = [
        ("1", "Nghị định 15/2020/NĐ-CP về thuế", None, None, None, None),
        ("2", None, "https://a.vn/thong-tu-moi-5.aspx", "x Luật Báo chí 2016 y", None, None),
        ("3", "Quyết định nội bộ", None, None, None, None),
        ("4", "abc", None, "Số: 9/2011/QĐ-UBND", None, None),
        ("5", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id string, name string, link string, passage string, prefix string, evidence string")
    got = {r["doc_id"]: r["title"] for r in with_titles(df, "evidence").collect()}
    assert got == {"1": "Nghị định 15/2020/NĐ-CP về thuế", "2": "Luật Báo chí 2016", "3": "Quyết định nội bộ", "4": "9/2011/QĐ-UBND", "5": ""}


def test_clean_passage_and_tidy_answer(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.clean_passage(F.lit("a  b\r\nc\n\n\n\nd\ne. \nf\nb) g"))) == "a b c\n\nd e.\nf\nb) g"
    assert one(T.tidy_answer(F.lit("a\n\n\n\nb  c\n  d"))) == "a\n\nb c\nd"
    text = "x" * 80 + "." + "y" * 50
    assert one(T.tidy_answer(F.lit(text), 100)) == "x" * 80 + "."
    assert one(T.tidy_answer(F.lit("x." + "y" * 150), 100)) == ("x." + "y" * 150)[:100]
