"""Chunkers against a plain version written for the tests."""

import re

from grainlake.functions import chunking as C

DOC = "Điều 1. Quy định\n1. Nội dung thứ nhất.\n2. Nội dung thứ hai."


def chunks(spark, f, *rows):
    return f(spark.createDataFrame(list(rows), "doc_id string, name string, passage string"))


def test_two_clauses(spark):
    got = chunks(spark, C.child_chunks, ("7", "Văn bản thử", DOC)).orderBy("clause_no").collect()
    assert [r["clause"] for r in got] == ["1", "2"] and {r["article"] for r in got} == {"1"}
    assert got[0]["text"] == "Văn bản thử. Điều 1. Quy định. Khoản 1.\n1. Nội dung thứ nhất."
    assert got[1]["raw_clause_text"] == "2. Nội dung thứ hai."


def test_child_edges(spark):
    rows = [("1", "n", None), ("2", "n", ""), ("3", "n", "không có điều"), ("4", None, "mở đầu\nĐiều 2. Một\n1. chỉ một"), ("5", "", "Điều 3: Hai\nlời dẫn\n1. a\n2. b\nĐiều 3a (sửa). Ba\n1. c\n2. d\n10. e")]
    got = chunks(spark, C.child_chunks, *rows).orderBy("doc_id", "article_no", "clause_no").collect()
    assert [(r["doc_id"], r["article"], r["clause"], r["raw_clause_text"]) for r in got] == [("5", "3", "1", "1. a"), ("5", "3", "2", "2. b"), ("5", "3a", "1", "1. c"), ("5", "3a", "2", "2. d"), ("5", "3a", "10", "10. e")]
    assert got[2]["text"] == "Điều 3a (sửa). Ba. Khoản 1.\n1. c"


def plain_windows(text, size):
    return [text[i : i + size] for i in range(0, len(text), size - 200)]


def test_parent_chunks(spark):
    long = "Điều 5. Dài\n" + "Chữ " * 400
    rows = [
        ("1", "Luật X", "Điều 1. Phạm vi điều chỉnh\nbỏ\n\nĐiều 2. Giữ\nNội dung"),
        ("2", "", "đoạn một\n\nđoạn hai"),
        ("3", None, "1. a\n2) b\n3. c"),
        ("4", "Y", long + "\nĐiều 6. Ngắn\nZ"),
        ("5", "n", None), ("6", "n", "  \n "),
    ]
    got = {}
    for r in chunks(spark, lambda df: C.parent_chunks(df, 500), *rows).orderBy("doc_id", "chunk_pos").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got["1"] == ["Luật X.\nĐiều 2. Giữ\nNội dung"]
    assert got["2"] == ["đoạn một", "đoạn hai"]
    assert got["3"] == ["1. a", "2) b", "3. c"]
    body = re.sub(r"[ \t]+", " ", long).strip()
    head = "Điều 5. Dài"
    want = ["Y.\n" + w.strip() if w.strip().startswith(head) else f"Y. {head}.\n" + w.strip() for w in plain_windows(body, 500)]
    assert got["4"] == [*want, "Y.\nĐiều 6. Ngắn\nZ"]
    assert set(got) == {"1", "2", "3", "4"}


def test_windows_cover_the_text(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 999, 1000, 1001, 4000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        assert spark.range(1).select(C.windows(F.lit(text), 1000)).first()[0] == plain_windows(text, 1000)
