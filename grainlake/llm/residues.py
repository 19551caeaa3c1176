"""Problem 10: documents that hold left-over template marks, filler, an error page or a notice instead of content.

Method: lines are normalised (folded to words) and counted by host. A line that holds nothing but stock phrases and page trimmings
(menus, codes, references) is evidence. Evidence that recurs in much of its host (at least `min_docs` documents and a tenth of
them, as a notice in every footer does) is boilerplate and is subtracted, unless the document has no other line; a document whose
residual holds evidence is a case. Template marks are found by their shapes anywhere in the text, in boilerplate too, as
TESTDATA.md asks. A line that merely speaks of such things leaves words of its own and is no evidence. Only evidence is counted:
of other lines the decision doesn't depend. A new phrase must be added to the lists.

Defined results: null and blank texts and null keys are no cases; null hosts are one host; repeated rows count once; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from grainlake.llm.charforms import ascii_fold, canonical
from grainlake.session import materialize

MIN_DOCS, MIN_SHARE = 4, 0.1

# Shapes of unfilled placeholders. "{a + b}" is a formula, "5%s" a misprint, "[Sửa đổi]" a note.
_UPPER = "A-ZÀ-ÖØ-ÞĂĐĨŨƠƯẠ-Ỹ"
_MARK = re.compile(
    r"\{\{[^{}\n]*\}\}|[$#]\{\s*\w[^{}\n]*\}|<%[^%\n]*%>|\{%[^%\n]*%\}|\{[\w.]+\|[^{}\n]*\}|\{(?:\d+|[A-Za-z]+[._]\w+)\}|(?<![\w%])%[sd](?!\w)|(?<![\w%])%[A-Z][A-Z_]+%(?!\w)"
    r"|@@\w+@@|(?<!\w)__[A-Za-z]\w*?__(?!\w)|\[\[\s*\w+\s*\]\]|<<[^<>\n]+>>|\[object Object\]|(?<![\w-])undefined(?![\w-])|\[INSERT [^\]\n]+\]"
)
_UPPER_MARK = re.compile(r"\[([^\[\]\n]{2,60})\]")  # in capital letters throughout, e.g. [TÊN CƠ QUAN]

_LOREM = "lorem ipsum dolor sit amet|lorem ipsum|dolor sit amet|consectetur adipiscing elit|sed do eiusmod tempor|ut labore et dolore magna(?: aliqua)?|incididunt|ut enim ad minim veniam|quis nostrud exercitation|duis aute irure dolor|excepteur sint occaecat"
_FILLER = "van ban mau se thay sau|bai viet thu nghiem khong dang|noi dung dang duoc cap nhat|todo viet phan nay|nhap mo ta tai day|doan nay de giu cho cho bai viet|your text goes here|abc abc abc xyz xyz|tieu de bai viet o day|dang tai noi dung xin cho"
_ERROR = (
    "khong tim thay trang|service temporarily unavailable|ban khong co quyen xem muc nay|da xay ra loi khi tai du lieu|internal server error|may chu dang qua tai|access denied|trang ban tim khong con ton tai|phien lam viec da het han"
    "|too many requests from your address|bad gateway|request timed out|lien ket da hong hoac bi go|he thong dang bao tri|this page could not be loaded|ket noi bi gian doan|page not found|forbidden|gateway timeout"
)
_NOTICE = (
    "you need to enable javascript to run this app|hay bat javascript de xem van ban nay|this site requires javascript and cookies|please turn on scripts in your browser to continue|xac nhan ban khong phai la ro bot de doc tiep"
    "|ung dung can chay script xin bat lai roi tai trang|checking your browser before access scripts must be allowed|trang nay khong hien thi khi chan tap lenh|vui long cho phep cookie va tap lenh de tiep tuc|trinh duyet cua ban chua bat javascript"
)
_STOCK = re.compile(rf"(?<!\w)(?:{_LOREM}|{_FILLER}|{_ERROR}|{_NOTICE})(?!\w)")
_TRIMMINGS = re.compile(
    r"(?<!\w)(?:trang chu tra cuu dang nhap|quay ve trang chu de tim tiep|vui long thu lai sau it phut|nhan f\d+ de tai lai|please try again later|(?:error code|ma loi|http) \d+|return to the home page"
    r"|hay bao cho ban quan tri ma tra cuu \w+|reference \w+|loi|error|\d{3})(?!\w)"
)
_WORD = re.compile(r"[a-z0-9]+")
_HINT = re.compile(r"[{}%@_\[<]|undefined")


def has_mark(form: str) -> bool:
    """Whether a canonical text holds an unfilled placeholder."""
    if not _HINT.search(form):
        return False
    return bool(_MARK.search(form)) or any(m[1].isupper() and len(m[1].split()) > 1 for m in _UPPER_MARK.finditer(form))


def is_stock(line: str) -> bool:
    """Whether a folded line of words is nothing but stock phrases and page trimmings, with at least one stock phrase."""
    rest, n = _STOCK.subn(" ", line)
    return n > 0 and not _TRIMMINGS.sub(" ", rest).strip()


class Evidence(NamedTuple):
    """What speaks against a text: a mark, its stock lines, and whether it has no other line."""

    mark: bool
    stock: list[str]
    bare: bool


def evidence(text: str) -> Evidence:
    stock, others = [], 0
    for line in ascii_fold(text).decode("ascii").split("\n"):
        own = " ".join(_WORD.findall(line))
        if is_stock(own):
            stock.append(own)
        elif own:
            others += 1
    return Evidence(has_mark(canonical(text)), stock, not others)


_TYPE = StructType([StructField("mark", BooleanType()), StructField("stock", ArrayType(LongType())), StructField("bare", BooleanType())])
_ARROW = pa.struct([("mark", pa.bool_()), ("stock", pa.list_(pa.int64())), ("bare", pa.bool_())])


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


@arrow_udf(_TYPE)
def _evidence(text: pa.Array) -> pa.Array:
    out = []
    for t in text.to_pylist():
        found = evidence(t) if t else None
        out.append({"mark": found.mark, "stock": sorted({_hash(x) for x in found.stock}), "bare": found.bare} if found and (found.mark or found.stock) else None)
    return pa.array(out, _ARROW)


def residue_documents(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id of each document that holds residues in place of content."""
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text")).filter("doc_id is not null")
    sizes = rows.groupBy("host").agg(F.count_distinct("doc_id").alias("docs"))
    found = materialize(rows.filter("text is not null").select("doc_id", "host", _evidence("text").alias("e")).filter("e is not null").select("doc_id", "host", "e.*"), "p10-evidence")
    lines = found.select("doc_id", "host", F.explode("stock").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count_distinct("doc_id").alias("n")).filter(F.col("n") >= min_docs)
    recurrent = counts.join(sizes, "host").filter(F.col("n") >= min_share * F.col("docs")).select("host", "line")
    residual = lines.join(recurrent, ["host", "line"], "left_anti").select("doc_id")
    return found.filter("mark or bare").select("doc_id").unionByName(residual).dropDuplicates()
