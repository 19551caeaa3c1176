"""Regular expressions that mean the same in Java and in RE2: white space and word characters as explicit classes."""

from __future__ import annotations

#: Inside of a character class: white space as Python's str.strip and \s know it.
SPACE_IN = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{SPACE_IN}]"
WORD = r"[\p{L}\p{N}_]"
STRIP = f"^{SPACE}+|{SPACE}+$"


def spaced(pattern: str) -> str:
    """The pattern with every `~` replaced by the class of white space."""
    return pattern.replace("~", SPACE)


# Patterns that decide results.
NUMBER = r"[0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]+)?"
ARTICLE = spaced(r"Điều~+([0-9]+[A-Za-z]?)")
CLAUSE = spaced(r"[Kk]hoản~+([0-9]+)")
ARTICLE_TITLE = rf"Điều{SPACE}+[0-9]+[A-Za-z]?[.:{SPACE_IN}]+([^\n]{{5,100}})"
CHUNK_PREFIX = r"(?s)^(.{0,200}?\.)\n(.*)$"
BOILERPLATE_ANY_CASE = [
    spaced(p)
    for p in (
        r"^CỘNG~*HÒA~*XÃ~*HỘI~*CHỦ~*NGHĨA~*VIỆT~*NAM$",
        r"^Độc~*lập~*[-–]~*Tự~*do~*[-–]~*Hạnh~*phúc$",
        r"^Chương~+[IVXLCDM0-9]+~*[.:]?$",
        r"^Mục~+[0-9]+~*[.:]?$",
    )
]
BOILERPLATE = [
    spaced(p)
    for p in (
        r"^[-–_]{3,}$",
        r"^(?:BỘ|CHÍNH~+PHỦ|QUỐC~+HỘI)[^\n]{0,60}$",
        r"^Số~*[:.]?~*[0-9A-Za-zĐđ/-]+$",
    )
]
LEGAL_TYPE = r"(Bộ luật|Luật|Nghị định|Thông tư liên tịch|Thông tư|Quyết định|Nghị quyết|Pháp lệnh)"
DOC_CODE = r"[0-9]{1,4}[A-Za-zĐđ]?/[0-9]{4}/(?:NĐ-CP|TTLT-[A-ZĐ]+|TT-[A-ZĐ]+|QĐ-[A-ZĐ]+|NQ-[A-ZĐ]+|NQ|QH[0-9]*|UBTVQH[0-9]*|[A-ZĐ-]{2,})"
DOC_NAMES = [
    spaced(p)
    for p in (
        r"(Nghị~+định~+[0-9]+/[0-9]{4}/NĐ-CP)",
        r"(Thông~+tư~+liên~+tịch~+[0-9]+/[0-9]{4}/TTLT-[A-ZĐa-zđ-]+)",
        r"(Thông~+tư~+[0-9]+/[0-9]{4}/TT-[A-ZĐa-zđ]+)",
        r"(Quyết~+định~+[0-9]+/[0-9]{4}/QĐ-[A-ZĐa-zđ]+)",
        r"(Nghị~+quyết~+[0-9]+/[0-9]{4}/(?:NQ|QH)[A-ZĐa-zđ-]*)",
    )
]
_UPPER_VN = "A-ZĐÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯ"
LAW_NAME = rf"((?:Bộ{SPACE}+luật|Luật){SPACE}+(?!(?:này|đó|hiện{SPACE}+hành)(?![\p{{L}}\p{{N}}_]))[{_UPPER_VN}][{_UPPER_VN}a-zđàáâãèéêìíòóôõùúăđĩũơư,{SPACE_IN}]{{2,55}}?[0-9]{{4}})"
ROUGE_BREAK = "[^a-z0-9]+"
#: Words left out of the lexical index; the list is a parameter of the functions that use it.
STOPWORDS = ("và", "của", "là", "có", "các", "được", "cho", "trong", "theo", "về", "khi", "này", "thì", "những", "với", "để", "từ", "tại", "như", "thế", "nào")
