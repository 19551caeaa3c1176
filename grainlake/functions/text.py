"""Text functions as column expressions; nothing here leaves the JVM.

All take a column and give a column. Null text gives an empty string or an empty array unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainlake.functions import patterns as P


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, P.STRIP, "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, f"{P.SPACE}+", " "))


def rstrip_chars(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"[{chars}]+$", "")


def words(c: Column, stopwords: Sequence[str] = P.STOPWORDS) -> Column:
    """Lower-case words between white space, without stopwords, in their order and with repeats."""
    return F.filter(F.split(F.lower(text_of(c)), f"{P.SPACE}+"), lambda w: ~w.isin("", *stopwords))  # a lookup, not a pass over the stopwords, for each word


def numbers(c: Column) -> Column:
    """Numbers in a text; four digits without separator give two, as rankings rely on it."""
    return F.regexp_extract_all(text_of(c), F.lit(P.NUMBER), F.lit(0))


def token_set(c: Column) -> Column:
    """Distinct lower-case word tokens, by first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(c)), F.lit(f"({P.WORD}+)"), F.lit(1)))


def chunk_prefix(c: Column) -> Column:
    """The heading of a chunk: up to 200 characters that end in a full stop before a line break."""
    return strip(F.regexp_extract(text_of(c), P.CHUNK_PREFIX, 1))


def chunk_body(c: Column) -> Column:
    """The chunk after its heading; the whole text where there is none."""
    return F.when(F.regexp_like(text_of(c), F.lit(P.CHUNK_PREFIX)), strip(F.regexp_extract(text_of(c), P.CHUNK_PREFIX, 2))).otherwise(text_of(c))


def strip_boilerplate(c: Column) -> Column:
    """Without letterhead lines; at most one blank line in a row."""

    def plain(line: Column) -> Column:
        bare = strip(line)
        hit = F.lit(False)
        for p in P.BOILERPLATE_ANY_CASE:
            hit = hit | bare.rlike(f"(?iu){p}")
        for p in P.BOILERPLATE:
            hit = hit | bare.rlike(p)
        return ~hit

    kept = F.array_join(F.filter(F.split(text_of(c), "\n", -1), plain), "\n")
    return strip(F.regexp_replace(kept, r"\n{3,}", "\n\n"))


def articles(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text_of(c), F.lit(P.ARTICLE), F.lit(1)))


def clauses(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text_of(c), F.lit(P.CLAUSE), F.lit(1)))


def article_title(c: Column) -> Column:
    """Title after the first article number, unless it begins with a digit."""
    title = F.regexp_extract(text_of(c), P.ARTICLE_TITLE, 1)
    return F.when(title.rlike("^[0-9]"), F.lit("")).otherwise(strip(title))


def first_article(c: Column) -> Column:
    return F.regexp_extract(text_of(c), P.ARTICLE, 1)


def document_name(c: Column) -> Column:
    """The first legal document named in a text, by six patterns in their order; '' where none is."""
    found = [F.nullif(F.regexp_extract(text_of(c), p, 1), F.lit("")) for p in (*P.DOC_NAMES, P.LAW_NAME)]
    return F.coalesce(*(squeeze(x) for x in found), F.lit(""))


def clean_name(c: Column) -> Column:
    """A title without file ending, dashes and bars at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text_of(c), f"{P.SPACE}+", " "), r"^[ \-–|]+|[ \-–|]+$", ""), r"(?i)\.(?:html?|aspx?)$", "")


def _last_segment(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(text_of(c), "/+$", ""), "/", -1), -1)


def name_from_link(c: Column) -> Column:
    """The words of a link's last segment, without ending and number."""
    bare = F.regexp_replace(F.regexp_replace(_last_segment(c), r"(?i)\.(?:html?|aspx?)$", ""), r"-[0-9]+$", "")
    return squeeze(F.replace(bare, F.lit("-"), F.lit(" ")))


def title_from_link(c: Column) -> Column:
    """As name_from_link, for links that end in -<number>.aspx only."""
    return F.replace(F.regexp_replace(_last_segment(c), r"-[0-9]+\.aspx$", ""), F.lit("-"), F.lit(" "))


def document_code(c: Column) -> Column:
    """The first code of a legal document, blanks around its slashes taken out; '' where none is."""
    joined = F.regexp_replace(text_of(c), rf"(?iu)Số{P.SPACE}*:{P.SPACE}*\n+{P.SPACE}*", "Số: ")
    joined = F.regexp_replace(joined, rf"([0-9]+){P.SPACE}*/{P.SPACE}*([0-9]{{4}}){P.SPACE}*/{P.SPACE}*", "$1/$2/")
    return F.regexp_extract(joined, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({P.DOC_CODE})(?![\p{{L}}\p{{N}}_])", 1)


_LOWER = "a-zàáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"


def join_broken_lines(c: Column) -> Column:
    """Single line breaks before a small letter become blanks, unless a mark stands before or a list letter behind."""
    held = F.replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), F.lit("\n\n"), F.lit("\ue000"))
    joined = F.regexp_replace(held, rf"(?<=[^.:;)\-\x{{E000}}])\n(?=[{_LOWER}])(?!{P.SPACE}*[a-zđ]\){P.SPACE})", " ")
    return F.replace(joined, F.lit("\ue000"), F.lit("\n\n"))


def clean_passage(c: Column) -> Column:
    """One kind of line break, single blanks, at most one blank line in a row, broken lines joined."""
    flat = F.regexp_replace(F.regexp_replace(text_of(c), "\r\n?", " "), r"[ \t\x{0B}\f]+", " ")
    return join_broken_lines(strip(F.regexp_replace(flat, r"\n{3,}", "\n\n")))


def tidy_answer(c: Column, most: int = 5800) -> Column:
    """Blanks and blank lines reduced; cut at `most` characters, at the last full stop if it lies beyond 70 percent."""
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "), r"\n[ \t]+", "\n")
    cut = F.substring(tidy, 1, most)
    stop = F.length(cut) - F.locate(".", F.reverse(cut)) + 1  # 1-based place of the last full stop
    at_stop = F.when((F.locate(".", F.reverse(cut)) > 0) & (stop - 1 > most * 0.7), F.substring(cut, F.lit(1), stop)).otherwise(cut)
    return strip(F.when(F.length(tidy) > most, at_stop).otherwise(tidy))


def rouge_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; every other letter separates."""
    return F.filter(F.split(F.lower(text_of(c)), P.ROUGE_BREAK), lambda w: w != "")
