"""Answers: assembled from evidence by templates, and normalised by rules on header, body and conclusion.

An answer is split once into its three parts (columns h, b, c); each rule rewrites parts, and the chain joins them at the end.
The names under which laws are cited come as a table (code, name), not as part of the program.

Defined results: a null answer counts as ''; a question without evidence has no answer; ties between documents and between chunks
go to the better rank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainlake.functions import patterns as P
from grainlake.functions import text as T
from grainlake.session import materialize

Parts = tuple[Column, Column, Column]
_EDGE_L, _EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
LAW_CODE = r"[0-9]+[A-Za-zĐđ]?/[0-9]{4}/QH[0-9]+"
ART = P.spaced(r"Điều~+([0-9]+[A-Za-z]?)")
GAP = P.spaced(r"\n~*\.\.\.~*\n")
LIKE = "(?iu)"
# What a question ends in but a topic does not.
TAIL = P.spaced(
    r"(?iu)~+(?:là gì\??|(?:được~+)?(?:quy định~+)?như thế nào\??|(?:được~+)?(?:quy định~+)?ra sao\??|(?:được~+)?(?:quy định~+)?thế nào\??|(?:là~+)?bao lâu\??|(?:là~+)?bao nhiêu\??|(?:hay|không)~+không\??)$"
)
SHORT_TAIL = P.spaced(r"(?iu)~+(?:là gì\??|(?:được~+)?(?:quy định~+)?như thế nào\??|(?:được~+)?(?:quy định~+)?ra sao\??|(?:được~+)?(?:quy định~+)?thế nào\??)$")


def header(title: Column, articles: Column, clauses: Column, heading: Column, question: Column) -> Column:
    """The opening sentence: article, document and topic as far as known, else the question; up to three clauses are named."""
    named = F.when((F.size(clauses) > 0) & (F.size(clauses) <= 3), F.concat(F.lit("khoản "), F.array_join(clauses, ", khoản "), F.lit(" "))).otherwise(F.lit(""))
    article = F.concat(F.lit("Căn cứ "), named, F.lit("Điều "), F.try_element_at(articles, F.lit(1)), F.lit(" "), title)
    asked = T.strip(T.rstrip_chars(T.text_of(question), "?"))
    return (
        F.when((F.size(articles) > 0) & (title != "") & (heading != ""), F.concat(article, F.lit(" quy định về "), heading, F.lit(" như sau:")))
        .when((F.size(articles) > 0) & (title != ""), F.concat(article, F.lit(" quy định như sau:")))
        .when(title != "", F.concat(F.lit("Căn cứ "), title, F.lit(" quy định như sau:")))
        .otherwise(F.concat(F.lit("Theo quy định của pháp luật về "), asked, F.lit(" như sau:")))
    )


def conclusion(title: Column, articles: Column, question: Column) -> Column:
    """The closing sentence with the citation, as far as known."""
    asked = T.strip(T.rstrip_chars(T.text_of(question), "?"))
    ref = F.when((F.size(articles) > 0) & (title != ""), F.concat(F.lit(" tại Điều "), F.try_element_at(articles, F.lit(1)), F.lit(" "), title)).when(title != "", F.concat(F.lit(" tại "), title)).otherwise(F.lit(""))
    return F.concat(F.lit("Như vậy, "), asked, F.lit(" được quy định"), ref, F.lit("."))


def assemble(kept: DataFrame, corpus: DataFrame, most: int = 5800) -> DataFrame:
    """qid, answer of the kept candidates (qid, question, ce_rank, doc_id, text, ce).

    Documents by their best score, chunks by score; within a document joined by "...", documents by a blank line.
    """
    rows = kept.withColumns({"body": T.chunk_body(F.col("text")), "prefix": T.chunk_prefix(F.col("text"))})
    item = F.struct((-F.col("ce")).alias("s"), "ce_rank", "body", "text", "prefix")
    docs = rows.groupBy("qid", "question", "doc_id").agg(F.array_sort(F.collect_list(item)).alias("xs"), F.max("ce").alias("best"), F.min("ce_rank").alias("first"))
    bodies = F.transform(F.filter("xs", lambda x: T.strip(x["body"]) != ""), lambda x: T.strip_boilerplate(x["body"]))
    docs = docs.select("qid", "question", F.struct((-F.col("best")).alias("s"), "first", "doc_id", F.array_join(bodies, "\n...\n").alias("body"), F.array_join(F.transform("xs", lambda x: x["text"]), "\n...\n").alias("raw"), F.array_join(F.filter(F.transform("xs", lambda x: x["prefix"]), lambda x: x != ""), " ").alias("prefix")).alias("x"))
    whole = docs.groupBy("qid", "question").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    whole = whole.select("qid", "question", F.array_join(F.transform("xs", lambda x: x["body"]), "\n\n").alias("body"), F.col("xs")[0]["doc_id"].alias("doc_id"), F.col("xs")[0]["raw"].alias("raw"), F.col("xs")[0]["prefix"].alias("prefix"))
    known = whole.join(corpus.select("doc_id", "name", "link", "passage"), "doc_id", "left")
    raw = F.col("raw")
    named = F.coalesce(F.nullif(T.document_name(F.substring(T.text_of(F.col("passage")), 1, 1500)), F.lit("")), T.document_name(raw))
    known = known.withColumns({"articles": T.articles(raw), "clauses": T.clauses(raw), "heading": T.article_title(raw), "named": named})
    known = with_titles(known, "raw")
    top = header(F.col("named"), F.col("articles"), F.col("clauses"), F.col("heading"), F.col("question"))
    end = conclusion(F.col("title"), F.col("articles"), F.col("question"))
    return known.select("qid", T.tidy_answer(F.concat_ws("\n", top, "body", end), most).alias("answer"))


def with_titles(df: DataFrame, evidence: str, name: str = "name", link: str = "link", passage: str = "passage", prefix: str = "prefix") -> DataFrame:
    """df with title, how each document is cited; in steps, so that no expression is computed twice."""
    bounded, coded = rf"{LIKE}{_EDGE_L}{P.LEGAL_TYPE}{_EDGE_R}", rf"{LIKE}{_EDGE_L}({P.DOC_CODE}){_EDGE_R}"
    sources = [T.clean_name(F.col(name)), T.name_from_link(F.col(link)), T.squeeze(T.text_of(F.col(prefix))), T.squeeze(F.substring(T.text_of(F.col(passage)), 1, 2000)), T.squeeze(F.substring(T.text_of(F.col(evidence)), 1, 1000))]
    rows = df.withColumn("_s", F.array(*sources)).withColumn("_code", T.document_code(F.substring(T.text_of(F.col(passage)), 1, 2500)))

    def typed(s: Column) -> Column:
        code = F.regexp_extract(s, coded, 1)
        begin, end = F.regexp_instr(s, F.lit(bounded)), F.regexp_instr(s, F.lit(coded)) + F.length(code) + 80
        cut = T.squeeze(F.regexp_replace(F.substring(s, begin, F.greatest(F.lit(0), end - begin)), "^[ ,;-]+|[ ,;-]+$", ""))
        return F.when(s.rlike(bounded), F.when(code != "", cut).when(F.length(s) <= 180, s))

    rows = rows.withColumn("_typed", F.filter(F.transform(F.slice("_s", 1, 3), typed), lambda x: x.isNotNull()))
    rows = rows.withColumn("_named", F.filter(F.transform("_s", T.document_name), lambda x: x != ""))
    kind = F.regexp_extract(F.array_join(F.filter(F.slice("_s", 1, 3), lambda x: x != ""), " "), bounded, 1)
    last = F.when(F.col("_code") != "", F.when(kind != "", F.concat_ws(" ", kind, "_code")).otherwise(F.col("_code")))
    one = F.lit(1)
    return rows.withColumn("title", F.coalesce(F.try_element_at("_typed", one), F.try_element_at("_named", one), last, F.lit(""))).drop("_s", "_code", "_typed", "_named")


def split_parts(df: DataFrame, answer: str = "answer") -> DataFrame:
    """df with h, b, c: first line, what lies between, and the last line with text if it begins with "như vậy"."""
    lines = F.split(F.regexp_replace(T.text_of(F.col(answer)), "\r\n?", "\n"), "\n", -1)
    rows = df.withColumn("_l", lines).withColumn("_n", F.array_max(F.transform("_l", lambda x, i: F.when(T.strip(x) != "", i + 1).otherwise(0))))
    last = T.strip(F.try_element_at("_l", F.greatest(F.lit(1), F.col("_n"))))
    rows = rows.withColumn("c", F.when((F.col("_n") > 0) & F.startswith(F.lower(last), F.lit("như vậy")), last).otherwise(F.lit("")))
    upto = F.when(F.col("c") != "", F.col("_n") - 1).otherwise(F.size("_l"))
    body = F.array_join(F.slice("_l", F.lit(2), F.greatest(F.lit(0), upto - 1)), "\n")
    return rows.withColumns({"h": T.strip(F.col("_l")[0]), "b": T.strip(body)}).drop("_l", "_n")


def joined(h: Column, b: Column, c: Column) -> Column:
    """The parts that aren't blank, one under the other."""
    return F.array_join(F.filter(F.array(*map(T.strip, (h, b, c))), lambda x: x != ""), "\n")


def fallback_topic(h: Column) -> Column:
    """The topic of a header that cites nothing."""
    return F.regexp_extract(h, P.spaced(LIKE + r"^Theo quy định của pháp luật về~+(.+?)~+như sau:$"), 1)


def cite_from_conclusion(h: Column, b: Column, c: Column) -> Parts:
    """A header without citation takes the one of the conclusion, unless that is no clean name."""
    pattern = P.spaced(LIKE + _EDGE_L + r"quy định tại~+" + ART + r"~+(.+?)\.$")
    doc, topic = T.strip(F.regexp_extract(c, pattern, 2)), fallback_topic(h)
    ok = (topic != "") & (doc != "") & ~F.contains(doc, F.lit(". ")) & (F.length(doc) <= 180)
    return F.when(ok, F.concat(F.lit("Căn cứ Điều "), F.regexp_extract(c, pattern, 1), F.lit(" "), doc, F.lit(" quy định về "), T.strip(topic), F.lit(" như sau:"))).otherwise(h), b, c


#: Kind of a document by the form of its code, and kinds that may stand before it already.
KIND_OF_CODE = (
    (r"TTLT-[A-ZĐ-]+", "Thông tư liên tịch", ("Thông tư liên tịch",)), ("NĐ-CP", "Nghị định", ("Nghị định",)), (r"TT-[A-ZĐ-]+", "Thông tư", ("Thông tư", "Thông tư liên tịch")),
    (r"QĐ-[A-ZĐ-]*", "Quyết định", ("Quyết định",)), (r"QH[0-9]+", "Luật", ("Luật", "Nghị quyết")),
)


def name_kinds(h: Column) -> Column:
    """Codes without the kind of their document get it."""
    for form, kind, before in KIND_OF_CODE:
        unless = "".join(f"(?<!{x} )" for x in before)
        h = F.regexp_replace(h, rf"{LIKE}{unless}{_EDGE_L}([0-9]+[A-Za-zĐđ]?/[0-9]{{4}}/{form}){_EDGE_R}", f"{kind} $1")
    return h


def citation_wording(h: Column, b: Column, c: Column) -> Parts:
    """One wording for circulars and untyped documents, another for typed ones."""
    h = name_kinds(h)
    pattern = P.spaced(LIKE + "^Căn cứ " + ART + r"~+(.+?)~+quy định về~+(.+?)~+như sau:$")
    article, doc, topic = (F.regexp_extract(h, pattern, k) for k in (1, 2, 3))
    plain = F.upper(doc).rlike("/TT-|/TTLT-") | ~doc.rlike(rf"{LIKE}{_EDGE_L}{P.LEGAL_TYPE}{_EDGE_R}")
    short = F.concat(F.lit("Căn cứ theo Điều "), article, F.lit(" "), doc, F.lit(" quy định về "), topic, F.lit(" như sau:"))
    full = F.concat(F.lit("Căn cứ theo quy định tại Điều "), article, F.lit(" "), doc, F.lit(" về "), topic, F.lit(" như sau:"))
    return F.when(article == "", h).when(plain, short).otherwise(full), b, c


def trim_topic(h: Column, b: Column, c: Column) -> Parts:
    """The topic of a header loses the tail of a question."""
    pattern = P.spaced(LIKE + "^(.*?" + _EDGE_L + r"về~+)(.+?)(~+như sau:)$")
    topic = F.regexp_extract(h, pattern, 2)
    new = F.regexp_replace(F.regexp_replace(topic, TAIL, ""), "^[ ?]+|[ ?]+$", "")
    return F.when((topic != "") & (new != ""), F.concat(F.regexp_extract(h, pattern, 1), new, F.regexp_extract(h, pattern, 3))).otherwise(h), b, c


def add_clause(h: Column, b: Column, c: Column) -> Parts:
    """The clause that the evidence is, if its second chunk begins with one or the body has exactly one."""
    begins, line = P.spaced(r"^~*([0-9]{1,2})\.~+"), P.spaced(r"(?m)^~*([0-9]{1,2})\.~+")
    second = F.regexp_extract(T.text_of(F.try_element_at(F.split(b, GAP, -1), F.lit(2))), begins, 1)
    lines = F.regexp_extract_all(b, F.lit(line), F.lit(1))
    k = F.when(second != "", second).when(F.size(lines) == 1, F.try_element_at(lines, F.lit(1))).otherwise(F.lit(""))
    cites = h.rlike(P.spaced(LIKE + _EDGE_L + "Điều~+[0-9]+")) & ~h.rlike(P.spaced(LIKE + _EDGE_L + "khoản~+[0-9]+~+Điều" + _EDGE_R))
    pattern = P.spaced(LIKE + "^(.*?)" + _EDGE_L + "Điều~+(.*)$")
    return F.when(cites & (k != ""), F.concat(F.regexp_extract(h, pattern, 1), F.lit("khoản "), k, F.lit(" Điều "), F.regexp_extract(h, pattern, 2))).otherwise(h), b, c


def is_upper_heading(line: Column) -> Column:
    """8 to 180 characters, ten letters at least and nine in ten of them capitals, and no article."""
    s = T.strip(line)
    letters, capitals = F.length(F.regexp_replace(s, r"[^\p{L}]", "")), F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    return (F.length(s) >= 8) & (F.length(s) <= 180) & ~s.rlike(LIKE + "^Điều" + _EDGE_R) & (letters >= 10) & (capitals * 10 >= letters * 9)


def drop_upper_headings(h: Column, b: Column, c: Column) -> Parts:
    """The body without headings in capitals."""
    kept = F.array_join(F.filter(F.split(b, "\n", -1), lambda x: ~is_upper_heading(x)), "\n")
    return h, T.strip(F.regexp_replace(kept, r"\n{3,}", "\n\n")), c


def trim_conclusion(h: Column, b: Column, c: Column) -> Parts:
    """The conclusion loses the tail of a question, and one "được"."""
    pattern = P.spaced(LIKE + r"^(Như vậy,~*)(.+?)(~+(?:được~+)?quy định(?:~+tại.*)?\.)$")
    new = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, pattern, 2), SHORT_TAIL, ""), "^[ ?]+|[ ?]+$", "")
    c = F.when(new != "", F.concat(F.regexp_extract(c, pattern, 1), new, F.regexp_extract(c, pattern, 3))).otherwise(c)
    once = P.spaced(LIKE + "^(.*?)~+được quy định tại~+(.*)$")
    return h, b, F.when(c.rlike(once), F.regexp_replace(c, once, "$1 quy định tại $2")).otherwise(c)


def article_of_body(h: Column, b: Column, c: Column) -> Parts:
    """A header that cites nothing takes the article that the body begins with; chunks lose the mark of the header's article."""
    mark = P.spaced(LIKE + "^~*Điều~+([0-9]+[A-Za-z]?)~*[.:]~*")
    topic, first = fallback_topic(h), F.regexp_extract(b, mark, 1)
    h = F.when((topic != "") & (first != ""), F.concat(F.lit("Căn cứ theo Điều "), first, F.lit(" quy định về "), T.strip(topic), F.lit(" như sau:"))).otherwise(h)
    cited = F.lower(F.regexp_extract(h, LIKE + _EDGE_L + ART + _EDGE_R, 1))
    marked = F.split(F.regexp_replace(b, f"({GAP})", "\ue001$1\ue001"), "\ue001", -1)
    new = F.transform(marked, lambda x: F.when((cited != "") & (F.lower(F.regexp_extract(x, mark, 1)) == cited), F.regexp_replace(x, mark, "")).otherwise(x))
    return h, T.strip(F.array_join(new, "")), c


def conclude(question: Column) -> Callable[[Column, Column, Column], Parts]:
    """The conclusion in its last form, whatever stood there."""
    asked = T.strip(T.rstrip_chars(T.strip(T.text_of(question)), " ?."))
    return lambda h, b, c: (h, b, F.concat(F.lit("Như vậy, theo quy định trên thì "), asked, F.lit(".")))


def apply_rule(df: DataFrame, rule: Callable[[Column, Column, Column], Parts]) -> DataFrame:
    h, b, c = rule(F.col("h"), F.col("b"), F.col("c"))
    return df.withColumns({"h": h, "b": b, "c": c})


def cite_by_name(df: DataFrame, names: DataFrame, only: bool = False) -> DataFrame:
    """The document cited in h under its name, if (code, name) has its code; only: and if it names no second code."""
    pattern = P.spaced(LIKE + "^(.*?" + _EDGE_L + r"Điều~+[0-9]+[A-Za-z]?~+)(.+?)(~+(?:quy định~+)?về~+.*)$")
    codes = F.array_distinct(F.transform(F.regexp_extract_all(F.col("_doc"), F.lit(f"{LIKE}{_EDGE_L}({LAW_CODE}){_EDGE_R}"), F.lit(1)), F.upper))
    rows = df.withColumn("_doc", F.regexp_extract("h", pattern, 2)).withColumn("_codes", codes)
    rows = rows.withColumn("_code", F.when(F.size("_codes") == 1 if only else F.size("_codes") >= 1, F.try_element_at("_codes", F.lit(1))))
    table = names.select(F.upper("code").alias("_code"), F.col("name").alias("_name")).dropDuplicates(["_code"])
    rows = rows.join(table, "_code", "left")
    new = F.concat(F.regexp_extract("h", pattern, 1), "_name", F.regexp_extract("h", pattern, 3))
    return rows.withColumn("h", F.when(F.col("_name").isNotNull(), new).otherwise(F.col("h"))).drop("_doc", "_codes", "_code", "_name")


def override(df: DataFrame, headers: DataFrame, key: str = "qid") -> DataFrame:
    """Headers given for single questions (key, header) replace what the rules made."""
    return df.join(headers.select(key, F.col("header").alias("_h")).dropDuplicates([key]), key, "left").withColumn("h", F.coalesce("_h", "h")).drop("_h")


def normalise(df: DataFrame, names: DataFrame | None = None, headers: DataFrame | None = None, question: str = "question", answer: str = "answer") -> DataFrame:
    """df with the answer after all rules in their order; written between, as the driver's memory is too small for one plan of them all."""
    rows = split_parts(materialize(df, "answers"), answer)
    for rule in (cite_from_conclusion, citation_wording):
        rows = apply_rule(rows, rule)
    if names is not None:
        rows = cite_by_name(rows, names)
    for some in ((trim_topic, add_clause, drop_upper_headings), (trim_conclusion, article_of_body, conclude(F.col(question)))):
        rows = materialize(rows, "answers")
        for rule in some:
            rows = apply_rule(rows, rule)
    if names is not None:
        rows = cite_by_name(rows, names, only=True)
    if headers is not None:
        rows = override(rows, headers)
    return rows.withColumn(answer, joined(F.col("h"), F.col("b"), F.col("c"))).drop("h", "b", "c")
