"""Problem 7: questions of an evaluation table that also stand, word for word or nearly, in train.

Method: canonicalised hash join across the splits. Each question is folded to words, courtesy phrases taken off; the numbers
that it names must be equal and are part of every join key, and the legal documents must not differ. A change of one word destroys at most three
pairs of adjacent words, so of the rarest 3k + 6 pairs of two questions within k changes at least six are common (prefix
filter, in one global order): the hash join over these keys loses none, and an exact count of the changes follows. The keys of
the other table go to the shared folder; each task joins its own questions with them, block by block, counts and compares there,
so no pair of questions that isn't one in the result is shuffled.

Defined results: null and blank questions, and null keys, are no cases; repeated rows count once; the most changes are one
word in eight of the longer question; a word that stands elsewhere counts as one change.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from grainlake.llm.charforms import canonical, words
from grainlake.llm.grouped_split import cited_documents
from grainlake.session import materialize

WORDS_A_CHANGE = 8
IN_COMMON = 6  # keys that two questions must share; shorter ones are equal and share all they have

# Courtesy phrases after the fold, at the start and at the end.
_OPENING = re.compile(
    r"^(?:(?:da |a )?(?:xin |em |toi )?(?:kinh )?(?:chao|gui|thua) (?:luat su|quy bao|ban tu van|quy luat su|ban bien tap)(?: a)?|(?:rat )?mong (?:som )?duoc tu van|(?:da )?(?:xin )?cho (?:toi|em) (?:xin )?hoi"
    r"|(?:da )?xin hoi|(?:toi|em) (?:muon biet|muon hoi|xin hoi|co thac mac nhu sau)|(?:xin )?nho giai dap giup)(?: |$)"
)
_ENDING = re.compile(r"(?:^| )(?:(?:rat )?mong (?:som )?(?:nhan )?duoc (?:su )?(?:giai dap|phan hoi|tu van)|(?:toi |em )?(?:xin )?(?:chan thanh )?cam on(?: rat)?(?: nhieu)?(?: luat su)?(?: a)?|(?:xin )?tran trong(?: cam on)?)$")
_THOUSANDS = re.compile(r"(?<![\d.,/])\d{1,3}(?:[.,]\d{3})+(?![\d/])")
_NUMBER = re.compile(r"\d+")


def question_words(text: str) -> list[str]:
    """Folded words without courtesy phrases at either end; figures lose separators of thousands."""
    line = " ".join(words(_THOUSANDS.sub(lambda m: re.sub("[.,]", "", m[0]), canonical(text))))
    while line != (line := _ENDING.sub("", _OPENING.sub("", line)).strip()):
        pass
    return line.split()


def numbers(own: list[str]) -> str:
    """The numbers that the words of a question name, as one string."""
    return " ".join(sorted({n.lstrip("0") or "0" for w in own for n in _NUMBER.findall(w)}))


def other_document(a: list[str], b: list[str]) -> bool:
    """Whether each of two lists of cited documents names one that the other lacks; a citation cut short names none."""
    return bool(set(a) - set(b) and set(b) - set(a))


def changes(a: list[str], b: list[str]) -> int:
    """Words changed, added, left out or moved from a to b."""
    if a == b:
        return 0
    gone, come, swapped = Counter(), Counter(), []
    for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind != "equal":
            gone.update(a[i:j])
            come.update(b[k:m])
            swapped.append((a[i:j], b[k:m]))
    moved = gone & come
    n, left, more = sum(moved.values()), Counter(moved), Counter(moved)
    for x, y in swapped:  # what is not moved: the words of one gap replace each other
        rest = [0, 0]
        for side, own, budget in ((0, x, left), (1, y, more)):
            for w in own:
                if budget[w] > 0:
                    budget[w] -= 1
                else:
                    rest[side] += 1
        n += max(rest)
    return n


def same_question(a: list[str], b: list[str], words_a_change: int = WORDS_A_CHANGE) -> bool:
    """Whether at most one word in `words_a_change` of the longer one differs."""
    most = max(len(a), len(b)) // words_a_change
    bag, other = Counter(a), Counter(b)
    if max((bag - other).total(), (other - bag).total()) > most:  # a change replaces one word at most
        return False
    return min(changes(a, b), changes(b, a)) <= most


_FORM = StructType([StructField("line", StringType()), StructField("numbers", StringType()), StructField("cited", ArrayType(StringType())), StructField("pairs", ArrayType(StringType()))])
_FORM_ARROW = pa.struct([("line", pa.string()), ("numbers", pa.string()), ("cited", pa.list_(pa.string())), ("pairs", pa.list_(pa.string()))])


@arrow_udf(_FORM)
def _form(text: pa.Array) -> pa.Array:
    out = []
    for t in text.to_pylist():
        own = question_words(t) if t else []
        if not own:
            out.append(None)
            continue
        count: Counter[str] = Counter()
        pairs = []
        for x, y in zip(["^", *own], own):  # noqa: B905
            count[f"{x} {y}"] += 1
            pairs.append(f"{x} {y} {count[f'{x} {y}']}")
        out.append({"line": " ".join(own), "numbers": numbers(own), "cited": cited_documents(t), "pairs": pairs})
    return pa.array(out, _FORM_ARROW)


def _forms(df: DataFrame, side: str, key: str, text: str) -> DataFrame:
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("qid"), F.col(text).alias("text")).dropDuplicates()
    return rows.select(F.lit(side).alias("side"), "qid", _form("text").alias("f")).filter("f is not null").select("side", "qid", "f.*")


_HELD, _BLOCK, _MOST_PAIRS = 60_000, 20_000, 4_000_000  # questions of a task and of the other table at a time, pairs expanded at once


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all rows and the row of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))


def _joined(left: pa.Table, right: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of left and right that share as many keys as `need` of the left one says."""
    own, of = _keys(left.column("hs").combine_chunks())
    other, to = _keys(right.column("hs"))
    order = np.argsort(other, kind="stable")
    other, to = other[order], to[order]
    first = np.searchsorted(other, own, "left")
    met = np.searchsorted(other, own, "right") - first
    need = left.column("need").to_numpy()
    met[(np.bincount(of[met > 0], minlength=len(left)) < need)[of]] = 0
    own_met = np.cumsum(np.bincount(of, weights=met, minlength=len(left)))
    key_end = np.searchsorted(of, np.arange(len(left)), "right")
    done = 0
    while done < len(left):  # whole questions, as many as give the most pairs, one at least
        upto = max(done + 1, int(np.searchsorted(own_met, (own_met[done - 1] if done else 0) + _MOST_PAIRS, "right")))
        k = slice(key_end[done - 1] if done else 0, key_end[upto - 1])
        n = met[k]
        at = np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        code, shared = np.unique(np.repeat(of[k], n) * right.num_rows + to[at], return_counts=True)
        x, y = code // right.num_rows, code % right.num_rows
        enough = shared >= need[x]
        yield x[enough], y[enough]
        done = upto


def _matching(files: list[str]):
    """A function for mapInArrow from questions to their pairs with the same question in the files."""

    def pairs(left: pa.Table) -> Iterator[pa.RecordBatch]:
        for file in files:
            where, path = fs.FileSystem.from_uri(file)
            with where.open_input_file(path) as source:
                for right in pq.ParquetFile(source).iter_batches(batch_size=_BLOCK):
                    for x, y in _joined(left, right):
                        equal = pc.equal(left.column("numbers").take(pa.array(x)), right.column("numbers").take(pa.array(y))).to_numpy()
                        x, y = pa.array(x[equal]), pa.array(y[equal])
                        texts = (side.column(c).take(i).to_pylist() for c in ("cited", "line") for side, i in ((left, x), (right, y)))
                        same = [not other_document(c, d) and same_question(a.split(), b.split()) for c, d, a, b in zip(*texts, strict=True)]
                        same = pa.array(same, pa.bool_())
                        found = left.column("qid").take(x.filter(same)), right.column("qid").take(y.filter(same))
                        yield from pa.Table.from_arrays(list(found), names=["train_qid", "public_qid"]).combine_chunks().to_batches()

    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _HELD:
                yield from pairs(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from pairs(pa.Table.from_batches(held))

    return matching


def same_questions(train: DataFrame, other: DataFrame, key: str = "qid", text: str = "question") -> DataFrame:
    """train_qid, public_qid of each pair that is the same question."""
    both = _forms(train, "a", key, text).unionByName(_forms(other, "b", key, text))
    hashed = F.transform("pairs", lambda p: F.hash("numbers", p))  # keys that meet by chance fail the comparison
    place = F.monotonically_increasing_id()
    forms = materialize(both.select(F.when(F.col("side") == "a", place).otherwise(-1 - place).alias("row"), "qid", "line", "numbers", "cited", F.size("pairs").alias("n"), F.array_distinct(hashed).alias("hs")), "p7-forms")
    keys = forms.select("row", F.explode("hs").alias("h"))
    alike = Window.partitionBy("h")
    often = F.count_if(F.col("row") >= 0).over(alike) * F.count_if(F.col("row") < 0).over(alike)
    # rarity above, hash below, in one number; keys of one side only are the rarest, their count is enough
    ranked = keys.select("row", (F.shiftleft(F.least(often, F.lit(2**31 - 1)).cast("long"), 32) + F.col("h").cast("long").bitwiseAND(2**32 - 1)).alias("x")).filter(F.col("x") >= 2**32)
    rarest = ranked.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    # within k changes the longer question has at most 8/7 of these words, so k is at most a seventh of either
    least = 3 * F.floor(F.col("n") / (WORDS_A_CHANGE - 1)).cast("int") + IN_COMMON
    shared = F.slice("xs", F.lit(1), F.greatest(least - F.size("hs") + F.size("xs"), F.lit(0)))
    rows = forms.join(rarest.hint("merge"), "row").withColumns({"need": F.least(F.size("hs"), F.lit(IN_COMMON)), "hs": F.transform(shared, lambda x: (x.bitwiseAND(2**32 - 1) - 2**31).cast("int"))})
    rows = materialize(rows.select("row", "qid", "line", "numbers", "cited", "need", "hs").filter("size(hs) > 0"), "p7-prefix")
    kept = ["qid", "line", "numbers", "cited", "need", "hs"]
    files = sorted(materialize(rows.filter("row < 0").select(kept), "p7-other").inputFiles())
    kind = forms.schema["qid"].dataType
    schema = StructType([StructField("train_qid", kind), StructField("public_qid", kind)])
    return rows.filter("row >= 0 and size(hs) >= need").select(kept).mapInArrow(_matching(files), schema).distinct()


def pair_counts(pairs: DataFrame, other: DataFrame) -> DataFrame:
    """eval_split, site, n_questions, n_leaked: questions of the evaluation table and those of them that stand in train."""
    hit = pairs.select(F.col("public_qid").alias("qid")).distinct().withColumn("hit", F.lit(1))
    rows = other.filter("qid is not null").select("qid", "eval_split", "site").distinct().join(hit, "qid", "left")
    return rows.groupBy("eval_split", "site").agg(F.count_distinct("qid").alias("n_questions"), F.count("hit").alias("n_leaked"))
