"""Problem 9: corpus documents that hold questions or answers of a held-out test, fully or in part.

Method: one Aho-Corasick automaton over the normalised test items scans every document once. Its patterns are the disjoint
blocks of six words of each item: any stretch of 24 words of an item holds three whole blocks, so two edits leave one of them
untouched and no leak is missed. (A stretch that reaches 24 words only with words that the document adds has fewer of the item's;
it is found if a block of it is whole. Blocks of five words would find all of these too, at three times the CPU time.)
Around each hit the stretch is grown on both sides with furthest-reaching diagonals (an exact check),
and its word positions are mapped back to character offsets of the original text.

Defined results: null and blank texts and items leak nothing; items of fewer than `least` words can't leak; documents repeated
in every column count once; several stretches of one item in one document give the longest; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from grainlake.llm.charforms import ascii_fold, word_line, words

LEAST_WORDS, MOST_EDITS, BLOCK = 24, 2, 6
ITEMS_AT_ONCE, CHARS_AT_ONCE = 20_000, 16 << 20  # of test items in one automaton; more are scanned for in further passes

_RUN = re.compile("[a-z0-9]+")


def _grow(a: list[str], i: int, b: list[str], j: int, step: int, edits: int) -> list[tuple[int, int]]:
    """From a[i], b[j] on, in direction step: for 0..edits edits the most words of a and b in a stretch that ends in a match."""
    last_a, last_b = (len(a), len(b)) if step > 0 else (-1, -1)

    def slide(x: int, y: int) -> int:
        n = 0
        while x != last_a and y != last_b and a[x] == b[y]:
            x, y, n = x + step, y + step, n + 1
        return n

    best = []
    top = (0, 0)
    front = {0: slide(i, j)}  # diagonal (words of b more than of a) to words of a
    top = (front[0], front[0])
    best.append(top)
    for _ in range(edits):
        grown: dict[int, int] = {}
        for d, n in front.items():
            for more_a, more_b in ((1, 1), (1, 0), (0, 1)):
                x, y = n + more_a, n + d + more_b
                if x <= abs(last_a - i) and y <= abs(last_b - j):
                    far = slide(i + step * x, j + step * y)
                    if far and min(x, y) + far > min(top):
                        top = max(top, (x + far, y + far))
                    if grown.get(y - x, -1) < x + far:
                        grown[y - x] = x + far
        front = grown
        best.append(top)
    return best


class Scanner:
    """The automaton over the test items and the check of its hits."""

    def __init__(self, items: list[tuple[str, str]], least: int = LEAST_WORDS, edits: int = MOST_EDITS, block: int = BLOCK) -> None:
        self.least, self.edits, self.block = least, edits, block
        self.texts: list[tuple[str, list[str]]] = []
        self.near: list[dict[int, frozenset[str]]] = []
        blocks: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            own = words(text)
            if len(own) < least:
                continue
            for at in range(0, len(own) - block + 1, block):
                blocks.setdefault(" " + " ".join(own[at : at + block]) + " ", []).append((len(self.texts), at))
            far = least - block
            self.near.append({at: frozenset(own[max(0, at - far) : at] + own[at + block : at + least]) for at in range(0, len(own) - block + 1, block)})
            self.texts.append((key, own))
        self.automaton = ahocorasick.Automaton()
        for pattern, where in blocks.items():
            self.automaton.add_word(pattern, (len(pattern), where))
        if blocks:
            self.automaton.make_automaton()
        self.empty = not blocks

    def scan(self, text: str) -> dict[str, tuple[int, int, int]]:
        """Test item key to the longest leaked stretch: words of it, and its first and last word in the document."""
        if self.empty:
            return {}
        line = b" " + word_line(text) + b" "
        hits = list(self.automaton.iter(line.decode("ascii")))
        if not hits:
            return {}
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
        far = self.least - self.block
        doc = line.decode("ascii").split()
        found: dict[str, tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}  # item text and diagonal to the end of what was checked there
        for end, (size, where) in hits:
            j = bisect_left(blanks, end - size + 1)
            around = doc[max(0, j - far) : j] + doc[j + self.block : j + self.least]
            for no, i in where:
                if done.get((no, j - i), -1) > j:
                    continue
                near = self.near[no][i]  # a leak has least - edits words around here in common, this block included
                if sum(map(near.__contains__, around)) < self.least - self.edits - self.block:
                    continue
                key, own = self.texts[no]
                left = _grow(own, i - 1, doc, j - 1, -1, self.edits)
                right = _grow(own, i + self.block, doc, j + self.block, 1, self.edits)
                done[no, j - i] = j + self.block + right[0][1]
                for e in range(self.edits + 1):
                    (la, lb), (ra, rb) = left[e], right[self.edits - e]
                    n = max(la + ra, lb + rb) + self.block
                    if n >= self.least and n > found.get(key, (0,))[0]:
                        found[key] = (n, j - lb, j + self.block + rb - 1)
        return found


_FOLDS: dict[str, str] = {}


def word_offsets(text: str) -> list[tuple[int, int]]:
    """First and one-past-last character in the original text of each of its words."""
    folded, origin = [], []
    for at, ch in enumerate(text):
        if ch not in _FOLDS:
            _FOLDS[ch] = ascii_fold(ch).decode("ascii")
        folded.append(_FOLDS[ch])
        origin += [at] * len(_FOLDS[ch])
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in _RUN.finditer("".join(folded))]


_SCANNERS: dict[str, Scanner] = {}
_FOUND = pa.list_(pa.struct([("qid", pa.string()), ("n_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND_TYPE = ArrayType(StructType([StructField("qid", StringType()), *(StructField(c, IntegerType()) for c in ("n_words", "start", "end"))]))


def _scan(shared: Broadcast, name: str, least: int, edits: int, block: int):
    """A column function from text to its leaked stretches; the automaton is built once for each Python worker."""

    @arrow_udf(_FOUND_TYPE)
    def scan(text: pa.Array) -> pa.Array:
        if name not in _SCANNERS:
            _SCANNERS.clear()
            _SCANNERS[name] = Scanner(shared.value, least, edits, block)
        found = []
        for t in text.to_pylist():
            leaks = _SCANNERS[name].scan(t) if t else {}
            spans = word_offsets(t) if leaks else []
            found.append([{"qid": q, "n_words": n, "start": spans[a][0], "end": spans[b][1]} for q, (n, a, b) in leaks.items()])
        return pa.array(found, _FOUND)

    return scan


def _passes(pairs: Iterator[tuple[str, str]], most_items: int, most_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of bounded size, so that what is broadcast at once is bounded; one empty list if there are none."""
    held, chars = [], 0
    for key, text in pairs:
        if held and (len(held) >= most_items or chars + len(text) > most_chars):
            yield held
            held, chars = [], 0
        held.append((key, text))
        chars += len(text)
    yield held


def leaked_stretches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "qid", item_texts: tuple[str, ...] = ("question", "reference_answer"), least: int = LEAST_WORDS, edits: int = MOST_EDITS, block: int = BLOCK, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """doc_id, qid, n_words, start, end: the longest leaked stretch of each test item in each document, as character offsets."""
    if (least - block + 1) // block <= edits:
        raise ValueError("a stretch must hold more whole blocks than edits")
    wanted = items.filter(F.col(item_key).isNotNull()).select(item_key, *item_texts).dropDuplicates().orderBy(item_key)
    pairs = ((str(r[0]), t) for r in wanted.toLocalIterator() for t in r[1:] if t and t.strip())
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for held in _passes(pairs, items_at_once, CHARS_AT_ONCE):
        shared, name = spark.sparkContext.broadcast(held), uuid.uuid4().hex
        scan = _scan(shared, name, least, edits, block)
        part = rows.select("doc_id", F.explode(scan("text")).alias("f")).select("doc_id", "f.*")
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates()


def leaks(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """doc_id, qid of each leak."""
    return leaked_stretches(docs, items, **options).select("doc_id", "qid").dropDuplicates()
