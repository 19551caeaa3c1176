"""Problem 1: items longer than a limit come out as overlapping pieces, cut at natural ends.

Item: an article of a passage, from its heading to the next heading or the end; a passage without heading is one item.
Method: pointer doubling. Every boundary gets its farthest legal successor (the next cut, overlap included); squaring the
successor table marks all cuts of the greedy chain in log2(cuts) vectorised steps, for all items of an Arrow batch at once.
A passage is one value in one task, so the boundaries are joined to their successors by binary search inside the batch:
of the passages nothing is shuffled; only the pieces given out are made distinct.

Defined results: null, empty and blank passages have no item; a null id stays null; rows with the same id and pieces count
once; an item of up to `limit` characters (white space at both ends aside) is no case; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from grainlake.llm.charforms import canonical

LIMIT, OVERLAP = 1200, 120

# The heading of an article, and the words that make "Điều 5." after a line break a reference.
_CANDIDATE = re.compile(r"^[^\w\n“\"«‘']*([ĐđÐƉＤｄ].*)", re.M)
_HEADING = re.compile(r"điều\s+\d+\s*[a-zđ]?\s*(?:\([^)\n]*\)|\[[^\]\n]*\])?\s*[.:]")
_QUOTED = re.compile(r"^[^\w\n“\"«]*[“\"«][^\w\n]*[ĐđÐƉＤｄ]", re.M)
_CLOSING = re.compile("[”\"»]")
_LEADS_ON = set("tại theo của và hoặc với cùng đến từ trong ở nếu bởi về các những khoản điểm".split())
_REFERENCE_END = re.compile(r"(?:^| )(?:khoản \d+|điểm [a-zđ]|khoản|điểm|quy định|căn cứ|chiếu|điều)$")
_SENTENCE_OVER = re.compile(r"[.;:!?…][”\"»’')\]]*$")
_WORD = re.compile(r"\w+")

# Natural ends: before a line break, and after a sentence mark that is no number of a clause or abbreviation.
_LINE_END = re.compile(r"[ \t\r\xa0]*\n")
_SENTENCE_END = re.compile(r"(?:(?<=\w\w)|(?<=[)\]%”\"»]))[.;:!?…]+[”\"»’)\]]*(?=\s)")
_NO_SENTENCE = re.compile(r"(?:^|\n)[ \t]*(?:điều[ \t]+)?\d+\w?$", re.I)
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:TP|Tp|tp|ThS|TS|GS|PGS|Mr|Mrs|Dr|No|Art|St|vs)$")
_BLANK = re.compile(r"\s+")


def article_starts(passage: str) -> list[int]:
    """Offsets of the headings that open an item."""
    starts = []
    quoted_until = -1
    quotes = [m.start() for m in _QUOTED.finditer(passage)]
    for m in _CANDIDATE.finditer(passage):
        at = m.start()
        while quotes and quotes[0] < at:  # an article quoted from another text runs to its closing mark
            closing = _CLOSING.search(passage, passage.find("Đ", quotes[0]) + 1 or quotes[0] + 2)
            quoted_until = max(quoted_until, closing.start() if closing else -1)
            quotes.pop(0)
        if at < quoted_until or not _HEADING.match(canonical(m[1]).lower()):
            continue
        before = passage[max(0, at - 120) : at].rstrip()
        if before.endswith((",", "(", "/")):
            continue
        last = canonical(before.rpartition("\n")[2][-60:]).lower().rstrip()
        tail = _WORD.findall(last)[-2:]
        if tail and not _SENTENCE_OVER.search(last) and (tail[-1] in _LEADS_ON or _REFERENCE_END.search(" ".join(tail))):
            continue
        starts.append(at)
    return starts


def items(passage: str) -> list[tuple[int, int]]:
    """Start and end of each item, white space at both ends left out."""
    starts = article_starts(passage) or [0]
    spans = []
    for a, b in zip(starts, [*starts[1:], len(passage)], strict=True):
        body = passage[a:b]
        lead = len(body) - len(body.lstrip())
        spans.append((a + lead, a + max(lead, len(body.rstrip()))))
    return spans


def natural_ends(text: str) -> np.ndarray:
    """Offsets right after clauses, paragraphs and sentences of a text."""
    ends = {m.start() for m in _LINE_END.finditer(text)}
    for m in _SENTENCE_END.finditer(text):
        head = text[max(0, m.start() - 24) : m.start()]
        if not _NO_SENTENCE.search(head) and not _ABBREVIATION.search(head):
            ends.add(m.end())
    return np.array(sorted(ends), dtype=np.int64)


def greedy_cuts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[np.ndarray]:
    """For each text the ends of its pieces; each piece starts `overlap` before the end of the one before."""
    reach = limit - overlap  # how far one cut lies behind the last
    if reach <= overlap or overlap < 0:
        raise ValueError("the limit must be more than twice the overlap")
    bases, natural, nodes = [], [], []
    base = 0
    for text in texts:
        n = len(text)
        ends = natural_ends(text)
        ends = ends[(ends > overlap) & (ends < n)]
        soft = np.concatenate(([overlap], ends, [n]))  # the first piece starts as if cut at `overlap`
        wide = np.flatnonzero(np.diff(soft) > reach)
        extra = []
        for k in wide:  # no natural end within reach: blanks, and inside very long words fixed steps
            blanks = [m.start() for m in _BLANK.finditer(text, int(soft[k]) + 1, int(soft[k + 1]))]
            stops = np.concatenate(([soft[k]], blanks, [soft[k + 1]])).astype(np.int64)
            extra.append(stops[1:-1])
            for j in np.flatnonzero(np.diff(stops) > reach):
                extra.append(np.arange(stops[j] + reach, stops[j + 1], reach))
        natural.append(base + soft[1:])
        nodes.append(base + np.unique(np.concatenate([soft, *extra])).astype(np.int64))
        bases.append(base)
        base += n + 2 * limit  # no window reaches the next text
    if not texts:
        return []
    nat, node = np.concatenate(natural), np.concatenate(nodes)
    at = np.searchsorted(nat, node + reach, "right")
    far = np.where(at > 0, nat[at - 1], -1)  # -1: no natural end so far
    any_far = node[np.searchsorted(node, node + reach, "right") - 1]
    succ = np.searchsorted(node, np.where(far > node, far, any_far))  # the successor of each boundary
    first = np.searchsorted(node, np.array(bases) + overlap)
    reached = np.zeros(len(node), bool)
    reached[first] = True
    while True:  # reached: all cuts up to 2^k; succ: 2^k cuts ahead
        more = reached.copy()
        more[succ[reached]] = True
        if (more == reached).all():
            break
        reached, succ = more, succ[succ]
    cuts = node[reached]
    split = np.searchsorted(cuts, np.array(bases[1:]))
    return [own[1:] - b for own, b in zip(np.split(cuts, split), bases, strict=True)]


_PIECES = pa.list_(pa.struct([("item_no", pa.int32()), ("piece_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _pieces_of(passages: list[str | None], limit: int, overlap: int) -> list[list[dict]]:
    """Pieces, as offsets into the passage, of the items over the limit."""
    found = [(row, no, a, b) for row, p in enumerate(passages) if p for no, (a, b) in enumerate(items(p)) if b - a > limit]
    out: list[list[dict]] = [[] for _ in passages]
    cuts = greedy_cuts([passages[row][a:b] for row, _, a, b in found], limit, overlap)
    for (row, no, a, _), ends in zip(found, cuts, strict=True):
        starts = np.concatenate(([0], ends[:-1] - overlap))
        out[row] += [{"item_no": no, "piece_no": k, "start": a + int(s), "end": a + int(e)} for k, (s, e) in enumerate(zip(starts, ends, strict=True))]
    return out


def piece_offsets(df: DataFrame, key: str = "id", text: str = "passage", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, item_no, piece_no, start, end of every piece of every item over the limit; rows are not yet distinct."""

    @arrow_udf("array<struct<item_no:int,piece_no:int,start:int,end:int>>")
    def cut(passage: pa.Array) -> pa.Array:
        return pa.array(_pieces_of(passage.to_pylist(), limit, overlap), type=_PIECES)

    # short passages need no Python: an item is never longer than its passage
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("passage")).filter(F.length("passage") > limit)
    return rows.select("id", F.explode(cut("passage")).alias("p"), "passage").select("id", "p.*", "passage")


def split_oversized(df: DataFrame, key: str = "id", text: str = "passage", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """id, item_no, piece_no, piece: pieces of at most `limit` characters, consecutive ones sharing `overlap` characters."""
    pieces = piece_offsets(df, key, text, limit, overlap)
    piece = F.col("passage").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    return pieces.select("id", "item_no", "piece_no", piece.alias("piece")).dropDuplicates()


def oversized_items(df: DataFrame, key: str = "id", text: str = "passage", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """id, item_no of the items that the operator cut, i.e. that have a second piece."""
    return piece_offsets(df, key, text, limit, overlap).filter("piece_no = 1").select("id", "item_no").dropDuplicates()
