"""p2, p8 and p9 on small tables with nulls, ties, repeated rows and long texts."""

import os
import random
import unicodedata

import pytest


def test_skeletons():
    from grainlake.llm.charforms import ascii_fold, canonical, skeleton

    for odd, want in (("ό", "ó"), ("ё", "ë"), ("ѐ", "è"), ("Ό", "Ó"), ("ＡＢ", "AB"), ("a​b", "ab"), ("x y", "x y"), ("hòa", "hòa"), ("ﬁ", "fi"), ("Ⅷ", "VIII"), ("ꓐ", "B")):
        assert canonical(odd) == want and skeleton(odd) == unicodedata.normalize("NFD", want)
        assert canonical(odd + "​") == want  # one form, whatever stands beside it
    assert canonical("m²") != canonical("m2") and canonical("hòa") != canonical("hoà")
    assert ascii_fold("Đόn Ё") == b"don e"


def test_lookalike_pairs_and_classes(spark):
    from grainlake.llm.lookalikes import lookalike_classes, lookalike_pairs, signatures

    rows = [("1", "hòa"), ("2", unicodedata.normalize("NFD", "hòa")), ("3", "hòa"), ("4", None), ("5", " "), ("6", "​"), (None, "hòa"), ("2", unicodedata.normalize("NFD", "hòa")), ("7", "HÒA")]
    s = signatures(spark.createDataFrame([(*r, 1) for r in rows], "qid string, question string, skel int"), "qid", "question", "t")
    assert sorted(map(tuple, lookalike_pairs(s).collect())) == [("t", "1", "2"), ("t", "2", "3")]
    assert {r["key"]: (r["class_key"], r["n_rows"], r["n_forms"]) for r in lookalike_classes(s).collect()} == {"1": ("1", 3, 2), "2": ("1", 3, 2), "3": ("1", 3, 2), "7": ("7", 1, 1)}


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_ids_equal_the_public_library(spark):
    import tiktoken

    from grainlake.llm.tokenizing import PATTERN, encode_corpus, read_ranks

    ranks = read_ranks(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "  a", "Điều 1.\n\nx  y\t z", "a" * 3000, "<|endoftext|>", "😀👍🏽", "".join(rng.choice("ab ćđ\n1,.😀") for _ in range(2000))]
    df = spark.createDataFrame([*enumerate(texts), (99, None), (0, "")], "doc_id bigint, text string")
    rows = encode_corpus(df).collect()
    assert len(rows) == len(texts) + 2
    got = {r["doc_id"]: list(r["ids"]) for r in rows}
    assert got[99] == [] and all(got[i] == library.encode_ordinary(t) for i, t in enumerate(texts))


def test_leaks(spark):
    from grainlake.llm.leakage import leaked_stretches, leaks

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(3))
    item = [word() for _ in range(60)]
    other = [word() for _ in range(40)]
    edited = item[10:40]
    edited[8], edited[20] = "zzz", "yyy"
    thrice = item[10:34]
    thrice[5], thrice[11], thrice[17] = "z", "y", "x"
    docs = [(1, "mở đầu " + " ".join(item).upper() + " kết"), (2, "a " + ",\n".join(edited)), (3, " ".join(thrice)), (4, " ".join(item[:23])), (5, None), (6, ""), (7, " ".join(other[3:27])), (1, "mở đầu " + " ".join(item).upper() + " kết")]
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id bigint, text string, qid string")
    tests = spark.createDataFrame([("q1", None, " ".join(item)), ("q2", " ".join(other), ""), ("q3", "ngắn", None), (None, "x", "y"), ("q1", None, " ".join(item))], "qid string, question string, reference_answer string")
    assert sorted(map(tuple, leaks(d, tests).collect())) == [(1, "q1"), (2, "q1"), (7, "q2")]
    first = leaked_stretches(d, tests).filter("doc_id = 1").first()
    assert (docs[0][1][first["start"] : first["end"]]).lower() == " ".join(item) and first["n_words"] == 60
    assert leaks(d, tests.limit(0)).isEmpty() and leaks(d.limit(0), tests).isEmpty()


def test_pieces(spark):
    from grainlake.llm.splitting import split_oversized

    body = "".join(f"Câu số {i} nói về việc này. " for i in range(200))
    rows = [(1, f"lời đầu\nĐiều 1. Một\n{body}\nĐiều 2 ({'chú thích ' * 40}). Hai\nngắn"), (2, "x" * 5000), (3, None), (4, ""), (1, f"lời đầu\nĐiều 1. Một\n{body}\nĐiều 2 ({'chú thích ' * 40}). Hai\nngắn")]
    got = {}
    for r in split_oversized(spark.createDataFrame([(*x, 0) for x in rows], "id bigint, passage string, item_no int")).orderBy("id", "item_no", "piece_no").collect():
        got.setdefault((r["id"], r["item_no"]), []).append(r["piece"])
    assert set(got) == {(1, 0), (2, 0)}
    for pieces in got.values():
        assert all(len(p) <= 1200 for p in pieces) and all(a[-120:] == b[:120] for a, b in zip(pieces, pieces[1:]))  # noqa: B905
    whole = got[1, 0][0] + "".join(p[120:] for p in got[1, 0][1:])
    assert whole == rows[0][1][len("lời đầu\n") : rows[0][1].index("\nĐiều 2")].strip()


def test_groups_and_split(spark):
    from grainlake.llm.grouped_split import group_members, stratified_split

    rng = random.Random(9)
    rows = [(f"{i:04d}", f"câu {i}" + (f" theo Nghị định {rng.randint(1, 400)}/2015/NĐ-CP" if rng.random() < 0.4 else ""), rng.choice([None, 0, *range(1, 500)]), rng.choice(["a", "b", None])) for i in range(1500)]
    df = spark.createDataFrame(rows + rows[:5], "qid string, question string, asker_id bigint, topic string")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for q, text, asker, _ in rows:
        for key in ([f"a{asker}"] if asker else []) + ([text.split(" theo ")[1]] if " theo " in text else []):
            a, b = root(q), root(key)
            parent[max(a, b)] = min(a, b) if min(a, b) != key or True else a
    groups = {}
    for q, *_ in rows:
        groups.setdefault(root(q), []).append(q)
    want = {(min(g), q) for g in groups.values() for q in g if q != min(g)}
    assert {tuple(r) for r in group_members(df).collect()} == want
    split = {r["qid"]: r["split"] for r in stratified_split(df).collect()}
    assert len(split) == 1500 and all(len({split[q] for q in g}) == 1 for g in groups.values())
    assert abs(sum(s == "train" for s in split.values()) / 1500 - 0.8) < 0.05
    assert group_members(df.limit(0)).isEmpty() and stratified_split(df.limit(0)).isEmpty()
