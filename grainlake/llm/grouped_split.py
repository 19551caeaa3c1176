"""Problem 3: splits in which no asker and no cited legal document occurs twice.

Components: questions are tied by keys (a known asker, a cited document). The graph of the keys alone is small: one edge for
each distinct pair of keys that stand in one question. Its components come from minimum labels with pointer jumping, each
round written to the shared folder.
Split: grouped iterative stratification. Components are placed whole, those with the rarest outstanding label first, into the
split that needs the label most. The few components with a large share of the label are placed one by one; the many small
ones by their running count, in buckets, so that no list of components reaches the driver.

Defined results: asker null or 0 and questions without citation bind nobody; a question bound to nobody is its own component;
null topics are a label of their own; a null qid is left out; repeated rows count once; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

from grainlake.llm.charforms import ascii_fold
from grainlake.session import materialize

# Kinds of legal documents after the fold, and their one name.
KINDS = {
    "bo luat": "luat", "luat": "luat", "qh": "luat", "nghi dinh": "nd", "nd": "nd", "nghi quyet": "nq", "nq": "nq", "quyet dinh": "qd", "qd": "qd",
    "thong tu lien tich": "ttlt", "ttlt": "ttlt", "thong tu": "tt", "tt": "tt", "phap lenh": "pl", "pl": "pl", "chi thi": "ct", "ct": "ct",
}
_KIND = "|".join(sorted((k.replace(" ", r"\s+") for k in KINDS if k != "qh"), key=len, reverse=True))
_YEAR = r"(\d{4})(?!\d)"
_CITED = re.compile(rf"(?<![a-z])({_KIND})[\s,]*(?:so\s*:?)?\s*0*(\d+)\s*(?:/|-|\s+nam\s|,\s*nam\s)\s*{_YEAR}")
_BARE = re.compile(rf"(?<![\d/])0*(\d+)\s*/\s*{_YEAR}\s*/\s*({_KIND}|qh)(?![a-z])")


def cited_documents(text: str | None) -> list[str]:
    """Kind, number and year of each legal document named in a text, however it is written; distinct and sorted."""
    if not text:
        return []
    folded = ascii_fold(text).decode("ascii")
    if not any(c.isdigit() for c in folded):
        return []
    name = lambda kind: KINDS[re.sub(r"\s+", " ", kind)]
    found = {f"{name(k)}/{n}/{y}" for k, n, y in _CITED.findall(folded)}
    found |= {f"{name(k)}/{n}/{y}" for n, y, k in _BARE.findall(folded)}
    return sorted(found)


@arrow_udf(ArrayType(StringType()))
def _cited(text: pa.Array) -> pa.Array:
    return pa.array([cited_documents(t) for t in text.to_pylist()], pa.list_(pa.string()))


def binding_keys(df: DataFrame) -> DataFrame:
    """qid, keys: the known asker and the cited documents of each distinct question."""
    asker = F.when(F.col("asker_id") != 0, F.array(F.concat(F.lit("asker/"), F.col("asker_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = df.filter("qid is not null").select("qid", F.array_sort(F.array_union(asker, _cited("question"))).alias("keys"))
    return rows.dropDuplicates()


def key_components(keys: DataFrame, most_rounds: int = 60) -> DataFrame:
    """key, label: the smallest key of the component, for every key."""
    pairs = keys.filter(F.size("keys") > 1).select(F.col("keys")[0].alias("a"), F.explode(F.slice("keys", F.lit(2), F.size("keys"))).alias("b")).distinct()
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "p3-edges")
    label = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "key"), "p3-label")
    for _ in range(most_rounds):
        near = both.join(label, both.b == label.key).groupBy("a").agg(F.min("label").alias("near"))
        lower = label.join(near, label.key == near.a).select("key", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        ahead = label.select(F.col("key").alias("at"), F.col("label").alias("ahead"))
        jumped = lower.join(ahead, lower.label == ahead["at"], "left").select("key", "was", F.least("label", F.coalesce("ahead", "label")).alias("label"))
        step = materialize(jumped, "p3-label")
        label = step.select("key", "label")
        if step.filter("was <> label").isEmpty():
            return label
    raise RuntimeError("the components did not settle")


def question_groups(df: DataFrame) -> DataFrame:
    """qid, comp, n_keys: comp is a key of the component, or the qid itself of a question bound to nobody."""
    keys = materialize(binding_keys(df), "p3-keys")
    label = key_components(keys)
    rows = keys.select("qid", F.size("keys").alias("n_keys"), F.try_element_at("keys", F.lit(1)).alias("key"))
    named = rows.join(label, "key", "left")
    return named.select("qid", F.coalesce("label", "key", F.concat(F.lit("qid/"), F.col("qid"))).alias("comp"), "n_keys")


def group_members(df: DataFrame) -> DataFrame:
    """group_qid, qid: each question that has a smaller one in its component, with the smallest."""
    groups = materialize(question_groups(df).filter("n_keys > 0").groupBy("comp", "qid").agg(F.max("n_keys").alias("n_keys")), "p3-groups")
    least = groups.groupBy("comp").agg(F.min("qid").alias("group_qid"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.join(least, "comp").filter("qid <> group_qid").select("group_qid", "qid")


SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def stratified_split(df: DataFrame, label: str = "topic", splits: tuple[tuple[str, float], ...] = SPLITS, buckets: int = 256) -> DataFrame:
    """qid, split: whole components, so placed that every label comes near its share in each split.

    The labels are few (topics); their totals, at most 400 large components a label and `buckets` sums are all the driver sees.
    """
    labels = df.filter("qid is not null").select("qid", F.coalesce(F.col(label), F.lit("")).alias("label")).groupBy("qid").agg(F.min("label").alias("label"))
    members = materialize(question_groups(df).groupBy("qid").agg(F.min("comp").alias("comp")).join(labels, "qid"), "p3-members")
    counts = members.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("n"))
    comps = materialize(counts.groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("has"), F.sum("n").alias("size")), "p3-comps")
    names = [s for s, _ in splits]
    left = {r["label"]: r["n"] for r in members.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    target = {x: {s: n * share for s, share in splits} for x, n in left.items()}
    done: list[str] = []
    placed: list[DataFrame] = []
    while any(left.values()):
        rare = min((x for x in left if left[x]), key=lambda x: (left[x], x))
        used = F.array(*map(F.lit, done)) if done else F.array().cast("array<string>")
        todo = comps.filter(F.map_contains_key("has", F.lit(rare)) & ~F.arrays_overlap(F.map_keys("has"), used)).withColumn("n", F.col("has")[F.lit(rare)])
        todo = todo.select("comp", "has", "n", F.pmod(F.xxhash64("comp"), F.lit(buckets)).alias("bucket"))
        large = max(1, left[rare] / 400)
        need = dict(target[rare])
        chosen: list[tuple[str, str]] = []
        is_large = F.col("n") > large  # at most 400 of them; the others are summed by bucket, in the same job
        found = todo.groupBy(F.when(is_large, F.col("comp")).alias("comp"), F.when(~is_large, F.col("bucket")).alias("bucket")).agg(F.sum("n").alias("n")).collect()
        for r in sorted((r for r in found if r["comp"] is not None), key=lambda r: (-r["n"], r["comp"])):
            to = max(names, key=lambda s: (need[s], -names.index(s)))
            need[to] -= r["n"]
            chosen.append((r["comp"], to))
        small = todo.filter(~is_large)
        sums = {r["bucket"]: r["n"] for r in found if r["comp"] is None}
        total, open_need = sum(sums.values()), {s: max(0.0, v) for s, v in need.items()}
        scale = total / (sum(open_need.values()) or 1)
        before, run = [], 0
        for b in range(buckets):
            before.append(run)
            run += sums.get(b, 0)
        upto = F.sum("n").over(_by_bucket())
        at = F.element_at(F.array(*map(F.lit, before)), (F.col("bucket") + 1).cast("int")) + upto - F.col("n") / 2
        edge, to_small = 0.0, F.lit(names[0])
        for s in names:  # the running count falls into the stretch of one split
            to_small = F.when(F.col("at") >= edge, F.lit(s)).otherwise(to_small) if open_need[s] else to_small
            edge += open_need[s] * scale
        spread = small.withColumn("at", at).select("comp", "has", to_small.alias("split"))
        if chosen:
            named = comps.sparkSession.createDataFrame(chosen, "comp string, split string")
            spread = spread.unionByName(todo.join(F.broadcast(named), "comp").select("comp", "has", "split"))
        spread = materialize(spread, "p3-placed")
        placed.append(spread.select("comp", "split"))
        done.append(rare)
        for r in spread.select("split", F.explode("has").alias("label", "n")).groupBy("split", "label").agg(F.sum("n").alias("n")).collect():
            target[r["label"]][r["split"]] -= r["n"]
            left[r["label"]] -= r["n"]
    if not placed:
        return members.select("qid", F.lit(names[0]).alias("split"))
    where = placed[0]
    for more in placed[1:]:
        where = where.unionByName(more)
    return members.join(where, "comp").select("qid", "split")


def _by_bucket():
    from pyspark.sql import Window

    return Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(7), "comp"), "comp").rowsBetween(Window.unboundedPreceding, 0)
