"""What the queries over the candidates write between their steps."""

import random
from pathlib import Path

import pytest

from grainlake import session
from grainlake.plans import action_queries
from grainlake.plans.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of two tables of texts that don't compress, and the characters of these texts."""
    rng, d = random.Random(11), tmp_path_factory.mktemp("tables")
    text = lambda: " ".join(f"{rng.getrandbits(40):010x}" for _ in range(450))
    documents = [(i, "n", "l", text()) for i in range(200)]
    chunks = [(i, str(i % 10), "parent", i, text(), [rng.uniform(-1, 1) for _ in range(64)]) for i in range(1, 201)]
    spark.createDataFrame(documents, "id bigint, name string, link string, passage string").coalesce(1).write.parquet(f"{d}/selected_contexts.parquet")
    spark.createDataFrame(chunks, "chunk_id bigint, doc_id string, kind string, chunk_pos int, text string, vec array<float>").coalesce(1).write.parquet(f"{d}/parent_embeddings.parquet")
    return str(d), sum(len(r[3]) for r in documents) + sum(len(r[4]) for r in chunks)


@pytest.mark.parametrize(("name", "rows"), [("null_policy_check", 1), ("group_size_violations", 0), ("canonical_sort", 60), ("jaccard_overlap", 20)])
def test_texts_are_not_written_between_steps(spark, tables, name, rows):
    before = len(session._WRITTEN)
    assert len(getattr(action_queries, name)(spark, tables[0]).collect()) == rows
    written = [Path(p.removeprefix("file://")) for p in session._WRITTEN[before:]]
    assert written and sum(f.stat().st_size for p in written for f in p.rglob("*.parquet")) < tables[1] / 4


OTHERS = [
    ("pair_features", 40),
    ("assemble_actions", 4),
    ("pp_add_clause", 4),
    ("assemble_answer", 4),
    ("pp_canonical_lookup", 4),
    ("reconstruct_scores", 20),
    ("audit_pool", 200),
    ("bm25_number_boost", 800),
    ("bm25_topk", 800),
    ("hybrid_topdocs", 12),
    ("pp_v84", 4),
    ("pp_override", 4),
    ("pp_v80", 4),
]


@pytest.mark.parametrize(("name", "rows"), OTHERS)
def test_rankings_and_answers_write_no_texts(spark, tables, name, rows):
    before = len(session._WRITTEN)
    assert len(QUERIES[name](spark, tables[0]).collect()) == rows
    written = [Path(p.removeprefix("file://")) for p in session._WRITTEN[before:]]
    assert written and sum(f.stat().st_size for p in written for f in p.rglob("*.parquet")) < tables[1] / 4
