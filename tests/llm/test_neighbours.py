import random

import numpy as np
import pytest

WIDE = {"width": 20.0, "functions": 3, "probes": 27, "block_rows": 16}  # every bucket is visited: an exact search


def units(rows):
    x = np.array(rows, np.float32).astype(float)
    return x / np.linalg.norm(x, axis=1)[:, None]


def brute_force(ids, rows, k=5):
    x = units(rows)
    sim = np.round(x @ x.T, 12)
    return {i: [ids[c] for c in sorted((c for c in range(len(ids)) if c != r), key=lambda c: (-sim[r, c], ids[c]))[:k]] for r, i in enumerate(ids)}


def neighbours(spark, rows, **options):
    from grainlake.llm.neighbours import nearest_chunks

    found = {}
    for r in nearest_chunks(spark.createDataFrame(rows, "chunk_id bigint, vec array<float>"), **options).orderBy("chunk_id", "place").collect():
        found.setdefault(r["chunk_id"], []).append(r["neighbour"])
    return found


def test_same_as_brute_force_where_every_bucket_is_visited(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(60)]
    bad = [(200, None), (201, [1.0] * 63), (202, [0.0] * 64), (203, [float("nan")] + [1.0] * 63), (204, [None] + [1.0] * 63), (205, [float("inf")] * 64), (None, [1.0] * 64), (206, [])]
    assert neighbours(spark, rows + rows[:3] + bad, **WIDE) == brute_force([r[0] for r in rows], [r[1] for r in rows])


def test_copies_and_scaled_copies(spark):
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(8)]
    rows = [(100 + i, base[0]) for i in range(40)] + [(i, [4 * x for x in base[1]]) for i in range(3)] + [(50, base[1])] + [(60 + i, b) for i, b in enumerate(base[2:])]
    assert neighbours(spark, rows, **WIDE) == brute_force([r[0] for r in rows], [r[1] for r in rows])


def test_few_rows_and_none(spark):
    one = [(1, [1.0] * 64)]
    assert neighbours(spark, one) == {}
    assert neighbours(spark, []) == {}
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(4)]
    assert {k: sorted(v) for k, v in neighbours(spark, rows).items()} == {i: [j for j in range(4) if j != i] for i in range(4)}


@pytest.mark.parametrize("hot", [False, True])
def test_recall_with_the_production_parameters(spark, hot):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 64))
    rows = [(i, (centres[i % 60 if not hot or i % 3 else 0] + 0.6 * rng.normal(size=64)).tolist()) for i in range(3000)]
    want = brute_force([r[0] for r in rows], [r[1] for r in rows])
    got = neighbours(spark, rows, block_rows=500)
    assert all(len(got[i]) == 5 for i in want)
    assert sum(len({*got[i]} & {*want[i]}) for i in want) >= 0.9 * 5 * len(want)


def test_clashing_columns(spark):
    from grainlake.llm.neighbours import neighbour_pairs

    df = spark.createDataFrame([(i, [float(i + 1), 2.0] * 32, 1, "x") for i in range(3)], "chunk_id bigint, vec array<float>, code int, `class` string")
    assert sorted(map(tuple, neighbour_pairs(df).collect())) == [(0, 1), (0, 2), (1, 2)]
