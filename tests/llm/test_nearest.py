"""Approximate nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import nearest, queries

SCHEMA = "vec_id bigint, embedding array<double>, point bigint, vector string, id string, ids int, query int, band string, asks int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", "clash", 1, 1, "clash", 1, 0.5) for i, v in rows], SCHEMA)


def usable(rows):
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    return [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and fine(v))]


def plain(rows, k):
    rows, out = usable(rows), {}
    for n, (i, q) in enumerate(rows):
        if i % 5 == 0:
            found = sorted((-float((q * v).sum()), j) for m, (j, v) in enumerate(rows) if m != n and len(v) == len(q))
            out.setdefault(i, []).extend((rank, j, -s) for rank, (s, j) in enumerate(found[:k], 1))
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(found) for q, found in out.items()}


ODD = [
    (None, [1.0, 2.0]), (1000, None), (1001, []), (1005, [0.0, 0.0]), (1010, [1.0, None]), (1015, [float("nan"), 1.0]), (1020, [float("inf"), 1.0]),
    (1025, [3.0]), (1030, [1.0, 2.0, 3.0]), (1031, [-1.0, 2.0, 3.0]), (1032, [1e-3, 0.0, 0.0]), (1033, [1e6, 0.0, 0.0]),
]


@pytest.mark.parametrize("blocks", [(8_192, 1_024), (7, 3)])
def test_everything_visited_equals_brute_force(spark, monkeypatch, blocks):
    """With no hash that serves, every point is compared, in blocks."""
    monkeypatch.setattr(nearest, "visits_needed", lambda *_: None)
    monkeypatch.setattr(nearest, "POINT_BLOCK", blocks[0])
    monkeypatch.setattr(nearest, "QUERY_BLOCK", blocks[1])
    monkeypatch.setattr(nearest, "SAMPLE", 40)
    rng = np.random.default_rng(4)
    same = rng.normal(size=3).tolist()
    rows = [(i, same if i % 3 == 0 else (rng.normal(size=3) * 10.0 ** rng.integers(-2, 3)).tolist()) for i in range(90)] + ODD + [(5, same), (5, same)]
    out = answers(nearest.nearest(table(spark, rows), F.col("vec_id") % 5 == 0, k=6))
    expected = plain(rows, 6)
    assert expected.pop(1025) == [] if 1025 in expected else True
    assert out == {q: sorted(found) for q, found in expected.items() if found}


def test_recall_on_uniform_and_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SAMPLE", 24 * 400)
    monkeypatch.setattr(nearest, "REGION", 300)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(8, 24))
    clustered = centre[rng.integers(0, 8, 1200)] * 2 + 0.3 * rng.normal(size=(1200, 24))
    vectors = np.concatenate([rng.normal(size=(1200, 24)), clustered, np.repeat(centre[:1], 600, axis=0)])
    rows = list(enumerate(vectors.tolist()))
    out = answers(nearest.nearest(table(spark, rows), F.col("vec_id") % 5 == 0))
    hit = total = 0
    for i in range(0, len(rows), 5):
        scores = vectors @ vectors[i]
        scores[i] = -np.inf
        kth = np.sort(scores)[-20]
        assert [r for r, _, _ in out[i]] == list(range(1, 21)) and i not in [j for _, j, _ in out[i]]
        assert all(abs(scores[j] - s) < 1e-9 for _, j, s in out[i])
        hit += sum(s >= kth - 1e-9 for _, _, s in out[i])
        total += 20
    assert hit / total >= 0.9


def test_recall_of_the_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    out = answers(queries.QUERIES["op12_nearest"](spark, "/root/testdata/sf0.001"))
    vectors = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    assert set(out) == {i for i in ids if i % 20 == 0}
    hit = 0
    for i, found in out.items():
        scores = vectors @ vectors[ids == i][0]
        scores[ids == i] = -np.inf
        hit += sum(s >= np.sort(scores)[-20] - 1e-9 for _, _, s in found)
    assert hit >= 0.9 * 20 * len(out)


def test_empty_tables(spark):
    assert nearest.nearest(table(spark, []), F.col("vec_id") % 5 == 0).collect() == []
    assert nearest.nearest(table(spark, [(1, [1.0])]), F.col("vec_id") % 5 == 0).collect() == []
    assert nearest.nearest(table(spark, [(5, [1.0])]), F.col("vec_id") % 5 == 0).collect() == []


def test_visits_start_at_home_and_cross_the_nearest_border_next():
    hashes = nearest.Hashes(0, 4, 1.0, 0.5, 5, 2, 7)
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(50, 4))
    unit = hashes.asked(vectors)
    place = hashes.cells(unit, 1)
    region, bucket = hashes.visits(vectors, 1, 12, nearest.perturbations(5, 48))
    cell = np.floor(place).astype(np.int64)
    inside = place - cell
    border = np.c_[inside, 1 - inside]
    for i in range(50):
        code = lambda c: (c.astype(np.uint64) * hashes.multipliers(1)).sum(dtype=np.uint64)
        first = int(border[i].argmin())
        crossed = cell[i].copy()
        crossed[first % 5] += -1 if first < 5 else 1
        assert bucket[i, 0] == code(cell[i]) and bucket[i, 1] == code(crossed)
        assert len(set(bucket[i].tolist())) == 12
