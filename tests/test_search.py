"""Hashed search against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from vellum.operators import index, search


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def recall(points, asks, k=10):
    true = {(r.query_id, r.vec_id) for r in index.cosine_topk(points, points.filter(asks), k).collect()}
    got = search.cosine_topk_lsh(points, asks, k).collect()
    assert len({(r.query_id, r.vec_id) for r in got}) == len(got)
    return len(true & {(r.query_id, r.vec_id) for r in got}) / len(true), got


def clustered(rng, n, dim=32, centres=40):
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("n", [1000, 4000])
def test_recall_on_clusters_and_share_read(spark, n):
    x = clustered(np.random.default_rng(n), n)
    points = table(spark, x).repartition(4)
    found, got = recall(points, F.col("vec_id") % 25 == 0)
    assert found >= 0.9
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert search.choose(unit[:2000], n, 10, 0.97).share < 0.35
    for r in got:
        assert r.score == pytest.approx(float(unit[r.query_id] @ unit[r.vec_id]), abs=1e-8)


def test_recall_on_given_vectors(spark):
    points = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert recall(points, F.col("vec_id") % 10 == 0)[0] >= 0.9


def test_ranks_copies_and_odd_vectors(spark):
    x = np.eye(4)
    rows = [(i, x[i % 4].tolist()) for i in range(200)] + [(500, None), (501, []), (502, [0.0] * 4), (503, [float("nan")] * 4), (504, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0]), (505, [1.0, None, 0.0, 0.0])]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in search.cosine_topk_lsh(points, F.col("vec_id").isin(3, 198, 500, 502, 504), 3).collect())
    assert [g for g in got if g[3] == 1.0] == [(3, 1, 3, 1.0), (3, 2, 7, 1.0), (3, 3, 11, 1.0), (198, 1, 2, 1.0), (198, 2, 6, 1.0), (198, 3, 10, 1.0)] and len(got) == 6
    assert search.cosine_topk_lsh(points.limit(0), F.col("vec_id") == 3).count() == 0
    assert search.cosine_topk_lsh(points.filter("vec_id >= 500 AND vec_id < 504"), F.lit(True)).count() == 0


def test_store_is_searched_with_any_queries(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = clustered(rng, 1500)
    search.LshStore.build(table(spark, x), str(tmp_path / "i"), k=10)
    store = search.LshStore(spark, str(tmp_path / "i"))
    q = x[::50] * 3 + 0.05 * rng.normal(size=(30, 32))
    odd = [(900, None), (901, [0.0] * 32), (902, [1.0]), (None, x[0].tolist())]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + odd, "query_id long, embedding array<double>")
    got = store.search(queries, 5).collect()
    unit, qn = x / np.linalg.norm(x, axis=1)[:, None], q / np.linalg.norm(q, axis=1)[:, None]
    true = {(i, int(j)) for i, row in enumerate(qn @ unit.T) for j in np.argsort(-row)[:5]}
    assert len(true & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(true)
    assert all(r.score == pytest.approx(float(qn[r.query_id] @ unit[r.vec_id]), abs=1e-8) for r in got)
    assert {r.query_id for r in got} == set(range(30)) and max(r["rank"] for r in got) == 5
    with pytest.raises(ValueError, match="10 neighbours"):
        store.search(queries, 11)
    with pytest.raises(ValueError, match="no points"):
        search.LshStore.build(table(spark, np.zeros((3, 4))), str(tmp_path / "j"))


def test_plan_has_no_nested_loop(spark):
    plan = search.cosine_topk_lsh(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_searches_send_no_pairs(spark):
    points = table(spark, np.random.default_rng(2).normal(size=(3000, 8)))
    asks = F.col("vec_id") % 50 == 0
    for met in (index.cosine_topk(points, points.filter(asks), 3), search.cosine_topk_lsh(points, asks, 3)):
        assert met.count() == 180
        assert "MapInArrow" in met._jdf.queryExecution().executedPlan().toString()


def test_best_orders_ties_and_odd_scores():
    s = np.array([[0.1, 0.5, 0.5 + 1e-12, np.nan, -1.0], [2.0, 2.0, 2.0, 2.0, 2.0]])
    row, column, score = index.best(s, 3)
    assert row.tolist() == [0, 0, 0, 1, 1, 1] and column.tolist() == [3, 1, 2, 0, 1, 2]
    assert np.isnan(score[0]) and score[1:].tolist() == [0.5, 0.5, 2.0, 2.0, 2.0]
    assert [len(a) for a in index.best(s[:, :2].copy(), 3)] == [4, 4, 4]


def test_meeting_chance_is_that_of_drawn_projections():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 64)) / 8
    d = float(np.linalg.norm(a - b))
    u = rng.normal(size=(20_000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    for width in (0.1, 0.4, 1.5):
        shift = rng.random(len(u)) * width
        hit = (np.floor((u @ a + shift) / width) == np.floor((u @ b + shift) / width)).mean()
        assert search.meet(np.array([d]), width, 64)[0] == pytest.approx(hit, abs=0.02)
