from __future__ import annotations

import random

import numpy as np
import pytest

from halyard.config import Knobs
from halyard.operators import evaluate as E
from halyard.operators import search as S

NAN = float("nan")


def index(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, embedding array<double>")


def test_invalid_and_unequal_vectors_match_nothing(spark):
    i = index(spark, [(1, [1.0, 0.0]), (2, [NAN, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [0.6, 0.8]), (7, [1.0])])
    out = S.score(i, queries(spark, [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [NAN, 1.0]), (2, [1.0])]))
    assert {(r["query_id"], r["vec_id"], round(r["score"], 6)) for r in out.collect()} == {(0, 1, 1.0), (0, 6, 0.8), (2, 7, 1.0)}


def test_blocks_of_queries_agree(spark):
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    i, q = index(spark, [(k, vec()) for k in range(30)]), queries(spark, [(k % 5, vec()) for k in range(15)])
    key = lambda df: sorted((r["query_id"], r["vec_id"], round(r["score"], 9)) for r in df.collect())
    assert key(S.score(i, q)) == key(S.score(i, q, query_bytes=100))


def brute(scores, k):
    """scores: id -> score; the reference semantics on one list."""
    order = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    near = [x for x in order if x[1] >= order[0][1] * k.ratio] if order else []
    hit = [x for x in near if (x[1] >= k.threshold if k.inclusive else x[1] > k.threshold)]
    return [i for i, _ in (hit[: k.top_k] if hit else near[: k.fallback])]


@pytest.mark.parametrize("knobs", [Knobs(), Knobs(0.5, 0.9, 2, 3), Knobs(0.3, 0.5, None, 2, False), Knobs(0.1, 0.0, 5), Knobs(2.0, 0.75, None, 4)])
def test_cut_is_the_reference_rule(spark, knobs):
    rng = random.Random(7)
    lists = {q: {i: round(rng.choice([-1, 1, 1]) * rng.random(), 1) for i in range(rng.randint(0, 12))} for q in range(12)}
    lists[99] = {1: 0.19, 2: 0.19, 3: 0.18}
    df = spark.createDataFrame([(q, i, float(s)) for q, x in lists.items() for i, s in x.items()], "query_id long, vec_id long, score double")
    out = {}
    for r in S.cut(df, knobs).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    assert out == {q: w for q, x in lists.items() if (w := brute(x, knobs))}


@pytest.mark.parametrize("n", [0, 1, 30, 31, 60])
def test_pages_partition_the_list(spark, n):
    df = spark.createDataFrame([(0, i, float(-i), i + 1) for i in range(n)], "query_id long, vec_id long, score double, rank long")
    pages = [[r["vec_id"] for r in S.page(df, p).orderBy("rank").collect()] for p in range(4)]
    assert sum(pages, []) == list(range(n)) and all(len(p) <= 30 for p in pages)
    marked = S.with_page(df).collect()
    assert {r["page"] for r in marked if r["is_last_page"]} == ({(n - 1) // 30} if n else set())


def test_near_duplicates_find_every_pair(spark):
    rng = random.Random(3)

    def unit():
        v = [rng.gauss(0, 1) for _ in range(6)]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    rows = [(i, unit()) for i in range(60)]
    rows += [(100 + i, [a + rng.gauss(0, 0.02) for a in v]) for i, v in rows[:20]]
    rows = [(i, [x / sum(y * y for y in v) ** 0.5 for x in v]) for i, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for t in (0.97, 0.5):
        want = {(i, j) for i, v in rows for j, w in rows if i < j and dot(v, w) >= t}
        assert {(r["a"], r["b"]) for r in S.near_duplicates(index(spark, rows), t).collect()} == want


def test_image_to_image_leaves_itself_out(spark):
    i = index(spark, [(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0])])
    assert [(r["query_id"], r["vec_id"]) for r in S.image_to_image(i, i.filter("vec_id = 1")).collect()] == [(1, 2)]


def test_metrics_of_empty_sets(spark):
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    res = spark.createDataFrame([(2, 10), (4, 10), (4, 11)], "query_id long, id long")
    tru = spark.createDataFrame([(3, 10), (4, 10), (4, 12), (4, 13)], "query_id long, id long")
    out = {r["query_id"]: (r["precision"], r["recall"], round(r["f1"], 6)) for r in E.set_metrics(res, tru, q).collect()}
    assert out == {1: (1.0, 1.0, 1.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0), 4: (0.5, 1 / 3, 0.4)}


def test_sweep_is_cut_for_each_setting(spark):
    rng = random.Random(5)
    rows = [(q, i, round(rng.random(), 2)) for q in range(6) for i in range(8)]
    df = spark.createDataFrame(rows, "query_id long, id long, score double")
    grid = E.knob_grid((0.2, 0.9, 1.5), (0.5, 0.9), (2, 5), (0, 2))
    got = {}
    for r in E.sweep(df, grid).collect():
        got.setdefault((r["config"], r["query_id"]), set()).add(r["id"])
    want = {(c, q): set(w) for c, k in enumerate(grid) for q in range(6) if (w := brute({i: s for x, i, s in rows if x == q}, k))}
    assert got == want


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "score double, relevant boolean")
    assert E.roc_auc(df).first()["auc"] == 0.875
    assert E.youden(df).first()["score"] == 0.9
    assert E.cut_at_tpr(df, 0.9).first()["score"] == 0.5


def unit_rows(rng, n, dim):
    v = rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("knobs", [Knobs(), Knobs(0.2, 0.9, 2, 3), Knobs(0.3, 0.5, None, 2, False), Knobs(-0.5, 0.0, 5), Knobs(2.0, 0.75, None, 4), Knobs(-2.0, 0.5, 3, 3)])
def test_pruned_search_is_the_whole_one(spark, knobs):
    """Batches of a few rows, so that each prunes by its own best."""
    rng = np.random.default_rng(3)
    v = unit_rows(rng, 90, 5)
    v[40:50] = v[30:40]  # ties
    v[0:3] = -np.abs(v[0:3])
    i, q = index(spark, [(k, x.tolist()) for k, x in enumerate(v)]).repartition(3), queries(spark, [(k, v[k].tolist()) for k in (0, 5, 31, 44)] + [(5, v[7].tolist()), (200, np.abs(v[9]).tolist())])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    key = lambda df: sorted((r["query_id"], r["vec_id"], r["rank"], round(r["best"], 9)) for r in df.collect())
    try:
        for itself in (False, True):
            assert key(S.search(i, q, knobs, exclude_self=itself)) == key(S.cut(S.score(i, q, exclude_self=itself), knobs))
        first = lambda df: sorted((r["query_id"], r["vec_id"], r["rank"]) for r in df.collect())
        assert first(S.nearest(i, q, 6)) == first(S.top_k(S.score(i, q), 6))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_two_stages_score_candidates_only(spark):
    rng = np.random.default_rng(5)
    i = index(spark, [(k, x.tolist()) for k, x in enumerate(unit_rows(rng, 80, 6))])
    q = queries(spark, [(k, x.tolist()) for k in (0, 1, 2) for x in unit_rows(rng, 2, 6)])
    heads = queries(spark, [(0, unit_rows(rng, 1, 6)[0].tolist()), (2, unit_rows(rng, 1, 6)[0].tolist())])
    knobs = Knobs(0.1, 0.3, 8, 2)
    pool = S.top_k(S.score(i, heads.unionByName(q.filter("query_id = 1"))), 12).select("query_id", "vec_id")
    want = S.cut(S.score(i, q).join(pool, ["query_id", "vec_id"], "left_semi"), knobs)
    key = lambda df: sorted((r["query_id"], r["vec_id"], r["rank"], round(r["score"], 9)) for r in df.collect())
    assert key(S.two_stage(i, heads, q, knobs, candidates=12)) == key(want)


def test_equal_vectors_link_to_the_first(spark):
    v = unit_rows(np.random.default_rng(1), 2, 4)
    rows = [(k, v[0].tolist()) for k in range(50)] + [(60, (v[0] * 0.999 + v[1] * 0.01).tolist()), (61, v[1].tolist())]
    got = {(r["a"], r["b"]) for r in S.near_duplicates(index(spark, rows), 0.97).collect()}
    assert got == {(0, k) for k in range(1, 50)} | {(0, 60)}


def test_bands_of_planes_reach_their_recall_and_prune(spark):
    """512 dimensions, where cells of coordinates would be all pairs."""
    rng = np.random.default_rng(2)
    v = unit_rows(rng, 3000, 512)
    near = v[:1500] + rng.normal(size=(1500, 512)) * (0.245 / 512**0.5) * rng.uniform(0.2, 1, (1500, 1))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    i = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(np.concatenate([v, near]))], "vec_id long, embedding array<double>")
    scores = np.einsum("ij,ij->i", v[:1500], near)
    want = {(k, 3000 + k) for k in np.flatnonzero(scores >= 0.97).tolist()}
    got = {(r["a"], r["b"]) for r in S.near_duplicates(i, 0.97, recall=0.95).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 1000
    planes, bands = S.band_plan(10**9, 0.97, 0.95)
    assert planes == 20 and bands < 20  # a billion rows: 20 groups of a thousand each to look at
    assert S.band_plan(4500, 0.97, 0.95)[0] == 3
