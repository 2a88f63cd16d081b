"""All pairs of an index and its queries: what a task holds, and what leaves the scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from halyard.operators import evaluate as E
from halyard.operators import search as S
from halyard.plans import retrieval as R

DATA = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], label) for i, v, label in rows], "vec_id long, embedding array<double>, label int").repartition(3)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_a_task_holds_some_scores_at_once(monkeypatch):
    monkeypatch.setattr(S, "CELLS", 60)
    rng = np.random.default_rng(1)
    rows, asked = rng.normal(size=(20, 3)), rng.normal(size=(17, 3))
    names = sorted(int(x) for x in rng.integers(0, 9, 17))
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(rows.tolist())], names=["k", "v"])
    schema = S.T.StructType([S.T.StructField("q", S.T.LongType()), S.T.StructField("k", S.T.LongType()), S.T.StructField("score", S.T.DoubleType())])
    out = list(S.scorer(S.Asked(names, list(asked)), S.Prune(None, None, None, True), schema)(iter([batch])))
    assert max(b.num_rows for b in out) <= 60 < sum(b.num_rows for b in out)
    got = {(q, k): s for b in out for q, k, s in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    want = {(q, k): max(asked[i] @ rows[k] for i in range(17) if names[i] == q) for q in names for k in range(20) if k != q}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_tally_is_that_of_all_pairs(spark, small_batches):
    """Labels that are null, scores beyond the arrays, halves between places, copies."""
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(60, 4)), 1)
    v[7] = v[3] * 9
    v[20:30] = v[20]
    rows = [(i, x, None if i % 11 == 0 else i % 3) for i, x in enumerate(v)]
    index = table(spark, rows)
    queries = index.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    pairs = [(float(a @ b), None if k is None or m is None else k == m) for i, a, k in rows if i % 5 == 0 for j, b, m in rows if i != j]
    for width in (1e-6, 0.02):
        got = S.tally(index, queries, width, exclude_self=True)
        want = E.tallied(spark.createDataFrame(pairs, "score double, relevant boolean"), width=width)
        key = lambda df: {(r["relevant"], r["score"]): r["pairs"] for r in df.collect()}
        assert key(got) == key(want)
    got = {r["relevant"]: r for r in E.distribution(S.tally(index, queries, 1e-6, exclude_self=True)).collect()}
    for which in (True, False, None):
        x = np.array([s for s, r in pairs if r is which])
        r = got[which]
        assert r["n"] == len(x)
        assert np.allclose([r["mean"], r["std"]], [x.mean(), x.std(ddof=1)], rtol=1e-12)
        assert np.allclose([r[f"p{p}"] for p in (10, 25, 50, 75, 95)], np.quantile(np.round(x, 6), [0.1, 0.25, 0.5, 0.75, 0.95]), atol=1e-9)


@pytest.mark.parametrize("block_bytes", [S.BLOCK_BYTES, 300])
def test_pair_tally_is_that_of_every_row_with_all_others(spark, monkeypatch, small_batches, block_bytes):
    """Keys on several rows, null keys and labels, two lengths, scores beyond the arrays, halves between places, copies."""
    monkeypatch.setattr(S, "CELLS", 40)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(90, 4)) * 8) / 8  # so that sums of products are exact in any order
    v[7] = v[3] * 9e6
    v[20:30] = v[20]
    rows = [(None if i == 50 else i // 2 if i < 12 else i, x[:3] if i % 10 == 9 else x, None if i % 11 == 0 else i % 3) for i, x in enumerate(v)]
    known = [r for r in rows if r[0] is not None and r[2] is not None]
    pairs = [(float(a @ b), k == m) for i, a, k in known for j, b, m in known if i != j and len(a) == len(b)]
    for width in (1e-6, 1 / 32):
        want = E.tallied(spark.createDataFrame(pairs, "score double, relevant boolean"), width=width)
        count = lambda df: {(r["relevant"], r["score"]): r["n"] for r in df.groupBy("relevant", "score").agg(S.F.sum("pairs").alias("n")).filter("n <> 0").collect()}
        assert count(S.pair_tally(table(spark, rows), width, block_bytes=block_bytes)) == count(want)


def test_pair_tally_counts_many_in_one_place(spark):
    rows = [(i, [1.0, 0.0], i % 2) for i in range(1500)]
    got = S.pair_tally(table(spark, rows), 1e-6).groupBy("relevant").agg(S.F.sum("pairs").alias("n"), S.F.max("score").alias("s"), S.F.min("score").alias("t")).collect()
    assert sorted(tuple(r) for r in got) == [(False, 2 * 750 * 750, 1.0, 1.0), (True, 2 * 750 * 749, 1.0, 1.0)]


def test_threshold_comes_from_all_rows(spark, tmp_path):
    """Rows whose id is divisible by 20 score otherwise than the rest."""
    odd = [(i, [1.0, 0.0, 0.0], 0) for i in range(0, 100, 20)]
    rest = [(i, [0.0, 0.8, 0.6] if i % 2 else [0.0, 0.6, 0.8], i % 2) for i in range(100) if i % 20]
    table(spark, odd + rest).write.parquet(f"{tmp_path}/embeddings.parquet")
    (r,) = R.threshold_at_tpr(spark, str(tmp_path)).collect()
    n = {0: 45, 1: 50}  # of the rest, by label
    relevant = [1.0] * (5 * 4 + sum(k * (k - 1) for k in n.values())) + [0.0] * (2 * 5 * n[0])
    assert (r["score"], r["tpr"], r["fpr"]) == (1.0, round(relevant.count(1.0) / len(relevant), 6), 0.0)


def test_distribution_of_one(spark):
    r = E.distribution(spark.createDataFrame([(0.5, True)], "score double, relevant boolean")).first()
    assert (r["n"], r["mean"], r["std"], r["p10"], r["p95"]) == (1, 0.5, None, 0.5, 0.5)


@pytest.mark.parametrize("stretch", [5, 1000])
def test_running_best_over_equal_keys(spark, small_batches, stretch):
    """Rows of one key share their best, as in SQL, wherever batches and parts end."""
    rng = np.random.default_rng(4)
    rows = [(i if i < 30 or i % 9 else 31, x, 0) for i, x in enumerate(rng.normal(size=(80, 3)))] + [(200, [1.0, 2.0], 0), (None, [1.0, 1.0, 1.0], 0)]
    index = table(spark, rows).withColumnRenamed("vec_id", "id")
    queries = index.filter("id in (0, 10, 40, 200)").withColumnRenamed("id", "query_id")
    got = S.running_best(index, queries, key="id", exclude_self=True, stretch=stretch).collect()
    known = [(i, np.array(v)) for i, v, _ in rows if i is not None]
    want = []
    for q, a in known:
        if q in (0, 10, 40, 200):
            mine = [(i, float(a @ b)) for i, b in known if i != q and len(a) == len(b)]
            want += [(q, i, round(max(s for j, s in mine if j <= i), 9)) for i, _ in mine]
    assert sorted((r["query_id"], r["id"], round(r["best"], 9)) for r in got) == sorted(want)


def test_report_over_pieces(spark, monkeypatch, small_batches):
    """Scores that don't fit 16 bits, that round to a negative zero, ties, halves, and a name on two rows."""
    values = [0.0312500, 0.00001, -0.00001, 0.5, -1.25, 3.2699, 0.99995, 0.12345]
    images = [(f"i{i}", [x, 0.01]) for i, x in enumerate(values * 3)] + [("i5", [0.25, 0.01]), ("j", [40000.0, 0.01]), ("k", [40000.0, 0.01])]
    texts = [(f"q{i}", [1.0 - i / 7, 0.0]) for i in range(5)]
    i = spark.createDataFrame(images, "name string, embedding array<double>").repartition(4)
    t = spark.createDataFrame(texts, "query string, embedding array<double>")
    got = {r["query"]: r for r in S.score_report(t, i).collect()}
    assert len(got) == 5
    for q, (x, _) in texts:
        want = sorted((n, f"{v * x:.4f}") for n, (v, _) in images)
        entries = [tuple(e.split("=")) for e in got[q]["matches"].split(",")]
        assert sorted(entries) == want and [n for n, _ in entries] == [n for n, _ in want]
        assert got[q]["best_score"] == 40000.0 * x and got[q]["best_name"] == "k"


def test_ten_thousandths_are_those_of_printf():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.uniform(-3, 3, 5000), np.arange(-3000, 3000) / 1e3 + 5e-5, np.arange(-200, 200) / 64, [0.0, -0.0, -1e-9, -4.9e-5, -5e-5]])
    shown = [f"{i / 1e4:.4f}" if i > S.NO_SIGN else "-0.0000" for i in S.ten_thousandths(x).tolist()]
    assert shown == [f"{v:.4f}" for v in x.tolist()]


#: Of the 12,475 pairs, how many may leave the scan.
LEAVE = {
    "confusion_diagonal": 100,
    "diagonal_rate": 100,
    "recall_at_k": 500,
    "outcome_rates": 500,
    "score_ratio": 1000,
    "score_distribution": 0,
    "roc_auc": 0,
    "youden_cut": 0,
    "threshold_at_tpr": 0,
    "knob_sweep": 1500,
    "sweep_objective": 6000,
}


@pytest.mark.parametrize("name", LEAVE)
def test_pairs_that_decide_nothing_stay_in_the_scan(spark, monkeypatch, name):
    left, score = [], S.score
    monkeypatch.setattr(S, "score", lambda *a, **b: left.append(score(*a, **b)) or left[-1])
    R.QUERIES[name](spark, DATA)
    assert sum(s.count() for s in left) <= LEAVE[name]
