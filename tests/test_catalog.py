"""Names of their own, numbering without one ordered task, and latency windows over stretches."""

from __future__ import annotations

import random

import numpy as np
import pytest

from halyard.operators import catalog as C
from halyard.operators import evaluate as E


def probed(wanted, taken):
    """Names one after the other, each probing until it finds a free one."""
    used, out = set(taken), []
    for i, base in sorted(wanted):
        name, k = base, 0
        while name in used:
            k += 1
            name = f"{base}_{k}"
        used.add(name)
        out.append((i, base, name))
    return out


@pytest.mark.parametrize(
    ("names", "taken"),
    [
        (["a", "a", "a_1"], []),
        (["a_1", "a", "a", "a"], []),
        (["a", "a", "a"], ["a", "a_1", "a_3"]),
        (["a_1", "a_1", "a", "a", "a_1_1", "a_1", "a_1_1"], ["a_2"]),
        (["b"] * 40 + ["c_01", "c", "c", "c_0", "_1", "_1", "", "", "x_", "x_"], ["b_5", "c_1"]),
        ([], ["a"]),
    ],
)
def test_unique_names(spark, names, taken):
    wanted = list(enumerate(names))
    got = C.unique_names(spark.createDataFrame(wanted, "id long, name string"), spark.createDataFrame([(x,) for x in taken], "name string"))
    rows = sorted((r["id"], r["name"], r["unique_name"]) for r in got.collect())
    assert rows == probed(wanted, taken)
    assert len({r[2] for r in rows} | set(taken)) == len(rows) + len(taken)


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_of_many(spark, seed):
    rng = random.Random(seed)
    make = lambda: rng.choice("ab") + "".join(f"_{rng.randint(1, 3)}" for _ in range(rng.choice([0, 0, 1, 2])))
    wanted, taken = [(i, make() if rng.random() < 0.6 else "hot") for i in range(400)], {make() for _ in range(6)} | {"hot_7"}
    got = C.unique_names(spark.createDataFrame(wanted, "id long, name string").repartition(5), spark.createDataFrame([(x,) for x in taken], "name string"))
    assert sorted((r["id"], r["name"], r["unique_name"]) for r in got.collect()) == probed(wanted, taken)


@pytest.mark.parametrize("part_rows", [10, E.PART_ROWS])
def test_places_within_a_key(spark, monkeypatch, part_rows):
    monkeypatch.setattr(E, "PART_ROWS", part_rows)
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "cold", None]), rng.randint(0, 40)) for i in range(500)]
    got = E.placed(spark.createDataFrame(rows, "id long, k string, t long").repartition(4), "k", ["t", "id"], parts=7).collect()
    want = {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want.setdefault(k, []).append(i)
    assert {r["id"]: r["nth"] for r in got} == {i: n for ids in want.values() for n, i in enumerate(ids)}


@pytest.mark.parametrize("stretch", [60, 10_000])
def test_latency_windows_reach_over_stretches(spark, stretch):
    rng = random.Random(6)
    rows = [(i, rng.choice("xxxy"), i * 10 // 3, rng.random()) for i in range(600)]
    got = E.latency(spark.createDataFrame(rows, "event_id long, k string, ts long, value double"), key="k", ts="ts", value="value", stretch=stretch)
    for r in got.collect():
        mine = [v for i, k, t, v in sorted(rows, key=lambda x: (x[2], x[0])) if k == r["k"] and (t, i) <= (rows[r["event_id"]][2], r["event_id"])][-50:]
        assert np.allclose((r["p50"], r["p95"]), np.quantile(mine, (0.5, 0.95)))
