import random
from collections import Counter

import numpy as np

from tidemark.llm.packing import evolve, pack


def test_island_is_valid_and_tight():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 700, 300)
    fit, labels = evolve(sizes, 1000, 5)
    loads = np.bincount(labels, weights=sizes)
    assert loads.max() <= 1000 and len(loads) <= -(-sizes.sum() // 1000) + 1 and 0.9 < fit <= 1
    again = evolve(sizes, 1000, 5)
    assert (again[1] == labels).all()
    hard = np.array([510] * 40 + [490] * 40)
    assert len(set(evolve(hard, 1000, 1)[1])) == 40


def best_fit_decreasing(sizes, capacity):
    free = []
    for x in sorted(sizes, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= x]
        if fits:
            free[min(fits)[1]] -= x
        else:
            free.append(capacity - x)
    return len(free)


def test_crossovers_happen_and_beat_best_fit_decreasing():
    better = 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        triplets = []
        for _ in range(20):  # each three fill a container, which best fit by size doesn't find
            a = int(rng.integers(380, 490))
            b = int(rng.integers(250, (1000 - a) // 2 + 1))
            triplets += [a, b, 1000 - a - b]
        sizes, births = np.array(triplets), []
        labels = min((evolve(sizes, 1000, 40 + i, None, i, births)[1] for i in range(3)), key=lambda x: len(set(x)))
        assert len(births) >= 3 * 8 and np.bincount(labels, weights=sizes).max() <= 1000
        better += len(set(labels)) < best_fit_decreasing(triplets, 1000)
        assert len(set(labels)) <= best_fit_decreasing(triplets, 1000)
    assert better >= 3


def test_islands_start_differently_and_evolution_goes_on_at_the_lower_bound():
    sizes = np.random.default_rng(9).integers(1, 300, 400)
    births = [[] for _ in range(3)]
    got = [evolve(sizes, 1000, 3, None, i, births[i]) for i in range(3)]
    assert all(births) and len({tuple(x[1]) for x in got}) == 3


def run(spark, rows, shard):
    df = spark.createDataFrame(rows, "k string, n long, units string")
    return pack(df, key="k", size="n", capacity=100, shard=shard).collect()


def test_pack(spark):
    rng = random.Random(3)
    rows = [(f"k{i % 90}", rng.choice([1, 5, 20, 35, 60, 99, 100]), "x") for i in range(200)] + [("big", 350, "x"), ("none", None, "x"), ("zero", 0, "x"), (None, 40, "x")]
    for shard in (1000, 40):
        got = run(spark, rows, shard)
        loads, by_key = Counter(), Counter()
        for r in got:
            if r.container is not None:
                loads[r.container] += r.units
                by_key[r.k] += r.units
        want = Counter()
        for k, n, _ in rows:
            want[k] += max(n or 0, 0)
        assert max(loads.values()) <= 100 and by_key == Counter({k: v for k, v in want.items() if v})
        assert {r.k for r in got if r.container is None} == {"none", "zero"}
        assert sorted((r.piece, r.first_unit, r.units) for r in got if r.k == "big") == [(0, 0, 100), (1, 100, 100), (2, 200, 100), (3, 300, 50)]
        assert len(loads) <= sum(loads.values()) / 100 * 1.1 + 2


def test_empty(spark):
    assert run(spark, [], 10) == []
