import numpy as np
import pytest

from tidemark.llm.neighbours import Params, Router, Tree, _cells, _packed, _unpacked, nearest

SCHEMA = "id string, v array<float>, near string"


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(float(sim[i, j]), 4), ids[j]))
        out[ids[i]] = [ids[j] for j in order[:k] if sim[i, j] >= least]
    return out


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 32))
    x = (centres[rng.integers(0, 30, 1500)] + 0.6 * rng.normal(size=(1500, 32))).astype(np.float32)
    ids = [f"i{k:04d}" for k in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = {}
    for r in nearest(df, key="id", vector="v", dim=32, k=5, params=Params(sample=1000, leaf=150, probes=3)).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    want = brute(ids, x.astype(float), 5, -2)
    hit = sum(len(set(got[i]) & set(want[i])) for i in ids) / (5 * len(ids))
    assert hit >= 0.9 and all(len(v) == 5 for v in got.values())


@pytest.mark.parametrize(
    "params",
    [Params(sample=1000, leaf=150, fan=6), Params(sample=1000, leaf=100, fan=4, tree=4), Params(sample=100, leaf=40, fan=2, tree=2)],
    ids=["two levels", "cut again where the rows lie", "hot parts in blocks"],
)
def test_recall_where_parts_are_many_or_hot(spark, params):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    of = np.where(rng.random(1500) < 1 / 3, 0, rng.integers(0, 40, 1500))  # one cluster holds a third
    x = (centres[of] + 0.6 * rng.normal(size=(1500, 32))).astype(np.float32)
    ids = [f"i{k:04d}" for k in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = {}
    for r in nearest(df, key="id", vector="v", dim=32, k=5, params=params).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    want = brute(ids, x.astype(float), 5, -2)
    hit = sum(len(set(got[i]) & set(want[i])) for i in ids) / (5 * len(ids))
    assert hit >= 0.9 and all(len(v) == 5 for v in got.values())


def test_parts_grow_with_the_collection_and_copies_do_not():
    parts = 50
    top = Router(np.random.default_rng(0).normal(size=(8, parts)), np.zeros(parts), np.full(parts, 1 / parts))
    for total in (10**6, 10**8):
        per = round(total / 2048 / parts)
        tree = Tree(top, [Router(np.random.default_rng(c).normal(size=(8, per)), np.zeros(per), np.full(per, 1 / per)) for c in range(parts)], total, 2048)
        assert tree.sizes.max() <= 4096 and (tree.blocks == 1).all()
        assert tree.route(np.random.default_rng(1).normal(size=(20, 8)).astype(np.float32), 3).shape == (20, 3)


def test_cells_meet_every_pair_once():
    n, b = 200, 3
    to, own = np.zeros((n, 1), int), np.arange(n)
    row, part, cell, q, i = _cells(to, np.ones((n, 1), bool), own, np.full((n, 1), b))
    met = {}
    for c in range(b * b):
        for x in row[(cell == c) & q]:
            for y in row[(cell == c) & i]:
                met[x, y] = met.get((x, y), 0) + 1
    assert len(met) == n * n and set(met.values()) == {1} and np.bincount(cell).max() <= 2 * (n // b + 1)


def test_packing_keeps_cosines():
    x = np.random.default_rng(5).normal(size=(40, 33)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = _unpacked([v.tobytes() for v in _packed(x)], 33)
    assert abs(x @ x.T - y @ y.T).max() < 1e-3


def test_unusable_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 8)).astype(np.float32)
    rows = [(f"b{i:02d}", v.tolist(), "x") for i, v in enumerate(base)]
    rows += [(f"c{i:02d}", base[0].tolist(), "x") for i in range(12)] + [("scaled", (base[1] * 3).tolist(), "x"), rows[5]]
    rows += [("null", None, "x"), ("short", [1.0], "x"), ("zero", [0.0] * 8, "x"), ("nan", [float("nan")] * 8, "x"), ("inf", [float("inf")] + [1.0] * 7, "x"), (None, base[3].tolist(), "x")]
    got = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), key="id", vector="v", dim=8, k=5, least=0.7).collect():
        got.setdefault(r.id, []).append((r.neighbour, r.cosine))
    same = ["b00"] + [f"c{i:02d}" for i in range(12)]
    for i in same:
        assert sorted(n for n, _ in got[i]) == [s for s in same if s != i][:5]
    assert ("b01" in {n for n, _ in got["scaled"]}) and not {"null", "short", "zero", "nan", "inf"} & set(got)
    assert not any(n in {"null", "short", "zero", "nan", "inf"} for v in got.values() for n, _ in v)


def test_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), key="id", vector="v", dim=8).count() == 0
