import random

import pytest

from tidemark.operators import hierarchy


def brute(rows):
    groups, out = {}, {}
    for g, i, p in rows:
        groups.setdefault(g, {})[i] = p
    for g, m in groups.items():
        for i in m:
            path, seen, c = [i], {i: 0}, i
            while True:
                p = m[c]
                if p is None or p == 0:
                    out[g, i] = ("tree", c, len(path) - 1, path[::-1])
                    break
                if p not in m:
                    out[g, i] = ("detached", c, len(path) - 1, path[::-1])
                    break
                if p in seen:
                    d = seen[p]
                    out[g, i] = ("cycle" if d == 0 else "below_cycle", min(path[d:]), d, path[: d + 1][::-1])
                    break
                seen[p] = len(path)
                path.append(p)
                c = p
    below = {}
    for (g, _), r in out.items():
        for x in r[3][:-1]:
            below[g, x] = below.get((g, x), 0) + 1
    return {k: (*v, below.get(k, 0)) for k, v in out.items()}


def sample():
    rng, rows = random.Random(3), []
    for g in "xy":
        for i in range(1, 300):
            rows.append((g, i, rng.choice([i - 1, i - 1, i - 1, max(i - 3, 0), rng.randint(1, 304)]) if i > 1 else 0))
    rows += [("c", i, i % 150 + 1) for i in range(1, 151)] + [("c", 1000 + i, 1000 + i - 1 if i else 7) for i in range(40)]
    rows += [("s", 1, 1), ("s", 2, 1), ("s", 3, None), ("l", 1, 0)] + [("l", i, i - 1) for i in range(2, 400)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [32, 4096])
def test_matches_walking_each_node(spark, monkeypatch, block):
    monkeypatch.setattr(hierarchy, "BLOCK", block)
    rows = sample()
    df = spark.createDataFrame([(*r, "t") for r in rows + rows[:9]], "g string, id long, p long, top string")
    got = hierarchy.hierarchies(df, group="g", node="id", parent="p", paths=True).collect()
    assert {(r.g, r.id): (r.kind, r.top, r.depth, list(r.path), r.n_descendants) for r in got} == brute(rows)
    assert len(got) == len(set((a, b) for a, b, _ in rows))


def test_without_paths_nulls_and_versions(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 8)
    rows = [("a", 1, None, 1), ("a", 2, 1, 1), ("a", 2, 99, 2), (None, 3, 1, 1), ("a", None, 1, 1), ("a", 20, 2, 1), ("b", 9, 17, 1), ("b", 17, 9, 1), ("b", 30, 17, 1)]
    df = spark.createDataFrame(rows, "g string, id long, p long, v int")
    got = {(r.g, r.id): (r.kind, r.top, r.depth) for r in hierarchy.hierarchies(df, group="g", node="id", parent="p", version="v").collect()}
    assert got == {("a", 1): ("tree", 1, 0), ("a", 2): ("detached", 2, 0), ("a", 20): ("detached", 2, 1), ("b", 9): ("cycle", 9, 0), ("b", 17): ("cycle", 9, 0), ("b", 30): ("below_cycle", 9, 1)}


def test_empty(spark):
    df = spark.createDataFrame([], "g string, id long, p long")
    assert hierarchy.hierarchies(df, group="g", node="id", parent="p", paths=True).count() == 0


@pytest.mark.parametrize("block", [32, 4096])
def test_descendants_match_walking_up(spark, monkeypatch, block):
    monkeypatch.setattr(hierarchy, "BLOCK", block)
    rows = sample() + [("b", 9, 170), ("b", 170, 90), ("b", 90, 9), ("b", 300, 170), ("b", 301, 300)]
    parent, want = {(g, i): p for g, i, p in rows}, set()
    for g, i in parent:
        c, steps, seen = parent[g, i], 1, {i}
        while (g, c) in parent and c not in seen:
            want.add((g, c, i, steps))
            seen.add(c)
            c, steps = parent[g, c], steps + 1
    df = spark.createDataFrame(rows + rows[:9], "g string, id long, p long")
    got = [tuple(r) for r in hierarchy.descendants(df, group="g", node="id", parent="p").collect()]
    assert set(got) == want and len(got) == len(want)
    assert {x[1:] for x in got if x[0] == "b" and x[1] == 9} == {(9, 90, 1), (9, 170, 2), (9, 300, 3), (9, 301, 4)}
