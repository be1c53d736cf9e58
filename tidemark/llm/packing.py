"""Filling fixed-capacity containers with items, by a grouping genetic algorithm on islands.

A solution is a set of containers, and containers are what is inherited: crossover injects well-filled containers of one parent into the
other, removes those that share an item with them, and puts the displaced items back by best fit, longest first.  Items are dealt to
shards of about ``SHARD`` by a hash; each shard is evolved on several islands, which start from differently disturbed orders and whose
elites migrate along a ring between epochs.  Evolution goes on after the lower bound of containers is reached, as it also gathers the free
space in few containers; it stops early only at a solution that cannot be bettered (all containers full but one).

A round settles the containers filled to ``WELL_FILLED``, or the better-filled half of a shard where fewer are; what lies in the others is
taken out and dealt again to fewer shards, until one shard holds the rest.  At least half the containers settle in a round, so there are
about log2 of the number of shards rounds at most, no round is cut off, and only one shard keeps a partly empty tail.

An item is split only if it alone exceeds the capacity: into full containers of its own and one remainder, which is packed like any item.
A task sees shards, never all items; the tables of each round are written to the shared folder.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import Scratch

SHARD = 2000  # items
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 8
POPULATION = 4
WELL_FILLED = 0.97


def _best_fit(bins: list[list[int]], free: list[int], items: list[int], sizes: np.ndarray, capacity: int) -> None:
    """Put ``items``, in their order, each into the fullest container that has room, opening new ones; changes ``bins`` and ``free``."""
    room = sorted((f, i) for i, f in enumerate(free))
    for x in items:
        need = int(sizes[x])
        at = bisect_left(room, (need, -1))
        if at == len(room):
            bins.append([x])
            free.append(capacity - need)
            insort(room, (capacity - need, len(bins) - 1))
            continue
        f, i = room.pop(at)
        bins[i].append(x)
        free[i] = f - need
        insort(room, (f - need, i))


def _fitness(free: list[int], capacity: int) -> float:
    """Falkenauer's: the mean of squared fills, which prefers few containers and full ones."""
    fill = 1.0 - np.asarray(free, float) / capacity
    return float((fill**2).mean()) if len(fill) else 1.0


def _cross(a: list[list[int]], b: list[list[int]], sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> tuple[list[list[int]], list[int]]:
    fills = np.array([sizes[x].sum() for x in b])
    well = np.flatnonzero(fills >= np.quantile(fills, 0.5))
    chosen = rng.choice(well, max(1, len(well) // 2), replace=False)
    taken = {x for i in chosen for x in b[i]}
    bins = [list(b[i]) for i in chosen]
    displaced: list[int] = []
    for c in a:
        if taken.isdisjoint(c):
            bins.append(list(c))
        else:
            displaced.extend(x for x in c if x not in taken)
    free = [capacity - int(sizes[c].sum()) for c in bins]
    displaced.sort(key=lambda x: (-sizes[x], x))
    _best_fit(bins, free, displaced, sizes, capacity)
    return bins, free


def _mutate(bins: list[list[int]], free: list[int], sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> tuple[list[list[int]], list[int]]:
    """Empty the worst-filled containers and a few random ones, and fit their items again."""
    order = np.argsort([-f for f in free], kind="stable")
    out = set(order[: max(1, len(bins) // 20)]) | set(rng.choice(len(bins), min(2, len(bins)), replace=False))
    kept = [i for i in range(len(bins)) if i not in out]
    items = sorted((x for i in out for x in bins[i]), key=lambda x: (-sizes[x], x))
    new, room = [list(bins[i]) for i in kept], [free[i] for i in kept]
    _best_fit(new, room, items, sizes, capacity)
    return new, room


def evolve(sizes: np.ndarray, capacity: int, seed: int, migrants: list[np.ndarray] | None = None, island: int = 0, births: list[tuple[float, int]] | None = None) -> tuple[float, np.ndarray]:
    """The best solution of an island, as (fitness, container of each item).  The first island starts with an undisturbed best fit by size, the
    others with disturbed ones only.  ``births`` takes (fitness, containers) of every child of a crossover."""
    n = len(sizes)
    if not n:
        return 1.0, np.zeros(0, int)
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    perfect = (least - 1 + ((int(sizes.sum()) - (least - 1) * capacity) / capacity) ** 2) / least
    population = []
    for labels in migrants or []:
        bins: list[list[int]] = [[] for _ in range(int(labels.max()) + 1)]
        for x, c in enumerate(labels):
            bins[c].append(x)
        population.append((bins, [capacity - int(sizes[c].sum()) for c in bins]))
    while len(population) < POPULATION:
        noise = 0.0 if not (population or island or migrants) else 0.08 * (1 + island + len(population))
        order = np.lexsort((np.arange(n), -sizes * (1 + noise * rng.standard_normal(n))))
        bins, free = [], []
        _best_fit(bins, free, [int(x) for x in order], sizes, capacity)
        population.append((bins, free))
    score = lambda s: _fitness(s[1], capacity)
    population.sort(key=score, reverse=True)
    for _ in range(GENERATIONS):
        if score(population[0]) > perfect - 1e-12:
            break
        i, j = sorted(rng.choice(len(population), 2, replace=False))
        crossed = _cross(population[j][0], population[i][0], sizes, capacity, rng)
        child = max(crossed, _mutate(*crossed, sizes, capacity, rng), key=score)
        if births is not None:
            births.append((score(child), len(child[0])))
        population = sorted([*population, child], key=score, reverse=True)[:POPULATION]
    bins, free = population[0]
    labels = np.zeros(n, int)
    for c, items in enumerate(bins):
        labels[items] = c
    return _fitness(free, capacity), labels


def _island(capacity: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for shard, island, sizes, migrants in zip(b["shard"], b["island"], b["sizes"], b["migrants"], strict=True):
                elites = [np.asarray(m, int) for m in migrants] if migrants is not None else None
                fit, labels = evolve(np.asarray(sizes, np.int64), capacity, int(shard) * 1009 + int(island) * 31 + epoch, elites, int(island))
                rows.append((shard, island, fit, labels.tolist()))
            yield pd.DataFrame(rows, columns=["shard", "island", "fitness", "labels"])

    return run


def _pack_shards(shards: DataFrame, capacity: int, s: Scratch) -> DataFrame:
    """(shard, labels) of ``shards``(shard, sizes): epochs on islands, elites moving along the ring between them."""
    islands = shards.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    schema = "shard bigint, island int, fitness double, labels array<int>"
    elites = None
    for epoch in range(EPOCHS):
        if elites is None:
            rows = islands.withColumn("migrants", F.lit(None).cast("array<array<int>>"))
        else:
            own = elites.select("shard", "island", F.col("labels").alias("own"))
            guest = elites.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("labels").alias("guest"))
            rows = islands.join(own, ["shard", "island"]).join(guest, ["shard", "island"]).select("shard", "sizes", "island", F.array("own", "guest").alias("migrants"))
        tasks = max(s.spark.sparkContext.defaultParallelism, int(s.spark.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.repartition(tasks, "shard", "island")
        elites = s.write(rows.select("shard", "island", "sizes", "migrants").mapInPandas(_island(capacity, epoch), schema), "elites")
    return elites.groupBy("shard").agg(F.max_by("labels", F.struct("fitness", -F.col("island"))).alias("labels"))


def pack(items: DataFrame, *, key: str, size: str, capacity: int, shard: int = SHARD) -> DataFrame:
    """Every item's place: (key, piece, first_unit, units, container); units of a container never sum to more than ``capacity``.

    piece counts the parts of an item from 0, first_unit is where the part starts; only items larger than ``capacity`` have several.
    Nulls: an item of null or non-positive size needs no place and comes out with null container; null keys are items like others.
    Repeated rows are items of their own.  Ties in size keep the order of their numbers.  An empty table gives no rows.  Other columns are
    ignored.
    """
    s = Scratch(items.sparkSession, "packing")
    raw = items.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("n"))
    placed = F.col("n") > 0
    n_pieces = F.ceil(F.col("n") / capacity)
    pieces = raw.select("key", "n", F.explode(F.when(placed, F.sequence(F.lit(0).cast("bigint"), n_pieces - 1)).otherwise(F.array(F.lit(0).cast("bigint")))).alias("piece"))
    units = F.when(F.col("n") > 0, F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece") * capacity)).otherwise(F.col("n"))
    # the numbers are drawn once and written, so that a lost task can't deal an item twice
    dealt = s.write(pieces.select("key", "piece", (F.col("piece") * capacity).alias("first_unit"), units.alias("units"), F.monotonically_increasing_id().alias("item")), "items")
    out = ["key", "piece", "first_unit", "units"]
    done = [
        dealt.filter(F.col("units").isNull() | (F.col("units") <= 0)).select(*out, F.lit(None).cast("string").alias("container")),
        dealt.filter(F.col("units") == capacity).select(*out, F.concat(F.lit("full-"), "item").alias("container")),
    ]
    todo, level = dealt.filter((F.col("units") > 0) & (F.col("units") < capacity)), 0
    n = todo.count()
    while n:
        n_shards = max(1, -(-n // shard))
        sharded = todo.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(n_shards)))
        lists = s.write(sharded.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("item", "units"))).alias("items")), "shards")
        shards = lists.select("shard", F.col("items.units").alias("sizes"))
        best = _pack_shards(shards, capacity, s)
        placed_at = lists.join(best, "shard").select("shard", F.explode(F.arrays_zip(F.col("items.item").alias("item"), F.col("items.units").alias("units"), F.col("labels").alias("label"))).alias("x")).select("shard", "x.*")
        fills = s.write(placed_at.groupBy("shard", "label").agg(F.sum("units").alias("fill"), F.collect_list("item").alias("members")), "fills")
        enough = fills.groupBy("shard").agg(F.least(F.lit(WELL_FILLED * capacity), F.percentile("fill", F.lit(0.5))).alias("enough"))
        keep = (F.col("fill") >= F.col("enough")) if n_shards > 1 else F.lit(True)
        settled = s.write(fills.join(enough, "shard").select("shard", "label", keep.alias("keep"), F.explode("members").alias("item")), "settled")
        named = settled.filter("keep").select("item", F.concat_ws("-", F.lit(level), "shard", "label").alias("container"))
        done.append(todo.join(named, "item").select(*out, "container"))
        left = s.write(todo.join(settled.filter("!keep").select("item"), "item", "left_semi"), "left")
        todo, n, level = left, left.count(), level + 1
    return reduce(DataFrame.unionByName, done).withColumnRenamed("key", key)
