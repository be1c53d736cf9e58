"""Most similar vectors for every vector, by learned partitions.

Fit, on bounded samples (``Params.sample`` vectors for each classifier, a documented parameter): the exact neighbour graph of the sample is
cut into balanced parts of few crossing edges; a small softmax classifier learns which parts the neighbours of a vector lie in.  The number
of parts grows with the collection, so a part has about ``leaf`` vectors at any size: up to ``fan`` parts by one classifier; beyond that each
part has a classifier of its own, fitted in a task on a sample of that part, and the two levels are broadcast up to ``tree`` parts (a bound in
bytes); beyond that the parts are cut again, level by level, where the vectors lie, each by classifiers that only its own tasks see.

Search, over all vectors: each is sent to its ``probes`` most probable parts, indexed in the first of them and a query in all; inside a
part the candidates are reranked by their cosines in blocks of matrix products.  A vector is copied ``probes`` times (once more for each
further level), whatever the size of the collection.  Vectors travel as 12-bit integers scaled to the vector's largest component, which keeps
cosines to about 1e-4.

Skew: a part that holds more than twice ``leaf`` vectors, by the sample's estimate, is cut into index blocks and query blocks, and each pair of
them is a task's group of its own, so no group grows with a hot part.
Exact copies are one class: they are collapsed where they are read, before anything is shuffled, searched once, and expanded at the end,
linearly in their number.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lookup import lookup
from tidemark.scratch import Scratch
from tidemark.shared import received, share


@dataclass(frozen=True)
class Params:
    """``sample`` bounds the vectors a classifier is fitted on; ``leaf`` is the size of a part aimed at; ``fan`` the parts of one classifier;
    ``tree`` the parts whose classifiers are broadcast (2 bytes a component each)."""

    sample: int = 16384
    leaf: int = 2048
    fan: int = 128
    tree: int = 1 << 15
    probes: int = 3
    graph_k: int = 8
    epochs: int = 12
    seed: int = 7


class Router:
    """Parts of the vector space and the classifier that finds them; ``share`` is the part of the sample in each."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, share: np.ndarray):
        self.weights, self.bias, self.share = weights.astype(np.float16), bias.astype(np.float32), share

    @property
    def parts(self) -> int:
        return len(self.bias)

    @classmethod
    def single(cls, dim: int) -> Router:
        return cls(np.zeros((dim, 1)), np.zeros(1), np.ones(1))

    def to_bytes(self) -> bytes:
        return pickle.dumps((self.weights, self.bias, self.share))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Router:
        return cls(*pickle.loads(raw))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights.astype(np.float32) + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """The columns of the ``n`` largest of each row, best first."""
    n = min(n, score.shape[1])
    top = np.argpartition(-score, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1)


class Tree:
    """A classifier of parts and, where there are more, one of its own for each part; leaves are numbered through."""

    def __init__(self, top: Router, below: list[Router] | None, total: int, leaf: int):
        self.top, self.below = top, below
        sizes = [top.share * total] if below is None else [np.atleast_1d(r.share) * s * total for r, s in zip(below, top.share, strict=True)]
        self.first = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
        self.sizes = np.concatenate(sizes)
        self.blocks = blocks_of(self.sizes, leaf)

    def route(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` most probable leaves of each row, best first; -1 where there are fewer."""
        coarse = self.top.log_odds(x)
        if self.below is None:
            return _best(coarse, probes)
        to = _best(coarse, probes)
        leaf = np.full((len(x), to.shape[1] * probes), -1)
        odds = np.full(leaf.shape, -np.inf)
        for j in range(to.shape[1]):
            order = np.argsort(to[:, j], kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(to[order, j])) + 1):
                c = int(to[rows[0], j])
                fine = self.below[c].log_odds(x[rows])
                best = _best(fine, probes)
                at = slice(j * probes, j * probes + best.shape[1])
                leaf[rows, at] = self.first[c] + best
                odds[rows, at] = coarse[rows, c][:, None] + np.take_along_axis(fine, best, axis=1)
        return np.take_along_axis(leaf, _best(odds, probes), axis=1)


def blocks_of(sizes: np.ndarray, leaf: int) -> np.ndarray:
    return np.maximum(1, np.ceil(np.asarray(sizes, float) / (2 * leaf))).astype(int)


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int32)
    for s in range(0, len(x), 1024):
        sim = x[s : s + 1024] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -2
        out[s : s + 1024] = np.argpartition(-sim, k, axis=1)[:, :k]
    return out


def _balanced(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Balanced parts of the neighbour graph: grown from spread centres, then nodes move to the part of most of their neighbours as far
    as its room allows."""
    n = len(x)
    room = int(np.ceil(1.1 * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(4):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-9), centres)

    def fill(gain: np.ndarray) -> np.ndarray:
        # those with the most to lose choose first; whoever finds no room takes the best part that has some
        label, left = np.full(n, -1), np.full(parts, room)
        best = np.argsort(-gain, axis=1)[:, :8]
        second = np.take_along_axis(gain, best, axis=1)
        for i in np.argsort(-(second[:, 0] - second[:, 1] if parts > 1 else second[:, 0]), kind="stable"):
            for p in best[i]:
                if left[p] > 0:
                    label[i] = p
                    left[p] -= 1
                    break
        for i in np.flatnonzero(label < 0):
            p = int(np.argmax(np.where(left > 0, gain[i], -np.inf)))
            label[i] = p
            left[p] -= 1
        return label

    affinity = x @ centres.T
    label = fill(affinity)
    for _ in range(3):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1.0)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1.0)
        label = fill(votes + 0.5 * affinity)
    return label


def fit(sample: np.ndarray, parts: int, p: Params) -> Router:
    """A classifier of ``parts`` parts from ``sample``, unit vectors; of fewer where the sample has fewer than 8 a part."""
    parts = int(min(parts, max(1, len(sample) // 8)))
    if parts == 1:
        return Router.single(sample.shape[1])
    rng = np.random.default_rng(p.seed)
    graph = _graph(sample, min(p.graph_k, len(sample) - 1))
    label = _balanced(sample, graph, parts, rng)
    # the classifier's target: where the vector itself and its neighbours lie
    target = np.zeros((len(sample), parts), np.float32)
    np.add.at(target, (np.arange(len(sample)), label), float(graph.shape[1]))
    np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), label[graph].ravel()), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    sums = np.zeros((parts, sample.shape[1]), np.float32)
    np.add.at(sums, label, sample)
    w = (12 * sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).T.astype(np.float32)
    b = np.zeros(parts, np.float32)
    moment_w, moment_b = np.zeros_like(w), np.zeros_like(b)
    for epoch in range(p.epochs):
        order = rng.permutation(len(sample))
        for s in range(0, len(order), 256):
            rows = order[s : s + 256]
            z = sample[rows] @ w + b
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            moment_w = 0.9 * moment_w + sample[rows].T @ d
            moment_b = 0.9 * moment_b + d.sum(axis=0)
            rate = 2.0 * (1 - epoch / p.epochs)
            w -= rate * moment_w
            b -= 0.1 * rate * moment_b
    router = Router(w, b, np.ones(parts))
    router.share = np.bincount(_best(router.log_odds(sample), 1)[:, 0], minlength=parts) / len(sample)
    return router


def unit_rows(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of an Arrow list column, and their unit vectors; not usable are nulls, other lengths, all zeros, what isn't finite."""
    offsets = np.asarray(column.offsets)
    fits = (np.diff(offsets) == dim) & ~np.asarray(column.is_null())
    at = np.flatnonzero(fits)
    values = column.values.to_numpy(zero_copy_only=False)
    x = values[offsets[at][:, None] + np.arange(dim)].astype(np.float32) if len(at) else np.zeros((0, dim), np.float32)
    norms = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    good = np.isfinite(norms) & (norms > 0)
    return at[good], (x[good] / norms[good, None]).astype(np.float32)


def _packed(x: np.ndarray) -> np.ndarray:
    """Rows as 12-bit integers, two of them in three bytes."""
    q = np.round(x * (2047 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int16).astype(np.uint16) & 0xFFF
    if q.shape[1] % 2:
        q = np.hstack([q, np.zeros((len(q), 1), np.uint16)])
    a, b = q[:, 0::2], q[:, 1::2]
    return np.stack([a & 0xFF, (a >> 8) | ((b & 0xF) << 4), b >> 4], axis=2).astype(np.uint8).reshape(len(q), -1)


def _unpacked(rows, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1, 3).astype(np.int16)
    q = np.empty((len(raw), raw.shape[1], 2), np.int16)
    q[:, :, 0] = raw[:, :, 0] | ((raw[:, :, 1] & 0xF) << 8)
    q[:, :, 1] = (raw[:, :, 1] >> 4) | (raw[:, :, 2] << 4)
    x = ((q ^ 0x800) - 0x800).reshape(len(raw), -1)[:, :dim].astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_SENT = "part bigint, cell int, is_query boolean, is_index boolean, class binary, vector binary"


def _cells(to: np.ndarray, home: np.ndarray, own: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, part, cell, is_query, is_index) of rows sent to the parts ``to``, -1 for none, of which ``home`` index them.

    A part of b blocks has b x b cells, one per pair of an index and a query block: as a query a row goes to its own query block of
    every index block, as indexed to its own index block of every query block."""
    row, slot = np.nonzero(to >= 0)
    part, is_home = to[row, slot], home[row, slot]
    b = blocks[row, slot]
    one = b == 1
    out = [(row[one], part[one], np.zeros(one.sum(), int), np.ones(one.sum(), bool), is_home[one])]
    many = np.flatnonzero(~one)
    if len(many):
        r = np.repeat(many, b[many])
        k = np.concatenate([np.arange(n) for n in b[many]])
        mine = own[row[r]] % b[r]
        out.append((row[r], part[r], k * b[r] + mine, np.ones(len(r), bool), is_home[r] & (k == mine)))
        i = is_home[r] & (k != mine)
        out.append((row[r][i], part[r][i], (mine * b[r] + k)[i], np.zeros(i.sum(), bool), np.ones(i.sum(), bool)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _send(shared, dim: int, probes: int, split: bool):
    """Each class's vector, once per task, to its parts; ``split`` into the cells of large ones."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tree: Tree = received(shared)
        seen: set[bytes] = set()
        for batch in batches:
            at, x = unit_rows(batch.column("embedding"), dim)
            names = batch.column("class").to_pylist()
            fresh = []
            for i, row in enumerate(at):
                if names[row] not in seen:
                    seen.add(names[row])
                    fresh.append(i)
            if len(seen) > 2_000_000:
                seen.clear()
            if not fresh:
                continue
            x = x[fresh]
            names = [names[at[i]] for i in fresh]
            to = tree.route(x, probes)
            home = np.zeros(to.shape, bool)
            home[:, 0] = True
            own = np.array([_number(n) for n in names])
            row, part, cell, q, i = _cells(to, home, own, tree.blocks[np.maximum(to, 0)] if split else np.ones(to.shape, int))
            data = _packed(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array(cell, pa.int32()), pa.array(q), pa.array(i), pa.array([names[r] for r in row], pa.binary()), pa.array([data[r].tobytes() for r in row], pa.binary())],
                names=["part", "cell", "is_query", "is_index", "class", "vector"],
            )

    return run


def _number(name: bytes) -> int:
    return int.from_bytes(name[-4:], "big") & 0x7FFFFFFF


def _rerank(k: int, dim: int, least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # copies read by several tasks meet here
        code, names = pd.factorize(rows["class"], sort=True)
        _, at = np.unique(code, return_index=True)
        x = _unpacked(rows["vector"].iloc[at].to_list(), dim)
        home = np.unique(code[rows["is_index"].to_numpy(bool)])
        asks = np.unique(code[rows["is_query"].to_numpy(bool)])
        names = np.asarray(names)
        out = []
        if len(home) and len(asks):
            indexed = x[home]
            place = np.full(len(x), -1)
            place[home] = np.arange(len(home))
            for s in range(0, len(asks), 1024):
                mine = asks[s : s + 1024]
                sim = x[mine] @ indexed.T
                self_at = place[mine]
                has = np.flatnonzero(self_at >= 0)
                sim[has, self_at[has]] = -2
                if least > -1:
                    q, c = np.nonzero(sim >= least)
                    cos = sim[q, c]
                    order = np.lexsort((c, -cos, q))
                    q, c, cos = q[order], c[order], cos[order]
                    start = np.searchsorted(q, np.arange(len(sim)))
                    keep = np.arange(len(q)) - start[q] < k
                    q, c, cos = q[keep], c[keep], cos[keep]
                else:
                    r = min(k, sim.shape[1])
                    top = np.argpartition(-sim, r - 1, axis=1)[:, :r]
                    q, c = np.repeat(np.arange(len(sim)), r), top.ravel()
                    cos = sim[q, c]
                    real = cos > -1.5
                    q, c, cos = q[real], c[real], cos[real]
                out.append(pd.DataFrame({"class": names[mine[q]], "near": names[home[c]], "cosine": cos.astype(float)}))
        return pd.concat(out) if out else pd.DataFrame({"class": np.array([], object), "near": np.array([], object), "cosine": np.array([], float)})

    return run


def _threshold(name: str, share) -> F.Column:
    """Rows whose hash of ``name`` falls into ``share`` of all."""
    return F.pmod(F.xxhash64(name), F.lit(1 << 24)) < share * (1 << 24) + 1


def _tree(spark, base: DataFrame, total: int, dim: int, p: Params) -> Tree:
    """The classifiers for ``total`` vectors of ``base``(key, embedding), as far as ``Params.tree`` goes."""
    take = base.filter(_threshold("key", F.lit(min(1.0, p.sample / max(total, 1))))).limit(2 * p.sample).select("embedding")
    got = take.toArrow().column("embedding").combine_chunks()
    sample = unit_rows(got, dim)[1] if len(got) else np.zeros((0, dim), np.float32)
    wanted = max(1, round(total / p.leaf))
    if wanted <= p.fan:
        return Tree(fit(sample, wanted, p), None, total, p.leaf)
    wanted = min(wanted, p.tree)
    coarse = min(p.fan, max(2, -(-wanted // p.fan)))
    top = fit(sample, coarse, p)
    shared = share(spark, Tree(top, None, total, p.leaf))

    def parts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        router: Tree = received(shared)
        for batch in batches:
            _, x = unit_rows(batch.column("embedding"), dim)
            if len(x):
                data = _packed(x)
                yield pa.RecordBatch.from_arrays([pa.array(router.route(x, 1)[:, 0], pa.int64()), pa.array([d.tobytes() for d in data], pa.binary())], names=["part", "vector"])

    drawn = base.filter(_threshold("key", F.lit(min(1.0, top.parts * p.sample / total)))).select("embedding").mapInArrow(parts, "part bigint, vector binary")
    sizes = top.share * wanted
    fitted = drawn.groupBy("part").applyInPandas(_fit_part(dim, p, lambda part: max(1, round(sizes[part]))), "part bigint, router binary").collect()
    below = {r.part: Router.from_bytes(r.router) for r in fitted}
    return Tree(top, [below.get(c) or Router.single(dim) for c in range(top.parts)], total, p.leaf)


def _fit_part(dim: int, p: Params, parts_of):
    """A classifier of one part from the vectors drawn of it, at most ``2 * sample`` of them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = _unpacked(rows["vector"].iloc[: 2 * p.sample].to_list(), dim)
        part = int(rows["part"].iloc[0])
        return pd.DataFrame({"part": [part], "router": [fit(x, min(parts_of(part), 2 * p.fan), p).to_bytes()]})

    return run


def _descend(sent: DataFrame, sizes: DataFrame, dim: int, p: Params, s: Scratch, last: bool) -> DataFrame:
    """``sent`` with its parts cut once more, into up to ``fan`` each, where the rows lie: a classifier per part is fitted on a sample of its
    indexed rows and meets them in cells of bounded size.  ``sizes``(part, n) has the indexed rows of each part.  A row goes on to its
    ``probes`` best parts below the one that indexes it and to the best one below any other; at the ``last`` level large parts get cells."""
    fan = p.fan
    drawn = sent.filter("is_index").join(sizes, "part").filter(_threshold("class", F.least(F.lit(1.0), F.lit(p.sample) / F.col("n"))))
    sized = drawn.withColumn("wanted", F.least(F.lit(fan), F.greatest(F.lit(1), F.ceil(F.col("n") / p.leaf))))

    def fit_one(rows: pd.DataFrame) -> pd.DataFrame:
        wanted = int(rows["wanted"].iloc[0])
        return _fit_part(dim, p, lambda _: wanted)(rows)

    routers = s.write(sized.groupBy("part").applyInPandas(fit_one, "part bigint, router binary"), "routers")
    n_cells = sizes.select("part", "n", F.ceil(F.col("n") * p.probes / (16 * p.leaf)).cast("int").alias("cells"))
    rows = sent.join(n_cells, "part").withColumn("salt", F.pmod(F.xxhash64("class"), F.col("cells")))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells").cast("bigint") - 1))
    routed = routers.join(n_cells, "part").select(F.col("part").alias("own_part"), F.col("router").alias("own_router"), each.alias("own_salt"))

    def route(rows: pd.DataFrame, router: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"part": [], "cell": [], "is_query": [], "is_index": [], "class": [], "vector": []})
        r = Router.from_bytes(router["own_router"].iloc[0]) if len(router) else Router.single(dim)
        x = _unpacked(rows["vector"].to_list(), dim)
        to = _best(r.log_odds(x), p.probes)
        to[~rows["is_index"].to_numpy(bool), 1:] = -1
        home = np.zeros(to.shape, bool)
        home[:, 0] = rows["is_index"].to_numpy(bool)
        blocks = blocks_of(r.share * int(rows["n"].iloc[0]), p.leaf) if last else np.ones(r.parts, int)
        number = np.array([_number(c) for c in rows["class"]])
        row, part, cell, q, i = _cells(to, home, number, blocks[np.maximum(to, 0)])
        base = int(rows["part"].iloc[0]) * (2 * fan)
        return pd.DataFrame({"part": base + part, "cell": cell, "is_query": q, "is_index": i, "class": rows["class"].to_numpy()[row], "vector": rows["vector"].to_numpy()[row]})

    return rows.groupBy("part", "salt").cogroup(routed.groupBy("own_part", "own_salt")).applyInPandas(route, _SENT)


def nearest(vectors: DataFrame, *, key: str, vector: str, dim: int, k: int = 5, least: float = -1.0, params: Params = Params()) -> DataFrame:
    """(key, neighbour, cosine): for every usable vector the ``k`` others of highest cosine, of those at ``least``, ties by smaller key.

    Every vector is indexed and every vector is a query.  The result is approximate: a neighbour indexed in a part that its query isn't
    sent to is missed; what is reported is measured at full length.
    Nulls, vectors of another length than ``dim``, all zero or not finite take no part.  Exact copies are neighbours of cosine 1.  Rows
    without key take no part; rows of a repeated key with equal vectors count once.  Empty tables give no rows.  Other columns are ignored.
    """
    spark, p = vectors.sparkSession, params
    s = Scratch(spark, "neighbours")
    name = F.unhex(F.concat(F.lpad(F.hex(F.xxhash64("embedding")), 16, "0"), F.lpad(F.hex(F.hash("embedding").cast("bigint").bitwiseAND(0xFFFFFFFF)), 8, "0")))
    total = vectors.count()  # of the files' footers; unusable rows only make parts a little smaller
    base = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("embedding")).filter(F.col("key").isNotNull() & (F.size("embedding") == dim))
    tree = _tree(spark, base, total, dim, p)
    deep = deep_tree = total > 2 * p.leaf * p.tree  # the broadcast classifiers don't reach parts of the wanted size
    shared = share(spark, tree)
    named = base.select("key", name.alias("class"), "embedding")
    sent = named.select("class", "embedding").mapInArrow(_send(shared, dim, p.probes, not deep), _SENT)
    n = total / len(tree.sizes)
    while deep:
        sent = s.write(sent, "sent")
        sizes = s.write(sent.filter("is_index").groupBy("part").agg(F.count(F.lit(1)).alias("n")), "sizes")
        n /= p.fan
        deep = n > 2 * p.leaf
        sent = _descend(sent, sizes, dim, p, s, not deep)
    if not deep_tree:  # a task for about every cell, so a task's share doesn't grow with the collection
        sent = sent.repartition(int(min((tree.blocks**2).sum(), 200_000)), "part", "cell")
    found = sent.groupBy("part", "cell").applyInPandas(_rerank(k, dim, least), "class binary, near binary, cosine double")
    # the same pair comes from several parts
    pairs = found.groupBy("class", "near").agg(F.max("cosine").alias("cosine"))

    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    members = s.write(named.filter(sound).select("class", "key").distinct(), "members")
    by_key = Window.partitionBy("class").orderBy("key")
    first = members.withColumn("place", F.row_number().over(by_key)).filter(F.col("place") <= k + 1)
    own = first.join(first.filter("place = 2").select("class"), "class", "left_semi").select("class", F.col("key").alias("neighbour"), F.lit(1.0).alias("cosine"))
    others = pairs.join(first.select(F.col("class").alias("near"), F.col("key").alias("neighbour")), "near").select("class", "neighbour", "cosine")
    best = Window.partitionBy("class").orderBy(F.desc("cosine"), "neighbour")
    ranked = own.unionByName(others).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    lists = ranked.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("place", "neighbour", "cosine"))).alias("near"))
    each = lookup(members, lists, "class", "inner")
    rest = F.slice(F.filter("near", lambda n: n["neighbour"] != F.col("key")), 1, k)
    return each.select("key", F.explode(rest).alias("n")).select(F.col("key").alias(key), "n.neighbour", "n.cosine").filter(F.col("cosine") >= least)
