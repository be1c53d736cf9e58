"""Parent links to full hierarchies: path, depth, top, descendants, loops.

The rows of a group form a graph in which every node has at most one parent.  It is solved by splitters, twice over:

* Keys are cut into blocks of ``BLOCK`` neighbouring ids, so the rows brought together are bounded whatever the size of a group.
  In a block a share of the nodes, chosen by a hash of the id, are splitters.  Every node walks to its next splitter or end by
  pointer jumping, the reduced graph of splitters and ends is solved by pointer doubling, and every node takes its splitter's
  answer on top of its own walk.  What never arrives is on a loop or leads into one and is solved apart: walking as many steps
  as there are nodes ends on the loops, which are cut.
* A node whose walk leaves its block is solved up to the node it enters next, a portal.  Portals are the splitters of the whole
  group; their reduced graph, which small groups don't have at all, is solved by pointer doubling with joins on (group, node).
  Loops through several blocks are found on that graph, cut, and the nodes below them solved again.

Each round of joins is written to the shared folder and read back, so no plan grows and lost executors cost one round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import Scratch

BLOCK = 4096  # ids in a block
BUCKET = 50_000  # nodes solved by one call, about
SHARE = 16  # one node in so many is a splitter

_SCHEMA = "g string, id bigint, portal boolean, kind string, top bigint, depth bigint, head bigint, last bigint, low bigint, seg array<bigint>, below bigint"


def _jump(nxt: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each node's walk along ``nxt`` first stops, after how many steps, and whether it does at all."""
    cur = np.where(stop, np.arange(len(nxt)), nxt)
    steps = (~stop).astype(np.int64)
    for _ in range(len(nxt).bit_length() + 1):
        go = ~stop[cur]
        if not go.any():
            break
        steps = steps + np.where(go, steps[cur], 0)
        cur = np.where(go, cur[cur], cur)
    return cur, steps, stop[cur]


def _solve(nxt: np.ndarray, splitter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's end (where nxt is negative), the steps to it, and whether it has one: splitters, reduced graph, expansion."""
    end = nxt < 0
    safe = np.where(end, np.arange(len(nxt)), nxt)
    stop = end | splitter
    if not stop.any():  # nothing but loops and what leads into them
        return np.full(len(nxt), -1), np.zeros(len(nxt), np.int64), stop
    # a splitter's own walk starts at its next node
    cur, steps, _ = _jump(safe, stop)
    first = np.where(end, np.arange(len(nxt)), cur[safe])
    hops = np.where(end, 0, 1 + steps[safe])
    on = np.flatnonzero(stop)
    where = np.full(len(nxt), -1)
    where[on] = np.arange(len(on))
    target, weight, done = first[on], hops[on], end[on].copy()
    ok = stop[target]
    to = np.where(ok, where[target], np.arange(len(on)))
    at_end = end[on]
    for _ in range(len(on).bit_length() + 1):
        go = ~at_end[to]
        if not go.any():
            break
        weight = weight + np.where(go, weight[to], 0)
        to = np.where(go, to[to], to)
    done = at_end[to] & ok
    reached = stop[first] & np.where(stop[first], done[where[np.where(stop[first], first, 0)]], False)
    r = where[np.where(reached, first, on[0] if len(on) else 0)]
    ends = np.where(reached, on[to[r]] if len(on) else 0, -1)
    depth = np.where(reached, hops + np.where(end[first], 0, weight[r] if len(on) else 0), 0)
    return ends, depth, reached


def _lowest(ids: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """The smallest id on each node's walk along ``nxt``, which ends everywhere, by pointer jumping."""
    low, cur = ids.copy(), np.where(nxt < 0, np.arange(len(nxt)), nxt)
    while True:
        better = np.minimum(low, low[cur])
        further = cur[cur]
        if (further == cur).all():
            return better
        low, cur = better, further


def _block(paths: bool):
    """All blocks of a bucket at once: the nodes' places in one array, in the order of group, block and id."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        block = rows["id"].to_numpy(np.int64) // BLOCK
        group, names = pd.factorize(rows["g"])
        # a code for each group's block, so that code and place in the block make one key
        place_of, numbers = pd.factorize(block)
        code = group * len(numbers) + place_of
        key = code * BLOCK + (rows["id"].to_numpy(np.int64) - block * BLOCK)
        is_mark = rows["mark"].to_numpy(bool)
        order = np.flatnonzero(~is_mark)[np.argsort(key[~is_mark], kind="stable")]
        own, keys = rows.iloc[order], key[order]
        ids, g = own["id"].to_numpy(np.int64), group[order]
        n = len(ids)
        marked = np.unique(key[is_mark])
        parent, is_cut = own["p"].to_numpy(np.int64), own["is_cut"].to_numpy(bool)
        start = parent == 0
        inside = ~start & ~is_cut & (parent // BLOCK == ids // BLOCK)
        wanted = keys - ids + parent
        place = np.searchsorted(keys, wanted).clip(0, max(n - 1, 0))
        found = inside & (keys[place] == wanted) if n else inside
        out = ~start & ~is_cut & ~inside
        nxt = np.where(found, place, -1)
        splitter = (ids * np.int64(-7046029254386353131) >> np.int64(40)) % SHARE == 0
        ends, depth, arrived = _solve(nxt, splitter) if n else (ids, ids, inside)
        loop_low = np.full(n, np.iinfo(np.int64).max)
        if not arrived.all():
            # walking as many steps as a block can have nodes, from what never arrives, ends on the loops
            cur, low = np.where(arrived, np.arange(n), nxt), ids.copy()
            for _ in range(min(n, BLOCK).bit_length()):
                low, cur = np.minimum(low, low[cur]), cur[cur]
            on = np.unique(cur[~arrived])
            loop_low[on] = low[on]
            nxt = nxt.copy()
            nxt[on] = -1
            ends, depth, _ = _solve(nxt, splitter)
        loop_low[is_cut] = own["cut"].to_numpy(np.int64)[is_cut]
        looped = (loop_low != np.iinfo(np.int64).max)[ends]
        kind = np.where(looped, np.where(depth == 0, "cycle", "below_cycle"), np.where(start[ends], "tree", "detached")).astype(object)
        leaves = out[ends]
        kind[leaves] = None
        portal = np.isin(keys, marked)
        low, seg = (_lowest(ids, nxt) if leaves.any() else ids), [None] * n
        below = np.zeros(n, np.int64)
        if paths:
            by_depth = np.argsort(depth, kind="stable")
            for i in by_depth:
                j = nxt[i]
                seg[i] = seg[j] + [ids[i]] if j >= 0 else [ids[i]]
            for i in by_depth[::-1]:
                if nxt[i] >= 0:
                    below[nxt[i]] += 1 + below[i]
        else:
            for i in np.flatnonzero(portal & leaves):  # loops through several blocks are told by their walks
                walk, j = [], i
                while j >= 0:
                    walk.append(ids[j])
                    j = nxt[j]
                seg[i] = walk[::-1]
        res = pd.DataFrame(
            {
                "g": np.asarray(names, object)[g],
                "id": ids,
                "portal": portal,
                "kind": kind,
                "top": np.where(looped, loop_low[ends], ids[ends]) if n else ids,
                "depth": depth + leaves,
                "head": pd.array(np.where(leaves, parent[ends], 0), "Int64") if n else ids,
                "last": ids[ends] if n else ids,
                "low": low,
                "seg": seg,
                "below": below,
            }
        )
        ghosts = np.flatnonzero(is_mark & ~np.isin(key, keys))
        ghosts = ghosts[np.unique(key[ghosts], return_index=True)[1]]
        if len(ghosts):
            at = rows["id"].to_numpy(np.int64)[ghosts]
            none = pd.DataFrame({"g": rows["g"].to_numpy()[ghosts], "id": at, "portal": True, "kind": "ghost", "top": at, "depth": 0, "head": 0, "last": at, "low": at, "seg": None, "below": 0})
            res = pd.concat([res, none], ignore_index=True) if n else none
        return res

    return solve


def _enter(a: DataFrame, b: DataFrame, portal: bool) -> DataFrame:
    """Walks ``a`` that end at a portal, each continued by that portal's own walk or answer in ``b``."""
    a, b = a.alias("a"), b.alias("b")
    on, ghost, through = F.col("b.kind").isNotNull(), F.col("b.kind") == "ghost", F.col("b.kind") == "cycle"
    kind = F.when(ghost, "detached").when(through, "below_cycle").otherwise(F.col("b.kind"))
    joined = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.head") == F.col("b.id")))
    return joined.select(
        "a.g",
        "a.id",
        F.lit(portal).alias("portal"),
        kind.alias("kind"),
        F.when(ghost, F.col("a.last")).otherwise(F.col("b.top")).alias("top"),
        F.when(ghost, F.col("a.depth") - 1).otherwise(F.col("a.depth") + F.col("b.depth")).alias("depth"),
        F.when(on, F.col("a.head")).otherwise(F.col("b.head")).alias("head"),
        F.when(on, F.col("a.last")).otherwise(F.col("b.last")).alias("last"),
        F.least("a.low", "b.low").alias("low"),
        F.when(ghost, F.col("a.seg")).otherwise(F.concat("b.seg", "a.seg")).alias("seg"),
        F.when(ghost, F.col("a.via")).otherwise(F.concat("b.via", "a.via")).alias("via"),
    )


def _place(nodes: DataFrame, s: Scratch, paths: bool) -> DataFrame:
    """(g, id, kind, top, depth, path, n_descendants) of ``nodes``(g, id, p, cut); cut is set at the nodes where loops are cut."""
    block, solve = F.floor(F.col("id") / BLOCK), _block(paths)
    rows = nodes.withColumn("mark", F.lit(False))
    crossing = nodes.filter(f"p != 0 and cut is null and floor(p / {BLOCK}) != floor(id / {BLOCK})")
    marks = crossing.select("g", F.col("p").alias("id"), F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("bigint").alias("cut"), F.lit(True).alias("mark")).distinct()
    full = rows.unionByName(marks).select("g", "id", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("cut", F.lit(0)).alias("cut"), F.col("cut").isNotNull().alias("is_cut"), "mark")
    # many blocks to a bucket: a block has at most BLOCK nodes, so buckets are even whatever the groups
    buckets = max(1, -(-nodes.count() // BUCKET))
    solved = full.withColumn("bucket", F.pmod(F.xxhash64("g", block), F.lit(buckets))).groupBy("bucket").applyInPandas(lambda rows: solve(rows.drop(columns="bucket")), _SCHEMA)
    blocks = s.write(solved, "blocks")
    ended = blocks.filter("kind is not null and kind != 'ghost'")
    extra = [F.col("seg").alias("path"), F.col("below").alias("n_descendants")] if paths else []
    answer = ended.select("g", "id", "kind", "top", "depth", *extra)
    walks = blocks.filter("kind is null")
    if walks.isEmpty():
        return answer

    via = F.array("id") if paths else F.lit(None).cast("array<bigint>")
    cols = ["g", "id", "portal", "kind", "top", "depth", "head", "last", "low", "seg", "via"]
    portals = blocks.filter("portal").withColumn("via", via).select(*cols)
    closed, open_ = [portals.filter("kind is not null")], portals.filter("kind is null")
    limit = open_.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    covered, n_open = 1, limit
    while n_open and covered <= 2 * limit:
        at = open_
        for d in closed:
            at = at.unionByName(d)
        step = s.write(_enter(open_, at, True), "portals")
        closed.append(step.filter("kind is not null"))
        open_ = step.filter("kind is null")
        covered *= 2
        n_open = open_.count()
    heads = closed[0]
    for d in closed[1:]:
        heads = heads.unionByName(d)
    through = _enter(walks.withColumn("via", F.lit(None).cast("array<bigint>")), heads, False)
    if paths:
        local = walks.select("g", "id", F.col("below").alias("n_descendants"))
        entered = walks.groupBy("g", F.col("head").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        passed = heads.filter("kind != 'ghost'").join(entered, ["g", "id"]).select("g", "n", F.explode("via").alias("id")).groupBy("g", "id").agg(F.sum("n").alias("n"))
        handed = blocks.filter("portal and kind is distinct from 'ghost'").join(passed, ["g", "id"]).select("g", F.explode("seg").alias("id"), F.col("n").alias("n_descendants"))
        through = through.select("g", "id", "kind", "top", "depth", F.col("seg").alias("path"))
        counts = local.unionByName(ended.select("g", "id", F.col("below").alias("n_descendants"))).unionByName(handed).groupBy("g", "id").agg(F.sum("n_descendants").alias("n_descendants"))
        answer = answer.drop("n_descendants").unionByName(through).join(counts, ["g", "id"])
    else:
        answer = answer.unionByName(through.select("g", "id", "kind", "top", "depth"))
    if not n_open:
        return answer

    # loops through several blocks: after more steps than portals every open walk stands on one; their walks from portal to portal make up the loops
    answer = s.write(answer, "answer")
    on = open_.select("g", F.col("head").alias("id")).distinct()
    ring = s.write(open_.join(on, ["g", "id"]).select("g", "id", "low"), "ring")
    loops = blocks.filter("portal and kind is null").drop("low").join(ring, ["g", "id"])
    member = loops.select("g", F.explode("seg").alias("id"), F.col("low").alias("cut")).distinct()
    rest = nodes.drop("cut").join(answer.select("g", "id"), ["g", "id"], "left_anti").join(member, ["g", "id"], "left")
    below = _place(s.write(rest.select("g", "id", "p", "cut"), "rest"), s, paths)
    return answer.unionByName(below)


def hierarchies(links: DataFrame, *, group: str, node: str, parent: str, version: str | None = None, paths: bool = False) -> DataFrame:
    """Every node's place in its tree: (group, node, kind, top, depth) and, with ``paths``, path from the top down and n_descendants.

    kind: 'tree' descends from a start (parent 0 or null); 'detached' leads to a node whose parent isn't recorded in the group;
    'cycle' is on a loop, 'below_cycle' leads into one.  For a cycle, top is the loop's smallest node and depth 0; below a cycle, top
    is that of the loop and depth the number of steps to reach it, and the path starts at the node where it is reached.
    The descendants of x are the nodes whose path holds x; on a loop, n_descendants counts those that hang off the node itself.

    Nulls: rows without group or node are left out.  Repeated rows of a node count once; of differing ones that of the largest
    ``version`` holds, then of the largest parent.  Empty tables give no rows.  Other columns are ignored.
    """
    s = Scratch(links.sparkSession, "hierarchy")
    extra = ["path", "n_descendants"] if paths else []
    return _place(_nodes(links, s, group, node, parent, version), s, paths).select(F.col("g").alias(group), F.col("id").alias(node), "kind", "top", "depth", *extra)


def _nodes(links: DataFrame, s: Scratch, group: str, node: str, parent: str, version: str | None) -> DataFrame:
    order = [F.col(version).alias("v")] if version else []
    raw = links.select(F.col(group).cast("string").alias("g"), F.col(node).cast("bigint").alias("id"), F.struct(*order, F.col(parent).cast("bigint").alias("p")).alias("p"))
    nodes = raw.filter("g is not null and id is not null").groupBy("g", "id").agg(F.max("p").alias("p"))
    return s.write(nodes.select("g", "id", F.col("p.p").alias("p"), F.lit(None).cast("bigint").alias("cut")), "nodes")


def _ring(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The place of every node of a loop, counted along the parents from its smallest."""
    parent = dict(zip(rows["id"], rows["p"], strict=True))
    walk = [min(parent)]
    while parent[walk[-1]] != walk[0]:
        walk.append(parent[walk[-1]])
    return pd.DataFrame({"g": key[0], "top": key[1], "id": walk, "place": range(len(walk)), "size": len(walk)})


def descendants(links: DataFrame, *, group: str, node: str, parent: str, version: str | None = None) -> DataFrame:
    """Every descendant of every node: (group, node, descendant, distance), distance the parent links from the descendant up to the node.

    A node isn't its own descendant.  The descendants of a node on a loop are all other nodes of the loop and all that hang off any of them,
    by their shortest way up.  One row per pair: as many as the paths have nodes above their last, and for a loop its size times what leads
    into it.  Nodes are brought together only by loop, of which the pairs are the square.  Nulls and repeated rows as in ``hierarchies``.
    """
    s = Scratch(links.sparkSession, "hierarchy")
    nodes = _nodes(links, s, group, node, parent, version)
    placed = _place(nodes, s, True)
    above = placed.filter("depth > 0").select("g", "id", F.size("path").alias("n"), F.posexplode("path").alias("at", "above"))
    pairs = above.select("g", F.col("above").alias("node"), F.col("id").alias("descendant"), (F.col("n") - 1 - F.col("at")).cast("bigint").alias("distance")).filter("distance > 0")
    looped = placed.filter("kind in ('cycle', 'below_cycle')")
    looped = s.write(looped.select("g", "id", "kind", "top", "depth", F.col("path")[0].alias("entry")), "looped")
    ring = looped.filter("kind = 'cycle'").select("g", "top", "id").join(nodes.select("g", "id", "p"), ["g", "id"])
    ring = s.write(ring.groupBy("g", "top").applyInPandas(_ring, "g string, top bigint, id bigint, place bigint, size bigint"), "rings")
    entered = looped.join(ring.select("g", "top", F.col("id").alias("entry"), F.col("place").alias("from")), ["g", "top", "entry"])
    around = entered.withColumnRenamed("id", "descendant").join(ring.select("g", "top", F.col("id").alias("node"), "place", "size"), ["g", "top"]).filter("node != entry")
    pairs = pairs.unionByName(around.select("g", "node", "descendant", (F.col("depth") + F.pmod(F.col("place") - F.col("from"), F.col("size"))).alias("distance")))
    return pairs.select(F.col("g").alias(group), F.col("node").alias(node), "descendant", "distance")
