"""Density clusters of a minimum spanning tree in distributed steps.

Edges are ordered by (w, ends). A point *settles* at the edge with which its component first has ``min_pts`` points; it leaves the condensed tree
there. An edge is a *split* where both sides had that many before it, which is so where both ends had settled. The path between two splits never
holds a greater edge that is none, so the condensed tree is the single-linkage tree of the points joined by all other edges, and has n / min_pts
splits at most. Steps: settling by growing each point along its least edges, inside blocks of space and then by joins; the joined points by pointer
jumping; splits in ranges of some ``RANGE``, each united in one task from where the one before ended; masses and choice up the same ranges.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written
from .balls import BLOCK, cells_of
from .boruvka import jumped

#: Splits that one task unites, about.
RANGE = 500_000
_STATE = "id long, got int, w double, lo long, hi long, via long, next long, ws array<double>, los array<long>, his array<long>, tos array<long>"


def _grow(least: int, got: int, worst: tuple, heap: list, around: dict) -> tuple[int, tuple, tuple | None]:
    """Takes least edges until there are ``least`` points, or one is reached that ``around`` lacks: (points, greatest edge, edge to that one)."""
    while got < least and heap:
        edge = heapq.heappop(heap)
        worst, got = max(worst, edge[:3]), got + 1
        if got < least:
            if edge[3] not in around:
                return got, worst, edge
            for e in around[edge[3]]:
                if e[1:3] != edge[1:3]:
                    heapq.heappush(heap, e)
    return got, worst, None


def _edges_of(point: int, ws: list, tos: list) -> list[tuple]:
    return [(w, min(point, t), max(point, t), t) for w, t in zip(ws, tos, strict=True)]


def _state(point: int, least: int, got: int, worst: tuple, heap: list, out: tuple | None) -> tuple:
    if out is None:
        return (point, got, *worst, None, None, [], [], [], [])
    kept = heapq.nsmallest(least - got, heap)
    return (point, got, *worst, out[1] + out[2] - out[3], out[3], *([e[i] for e in kept] for i in range(4)))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _STATE.split(", ")])
    return out.astype({"via": "Int64", "next": "Int64"})


def settled(points: DataFrame, tree: DataFrame, least: int) -> DataFrame:
    """(id, w, lo, hi): the edge with which each point's component first has ``least`` points; left out where it never has.

    points: id, v; tree: u, v, w. A point never needs more than its ``least`` least edges.
    """
    ends = tree.select("w", F.col("u").alias("id"), F.col("v").alias("to")).unionByName(tree.select("w", F.col("v").alias("id"), F.col("u").alias("to")))
    order = W.partitionBy("id").orderBy("w", F.least("id", "to"), F.greatest("id", "to"))
    near = ends.withColumn("r", F.row_number().over(order)).where(F.col("r") <= least)
    near = near.groupBy("id").agg(F.collect_list("w").alias("ws"), F.collect_list("to").alias("tos"))
    cells, table = cells_of(points)
    parts = max(1, int(cells.rows.max(initial=0)) // (4 * BLOCK))
    table = table.select("id", "cell", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    near = written(near.join(table, "id"), "near")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        around = {i: _edges_of(i, ws, tos) for i, ws, tos in zip(pdf["id"].tolist(), pdf["ws"], pdf["tos"], strict=True)}
        out = []
        for i, own in around.items():
            heap = list(own)
            heapq.heapify(heap)
            got, worst, edge = _grow(least, 1, (-np.inf, 0, 0), heap, around)
            out.append(_state(i, least, got, worst, heap, edge))
        return _frame(out)

    def onward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                heap = list(zip(r.ws, r.los, r.his, r.tos, strict=True))
                heap += [e for e in _edges_of(r.next, r.more_ws, r.more_tos) if e[3] != r.via]
                heapq.heapify(heap)
                got, worst, edge = _grow(least, r.got, (r.w, r.lo, r.hi), heap, {})
                out.append(_state(r.id, least, got, worst, heap, edge))
            yield _frame(out)

    more = near.select(F.col("id").alias("next"), F.col("ws").alias("more_ws"), F.col("tos").alias("more_tos"))
    now = written(near.groupBy("cell", "part").applyInPandas(inside, _STATE), "settling")
    done = now.where(f"next is null and got = {least}").select("id", "w", "lo", "hi")
    while not (still := now.where("next is not null")).isEmpty():
        now = written(still.join(more, "next").mapInPandas(onward, _STATE), "settling")
        done = done.unionByName(now.where(f"next is null and got = {least}").select("id", "w", "lo", "hi"))
    return written(done, "settled")


def _numbered(df: DataFrame, by: list[str], size: int) -> tuple[DataFrame, list[int]]:
    """(df with its place ``n`` in the order of ``by`` and its ``part``, the parts). A part has some ``size`` rows; one number of each is collected."""
    parts = max(1, -(-df.count() // size))
    cut = written(df.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), "parts")
    counts = sorted((r["part"], r["count"]) for r in cut.groupBy("part").count().collect())
    starts = df.sparkSession.createDataFrame([(p, sum(c for q, c in counts if q < p)) for p, _ in counts], "part int, start long")
    place = F.row_number().over(W.partitionBy("part").orderBy(*by)) - 1
    return written(cut.join(F.broadcast(starts), "part").withColumn("n", F.col("start") + place).drop("start"), "numbered"), [p for p, _ in counts]


def _united(splits: DataFrame, parts: list[int], leaves: DataFrame) -> DataFrame:
    """(child, parent, side): the linkage of splits (node, x, y, part), ``leaves`` (x, n) being its leaves. Side 0 has the split's x."""

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := up.get(x, x)) != x:
                up[x] = up.get(p, p)
                x = up[x]
            return x

        out = []
        for node, a, b in zip(pdf["node"].tolist(), pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            tops = find(a), find(b)
            for side, top in enumerate(tops):
                out.append((top, node, side))
                up[top] = node
        return pd.DataFrame([(*r, find(r[0])) for r in out], columns=["child", "parent", "side", "last"])

    top, links = leaves.select("x", F.col("n").alias("top")), None
    for part in parts:
        some = splits.where(F.col("part") == part).join(top.select("x", F.col("top").alias("a")), "x").join(top.select(F.col("x").alias("y"), F.col("top").alias("b")), "y")
        new = written(some.select("node", "a", "b", F.lit(0).alias("one")).groupBy("one").applyInPandas(unite, "child long, parent long, side int, last long"), "united")
        links = new.drop("last") if links is None else links.unionByName(new.drop("last"))
        if part != parts[-1]:
            to = new.select(F.col("child").alias("top"), "last")
            top = written(top.join(to, "top", "left").select("x", F.coalesce("last", "top").alias("top")), "tops")
    return written(links, "links")


def _weighed(nodes: DataFrame, parts: list[int]) -> DataFrame:
    """(node, total, best, itself): points below each node, the greatest mass of clusters there, and whether its own is no less.

    nodes: node, part (null: a leaf), l, r, own, fall, birth, death; own points leave at ``fall`` together.
    """
    mass = F.col("fall") - F.col("own") * F.col("birth")
    state = written(nodes.where("part is null").select("node", F.col("own").alias("total"), mass.alias("best"), F.lit(True).alias("itself")), "weighed")

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[int, tuple] = {}
        for r in pdf.sort_values("node").itertuples(index=False):
            lt, lb = known[r.l] if r.l in known else (r.lt, r.lb)
            rt, rb = known[r.r] if r.r in known else (r.rt, r.rb)
            own = r.fall - r.own * r.birth + (lt + rt) * (r.death - r.birth)
            known[r.node] = r.own + lt + rt, max(own, lb + rb)
            known[-1 - r.node] = own >= lb + rb, 0
        return pd.DataFrame([(n, int(t), b, known[-1 - n][0]) for n, (t, b) in known.items() if n >= 0], columns=["node", "total", "best", "itself"])

    for part in parts:
        side = lambda s: state.select(F.col("node").alias(s), F.col("total").alias(f"{s}t"), F.col("best").alias(f"{s}b"))
        some = nodes.where(F.col("part") == part).join(side("l"), "l", "left").join(side("r"), "r", "left").withColumn("one", F.lit(0))
        state = state.unionByName(written(some.groupBy("one").applyInPandas(weigh, "node long, total long, best double, itself boolean"), "weighed"))
    return state


def _owners(falls: DataFrame, links: DataFrame, times: DataFrame) -> DataFrame:
    """falls (leaf, w, lo, hi, own) with ``node``: the highest node above the leaf that was there before that edge. times: node, t."""
    jump = written(links.join(times.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"), F.col("parent").alias("to"), "t"), "jump")
    jumps = [jump]
    edge = F.struct("w", "lo", "hi")
    while not jump.isEmpty():
        on = jump.select(F.col("node").alias("to"), F.col("to").alias("on"), F.col("t").alias("then"))
        jump = written(jump.select("node", "to").join(on, "to").select("node", F.col("on").alias("to"), F.col("then").alias("t")), "jump")
        jumps.append(jump)
    now = falls.withColumn("node", F.col("leaf"))
    for j in reversed(jumps[:-1]):
        now = now.join(j, "node", "left").withColumn("node", F.when(F.col("t") < edge, F.col("to")).otherwise(F.col("node"))).drop("to", "t")
    return written(now, "owners")


def _topmost(nodes: DataFrame) -> DataFrame:
    """(node, mark, place) of nodes (node, up, mark, place): the highest mark from the node to the root, places added up."""
    now = written(nodes, "topmost")
    while not now.where("up is not null").isEmpty():
        on = now.select(F.col("node").alias("up"), F.col("up").alias("on"), F.col("mark").alias("higher"), F.col("place").alias("more"))
        step = now.join(on, "up", "left").select("node", F.col("on").alias("up"), F.coalesce("higher", "mark").alias("mark"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
        now = written(step, "topmost")
    return now.drop("up")


def tree_labels(points: DataFrame, tree: DataFrame, least: int, method: str = "eom") -> DataFrame:
    """(doc_id, topic): clusters from 1 by excess of mass, or the ``leaf`` ones; noise is -1. points: id, v; tree: their edges (u, v, w), u < v.

    The same labels as the kernels give for all edges in one task. Where no component ever has ``least`` points, ``eom`` has one cluster of two
    or more points and ``leaf`` none; a single point is noise; no points have no rows.
    """
    spark = points.sparkSession
    tree = written(tree, "tree")
    fall = settled(points, tree, least)
    all_one = lambda topic: points.select(F.col("id").alias("doc_id"), F.lit(topic).cast("int").alias("topic"))
    if fall.isEmpty():
        return all_one(1 if method == "eom" and not tree.isEmpty() else -1)
    at = lambda end: fall.select(F.col("id").alias(end), F.struct("w", "lo", "hi").alias(f"a_{end}"))
    marked = written(tree.join(at("u"), "u").join(at("v"), "v").withColumn("e", F.struct("w", F.col("u").alias("lo"), F.col("v").alias("hi"))), "marked")
    splits = marked.where("a_u < e and a_v < e").select("u", "v", "w")
    if splits.isEmpty():
        return all_one(1)
    # A point goes over to the other end of its edge where that had settled before, else to the lesser end, where all of a first component meet.
    over = marked.where("a_u = e or a_v = e").select(
        F.col("u").alias("lo"), F.col("v").alias("hi"), F.when(F.col("a_u") < F.col("e"), F.col("u")).when(F.col("a_v") < F.col("e"), F.col("v")).otherwise(F.col("u")).alias("into")
    )
    joined = jumped(written(fall.join(over, ["lo", "hi"]).select(F.col("id").alias("comp"), "into"), "into"))
    joined = written(joined.select(F.col("comp").alias("id"), F.col("into").alias("x")), "joined")
    end = lambda e, x: joined.select(F.col("id").alias(e), F.col("x").alias(x))
    splits = splits.join(end("u", "x"), "u").join(end("v", "y"), "v")
    splits, parts = _numbered(splits.withColumnRenamed("u", "lo").withColumnRenamed("v", "hi"), ["w", "lo", "hi"], RANGE)
    leaves, _ = _numbered(splits.select("x").union(splits.select("y")).distinct(), ["x"], RANGE)
    base = leaves.count()
    splits = splits.withColumn("node", F.col("n") + base)
    links = _united(splits, parts, leaves)

    # Points that leave by one edge from one place are counted together.
    lam = lambda w: F.when(w > 0, 1 / w).otherwise(F.lit(1e15))
    where = written(fall.join(joined, "id").join(leaves.select("x", F.col("n").alias("leaf")), "x").select("id", "leaf", "w", "lo", "hi"), "left")
    falls = where.groupBy("leaf", "w", "lo", "hi").agg(F.count("*").alias("own"))
    owners = _owners(falls, links, splits.select("node", F.struct("w", "lo", "hi").alias("t")))
    own = owners.groupBy("node").agg(F.sum("own").alias("own"), F.sum(F.col("own") * lam(F.col("w"))).alias("fall"))
    death = splits.select("node", "part", lam(F.col("w")).alias("death"))
    sides = links.groupBy(F.col("parent").alias("node")).agg(F.max(F.when(F.col("side") == 0, F.col("child"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("child"))).alias("r"))
    up = links.join(death.select(F.col("node").alias("parent"), F.col("death").alias("birth")), "parent").withColumnRenamed("child", "node")
    every = leaves.select(F.col("n").alias("node")).union(splits.select("node"))
    nodes = every.join(death, "node", "left").join(sides, "node", "left").join(up, "node", "left").join(own, "node", "left")
    nodes = written(nodes.fillna({"own": 0, "fall": 0.0, "birth": 0.0}), "nodes")
    state = written(_weighed(nodes, parts), "state")

    beside = state.select(F.col("node").alias("l"), F.col("total").alias("before"))
    right = nodes.where("l is not null").join(beside, "l").select(F.col("r").alias("node"), "before")
    picked = F.col("itself") if method == "eom" else F.col("own") > 0
    tops = nodes.join(state, "node").join(right, "node", "left").select("node", F.col("parent").alias("up"), F.when(picked, F.col("node")).alias("mark"), F.coalesce("before", F.lit(0)).cast("long").alias("place"))
    tops = _topmost(tops)
    chosen = tops.where("mark = node").join(nodes.select("node", "parent", "side"), "node")
    order = [F.desc("parent"), F.asc("side")] if method == "eom" else [F.asc("place")]
    numbers = chosen.select(F.col("node").alias("mark"), F.row_number().over(W.orderBy(*order)).alias("topic"))
    topic = owners.join(tops.select("node", "mark"), "node").join(numbers, "mark", "left").select("leaf", "w", "lo", "hi", "topic")
    out = where.join(topic, ["leaf", "w", "lo", "hi"]).select(F.col("id").alias("doc_id"), F.coalesce("topic", F.lit(-1)).cast("int").alias("topic"))
    return written(out, "labels")
