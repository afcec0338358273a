"""Linkage of tables that don't fit one task: Ward's by rounds of merges within groups of clusters, single by a spanning tree.

Ward's linkage is reducible: a merge never brings a cluster nearer to others than the nearer of its parts was. So all pairs of clusters
that are nearest to one another may be merged at once, in any order, and the dendrogram is the one of merging the single nearest pair again and again.
A cluster is its mean, size and height. Clusters are in cells of space (see ``balls``), and cells near one another are a group, which a task holds.
In a round a group merges its own clusters for as long as none outside of it can be nearer: a cluster looks in the cells outside that may hold one
within twice the height of its nearest in the group; what it finds there bounds its merges, and those of what it becomes, and the balls of the
other cells bound them too. Pairs of two groups that are nearest to one another merge at the end of the round. Once ``TAIL`` clusters are left
they go on in one task. Rows merge downwards in id, so the merges are a table of parents and a cut is made by pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written
from . import balls
from .boruvka import jumped, spanning_tree

#: Clusters that end their merges in one task, and that a group may hold in any case; cells of a round; visitors of a task; numbers of a task's matrix of heights.
TAIL, CELLS, VISITORS, CHUNK = 2000, 512, 32768, 1 << 23
_BEST = "id long, w double, tie long, lo long, hi long"
_MERGES = "comp long, into long, height double, step int"


def _tie(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A number for each pair that orders equal distances without regard to ids, so that rows of a grid don't wait for one another."""
    z = lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hi.astype(np.uint64)
    for shift in (30, 27):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def _best(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], bound: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row of x, squared height, tie, lo, hi) of each row's nearest in y within its bound. x, y: ids, means, sizes; the same or disjoint.

    The product only finds candidates; their heights are made so that both ends of a pair get the same bits.
    """
    (ids, p, s), (far, q, t) = x, y
    middle = p.mean(0)
    a, b = p - middle, q - middle
    norm, norm_b = (a**2).sum(1), (b**2).sum(1)
    d = a @ (-2 * b.T)
    d += norm[:, None]
    d += norm_b[None, :]
    np.maximum(d, 0, out=d)
    if (s != 1).any() or (t != 1).any():
        d *= 2 / (1 / s[:, None] + 1 / t[None, :])
    if ids is far:
        np.fill_diagonal(d, np.inf)
    # What rounding may have moved: no weight of a row is over twice the lesser of its size and the largest other one.
    slack = 2e-12 * (norm + norm_b.max(initial=0)) * 2 * np.minimum(s, t.max(initial=1))
    most = d.min(1, initial=np.inf)
    most = (most if bound is None else np.minimum(most, bound)) + slack
    i, j = np.nonzero((d <= most[:, None] + slack[:, None]) & np.isfinite(d))
    exact = np.zeros(len(i))
    for dim in range(p.shape[1]):
        exact += (p[i, dim] - q[j, dim]) ** 2
    exact *= 2 * s[i] * t[j] / (s[i] + t[j])
    lo, hi = np.minimum(ids[i], far[j]), np.maximum(ids[i], far[j])
    tie = _tie(lo, hi)
    order = np.lexsort((hi, lo, tie, exact, i))
    order = order[np.r_[True, i[order][1:] != i[order][:-1]]] if len(order) else order
    return i[order], exact[order], tie[order], lo[order], hi[order]


@dataclass
class _Outside:
    """The cells outside of a group: how near their balls and least sizes let a cluster come."""

    center: np.ndarray
    radius: np.ndarray
    least: np.ndarray

    def within(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        """A squared height for each cluster and cell that no merge with one of the cell is below."""
        norm = (x**2).sum(1)
        d = np.sqrt(np.maximum(norm[:, None] + (self.center**2).sum(1)[None, :] - 2 * x @ self.center.T, 0))
        gap = np.maximum(d - self.radius[None, :] - 1e-7 * (1 + np.sqrt(norm))[:, None], 0)
        return 2 * s[:, None] * self.least[None, :] / (s[:, None] + self.least[None, :]) * gap**2

    def bound(self, x: np.ndarray, s: np.ndarray, looked: np.ndarray) -> np.ndarray:
        """The least of these over the cells that were not looked in."""
        out = np.full(len(x), np.inf)
        for at in range(0, len(x) if len(self.center) else 0, 4096):
            part = slice(at, at + 4096)
            out[part] = np.where(looked[part], np.inf, self.within(x[part], s[part])).min(1)
        return out


def _search(rows: np.ndarray, live: np.ndarray, ids: np.ndarray, x: np.ndarray, s: np.ndarray, w: np.ndarray, tie: np.ndarray, to: np.ndarray) -> None:
    """Sets squared height, tie and place of the nearest live one of each of ``rows``, as ``_best`` orders them."""
    c = x - x[live].mean(0)
    norm = (c**2).sum(1)
    top, largest, uneven = norm[live].max(), s[live].max(), bool((s[live] != 1).any())
    double, column, inverse = np.ascontiguousarray(-2 * c.T), np.where(live, norm, np.inf), 1 / s
    for at in range(0, len(rows), step := max(1, CHUNK // len(ids))):
        part = rows[at : at + step]
        d = c[part] @ double
        d += norm[part][:, None]
        d += column
        np.maximum(d, 0, out=d)
        if uneven:
            d /= (inverse[part][:, None] + inverse[None, :]) / 2
        d[np.arange(len(part)), part] = np.inf
        slack = 2e-12 * (norm[part] + top) * 2 * np.minimum(s[part], largest)
        i, j = np.nonzero(d <= np.minimum(d.min(1) + 2 * slack, np.finfo(float).max)[:, None])
        exact = np.zeros(len(i))
        for dim in range(x.shape[1]):
            exact += (x[part[i], dim] - x[j, dim]) ** 2
        exact *= 2 * s[part[i]] * s[j] / (s[part[i]] + s[j])
        lo, hi = np.minimum(ids[part[i]], ids[j]), np.maximum(ids[part[i]], ids[j])
        order = np.lexsort((hi, lo, ties := _tie(lo, hi), exact, i))
        order = order[np.r_[True, i[order][1:] != i[order][:-1]]] if len(order) else order
        own = part[i[order]]
        w[own], tie[own], to[own] = exact[order], ties[order], j[order]


def _merged(ids: np.ndarray, x: np.ndarray, s: np.ndarray, h: np.ndarray, step: int, found: tuple[np.ndarray, np.ndarray] | None = None, near: np.ndarray | None = None, looked: np.ndarray | None = None, outside: _Outside | None = None) -> tuple[list[tuple[np.ndarray, ...]], tuple[np.ndarray, ...]]:
    """(merges by rounds: comp, into, squared height, step; what is left: ids, means, sizes, heights) of clusters in the order of their ids.

    found: squared height and place of each one's nearest, where known. near: of the nearest in the cells ``outside`` that each one ``looked`` in. A cluster keeps its nearest until that merges.
    """
    out, n = [], len(ids)
    if outside is None:
        outside, looked = _Outside(np.zeros((0, x.shape[1])), np.zeros(0), np.zeros(0)), np.zeros((n, 0), bool)
    near = np.full(n, np.inf) if near is None else near
    bound = np.minimum(near, outside.bound(x, s, looked))
    least = outside.least.min(initial=np.inf)
    live, w, tie, to = np.ones(n, bool), np.full(n, np.inf), np.zeros(n, np.int64), np.full(n, -1)
    ask = np.arange(n)
    if found is not None:
        w, to = found[0].copy(), found[1].copy()
        has = to >= 0
        tie[has] = _tie(np.minimum(ids[has], ids[to[has]]), np.maximum(ids[has], ids[to[has]]))
        ask = ask[:0]
    while live.sum() > 1:
        if len(ask):
            _search(ask, live, ids, x, s, w, tie, to)
        # Of equal heights the other end takes the one that comes first, too; then the first pair of all is always chosen by both.
        i = ask[to[ask] >= 0]
        for a in i[(w[i] < w[to[i]]) | ((w[i] == w[to[i]]) & (tie[i] < tie[to[i]]))]:
            b = to[a]
            if (w[a], tie[a]) < (w[b], tie[b]):
                w[b], tie[b], to[b] = w[a], tie[a], a
        a = np.flatnonzero(live & (to > np.arange(len(ids))))
        b = to[a]
        pick = (to[b] == a) & (w[a] <= bound[a]) & (w[a] <= bound[b])
        a, b = a[pick], b[pick]
        if not len(a):
            break
        h[a] = np.maximum(np.maximum(h[a], h[b]), w[a])
        out.append((ids[b], ids[a], h[a].copy(), np.full(len(a), step, np.int32)))
        step += 1
        total = s[a] + s[b]
        looked[a] &= looked[b]
        with np.errstate(invalid="ignore"):
            # No merged one is nearer to what both have looked at than this, whatever has merged there.
            ahead = ((s[a] + least) * near[a] + (s[b] + least) * near[b] - least * w[a]) / (total + least) * (1 - 1e-12)
        near[a] = np.where(looked[a].any(1), ahead, np.inf) if len(outside.center) else np.inf
        x[a] = (x[a] * s[a][:, None] + x[b] * s[b][:, None]) / total[:, None]
        s[a] = total
        live[b] = False
        bound[a] = np.minimum(near[a], outside.bound(x[a], s[a], looked[a]))
        gone = np.zeros(len(ids), bool)
        gone[a] = gone[b] = True
        lost = live & (gone | (gone[to] & (to >= 0)))
        to[lost] = -1
        # What is nearer to something outside stays as it is.
        ask = np.flatnonzero(lost & (w <= bound))
        if live.sum() < 0.7 * len(ids):
            place = np.cumsum(live) - 1
            to = np.where(to >= 0, place[to], -1)
            ask = place[ask]
            ids, x, s, h, w, tie, to, near, looked, bound = (v[live] for v in (ids, x, s, h, w, tie, to, near, looked, bound))
            live = np.ones(len(ids), bool)
    return out, (ids[live], x[live], s[live], h[live])


def _groups(cells: balls.Cells, most: int) -> np.ndarray:
    """The group of each cell: the nearest cells, or groups of these, go together while they hold ``most`` rows at most."""
    n = len(cells.center)
    group, rows = np.arange(n), cells.rows.astype(np.int64).copy()
    d = ((cells.center[:, None] - cells.center[None]) ** 2).sum(2) if n < 64 else np.maximum((cells.center**2).sum(1)[:, None] + (cells.center**2).sum(1)[None] - 2 * cells.center @ cells.center.T, 0)
    i, j = np.triu_indices(n, 1)
    for at in np.argsort(d[i, j], kind="stable"):
        a, b = group[i[at]], group[j[at]]
        if a != b and rows[a] + rows[b] <= most:
            group[group == b] = a
            rows[a] += rows[b]
    return np.unique(group, return_inverse=True)[1]


def _arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(ids, means, sizes) and, where it has them, heights and cells of a table, by id; copies."""
    table = table.sort_by("id").combine_chunks()
    x = balls._points(table.column("v").combine_chunks())
    return (table.column("id").to_numpy().copy(), x.copy(), *(table.column(c).to_numpy().copy() for c in ("size", "height", "cell") if c in table.column_names))


def _round(clusters: DataFrame, n: int, step: int) -> DataFrame:
    """Clusters (id, v, size, height) after a round, and its merges (id, height, into, step) with v null."""
    cells, _ = balls.cells_of(clusters.select("id", "v"), many=max(2, min(CELLS, -(-n // balls.BLOCK) * 8)))
    dims = cells.center.shape[1]
    group = _groups(cells, max(TAIL, min(n // 8, balls.REGION // (8 * dims))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = cells.of(balls._points(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(group[own].astype(np.int32))], [*batch.schema.names, "cell", "grp"])

    table = written(clusters.select("id", "v", "size", "height").mapInArrow(place, "id long, v array<double>, size double, height double, cell int, grp int"), "placed")
    least = np.ones(len(cells.rows))
    for r in table.groupBy("cell").agg(F.min("size").alias("s")).collect():
        least[r["cell"]] = r["s"]

    def beyond(own: int) -> tuple[np.ndarray, _Outside]:
        far = np.flatnonzero((group != own) & (cells.rows > 0))
        return far, _Outside(cells.center[far], cells.radius[far], least[far])

    def ask(held: pa.Table) -> pa.Table:
        """The nearest in the group, and a row for each other group that a cluster has to look in."""
        own = held.column("grp")[0].as_py()
        ids, x, s, *_ = _arrays(held)
        w, tie, to = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64), np.full(len(ids), -1)
        if len(ids) > 1:
            _search(np.arange(len(ids)), np.ones(len(ids), bool), ids, x, s, w, tie, to)
        far, outside = beyond(own)
        rows, grps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(ids) if len(far) else 0, 4096):
            part = slice(at, at + 4096)
            reach = outside.within(x[part], s[part]) <= 2 * w[part, None]
            for g in np.unique(group[far]):
                hit = np.flatnonzero(reach[:, group[far] == g].any(1)) + at
                rows.append(hit)
                grps.append(np.full(len(hit), g))
        row, grp = np.concatenate(rows), np.concatenate(grps)
        away = pa.array(np.arange(len(ids) + len(row)) >= len(ids))
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(x[row].ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        vectors = pa.concat_arrays([pa.nulls(len(ids), pa.list_(pa.float64())), vectors])
        of = np.concatenate([np.arange(len(ids)), row])
        return pa.table({"id": ids[of], "grp": pa.array(np.concatenate([np.full(len(ids), own), grp]).astype(np.int32)), "away": away, "w": w[of], "to": np.where(to >= 0, ids[to], -1)[of], "size": s[of], "v": vectors})

    asked = written(table.groupBy("grp").applyInArrow(ask, "id long, grp int, away boolean, w double, to long, size double, v array<double>"), "asked")
    come = asked.where("away").select("id", "grp", "w", "size", "v")
    parts = [(r["grp"], -(-r["n"] // VISITORS)) for r in come.groupBy("grp").agg(F.count("*").alias("n")).collect()]

    def look(visitors: pa.Table, held: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if visitors.num_rows and held.num_rows:
            far = np.unique(cell := held.sort_by("id").column("cell").to_numpy())
            ids, x, s, *_ = _arrays(held)
            outside = _Outside(cells.center[far], cells.radius[far], least[far])
            visitors = visitors.sort_by("id").combine_chunks()
            for at in range(0, visitors.num_rows, balls.BLOCK):
                part = visitors.slice(at, balls.BLOCK)
                p, q, t = _arrays(part)
                limit = 2 * part.column("w").to_numpy()
                reach = outside.within(q, t) <= limit[:, None]
                for c in np.flatnonzero(reach.any(0)):
                    some, there = reach[:, c], cell == far[c]
                    i, w, tie, lo, hi = _best((p[some], q[some], t[some]), (ids[there], x[there], s[there]), limit[some])
                    out.append((p[some][i], w, tie, lo, hi))
        return pa.table({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("id", "w", "tie", "lo", "hi"))})

    own = asked.where("not away").select("id", "grp", "w", "to")
    if parts:
        dealt = F.broadcast(clusters.sparkSession.createDataFrame(parts, "grp int, parts int"))
        visitors = come.join(dealt, "grp").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        targets = table.select("id", "v", "size", "cell", "grp").join(dealt, "grp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = visitors.groupBy("grp", "part").cogroup(targets.groupBy("grp", "part")).applyInArrow(look, _BEST)
        best = met.groupBy("id").agg(F.min(F.struct("w", "tie", "lo", "hi")).alias("e"))
        own = written(own.join(best, "id", "left").select("id", "grp", "w", "to", F.col("e.w").alias("near"), "e.lo", "e.hi"), "nearest")
        # A pair of two groups that both of its ends chose.
        pairs = own.where("near < w").groupBy("lo", "hi").agg(F.count("*").alias("n")).where("n = 2")
        ends = pairs.select(F.explode(F.array("lo", "hi")).alias("id"), F.col("lo").alias("pair"))
        own = own.drop("lo", "hi").join(ends, "id", "left")
    else:
        own = own.select("*", F.lit(None).cast("double").alias("near"), F.lit(None).cast("long").alias("pair"))

    def merge(held: pa.Table, bounds: pa.Table) -> pa.Table:
        far, outside = beyond(held.column("grp")[0].as_py())
        ids, x, s, h, _ = _arrays(held)
        bounds = bounds.sort_by("id").combine_chunks()
        w, to = bounds.column("w").to_numpy(), bounds.column("to").to_numpy()
        seen = bounds.column("near").to_numpy()
        looked = np.zeros((len(ids), len(far)), bool)
        for at in range(0, len(ids) if len(far) else 0, 4096):
            part = slice(at, at + 4096)
            looked[part] = outside.within(x[part], s[part]) <= 2 * w[part, None]
        near = np.where(np.isnan(seen), np.where(looked.any(1), 2 * w, np.inf), seen)
        place = np.where(to >= 0, np.searchsorted(ids, to), -1)
        pair = dict(zip((p := bounds.filter(pa.compute.is_valid(bounds.column("pair")))).column("id").to_pylist(), zip(p.column("pair").to_pylist(), p.column("near").to_pylist(), strict=True), strict=True))
        merges, (ids, x, s, h) = _merged(ids, x, s, h, step, (w, place), near, looked, outside)
        comp, into, height, at = (np.concatenate([m[i] for m in merges]) if merges else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, float, np.int32)))
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        mine = [pair.get(i, (None, None)) for i in ids.tolist()]
        return pa.table({
            "id": np.concatenate([ids, comp]),
            "v": pa.concat_arrays([vectors, pa.nulls(len(comp), pa.list_(pa.float64()))]),
            "size": np.concatenate([s, np.zeros(len(comp))]),
            "height": np.concatenate([h, height]),
            "into": pa.array([m[0] for m in mine] + into.tolist(), pa.int64()),
            "w": pa.array([m[1] for m in mine] + [None] * len(comp), pa.float64()),
            "step": np.concatenate([np.full(len(ids), step, np.int32), at]),
        })

    left = written(table.groupBy("grp").cogroup(own.groupBy("grp")).applyInArrow(merge, "id long, v array<double>, size double, height double, into long, w double, step int"), "left")
    ends = left.where("v is not null and into is not null")
    a = ends.where("id = into").select("into", F.col("v").alias("v_a"), F.col("size").alias("s_a"), F.col("height").alias("h_a"), "w")
    b = ends.where("id <> into").select(F.col("id").alias("comp"), "into", F.col("v").alias("v_b"), F.col("size").alias("s_b"), F.col("height").alias("h_b"))
    both, total = written(a.join(b, "into"), "pairs"), F.col("s_a") + F.col("s_b")
    mean = F.zip_with("v_a", "v_b", lambda x, y: (x * F.col("s_a") + y * F.col("s_b")) / total)
    # Rounding may not put a merge below those that it is made of.
    height, none = F.greatest("w", "h_a", "h_b"), F.lit(None).cast("long")
    merged = both.select(F.col("into").alias("id"), mean.alias("v"), total.alias("size"), height.alias("height"), none.alias("into"), F.lit(step).alias("step"))
    gone = both.select(F.col("comp").alias("id"), F.lit(None).cast("array<double>").alias("v"), F.lit(0.0).alias("size"), height.alias("height"), "into", F.lit(step).alias("step"))
    return left.where("v is null or into is null").drop("w").unionByName(merged).unionByName(gone)


def ward_merges(rows: DataFrame) -> DataFrame:
    """(comp, into, height, step): the n - 1 merges of Ward's linkage (``ward.D2``), in which the cluster of least id ``comp`` goes into ``into``.

    rows: doc_id (distinct longs), reduced (vectors of one length). Heights never fall from a cluster's parts to it, and of equal heights
    a later step is the later merge. Equal vectors merge first, at 0. No rows, or one, have no merges.
    """
    rows = written(rows.select(F.col("doc_id").cast("long").alias("id"), F.col("reduced").cast("array<double>").alias("v")), "points")
    equal = rows.groupBy("v").agg(F.min("id").alias("into"), F.count("*").cast("double").alias("size"))
    clusters = written(equal.select(F.col("into").alias("id"), "v", "size", F.lit(0.0).alias("height")), "clusters")
    copies = rows.join(clusters.where("size > 1").select("v", F.col("id").alias("into")), "v").where("id <> into")
    merges = written(copies.select(F.col("id").alias("comp"), "into", F.lit(0.0).alias("height"), F.lit(0).alias("step")), "merges")
    step, n = 1, clusters.count()
    while n > TAIL:
        after = _round(clusters, n, step)
        merges = merges.unionByName(after.where("v is null").select(F.col("id").alias("comp"), "into", "height", "step"))
        clusters = after.where("v is not null").select("id", "v", "size", "height")
        n, last = after.agg(F.count("v"), F.max("step")).first()
        step = last + 1

    def end(table: pa.Table) -> pa.Table:
        ids, x, s, h = _arrays(table)
        out, _ = _merged(ids, x, s, h, step)
        return pa.table({n: np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, (n, t) in enumerate((("comp", np.int64), ("into", np.int64), ("height", float), ("step", np.int32)))})

    last = clusters.select(F.lit(0).alias("one"), "id", "v", "size", "height").groupBy("one").applyInArrow(end, _MERGES)
    return written(merges.unionByName(written(last, "last")).withColumn("height", F.sqrt("height")), "merges")


def _numbered(roots: DataFrame) -> DataFrame:
    """(doc_id, topic) from (id, root): topics from 0 in the order of roots, which are as many as clusters."""
    number = roots.select("root").distinct().select("root", (F.row_number().over(W.orderBy("root")) - 1).cast("int").alias("topic"))
    return roots.join(number, "root").select(F.col("id").alias("doc_id"), "topic")


def ward_cut(ids: DataFrame, merges: DataFrame, k: int) -> DataFrame:
    """(doc_id, topic): the clusters left without the last k - 1 merges, numbered from 0 by their least id. ids: doc_id."""
    undone = merges.orderBy(F.desc("height"), F.desc("step"), F.desc("comp")).limit(max(k - 1, 0)).select("comp")
    kept = merges.join(undone, "comp", "left_anti").select("comp", "into")
    parents = ids.select(F.col("doc_id").cast("long").alias("comp")).join(kept, "comp", "left").select("comp", F.coalesce("into", "comp").alias("into"))
    return _numbered(jumped(written(parents, "parents")).select(F.col("comp").alias("id"), F.col("into").alias("root")))


def forest_roots(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each row's tree. ids: id; edges (u, v) without a cycle.

    Each tree's part takes one of its edges; in a forest these make no cycle but a pair that took the same one.
    """
    own = written(ids.select("id", F.col("id").alias("comp")), "parts")
    edges = written(edges.select("u", "v"), "edges")
    while not edges.isEmpty():
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        taken = ways.groupBy("u").agg(F.min(F.struct(F.xxhash64(F.least("u", "v"), F.greatest("u", "v")), "v")).alias("e")).select(F.col("u").alias("comp"), F.col("e.v").alias("other"))
        back = taken.select(F.col("comp").alias("other"), F.col("other").alias("back"))
        mutual = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other"))
        into = jumped(written(taken.join(back, "other").select("comp", F.when(mutual, F.col("comp")).otherwise(F.col("other")).alias("into")), "into"))
        own = written(own.join(into, "comp", "left").select("id", F.coalesce("into", "comp").alias("comp")), "parts")
        end = lambda e, into=into: into.select(F.col("comp").alias(e), F.col("into").alias(f"{e}_into"))
        edges = written(edges.join(end("u"), "u").join(end("v"), "v").where("u_into <> v_into").select(F.col("u_into").alias("u"), F.col("v_into").alias("v")), "edges")
    roots = own.groupBy("comp").agg(F.min("id").alias("root"))
    return own.join(roots, "comp").select("id", "root")


def single_cut(rows: DataFrame, k: int) -> DataFrame:
    """(doc_id, topic) of single linkage: the spanning tree of distances without its k - 1 longest edges. rows as for ``ward_merges``."""
    ids = rows.select(F.col("doc_id").cast("long").alias("id"))
    tree = written(spanning_tree(rows.select("doc_id", "reduced", F.lit(0.0).alias("core"))), "tree")
    undone = tree.orderBy(F.desc("w"), F.desc("u"), F.desc("v")).limit(max(k - 1, 0)).select("u", "v")
    return _numbered(forest_roots(ids, tree.join(undone, ["u", "v"], "left_anti")))
