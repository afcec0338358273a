"""A minimum spanning tree under mutual reachability, by Boruvka rounds over listed neighbours and then over blocks of points.

Each row comes with its nearest neighbours. No edge out of these lists is shorter than the list's end, so a component whose least listed edge is
no longer than the shortest list end of its points may take that edge unseen; as long as there are such components, rounds go over ids and edges alone.
What is left searches: the small components' points whose list ends within their component's best edge look in the cells of space (see ``balls``) that
come as near, and once only large components are left, all but the largest do, where those that lie apart are told by their spans along the lines between
their middles. Visitors are sent to regions of cells, as neighbours are. An edge is offered to both of its ends and ties go by ids, so that no round makes a
cycle. No task holds more than a region and a part of its visitors, and nothing that has a row for each point comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .balls import BLOCK, Cells, _points, cells_of, nearest, packed

#: Neighbours that are listed where none are given; components are large from this share of the rows on; rows that first bounds come from; visitors sent to each task of a join.
LISTED, LARGE, PILOTS, SENT = 8, 64, 2000, 200_000
_EDGE = "comp long, w double, lo long, hi long"


def _first(comp: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """The least edge of each component."""
    order = np.lexsort((hi, lo, w, comp))
    order = order[np.r_[True, comp[order][1:] != comp[order][:-1]]] if len(order) else order
    return pa.RecordBatch.from_arrays([pa.array(v[order]) for v in (comp, w, lo, hi)], ["comp", "w", "lo", "hi"])


def _edges(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], of: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row of x, weight, lo, hi): what may be the least edge of a component to another one among y, none beyond its bound.

    x, y: ids, points, core distances, components; of: the place of each row's component in ``bound``. The product finds candidates, whose weights are then made exactly.
    """
    (ids, points, core, comp), (far, points_y, core_y, comp_y) = x, y
    middle = points.mean(0)
    a, b = points - middle, points_y - middle
    norm, norm_y = (a**2).sum(1), (b**2).sum(1)
    d = a @ (-2 * b.T)
    d += norm[:, None]
    d += norm_y[None, :]
    np.maximum(d, np.square(core_y)[None, :], out=d)
    if (same := comp[:, None] == comp_y[None, :]).any():
        d[same] = np.inf
    best = np.maximum(d.min(1, initial=np.inf), core**2)
    most = np.square(bound)
    np.minimum.at(most, of, best)
    limit = most[of] * (1 + 1e-9) + 1e-12 * (norm + norm_y.max(initial=0))
    some = np.flatnonzero((best <= limit) & np.isfinite(best))
    i, j = np.nonzero((d[some] <= limit[some][:, None]) & np.isfinite(d[some]))
    i = some[i]
    w = np.maximum(np.maximum(np.sqrt(((points_y[j] - points[i]) ** 2).sum(1)), core[i]), core_y[j])
    return i, w, np.minimum(ids[i], far[j]), np.maximum(ids[i], far[j])


def _jumped(best: DataFrame) -> DataFrame:
    """(comp, into) from (comp, other): what each reaches by its chosen edges, by pointer jumping.

    Chosen edges make trees whose only cycle is a pair that chose one another; the lesser of the two is their root.
    """
    back = best.select(F.col("comp").alias("other"), F.col("other").alias("back"))
    mutual = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other"))
    return jumped(written(best.join(back, "other", "left").select("comp", F.when(mutual, F.col("comp")).otherwise(F.col("other")).alias("into")), "into"))


def jumped(into: DataFrame) -> DataFrame:
    """(comp, into) with each row's root in place of its parent; roots are their own. A written table, as it is read in each round."""
    while True:
        on = into.select(F.col("comp").alias("into"), F.col("into").alias("on"))
        further = written(into.join(on, "into").select("comp", F.col("on").alias("into"), (F.col("on") != F.col("into")).alias("moved")), "into")
        into = further.select("comp", "into")
        if further.where("moved").isEmpty():
            return into



def _listed(rows: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components (comp, low, n) of one row each, edges (a, b, w, lo, hi) between them) of rows (id, bound, end) and their lists (id, neighbor, distance)."""
    core = lambda e: rows.select(F.col("id").alias(e), F.col("bound").alias(f"core_{e}"))
    pairs = near.groupBy(F.least("id", "neighbor").alias("lo"), F.greatest("id", "neighbor").alias("hi")).agg(F.min("distance").alias("d"))
    pairs = pairs.where("lo <> hi").join(core("lo"), "lo").join(core("hi"), "hi")
    edges = pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.greatest("d", "core_lo", "core_hi").alias("w"), "lo", "hi")
    return rows.select(F.col("id").alias("comp"), F.greatest("end", "bound").alias("low"), F.lit(1).cast("long").alias("n")), edges


def _best(edges: DataFrame) -> DataFrame:
    """(comp, w, lo, hi, other): each component's least edge."""
    ways = edges.select(F.col("a").alias("comp"), F.struct("w", "lo", "hi", F.col("b").alias("other")).alias("e"))
    ways = ways.unionByName(edges.select(F.col("b").alias("comp"), F.struct("w", "lo", "hi", F.col("a").alias("other")).alias("e")))
    return ways.groupBy("comp").agg(F.min("e").alias("e")).select("comp", "e.*")


def _least_pairs(edges: DataFrame) -> DataFrame:
    """The least edge between two components, which are not the same."""
    pairs = edges.where("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("w", "lo", "hi")).alias("e"))
    return pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "e.*")


def _merged(parts: DataFrame, edges: DataFrame, own: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parts, edges, own) after each component that chose has gone into the one it chose."""
    every = parts.select("comp").join(chosen.select("comp", "other"), "comp", "left").select("comp", F.coalesce("other", "comp").alias("other"))
    into = _jumped(every)
    end = lambda e: into.select(F.col("comp").alias(e), F.col("into").alias(f"{e}_into"))
    moved = edges.join(end("a"), "a").join(end("b"), "b").select(F.col("a_into").alias("a"), F.col("b_into").alias("b"), "w", "lo", "hi")
    own = own.join(into, "comp").select("id", F.col("into").alias("comp"))
    parts = parts.join(into, "comp").groupBy(F.col("into").alias("comp")).agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    return written(parts, "parts"), written(_least_pairs(moved), "edges"), written(own, "components")


class _Search:
    """Points in units of space, in which components look for their least edges."""

    def __init__(self, rows: DataFrame):
        """rows: id, v, bound (the core distance), end."""
        self.rows = rows
        self.cells, table = cells_of(rows.select("id", "v"))
        self.begin, self.many, self.per = self.cells.regions()
        self.total = int(self.cells.rows.sum())
        of = F.broadcast(rows.sparkSession.createDataFrame([(c, int(u)) for c, u in enumerate(self.begin)], "cell int, first int"))
        unit = (F.col("first") + F.floor((F.col("block") - F.shiftleft(F.col("cell").cast("long"), 32)) / self.per)).cast("int")
        blocks = packed(table.join(rows.select("id", "bound"), "id")).join(of, "cell")
        self.blocks = written(blocks.select(unit.alias("unit"), "cell", "ids", "points", "bounds"), "blocks")

        def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    own = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(np.full(len(own), batch.column(c)[i].as_py(), np.int32)) for c in (0, 1))], ["id", "unit", "cell"])

        self.where = written(self.blocks.select("unit", "cell", "ids").mapInArrow(ids, "id long, unit int, cell int"), "where")

    def found(self, own: DataFrame, asking: DataFrame, apart: bool) -> DataFrame:
        """(w, lo, hi): edges with each asking component's least one among them, unless that is its w already. own: id, comp; asking: comp, w; apart: few components, some of them large."""
        own_cells = self.where.join(own, "id")
        pure = np.full(len(self.cells.rows), -1, np.int64)
        for r in own_cells.groupBy("cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a = b").collect():
            pure[r["cell"]] = r["a"]
        asking = F.broadcast(asking) if apart or asking.count() <= SENT else asking
        few = written(own.join(asking, "comp").join(self.rows.select("id", "end"), "id").where("w is null or end <= w").select("id", "comp", F.coalesce("w", F.lit(float("inf"))).alias("w")), "asking")
        come = F.broadcast(few) if few.count() <= SENT else few
        come = written(self.rows.select("id", "v", "bound").join(come, "id"), "visitors")
        out = self._pilot(own, come)
        near = out.groupBy("comp").agg(F.min("w").alias("to"))
        come = come.join(F.broadcast(near) if apart or near.count() <= SENT else near, "comp", "left").select("id", "v", "bound", "comp", F.least("w", "to").alias("w"))
        spans = self._spans(own, own_cells) if apart else None
        met = self._met(self._visits(come, pure, spans), own_cells)
        return out.unionByName(met).select("w", "lo", "hi").distinct()

    def _pilot(self, own: DataFrame, come: DataFrame) -> DataFrame:
        """Edges to a few rows, which bound the search."""
        every = max(1, self.total // PILOTS)
        some = self.rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(2 * PILOTS)
        held = some.select("id", "v", "bound").join(own, "id").collect()
        y = np.array([r["id"] for r in held], np.int64), np.array([r["v"] for r in held], float), np.array([r["bound"] for r in held], float), np.array([r["comp"] for r in held], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    x = part.column(0).to_numpy(), _points(part.column(1)), part.column(2).to_numpy(), part.column(3).to_numpy()
                    names, of = np.unique(x[3], return_inverse=True)
                    bound = np.full(len(names), np.inf)
                    np.minimum.at(bound, of, part.column(4).to_numpy())
                    i, w, lo, hi = _edges(x, y, of, bound)
                    yield _first(x[3][i], w, lo, hi)

        edges = come.select("id", "v", "bound", "comp", "w").mapInArrow(run, _EDGE) if len(held) else self.rows.sparkSession.createDataFrame([], _EDGE)
        return written(edges.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("comp", "e.*"), "pilot")

    def _spans(self, own: DataFrame, own_cells: DataFrame) -> tuple[np.ndarray, ...]:
        """(components, their middles, how far each reaches from the origin towards each other one, which of them each cell holds)."""
        names = np.array(sorted(r["comp"] for r in own.select("comp").distinct().collect()), np.int64)
        held = written(self.rows.select("id", "v").join(own, "id").select("v", "comp"), "spanned")
        k = len(names)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0, np.zeros(k, np.int64)
            for batch in batches:
                if batch.num_rows:
                    at, x = np.searchsorted(names, batch.column(1).to_numpy()), _points(batch.column(0))
                    total, n = total + np.stack([np.bincount(at, c, k) for c in x.T], 1), n + np.bincount(at, minlength=k)
            for i in np.flatnonzero(n):
                yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([int(n[i])], pa.int64()), pa.array([total[i].tolist()], pa.list_(pa.float64()))], ["at", "n", "total"])

        sums = held.mapInArrow(summed, "at int, n long, total array<double>").collect()
        middle, n = np.zeros((k, len(sums[0]["total"]))), np.zeros(k)
        for r in sums:
            middle[r["at"]] += r["total"]
            n[r["at"]] += r["n"]
        middle /= n[:, None]

        def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = np.full((k, k), -np.inf)
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    at = np.searchsorted(names, part.column(1).to_numpy())
                    np.maximum.at(top, at, _towards(_points(part.column(0)), at, middle))
            for i in np.flatnonzero(np.isfinite(top).any(1)):
                yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([top[i].tolist()], pa.list_(pa.float64()))], ["at", "top"])

        top = np.full((k, k), -np.inf)
        for r in held.mapInArrow(most, "at int, top array<double>").collect():
            top[r["at"]] = np.maximum(top[r["at"]], r["top"])
        holds = np.zeros((k, len(self.cells.rows)), np.float32)
        for r in own_cells.select("cell", "comp").distinct().collect():
            holds[np.searchsorted(names, r["comp"]), r["cell"]] = 1
        return names, middle, top, holds

    def _visits(self, come: DataFrame, pure: np.ndarray, spans: tuple[np.ndarray, ...] | None) -> DataFrame:
        """(id, v, bound, comp, w, unit): the units that each visitor has to look in."""
        cells: Cells = self.cells
        order = np.argsort(self.begin, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(self.begin[order]) > 0])
        begin, many = self.begin[order][at], self.many[order][at]
        units, region = np.concatenate([np.arange(b, b + n) for b, n in zip(begin, many, strict=True)]), np.repeat(np.arange(len(at)), many)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    x, comp, w = _points(part.column(1)), part.column(3).to_numpy(), part.column(4).to_numpy()
                    reach = cells.reached(x, w) & (pure[None, :] != comp[:, None])
                    if spans is not None:
                        names, middle, top, holds = spans
                        own = np.searchsorted(names, comp)
                        gap = -top.T[own] - _towards(x, own, middle) - 1e-7 * (1 + np.sqrt((x**2).sum(1)))[:, None]
                        may = gap <= w[:, None]
                        may[np.arange(len(x)), own] = False
                        reach &= may.astype(np.float32) @ holds > 0
                    row, to = np.nonzero(np.logical_or.reduceat(reach[:, order], at, axis=1)[:, region])
                    own = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*(c.take(own) for c in part.columns), pa.array(units[to].astype(np.int32))], ["id", "v", "bound", "comp", "w", "unit"])

        return written(come.select("id", "v", "bound", "comp", "w").mapInArrow(run, "id long, v array<double>, bound double, comp long, w double, unit int"), "visits")

    def _met(self, visits: DataFrame, own_cells: DataFrame) -> DataFrame:
        """(comp, w, lo, hi): the least edges found by visitors, one for each component and task."""
        some = max(4, self.total // 16 // BLOCK) * BLOCK
        parts = [(r["unit"], -(-r["n"] // some)) for r in visits.groupBy("unit").agg(F.count("*").alias("n")).collect()]
        parts = F.broadcast(visits.sparkSession.createDataFrame(parts, "unit int, parts int"))
        dealt = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        blocks = self.blocks.join(parts, "unit").select("unit", dealt.alias("part"), "cell", "ids", "points", "bounds")
        members = own_cells.join(parts, "unit").select("unit", dealt.alias("part"), "id", F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("double").alias("bound"), "comp", F.lit(None).cast("double").alias("w"))
        come = visits.join(parts, "unit").select("unit", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v", "bound", "comp", "w")
        cells = self.cells

        def run(left: pa.Table, table: pa.Table) -> pa.Table:
            visitor = pc.is_valid(left.column("w"))
            member, left = left.filter(pc.invert(visitor)).select(["id", "comp"]).sort_by("id"), left.filter(visitor).sort_by([("comp", "ascending"), ("id", "ascending")]).combine_chunks()
            known, comps = member.column("id").to_numpy(), member.column("comp").to_numpy()
            held = []
            for row in range(table.num_rows):
                ids, y, core = (np.frombuffer(table.column(c)[row].as_buffer(), np.int64 if c == "ids" else np.float64) for c in ("ids", "points", "bounds"))
                held.append((table.column("cell")[row].as_py(), (ids, y.reshape(len(ids), -1), core, comps[np.searchsorted(known, ids)])))
            names, of = np.unique(left.column("comp").to_numpy(), return_inverse=True)
            bound = np.full(len(names), np.inf)
            np.minimum.at(bound, of, left.column("w").to_numpy())
            out = [_first(*(np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64)))]
            for start in range(0, left.num_rows, BLOCK):
                part = left.slice(start, BLOCK).combine_chunks()
                x = part.column("id").to_numpy(), _points(part.column("v").combine_chunks()), part.column("bound").to_numpy(), part.column("comp").to_numpy()
                at, gaps = of[start : start + BLOCK], cells.gaps(x[1])
                for cell, y in held:
                    go = np.flatnonzero((gaps[:, cell] <= bound[at]) & (x[2] <= bound[at]) & ~((y[3] == y[3][0]).all() & (x[3] == y[3][0])))
                    if len(go):
                        i, w, lo, hi = _edges(tuple(v[go] for v in x), y, at[go], bound)
                        found = _first(x[3][go][i], w, lo, hi)
                        np.minimum.at(bound, np.searchsorted(names, found.column(0).to_numpy()), found.column(1).to_numpy())
                        out.append(found)
            every = pa.Table.from_batches(out)
            return pa.Table.from_batches([_first(*(c.to_numpy() for c in every.columns))])

        return come.unionByName(members).groupBy("unit", "part").cogroup(blocks.groupBy("unit", "part")).applyInArrow(run, _EDGE)


def _towards(x: np.ndarray, own: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """How far each row lies along the lines from its component's middle to each other one's; 0 where two middles are one."""
    along = x @ middle.T
    along -= along[np.arange(len(x)), own][:, None]
    apart = np.sqrt(((middle[:, None] - middle[None]) ** 2).sum(2))
    return np.where(apart[own] > 0, along / np.where(apart > 0, apart, 1)[own], 0)


def spanning_tree(rows: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(u, v, w): the n - 1 edges of the tree. rows: doc_id (distinct longs), reduced, core. Fewer than two rows have none.

    near (id, neighbor, distance): the nearest others of each row, exact, as many for each; some are found where none are given.
    """
    spark = rows.sparkSession
    rows = written(rows.select(F.col("doc_id").cast("long").alias("id"), F.col("reduced").cast("array<double>").alias("v"), F.col("core").alias("bound")), "points")
    tree = spark.createDataFrame([], "u long, v long, w double")
    if rows.count() < 2:
        return tree
    near = written((nearest(rows.select("id", "v"), LISTED) if near is None else near).select("id", "neighbor", "distance"), "listed")
    ends = near.groupBy("id").agg(F.max("distance").alias("end"))
    rows = written(rows.join(ends, "id"), "points")
    parts, edges = _listed(rows, near)
    parts, edges, own = written(parts, "parts"), written(edges, "edges"), rows.select("id", F.col("id").alias("comp"))
    search = None
    while parts.count() > 1:
        best = parts.join(_best(edges), "comp", "left")
        sure = F.coalesce(F.col("w") <= F.col("low"), F.lit(False))
        chosen = written(best.where(sure).select("comp", "other", "w", "lo", "hi"), "chosen")
        if chosen.isEmpty():
            search = search or _Search(rows)
            largest = parts.orderBy(F.desc("n"), "comp").first()["comp"]
            asking = best.where(F.col("comp") != largest)
            small = asking.where(F.col("n") * LARGE <= search.total)
            apart = small.isEmpty()
            asking = written((asking if apart else small).select("comp", "w"), "asking")
            end = lambda e: own.select(F.col("id").alias(e), F.col("comp").alias(x))
            new = search.found(own, asking, apart)
            for e, x in (("lo", "a"), ("hi", "b")):
                new = new.join(end(e), e)
            edges = written(_least_pairs(edges.unionByName(new.select("a", "b", "w", "lo", "hi"))), "edges")
            chosen = written(_best(edges).join(asking.select("comp"), "comp", "left_semi").select("comp", "other", "w", "lo", "hi"), "chosen")
        # Two components that chose one another chose the same edge.
        tree = tree.unionByName(chosen.select(F.col("lo").alias("u"), F.col("hi").alias("v"), "w").distinct())
        parts, edges, own = _merged(parts, edges, own, chosen)
    return tree
