"""Exact neighbours with pruning: cells of a tree, each inside a ball, visited only where a row's k-th distance reaches.

A tree of half-spaces is fitted on a bounded sample (SAMPLE rows by a hash of their id), so it has SAMPLE / LEAST cells at most, and
the list of their balls may go to every task. The sample shapes the cells alone: every row is in one, and each ball holds all rows of its cell.
A row looks in its own cell first, which bounds its k-th distance; then it visits the cells whose ball comes nearer than that
by the triangle inequality. Cells of many rows are blocks of some BLOCK rows. Cells beside one another in the tree are a region: a row is sent
once to each region that it has to look in, not to each cell, and a task holds a region and a part of the rows that look there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written

#: Rows of a block, about; rows that the tree is fitted on, and of them in a cell at least.
BLOCK, SAMPLE, LEAST = 2048, 50_000, 16
#: Bytes of a region's vectors at most. Regions are an eighth of the rows up to that, so that a row looks in few, however many rows there are.
REGION = 32 << 20
#: Rows of a block in the arrays of a task.
_PACKED = "cell int, block long, ids binary, points binary, bounds binary"


@dataclass
class Cells:
    """Half-spaces: node i holds direction[i] . x > cut[i] on its right; below[i] has its children, or -1 - cell for a cell."""

    direction: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        if len(self.center) == 1:
            return np.zeros(len(x), np.int64)
        at = np.zeros(len(x), np.int64)
        inner = np.arange(len(x))
        while len(inner):
            node = at[inner]
            right = np.einsum("ij,ij->i", x[inner], self.direction[node]) > self.cut[node]
            at[inner] = self.below[node, right.astype(np.int64)]
            inner = inner[at[inner] >= 0]
        return -1 - at

    def homes(self, k: int) -> list[np.ndarray]:
        """For each cell the nearest cells that hold k rows together, itself first."""
        out = []
        for c in range(len(self.center)):
            far = ((self.center - self.center[c]) ** 2).sum(1)
            far[c] = -1
            order = np.argsort(far, kind="stable")
            out.append(order[: int(np.searchsorted(np.cumsum(self.rows[order]), k)) + 1])
        return out

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """How near each cell's ball comes to each row, less what rounding may take; infinite for a cell without rows."""
        if len(self.center) == 1:
            return np.broadcast_to(np.where(self.rows > 0, -np.inf, np.inf), (len(x), 1))
        d = np.maximum((x**2).sum(1)[:, None] + (self.center**2).sum(1)[None, :] - 2 * x @ self.center.T, 0)
        slack = 1e-7 * (1 + np.sqrt((x**2).sum(1)))
        return np.where(self.rows > 0, np.sqrt(d) - self.radius - slack[:, None], np.inf)

    def reached(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which cells' balls come within its bound of each row; the bound is widened by what rounding may take."""
        gaps = self.gaps(x)
        return (gaps <= bound[:, None]) & (gaps < np.inf)

    def regions(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(first unit and number of units of each cell's region, blocks of a unit). A region of one large cell is several units, others are one."""
        blocks = max(4, min(int(self.rows.sum()) // 8, REGION // (8 * max(1, self.center.shape[1]))) // BLOCK)
        order, waiting = [], [0]
        while waiting:
            node = waiting.pop()
            if node < 0:
                order.append(-1 - node)
            else:
                waiting += [int(n) for n in self.below[node][::-1]]
        first, many = np.zeros(len(self.center), np.int64), np.ones(len(self.center), np.int64)
        unit, held = 0, 0
        for cell in dict.fromkeys(order):
            own = -(-int(self.rows[cell]) // BLOCK)
            if held and held + own > blocks:
                unit, held = unit + 1, 0
            first[cell], many[cell] = unit, max(1, -(-own // blocks))
            unit, held = (unit + int(many[cell]), 0) if own > blocks else (unit, held + own)
        return first, many, blocks


def _between(along: np.ndarray) -> float:
    """Where two parts of these numbers differ most, by the variance between them; neither has under a sixteenth. Clusters are not cut through."""
    a, n = np.sort(along), len(along)
    low = max(LEAST, n // 16)
    k = np.arange(low, n - low + 1)
    sums = np.cumsum(a)
    apart = k * (n - k) * (sums[k - 1] / k - (sums[-1] - sums[k - 1]) / (n - k)) ** 2
    at = int(k[apart.argmax()])
    return float((a[at - 1] + a[at]) / 2)


def fit_cells(sample: np.ndarray, cells: int) -> Cells:
    """Cuts the largest cell of the sample along its spread until there are ``cells``, or none can be cut."""
    direction, cut, below = [], [], []
    done: list[np.ndarray] = []
    waiting = [(np.arange(len(sample)), None)]
    while waiting:
        waiting.sort(key=lambda w: len(w[0]))
        own, place = waiting.pop()
        x = sample[own]
        split = None
        if len(done) + len(waiting) + 1 < cells and len(own) >= 2 * LEAST:
            one = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
            way = x[((x - one) ** 2).sum(1).argmax()] - one
            along = x @ way
            for middle in (_between(along), float(np.median(along))):
                right = along > middle
                if 0 < right.sum() < len(own):
                    split = way, middle, right
                    break
        if split is None:
            node = -1 - len(done)
            done.append(x.mean(0) if len(own) else np.zeros(sample.shape[1]))
        else:
            node = len(cut)
            direction.append(split[0])
            cut.append(split[1])
            below.append([0, 0])
            waiting += [(own[~split[2]], (node, 0)), (own[split[2]], (node, 1))]
        if place:
            below[place[0]][place[1]] = node
    if not cut:  # one cell: both sides of a plane that all are on one side of
        direction, cut, below = [np.zeros(sample.shape[1])], [0.0], [[-1, -1]]
    n = len(done)
    return Cells(np.array(direction), np.array(cut), np.array(below), np.array(done), np.zeros(n), np.zeros(n, np.int64))


def _points(column: pa.Array) -> np.ndarray:
    """The vectors of an array column as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def placed(rows: DataFrame, cells: Cells, metric: str = "euclidean") -> DataFrame:
    """(id, v, cell) of rows (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = cells.of(_unit(_points(batch.column(1)), metric)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], ["id", "v", "cell"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, cell int")


def cells_of(rows: DataFrame, metric: str = "euclidean", many: int | None = None) -> tuple[Cells, DataFrame]:
    """(cells with the balls of all rows, rows (id, v, cell)). rows: id, v, a table that is read several times. ``many``: cells at most."""
    n = rows.count()
    if n <= BLOCK:  # one cell, whatever its ball
        one = np.zeros((1, 1))
        return Cells(one, np.zeros(1), np.array([[-1, -1]]), one, np.zeros(1), np.array([n])), rows.select("id", "v", F.lit(0).alias("cell"))
    every = max(1, n // SAMPLE)
    sample = _points(rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("v").limit(2 * SAMPLE).toArrow().column("v").combine_chunks())
    cells = fit_cells(_unit(sample if sample.size else np.zeros((0, 1)), metric), max(1, many or -(-n // BLOCK)))
    table = placed(rows, cells, metric)

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius, count = np.zeros(len(cells.center)), np.zeros(len(cells.center), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, own = _unit(_points(batch.column(0)), metric), batch.column(1).to_numpy()
                np.maximum.at(radius, own, np.sqrt(((x - cells.center[own]) ** 2).sum(1)))
                count += np.bincount(own, minlength=len(count))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count), dtype=np.int32)), pa.array(radius), pa.array(count)], ["cell", "radius", "n"])

    parts = table.select("v", "cell").mapInArrow(balls, "cell int, radius double, n long")
    for r in parts.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect():
        cells.radius[r["cell"]], cells.rows[r["cell"]] = r["radius"] * (1 + 1e-12), r["n"]
    return cells, table


def packed(rows: DataFrame) -> DataFrame:
    """Blocks (cell, block, ids, points, bounds) of some BLOCK rows (id, v, cell, bound) of one cell, those of large cells dealt by id."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        out = [table.column("id").to_numpy(), _points(table.column("v").combine_chunks()), table.column("bound").to_numpy()]
        cell, part = table.column("cell")[0].as_py(), table.column("part")[0].as_py()
        return pa.table({"cell": pa.array([cell], pa.int32()), "block": pa.array([(cell << 32) + part], pa.int64()), **{n: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for n, x in zip(("ids", "points", "bounds"), out, strict=True)}})

    return dealt.groupBy("cell", "part").applyInArrow(pack, _PACKED)


def _nearest_of(ids: np.ndarray, x: np.ndarray, bound: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, metric: str, among: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, its place, neighbor, distance) of each row's k nearest among ``others`` within its bound. Vectors of the cosine have norm 1."""
    d = np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0)
    if among:
        d[ids[:, None] == others[None, :]] = np.inf
    # What the product's rounding may have moved is taken in, then distances are made exactly.
    slack = 1e-9 * (1 + (x**2).sum(1)[:, None] + (y**2).max(initial=0))
    most = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
    i, j = np.nonzero(np.isfinite(d) & (d <= np.minimum(most, bound**2 * (1 + 1e-9))[:, None] + slack))
    exact = 1 - np.einsum("ij,ij->i", x[i], y[j]) if metric == "cosine" else np.sqrt(((y[j] - x[i]) ** 2).sum(1))
    order = np.lexsort((others[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    place = np.arange(len(i)) - np.searchsorted(i, np.arange(len(ids)))[i]
    few = place < k
    return i[few], place[few], others[j[few]], exact[few]


def _compare(pairs: DataFrame, k: int, metric: str, among: bool) -> DataFrame:
    """(id, neighbor, distance): for each pair of blocks (ids, points, bounds; ids_b, points_b) the k nearest within the rows' bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, x, bound, others, y = (np.frombuffer(batch.column(i)[row].as_buffer(), np.int64 if i in (0, 3) else np.float64) for i in range(5))
                x, y = _unit(x.reshape(len(ids), -1), metric), _unit(y.reshape(len(others), -1), metric)
                i, _, near, exact = _nearest_of(ids, x, bound, others, y, k, metric, among)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(near), pa.array(exact)], ["id", "neighbor", "distance"])

    return pairs.select("ids", "points", "bounds", "ids_b", "points_b").mapInArrow(run, "id long, neighbor long, distance double")


def _looked(asked: DataFrame, blocks: DataFrame, cells: Cells, seen: np.ndarray, k: int, metric: str, among: bool) -> DataFrame:
    """(id, neighbor, distance): the k nearest in each unit that a row is sent to. asked: id, v, home, cell (the unit), bound; blocks: of the rows looked in.

    A unit's blocks go to as many tasks as its visitors need.
    """
    first, _, per = cells.regions()
    some = max(2, min(int(cells.rows.sum()) // 32 // BLOCK, per // 2)) * BLOCK
    asked = written(asked, "visits")
    parts = [(r["cell"], -(-r["n"] // some)) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()]
    parts = F.broadcast(asked.sparkSession.createDataFrame(parts, "unit int, parts int"))
    of = F.broadcast(asked.sparkSession.createDataFrame([(c, int(u)) for c, u in enumerate(first)], "cell int, first int"))
    unit = (F.col("first") + F.floor((F.col("block") - F.shiftleft(F.col("cell").cast("long"), 32)) / per)).cast("int")
    to = blocks.join(of, "cell").select("cell", "ids", "points", unit.alias("unit")).join(parts, "unit").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    come = asked.withColumnRenamed("cell", "unit").join(parts, "unit").select("unit", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v", "home", "bound")

    def run(visitors: pa.Table, table: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        table, visitors = table.sort_by("cell").combine_chunks(), visitors.sort_by([("home", "ascending"), ("id", "ascending")]).combine_chunks()
        held = []
        for row in range(table.num_rows):
            others = np.frombuffer(table.column("ids")[row].as_buffer(), np.int64)
            held.append((table.column("cell")[row].as_py(), others, _unit(np.frombuffer(table.column("points")[row].as_buffer(), np.float64).reshape(len(others), -1), metric)))
        for start in range(0, visitors.num_rows, BLOCK):
            part = visitors.slice(start, BLOCK).combine_chunks()
            ids, home, bound = (part.column(c).to_numpy() for c in ("id", "home", "bound"))
            x = _unit(_points(part.column("v").combine_chunks()), metric)
            gaps, bound = cells.gaps(x), bound.copy()
            near, far = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), np.inf)
            for cell, others, y in held:
                own = np.flatnonzero((gaps[:, cell] <= bound) & ~seen[home, cell])
                if not len(own):
                    continue
                i, place, new, exact = _nearest_of(ids[own], x[own], bound[own], others, y, k, metric, among)
                both, d = np.zeros((len(own), 2 * k), np.int64), np.full((len(own), 2 * k), np.inf)
                both[:, :k], d[:, :k] = near[own], far[own]
                both[i, k + place], d[i, k + place] = new, exact
                order = np.lexsort((both, d), axis=-1)[:, :k]
                near[own], far[own] = np.take_along_axis(both, order, 1), np.take_along_axis(d, order, 1)
                # What was found bounds what is looked at next.
                last = far[own, k - 1]
                bound[own] = np.minimum(bound[own], np.sqrt(2 * np.maximum(last, 0)) if metric == "cosine" else last)
            row, at = np.nonzero(np.isfinite(far))
            out.append((ids[row], near[row, at], far[row, at]))
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out])) for i, n in enumerate(("id", "neighbor", "distance"))})

    return come.groupBy("unit", "part").cogroup(to.groupBy("unit", "part")).applyInArrow(run, "id long, neighbor long, distance double")


def _least(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbor"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("id", "rank", "neighbor", "distance")


def _seen(homes: list[np.ndarray]) -> np.ndarray:
    """Which cells (columns) a row of each cell has looked in at home."""
    seen = np.zeros((len(homes), len(homes)), bool)
    for c, own in enumerate(homes):
        seen[c, own] = True
    return seen


def visits(table: DataFrame, first: DataFrame, cells: Cells, homes: list[np.ndarray], k: int, metric: str, by_unit: bool = False) -> DataFrame:
    """(id, v, home, cell, bound): the cells, besides those of its home, that each row has to look in, or ``by_unit`` the units that hold these.

    first: its nearest at home.
    """
    bounds = first.groupBy("id").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
    far = F.when(F.col("n") >= k, F.sqrt(2 * F.greatest("far", F.lit(0.0))) if metric == "cosine" else F.col("far")).otherwise(float("inf"))
    asked = table.join(bounds, "id", "left").select("id", "v", "cell", F.coalesce(far, F.lit(float("inf"))).alias("bound"))
    begin, many, _ = cells.regions()
    # Cells in the order of their regions, the places where a region begins, and what units it has.
    order = np.argsort(begin, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(begin[order]) > 0])
    begin, many, seen = begin[order][at], many[order][at], _seen(homes)
    units, region = np.concatenate([np.arange(b, b + n) for b, n in zip(begin, many, strict=True)]), np.repeat(np.arange(len(at)), many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x, cell, bound = _unit(_points(part.column(1)), metric), part.column(2).to_numpy(), part.column(3).to_numpy()
                reach = cells.reached(x, bound) & ~seen[cell]
                row, to = np.nonzero(np.logical_or.reduceat(reach[:, order], at, axis=1)[:, region] if by_unit else reach)
                own, to = pa.array(row), (units[to] if by_unit else to).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), part.column(2).take(own), pa.array(to), part.column(3).take(own)], ["id", "v", "home", "cell", "bound"])

    return asked.mapInArrow(run, "id long, v array<double>, home int, cell int, bound double")


def nearest(asked: DataFrame, k: int, metric: str = "euclidean", base: DataFrame | None = None) -> DataFrame:
    """(id, rank, neighbor, distance): the exact k nearest others of each row (id, v), or the nearest rows of ``base``, ties by id.

    Vectors have one length. Fewer than k rows give as many as there are; an empty table gives an empty one.
    """
    among, everywhere = base is None, F.lit(float("inf")).alias("bound")
    asked = written(asked.select("id", "v"), "asked")
    base = asked if among else written(base.select("id", "v"), "base")
    cells, own = cells_of(base, metric)
    if not cells.rows.sum():
        return _least(asked.sparkSession.createDataFrame([], "id long, neighbor long, distance double"), k)
    table = own if among else placed(asked, cells, metric)
    blocks = written(packed(own.select("*", everywhere)), "blocks")
    to = blocks.select("cell", F.col("ids").alias("ids_b"), F.col("points").alias("points_b"))
    homes = cells.homes(k + among)
    pairs = asked.sparkSession.createDataFrame([(c, int(h)) for c, own_homes in enumerate(homes) for h in own_homes], "cell int, to int")
    looked = (blocks if among else packed(table.select("*", everywhere))).join(F.broadcast(pairs), "cell").select(F.col("to").alias("cell"), "ids", "points", "bounds")
    first = _least(_compare(looked.join(to, "cell"), k, metric, among), k)
    if len(homes) == 1:
        return first
    first = written(first, "first")
    more = _looked(visits(table, first, cells, homes, k, metric, True), blocks, cells, _seen(homes), k, metric, among)
    return _least(first.drop("rank").unionByName(more), k)
