"""A low-dimensional layout of a neighbour graph by rounds of gradient steps over blocks of rows.

The fuzzy graph is an edge table. Each edge belongs to the block of one of its ends, so a block has no more edges than its rows have neighbours. In a
round a block gets its rows' places and those of its edges' other ends, takes some epochs on them, and gives back where each went; a
point that several blocks moved goes to the mean of these places, weighed by the steps each took with it. Points push off a bounded sample of all places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .balls import cells_of

#: Rows of a block, about; places that points push off, at most some twice as many; epochs of a round where there are several blocks.
ROWS, PUSHERS, STEP = 2048, 2000, 5


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + a x^2b) is nearest, by least squares, to 1 up to ``min_dist`` and exp(-(x - min_dist) / spread) beyond."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    at, damp = np.zeros(2), 1e-2  # logarithms of a and b

    def miss(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.exp(p)
        power = a * x ** (2 * b)
        slope = -power / (1 + power) ** 2
        return 1 / (1 + power) - y, np.column_stack([slope, slope * 2 * b * np.log(x)])

    r, j = miss(at)
    for _ in range(200):
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), -j.T @ r)
        new, slopes = miss(at + step)
        if new @ new < r @ r:
            at, r, j, damp = at + step, new, slopes, damp / 3
            if np.abs(step).max() < 1e-10:
                break
        elif damp > 1e9:
            break
        else:
            damp *= 4
    return float(np.exp(at[0])), float(np.exp(at[1]))


def fuzzy_edges(near: DataFrame, k: int) -> DataFrame:
    """(id, other, w), each pair once: the fuzzy union of both directions. near: id, rank, neighbor, distance, ``k`` of them or fewer.

    An edge is kept with an end that has the other among its neighbours (the lesser where both have).
    """
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor", "distance"))).alias("near"))
    lists = lists.select("id", F.col("near.neighbor").alias("neighbor"), F.col("near.distance").alias("distance"))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            d = np.full((len(pdf), k), np.inf)
            for i, x in enumerate(pdf["distance"]):
                d[i, : len(x)] = x
            d -= d[:, :1]
            low, high = np.full(len(d), 1e-6), np.full(len(d), 1e3)
            for _ in range(60):
                sigma = (low + high) / 2
                over = np.exp(-d / sigma[:, None]).sum(1) > np.log2(k)
                low, high = np.where(over, low, sigma), np.where(over, sigma, high)
            w = np.exp(-d / sigma[:, None])
            yield pd.DataFrame({"id": pdf["id"], "neighbor": pdf["neighbor"], "w": [w[i, : len(x)] for i, x in enumerate(pdf["distance"])]})

    each = lists.mapInPandas(weigh, "id long, neighbor array<long>, w array<double>")
    each = each.select("id", F.explode(F.arrays_zip("neighbor", "w")).alias("e")).select("id", F.col("e.neighbor").alias("other"), "e.w")
    both = each.groupBy(F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi")).agg(
        F.min("id").alias("id"), F.when(F.count("*") > 1, F.sum("w") - F.min("w") * F.max("w")).otherwise(F.max("w")).alias("w")
    )
    return both.select("id", (F.when(F.col("id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))).alias("other"), "w")


def _epochs(y: np.ndarray, head: np.ndarray, tail: np.ndarray, p: np.ndarray, pushers: np.ndarray | None, ab: tuple[float, float], rates: list[float], rng: np.random.Generator) -> np.ndarray:
    """Moves y in place: edges pull both ends as often as their weight p says, and ends push off others. How many steps each took."""
    a, b = ab
    took = np.zeros(len(y))
    for rate in rates:
        use = rng.random(len(p)) < p
        i, j = head[use], tail[use]
        diff = y[i] - y[j]
        d2 = (diff**2).sum(1)
        pull = np.clip((-2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b))[:, None] * diff, -4, 4) * rate
        np.add.at(y, i, pull)
        np.add.at(y, j, -pull)
        np.add.at(took, i, 1)
        np.add.at(took, j, 1)
        for _ in range(3):
            others = y if pushers is None else pushers
            diff = y[i] - others[rng.integers(0, len(others), len(i))]
            d2 = (diff**2).sum(1)
            push = (2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, None] * diff
            np.add.at(y, i, np.clip(push, -4, 4) * rate)
    return took


def _stepper(pushers: np.ndarray | None, ab: tuple[float, float], rates: list[float], seeds: list[int]) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What a block does in a round: (its number, places, edges) to (id, v, took)."""

    def steps(key: tuple, places: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        places, links = places.sort_values("id"), links.sort_values(["id", "other"])
        ids, y = places["id"].to_numpy(), np.stack(places["v"]).astype(float)
        rng = np.random.default_rng([*seeds, int(key[0]) & 0xFFFFFFFF])
        took = _epochs(y, np.searchsorted(ids, links["id"]), np.searchsorted(ids, links["other"]), links["p"].to_numpy(), pushers, ab, rates, rng)
        return pd.DataFrame({"id": ids, "v": list(y), "took": took})

    return steps


def laid_out(start: DataFrame, edges: DataFrame, min_dist: float = 0.0, epochs: int = 60, seed: int = 42) -> DataFrame:
    """(id, v): places after ``epochs``. start: id, v, distinct ids; edges: id, other, w. Rows without an edge stay; no rows give none.

    The same seed gives the same places. Up to ``ROWS`` rows are one block, which takes all epochs at once.
    """
    start, edges = written(start, "start"), written(edges, "edges")
    most = edges.agg(F.max("w")).first()[0]
    if most is None:
        return start
    cells, table = cells_of(start)
    many = max(1, -(-int(cells.rows.max(initial=0)) // (2 * ROWS)))
    block = written(table.select("id", (F.col("cell") * many + F.pmod(F.xxhash64("id"), F.lit(many))).cast("long").alias("block")), "block")
    owned = written(edges.join(block, "id").select("block", "id", "other", (F.col("w") / most).alias("p")), "owned")
    members = written(owned.select("block", "id").union(owned.select("block", "other")).distinct(), "members")
    alone = block.agg(F.count_distinct("block")).first()[0] == 1
    rows, ab = start.count(), curve(min_dist)
    every = max(1, rows // PUSHERS)
    now = start

    for first in range(0, epochs, epochs if alone else STEP):
        rates = [1 - e / epochs for e in range(first, epochs if alone else min(first + STEP, epochs))]
        pushers = None
        if not alone:
            some = now.where(F.pmod(F.xxhash64("id", F.lit(seed + first)), F.lit(every)) == 0).orderBy("id").limit(2 * PUSHERS).collect()
            pushers = np.array([r["v"] for r in some]) if some else None
        held = members.join(now, "id").groupBy("block")
        moved = written(held.cogroup(owned.groupBy("block")).applyInPandas(_stepper(pushers, ab, rates, [seed & 0xFFFFFFFF, first]), "id long, v array<double>, took double"), "moved")
        if alone:
            to = moved.select("id", F.col("v").alias("to"))
        else:
            cells_moved = moved.where("took > 0").select("id", "took", F.posexplode("v").alias("i", "x")).groupBy("id", "i").agg((F.sum(F.col("took") * F.col("x")) / F.sum("took")).alias("x"))
            to = cells_moved.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("to"))
        now = written(now.join(to, "id", "left").select("id", F.coalesce("to", "v").alias("v")), "places")
    return now
