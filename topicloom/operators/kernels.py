"""Sequential kernels over arrays: density clustering and linkage. Each runs in one task or on the driver,
for as many points as its caller allows; the quadratic parts before them are distributed."""

from __future__ import annotations

import numpy as np


def single_linkage(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, size, lambda) of the merges of MST edges (u, v, w); node i is a point below n, else merge i - n."""
    edges = edges[np.argsort(edges[:, 2], kind="stable")]
    parent, top, count = np.arange(n), np.arange(n), np.ones(n, np.int64)
    left, right, size, lam = (np.zeros(len(edges), t) for t in (np.int64, np.int64, np.int64, float))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (u, v, w) in enumerate(edges):
        a, b = find(int(u)), find(int(v))
        left[i], right[i], size[i], lam[i] = top[a], top[b], count[a] + count[b], 1 / w if w > 0 else 1e15
        if count[a] < count[b]:
            a, b = b, a
        parent[b] = a
        count[a] = size[i]
        top[a] = n + i
    return left, right, size, lam


def condensed_labels(edges: np.ndarray, n: int, min_pts: int) -> np.ndarray:
    """Labels by excess of mass: 1, 2, ... for clusters, 0 for noise. The root may be the only cluster."""
    if n < 2 or not len(edges):
        return np.zeros(n, np.int64)
    left, right, size, lam = single_linkage(edges, n)
    of = np.full(2 * n - 1, -1)
    birth, mass, children = [0.0], [0.0], [[]]
    root = n + len(left) - 1
    of[root] = 0
    weight = lambda x: 1 if x < n else size[x - n]
    for node in range(root, n - 1, -1):
        c = of[node]
        if c < 0:
            continue
        i = node - n
        a, b = left[i], right[i]
        sa, sb, gain = weight(a), weight(b), lam[i] - birth[c]
        if sa >= min_pts and sb >= min_pts:
            mass[c] += (sa + sb) * gain
            for x in (a, b):
                of[x] = len(birth)
                children[c].append(len(birth))
                birth.append(lam[i])
                mass.append(0.0)
                children.append([])
        elif sa >= min_pts or sb >= min_pts:
            big, small = (a, sb) if sa >= min_pts else (b, sa)
            mass[c] += small * gain
            of[big] = c
        else:
            mass[c] += (sa + sb) * gain
    k = len(birth)
    best, itself = np.array(mass), np.ones(k, bool)
    for c in range(k - 1, -1, -1):
        if children[c]:
            below = sum(best[x] for x in children[c])
            itself[c] = mass[c] >= below
            best[c] = max(mass[c], below)
    chosen, active = np.full(k, -1), [0]
    while active:
        c = active.pop()
        if itself[c]:
            chosen[c] = c
        else:
            active += children[c]
    above = np.full(k, -1)
    for c in range(k):
        for x in children[c]:
            above[x] = c
        if chosen[c] < 0 and above[c] >= 0:
            chosen[c] = chosen[above[c]]
    number = {c: i + 1 for i, c in enumerate(c for c in range(k) if chosen[c] == c)}
    up = np.full(2 * n - 1, -1)
    for i in range(len(left)):
        up[left[i]] = up[right[i]] = n + i
    out = np.zeros(n, np.int64)
    # From the root down a node without a cluster has that of the nearest node above which has one.
    owner = np.full(2 * n - 1, -1)
    for node in range(root, -1, -1):
        owner[node] = of[node] if of[node] >= 0 else owner[up[node]] if up[node] >= 0 else -1
    for p in range(n):
        out[p] = number.get(chosen[owner[p]] if owner[p] >= 0 else -1, 0)
    return out


def leaf_labels(edges: np.ndarray, n: int, min_pts: int) -> np.ndarray:
    """Labels of the lowest nodes that are not split into two parts of ``min_pts`` or more."""
    out = np.zeros(n, np.int64)
    if n < 2 or not len(edges):
        return out
    left, right, size, _ = single_linkage(edges, n)
    weight = lambda x: 1 if x < n else size[x - n]
    stack, label = [n + len(left) - 1], 0
    while stack:
        node = stack.pop()
        if weight(node) < min_pts:
            continue
        if node >= n and weight(left[node - n]) >= min_pts and weight(right[node - n]) >= min_pts:
            stack += [right[node - n], left[node - n]]
            continue
        label += 1
        own = [node]
        while own:
            x = own.pop()
            if x < n:
                out[x] = label
            else:
                own += [left[x - n], right[x - n]]
    return out


def prim(points: np.ndarray, core: np.ndarray) -> np.ndarray:
    """MST edges (u, v, w) under mutual reachability, in quadratic time and linear memory."""
    n = len(points)
    best, link = np.full(n, np.inf), np.zeros(n, np.int64)
    out, now, outside = [], 0, np.ones(n, bool)
    for _ in range(n - 1):
        outside[now] = False
        d = np.sqrt(np.maximum(((points - points[now]) ** 2).sum(1), 0))
        reach = np.maximum(np.maximum(core, core[now]), d)
        nearer = outside & (reach < best)
        best[nearer], link[nearer] = reach[nearer], now
        nxt = int(np.where(outside, best, np.inf).argmin())
        out.append((link[nxt], nxt, best[nxt]))
        now = nxt
    return np.array(out, float).reshape(-1, 3)


def linkage(distance: np.ndarray, method: str = "ward.D2") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) by Lance-Williams updates; clusters are numbered as points, then merges."""
    n = len(distance)
    square = method == "ward.D2"
    d = distance.astype(float) ** 2 if square else distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, live, out = list(range(n)), np.ones(n), np.ones(n, bool), []
    for step in range(n - 1):
        masked = np.where(live[:, None] & live[None, :], d, np.inf)
        i, j = divmod(int(masked.argmin()), n)
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        k = np.flatnonzero(live & (np.arange(n) != i) & (np.arange(n) != j))
        a, b, c = size[i], size[j], size[k]
        if square or method == "ward.D":
            new = ((a + c) * d[i, k] + (b + c) * d[j, k] - c * h) / (a + b + c)
        elif method == "single":
            new = np.minimum(d[i, k], d[j, k])
        elif method == "complete":
            new = np.maximum(d[i, k], d[j, k])
        elif method == "average":
            new = (a * d[i, k] + b * d[j, k]) / (a + b)
        else:
            raise ValueError(f"unknown linkage {method!r}")
        d[i, k] = d[k, i] = new
        out.append((ids[i], ids[j], float(np.sqrt(h)) if square else float(h), int(a + b)))
        size[i], live[j], ids[i] = a + b, False, n + step
    return out


def cut_tree(merges: list[tuple[int, int, float, int]], n: int, k: int) -> np.ndarray:
    """k clusters, numbered from 0 by first appearance."""
    parent = list(range(2 * n))
    for i, (a, b, *_) in enumerate(merges[: n - k]):
        parent[a] = parent[b] = n + i

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    seen: dict[int, int] = {}
    return np.array([seen.setdefault(top(i), len(seen)) for i in range(n)])
