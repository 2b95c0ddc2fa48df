"""NumPy kernels that run inside grouped Arrow functions, one group (scan or tree) at a time."""

from __future__ import annotations

import math

import numpy as np


def nearest(points: np.ndarray, k: int, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other rows of each row and their distances; ties to the lower row number.

    Rows are sorted along the first axis; a block of them looks at a stretch of neighbours that
    doubles until the k-th distance is no greater than the gap to what lies outside the stretch.
    """
    n = len(points)
    k = min(k, n - 1)
    if k <= 0:
        return np.empty((n, 0), np.int64), np.empty((n, 0))
    order = np.argsort(points[:, 0], kind="stable")
    p = points[order]
    who, far = np.empty((n, k), np.int64), np.empty((n, k))
    for a in range(0, n, block):
        b = min(n, a + block)
        reach = max(4 * k, 256)
        while True:
            lo, hi = max(0, a - reach), min(n, b + reach)
            d2 = np.zeros((b - a, hi - lo))
            for axis in range(p.shape[1]):
                diff = p[a:b, None, axis] - p[None, lo:hi, axis]
                d2 += diff * diff
            d2[np.arange(b - a), np.arange(a, b) - lo] = np.inf
            d = np.sqrt(d2)
            some = np.argpartition(d, k - 1, axis=1)[:, :k]
            kth = np.take_along_axis(d, some, 1).max(1)
            left = p[a:b, 0] - (p[lo - 1, 0] if lo else -np.inf)
            right = (p[hi, 0] if hi < n else np.inf) - p[a:b, 0]
            if (kth < np.minimum(left, right)).all() or (lo == 0 and hi == n):
                break
            reach *= 2
        ids = order[lo:hi]
        # By row number, then stably by distance.
        some = np.take_along_axis(some, np.argsort(ids[some], axis=1), 1)
        some = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
        for r in np.flatnonzero((d <= kth[:, None]).sum(1) > k).tolist():
            near = np.flatnonzero(d[r] <= kth[r])
            some[r] = near[np.lexsort((ids[near], d[r, near]))][:k]
        who[order[a:b]], far[order[a:b]] = ids[some], np.take_along_axis(d, some, 1)
    return who, far


def nearest_by(points: np.ndarray, k: int, metric, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """As `nearest`, under any metric: `metric(a, b)` gives the distances of each row of a to each row of b."""
    n = len(points)
    k = min(k, n - 1)
    who, far = np.empty((n, max(k, 0)), np.int64), np.empty((n, max(k, 0)))
    for a in range(0, n if k > 0 else 0, block):
        d = np.array(metric(points[a : a + block], points), np.float64)
        rows = np.arange(len(d))
        d[rows, rows + a] = np.inf
        who[a : a + block] = np.argsort(d, axis=1, kind="stable")[:, :k]
        far[a : a + block] = np.take_along_axis(d, who[a : a + block], 1)
    return who, far


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 minus the cosine of the angle; a vector without length is at distance 1 from all."""
    length = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
    dot = np.zeros(length.shape)
    for axis in range(a.shape[1]):
        dot += a[:, None, axis] * b[None, :, axis]
    return 1.0 - np.where(length > 0, dot / np.where(length > 0, length, 1.0), 0.0)


def nearest_of(q: np.ndarray, who: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and distance of the k rows of `p` nearest to each row of `q`, by row and distance, ties to the lower id.

    `who` are the ids of `q`: a row is no neighbour of itself; nothing beyond a row's `bound` is returned.
    """
    order = np.argsort(ids, kind="stable")
    p, ids = p[order], ids[order]
    rows, found, fars = [np.empty(0, np.int64)], [np.empty(0, ids.dtype)], [np.empty(0)]
    own = np.searchsorted(ids, who)
    for a in range(0, len(q) if len(p) else 0, block):
        b = min(len(q), a + block)
        d = np.zeros((b - a, len(p)))
        for axis in range(p.shape[1]):
            diff = q[a:b, None, axis] - p[None, :, axis]
            d += diff * diff
        np.sqrt(d, out=d)
        at = np.minimum(own[a:b], len(p) - 1)
        self = np.flatnonzero(ids[at] == who[a:b])
        d[self, at[self]] = np.inf
        last = min(k, len(p)) - 1
        limit = np.minimum(np.partition(d, last, axis=1)[:, last], bound[a:b])
        r, c = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        far = d[r, c]
        near = np.lexsort((c, far, r))
        r, c, far = r[near], c[near], far[near]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        rows.append(r[keep] + a)
        found.append(ids[c[keep]])
        fars.append(far[keep])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(fars)


def nearest_features(
    q: np.ndarray, who: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int, loop: bool = True, block: int = 256,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `nearest_of` for rows of many features: matrix products rule out, plain sums of squares decide.

    A product's rounding error is bounded by the lengths of the rows; whatever may be among the k nearest
    within that bound is measured exactly.  Columns fall into groups: the k-th of the groups' least values is no
    nearer than the k-th neighbour, and only groups that reach it are looked into.  With `loop` a row is its own neighbour.
    """
    order = np.argsort(ids, kind="stable")
    p, ids = p[order], ids[order]
    rows, found, fars = [np.empty(0, np.int64)], [np.empty(0, ids.dtype)], [np.empty(0)]
    n, last = len(p), min(k, len(p)) - 1
    if last < 0:
        return rows[0], found[0], fars[0]
    own, squares = np.searchsorted(ids, who), (p * p).sum(1)
    groups = min(n, max(8 * (last + 1), math.isqrt(n)))
    members = np.arange(0, n, groups)
    # One product gives the square less the row's own, which no comparison needs; columns beyond n are at infinity.
    columns = np.zeros((p.shape[1] + 1, groups * len(members)))
    columns[:-1, :n], columns[-1, :n], columns[-1, n:] = p.T, squares, np.inf
    room = np.empty((min(block, len(q)), columns.shape[1]))
    for a in range(0, len(q), block):
        some = q[a : a + block]
        lengths = (some * some).sum(1)
        rough = np.matmul(np.concatenate([-2.0 * some, np.ones((len(some), 1))], axis=1), columns, out=room[: len(some)])
        if not np.isfinite(lengths).all():
            rough[~np.isfinite(lengths)] = np.inf
        if not loop:
            at = np.minimum(own[a : a + block], n - 1)
            self = np.flatnonzero(ids[at] == who[a : a + block])
            rough[self, at[self]] = np.inf
        slack = 8 * (p.shape[1] + 4) * np.finfo(float).eps * (lengths + squares.max())
        least = rough.reshape(len(some), len(members), groups).min(1)
        limit = np.partition(least, last, axis=1)[:, last] + slack
        if np.isfinite(limit).all():
            r, g = np.nonzero(least <= limit[:, None])
            r, c = np.repeat(r, len(members)), (g[:, None] + members).ravel()
        else:
            limit = np.partition(rough, last, axis=1)[:, last] + slack
            r, c = np.nonzero(rough <= limit[:, None])
        value = rough[r, c]
        held = (value <= limit[r]) & np.isfinite(value)
        r, c = r[held], c[held]
        far = np.zeros(len(r))
        for axis in range(p.shape[1]):
            diff = some[r, axis] - p[c, axis]
            far += diff * diff
        np.sqrt(far, out=far)
        near = np.lexsort((c, far, r))
        r, c, far = r[near], c[near], far[near]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        rows.append(r[keep] + a)
        found.append(ids[c[keep]])
        fars.append(far[keep])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(fars)


def pixel_edges(ids: np.ndarray, row: np.ndarray, col: np.ndarray, p: np.ndarray, width: int, far: float, near: float, same: float, dz: float, steps: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of point numbers with their distances, of neighbouring pixels of one range image: below, to the right, inside."""
    pixel = row * width + col
    order = np.argsort(pixel, kind="stable")
    held, start, count = np.unique(pixel[order], return_index=True, return_counts=True)

    def meet(a: np.ndarray, wanted: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points `a` with all close ones in the pixels `wanted`."""
        if not len(a):
            return a, a, np.empty(0)
        k = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
        n = np.where(held[k] == wanted, count[k], 0)
        a = np.repeat(a, n)
        b = order[np.repeat(start[k], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
        d2 = np.zeros(len(a))
        for axis in range(3):
            diff = p[a, axis] - p[b, axis]
            d2 += diff * diff
        d = np.sqrt(d2)
        close = (np.abs(p[a, 2] - p[b, 2]) < dz) & (d < limit)
        return a[close], b[close], d[close]

    every = np.arange(len(ids))
    out = [meet(every, pixel + width, far)]
    left = every
    for step in range(1, steps + 1):
        found = meet(left, row[left] * width + (col[left] + step) % width, near)
        out.append(found)
        left = np.setdiff1d(left, found[0], assume_unique=False)
    a, b, d = meet(every, pixel, same)
    once = ids[a] < ids[b]
    return [*out, (a[once], b[once], d[once])]


def pixel_pairs(row: np.ndarray, col: np.ndarray, steps: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of all pairs of neighbouring pixels: `steps` are rows down and columns on, from an even row and an odd one."""
    low = col.min(initial=0) - 1
    width = int(col.max(initial=0)) - int(low) + 2
    pixel = row * width + (col - low)
    order = np.argsort(pixel, kind="stable")
    held, start, count = np.unique(pixel[order], return_index=True, return_counts=True)
    firsts, seconds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for down, even, odd in steps:
        wanted = pixel + down * width + np.where(row % 2 == 0, even, odd)
        k = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
        n = np.where(held[k] == wanted, count[k], 0)
        a = np.repeat(np.arange(len(pixel)), n)
        firsts.append(a)
        seconds.append(order[np.repeat(start[k], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)])
    return np.concatenate(firsts), np.concatenate(seconds)


def invariant(points: np.ndarray, neighbours: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rho of points (n), rho, theta and phi of their neighbours (n, k); NaN where a direction has no length.

    theta is the angle between both directions from the origin; phi the least angle, seen along the
    point's direction, to another neighbour.
    """
    dot = lambda a, b: a[..., 0] * b[..., 0] + a[..., 1] * b[..., 1] + a[..., 2] * b[..., 2]
    with np.errstate(invalid="ignore", divide="ignore"):
        q = points[neighbours]
        rho_i, rho_j = np.sqrt(dot(points, points)), np.sqrt(dot(q, q))
        u, v = (points / rho_i[:, None])[:, None], q / rho_j[..., None]
        theta = np.arccos(np.clip(dot(u, v), -1.0, 1.0))
        t = q - dot(u, q)[..., None] * u
        t = t / np.sqrt(dot(t, t))[..., None]
        c = dot(t[:, :, None], t[:, None, :])
        angle = np.arctan2(np.sqrt(np.clip(1.0 - c * c, 0.0, 1.0)), c)
        angle[:, np.arange(q.shape[1]), np.arange(q.shape[1])] = np.nan
        phi = np.where(np.isnan(angle), np.inf, angle).min(2, initial=np.inf)
    return rho_i, rho_j, theta, np.where(np.isinf(phi), np.nan, phi)


class Forest:
    """Disjoint sets with path halving; every set is named by its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.size = [1] * n

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.size[a] += self.size[b]
        return True


def components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least member of every node's component."""
    label = np.arange(n)
    while len(src):
        low = np.minimum(label[src], label[dst])
        new = label.copy()
        np.minimum.at(new, label[src], low)
        np.minimum.at(new, label[dst], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        new = new[label]
        if (new == label).all():
            return label
        label = new
    return label


def spanning_tree(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    """A minimum spanning forest: numbers of its edges in order (by weight, then ends), and for each the sizes
    of the two sets that it joined, that of its first end first."""
    forest, kept, sizes = Forest(n), [], []
    for e in np.lexsort((dst, src, w)).tolist():
        a, b = forest.find(int(src[e])), forest.find(int(dst[e]))
        both = forest.size[a], forest.size[b]
        if forest.union(a, b):
            kept.append(e)
            sizes.append(both)
            if len(kept) == n - 1:
                break
    return kept, sizes


def local_forest(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of forest edges found by rounds of least outward edges, and every node's component (one of its nodes).

    Rows go by their order; `dst` is -1 where an edge leaves these n nodes.  A component whose least edge leaves
    them waits, as its other edges may not be the forest's; others may still join it.
    """
    label, won, live = np.arange(n), [np.empty(0, np.int64)], np.arange(len(src))
    while True:
        a, b = label[src[live]], np.where(dst[live] >= 0, label[dst[live]], -1)
        apart = a != b
        live, a, b = live[apart], a[apart], b[apart]
        place = np.arange(len(live))
        least = np.full(n, len(live))
        np.minimum.at(least, a, place)
        np.minimum.at(least, b[b >= 0], place[b >= 0])
        c = np.flatnonzero(least < len(live))
        c = c[b[least[c]] >= 0]
        if not len(c):
            return np.concatenate(won), label
        e = least[c]
        won.append(live[np.unique(e)])
        to = np.arange(n)
        to[c] = a[e] + b[e] - c
        # Two that picked one edge point to each other: the lower one is their root.
        root = c[(to[to[c]] == c) & (c < to[c])]
        to[root] = root
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def merge_tree(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Single linkage: rows (left, right, height, size), one a merge; node n + k is made by merge k."""
    kept, _ = spanning_tree(n, src, dst, w)
    forest, name, out = Forest(n), list(range(n)), []
    size = [1] * (2 * n)
    for k, e in enumerate(kept):
        a, b = forest.find(int(src[e])), forest.find(int(dst[e]))
        left, right = sorted((name[a], name[b]))
        size[n + k] = size[left] + size[right]
        out.append((left, right, float(w[e]), size[n + k]))
        forest.union(a, b)
        name[forest.find(a)] = n + k
    return np.array(out).reshape(-1, 4)


def tour(parent: np.ndarray) -> np.ndarray:
    """Place of every node in a walk that meets each node before its children; roots (parent -1) in turn."""
    n = len(parent)
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(-1, n + 1))
    children, first = order.tolist(), first.tolist()
    place, at = np.empty(n, np.int64), 0
    open_ = children[first[0] : first[1]][::-1]
    while open_:
        node = open_.pop()
        place[node] = at
        at += 1
        open_ += children[first[node + 1] : first[node + 2]][::-1]
    if at < n:
        raise ValueError("the parents run in a circle")
    return place


class CommonAncestors:
    """Lowest common ancestors of the nodes of a forest, from least values over stretches of its tour.

    Between two nodes of the tour the parents' least place is their common ancestor's.  A table holds the
    least of all stretches whose length is a power of two, so two looks answer a question, n log n in all.
    """

    def __init__(self, parent: np.ndarray):
        n = len(parent)
        self.place = tour(parent)
        self.node = np.empty(n, np.int64)
        self.node[self.place] = np.arange(n)
        up = parent[self.node]
        self.least = [np.where(up >= 0, self.place[up], -1)]
        half = 1
        while 2 * half <= n:
            last = self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))
            half *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common ancestors of nodes; -1 for nodes of different trees."""
        low, high = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b])
        out = np.array(a, np.int64)
        apart = np.flatnonzero(low < high)
        low, high = low[apart] + 1, high[apart]
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        found = np.empty(len(apart), np.int64)
        for k in np.unique(level):
            some = level == k
            found[some] = np.minimum(self.least[k][low[some]], self.least[k][high[some] - (1 << int(k)) + 1])
        out[apart] = np.where(found >= 0, self.node[found], -1)
        return out

    def depth(self) -> np.ndarray:
        """Steps of every node to its root."""
        up = self.least[0] if len(self.node) else np.empty(0, np.int64)
        depth = np.where(up >= 0, 1, 0)
        while (up >= 0).any():
            depth = depth + np.where(up >= 0, depth[up], 0)
            up = np.where(up >= 0, up[up], -1)
        out = np.empty(len(depth), np.int64)
        out[self.node] = depth
        return out


def assignment(gain: np.ndarray) -> np.ndarray:
    """The column of every row of a square matrix under the one-to-one choice of greatest sum.

    Rows enter one by one; each is matched along the shortest augmenting path under prices of rows and
    columns (the Hungarian method), n steps of n² each.
    """
    n = len(gain)
    cost = gain.max(initial=0) - gain.astype(np.float64)
    row_price, col_price = np.zeros(n), np.zeros(n + 1)
    owner = np.full(n + 1, -1)
    for row in range(n):
        owner[n], col = row, n
        least, before, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while owner[col] >= 0:
            done[col] = True
            i = owner[col]
            free = np.flatnonzero(~done[:n])
            reduced = cost[i, free] - row_price[i] - col_price[free]
            better = reduced < least[free]
            least[free[better]], before[free[better]] = reduced[better], col
            nearest = free[np.argmin(least[free])]
            step = least[nearest]
            held = np.flatnonzero(done)
            row_price[owner[held]] += step
            col_price[held] -= step
            least[free] -= step
            col = nearest
        while col != n:
            owner[col] = owner[before[col]]
            col = before[col]
    out = np.empty(n, np.int64)
    out[owner[:n]] = np.arange(n)
    return out


#: The neighbours of a cloth particle: all at one or two steps along the axes.
CLOTH_NEIGHBOURS = [(dr, dc) for dr in range(-2, 3) for dc in range(-2, 3) if 1 <= abs(dr) + abs(dc) <= 2]


def cloth(low: np.ndarray, mask: np.ndarray, step: float, rigidness: int = 3, local: float = 1.0, most: int = 200, eps: float = 0.01, masked: bool = False) -> np.ndarray:
    """Heights of a cloth that rises until it meets `low`; outside the image a neighbour counts as the cell itself.

    `masked`: only neighbours in `mask` count, and a cell without any is pulled to 0.
    """
    now = np.zeros(low.shape)
    before = now.copy()
    fixed = np.zeros(low.shape, bool)
    h, w = low.shape
    rows, cols = np.arange(h)[:, None], np.arange(w)[None, :]
    # Places of the neighbours, and whether they count.
    sides = []
    for dr, dc in CLOTH_NEIGHBOURS:
        inside = (rows + dr >= 0) & (rows + dr < h) & (cols + dc >= 0) & (cols + dc < w)
        at = np.where(inside, (rows + dr) * w + cols + dc, rows * w + cols)
        sides.append((at, mask.ravel()[at] if masked else np.ones(low.shape, bool)))
    count = np.sum([use for _, use in sides], axis=0)
    for _ in range(most):
        new = np.where(fixed, now, 2 * now - before + step)
        hit = new >= low
        new[hit] = low[hit]
        fixed |= hit
        for _ in range(rigidness):
            total = np.zeros(low.shape)
            flat = new.ravel()
            for at, use in sides:
                total += np.where(use, flat[at], 0.0)
            mean = total / np.maximum(count, 1)
            new = np.where(fixed, new, new + local * (mean - new))
        move = np.abs(now - new)[mask].max(initial=0.0)
        before, now = now, new
        if move <= eps:
            break
    return now


def eigen_normals(points: np.ndarray, neighbours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest eigenvector and ascending eigenvalues of the covariance of each point with its neighbours."""
    group = np.concatenate([np.arange(len(points))[:, None], neighbours], axis=1)
    p = points[group]
    centred = p - p.mean(1, keepdims=True)
    values, vectors = np.linalg.eigh(np.einsum("nki,nkj->nij", centred, centred) / group.shape[1])
    return vectors[:, :, 0], np.maximum(values, 0)
