"""Cover trees over blocks of points, as arrays, and their dual traversal. Numpy only; runs inside tasks.

A tree has levels of radius 2, 1, 1/2, ... of its scale. Level by level, centres are chosen among the
points so that each point has a centre within the radius, and centres of a level are centres of
the next. A node is a centre with the points nearest to it in its parent; its covering radius
is their true largest distance. Levels that hardly join any points are left out: in them every
point is a node already and the next level says the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CHUNK = 1024


@dataclass
class Level:
    centre: np.ndarray  # point of each node
    radius: np.ndarray  # covering radius
    first: np.ndarray  # members are order[first[k]:first[k + 1]]
    order: np.ndarray


@dataclass
class Tree:
    points: np.ndarray  # float64 rows
    levels: list[Level] = field(default_factory=list)  # coarse to fine


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, all rows of a against all of b."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0, out=square), out=square)


def cover(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the index of its centre, within the radius; greedy in the order of the points."""
    owner = np.full(len(points), -1)
    best = np.full(len(points), np.inf)
    centres = np.empty(0, int)
    for at in range(0, len(points), CHUNK):
        block = np.arange(at, min(at + CHUNK, len(points)))
        if len(centres):
            for c in range(0, len(centres), CHUNK):
                d = distances(points[block], points[centres[c:c + CHUNK]])
                k = d.argmin(1)
                d = d[np.arange(len(block)), k]
                closer = (d <= radius) & (d < best[block])
                owner[block[closer]], best[block[closer]] = centres[c + k[closer]], d[closer]
        free = block[owner[block] < 0]
        if not len(free):
            continue
        near = distances(points[free], points[free]) <= radius
        np.fill_diagonal(near, True)
        new, open_ = [], np.ones(len(free), bool)
        for k in range(len(free)):
            if open_[k]:
                mine = near[k] & open_
                owner[free[mine]] = free[k]
                best[free[mine]] = distances(points[free[mine]], points[free[k]][None])[:, 0]
                open_ &= ~near[k]
                new.append(free[k])
        centres = np.concatenate([centres, np.array(new, int)])
    return owner


def build(points: np.ndarray, scale: float = 0.5, depth: int = 5) -> Tree:
    """Levels of radius scale / 2 ** k, k below ``depth``, nested: a level is built inside the nodes above."""
    tree = Tree(np.ascontiguousarray(points, np.float64))
    owner = np.zeros(len(points), int)
    for k in range(depth):
        inner = np.empty(len(points), int)
        if k == 0:
            inner[:] = cover(tree.points, scale)
        else:
            order = np.argsort(owner, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(order) else []
            for g in groups:
                if len(g) == 1:
                    inner[g] = g
                else:
                    g = np.concatenate(([owner[g[0]]], g[g != owner[g[0]]]))  # the centre stays one
                    inner[g] = g[cover(tree.points[g], scale / 2 ** k)]
        owner = inner
        order = np.argsort(owner, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(owner[order]) != 0, [True]))) if len(order) else np.zeros(1, int)
        centre = owner[order[edge[:-1]]]
        gap = np.sqrt(((tree.points - tree.points[owner]) ** 2).sum(1))
        radius = np.maximum.reduceat(gap[order], edge[:-1]) if len(order) else np.empty(0)
        level = Level(centre, radius * (1 + 1e-9), edge, order)
        if tree.levels and len(tree.levels[-1].centre) * 10 > len(centre) * 9:
            tree.levels[-1] = level  # the coarser level hardly joined any more
        else:
            tree.levels.append(level)
    return tree


def _children(tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, order, of): child nodes of each node of a level are order[first[k]:first[k + 1]] of the next."""
    upper, lower = tree.levels[level], tree.levels[level + 1]
    of_point = np.empty(len(tree.points), int)
    of_point[upper.order] = np.repeat(np.arange(len(upper.centre)), np.diff(upper.first))
    parent = of_point[lower.centre]
    order = np.argsort(parent, kind="stable")
    return np.searchsorted(parent[order], np.arange(len(upper.centre) + 1)), order, parent


def _product(first_a, order_a, a, first_b, order_b, b, room: int = 2_000_000):
    """All pairs of what hangs below the pairs of nodes (a, b), some at a time."""
    na, nb = first_a[a + 1] - first_a[a], first_b[b + 1] - first_b[b]
    total = np.cumsum(na * nb)
    at = 0
    while at < len(a):
        done = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + room, "right")))
        n, m = na[at:to], nb[at:to]
        reps = n * m
        pair = np.repeat(np.arange(at, to), reps)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(reps) - reps, reps)
        yield order_a[first_a[a[pair]] + k // nb[pair]], order_b[first_b[b[pair]] + k % nb[pair]], pair
        at = to


def _gap(p: np.ndarray, i: np.ndarray, q: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), 200_000):
        out[at:at + 200_000] = np.sqrt(((p[i[at:at + 200_000]] - q[j[at:at + 200_000]]) ** 2).sum(1))
    return out


def dual_pairs(s: Tree, t: Tree, reach: float, same: bool):
    """Dual traversal for all pairs of points within ``reach``.

    Yields ("all", node members of s, of t) for node pairs that lie within reach as a whole,
    and ("some", points of s, points of t) for candidates among leaves: those must be verified.
    Node pairs whose distance less both covering radii exceeds reach are pruned. With ``same``
    (s is t) each pair comes once, and all members of one node may be paired with themselves.
    """
    slack = 1e-7
    top_s, top_t = s.levels[0], t.levels[0]
    fat = np.argsort(top_t.radius, kind="stable")  # nodes of one point first: their bound is sharper
    p, q = s.points[top_s.centre], t.points[top_t.centre[fat]]
    # One product per tile: |p - q| <= bound  <=>  p q - q q / 2 >= (p p - bound ** 2) / 2.
    p = np.concatenate([p, np.ones((len(p), 1))], axis=1)
    q = np.concatenate([q, -(q * q).sum(1)[:, None] / 2], axis=1)
    half_square = (p[:, :-1] ** 2).sum(1) / 2
    step = np.ceil(top_t.radius[fat] * 16 / max(top_t.radius.max(initial=0), 1e-30))  # tiles of like radius
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(step) != 0, [True]))) if len(fat) else np.zeros(1, int)
    a_list, b_list = [], []
    for at in range(0, len(p), CHUNK):
        rows = slice(at, at + CHUNK)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for c in range(lo, hi, 2 * CHUNK):
                cols = slice(c, min(c + 2 * CHUNK, hi))
                bound = reach + slack + top_s.radius[rows] + top_t.radius[fat[cols]].max()
                i, j = np.divmod(np.flatnonzero(p[rows] @ q[cols].T >= (half_square[rows] - bound ** 2 / 2)[:, None]), cols.stop - cols.start)
                a, b = i + at, fat[cols][j]
                keep = _gap(s.points, top_s.centre[a], t.points, top_t.centre[b]) <= reach + slack + top_s.radius[a] + top_t.radius[b]
                if same:
                    keep &= a <= b
                a_list.append(a[keep])
                b_list.append(b[keep])
    a, b = np.concatenate(a_list or [np.empty(0, int)]), np.concatenate(b_list or [np.empty(0, int)])
    for depth in range(len(s.levels)):
        ls, lt = s.levels[depth], t.levels[min(depth, len(t.levels) - 1)]
        d = _gap(s.points, ls.centre[a], t.points, lt.centre[b])
        whole = d + ls.radius[a] + lt.radius[b] <= reach - slack
        big = np.diff(ls.first)[a] * np.diff(lt.first)[b] > 1
        for x, y in zip(a[whole & big], b[whole & big]):
            yield "all", ls.order[ls.first[x]:ls.first[x + 1]], lt.order[lt.first[y]:lt.first[y + 1]], same and x == y
        rest = ~(whole & big)
        a, b, d = a[rest], b[rest], d[rest]
        leaf = (ls.radius[a] == 0) & (lt.radius[b] == 0) & ~big[rest]
        yield "some", ls.centre[a[leaf]], lt.centre[b[leaf]], False
        a, b = a[~leaf], b[~leaf]
        if depth + 1 == len(s.levels):
            for i, j, pair in _product(ls.first, ls.order, a, lt.first, lt.order, b):
                keep = (a[pair] != b[pair]) | (i < j) if same else np.ones(len(i), bool)
                yield "some", i[keep], j[keep], False
            return
        fa, oa, _ = _children(s, depth)
        deeper = depth + 1 < len(t.levels)
        fb, ob, _ = _children(t, depth) if deeper else (np.arange(len(lt.centre) + 1), np.arange(len(lt.centre)), None)
        ns, nt = s.levels[depth + 1], t.levels[depth + 1] if deeper else lt
        next_a, next_b = [], []
        for i, j, pair in _product(fa, oa, a, fb, ob, b):
            keep = _gap(s.points, ns.centre[i], t.points, nt.centre[j]) <= reach + slack + ns.radius[i] + nt.radius[j]
            if same:
                keep &= (a[pair] != b[pair]) | (i <= j)
            next_a.append(i[keep])
            next_b.append(j[keep])
        a, b = np.concatenate(next_a or [np.empty(0, int)]), np.concatenate(next_b or [np.empty(0, int)])
