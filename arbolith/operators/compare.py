"""Comparison of two labelled ordered trees: collapse match and edit distance.

A tree is (labels, children) in pre-order. Edit distance is Zhang and Shasha's, a row of the forest table at a time.
"""

from __future__ import annotations

import numpy as np

#: Labels that cost little to insert or delete and nothing to change.
CHEAP = ("BVar(", "FVar(", "MVar(", "Sort(", "Const(")


def collapse_score(t1, t2) -> float:
    """Share of t2's nodes that match when its leaves may stand for any subtree of t1. Not symmetric."""
    (a, ka), (b, kb) = t1, t2
    score, work = 0, [(0, 0)]
    while work:
        i, j = work.pop()
        if len(kb[j]) and (a[i] != b[j] or len(ka[i]) != len(kb[j])):
            continue
        score += 1
        work += zip(ka[i], kb[j], strict=False)
    return score / len(b)


def collapse_match(t1, t2) -> bool:
    (a, ka), (b, kb) = t1, t2
    work = [(0, 0)]
    while work:
        i, j = work.pop()
        if len(kb[j]):
            if a[i] != b[j] or len(ka[i]) != len(kb[j]):
                return False
            work += zip(ka[i], kb[j], strict=True)
    return True


class Ordered:
    """A tree in post-order: labels, leftmost leaves, key roots, and a number for each subtree's structure."""

    def __init__(self, tree, ids: dict):
        labels, kids = tree
        n = len(labels)
        size, same = [1] * n, [0] * n
        for i in reversed(range(n)):
            size[i] += sum(size[k] for k in kids[i])
            same[i] = ids.setdefault((labels[i], tuple(same[k] for k in kids[i])), len(ids))
        depth = [0] * n
        for i in range(n):
            for k in kids[i]:
                depth[k] = depth[i] + 1
        post = [i + size[i] - 1 - depth[i] for i in range(n)]
        self.n, order = n, np.argsort(post)
        self.left = np.array([p - size[i] + 1 for i, p in enumerate(post)])[order]
        self.same = np.array(same)[order]
        self.cheap = np.array([x.startswith(CHEAP) for x in labels])[order]
        self.roots = sorted({int(x): i for i, x in enumerate(self.left)}.values())


def edit_distance(t1, t2, unit: bool = False) -> float:
    """Cheap leaves cost 0.2 to insert or delete, others 1; a change costs 0.4, nothing between equal subtrees or if
    either side is cheap. With unit all costs are 1."""
    ids: dict = {}
    a, b = Ordered(t1, ids), Ordered(t2, ids)
    gone, new = (np.where(x.cheap & (not unit), 0.2, 1.0) for x in (a, b))
    change = np.where(a.same[:, None] == b.same[None], 0.0, 1.0 if unit else 0.4)
    if not unit:
        change[a.cheap], change[:, b.cheap] = 0.0, 0.0
    tree = np.zeros((a.n, b.n))
    for i in a.roots:
        for j in b.roots:
            l1, l2 = int(a.left[i]), int(b.left[j])
            ys = np.arange(l2, j + 1)
            steps = np.concatenate([[0.0], np.cumsum(new[ys])])
            forest = np.zeros((i - l1 + 2, j - l2 + 2))
            forest[0] = steps
            spine, before = b.left[ys] == l2, b.left[ys] - l2
            for x in range(l1, i + 1):
                r, above = x - l1 + 1, forest[x - l1]
                inner = forest[a.left[x] - l1][before] + tree[x, ys]
                if a.left[x] == l1:
                    inner = np.where(spine, above[:-1] + change[x, ys], inner)
                best = np.concatenate([[above[0] + gone[x]], np.minimum(above[1:] + gone[x], inner)])
                forest[r] = np.minimum.accumulate(best - steps) + steps
                if a.left[x] == l1:
                    tree[x, ys[spine]] = forest[r][1:][spine]
    return float(tree[-1, -1])


def least_distance(t1, t2) -> float:
    """A lower bound of edit_distance() from counts alone. Of the larger tree as many nodes go as it has more, cheap ones first. Its other
    costly nodes are changed, unless they meet one of the other tree's cheap nodes or an equal subtree; so are the other tree's,
    or they are new, which costs more."""
    ids: dict = {}

    def counts(tree):
        labels, kids = tree
        same, costly, cheap = [0] * len(labels), {}, 0
        for i in reversed(range(len(labels))):
            same[i] = ids.setdefault((labels[i], tuple(same[k] for k in kids[i])), len(ids))
            if labels[i].startswith(CHEAP):
                cheap += 1
            else:
                costly[same[i]] = costly.get(same[i], 0) + 1
        return costly, cheap

    (a, a_cheap), (b, b_cheap) = sorted(map(counts, (t1, t2)), key=lambda c: -(sum(c[0].values()) + c[1]))
    a_costly, b_costly = sum(a.values()), sum(b.values())
    equal = sum(min(n, b.get(k, 0)) for k, n in a.items())
    more = a_costly + a_cheap - b_costly - b_cheap
    gone = max(0, more - a_cheap)
    return gone + 0.2 * (more - gone) + 0.4 * max(0, a_costly - gone - b_cheap - equal, b_costly - a_cheap - equal)


def limited_distance(t1, t2, most: float = 1.5) -> float:
    """Unit-cost distance, infinite beyond a ratio of sizes."""
    n, m = len(t1[0]), len(t2[0])
    return float("inf") if max(n, m) / min(n, m) > most else edit_distance(t1, t2, unit=True)
