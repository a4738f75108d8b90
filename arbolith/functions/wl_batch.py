"""Weisfeiler-Leman histograms of whole Arrow batches of packed trees.

The same as the Column functions of `wl`, for the hot path: labels are numbers, a round finds the distinct pairs of own label
and sorted child labels of a batch, and only those are joined to strings and hashed. Higher-order functions walk each node of
each tree through the interpreter, which takes several times as long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds whose nodes are alike whatever they name.
NAMED = ("Const", "FVar", "BVar", "MVar", "Sort")
#: What encoded() gives.
ENCODED = "tree_depth int, enc map<string,int>, norm2 long"
#: Nodes of a tree.
NODES = pa.list_(pa.struct({"kind": pa.string(), "label": pa.string(), "depth": pa.int32(), "parent": pa.int32(), "children": pa.list_(pa.int32())}))


def alike(own: np.ndarray, below: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of each distinct row of (own, below...), where all values are under `many`."""
    if many ** (below.shape[1] + 1) < 1 << 62:
        key = own.astype(np.int64)
        for c in below.T:
            key = key * many + c
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
    else:
        _, first, number = np.unique(np.c_[own, below], axis=0, return_index=True, return_inverse=True)
    return first, number.ravel()


def rounds_of(names: list[str], codes: np.ndarray, children: np.ndarray, arity: np.ndarray, rounds: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """After each round, the distinct labels and each node's number among them. children: the nodes' children in a row."""
    parent = np.repeat(np.arange(len(codes)), arity)
    starts = np.cumsum(arity) - arity
    groups = [(a, np.flatnonzero(arity == a)) for a in np.unique(arity).tolist()]
    for _ in range(rounds):
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        below = codes[children]
        below = below[np.lexsort((rank[below], parent))]  # of each node, in the order of the labels
        numbers, new, made = {}, [], np.empty(len(codes), np.int64)
        for a, nodes in groups:
            rows = below[starts[nodes][:, None] + np.arange(a)] if a else np.zeros((len(nodes), 0), np.int64)
            first, number = alike(codes[nodes], rows, max(2, len(names)))
            of = []
            for own, kids in zip(codes[nodes[first]].tolist(), rows[first].tolist(), strict=True):
                text = f"{names[own]}({','.join([names[k] for k in kids])})" if kids else names[own]
                h = hashlib.md5(text.encode()).hexdigest()
                if h not in numbers:
                    numbers[h] = len(new)
                    new.append(h)
                of.append(numbers[h])
            made[nodes] = np.array(of, np.int64)[number]
        names, codes = new, made
        yield names, codes


#: Nodes that are taken at once from a batch, whose trees may be long.
AT_ONCE = 200_000


def slices(trees: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """Stretches of about `most` nodes (AT_ONCE if not given) of an array of trees, at least a tree each."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(trees), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin, done = 0, 0
    while begin < len(trees):
        end = max(begin + 1, int(np.searchsorted(ends, done + (most or AT_ONCE), "right")))
        yield trees.slice(begin, end - begin)
        begin, done = end, int(ends[end - 1])


class Flat:
    """Whole trees as flat columns: of each node its tree and the number of its label before any round; each tree's greatest depth.
    Built from each tree's size, and of each node the number of its kind or label among `texts`, depth, arity and children."""

    def __init__(self, size: np.ndarray, base: np.ndarray, texts: list[str], depth: np.ndarray, arity: np.ndarray, children: np.ndarray):
        self.given = size, base, texts, depth, arity, children
        self.many, self.tree = len(size), np.repeat(np.arange(len(size)), size)
        begins = np.cumsum(size) - size
        self.deepest = np.zeros(len(size), np.int64)
        if len(depth):
            self.deepest[size > 0] = np.maximum.reduceat(depth, begins[size > 0])
        wide = int(self.deepest.max(initial=0)) + 1
        found, self.codes = renumbered(base.astype(np.int64) * wide + depth, len(texts) * wide)
        self.names = [f"{texts[b]}_d{d}" for b, d in zip((found // wide).tolist(), (found % wide).tolist(), strict=True)]
        self.arity, self.children = arity, children + np.repeat(begins[self.tree], arity)

    @classmethod
    def of(cls, trees: pa.Array) -> Flat:
        size = pc.fill_null(pc.list_value_length(trees), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        node = pc.list_flatten(trees)
        kind, label, depth, kids = (pc.struct_field(node, f) for f in ("kind", "label", "depth", "children"))
        kind, label = pc.fill_null(kind, "").dictionary_encode(), label.dictionary_encode()
        texts = pa.concat_arrays([kind.dictionary, label.dictionary]).dictionary_encode()
        number, k, l = (x.indices.to_numpy(zero_copy_only=False) for x in (texts, kind, label))
        named = np.isin(np.array(kind.dictionary.to_pylist(), object), NAMED)
        base = np.where(named[k], number[k], number[len(kind.dictionary) + l])
        arity = pc.fill_null(pc.list_value_length(kids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ints = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(size, base, texts.dictionary.to_pylist(), ints(depth), arity, ints(pc.list_flatten(kids)))

    def beside(self, other: Flat) -> Flat:
        """These trees and then the other ones."""
        (size, base, texts, *rest), (size2, base2, texts2, *rest2) = self.given, other.given
        numbers = {x: i for i, x in enumerate(texts)}
        of = np.array([numbers.setdefault(x, len(numbers)) for x in texts2], np.int64)
        return Flat(np.r_[size, size2], np.r_[base, of[base2]], list(numbers), *map(np.concatenate, zip(rest, rest2, strict=True)))


def histograms(trees: pa.Array, rounds: int, raw: bool = False) -> pa.Array:
    """A map feature -> count for each tree (an array of nodes); null for a null tree. With raw, the labels before any round are round 0,
    and all rounds count, however deep a tree is."""
    f = Flat.of(trees)
    owner, feature, count, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    begin = f.names, f.codes
    steps = chain([begin] if raw else [], rounds_of(*begin, f.children, f.arity, rounds))
    for r, (names, codes) in enumerate(steps if len(f.tree) else ()):
        deep = f.deepest[f.tree] > (-1 if raw else r)
        key, n = np.unique(f.tree[deep] * len(names) + codes[deep], return_counts=True)
        owner.append(key // len(names))
        feature.append(key % len(names) + len(features))
        count.append(n)
        features += [f"{r}_{x}" for x in names]
    owner, feature, count = map(np.concatenate, (owner, feature, count))
    order = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[order], np.arange(f.many + 1))
    offsets = pa.array(ends, pa.int32(), mask=np.append(pc.is_null(trees).to_numpy(zero_copy_only=False), False)) if trees.null_count else pa.array(ends, pa.int32())
    return pa.MapArray.from_arrays(offsets, pa.array(features, pa.string()).take(pa.array(feature[order])), pa.array(count[order], pa.int32()))


def entries(trees: pa.Array, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Tree, number and count of each entry of the trees' histograms, and the features by number."""
    f = Flat.of(trees)
    owner, feature, count, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for r, (names, codes) in enumerate(rounds_of(f.names, f.codes, f.children, f.arity, rounds) if len(f.tree) else ()):
        deep = f.deepest[f.tree] > r
        key, n = np.unique(f.tree[deep] * len(names) + codes[deep], return_counts=True)
        owner.append(key // len(names))
        feature.append(key % len(names) + len(features))
        count.append(n)
        features += [f"{r}_{x}" for x in names]
    return *map(np.concatenate, (owner, feature, count)), features


def frequencies(trees: pa.Array, rounds: int) -> dict[str, pa.Array]:
    """Each feature of some trees, in how many of them it is, and how often in all."""
    _, feature, count, features = entries(trees, rounds)
    df, total = np.bincount(feature, minlength=len(features)), np.bincount(feature, count, len(features))
    found = np.flatnonzero(df)
    return {"feature": pa.array(features, pa.string()).take(pa.array(found)), "df": pa.array(df[found]), "total": pa.array(total[found].astype(np.int64))}


def renumbered(key: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, which are under `bound`, and each key's number among them, without a sort."""
    if bound > 8 * len(key) + 4096:
        coded = pa.array(key).dictionary_encode()
        return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
    seen = np.zeros(bound, bool)
    seen[key] = True
    found = np.flatnonzero(seen)
    number = np.empty(bound, np.int64)
    number[found] = np.arange(len(found))
    return found, number[key]


def numbers_of(codes: np.ndarray, many: int, children: np.ndarray, arity: np.ndarray, rounds: int) -> Iterator[tuple[int, np.ndarray]]:
    """rounds_of() without texts: after each round, how many labels there are and each node's number among them. Whether two labels are
    alike doesn't hang on the order in which children stand, if it is the same for all; here it is that of their numbers. The children's
    numbers are paired one after the other, and last with the node's own."""
    starts = np.cumsum(arity) - arity
    groups = [(a, np.flatnonzero(arity == a)) for a in np.unique(arity).tolist()]
    for _ in range(rounds):
        below = codes[children]
        made, new = np.empty(len(codes), np.int64), 0
        for a, nodes in groups:
            number, own, kinds = codes[nodes], None, many
            if a:
                at = starts[nodes]
                rows = [below[at + i] for i in range(a)]
                rows = [np.minimum(*rows), np.maximum(*rows)] if a == 2 else list(np.sort(np.stack(rows), 0))
                own, number = number, rows[0]
                for c in [*rows[1:], own]:
                    found, number = renumbered(number * many + c, kinds * many)
                    kinds = len(found)
            else:
                found, number = renumbered(number, many)
                kinds = len(found)
            made[nodes] = number + new
            new += kinds
        codes, many = made, new
        yield many, codes


def dots(trees: pa.Array, target: pa.Array, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each tree the dot product of its histogram with that of a target (an array of one tree), and its squared length, in numbers."""
    return flat_dots(Flat.of(trees), Flat.of(target), rounds)


def flat_dots(trees: Flat, target: Flat, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """dots() of flat trees."""
    f = trees.beside(target)
    dot, norm2 = np.zeros(f.many, np.int64), np.zeros(f.many, np.int64)
    for r, (many, codes) in enumerate(numbers_of(f.codes, len(f.names), f.children, f.arity, rounds)):
        tree = f.tree
        if f.deepest.min(initial=r + 1) <= r:
            deep = f.deepest[tree] > r
            tree, codes = tree[deep], codes[deep]
        own = np.bincount(codes[np.searchsorted(tree, f.many - 1) :], minlength=many)
        dot += np.bincount(tree, own[codes], f.many).astype(np.int64)
        key = tree * many + codes
        key.sort()
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        n = np.diff(np.r_[begins, len(key)])
        norm2 += np.bincount(key[begins] // many, n * n, f.many).astype(np.int64)
    return dot[:-1], norm2[:-1]


def encoded(trees: pa.Array, rounds: int) -> dict[str, pa.Array]:
    """The columns of wl.encode() of trees that are neither null nor empty."""
    enc = histograms(trees, rounds)
    depth = np.maximum.reduceat(pc.struct_field(trees.flatten(), "depth").to_numpy(zero_copy_only=False), trees.offsets.to_numpy()[:-1])
    sums = np.concatenate([[0], np.cumsum(enc.items.to_numpy(zero_copy_only=False).astype(np.int64) ** 2)])
    return {"tree_depth": pa.array(depth, pa.int32()), "enc": enc, "norm2": pa.array(np.diff(sums[enc.offsets.to_numpy()]), pa.int64())}
