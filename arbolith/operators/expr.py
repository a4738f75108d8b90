"""Expressions: JSON to flat arrays and back, and the rewrites, all by loops over flat arrays so that depth has no limit.

An Expr is three lists in pre-order: kind, payload, children (indices). Children stand after their parent, so that
walking indices backwards is bottom-up.
"""

from __future__ import annotations

import json
import sys
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa

#: Constructor: JSON key, fields of its children in order.
SHAPE = {
    "BVar": ("bvar", ()), "FVar": ("fvar", ()), "MVar": ("mvar", ()), "Sort": ("sort", ()), "Const": ("const", ()), "App": ("app", ("fn", "arg")), "Lam": ("lam", ("binderType", "body")),
    "ForallE": ("forallE", ("binderType", "body")), "LetE": ("letE", ("type", "value", "body")), "Lit": ("lit", ()), "MData": ("mdata", ("expr",)), "Proj": ("proj", ("struct",)),
}
NAMING = frozenset(("Lam", "ForallE", "LetE"))
ATOMS = frozenset(("BVar", "FVar", "MVar", "Sort", "Const"))


@dataclass
class Expr:
    kind: list[str] = field(default_factory=list)
    data: list = field(default_factory=list)
    kids: list[list[int]] = field(default_factory=list)

    def add(self, kind: str, data) -> int:
        self.kind.append(kind)
        self.data.append(data)
        self.kids.append([])
        return len(self.kind) - 1


def _plain(x):
    return next(iter(x.values())) if isinstance(x, dict) and len(x) == 1 else x


def _index(v):
    if not isinstance(v, dict) or "deBruijnIndex" not in v:
        raise ValueError("bvar without deBruijnIndex")
    return v["deBruijnIndex"]


def _name(v):
    return str(_plain(v))


def _binder(v):
    return v["binderName"], v.get("binderInfo")


#: JSON key: constructor, how its own data are read (None: it has none), fields of its children from the last.
READ = {
    SHAPE[kind][0]: (kind, read, SHAPE[kind][1][::-1])
    for kind, read in {
        "BVar": _index, "FVar": _name, "MVar": _name, "Sort": _name, "Const": lambda v: (v["declName"], tuple(map(str, v.get("us", ())))), "App": None, "Lam": _binder, "ForallE": _binder,
        "LetE": lambda v: (v["declName"], v.get("nonDep")), "Lit": lambda v: str(v["literal"]), "MData": lambda v: json.dumps(v.get("data"), sort_keys=True), "Proj": lambda v: (v.get("typeName"), v.get("idx")),
    }.items()
}


def parse(text: str) -> Expr:
    """From JSON; the first key of each object names the constructor."""
    if sys.getrecursionlimit() < 20_000:
        sys.setrecursionlimit(20_000)  # for json, whose scanner recurses
    out, work = Expr(), [(json.loads(text), -1)]
    kinds, data, kids = out.kind, out.data, out.kids
    while work:
        obj, parent = work.pop()
        key = next(iter(obj), None) if isinstance(obj, dict) else None
        if key not in READ:
            raise ValueError(f"unknown expression {key!r}")
        (kind, read, fields), v, me = READ[key], obj[key], len(kinds)
        data.append(read(v) if read else None)
        kinds.append(kind)
        kids.append([])
        if parent >= 0:
            kids[parent].append(me)
        for f in fields:
            work.append((v[f], me))
    return out


def dump(e: Expr) -> str:
    made: list = [None] * len(e.kind)
    for i in reversed(range(len(e.kind))):
        kind, d = e.kind[i], e.data[i]
        key, fields = SHAPE[kind]
        v = dict(zip(fields, (made[k] for k in e.kids[i]), strict=True))
        if kind == "BVar":
            v = {"deBruijnIndex": d}
        elif kind in ("FVar", "MVar", "Sort"):
            v = d
        elif kind == "Const":
            v = {"declName": d[0], "us": list(d[1])}
        elif kind in ("Lam", "ForallE"):
            v |= {"binderName": d[0], "binderInfo": d[1]}
        elif kind == "LetE":
            v |= {"declName": d[0], "nonDep": d[1]}
        elif kind == "Lit":
            v = {"literal": d}
        elif kind == "MData":
            v["data"] = json.loads(d)
        elif kind == "Proj":
            v |= {"typeName": d[0], "idx": d[1]}
        made[i] = {key: v}
    return json.dumps(made[0], ensure_ascii=False)


def _ordered(kind: list, data: list, kids: list, root: int) -> Expr:
    """Nodes reachable from root, renumbered in pre-order."""
    out, work = Expr(), [(root, -1)]
    while work:
        i, parent = work.pop()
        me = out.add(kind[i], data[i])
        if parent >= 0:
            out.kids[parent].append(me)
        work += [(k, me) for k in reversed(kids[i])]
    return out


def bind_names(e: Expr) -> Expr:
    """Bound indices become binder names. A let's value is read under the let's own binder. Unknown indices raise IndexError,
    indices that are names already TypeError. An expression without bound variables is returned as it is."""
    if "BVar" not in e.kind:
        return e
    scope: list = [None] * len(e.kind)
    data = list(e.data)
    for i, kind in enumerate(e.kind):
        if kind == "BVar":
            if not isinstance(data[i], int):
                raise TypeError("bound variable is named already")
            env = scope[i]
            for _ in range(data[i]):
                env = env[1] if env else None
            if env is None:
                raise IndexError("bound variable without binder")
            data[i] = env[0]
        inner = (data[i][0], scope[i]) if kind in ("Lam", "ForallE", "LetE") else scope[i]
        for n, k in enumerate(e.kids[i]):
            scope[k] = scope[i] if n == 0 else inner
    return Expr(list(e.kind), data, [list(k) for k in e.kids])


def structure(e: Expr) -> list[int]:
    """A number for each node, equal for equal subtrees; binder info and dependency flags don't count."""
    ids: dict = {}
    out = [0] * len(e.kind)
    number = ids.setdefault
    i = len(out)
    for kind, d, ks in zip(reversed(e.kind), reversed(e.data), reversed(e.kids), strict=True):
        i -= 1
        if kind in NAMING:
            d = d[0]
        if not ks:
            key = (kind, d)
        elif len(ks) == 2:
            key = (kind, d, out[ks[0]], out[ks[1]])
        else:
            key = (kind, d, *[out[k] for k in ks])
        out[i] = number(key, len(ids))
    return out


def share(e: Expr) -> Expr:
    """Each repeated subtree that isn't a constant becomes a fresh variable, numbered by first visit; nothing is bound to it."""
    key = structure(e)
    if len(set(key)) == len(key):
        return e
    times = Counter(key)
    fresh: dict[int, str] = {}
    out, work = Expr(), [(0, None)]
    kinds, data, kids = out.kind, out.data, out.kids
    while work:
        i, siblings = work.pop()
        if siblings is not None:
            siblings.append(len(kinds))
        kind, own = e.kind[i], []
        if times[key[i]] > 1 and kind != "Const":
            kinds.append("FVar")
            data.append(fresh.setdefault(key[i], f"v{len(fresh)}"))
        else:
            kinds.append(kind)
            data.append(e.data[i])
            work += [(k, own) for k in reversed(e.kids[i])]
        kids.append(own)
    return out


def drop_binders(e: Expr) -> Expr:
    """The normal form without universal quantifiers over atoms: such a node and its type go, and its body takes its place. Nodes stand
    in pre-order, so what goes is the stretch from the node to its body."""
    kind = e.kind
    if "ForallE" not in kind:
        return e
    now: dict[int, int] = {}
    for i in reversed([i for i, k in enumerate(kind) if k == "ForallE"]):
        of, body = e.kids[i]
        if kind[now.get(of, of)] in ATOMS:
            now[i] = now.get(body, body)
    if not now:
        return e
    kept, after = [], 0
    for i in sorted(now):
        if i >= after:
            kept += range(after, i)
            after = i
        after = max(after, e.kids[i][1])
    kept += range(after, len(kind))
    place = dict(zip(kept, range(len(kept)), strict=True))
    return Expr([kind[i] for i in kept], [e.data[i] for i in kept], [[place[now.get(k, k)] for k in e.kids[i]] for i in kept])


#: Parts of names that mark noise.
NOISE = ("inst", ".to", ".of", "HAdd.")


def fold_noise(e: Expr) -> Expr:
    """An application of two constants becomes the one that is noise, the function first."""
    noisy = lambda i: any(x in e.data[i][0] for x in NOISE)
    now = list(range(len(e.kind)))
    kids = [list(k) for k in e.kids]
    for i in reversed(range(len(e.kind))):
        kids[i] = [now[k] for k in e.kids[i]]
        if e.kind[i] == "App" and all(e.kind[k] == "Const" for k in kids[i]):
            now[i] = next((k for k in kids[i] if noisy(k)), i)
    return _ordered(e.kind, e.data, kids, now[0])


def normalize(e: Expr) -> Expr:
    """Names, then shared subtrees; to be applied once."""
    return share(bind_names(e))


#: Kinds whose label is just the kind.
BARE = frozenset(SHAPE) - ATOMS - {"Lit"}


def label(kind: str, d) -> str:
    if kind == "Const":
        return f"Const({d[0]}, {list(d[1])})"
    return f"{kind}({d})" if kind in ("BVar", "FVar", "MVar", "Sort", "Lit") else kind


def labels(e: Expr, seen: dict | None = None) -> list[str]:
    """The label of each node; half of a surrogate pair fails here. `seen` keeps labels for other trees of a batch."""
    seen, out = {} if seen is None else seen, []
    for k, d in zip(e.kind, e.data, strict=True):
        if k in BARE:
            out.append(k)
            continue
        text = seen.get((k, d))
        if text is None:
            text = seen[k, d] = label(k, d)
        out.append(text)
    "".join(out).encode()
    return out


def places(e: Expr) -> tuple[list[int], list[int]]:
    """Depth and parent of each node; parents stand before their children."""
    depth, parent = [0] * len(e.kind), [-1] * len(e.kind)
    for i, ks in enumerate(e.kids):
        if ks:
            d = depth[i] + 1
            for k in ks:
                depth[k], parent[k] = d, i
    return depth, parent


def pack(e: Expr) -> list[dict]:
    depth, parent = places(e)
    return [{"kind": k, "label": label(k, d), "depth": depth[i], "parent": parent[i], "children": list(e.kids[i])} for i, (k, d) in enumerate(zip(e.kind, e.data, strict=True))]


class Packed:
    """Many trees as flat columns, which become an Arrow array of what pack() gives for each."""

    def __init__(self, bare: bool = False):
        self.bare, self.seen = bare, {}  # bare: nodes of nothing but labels
        self.kind, self.label, self.depth, self.parent, self.children, self.arity, self.size = [], [], [], [], [], [], []

    def add(self, e: Expr) -> None:
        self.label += labels(e, self.seen)  # what can't be encoded fails here, and only this tree
        if self.bare:
            self.size.append(len(e.kind))
            return
        depth, parent = places(e)
        self.kind += e.kind
        self.depth += depth
        self.parent += parent
        self.children += chain.from_iterable(e.kids)
        self.arity += map(len, e.kids)
        self.size.append(len(e.kind))

    def skip(self) -> None:
        """A null tree."""
        self.size.append(None)

    def array(self) -> pa.Array:
        """Nodes as structs; bare ones have only a label."""
        ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
        ints = lambda x: pa.array(x, pa.int32())
        if self.bare:
            nodes = {"label": pa.array(self.label, pa.string())}
        else:
            nodes = {"kind": pa.array(self.kind, pa.string()), "label": pa.array(self.label, pa.string()), "depth": ints(self.depth), "parent": ints(self.parent), "children": pa.ListArray.from_arrays(ends(self.arity), ints(self.children))}
        null = pa.array([n is None for n in self.size], pa.bool_())
        return pa.ListArray.from_arrays(ends(n or 0 for n in self.size), pa.StructArray.from_arrays(list(nodes.values()), list(nodes)), mask=null)


def pretty(labels: list[str], kids: list[list[int]]) -> str:
    out, work = [], [(0, 0)]
    while work:
        i, d = work.pop()
        out.append("  " * d + labels[i])
        work += [(k, d + 1) for k in reversed(kids[i])]
    return "\n".join(out)
