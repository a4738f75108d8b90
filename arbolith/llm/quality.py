"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown from labelled rows on the driver, flattened into numpy node arrays, and score whole Arrow batches.
On chosen features the score may only fall as the feature rises. Null and empty texts have no words and fail the base
rule. Labels that are null don't count, labels of one id count as their mean, at a tie as the lower class; without rows of both
classes the base rule alone decides. Every row gives one row, rows that repeat an id and rows with a null id too; rows that
repeat a labelled id are all learned from. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "line_words", "distinct", "wide")
#: The score may not rise with these.
FALLING = ("symbols", "dup_lines", "repeats")

SPACE, UPPER, DIGIT, SYMBOL, MARK, WIDE, TAIL = 1, 2, 3, 4, 5, 6, 7
KIND = np.zeros(256, np.uint8)
KIND[[*b" \t\n\v\f\r"]] = SPACE
KIND[ord("A") : ord("Z") + 1] = UPPER
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[[*b"!\"'()+,-./:;=?@[\\]^_`{}~"]] = MARK
KIND[[*b"#*$%&|<>"]] = SYMBOL  # fixed value of the contract
KIND[0x80:0xC0], KIND[0xC0:] = TAIL, WIDE


def repeated_words(found: list[bytes]) -> tuple[int, int]:
    """Words covered by 3-word windows that occur twice or more, and distinct words."""
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in found], np.int64)
    v = len(ids)
    if len(a) < 4 or v == len(a):
        return 0, v
    _, at, n = np.unique((a[:-2] * v + a[1:-1]) * v + a[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1
    covered = np.zeros(len(a), bool)
    for k in range(3):
        covered[k : len(a) - 2 + k] |= again
    return int(covered.sum()), v


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of BASE and the values of FEATURES."""
    text = text or ""
    found = words(text)
    kinds = np.bincount(KIND[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=8)
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            dups += line in seen
            seen.add(line)
    n, chars = len(found), len(text) - int(kinds[SPACE])
    repeats, distinct = repeated_words(found)
    base = [n, chars, int(kinds[SYMBOL]), dups, repeats]
    of = lambda x, y: float(x) / max(1.0, float(y))
    return base, [float(np.log1p(n)), of(chars, n), of(kinds[SYMBOL], chars), of(dups, lines), of(repeats, n), of(kinds[UPPER], chars), of(kinds[DIGIT], chars), of(kinds[MARK], chars), of(n, lines), of(distinct, n), of(kinds[WIDE], chars)]


class BoostedTrees:
    """Binary logistic boosting on binned features; all trees share flat arrays of nodes, a leaf leads to itself."""

    def __init__(self, rounds: int = 60, depth: int = 3, bins: int = 48, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0, falling: tuple[int, ...] = ()):
        self.rounds, self.depth, self.bins, self.rate, self.ridge, self.least, self.falling = rounds, depth, bins, rate, ridge, least, frozenset(falling)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.bias = float(np.log(mean / (1 - mean)))
        self.feature, self.cut, self.left, self.right, self.value, self.roots = [], [], [], [], [], []
        margin = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            self.roots.append(len(self.value))
            margin += self._grow(binned, edges, p - y, p * (1 - p) + 1e-9, np.arange(len(y)), self.depth, -np.inf, np.inf, np.zeros(len(y)))
        for k in ("feature", "cut", "left", "right", "value", "roots"):
            setattr(self, k, np.array(getattr(self, k)))
        return self

    def _grow(self, binned, edges, g, h, rows, depth, low, high, out):
        """Append the subtree over these rows, whose leaves stay between low and high; fills and returns out."""
        me, total_g, total_h = len(self.value), g[rows].sum(), h[rows].sum()
        mine = float(np.clip(-total_g / (total_h + self.ridge), low, high))
        for k, v in (("feature", 0), ("cut", 0.0), ("left", me), ("right", me), ("value", self.rate * mine)):
            getattr(self, k).append(v)
        best = (1e-6, -1, -1, 0.0, 0.0)
        for f, e in enumerate(edges if depth and len(rows) > 1 else []):
            b, n = binned[rows, f], len(e) + 1
            gl, hl = (np.bincount(b, w, n).cumsum()[:-1] for w in (g[rows], h[rows]))
            gr, hr = total_g - gl, total_h - hl
            vl, vr = (np.clip(-a / (c + self.ridge), low, high) for a, c in ((gl, hl), (gr, hr)))
            gain = -(gl * vl + 0.5 * (hl + self.ridge) * vl**2) - (gr * vr + 0.5 * (hr + self.ridge) * vr**2) + (total_g * mine + 0.5 * (total_h + self.ridge) * mine**2)
            gain[(hl < self.least) | (hr < self.least)] = -1
            if f in self.falling:
                gain[vl < vr] = -1
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (float(gain[i]), f, i, float(vl[i]), float(vr[i]))
        if best[1] < 0:
            out[rows] = self.value[me]
            return out
        _, f, i, vl, vr = best
        self.feature[me], self.cut[me] = f, float(edges[f][i])
        go = binned[rows, f] <= i
        mid = (vl + vr) / 2
        bounds = ((mid, high), (low, mid)) if f in self.falling else ((low, high), (low, high))
        self.left[me] = len(self.value)
        self._grow(binned, edges, g, h, rows[go], depth - 1, *bounds[0], out)
        self.right[me] = len(self.value)
        self._grow(binned, edges, g, h, rows[~go], depth - 1, *bounds[1], out)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        each = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[each, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            margin += self.value[node]
        return 1 / (1 + np.exp(-margin))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, seed: int = 42) -> BoostedTrees | None:
    """Fit on about max_labelled labelled documents, chosen by a hash of their id. None if they aren't of two classes.

    Only the sample's statistics come to the driver: max_labelled rows of 12 numbers. The sample's ids are broadcast.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna()
    rows = rows.groupBy("doc_id").agg((F.avg("y") > 0.5).cast("double").alias("y"))
    share = max_labelled / max(1, rows.count())
    sample = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    @F.pandas_udf("array<double>")
    def features(text: pd.Series) -> pd.Series:
        return pd.Series([statistics(t)[1] for t in text])

    got = texts.select("doc_id", "y", features("text").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    y = (got["y"].to_numpy(float) > 0.5).astype(float)
    if len(y) == 0 or y.min() == y.max():
        return None
    return BoostedTrees(falling=tuple(FEATURES.index(f) for f in FALLING)).fit(np.array(got["x"].tolist()), y)


def quality_column(model: BoostedTrees | None, least: float = 0.5):
    """A UDF: text -> struct of the base counts, base_failed, score and kept."""

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
    def judge(text: pd.Series) -> pd.DataFrame:
        got = [statistics(t) for t in text]
        base = np.array([b for b, _ in got], np.int64).reshape(-1, len(BASE))
        x = np.array([f for _, f in got], float).reshape(-1, len(FEATURES))
        out = pd.DataFrame(base, columns=list(BASE))
        out["base_failed"] = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
        out["score"] = model.probability(x) if model else np.where(out["base_failed"], 0.0, 1.0)
        out["kept"] = ~out["base_failed"] & (out["score"] >= least)
        return out

    return judge.asNondeterministic()  # one evaluation, whatever reads its fields


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, the trees' score, kept."""
    judge = quality_column(train(docs, labels, id_col, text_col, **how))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), judge(F.col(text_col).cast("string")).alias("q")).select("doc_id", "q.*")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns."""
    judge = quality_column(train(docs, labels, id_col, text_col, **how))
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(*own, judge(F.col(text_col).cast("string")).alias("q")).where("q.kept")
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
