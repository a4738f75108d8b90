"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors.

1. Entries of the voters' lexicons are words of a fixed list, and words and word beginnings that mark toxic rows of a bounded
   labelled sample. A text's count of an entry is weighed against the rate of clean rows, so that long texts aren't suspect.
2. Voters say toxic, clean, or nothing: groups of entries, disguised spellings, shouting, exclamations, the lack of any entry.
3. The label model sees the votes on all texts but no label: covariances of independent voters have the form d_j d_k, from which
   follow each voter's rates on toxic and clean texts. Pairs that break the form are correlated, and their joint evidence shrinks.
4. The posteriors of the sample's texts, in which a label is one more voter whose rates are estimated, train a logistic regression
   on the weighed counts. Its score is the result.

Labels count only where the hash of the id isn't divisible by `held_out`. Labels that are null don't count, labels of one id count
as their mean, at a tie as clean; without rows of both classes the fixed list alone decides. Scores follow from texts alone. Null and
empty texts have a score too. Every row gives one row, rows that repeat an id and rows with a null id too; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, written
from .common import id_text, map_rows, tree_sum

#: Common insults of some languages, whole words.
INSULTS = frozenset("""
    clown crap creep cretin disgusting dumb dumbass filth fool garbage idiot idiots imbecile jerk loser losers lowlife moron morons pathetic scum shit stupid trash ugly worthless
    abschaum arschloch blödmann depp dreckskerl dumm dummkopf hurensohn idioten missgeburt schwachkopf trottel versager widerlich
    abruti connard crétin dégueulasse imbécile minable ordure pathétique salaud stupide
    asqueroso basura cabrón escoria estúpido gilipollas idiota imbécil inútil patético payaso perdedor
""".split())
WORD = re.compile(r"[^\W_]+")
LEET = [str.maketrans("013457$@", f"o{one}eastsa") for one in "il"]
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*-]){3,}[^\W\d_](?![^\W_])")
#: Beginnings of words that can be entries, in characters; an entry's least evidence, weight of toxic rows and lift; the most entries.
SHORTEST, LONGEST, EVIDENCE, SUPPORT, LIFT, ENTRIES = 3, 8, 24.0, 4.0, 4.0, 256
#: Groups of found entries, which vote each, of at least 4 entries for more than 3 groups; evidence against chance from which an entry counts as found; words a worker remembers.
GROUPS, FOUND, REMEMBERED = 12, 4.0, 500_000
PRIOR = 0.1


def beginnings(word: str) -> Iterator[str]:
    """A word's candidates: its beginnings, marked by *, and itself."""
    yield word
    for k in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield word[:k] + "*"


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def plain(word: str) -> list[str]:
    """A word as it reads once letters written as digits or signs are put right; nothing if it has none, or only such."""
    return [] if word.isalpha() or word.isdigit() else [word.translate(table) for table in LEET]


def disguised(text: str) -> bool:
    """Whether an insult is written with signs as letters, or letter by letter."""
    signs = re.findall(r"[\w$@]{4,}", text.lower()) if "$" in text or "@" in text else []
    apart = (re.sub(r"[ .*-]", "", m).lower() for m in SPACED.findall(text))
    return any(p in INSULTS for w in signs if "$" in w or "@" in w for p in plain(w)) or any(i in m for m in apart for i in INSULTS)


class Lexicon:
    """Entries with their rates on clean texts; counts and votes of a text."""

    def __init__(self, found: list[str], rates: np.ndarray | None = None):
        self.entries = [*sorted(INSULTS), *found]
        self.index = {e: i for i, e in enumerate(self.entries)}
        self.rates = np.full(len(self.entries), 1e-6) if rates is None else rates
        self.heads = {e.rstrip("*")[:SHORTEST] for e in self.entries}
        self.lengths = sorted({len(e) - 1 for e in self.entries if e[-1] == "*"})
        fixed, groups = len(INSULTS), int(np.clip(len(found) // 4, 3, GROUPS))
        self.group = np.array([i % 2 if i < fixed else 2 + (i - fixed) % groups for i in range(len(self.entries))])
        #: Two halves of the list, groups of found entries, disguises, shouting, exclamations; the last one votes clean.
        self.voters = 2 + groups + 4
        self.width = len(self.entries) + 6
        self.known: dict[str, tuple[tuple[int, ...], bool, bool] | None] = {}

    def _learn(self, word: str) -> tuple[tuple[int, ...], bool, bool] | None:
        """Of a word: the entries that it is or begins with, whether it is an insult in disguise, whether it is one letter. None if
        nothing of this."""
        get = self.index.get
        got = tuple(i for i in (get(word), *[get(word[:k] + "*") for k in self.lengths if k <= len(word)]) if i is not None)
        hidden = any(p in INSULTS for p in plain(word))
        return (got, hidden, len(word) == 1) if got or hidden or len(word) == 1 else None

    def counts(self, text: str) -> tuple[dict[int, int], int, bool]:
        """Counts of entries, number of words, and whether a disguised word is an insult of the list."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        words = Counter(tokens(text))
        heads = self.heads
        for w in words:
            if w not in known:
                known[w] = self._learn(w) if w[:SHORTEST] in heads or len(w) == 1 or not w.isalpha() else None
        hits: dict[int, int] = {}
        hidden, single = False, 0
        for (_, n), of in zip(words.items(), map(known.__getitem__, words), strict=True):
            if of:
                for i in of[0]:
                    hits[i] = hits.get(i, 0) + n
                hidden |= of[1]
                single += of[2] * n
        if single >= 4 or "$" in text or "@" in text:
            hidden |= disguised(text)
        return hits, words.total(), hidden

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Weighed counts (evidence against chance of each entry, their sum and largest, and signs of the whole text), and votes:
        1 if a voter speaks."""
        hits, n, hidden = self.counts(text)
        x, votes = np.zeros(self.width, np.float32), np.zeros(self.voters, np.int8)
        e = len(self.entries)
        if hits:
            at = np.fromiter(hits, int, len(hits))
            c = np.fromiter(hits.values(), float, len(hits))
            mean = self.rates[at] * max(n, 50)
            s = np.where(c > mean, c * np.log(c / mean) - (c - mean), 0.0)
            x[at] = np.minimum(s, 8.0) / 8.0
            x[e], x[e + 1] = min(s[s >= FOUND].sum(), 40.0) / 40.0, min(s.max(), 12.0) / 12.0
            votes[self.group[at[s >= FOUND]]] = 1
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)  # A-Z and a-z stand for all letters
        large = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
        upper, marks = large / max(1, large + int(np.count_nonzero((raw >= 97) & (raw <= 122)))), text.count("!")
        x[e + 2], x[e + 3], x[e + 4], x[e + 5] = hidden, upper, min(marks / max(n, 1), 1.0), 1.0
        v = self.voters
        votes[v - 4], votes[v - 3], votes[v - 2] = hidden, n >= 5 and upper > 0.5, marks > 3 and marks > n / 20
        votes[v - 1] = not votes[: v - 4].any() and not hidden
        return x, votes


class LabelModel:
    """Rates of each voter on toxic and clean texts, from how often each speaks and each two do; no label is needed."""

    def __init__(self, single: np.ndarray, pairs: np.ndarray, n: float, prior: float, cut: float = 0.25, rounds: int = 200):
        m, n = len(single), max(n, 1.0)
        p = single / n
        c = pairs / n - np.outer(p, p)
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        r = c / np.outer(spread, spread)
        speaks = (single >= 5) & (single <= n - 5)
        independent = np.outer(speaks, speaks) & ~np.eye(m, dtype=bool)
        self.correlated = np.zeros((m, m))
        side = np.ones(m)
        side[-1] = -1  # the voter for clean
        d = 0.3 * side
        for attempt in range(4):
            for _ in range(rounds):
                over = independent @ (d**2)
                new = np.where(over > 1e-9, (np.where(independent, r, 0.0) @ d) / np.maximum(over, 1e-9), 0.0)
                d = 0.5 * d + 0.5 * np.clip(new, -1, 1)
            d = d * (np.sign((d * side).sum()) or 1.0)
            rest = np.where(independent, r - np.outer(d, d), 0.0)
            broken = np.abs(rest) > cut
            if attempt == 3 or not broken.any():
                break
            for j, k in zip(*np.nonzero(np.triu(broken)), strict=True):
                if independent[j].sum() > 3 and independent[k].sum() > 3:  # three partners at least, for a rate to follow
                    independent[j, k] = independent[k, j] = False
                    self.correlated[j, k] = self.correlated[k, j] = abs(rest[j, k])
        self.prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
        gap = np.where(speaks, d * spread, 0.0) / np.sqrt(self.prior * (1 - self.prior))  # rate on toxic less rate on clean texts
        self.toxic = np.clip(p + gap * (1 - self.prior), 1e-4, 1 - 1e-4)
        self.clean = np.clip(p - gap * self.prior, 1e-4, 1 - 1e-4)
        self.weight = np.where(speaks, np.log(self.toxic / self.clean), 0.0)
        self.weight[~speaks & (single > 0)] = 2.0 * side[~speaks & (single > 0)]  # too rare to tell: what its kind says

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxic given the votes of each row; what correlated voters say together counts less."""
        v = votes.astype(float)
        return np.log(self.prior / (1 - self.prior)) + (v * self.weight / (1 + v @ self.correlated)).sum(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def with_labels(log_odds: np.ndarray, labels: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Posteriors once each row's label is a voter too, whose rates are those of its agreement with the posteriors."""
    post = _sigmoid(log_odds)
    for _ in range(rounds):
        high = (post @ labels + 1) / (post.sum() + 2)
        low = ((1 - post) @ labels + 1) / ((1 - post).sum() + 2)
        post = _sigmoid(log_odds + np.where(labels > 0.5, np.log(high / low), np.log((1 - high) / (1 - low))))
    return post


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method; the last feature is constant and not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + shrink * w
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(shrink), grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """A lexicon and the weights of its features."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None):
        if weights is None:  # no labels of both classes: the fixed list's evidence decides
            weights = np.zeros(lexicon.width)
            weights[len(lexicon.entries)], weights[len(lexicon.entries) + 1], weights[-1] = 6.0, 6.0, -3.0
        self.lexicon, self.weights = lexicon, weights

    def score(self, texts: Iterable[str]) -> np.ndarray:
        x = np.stack([self.lexicon.features(t)[0] for t in texts]).astype(float)
        return _sigmoid(x @ self.weights)


def _held_out(id_col: str, part: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % part == 0, F.lit(False))


def _keys(text: str, n: int = 4) -> list[int]:
    """Least hashes of five-word windows under n seeds: near copies share most."""
    from xxhash import xxh3_64_intdigest

    w = tokens(text)
    h = np.array([xxh3_64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))], np.uint64)
    return [int((h * np.uint64(2 * k + 1) ^ (h >> np.uint64(7 * k + 1))).min() >> np.uint64(1)) for k in range(n)]


def copy_weights(sample: DataFrame) -> tuple[dict[int, float], float, float]:
    """Of each labelled row one over its number of copies and near copies in the sample, and the sums of both classes."""

    def start():
        def step(batch):
            keys = [_keys(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "y": batch.column("y")} | {f"k{i}": [k[i] for k in keys] for i in range(4)}

        return step

    rows = map_rows(sample.select("doc_id", "y", "text"), "doc_id long, y double, k0 long, k1 long, k2 long, k3 long", start).toPandas()
    size = np.max([rows.groupby(f"k{i}")[f"k{i}"].transform("size").to_numpy(float) for i in range(4)], axis=0) if len(rows) else np.zeros(0)
    weight = 1 / np.maximum(size, 1)
    y = rows["y"].to_numpy(float)
    return dict(zip(rows["doc_id"].tolist(), weight.tolist(), strict=True)), float(weight[y > 0.5].sum()), float(weight[y <= 0.5].sum())


def _evidence(a: np.ndarray, b: np.ndarray, toxic: float, clean: float) -> np.ndarray:
    """G² of a table: weights of toxic and clean rows with an entry, of all toxic and clean rows."""
    n, total = a + b, toxic + clean
    out = np.zeros(len(a))
    for seen, row, col in ((a, n, toxic), (b, n, clean), (toxic - a, total - n, toxic), (clean - b, total - n, clean)):
        seen = np.maximum(seen, 0)
        out += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-300) * total / np.maximum(row * col, 1e-300)), 0.0)
    return np.where(a * clean > b * toxic, out, 0.0)


def find_entries(sample: DataFrame, weights: dict[int, float], toxic: float, clean: float) -> list[str]:
    """Words and word beginnings that mark toxic rows of the sample, the strongest first: those that stand there once, twice or
    three times in LIFT times as large a share of toxic as of clean rows, by evidence. Of those that begin alike the strongest
    stays, of equals the longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[float]] = {}
        for b in batches:
            for d, y, t in zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
                w, counts = weights.get(d, 1.0), Counter()
                for word, n in Counter(tokens(t)).items():
                    for c in beginnings(word):
                        counts[c] += n
                for c, n in counts.items():
                    own = sums.setdefault(c, [0.0] * 6)
                    for k in range(min(n, 3)):
                        own[2 * k + (y <= 0.5)] += w
        if sums:
            table = np.array(list(sums.values()))
            yield pa.RecordBatch.from_pydict({"entry": pa.array(list(sums), pa.string()), **{f"s{k}": table[:, k] for k in range(6)}})

    counts = sample.mapInArrow(run, "entry string, " + ", ".join(f"s{k} double" for k in range(6))).groupBy("entry").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)])
    lift = F.greatest(*[F.when((F.col(f"s{k}") >= SUPPORT) & (F.col(f"s{k}") * clean >= LIFT * toxic * F.col(f"s{k + 1}")), (F.col(f"s{k}") * clean - F.col(f"s{k + 1}") * toxic) / F.sqrt(F.col(f"s{k}") + F.col(f"s{k + 1}"))).otherwise(0.0) for k in (0, 2, 4)])
    rows = counts.withColumn("lift", lift).where("lift > 0").orderBy(F.desc("lift"), "entry").limit(40 * ENTRIES).toPandas()
    each = []
    for k in (0, 2, 4):
        a, b = rows[f"s{k}"].to_numpy(float), rows[f"s{k + 1}"].to_numpy(float)
        each.append(np.where((a >= SUPPORT) & (a * clean >= LIFT * toxic * b), _evidence(a, b, toxic, clean), 0.0))
    rows["g"] = np.round(np.max(each, axis=0), 6)
    out: list[str] = []
    for e in sorted(rows[rows["g"] >= EVIDENCE].itertuples(), key=lambda r: (-r.g, -len(r.entry), r.entry)):
        bare = e.entry.rstrip("*")
        if not any(bare.startswith(o.rstrip("*")) or o.startswith(bare) for o in out) and e.entry not in INSULTS:
            out.append(e.entry)
    return out[:ENTRIES]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 5, max_labelled: int = 20_000, seed: int = 42) -> Model:
    """Fit on about max_labelled labelled rows, chosen by a hash of their id, and on the votes on all texts.

    The sample is written once; to the driver come its ids, at most 40 x ENTRIES candidates, its features and the sums of votes.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna().where(~_held_out("doc_id", held_out))
    rows = rows.groupBy("doc_id").agg((F.avg("y") > 0.5).cast("double").alias("y"))
    share = max_labelled / max(1, rows.count())
    chosen = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = id_text(docs, id_col, text_col)
    sample = written(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text"), "labelled")
    weights, toxic, clean = copy_weights(sample)
    if not toxic or not clean:
        return Model(Lexicon([]), None)
    found = find_entries(sample, weights, toxic, clean)

    def counted():
        lexicon = Lexicon(found)

        def step(batch):
            got = [lexicon.counts(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "n": [n for _, n, _ in got], "entries": [[*h] for h, _, _ in got], "counts": [[*h.values()] for h, _, _ in got]}

        return step

    bare = Lexicon(found)
    got = map_rows(sample.select("doc_id", "y", "text").where("y < 0.5"), "doc_id long, y double, n long, entries array<int>, counts array<int>", counted).toPandas()
    seen, total = np.zeros(len(bare.entries)), 1.0
    for d, n, e, c in zip(got["doc_id"], got["n"], got["entries"], got["counts"], strict=True):
        total += n * weights.get(d, 1.0)
        seen[np.asarray(e, int)] += weights.get(d, 1.0) * np.minimum(np.asarray(c, float), 3)
    lexicon = Lexicon(found, (seen + 0.5) / total)
    m = lexicon.voters

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        single, pairs, n = np.zeros(m), np.zeros((m, m)), 0
        for b in batches:
            for t in b.column(0):
                v = lexicon.features(t.as_py())[1].astype(float)
                at = np.flatnonzero(v)
                single[at] += 1
                pairs[np.ix_(at, at)] += 1
                n += 1
        yield pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId()], pa.int64()), "blob": [np.concatenate([single, pairs.ravel(), [n]]).tobytes()]})

    sums = tree_sum(texts.select("text").mapInArrow(votes, "k long, blob binary"), m + m * m + 1)
    label_model = LabelModel(sums[:m], sums[m:-1].reshape(m, m), sums[-1], toxic / (toxic + clean))

    def featured():
        def step(batch):
            got = [lexicon.features(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": [x.tobytes() for x, _ in got], "v": [v.tobytes() for _, v in got]}

        return step

    got = map_rows(sample, "doc_id long, y double, x binary, v binary", featured).toPandas().sort_values(["doc_id", "x"], kind="stable")
    forget(sample)
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(float)
    y, v = got["y"].to_numpy(float), np.stack([np.frombuffer(b, np.int8) for b in got["v"]])
    own = np.array([weights.get(d, 1.0) for d in got["doc_id"]])
    return Model(lexicon, logistic(x, with_labels(label_model.log_odds(v), y), own))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 5, **how) -> DataFrame:
    """One row per document: doc_id, held_out (its label, if any, wasn't looked at), score and predicted (1 from 0.5 on)."""
    model = train(docs, labels, id_col, text_col, held_out=held_out, **how)

    def start():
        return lambda batch: {"doc_id": batch.column(0), "score": model.score(batch.column(1).to_pylist())}

    rows = map_rows(id_text(docs, id_col, text_col), "doc_id long, score double", start)
    return rows.select("doc_id", _held_out("doc_id", held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
