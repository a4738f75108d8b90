"""Language-model scoring with a causal self-attention model over subword ids, written in numpy.

A text is a row of words (runs without blanks, in lower case) and one end. Each word has the ids that a public tokenizer gives it.
The model reads a word by the first and the last of its ids and predicts
    P(word | context) = P(class of its first id | context) * P(first id | class) * P(other ids | first id).
The first factor comes from one layer of causal self-attention. A text is cut in overlapping windows of WINDOW inputs,
whose last FRESH positions are scored, so that each token is scored once, with WINDOW - FRESH inputs of context or more.
Windows run in batches under a causal mask. The second factor is counted over all training words. The third one is the
share of the word among words of its first id, smoothed by a bigram of ids down to the word's end, so that unknown words
too have a probability. Over classes, first ids and words, probabilities sum to 1.

What is learned grows with the input: counts and classes come from all training texts (those whose crc32(id as text)
mod 10 isn't 0); weights from one window in `every` of each training text, and one at least, in ROUNDS rounds of local
steps of all shards and averaging, each round on other windows, so that each is learned from once, at any size of the input.
A window's shard, its round and its place in the shard are hashes of its text, its id and its number in the text. There is a
shard for about SHARD training tokens, so the model follows from the rows alone, however they are laid out in partitions.
Windows stream through a shard's task, which holds SHARE of them at once.

Texts are cut into words once: tasks write blocks of texts as numbers of the block's distinct words. Those words, and not
their occurrences, are counted, segmented and joined, so neither the count table nor a text's words have to fit in one place.

Null and empty texts are one end. A null id counts as empty text for the split. Every row gives one row; rows that repeat
an id are scored, and learned from, each by itself. Without training texts all counts are 0 and the weights stay as drawn.
Sums of exponentials are over values less than the largest one, so nothing is clipped.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, written
from .common import id_text, tree_sum
from .files import tokenizer
from .packing import WordTable, word_table

WINDOW, FRESH, WIDTH, HIDDEN, CLASSES, OWN, SINGLE, NEAR = 32, 16, 16, 32, 64, 960, 24, 128
#: One window in so many is for training; windows that are mixed before steps on them; rounds; rate of Adam; windows of a step.
EVERY, SHARE, ROUNDS, RATE, BATCH = 1, 8_192, 3, 6e-3, 64
#: Training tokens of a shard; partitions of shards at most (a task trains its shards one after the other).
SHARD, TASKS = 2_000_000, 10_000
#: Characters of text in a block; id pairs that are held at once (8 bytes and 8 for their counts); blocks' words that are put together.
BLOCK_BYTES, PAIRS, WORDS = 18_000_000, 4_000_000, 1_000_000


#: 1 where a fresh position of a full window may look.
CAUSAL = (np.arange(WINDOW)[None] <= (WINDOW - FRESH + np.arange(FRESH))[:, None]).astype(np.float32)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Net:
    """Weights by name, float32. Inputs are symbols of a word's first and last id, the last symbol stands for the start; targets
    are classes, -1 for none."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = w
        self.tables: dict[str, np.ndarray] | None = None

    @classmethod
    def new(cls, n_in: int, prior: np.ndarray, rng: np.random.Generator) -> Net:
        """Random weights, but for those of the output: the net begins with the classes' shares."""
        shapes = {"e": (n_in + 1, WIDTH), "l": (n_in + 1, WIDTH), "p": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "w1": (WIDTH, HIDDEN), "b1": (HIDDEN,)}
        w = {k: (rng.standard_normal(s) * (0.35 if k in "elp" else s[0] ** -0.5 if len(s) == 2 else 0)).astype(np.float32) for k, s in shapes.items()}
        return cls(w | {"u": np.zeros((HIDDEN, len(prior)), np.float32), "b": np.log(prior).astype(np.float32)})

    @staticmethod
    def mask(pad: np.ndarray) -> np.ndarray:
        """1 where a fresh position may look: not at later inputs, nor at padding before the text."""
        return CAUSAL[None] * (np.arange(WINDOW) >= pad[:, None])[:, None]

    def loss(self, x: np.ndarray, y: np.ndarray, pad: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the classes and its gradients. x holds first and last symbols: (windows, WINDOW, 2)."""
        w, scale, many = self.w, np.float32(WIDTH**-0.5), len(x)
        flat = lambda t: t.reshape(-1, t.shape[-1])
        ones = np.ones(max(many * FRESH, WINDOW, len(w["b"])), np.float32)  # sums of rows and columns are products with these
        every = ones[: many * FRESH]
        first, last = np.ascontiguousarray(x[:, :, 0]), np.ascontiguousarray(x[:, :, 1])
        e = np.take(w["e"], first, axis=0)
        e += np.take(w["l"], last, axis=0)
        e += w["p"]
        e2, eq = flat(e), flat(e[:, -FRESH:])
        wkv = np.concatenate([w["k"], w["v"]], axis=1)
        k, v = ((e2 @ w[c]).reshape(many, WINDOW, WIDTH) for c in "kv")  # large products of flat arrays; only the attention itself is one for each window
        q = (eq @ (w["q"] * scale)).reshape(many, FRESH, WIDTH)
        a = q @ k.transpose(0, 2, 1)
        if a.max() > 40 or a.min() < -40:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a *= CAUSAL
        if (some := np.flatnonzero(pad)).size:
            a[some] *= self.mask(pad[some])
        # What is masked stays 0: as small numbers, products of its gradients would be denormal, which take many times as long.
        a *= 1 / (flat(a) @ ones[:WINDOW] + np.float32(1e-30)).reshape(many, FRESH, 1)
        o = flat(a @ v)
        h0 = o @ w["o"]
        h0 += eq
        h = h0 @ w["w1"]
        h += w["b1"]
        np.maximum(h, 0, out=h)
        p = h @ w["u"]
        p += w["b"]
        if p.max() > 60 or p.min() < -60:
            p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        total = p @ ones[: p.shape[1]]
        y = y.ravel()
        n = np.flatnonzero(y >= 0)
        at = n * p.shape[1] + y[n]
        loss = float(-np.log(p.ravel()[at] / total[n] + 1e-30).mean()) if len(n) else 0.0
        share = np.float32(1 / max(1, len(n)))
        each = share / total
        if len(n) < len(y):
            each[y < 0] = 0
        p *= each[:, None]
        p.ravel()[at] -= share
        grad = {"u": h.T @ p, "b": every @ p}
        dz = p @ w["u"].T
        dz *= h > 0
        grad |= {"w1": h0.T @ dz, "b1": every @ dz}
        dh = dz @ w["w1"].T
        grad["o"] = o.T @ dh
        do = dh @ w["o"].T
        inner = np.einsum("ij,ij->i", do, o).reshape(many, FRESH, 1)  # over a row, weights times their gradients
        do = do.reshape(many, FRESH, WIDTH)
        ds = do @ v.transpose(0, 2, 1)
        ds -= inner
        ds *= a
        dq = flat(ds @ k)
        dq *= scale
        dkv = np.concatenate([flat(ds.transpose(0, 2, 1) @ q), flat(a.transpose(0, 2, 1) @ do)], axis=1)
        both = e2.T @ dkv
        grad |= {"q": eq.T @ dq, "k": both[:, :WIDTH], "v": both[:, WIDTH:]}
        de = (dkv @ wkv.T).reshape(many, WINDOW, WIDTH)
        dh += dq @ w["q"].T
        de[:, -FRESH:] += dh.reshape(many, FRESH, WIDTH)
        grad["p"] = (ones[:many] @ de.reshape(many, -1)).reshape(WINDOW, WIDTH)
        de = flat(de)
        for name, symbols in (("e", first), ("l", last)):
            grad[name] = rows_sum(symbols.ravel(), de, len(w[name]))
        return loss, grad

    def step(self, x: np.ndarray, y: np.ndarray, pad: np.ndarray, moments: dict) -> None:
        """One step of Adam; moments holds its state. Weights and moments are rows of one array, of which the weights are views."""
        _, grad = self.loss(x, y, pad)
        if not moments:
            names = sorted(self.w)
            flat = np.concatenate([self.w[k].ravel() for k in names])
            ends = np.cumsum([self.w[k].size for k in names]).tolist()
            self.w = {k: flat[hi - self.w[k].size : hi].reshape(self.w[k].shape) for k, hi in zip(names, ends, strict=True)}
            moments |= {"t": 0, "w": flat, "m": np.zeros_like(flat), "s": np.zeros_like(flat), "names": names}
        m, s = moments["m"], moments["s"]
        t = moments["t"] = moments["t"] + 1
        g = np.concatenate([grad[k].ravel() for k in moments["names"]])
        m *= np.float32(0.9)
        m += np.float32(0.1) * g
        g *= g
        g *= np.float32(0.01)
        s *= np.float32(0.99)
        s += g
        np.multiply(s, np.float32(1 / (1 - 0.99**t)), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-8)
        np.divide(m, g, out=g)
        g *= np.float32(RATE / (1 - 0.9**t))
        moments["w"] -= g

    def windows(self, x: np.ndarray, l: np.ndarray, y: np.ndarray, pad: np.ndarray) -> np.ndarray:
        """Log10 probability of each window's targets, summed; keys, values and queries are looked up, not multiplied."""
        w = self.w
        if self.tables is None:
            kv, qe = np.c_[w["k"], w["v"]], np.c_[w["q"] * WIDTH**-0.5, np.eye(WIDTH)].astype(np.float32)
            one = lambda t, c: np.c_[t @ kv, np.full(len(t), c, np.float32)]
            self.tables = {"mask": self.mask(np.zeros(1, int)), "ones": np.ones(w["b"].shape, np.float32), "ekv": one(w["e"], 1), "lkv": one(w["l"], 0), "pkv": one(w["p"], 0), "eq": w["e"] @ qe, "lq": w["l"] @ qe, "pq": w["p"][-FRESH:] @ qe}
        t = self.tables
        kv = np.take(t["ekv"], x, axis=0, mode="clip")
        kv += np.take(t["lkv"], l, axis=0, mode="clip")
        kv += t["pkv"]
        q = np.take(t["eq"], x[:, -FRESH:], axis=0, mode="clip")
        q += np.take(t["lq"], l[:, -FRESH:], axis=0, mode="clip")
        q += t["pq"]
        s = q[:, :, :WIDTH] @ kv[:, :, :WIDTH].transpose(0, 2, 1)
        if s.max() > 40:
            s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        s *= t["mask"]
        if (some := np.flatnonzero(pad)).size:
            s[some] *= self.mask(pad[some])
        o = s @ kv[:, :, WIDTH:]  # the last column, of ones, sums the weights
        h = (q[:, :, WIDTH:] + (o[:, :, :-1] / (o[:, :, -1:] + np.float32(1e-30))) @ w["o"]).reshape(-1, WIDTH) @ w["w1"]
        h += w["b1"]
        np.maximum(h, 0, out=h)
        g = h @ w["u"]
        g += w["b"]
        if g.max() > 60:
            g -= g.max(1, keepdims=True)
        at = g.ravel()[np.arange(0, g.size, g.shape[1]) + np.maximum(y, 0).ravel()]
        np.exp(g, out=g)
        return ((at - np.log(g @ t["ones"])) * (y.ravel() >= 0)).reshape(y.shape).sum(1, dtype=np.float64) / np.log(10)

    def scores(self, first: list[np.ndarray], last: list[np.ndarray], classes: list[np.ndarray], chunk: int = 128) -> np.ndarray:
        """Log10 probability of each text's classes."""
        return self.sums(*cut(first, last, classes, len(self.w["e"]) - 1), len(first), chunk)

    def sums(self, x: np.ndarray, l: np.ndarray, y: np.ndarray, begin: np.ndarray, pad: np.ndarray, owner: np.ndarray, many: int, chunk: int = 128) -> np.ndarray:
        """The same of texts that are cut."""
        got = [np.zeros(0)]
        for i in range(0, len(begin), chunk):
            got.append(self.windows(*window_rows(x, l, y, begin[i : i + chunk]), pad[i : i + chunk]))
        return np.bincount(owner, np.concatenate(got), many)

    def plain(self, first: np.ndarray, last: np.ndarray, at: int, target: int) -> float:
        """The same for one target, from the inputs it may see, which begin at position `at` of their window."""
        w = self.w
        e = w["e"][first] + w["l"][last] + w["p"][at : at + len(first)]
        s = np.exp(e @ w["k"] @ (e[-1] @ w["q"]) * WIDTH**-0.5)
        o = (s / s.sum()) @ (e @ w["v"])
        g = np.maximum((e[-1] + o @ w["o"]) @ w["w1"] + w["b1"], 0) @ w["u"] + w["b"]
        return float((g[target] - np.log(np.exp(g).sum())) / np.log(10))


def rows_sum(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of each index (below 2^16), as a table of n rows."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(at.astype(np.uint16), kind="stable")  # by digits, which is for 16 bits only
    at = at[order]
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    out[at[begin]] = np.add.reduceat(np.take(rows, order, axis=0), begin, axis=0)
    return out


def cut(first: list[np.ndarray], last: list[np.ndarray], classes: list[np.ndarray], start: int) -> tuple[np.ndarray, ...]:
    """Inputs (each before its target) and targets of texts in a row, and of each window its begin there, padding in front, text."""
    return laid(*(np.concatenate([np.zeros(0, np.int32), *c]) for c in (first, last, classes)), np.array([len(c) for c in classes], np.int64), start)


def laid(first: np.ndarray, last: np.ndarray, classes: np.ndarray, n: np.ndarray, start: int) -> tuple[np.ndarray, ...]:
    """The same for texts that follow each other, of n tokens each."""
    back = WINDOW - FRESH
    each = (n + FRESH - 1) // FRESH
    at = np.concatenate([[0], np.cumsum(back + each * FRESH)])
    x, l, y = (np.full(at[-1], v, np.int32) for v in (start, start, -1))
    place = np.arange(len(classes)) + np.repeat(at[:-1] + back - np.cumsum(n) + n, n)
    y[place] = classes
    inner = np.ones(len(classes), bool)
    inner[np.cumsum(n)[n > 0] - 1] = False  # a text's last token is no input
    place = place[inner] + 1
    x[place], l[place] = first[inner], last[inner]
    owner = np.repeat(np.arange(len(n)), each)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    return x, l, y, at[owner] + k * FRESH, np.maximum(back - k * FRESH, 0), owner


def window_rows(x: np.ndarray, l: np.ndarray, y: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and fresh targets of the windows with these begins."""
    views = np.lib.stride_tricks.sliding_window_view
    return views(x, WINDOW)[begin], views(l, WINDOW)[begin], views(y, FRESH)[begin + (WINDOW - FRESH)]


class Classes:
    """Class and input symbol of each id, and log10 P(id | class), from counts of first ids and of their neighbours."""

    def __init__(self, counts: np.ndarray, seen: np.ndarray):
        v = len(counts)
        order = by_count(counts)
        self.of = np.full(v, CLASSES - 1, np.int32)
        self.of[order[:SINGLE]] = np.arange(min(SINGLE, v))
        self._cluster(counts, seen, order)
        self.symbol = OWN + self.of
        self.symbol[order[:OWN]] = np.arange(min(OWN, v))
        total = np.bincount(self.of, counts + 0.5, CLASSES)
        self.prior = (total + 1e-3) / (total + 1e-3).sum()
        self.within = np.log10((counts + 0.5) / total[self.of])

    def _cluster(self, counts: np.ndarray, seen: np.ndarray, order: np.ndarray, rounds: int = 12) -> None:
        """Group ids seen often enough by the frequent ids before and after them (k-means, seeded by frequency)."""
        use = order[SINGLE:][seen[order[SINGLE:]].sum(1) >= 6]
        k = CLASSES - SINGLE - 1
        if len(use) <= k:
            self.of[use] = SINGLE + np.arange(len(use))
            return
        x = np.sqrt(seen[use])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centre, weight = x[:k].copy(), counts[use].astype(np.float32) + 1
        for _ in range(rounds):
            mine = (x @ centre.T).argmax(1)
            new = np.zeros_like(centre)
            np.add.at(new, mine, x * np.sqrt(weight)[:, None])
            some = np.bincount(mine, minlength=k) > 0
            centre[some] = new[some] / np.linalg.norm(new[some], axis=1, keepdims=True)
        self.of[use] = SINGLE + (x @ centre.T).argmax(1)


def by_count(counts: np.ndarray) -> np.ndarray:
    """Ids, the most frequent first."""
    return np.lexsort((np.arange(len(counts)), -counts))


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words of the base score each text has, and these: A-Z are lowered, and texts split at the six ASCII blanks."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    many, found = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
    empty = pc.equal(pc.binary_length(found), 0)  # before a blank at a text's begin, and after one at its end
    some = np.flatnonzero(empty.to_numpy(zero_copy_only=False))
    if len(some):
        many -= np.bincount(np.searchsorted(np.cumsum(many), some, "right"), minlength=len(many))
        found = found.filter(pc.invert(empty))
    return many, found


def parts_of(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie in a row in an array, each up to its end (in numbers of the array)."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def gather(docs: DataFrame) -> DataFrame:
    """The one pass over texts. kind 0: a text (k: its id, n: 1 if for training) as numbers of its block's words; 1: a block's
    distinct word (k: its number, by first occurrence, n: its count in training texts)."""
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])

    def rows(kind: int, block: int, k, n, blobs: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip((np.full(len(blobs), kind), np.full(len(blobs), block), k, n, blobs), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            coded = pa.chunked_array([words for *_, words in held if len(words)], pa.string()).dictionary_encode()
            keys = coded.chunk(0).dictionary.cast(pa.binary()) if len(coded) else pa.array([], pa.binary())  # one for all chunks
            counts, chunks = np.zeros(len(keys), np.int64), iter(coded.chunks)
            for ids, training, many, words in held:
                codes = next(chunks).indices.to_numpy().astype("<u4") if len(words) else np.zeros(0, "<u4")
                counts += np.bincount(codes[np.repeat(training, many)], minlength=len(keys))
                yield rows(0, block, ids, training.astype(np.int64), parts_of(codes, np.cumsum(many)))
            for at in range(0, len(keys), 50_000):
                yield rows(1, block, np.arange(at, min(at + 50_000, len(keys))), counts[at : at + 50_000], keys.slice(at, 50_000))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = batch.slice(at, 256).columns
                many, words = split(texts)
                size += pc.sum(pc.utf8_length(texts)).as_py()
                held.append((ids, np.array([not held_out(d) for d in ids.to_pylist()]), many, words))
                if size >= BLOCK_BYTES:
                    yield from close()
                    block, held, size = block + 1, [], 0
        if held:
            yield from close()

    return written(docs.mapInArrow(run, "kind int, block long, k long, n long, blob binary"), "gathered")


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches that are sorted by word, as tables that hold all rows of each of their words."""
    rest, word = [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        last = batch.column("word")[-1]
        if word is not None and last.equals(word):
            rest.append(table)
            continue
        cut = int(np.flatnonzero(pc.equal(batch.column("word"), last).to_numpy(zero_copy_only=False))[0])
        out = pa.concat_tables([*rest, table.slice(0, cut)])
        rest, word = [table.slice(cut)], last
        if out.num_rows:
            yield out
    if rest:
        yield pa.concat_tables(rest)


def coded(words: DataFrame, path: str, vocabulary: int) -> DataFrame:
    """Each distinct word: its count in all training texts, its first and last id and its ids, and the blocks that hold it (at) with
    its number there (i). It is counted and segmented once, in one shuffle. A word without ids has an id of its own."""
    fields = [("n", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("ids", pa.binary()), ("at", pa.binary()), ("i", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, none = word_table(path), np.array([vocabulary + 1], "<u4").tobytes()
        for rows in runs_of(b for b in batches if b.num_rows):
            word = rows["word"].combine_chunks()
            lead = np.r_[True, pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)]
            begin = np.flatnonzero(lead)
            found = word.take(pa.array(begin)).cast(pa.string()).to_numpy(zero_copy_only=False).tolist()
            ids = [c or none for at in range(0, len(found), 1024) for c in table.chunks(found[at : at + 1024])]
            first, last = (np.frombuffer(b"".join([c[s] for c in ids]), "<u4").astype(np.int32) for s in (slice(0, 4), slice(-4, None)))
            ends = np.append(begin[1:], len(word))
            columns = [pa.array(np.add.reduceat(rows["n"].to_numpy(), begin)), pa.array(first), pa.array(last), pa.array(ids, pa.binary()), parts_of(rows["at"].to_numpy(), ends), parts_of(rows["i"].to_numpy().astype("<u4"), ends)]
            yield from pa.table(columns, schema=pa.schema(fields)).to_batches(max_chunksize=50_000)

    dealt = words.repartition("word").sortWithinPartitions("word")
    return written(dealt.mapInArrow(run, "n long, first int, last int, ids binary, at binary, i binary"), "words")


def transitions(codes: list[bytes], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words: each id, what follows it (`vocabulary` for the word's end), and the word."""
    size = np.array([len(c) // 4 for c in codes], np.int64)
    ids = np.frombuffer(b"".join(codes), "<u4").astype(np.int64)
    after = np.r_[ids[1:], vocabulary] if len(ids) else ids
    after[np.cumsum(size) - 1] = vocabulary
    return ids, after, np.repeat(np.arange(len(codes)), size)


def id_pairs(vocab: DataFrame, vocabulary: int) -> DataFrame:
    """(a, b, n): in how many distinct words of training texts id b, or the end, follows id a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, _ = transitions(batch.column(0).to_pylist(), vocabulary)
            key, n = np.unique(a * (vocabulary + 2) + b, return_counts=True)
            yield pa.RecordBatch.from_pydict({"a": pa.array(key // (vocabulary + 2)), "b": pa.array(key % (vocabulary + 2)), "n": pa.array(n, pa.int64())})

    return written(vocab.where("n > 0").select("ids").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")


def dense(rows: DataFrame, key: str, size: int) -> list[np.ndarray]:
    """The other columns of at most `size` rows as arrays by key."""
    got = rows.toArrow()
    out = [np.zeros(size) for _ in rows.columns[1:]]
    for values, c in zip(out, rows.columns[1:], strict=True):
        values[got[key].to_numpy()] = got[c].to_numpy()
    return out


def with_spelling(vocab: DataFrame, vocabulary: int, then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """Add q: log10 P(ids after the first one, end | first id) by a bigram of ids over distinct words, smoothed by how many
    ids an id follows. The table of pairs is sent out in ranges of `a` of at most PAIRS pairs or one id, one after the other. `then` makes other batches, of that schema, of
    the last ones."""
    size = vocabulary + 2
    pairs = id_pairs(vocab, vocabulary)
    seen, kinds = dense(pairs.groupBy("a").agg(F.sum("n").alias("n"), F.count("*").alias("m")), "a", size)
    (low,) = dense(pairs.groupBy("b").agg(F.count("*").alias("m")), "b", size)
    low = (low + 0.05) / (low.sum() + 0.05 * (vocabulary + 1))  # over the ids and the end
    lows, total = [0], 0.0
    for a in np.flatnonzero(kinds).tolist():
        if total + kinds[a] > PAIRS and total:
            lows.append(a)
            total = 0.0
        total += kinds[a]
    out = vocab.withColumn("q", F.lit(0.0))
    for lo, hi in zip(lows, [*lows[1:], size], strict=True):
        got = pairs.where(F.col("a").between(lo, hi - 1)).toArrow()
        key = got["a"].to_numpy() * size + got["b"].to_numpy()
        order = np.argsort(key)
        key, n = np.append(key[order], -1), np.append(got["n"].to_numpy()[order], 0)  # the last one is for absent pairs

        def run(batches: Iterator[pa.RecordBatch], lo=lo, hi=hi, key=key, n=n) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, word = transitions(batch.column("ids").to_pylist(), vocabulary)
                mine = (a >= lo) & (a < hi) & (a <= vocabulary)
                a, b, word = a[mine], b[mine], word[mine]
                pair = a * size + b
                order = np.argsort(pair)  # pairs in order are found in places near each other
                a, b, word, pair = a[order], b[order], word[order], pair[order]
                at = np.minimum(np.searchsorted(key[:-1], pair), len(key) - 2) if len(key) > 1 else np.zeros(len(a), np.int64)
                times = np.where(key[at] == pair, n[at], 0)
                p = (times + (kinds[a] + 0.5) * low[b]) / (seen[a] + kinds[a] + 0.5)
                q = batch.column("q").to_numpy() + np.bincount(word, np.log10(p), batch.num_rows)
                yield batch.set_column(batch.schema.get_field_index("q"), "q", pa.array(q))

        if then and hi == size:
            return out.mapInArrow(lambda batches, run=run: then(run(batches)), schema)
        out = out.mapInArrow(run, out.schema)
    return out


def blobs(arrays: list[np.ndarray], kind: str) -> list[bytes]:
    return [x.astype(kind).tobytes() for x in arrays]


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is known of each block's words: a few rows for each block (at), with the words' numbers there and columns as arrays."""
    kinds, held, size = {"n": "<i8", "first": "<i4", "last": "<i4", "q": "<f8"}, [], 0

    def close() -> pa.RecordBatch:
        at, i, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(at, kind="stable")
        at = at[order]
        ends = np.append(np.flatnonzero(np.diff(at)) + 1, len(at))
        return pa.RecordBatch.from_arrays([pa.array(at[ends - 1]), *(parts_of(c[order], ends) for c in (i, *columns))], names=["at", "i", *kinds])

    for batch in batches:
        at, i = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("at", "<i8"), ("i", "<u4")))
        many = pc.binary_length(batch.column("i")).to_numpy() // 4
        held.append((at, i, *(np.repeat(batch.column(c).to_numpy(), many).astype(t, copy=False) for c, t in kinds.items())))
        size += len(at)
        if size >= WORDS:
            yield close()
            held, size = [], 0
    if size:
        yield close()


def counted(got: DataFrame, vocab: DataFrame, totals: dict, kind: str, vocabulary: int) -> DataFrame:
    """One row per text: what the counts say of it, and its tokens' first and last ids."""
    of, kinds, ends, train = totals["of"], totals["kinds"], totals["ends"], totals["train"]
    below = train + 0.1 * (totals["distinct"] + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        read = lambda c, t: np.frombuffer(b"".join(right[c].to_pylist()), t)
        k = read("i", "<u4").astype(np.int64)
        n, q, first, last = (np.zeros(len(k) + 1, t) for t in (np.int64, float, np.int64, np.int64))
        for a, c, t, end in ((n, "n", "<i8", ends), (q, "q", "<f8", 0.0), (first, "first", "<i4", vocabulary), (last, "last", "<i4", vocabulary)):
            a[k], a[-1] = read(c, t), end
        logs, known = np.log10((n + 0.1) / below), n > 0
        some = of[first] + kinds[first] > 0
        rest = np.where(some, np.log10((n + kinds[first] * 10.0**q + 1e-300) / np.where(some, of[first] + kinds[first], 1.0)), q)
        rest[-1] = 0.0  # the end is the only one with its id
        out: dict[str, list] = {c: [] for c in ("n_tokens", "n_known", "base_score", "rest", "first", "last")}
        for blob in left["blob"]:
            i = np.append(np.frombuffer(blob.as_py(), "<u4"), len(k)).astype(np.int64)
            for c, v in (("n_tokens", len(i)), ("n_known", int(known[i].sum())), ("base_score", logs[i].sum()), ("rest", rest[i].sum()), ("first", first[i].astype(kind).tobytes()), ("last", last[i].astype(kind).tobytes())):
                out[c].append(v)
        return pa.table({"doc_id": left["k"], "train": pa.array(left["n"].to_numpy() > 0), **{c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()), strict=True)}})

    words = with_spelling(vocab, vocabulary, by_block, "at long, i binary, n binary, first binary, last binary, q binary")
    texts = got.where("kind = 0").select("block", "k", "n", "blob")
    schema = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, rest double, first binary, last binary"
    return written(texts.groupBy("block").cogroup(words.groupBy("at")).applyInArrow(score, schema), "counted")


def neighbours(rows: DataFrame, counts: np.ndarray, kind: str) -> np.ndarray:
    """How often each first id has each frequent one (the last stands for all others) before it, and after it, in training texts."""
    near = np.full(len(counts), NEAR - 1)
    order = by_count(counts)[: NEAR - 1]
    near[order] = np.arange(len(order))
    size = len(counts) * 2 * NEAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, many = np.zeros(size, np.int32), [], 0
        for batch in batches:
            for blob in batch.column(0):
                x = np.frombuffer(blob.as_py(), kind).astype(np.int64)
                a, b = x[:-1], x[1:]
                held += [b * (2 * NEAR) + near[a], a * (2 * NEAR) + NEAR + near[b]]
                many += 2 * len(a)
                if many > 4_000_000:
                    total += np.bincount(np.concatenate(held), minlength=size).astype(np.int32)
                    held, many = [], 0
        total += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=size).astype(np.int32)
        key = np.flatnonzero(total)
        for at in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_pydict({"pair": pa.array(key[at : at + 100_000]), "n": pa.array(total[key[at : at + 100_000]].astype(np.int64))})

    got = rows.where("train").select("first").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(size, np.float32)
    seen[got["pair"].to_numpy()] = got["n"].to_numpy()
    return seen.reshape(-1, 2 * NEAR)


def sequences(batch: pa.RecordBatch, classes: Classes, kind: str) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The texts of a batch (columns first, last) cut in windows; their first ids in a row, and how many each has."""
    first, last = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c in ("first", "last"))
    n = pc.binary_length(batch.column("first")).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
    return laid(classes.symbol[first], classes.symbol[last], classes.of[first], n, OWN + CLASSES), first, n


def chosen(rows: DataFrame, classes: Classes, kind: str, every: int, rounds: int, r: int, shards: int) -> DataFrame:
    """Training windows of round r, and the shard and the place in it of each. What is chosen, its round, its shard and its place
    follow from a text's id and words alone; rows that repeat both share them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                (x, l, y, begin, pad, owner), *_ = sequences(part, classes, kind)
                if not len(begin):
                    continue
                first = np.searchsorted(owner, owner)
                place = np.arange(len(begin)) - first
                mark = np.array([zlib.crc32(f, zlib.crc32(str(d).encode())) for d, f in zip(part.column("doc_id").to_pylist(), part.column("first").to_pylist(), strict=True)], np.uint64)[owner]
                again = mixed(mark + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                picked = np.ones(len(begin), bool) if every == 1 else (place == 0) | ((place + mark.astype(np.int64)) % every == 0)
                mine = picked & (again % np.uint64(rounds) == r)
                again = again[mine]
                blob = np.concatenate([*window_rows(*(c.astype("<i2") for c in (x, l, y)), begin[mine]), pad[mine, None].astype("<i2")], 1)
                shard = (again // np.uint64(rounds) % np.uint64(shards)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard), "place": pa.array(again.view(np.int64)), "blob": binaries(blob)})

    return rows.where("train").select("doc_id", "first", "last").mapInArrow(run, "shard int, place long, blob binary")


def binaries(rows: np.ndarray) -> pa.Array:
    """The rows of a table as binary values."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def table_of(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as rows of a table, not copied."""
    begin, end = np.frombuffer(column.buffers()[1], np.int32)[[column.offset, column.offset + len(column)]].tolist()
    size = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], kind, (end - begin) // size, begin).reshape(len(column), -1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, of which like ones come out unlike (the finish of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fit(rows: DataFrame, counts: np.ndarray, kind: str, every: int = EVERY, rounds: int = ROUNDS, tokens: int = SHARD) -> tuple[Net, Classes]:
    """Classes from all neighbours; weights by rounds of training in all shards, each on other windows, and averaging as a tree."""
    classes = Classes(counts, neighbours(rows, counts, kind))
    net = Net.new(OWN + CLASSES, classes.prior, np.random.default_rng(1))
    names = sorted(net.w)
    width = sum(v.size for v in net.w.values()) + 1
    shards = max(1, round(counts.sum() / tokens))

    def unpack(flat: np.ndarray) -> Net:
        at, w = 0, {}
        for k in names:
            w[k] = flat[at : at + net.w[k].size].reshape(net.w[k].shape).astype(np.float32)
            at += w[k].size
        return Net(w)

    flat = np.concatenate([net.w[k].ravel() for k in names]).astype(float)
    for r in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], flat=flat, r=r) -> Iterator[pa.RecordBatch]:
            total, own, moments, rng, now, held, many = np.zeros(width), None, {}, None, None, [], 0

            def train() -> None:
                nonlocal held, many
                if not held:
                    return
                w = np.concatenate(held).astype(np.int64)
                x, y, pad, held, many = np.stack([w[:, :WINDOW], w[:, WINDOW : 2 * WINDOW]], 2), w[:, 2 * WINDOW : -1], w[:, -1], [], 0
                order = rng.permutation(len(x))
                for at in range(0, len(order), BATCH):
                    i = order[at : at + BATCH]
                    own.step(x[i], y[i], pad[i], moments)

            def close() -> None:
                nonlocal total, used
                train()
                if own is not None:
                    total += np.r_[np.concatenate([own.w[k].ravel() for k in names]) * used, used]
                used = 0

            used = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                of, w = batch.column("shard").to_numpy(), table_of(batch.column("blob"), "<i2")
                lo = 0
                for hi in [*(np.flatnonzero(np.diff(of)) + 1).tolist(), len(w)]:
                    if (shard := int(of[lo])) != now:
                        close()
                        own, moments, rng, now = unpack(flat), {}, np.random.default_rng([r, shard]), shard
                    while lo < hi:
                        n = min(hi - lo, SHARE - many)
                        held.append(w[lo : lo + n])
                        lo, many, used = lo + n, many + n, used + n
                        if many >= SHARE:
                            train()
            close()
            yield pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId()], pa.int64()), "blob": [total.astype(float).tobytes()]})

        windows = chosen(rows, classes, kind, every, rounds, r, shards).repartition(min(shards, TASKS), "shard").sortWithinPartitions("shard", "place", "blob")
        got = tree_sum(windows.mapInArrow(run, "k long, blob binary"), width)
        if got is not None and got[-1]:
            flat = got[:-1] / got[-1]
    return unpack(flat), classes


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, every: int = EVERY) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    path = path or tokenizer("word_bpe_49k.json")
    vocabulary = WordTable(path).vocabulary  # also the end's id; the next one stands for words without ids
    kind = "<u2" if vocabulary + 2 <= 1 << 16 else "<u4"
    got = gather(id_text(docs, id_col, text_col))
    vocab = coded(got.where("kind = 1").select(F.col("block").alias("at"), F.col("k").alias("i"), "n", F.col("blob").alias("word")), path, vocabulary)
    ends = got.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    of, kinds = dense(vocab.groupBy("first").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("kinds")), "first", vocabulary + 2)
    totals = {"of": of, "kinds": kinds, "ends": ends, "train": int(of.sum()) + ends, "distinct": int(kinds.sum()) + (ends > 0)}
    rows = counted(got, vocab, totals, kind, vocabulary)
    forget(got)
    forget(vocab)
    counts = of.copy()
    counts[vocabulary] = ends
    net, classes = fit(rows, counts, kind, every)
    train = totals["train"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [np.zeros(0)]
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                windows, first, n = sequences(part, classes, kind)
                marks.append(net.sums(*windows, len(n)) + np.bincount(np.repeat(np.arange(len(n)), n), classes.within[first], len(n)))
            total = np.concatenate(marks) + batch.column("rest").to_numpy()
            columns = {"doc_id": batch.column("doc_id"), "held_out": pc.invert(batch.column("train")), "n_tokens": batch.column("n_tokens"), "n_known": batch.column("n_known"), "train_tokens": pa.array([train] * batch.num_rows, pa.int64()), "base_score": batch.column("base_score"), "score": pa.array(total)}
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
