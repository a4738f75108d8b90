"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of two blocks of words, each block shared with the next passage. Terms are the words of the
benchmark. Document frequencies and the TF-IDF matrix are over all passages of the corpus. Its singular vectors come from a
distributed randomised SVD: tasks send A'(A G) for a Gaussian G in slabs of terms, which are summed as a tree, and a Nystroem
step gives vectors and values.
Items are cut into parts no longer than a passage. The dot products of passages and parts, exact by an index of the parts, are
held against the squared length of the shorter one. From `cosine` on a pair is a candidate, so a verbatim copy, short or long,
is one whatever directions the corpus has. Between `floor` and `cosine` the latent space decides: a pair is a candidate if its
cosine in the space of the singular vectors, each divided by its value, reaches `latent`. Words that the corpus uses alike are
alike there, so a part and a passage are found that share words, but few of the rare ones.
Of candidates, the longest common subsequence of the whole item with the words around the passage decides: nearly the whole
item is a copy; most of it, with its answer (its last quarter) near complete, is a paraphrase.

Null and empty texts are clean. Items without id, text or words match nothing, items that repeat count once, items of equal
text under several ids are all named. An empty benchmark or corpus gives clean rows. Every row gives one row, rows that repeat
an id too, and null ids stay null. Terms in more than MOST of the passages have no weight, but for parts that would keep
under KEPT of their words.
A benchmark is searched in groups of items of at most GROUP_TERMS distinct words and GROUP_WORDS words, one pass each, so that
what is broadcast (weights of the parts' words, and rank numbers for each term) and what the driver holds have a bound.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import written
from .common import slab_sum, tree_sum
from .licenses import common_subsequence

TERM = re.compile(r"[^\W_]+")
#: Words of a block; chunks in a task's table.
STEP, TABLE_SIZE = 32, 400_000
#: Terms in more than this share of passages have no weight, but for parts that would keep under KEPT of their words (a text
#: that is repeated over and over), whose least weight is LEAST.
MOST, KEPT, LEAST = 0.1, 0.5, 0.1
#: Directions, and those that are drawn beside them; the bars.
RANK, BESIDE, LATENT, COSINE, FLOOR = 32, 8, 0.5, 0.5, 0.2
#: Share of an item's words in order that makes a copy, and a paraphrase if this share of its answer is there too.
COPY, PARAPHRASE, ANSWER = 0.85, 0.65, 0.75
#: Distinct words and words of the items of one pass; passages that are scored at once; places of a tile; terms of a slab.
GROUP_TERMS, GROUP_WORDS, AT_ONCE, TILE, SPARE, SLAB = 200_000, 2_000_000, 4096, 60_000, 0.5, 1024


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


class Terms(dict):
    """Chunk without blanks, in lower case -> the terms of its words (4 bytes each), `size` for words outside the benchmark.
    Words never cross blanks, so each distinct chunk is cut once. A chunk of letters and digits, or of these and one last sign, is one word."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.codes = {w: array("I", [i]).tobytes() for w, i in vocabulary.items()}
        self.outside = array("I", [len(vocabulary)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalnum():
            terms = self.codes.get(chunk, self.outside)
        elif chunk[:-1].isalnum():
            terms = self.codes.get(chunk[:-1], self.outside)
        else:
            terms = b"".join([self.codes.get(w, self.outside) for w in TERM.findall(chunk)])
        if len(self) < TABLE_SIZE:
            self[chunk] = terms
        return terms


class Coder:
    """Terms of the words of many texts at once (4 bytes each). Texts are split at ASCII blanks, which no word crosses and around which
    letters are lowered alike; distinct chunks, without marks at their ends, are looked up. One of ASCII letters and digits is one
    word; what else a chunk may be is left to Terms."""

    def __init__(self, vocabulary: dict[str, int]):
        self.rest, self.size = Terms(vocabulary), len(vocabulary)
        self.words, self.numbers = pa.array(list(vocabulary), pa.string()), np.append(np.fromiter(vocabulary.values(), np.uint32, len(vocabulary)), np.uint32(self.size))

    def __call__(self, texts: pa.Array) -> pa.Array:
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        chunks = split.flatten().dictionary_encode()
        found = pc.ascii_trim(chunks.dictionary, characters=string.punctuation)
        terms = self.numbers[pc.fill_null(pc.index_in(found, value_set=self.words), self.size).to_numpy(zero_copy_only=False)]
        other = np.flatnonzero(~pc.ascii_is_alnum(found).to_numpy(zero_copy_only=False))
        codes = [self.rest[c.lower()] for c in found.take(pa.array(other)).to_numpy(zero_copy_only=False)]
        many = np.ones(len(terms), np.int64)
        many[other] = [len(c) // 4 for c in codes]
        begin = np.cumsum(many) - many
        flat = np.repeat(terms, many)
        inside = np.zeros(len(terms), bool)
        inside[other] = True
        flat[np.repeat(inside, many)] = np.frombuffer(b"".join(codes), np.uint32)
        at = chunks.indices.to_numpy()
        k = many[at]
        ends = np.concatenate([[0], np.cumsum(k)])
        out = flat[np.repeat(begin[at] - ends[:-1], k) + np.arange(ends[-1])]
        offsets = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets * 4), pa.py_buffer(out)])


class Benchmark:
    """The words of some items (as terms), their parts of at most two blocks and the vocabulary. `last`: no other items follow."""

    def __init__(self, items: list[tuple[int, list[str]]], last: bool = True):
        self.ids, self.last = [i for i, _ in items], last
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in items for w in t}))}
        self.size = len(self.vocabulary)
        self.words = [np.array([self.vocabulary[x] for x in w], np.uint32) for _, w in items]
        self.answers = [w[-max(1, len(w) // 4) :].tolist() for w in self.words]
        self.counts = [np.unique(w, return_counts=True) for w in self.words]
        self.spot = np.full(self.size + 1, -1, np.int32)  # where held() notes the places of an item's words, and takes them out again
        cut = [(i, np.array_split(w, -(-len(w) // (2 * STEP)))) for i, w in enumerate(self.words)]
        self.parts, self.owner = [p for _, ps in cut for p in ps], np.array([i for i, ps in cut for _ in ps], np.int64)


def groups(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in groups that have a bound; at least one item is in each."""
    held, distinct, size = [], set(), 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct().orderBy("item_id", "text")
    for i, text in rows.toLocalIterator():
        words = terms_of(text)
        if words and held and (size + len(words) > GROUP_WORDS or len(distinct) + sum(w not in distinct for w in set(words)) > GROUP_TERMS):
            yield Benchmark(held, last=False)
            held, distinct, size = [], set(), 0
        if words:
            held.append((i, words))
            distinct.update(words)
            size += len(words)
    if held:
        yield Benchmark(held)


def coded(rows: DataFrame, bench: Benchmark) -> DataFrame:
    """Write the rows, once for all passes, with the terms of their texts' words, and with the texts if other items follow."""
    fields = [f for f in rows.schema.fields if f.name != "text" or not bench.last]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder(bench.vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), code(part.column("text")).cast(pa.binary())], names=[*(f.name for f in fields), "term"])

    return written(rows.mapInArrow(run, StructType([*fields, *StructType.fromDDL("term binary").fields])), "coded")


def blocks_of(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many coded texts: block and term of each word, first block of each text (and one past the last). An empty block
    stands between texts, so that neighbouring blocks are of one text."""
    parts = terms.to_pylist()
    n = np.array([len(p) // 4 for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum((n + STEP - 1) // STEP + 1)])
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(starts[:-1], n) + within // STEP, np.frombuffer(b"".join(parts), "<u4").astype(np.int64), starts


def passages(block: np.ndarray, term: np.ndarray, n: int, vectors: np.ndarray) -> np.ndarray:
    """Sum of the terms' vectors over the two blocks of each of n passages: passage p is blocks p and p + 1."""
    out = np.zeros((n + 1, vectors.shape[1]), np.float32)
    if len(block):
        begins = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        out[block[begins]] = np.add.reduceat(vectors[term], begins, axis=0)
    return out[:-1] + out[1:]


def slices(batches: Iterator[pa.RecordBatch], used: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words whose term is used, by many texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            block, term, starts = blocks_of(batch.column("term").slice(at, 512))
            on = used[term]
            yield block[on], term[on], starts


def frequencies(texts: DataFrame, size: int) -> np.ndarray:
    """In how many passages each of `size` terms is, and the number of passages."""

    used = np.arange(size + 1) < size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1)
        for block, term, starts in slices(batches, used):
            total[size] += starts[-1]
            if not len(term):
                continue
            wide = int(starts[-1]) + 1
            key = term * wide + block
            key.sort()
            key = key[np.r_[True, key[1:] != key[:-1]]]
            at, block = key // wide, key % wide
            # Two for each block of a term, less one for each pair of neighbours and for a text's first block.
            total[:size] += 2 * np.bincount(at, minlength=size) - np.bincount(at[1:][key[1:] == key[:-1] + 1], minlength=size)
            first = np.zeros(wide, bool)
            first[starts[:-1]] = True
            total[:size] -= np.bincount(at[first[block]], minlength=size)
        yield pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId()], pa.int64()), "blob": [total.tobytes()]})

    got = tree_sum(texts.select("term").mapInArrow(run, "k long, blob binary"), size + 1)
    return np.ones(size + 1) if got is None or not got[-1] else got


def weights(bench: Benchmark, df: np.ndarray) -> np.ndarray:
    """IDF of each term."""
    n, frequent, needed = df[-1], df[:-1] > MOST * df[-1], np.zeros(len(df) - 1, bool)
    for t in bench.parts:
        if frequent[t].mean() > 1 - KEPT:
            needed[t] = True
    return np.where(frequent & ~needed, 0.0, np.maximum(np.log((n + 1) / (df[:-1] + 1)), LEAST))


def factor(z: np.ndarray, gauss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular vectors and values of a factor F of the matrix M ~ F F', of which z = M gauss (Nystroem)."""
    core = gauss.T @ z
    shift = 1e-9 * np.linalg.norm(z) + 1e-12
    core = (core + core.T) / 2 + shift * np.eye(z.shape[1])
    lam, u = np.linalg.eigh(core)
    root = u / np.sqrt(np.maximum(lam, 1e-9 * max(lam.max(), 1e-12)))
    left, values, _ = np.linalg.svd((z + shift * gauss) @ root, full_matrices=False)
    return left, values


def directions(texts: DataFrame, idf: np.ndarray, rank: int, seed: int = 5) -> np.ndarray:
    """For each term its weight times the corpus' singular vectors, each divided by its value: rows of a passage's words sum
    up to its place in the latent space."""
    size, width = len(idf), min(len(idf), rank + BESIDE)
    gauss = np.random.default_rng(seed).standard_normal((size, width))
    weighted, useful = (idf[:, None] * gauss).astype(np.float32), np.append(idf > 0, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width))
        for block, term, starts in slices(batches, useful):
            if not len(term):
                continue
            y = passages(block, term, int(starts[-1]), weighted)
            y[1:] += y[:-1].copy()  # a block counts in its own passage and in the one before
            order = np.argsort(term.astype(np.uint32), kind="stable")
            t, b = term[order], block[order]
            begins = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            total[t[begins]] += np.add.reduceat(y[b], begins, axis=0) * idf[t[begins], None]
        for at in range(0, size, SLAB):
            yield pa.RecordBatch.from_pydict({"slab": pa.array([at], pa.int64()), "k": pa.array([TaskContext.get().partitionId()], pa.int64()), "blob": [total[at : at + SLAB].tobytes()]})

    z = np.zeros((size, width))
    for at, blob in slab_sum(texts.select("term").mapInArrow(run, "slab long, k long, blob binary")):
        z[at : at + SLAB] = np.frombuffer(blob).reshape(-1, width)
    left, values = factor(z, gauss)
    keep = values[:rank] > 1e-4 * max(values.max(), 1e-12)
    return (idf[:, None] * (left[:, :rank][:, keep] / values[:rank][keep])).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-20)


class Postings:
    """Index of the parts whose lengths are within a factor of 1.4 (numbers `members`). Lengths near each other make bars near
    each other, which the words of a passage are held against."""

    def __init__(self, size: int, members: np.ndarray, lengths: np.ndarray, term: np.ndarray, part: np.ndarray, value: np.ndarray):
        self.members, self.lengths, self.least = members, lengths[members], lengths[members].min()
        key = term * len(members) + np.searchsorted(members, part)
        order = np.argsort(key)
        self.keys, self.values = key[order], value[order]
        self.parts, self.begins = self.keys % len(members), np.searchsorted(self.keys, np.arange(size + 2) * len(members))
        self.top = np.zeros(size + 1)
        np.maximum.at(self.top, term, value)


class Index:
    """Finds candidates of passages among the parts. Of each passage the words that are in
    the most parts are left out for as long as, all together, they can't reach the bar; only parts of its other words are met."""

    def __init__(self, bench: Benchmark, idf: np.ndarray, space: np.ndarray, latent: float, cosine: float, floor: float):
        self.latent, self.cosine, self.floor, self.space = latent, cosine, min(floor, cosine), space
        self.square = np.append(idf, 0.0) ** 2
        terms, parts, values, lengths, places = [], [], [], [], []
        for i, part in enumerate(bench.parts):
            t, k = np.unique(part, return_counts=True)
            length = np.sqrt(((k * idf[t]) ** 2).sum() + 1e-30)
            terms.append(t)
            parts.append(np.full(len(t), i))
            values.append(k * idf[t] ** 2 / length)
            lengths.append(length)
            places.append(k @ space[t])
        self.lengths, self.places = np.array(lengths), unit(np.array(places)).astype(np.float32)
        term, part, value = np.concatenate(terms), np.concatenate(parts), np.concatenate(values)
        scale = np.floor(2 * np.log2(self.lengths))
        self.classes = []
        for c in np.unique(scale):
            mine = (scale == c)[part] & (value > 0)
            self.classes.append(Postings(len(idf), np.flatnonzero(scale == c), self.lengths, term[mine], part[mine], value[mine]))

    def search(self, of: Postings, p: np.ndarray, term: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of passage and part from the floor on, with their products: from the words `term` of passages p."""
        wide, bar = len(of.members), (self.floor - 1e-4) * np.minimum(size, of.least)
        many = of.begins[term + 1] - of.begins[term]
        order = np.flatnonzero(many)
        order = order[np.lexsort((-many[order], p[order]))]
        p, term, many = p[order], term[order], many[order]
        most, first = np.cumsum(of.top[term]), np.searchsorted(p, p)
        most -= (most - of.top[term])[first]
        rest = most < SPARE * bar[p]
        rest_p, rest_term = p[rest], term[rest]
        beyond = np.bincount(rest_p, of.top[rest_term], len(size))
        p, term, many = p[~rest], term[~rest], many[~rest]
        rows = max(1, TILE // wide)
        for a in np.unique(p // rows) * rows:
            lo, hi = np.searchsorted(p, [a, a + rows])
            t, k = term[lo:hi], many[lo:hi]
            at = np.repeat(of.begins[t] - np.cumsum(k) + k, k) + np.arange(k.sum())
            got = np.bincount(np.repeat((p[lo:hi] - a) * wide, k) + of.parts[at], of.values[at])
            least = np.maximum(bar - beyond, 1e-30)[a : a + rows]
            key = np.flatnonzero(got >= np.repeat(least, wide)[: len(got)])
            q, i, got = a + key // wide, key % wide, got[key]
            needed = (self.floor - 1e-4) * np.minimum(size[q], of.lengths[i])
            some = got + beyond[q] >= needed
            q, i, got, needed = q[some], i[some], got[some], needed[some]
            begin = np.searchsorted(rest_p, q)
            k = np.searchsorted(rest_p, q, "right") - begin
            at = np.repeat(begin - np.cumsum(k) + k, k) + np.arange(k.sum())
            key = rest_term[at] * wide + np.repeat(i, k)
            at = np.minimum(np.searchsorted(of.keys, key), len(of.keys) - 1)
            got += np.bincount(np.repeat(np.arange(len(q)), k), np.where(of.keys[at] == key, of.values[at], 0.0), len(q))
            some = got >= needed
            yield q[some], of.members[i[some]], got[some]

    def candidates(self, block: np.ndarray, term: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of n passages, each one with candidates, these, and which of them the latent space has decided."""
        on = self.square[term] > 0
        block, term = block[on], term[on]
        for a in range(0, n, AT_ONCE):
            rows = min(AT_ONCE, n - a)
            lo, hi = np.searchsorted(block, [a, a + rows + 1])
            t, b = term[lo:hi], block[lo:hi] - a
            own, before = b < rows, b > 0  # a word is in the passage of its block and in the one before
            p, w = np.r_[b[own], b[before] - 1], np.r_[t[own], t[before]]
            size = np.sqrt(np.bincount(p, self.square[w], rows))
            found = [f for c in self.classes for f in self.search(c, p, w, size)]
            if not found:
                continue
            p, i, got = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((i, p))
            p, i, got = p[order], i[order], got[order]
            sure = got >= (self.cosine - 1e-4) * np.minimum(size[p], self.lengths[i])
            near = ~sure
            if near.any() and self.space.shape[1]:
                some = np.zeros(rows + 1, bool)
                some[p[near]] = some[p[near] + 1] = True
                here = some[b]
                place = unit(passages(b[here], t[here], rows, self.space))
                near[near] = np.einsum("ij,ij->i", place[p[near]], self.places[i[near]]) >= self.latent
            else:
                near[:] = False
            keep = sure | near
            p, i, near = p[keep], i[keep], near[keep]
            if len(p):
                cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                yield from zip((a + p[cuts]).tolist(), np.split(i, cuts[1:]), np.split(near, cuts[1:]), strict=True)


def held(bench: Benchmark, found: np.ndarray, near: dict[int, list[int]]) -> dict[int, float]:
    """Items that the words (as terms) around their passages hold, with the share of their words in order. Words of no item have no
    part in it, and order is looked for only where enough of an item's words are, each as often as the item has it at most."""
    out: dict[int, float] = {}
    for i, at in near.items():
        item, answer, (own, many) = bench.words[i], bench.answers[i], bench.counts[i]
        p = np.array(at) * STEP
        begin = max(0, int(p[0]) - len(item))
        bench.spot[own] = np.arange(len(own))
        spots = bench.spot[found[begin : int(p[-1]) + 2 * STEP + len(item)]]
        bench.spot[own] = -1
        where = np.flatnonzero(spots >= 0)
        spots = spots[where]
        where += begin
        for a, b in np.searchsorted(where, [p - len(item), p + 2 * STEP + len(item)]).T.tolist():
            if out.get(i) == 1.0:
                break
            if b - a < PARAPHRASE * len(item) - 1 or np.minimum(np.bincount(spots[a:b], minlength=len(own)), many).sum() < PARAPHRASE * len(item) - 1e-6:
                continue
            region = found[where[a:b]].tolist()
            share = common_subsequence(item.tolist(), region) / len(item)
            if share >= COPY or share >= PARAPHRASE and common_subsequence(answer, region) >= ANSWER * len(answer):
                out[i] = max(out.get(i, 0.0), share)
    return out


def judged(rows: DataFrame, benchmark: DataFrame, rank: int, latent: float, cosine: float, floor: float) -> DataFrame:
    """The rows (with a column text) and: items (ids, ascending), best_overlap, n_candidates, n_latent."""
    fields = StructType.fromDDL("items array<long>, best_overlap double, n_candidates long, n_latent long")
    rows = rows.select("*", F.expr("cast(array() as array<long>)").alias("items"), F.lit(0.0).alias("best_overlap"), F.lit(0).cast("long").alias("n_candidates"), F.lit(0).cast("long").alias("n_latent"))
    for bench in groups(benchmark):
        rows = coded(rows, bench)
        idf = weights(bench, frequencies(rows, bench.size))
        index = Index(bench, idf, directions(rows, idf, rank), latent, cosine, floor)

        def run(batches: Iterator[pa.RecordBatch], bench=bench, index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 256):
                    batch = whole.slice(lo, 256)
                    block, term, starts = blocks_of(batch.column("term"))
                    hits: dict[int, dict[int, list[int]]] = {}
                    more = np.zeros((2, batch.num_rows), np.int64)
                    for p, parts, only in index.candidates(block, term, int(starts[-1])):
                        d = int(np.searchsorted(starts, p, "right")) - 1
                        more[:, d] += len(parts), only.sum()
                        for i in np.unique(bench.owner[parts]).tolist():
                            hits.setdefault(d, {}).setdefault(i, []).append(p - int(starts[d]))
                    got = {d: held(bench, np.frombuffer(batch.column("term")[d].as_py(), np.uint32).astype(np.int64), h) for d, h in hits.items()}
                    items, best = batch.column("items").to_pylist(), batch.column("best_overlap").to_pylist()
                    for d, g in got.items():
                        items[d] = sorted({*items[d], *(bench.ids[i] for i in g)})
                        best[d] = max([best[d], *g.values()])
                    new = [pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.float64()), *(pa.array(batch.column(c).to_numpy() + m) for c, m in zip(("n_candidates", "n_latent"), more, strict=True))]
                    names = [c for c in batch.schema.names if c != "term"]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[: -len(new)]), *new], names=names)

        rows = rows.mapInArrow(run, StructType([f for f in rows.schema.fields if f.name != "term"]))
    assert rows.schema.names[-len(fields) :] == fields.names
    return rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK, latent: float = LATENT, cosine: float = COSINE, floor: float = FLOOR) -> DataFrame:
    """One row per document: contaminated, n_items, items (ids, ascending), best_overlap (share of an item's words in order),
    n_candidates (pairs of passage and part that were compared), n_latent (those that the latent space has decided)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = judged(rows, benchmark, rank, latent, cosine, floor)
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items", "best_overlap", "n_candidates", "n_latent")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rank: int = RANK, latent: float = LATENT, cosine: float = COSINE, floor: float = FLOOR) -> DataFrame:
    """The rows of docs, with all columns, that aren't contaminated, each judged by itself, whatever its id."""
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], F.col(text_col).cast("string").alias("text"))
    kept = judged(own, benchmark, rank, latent, cosine, floor).where(F.size("items") == 0)
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
