"""Periodic runs of words by a harmonic grid of prefix hashes.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least max(6, 4q) words that no
neighbouring word extends. Words q apart are then equal at 3q places in a row, one of which is a multiple of 3q: so for each
period just the grid of these multiples is looked at, n/3q places, (n/3) ln(n/4) over all periods. For all pairs of a period
and a grid point of a batch of texts at once, numpy compares prefix hashes: first whether the half of a run on either side can
be there, then by binary search how far equality goes. What is found is verified word by word; a pair whose hashes lied is
settled by comparing its text's words. Of runs over the same words the one of least period counts, which is the smallest one.

Null and empty texts have no words and no runs. Every row gives one row, rows that repeat an id and rows with a null id too; an
empty table gives none. Other columns stay out. A text's work is its own, of any length: pairs are taken in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import id_text, map_rows, words

#: Least words of a run, and least periods in it. Fixed values of the contract.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Characters of texts and pairs of (period, grid point) that are held at once; a longer text is held alone.
CHARACTERS, PAIRS = 1_000_000, 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


class Prefixes:
    """Hashes of all stretches of a row of word numbers, modulo 2^64."""

    def __init__(self, ids: np.ndarray, seed: int = 7):
        n = len(ids)
        self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)]))
        values = np.random.default_rng(seed).integers(1, 1 << 63, int(ids.max(initial=0)) + 1, np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[ids] * self.powers[:n], out=self.sums[1:])

    def equal(self, at: np.ndarray, apart: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` words from `at` on look like those `apart` words later."""
        s = self.sums
        return (s[at + size] - s[at]) * self.powers[apart] == s[at + apart + size] - s[at + apart]


def _furthest(test: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """By binary search for all at once, the greatest size up to `most` that passes; 0 always does, and so does less."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        ok = test(mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    return low


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text, period, grid point): every multiple of 3q of each text, for each q up to a quarter of it."""
    most = np.where(sizes >= LEAST_WORDS, sizes // LEAST_PERIODS, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = -(-(sizes[text] - period) // (3 * period))
    ends = np.cumsum(points)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        c = points[at:to]
        q = np.repeat(period[at:to], c)
        yield np.repeat(text[at:to], c), q, 3 * q * (np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c))
        at = to


def _of_period(ids: np.ndarray, q: int) -> list[tuple[int, int]]:
    """(start, length) of the runs of period q of one text, word by word."""
    same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    return [(int(s), int(e - s + q)) for s, e in edge if e - s + q >= max(LEAST_WORDS, LEAST_PERIODS * q)]


def find_runs(ids: np.ndarray, starts: np.ndarray, seed: int = 7) -> list[list[tuple[int, int, int]]]:
    """Of each text (the word numbers from its start to the next one's) its runs (start, length, period), sorted by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in starts[1:]]
    hashes = Prefixes(ids, seed)
    found = []
    for text, q, point in _grid(np.diff(starts)):
        begin, end = starts[text], starts[text + 1]
        at = begin + point
        keep = ids[at] == ids[at + q]
        text, q, at, begin, end = text[keep], q[keep], at[keep], begin[keep], end[keep]
        half = (3 * q + 1) // 2  # of the 3q equal places, so many lie before the point, or from it on
        ahead, behind = end - at - q, at - begin
        keep = np.zeros(len(q), bool)
        for fits, back in ((half <= ahead, 0), (half <= behind, 1)):
            keep[fits] |= hashes.equal(at[fits] - back * half[fits], q[fits], half[fits])
        text, q, at, ahead, behind = text[keep], q[keep], at[keep], ahead[keep], behind[keep]
        after = _furthest(lambda k, at=at, q=q: hashes.equal(at, q, k), ahead)
        before = _furthest(lambda k, at=at, q=q: hashes.equal(at - k, q, k), behind)
        size = after + before + q
        keep = size >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        found.append(np.stack([text, at - before, size, q], 1)[keep])
    if not found or not sum(map(len, found)):
        return out
    settled: set[tuple[int, int]] = set()
    best: dict[tuple[int, int, int], int] = {}
    for text, at, size, q in np.unique(np.concatenate(found), axis=0).tolist():
        own = [(at - int(starts[text]), size)]
        if not np.array_equal(ids[at : at + size - q], ids[at + q : at + size]):
            own = [] if (text, q) in settled else _of_period(ids[starts[text] : starts[text + 1]], q)
            settled.add((text, q))
        for s, n in own:
            best[text, s, n] = min(q, best.get((text, s, n), q))
    for (text, s, n), q in best.items():
        out[text].append((s, n, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; of equals the first, then that of least period."""
    best = None
    for r in runs:  # sorted by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(found: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run has after its first period."""
    if not runs:
        return found
    change = np.zeros(len(found) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    return [found[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, with_runs: bool = False) -> DataFrame:
    """One row per document: n_runs; start, length, period and exponent_milli of the strongest run (null without any); digests
    of all runs and of the text without repetitions. On request also all runs and that text. `rewrite` changes a document's words first."""

    def start():
        def step(batch):
            out: dict[str, list] = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")}

            def flush(held: list[list[bytes]]) -> None:
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in held for w in ws), np.int64)
                starts = np.cumsum([0, *map(len, held)])
                for ws, runs in zip(held, find_runs(ids, starts), strict=True):
                    best, left = strongest(runs), b" ".join(collapsed(ws, runs))
                    out["n_runs"].append(len(runs))
                    for k, v in zip(("start", "length", "period"), best or (None,) * 3, strict=True):
                        out[k].append(v)
                    out["exponent_milli"].append(best and 1000 * best[1] // best[2])
                    out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
                    out["collapsed_sha256"].append(hashlib.sha256(left).hexdigest())
                    if with_runs:
                        out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                        out["collapsed"].append(left.decode())

            held, size = [], 0
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                if held and size + len(t) > CHARACTERS:
                    flush(held)
                    held, size = [], 0
                size += len(t)
                held.append(rewrite(d, words(t)) if rewrite else words(t))
            flush(held)
            return out | {"doc_id": batch.column(0)}

        return step

    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if with_runs else ""
    return map_rows(id_text(docs, id_col, text_col), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string" + more, start)


def repeat_tail(doc_id: int | None, found: list[bytes]) -> list[bytes]:
    """The contract's planted runs: in documents whose crc32 ends in 0, the words from a place on repeat a few of them. Documents
    without an id stay as they are."""
    import zlib

    h, n = zlib.crc32(str(doc_id).encode()), len(found)
    if doc_id is None or h % 10 or not n:
        return found
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return found[:a] + (found[a : a + p] * -(-(n - a) // p))[: n - a]
