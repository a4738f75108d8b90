"""Phrase collocations: frequent word sequences by hashed buckets (PCY, DHP) and Apriori pruning, scored by their weakest cut.

Texts are lower-cased (A-Z only), cut into pieces at marks and line ends, and those into words at blanks. Pass k over the texts
counts the k-word phrases that can be frequent exactly, and all k+1-word phrases whose two k-word parts can be, by buckets of a
hash. Pass k+1 counts a phrase only if its bucket was frequent (a bitmap of bounded size goes to all tasks) and both its parts
were found to be (a bitmap of their hashes). Both tests only ever let too much through, so counts are exact whatever the
bitmaps' sizes are; those follow the corpus up to `MOST_BITS`, beyond which more is counted exactly. Phrases are told apart by
their words, never by hashes.

Everything is per language, a null language being `und`. Null and empty texts have no words. Documents that repeat count as often
as they stand there, ids aren't read. An empty table gives no rows. Of cuts with equal scores the one after fewest words counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, written

#: Words of the longest phrase, and the language of rows without one. Fixed values of the contract.
LONGEST, NO_LANGUAGE = 5, "und"
#: Bits of a bucket number: at most so many, so a table of counts is 128 MB in a task and a bitmap 16 MB.
LEAST_BITS, MOST_BITS = 16, 27
#: Buckets of a slab, the unit in which tasks' counts meet; slabs that are summed at once.
SLAB, FAN = 1 << 16, 64
#: Words held by a task before they are counted; distinct words after which its numbering starts anew; bytes split at once.
HELD, VOCABULARY, SPLIT = 2_000_000, 1_000_000, 1_000_000
SALTS = 64

END = b"\xff"  # in no UTF-8 text: the end of a piece
_FOLD = bytearray(range(256))
_FOLD[ord("A") : ord("Z") + 1] = bytes(range(ord("a"), ord("z") + 1))
_FOLD[9] = 32
for _c in b".,;:!?\n\v\f\r":  # fixed values of the contract
    _FOLD[_c] = 0xFF
FOLD = bytes(_FOLD)


def cut(text: bytes) -> list[bytes]:
    """Words and piece ends of a text in UTF-8."""
    return text.translate(FOLD).replace(END, b" " + END + b" ").split()


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The hash of a phrase hashed to x with a word hashed to y after it."""
    x = x * np.uint64(0x9E3779B97F4A7C15) + y
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """64-bit hashes of words of one language, the same in every task."""

    def __init__(self, lang: str):
        from xxhash import xxh3_64_intdigest

        self.seed, self.of = xxh3_64_intdigest(lang.encode()), xxh3_64_intdigest

    def word(self, w: bytes) -> int:
        return self.of(w, seed=self.seed)


class Bitmap:
    """A set of hashes by their first bits."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Buckets:
    """Counts by the first bits of hashes, up to 255 and no further: enough to tell what reaches a bar of 255 or less."""

    def __init__(self, bits: int):
        self.bits, self.counts = bits, np.zeros(1 << bits, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        if len(self.counts) <= 8 * len(at):  # counting all buckets takes less than sorting
            self.counts = np.minimum(np.bincount(at, minlength=len(self.counts)) + self.counts, 255).astype(np.uint8)
        else:
            at, n = np.unique(at, return_counts=True)
            self.counts[at] = np.minimum(self.counts[at] + n, 255).astype(np.uint8)

    def rows(self, task: int) -> Iterator[dict]:
        for k, slab in enumerate(self.counts.reshape(-1, min(SLAB, len(self.counts)))):
            if slab.any():
                yield {"slab": k, "task": task, "blob": slab.tobytes()}


ROWS = "lang string, phrase string, n long, slab long, task long, blob binary"


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "slab": pa.int64(), "task": pa.int64(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def bitmap(parts: DataFrame, bits: int, least: int) -> Bitmap:
    """The buckets that reach `least` over all tasks, of rows (slab, task, blob of counts) without the bar of 255 being passed.

    Slabs are summed in rounds of at most FAN tasks, so none is a large group; the driver gets the bits, 16 MB at most.
    """

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table["blob"][0].as_py()), np.int64)
        for x in table["blob"]:
            total += np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"slab": table["slab"].slice(0, 1), "task": pa.array([table["task"][0].as_py() // FAN], pa.int64()), "blob": [np.minimum(total, 255).astype(np.uint8).tobytes()]})

    parts = parts.where("blob IS NOT NULL").select("slab", "task", "blob")
    tasks, made = (parts.agg(F.max("task")).first()[0] or 0) + 1, []
    while tasks > 1:
        parts = written(parts.groupBy("slab", F.floor(F.col("task") / FAN).alias("g")).applyInArrow(add, "slab long, task long, blob binary"), "slabs")
        made.append(parts)
        tasks = -(-tasks // FAN)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.packbits(np.frombuffer(x.as_py(), np.uint8) >= least, bitorder="little").tobytes() for x in b.column(2)], pa.binary())], names=["slab", "bits"])

    packed = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.mapInArrow(pack, "slab long, bits binary").toLocalIterator():
        at = r["slab"] * min(SLAB, 1 << bits) // 8
        packed[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    for p in made:
        forget(p)
    return Bitmap(bits, packed)


class Numbers(dict):
    """Words numbered in the order in which they are first looked up."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.words = [b""] * len(known)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


class Scan:
    """One task's work of pass k over the texts of one language."""

    def __init__(self, lang: str, k: int, words: Bitmap | None, parts: Bitmap | None, allowed: Bitmap | None, buckets: Buckets | None):
        self.lang, self.k, self.frequent, self.parts, self.allowed, self.buckets, self.hash = lang, k, words, parts, allowed, buckets, Hashes(lang)
        self.held: list[np.ndarray] = []
        self.size = 0
        self._renew()

    def _renew(self) -> None:
        self.numbers = Numbers({END: 0})
        self.words, self.hashes, self.counts = self.numbers.words, np.zeros(1, np.uint64), np.zeros(1, np.int64)
        self.live = np.zeros(1, np.int64)  # a word's own number, or 0: one that isn't frequent ends a piece

    def add(self, text: bytes) -> None:
        found = cut(text)
        ids = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        new = self.words[len(self.live) :]
        if new:
            h = np.fromiter(map(self.hash.word, new), np.uint64, len(new))
            at = np.arange(len(self.live), len(self.words))
            self.live = np.concatenate([self.live, np.where(self.frequent.has(h), at, 0) if self.frequent else at])
            self.hashes = np.concatenate([self.hashes, h])
        self.held.append(self.live[ids])
        self.held.append(np.zeros(1, np.int64))
        self.size += len(found) + 1

    def count(self) -> Iterator[dict]:
        """Count what is held; rows of phrases, of words only when their numbering starts anew."""
        if self.size:
            ids = np.concatenate(self.held)
            self.held, self.size = [], 0
            h = self.hashes[ids]
            if self.k == 1:
                self.counts = np.bincount(ids, minlength=len(self.words)) + np.pad(self.counts, (0, len(self.words) - len(self.counts)))
                here, gram = ids > 0, h
            else:
                here, part, gram = ids > 0, h, h
                for j in range(1, self.k):
                    here = here[:-1] & (ids[j:] > 0)
                    part, gram = gram, _mixed(gram[:-1], h[j:])
                at = np.flatnonzero(here)
                at = at[self.allowed.has(gram[at])]
                if self.k > 2:
                    at = at[self.parts.has(part[at])]
                    at = at[self.parts.has(part[at + 1])]
                here = np.zeros(len(gram), bool)
                here[at] = True
                yield from self._phrases(ids, at)
            if self.buckets:
                next_ = np.flatnonzero(here[:-1] & here[1:])
                self.buckets.add(_mixed(gram[next_], h[next_ + self.k]))
        if len(self.numbers) > VOCABULARY:
            yield from self.close()

    def _phrases(self, ids: np.ndarray, at: np.ndarray) -> Iterator[dict]:
        if not len(at):
            return
        code = ids[at]
        for j in range(1, self.k):
            _, first, code, n = np.unique(code * len(self.words) + ids[at + j], return_index=True, return_inverse=True, return_counts=True)
        rows = ids[at[first][:, None] + np.arange(self.k)].tolist()
        name = self.words
        for r, c in zip(rows, n.tolist(), strict=True):
            yield {"lang": self.lang, "phrase": b" ".join([name[i] for i in r]).decode(), "n": c}

    def close(self) -> Iterator[dict]:
        if self.k == 1:
            for w, c in zip(self.words[1:], self.counts[1:].tolist(), strict=True):
                yield {"lang": self.lang, "phrase": w.decode(), "n": c}
        self._renew()


def _pass(texts: DataFrame, k: int, bits: int, words: Bitmap | None = None, parts: Bitmap | None = None, allowed: Bitmap | None = None, longest: int = LONGEST) -> DataFrame:
    """Rows of counted phrases of k words, and of buckets of k + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        buckets = Buckets(bits) if k < longest else None
        scans: dict[str, Scan] = {}
        out: list[dict] = []

        def full(rows: Iterator[dict], least: int) -> Iterator[pa.RecordBatch]:
            for r in rows:
                out.append(r)
                if len(out) >= least:
                    yield _batch(out)
                    out.clear()

        for batch in batches:
            held: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, []).append(text.as_py())
            for lang, own in held.items():
                if lang not in scans:
                    scans[lang] = Scan(lang, k, words, parts, allowed, buckets)
                scan, at = scans[lang], 0
                while at < len(own):
                    to, size = at, 0
                    while to < len(own) and (to == at or size + len(own[to]) < SPLIT):
                        size += len(own[to])
                        to += 1
                    scan.add("\n".join(own[at:to]).encode("utf-8", "replace"))
                    at = to
                    if scan.size >= HELD:
                        yield from full(scan.count(), 50_000)
        for scan in scans.values():
            yield from full(scan.count(), 50_000)
            yield from full(scan.close(), 50_000)
        if buckets:
            yield from full(buckets.rows(TaskContext.get().partitionId()), 256)
        if out:
            yield _batch(out)

    return texts.mapInArrow(run, ROWS)


def _hashed(phrases: DataFrame, bits: int) -> DataFrame:
    """Bitmap rows of the phrases' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        buckets, known = Buckets(bits), {}
        for b in batches:
            got = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = known.setdefault(lang, None) or known.update({lang: Hashes(lang)}) or known[lang]
                got.append([h.word(w) for w in phrase.encode().split(b" ")])
            if got:
                a = np.array(got, np.uint64)
                x = a[:, 0]
                for j in range(1, a.shape[1]):
                    x = _mixed(x, a[:, j])
                buckets.add(x)
        for r in buckets.rows(TaskContext.get().partitionId()):
            yield _batch([r])

    return phrases.select("lang", "phrase").mapInArrow(run, ROWS)


def _bits(n: float) -> int:
    return int(np.clip(np.ceil(np.log2(max(n, 1.0))), LEAST_BITS, MOST_BITS))


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of all phrases of up to `longest` words that occur `least` times or more in their language, and
    (lang, total) of all word occurrences. `least` is at most 255, for buckets count no further."""
    if not 1 <= least <= 255:
        raise ValueError("least must lie between 1 and 255")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bits = _bits((texts.agg(F.sum(F.length("text"))).first()[0] or 0) / 96)  # a bucket for 16 words of 6 characters
    found, totals = [], None
    words = parts = allowed = None
    for k in range(1, longest + 1):
        rows = written(_pass(texts, k, bits, words, parts, allowed, longest), f"phrases-{k}")
        if k == 1:
            totals = written(rows.where("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("total")), "totals")
        counts = rows.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        found.append(written(counts.select("lang", F.lit(k).alias("size"), "phrase", "n"), f"frequent-{k}"))
        n = found[-1].count()
        if n and k < longest:
            allowed = bitmap(rows, bits, least)
            own = _bits(16 * n)
            parts = bitmap(written(_hashed(found[-1], own), "hashed"), own, 1)
            words = words or parts
        forget(rows)
        if not n:
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, top: int = 2000, share: int = 100, longest: int = LONGEST) -> DataFrame:
    """Each language's `top` phrases of 2 words or more: lang, rank, phrase, a (occurrences), l and r (of the parts of its weakest
    cut), n (words of the language), score = floor(1000 a n / (l r)) of that cut. A phrase that lies in a longer one with `share`
    percent of its occurrences or more is left out."""
    frequent, totals = frequent_phrases(docs, lang_col, text_col, least, longest)
    many = frequent.where("size > 1").withColumn("w", F.split("phrase", " "))
    # The frequent phrases that each longer one holds, with its count: the first shuffle gets the largest of a task only.
    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inside = many.where("size > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left = many.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n")))
    cuts = left.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.expr("transform(sequence(1, size - 1), k -> struct(k, array_join(slice(w, 1, k), ' ') AS head, array_join(slice(w, k + 1, size - k), ' ') AS tail))")).alias("c")).select("lang", "phrase", "a", "c.*")
    counted = lambda side, to: frequent.select("lang", F.col("phrase").alias(side), F.col("n").alias(to))
    both = cuts.join(counted("head", "l"), ["lang", "head"]).join(counted("tail", "r"), ["lang", "tail"]).join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    wide = lambda c: f"cast({c} AS decimal(19, 0))"
    scored = both.withColumn("score", F.expr(f"(cast(1000 AS decimal(4, 0)) * {wide('a')} * cast(total AS decimal(15, 0))) div ({wide('l')} * {wide('r')})"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"), F.first("total").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = weakest.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("p", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("p") <= top)
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_WORDS = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
     p AS (SELECT lang, list_filter(string_split_regex(unnest(pieces), '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
     totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),"""
COLLOCATIONS_SQL = _WORDS + """
     g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
     f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 100),
     many AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
     inside AS (SELECT DISTINCT lang, n, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase FROM many WHERE k > 2),
     kept AS (SELECT * FROM many m WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = m.lang AND i.phrase = m.phrase AND 100 * i.n >= 100 * m.n)),
     cuts AS (SELECT lang, phrase, n AS a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
     scored AS (SELECT x.lang, x.phrase, x.a, x.c, h.n AS l, t.n AS r, s.n, CAST((1000::HUGEINT * x.a * s.n) // (h.n::HUGEINT * t.n) AS BIGINT) AS score
                FROM cuts x JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f t ON t.lang = x.lang AND t.phrase = x.tail JOIN totals s ON s.lang = x.lang),
     worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS q FROM scored) WHERE q = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst) WHERE rank <= 2000
"""
