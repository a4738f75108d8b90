"""Token ids in fixed-width bit packing.

A segment holds whole documents: a head with their ids and lengths, and blocks of ids, in each of which an id takes the
fewest bits that hold the vocabulary. Blocks end on whole bytes, so any of them can be unpacked alone. Head and blocks are
rows of a Parquet table in the shared folder, so that Spark's commit protocol guards them against lost tasks, and a range of
a document's ids is read from the head and the blocks that hold it. export() writes segments as plain files too: the head,
the byte offset of each block, the blocks.
Documents stand in ascending doc_id order (nulls first, ties by text), each with an end id; null text counts as empty; rows
that repeat an id all stay. An empty table has no segments. A document of any length is in one segment.
"""

from __future__ import annotations

import os
import string
import struct
import sys
import types
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .common import id_text

MAGIC, HEAD = b"IDPACK1\0", "<8sIIQII"
#: Ids in a block; ids after which a segment is closed.
BLOCK, SEGMENT = 4096, 1 << 20
#: Chunks of a table, of which a worker holds two, and the longest that is held.
TABLE_SIZE, LONGEST = 600_000, 64
#: Letters before this one are cut from marks behind them; chunks coded in one call.
LATIN, JOINED = "\u0180", 256


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # the same layout, without the detour over bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(lanes[:, :bits], bitorder="little").tobytes()


def unpack(data, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    lanes = np.zeros((n, 32), np.uint8)
    lanes[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    return np.packbits(lanes, axis=1, bitorder="little").view("<u4").ravel()


def packed(ids: np.ndarray, bits: int) -> list[bytes]:
    return [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]


def head(bits: int, n_ids: int, n_blocks: int, doc_ids: list[int | None], lengths: list[int]) -> tuple[bytes, bytes]:
    """The fixed part of a head, and the documents."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    return struct.pack(HEAD, MAGIC, bits, BLOCK, n_ids, len(doc_ids), n_blocks), b"".join([keys.tobytes(), np.array(lengths, "<u8").tobytes(), known.tobytes()])


def image(top: bytes, documents: bytes, blocks: list[bytes]) -> bytes:
    """A segment as one file; without blocks, its offsets are 0."""
    sizes = [*map(len, blocks)] or [0] * struct.unpack(HEAD, top)[-1]
    return b"".join([top, np.cumsum([0, *sizes]).astype("<u8").tobytes(), documents, *blocks])


class Segment:
    """Reads a segment; ids(i, j) unpacks only the blocks that hold ids i to j. `data` may lack the blocks at its end."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.n_ids, n_docs, n_blocks = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a segment of packed ids")
        at = struct.calcsize(HEAD)

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.offsets = part("<u8", n_blocks + 1).astype(int)
        keys, self.lengths = part("<i8", n_docs), part("<u8", n_docs).astype(int)
        known = part("u1", n_docs)
        self.doc_ids = [int(k) if x else None for k, x in zip(keys, known, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(int)
        self.data = memoryview(data)[at:]

    def ids(self, i: int = 0, j: int | None = None) -> np.ndarray:
        j = self.n_ids if j is None else min(j, self.n_ids)
        if i >= j:
            return np.zeros(0, np.uint32)
        first, last = i // self.block, (j - 1) // self.block
        got = [unpack(self.data[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(got)[i - first * self.block : j - first * self.block]

    def doc(self, k: int) -> np.ndarray:
        return self.ids(self.starts[k], self.starts[k + 1])


class WordTable:
    """Ids of each distinct chunk between blanks, as little-endian 32-bit bytes.

    The tokenizer's normaliser and splitter never join characters over a blank or line end, so chunks can be coded
    apart, many of them in one call. It lower-cases, so an ASCII chunk has the ids of its lower-case form, and it cuts
    between a letter or digit and the ASCII marks behind it, so those two parts are looked up apart. A text with the
    start of an added token is coded whole. Two tables are held: a full one is kept until the next is full, and what
    is still in use moves over.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        if "Lowercase" not in str(self.tok.normalizer) or "ByteLevel" not in str(self.tok.pre_tokenizer):
            raise ValueError("this tokenizer's words can't be coded apart")
        self.vocabulary = self.tok.get_vocab_size(with_added_tokens=True)
        self.table: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {ord(c): spell(c)[0][0] for c in map(chr, range(128, ord(LATIN)))}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without blanks. Lower-case Latin words go to the model as they are spelled in bytes, for the
        normaliser and the splitter would leave them whole; others are coded in joined runs and cut where the next
        chunk's first character begins."""
        out, rest, model = [b""] * len(chunks), [], self.tok.model
        for i, c in enumerate(chunks):
            if c.isalpha() and c.islower() and max(c) < LATIN:
                out[i] = array("I", [t.id for t in model.tokenize(c if c.isascii() else c.translate(self.spelled))]).tobytes()
            else:
                rest.append(i)
        for at in range(0, len(rest), JOINED):
            run = rest[at : at + JOINED]
            got = self.tok.encode(" ".join(chunks[i] for i in run), add_special_tokens=False)
            begins = np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids))
            cuts = np.searchsorted(begins, np.cumsum([0, *(len(chunks[i]) + 1 for i in run)])).tolist()
            data = np.array(got.ids, "<u4").tobytes()
            for i, k, j in zip(run, cuts, cuts[1:], strict=False):
                out[i] = data[4 * k : 4 * j]
        return out

    def learn(self, new: list[str]) -> None:
        """Add the ids of chunks that the table lacks; those of the table before it move over."""
        if len(self.table) > TABLE_SIZE:
            self.before, self.table = self.table, {}
        table, before, cut = self.table, self.before, []
        for c in new:
            if (found := before.get(c)) is not None:
                table[c] = found
                continue
            plain = c.lower() if c.isascii() else c
            stem = plain.rstrip(string.punctuation)
            if not stem or stem[-1] >= LATIN or not stem[-1].lower().isalnum():
                stem = plain
            cut.append((c, stem, plain[len(stem) :]))
        lack = list(dict.fromkeys(x for _, *parts in cut for x in parts if x not in table))
        known = {x: found for x in lack if (found := before.get(x)) is not None}
        table.update(known)
        lack = [x for x in lack if x not in known]
        table.update(zip(lack, self.chunks(lack), strict=True))
        for c, stem, marks in cut:
            table[c] = table[stem] + table[marks]

    def code(self, texts: list[str]) -> list[bytes]:
        cut = [None if "<|" in t else t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*(c for c in cut if c is not None)).difference(self.table)
        if len(self.table) > TABLE_SIZE:  # learn() will start a new table
            new = set().union(*(c for c in cut if c is not None))
        self.learn(list(new))
        get = self.table.__getitem__
        out = [b"".join(map(get, c)) if c is not None else self.whole([t])[0] for c, t in zip(cut, texts, strict=True)]
        for c in [c for c in new if len(c) > LONGEST]:  # long chunks seldom come back
            for x in (c, c.lower(), c.lower().rstrip(string.punctuation)):
                self.table.pop(x, None)
        return out


def word_table(path: str) -> WordTable:
    """The table of a Python worker: the tasks that one process runs share it. Functions come to workers by value, each time
    with globals of their own, so the table is kept as a module of the process, which needs no file on the executor."""
    held = sys.modules.setdefault("arbolith_worker_tables", types.ModuleType("arbolith_worker_tables"))
    if path not in held.__dict__:
        held.__dict__[path] = WordTable(path)
    return held.__dict__[path]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """Write the table of segments and read it again. A head (block -1) has the ids before its segment in its part (`first`), the
    least and greatest document id and, as data, the head without offsets; a block has the ids before it in its segment."""
    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer)
        wide, end = bits or width(max(table.vocabulary, end_id + 1)), np.array([end_id], "<u4").tobytes()
        part, seg, first, held = TaskContext.get().partitionId(), 0, 0, []

        def close() -> pa.RecordBatch:
            nonlocal seg, first, held
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            blocks, known = packed(ids, wide), [d for d, _ in held if d is not None]
            data = [b"".join(head(wide, len(ids), len(blocks), [d for d, _ in held], [len(x) // 4 for _, x in held])), *blocks]
            n = len(data)
            columns = [[part] * n, [seg] * n, range(-1, n - 1), [first, *range(0, len(ids), BLOCK)], [len(ids), *(min(BLOCK, len(ids) - i) for i in range(0, len(ids), BLOCK))], [min(known, default=None), *[None] * (n - 1)], [max(known, default=None), *[None] * (n - 1)], data]
            seg, first, held = seg + 1, first + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for d, x in zip(rows.column(0).to_pylist(), table.code(rows.column(1).to_pylist()), strict=True):
                    held.append((d, x + end))
                    size += len(x) // 4 + 1
                    if size >= SEGMENT:
                        yield close()
                        size = 0
        if held:
            yield close()

    ordered = id_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "part int, seg int, block int, first long, n_ids long, low long, high long, data binary"), "idpack")


def with_starts(segments: DataFrame) -> DataFrame:
    """Add `start`, for heads the ids before them over all parts. The driver sees one row for each part, no more."""
    spark = segments.sparkSession
    totals = segments.where("block = -1").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for r in totals:
        rows.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(rows, "part int, before long")
    return segments.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("first"))


def whole(data: bytes, blocks: list[bytes]) -> Segment:
    """A segment from its head's row and its blocks' rows."""
    cut = struct.calcsize(HEAD)
    return Segment(image(data[:cut], data[cut:], blocks))


def read_documents(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from the segments: doc_id, start, n_tokens, ids_crc32, and the ids on request."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, bytes, list[bytes]] | None = None

        def documents() -> pa.RecordBatch:
            start, data, blocks = held
            seg = whole(data, blocks)
            ids = seg.ids().astype("<u4")
            each = [ids[i:j] for i, j in zip(seg.starts, seg.starts[1:], strict=False)]
            columns = [seg.doc_ids, start + seg.starts[:-1], seg.lengths, [zlib.crc32(x) for x in each], [x.astype(np.int32) for x in each]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=False)], names=[n for n, _ in fields])

        for batch in batches:
            for start, block, data in zip(*(batch.column(c).to_pylist() for c in ("start", "block", "data")), strict=True):
                if block >= 0:
                    held[2].append(data)
                    continue
                if held:
                    yield documents()
                held = (start, data, [])
        if held:
            yield documents()

    rows = with_starts(segments).select("part", "seg", "block", "start", "data").repartition("part", "seg").sortWithinPartitions("part", "seg", "block")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def read_ids(segments: DataFrame, doc_id: int, i: int = 0, j: int | None = None) -> np.ndarray:
    """Ids i to j of a document (the first one of that id): reads the head of its segment and the blocks that hold them, which
    Parquet finds by the least and greatest values of its row groups and pages. KeyError if there is none."""
    row = segments.where((F.col("block") == -1) & (F.col("low") <= doc_id) & (F.col("high") >= doc_id)).orderBy("part", "seg").limit(1).collect()
    top = whole(row[0]["data"], []) if row else None
    if not top or doc_id not in top.doc_ids:
        raise KeyError(doc_id)
    k = top.doc_ids.index(doc_id)
    lo, hi = int(top.starts[k]) + max(i, 0), int(top.starts[k + 1] if j is None else min(top.starts[k] + j, top.starts[k + 1]))
    if lo >= hi:
        return np.zeros(0, np.uint32)
    first, last = lo // top.block, (hi - 1) // top.block
    rows = segments.where((F.col("part") == row[0]["part"]) & (F.col("seg") == row[0]["seg"]) & F.col("block").between(first, last)).orderBy("block").select("n_ids", "data").collect()
    ids = np.concatenate([unpack(r["data"], r["n_ids"], top.bits) for r in rows])
    return ids[lo - first * top.block : hi - first * top.block]


def export(segments: DataFrame, folder: str) -> list[str]:
    """Write the segments as plain files part-segment.idpack in a local folder of the driver, one at a time."""
    paths, held = [], None
    Path(folder).mkdir(parents=True, exist_ok=True)

    def put(key: tuple[int, int], data: bytes, blocks: list[bytes]) -> None:
        cut = struct.calcsize(HEAD)
        (p := Path(folder, f"{key[0]:06d}-{key[1]:06d}.idpack")).write_bytes(image(data[:cut], data[cut:], blocks))
        paths.append(str(p))

    for r in segments.orderBy("part", "seg", "block").toLocalIterator():
        if r["block"] >= 0:
            held[2].append(bytes(r["data"]))
            continue
        if held:
            put(*held)
        held = ((r["part"], r["seg"]), bytes(r["data"]), [])
    if held:
        put(*held)
    return paths
