"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary has a white-space marker after another character, so merges never cross the start of a run
of markers. A text is cut there, each distinct chunk is segmented once in a task, and ids are joined back by position.
Null and empty texts have no ids. Every row gives one row, rows that repeat an id and rows with a null id too; an empty table
gives none. Other columns stay out.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from .common import id_text, map_rows

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks held by a task at once, and the longest that is held.
TABLE_SIZE, LONGEST = 400_000, 64


def chunks(text: str) -> list[str]:
    """The text's chunks, each without its first marker, which the library puts there again."""
    if MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    return [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))] if text else []


class PieceTable:
    """Chunk -> (number of ids, ids as decimal text, decoded text)."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a white-space marker; chunks of this model can't be segmented apart")
        self.marker = [self.sp.piece_to_id(MARK)]
        self.table: dict[str, tuple[int, bytes, str]] = {}

    def entry(self, chunk: str, ids: list[int]) -> tuple[int, bytes, str]:
        if not chunk:  # a marker alone: the library gives no ids for an empty string
            ids = self.marker
        return len(ids), ",".join(map(str, ids)).encode(), " " + self.sp.decode(ids)

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.table) > TABLE_SIZE:
            self.table.clear()
        new = list({c for t in texts for c in t if c not in self.table and len(c) <= LONGEST})
        self.table.update(zip(new, map(self.entry, new, self.sp.encode(new, num_threads=1)), strict=True))

    def code(self, cut: list[str]) -> tuple[int, bytes, str]:
        """Ids and the decoded text of a text whose short chunks are in the table."""
        if not cut:
            return 0, b"", ""
        get = self.table.get
        rows = [get(c) or self.entry(c, self.sp.encode(c)) for c in cut]
        n, ids, texts = zip(*rows, strict=True)
        return sum(n), b",".join(ids), "".join(texts)[1:]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: number of ids, digests of the ids and of the decoded text; the ids and that text on request."""

    def start():
        table = PieceTable(model)

        def step(batch):
            texts = batch.column(1)
            out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            for at in range(0, len(texts), 512):
                cut = [chunks(t) for t in texts.slice(at, 512).to_pylist()]
                table.learn(cut)
                for c in cut:
                    n, ids, text = table.code(c)
                    out["n_tokens"].append(n)
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        out["ids"].append([int(i) for i in ids.split(b",") if i])
                        out["decoded"].append(text)
            return out | {"doc_id": batch.column(0)}

        return step

    more = ", ids array<int>, decoded string" if with_ids else ""
    return map_rows(id_text(docs, id_col, text_col), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more, start)
