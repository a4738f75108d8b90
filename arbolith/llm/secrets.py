"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Null and empty texts have no spans. Every row gives one row, repeated rows and rows with a null id too; an empty table gives
none. Offsets count code points. Spans that begin together stand in the order of KINDS. Other columns stay out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from .common import id_text, map_rows

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: All access and hex spans, and all candidates of the models, lie within such runs.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CODE = np.full(128, -1)
CODE[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))

STEMS = (
    "get set user name file path list count index value data request response handler manager service client server "
    "config option default parse format string number time date update delete create insert select table column row "
    "page view model test result error message event stream buffer read write open close start stop init load save "
    "cache key map array node tree graph edge type class method field static public private return license version "
    "example product account order customer invoice report summary image video audio network address language text "
    "document paragraph sentence character position length width height maximum minimum average total the and with "
    "that this from for not was were have been international understanding development information communication "
    "nicht werden schaft heit keit ung lich gesellschaft entwicklung verbindung nachricht einstellung pour dans avec "
    "mentation ement eaux tion ique encore toujours maintenant ciones mente ador para como este nuestra desarrollo"
).split()


def labelled_samples(n: int = 6000, seed: int = 7) -> list[tuple[str, bool]]:
    """n strings, half random (True) and half ordinary identifiers (False), from a seed."""
    rng = np.random.default_rng(seed)
    sets = [ALPHABET[:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", "0123456789abcdef", "0123456789ABCDEF", ALPHABET[:26] + "234567", ALPHABET[:26] + "0123456789"]
    out: list[tuple[str, bool]] = []
    for _ in range(n // 2):
        letters = sets[rng.integers(len(sets))]
        out.append(("".join(letters[i] for i in rng.integers(len(letters), size=rng.integers(16, 65))), True))
    while len(out) < n:
        parts = [STEMS[i] for i in rng.integers(len(STEMS), size=rng.integers(2, 8))]
        style = rng.integers(8)
        if style == 0:
            s = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 1:
            s = "_".join(parts)
        elif style == 2:
            s = "-".join(parts)
        elif style == 3:
            s = "/".join(parts) + "." + parts[0][:3]
        elif style == 4:
            s = ".".join(parts)
        elif style == 5:
            s = "".join(parts)
        elif style == 6:
            s = "_".join(parts).upper() if rng.integers(2) else "".join(parts).upper()
        else:
            s = f"{parts[0]}-{rng.integers(1990, 2040)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}-v{rng.integers(10)}.{rng.integers(30)}.{rng.integers(100)}" if rng.integers(2) else str(rng.choice(list("=-._"))) * int(rng.integers(16, 60)) + parts[0]
        out.append((s, False))
    return out


class MarkovPair:
    """First-order character models of random strings and identifiers; the table holds their log-likelihood ratio."""

    def __init__(self, samples: Iterable[tuple[str, bool]], smoothing: float = 0.5):
        a = len(ALPHABET)
        counts = np.full((2, a + 1, a), smoothing)
        for text, random in samples:
            codes = self.codes(text)
            np.add.at(counts[int(bool(random))], (np.r_[a, codes[:-1]], codes), 1)
        logs = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.ratio = logs[1] - logs[0]

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return CODE[np.frombuffer(text.encode("ascii"), np.uint8)]

    def score(self, text: str) -> float:
        codes = self.codes(text)
        return float(self.ratio[np.r_[len(ALPHABET), codes[:-1]], codes].sum())


def spans_of(text: str, model: MarkovPair, least: float, shortest: int) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; base spans stay, the models add runs that touch none of them."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    runs = list(RUN.finditer(text))
    for m in runs:
        at, run = m.start(), m[0]
        if "AKIA" in run:
            spans += [(at + x.start(), 1, at + x.end()) for x in ACCESS.finditer(run) if len(x[0]) >= 18]
        spans += [(at + x.start(), 2, at + x.end()) for x in HEX.finditer(run)]
    base = [(s, e) for s, _, e in spans]
    for m in runs:
        run = m[0].strip("._-/=")
        at = m.start() + m[0].index(run) if run else 0
        if len(run) >= shortest and not any(s < at + len(run) and at < e for s, e in base) and model.score(run) >= least:
            spans.append((at, 3, at + len(run)))
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: list[tuple[str, bool]] | None = None, least: float = 10.0, shortest: int = 20) -> DataFrame:
    """One row per document: span counts, digest of the base spans, and all spans.

    samples: labelled strings to train from, by default labelled_samples(). A run of `shortest` or more characters is
    added when its log-likelihood ratio, random against identifier, is `least` or more. The model is a fixed 69 x 68 table.
    """
    model = MarkovPair(samples if samples is not None else labelled_samples())

    def start():
        def step(batch):
            found = [spans_of(t, model, least, shortest) for t in batch.column(1).to_pylist()]
            out = {"doc_id": batch.column(0), "spans": [joined(x) for x in found]}
            for k in range(4):
                out[f"n_{KINDS[k]}"] = [sum(s[1] == k for s in x) for x in found]
            out["base_sha256"] = [hashlib.sha256(joined([s for s in x if s[1] < 3]).encode()).hexdigest() for x in found]
            return out

        return step

    return map_rows(id_text(docs, id_col, text_col), "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string", start)
