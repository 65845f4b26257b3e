"""Secret scan: Shannon entropy in a sliding window over candidate strings, per character class."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trigrove.llm import kernels
from trigrove.llm.common import col


@dataclass(frozen=True)
class CharClass:
    """Runs of ``chars`` are looked at; what is left of one without leading words is a candidate if it has at least
    ``window`` characters. It is reported if a window of it has an entropy of at least ``bits`` per
    character. ``pad`` adds up to two "=" that follow."""

    name: str
    chars: str
    window: int
    bits: float
    pad: bool = False


_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

CLASSES = (
    CharClass("hex", _DIGIT + "abcdef", 16, 2.75),
    CharClass("upper", _UPPER + _DIGIT, 16, 3.0),
    CharClass("base64", _UPPER + _LOWER + _DIGIT + "+/_-", 20, 3.6, True),
)
_WORD = "(?:[A-Z]?[a-z]+|[A-Z]+)"
#: Words at the beginning of a run that separators end: key names and path segments, which are no part of a secret.
LEAD = f"(?:[-_/+]*{_WORD}[-_/+])*[-_/+]*"
#: Candidates that match one of these as a whole are no secrets: words of one case or capitalized,
#: alone or joined, also before a short number; numbers and dates; UUIDs; placeholders.
ALLOWED = (
    rf"{_WORD}(?:[-_/+]+{_WORD})*[-_/+]*(?:[0-9]{{1,4}})?",
    r"[a-z]*(?:[A-Z][a-z]{2,})+",
    r"[0-9_/+-]+",
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    r".*(?:EXAMPLE|example|XXXX|xxxx|0123456789|abcdefgh).*",
)


def window_entropy(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int, n_symbols: int, steps: int = 512) -> np.ndarray:
    """The greatest entropy of any window of each run of symbols.

    All runs advance together: per step one symbol enters and one leaves, so two
    counts of each run change and its sum of c * log2(c) with them. Long runs
    are cut into overlapping pieces of ``steps`` windows.
    """
    n_windows = lengths - window + 1
    pieces = -(-n_windows // steps)
    owner = np.repeat(np.arange(len(starts)), pieces)
    first = kernels.runs(np.zeros(len(starts), np.int64), pieces) * steps
    begin, count = starts[owner] + first, np.minimum(steps, n_windows[owner] - first)
    order = np.argsort(-count, kind="stable")
    owner, begin, count = owner[order], begin[order], count[order]
    c = np.arange(window + 1, dtype=np.float64)
    xlogx = np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0)
    counts = np.zeros((len(owner), n_symbols), np.int16)
    rows = np.arange(len(owner))
    total = np.zeros(len(owner))
    best = np.full(len(starts), -1.0)
    top = np.full(len(owner), -1.0)

    def change(live: np.ndarray, symbol: np.ndarray, by: int) -> None:
        was = counts[live, symbol]
        counts[live, symbol] = was + by
        total[live] += xlogx[was + by] - xlogx[was]

    for i in range(window):
        change(rows, symbols[begin + i], 1)
    top = np.log2(window) - total / window
    for i in range(1, int(count[0]) if len(count) else 0):
        live = rows[: np.searchsorted(-count, -i, side="left")]
        change(live, symbols[begin[live] + i - 1], -1)
        change(live, symbols[begin[live] + i + window - 1], 1)
        top[live] = np.maximum(top[live], np.log2(window) - total[live] / window)
    np.maximum.at(best, owner, top)
    return best


def find_secrets(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per finding: doc_id, char_class, start (character, from 0), length, millibits, preview.

    Candidates of a class are the maximal runs of its characters without LEAD, so a finding begins at
    the secret and not at its key's name or the folder it is in. A candidate
    that matches a pattern of the allow-list as a whole is suppressed; one that overlaps a reported
    candidate of an earlier class in ``classes`` is reported once, for that earlier class.
    millibits is the greatest window entropy, rounded; preview shows four characters only.
    Null and empty texts have no findings; a null id stays null; repeated rows
    repeat their findings; other columns are not read.
    """
    allow = re.compile("|".join(f"(?:{p})" for p in allowed) or r"(?!)", re.S)
    lead = re.compile(LEAD)
    widest = min(c.window for c in classes)
    tables = []
    for c in classes:
        t = np.full(256, 255, np.uint8)
        for i, ch in enumerate(c.chars):
            t[ord(ch)] = i
        tables.append(t)
    any_of = np.zeros(256, bool)
    for t in tables:
        any_of |= t != 255
    parted = frozenset(chr(i) for i in range(128) if not any_of[i] and chr(i) != "=")

    def slice_findings(data: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, class, first byte, length, millibits)."""
        on = np.concatenate(([False], any_of[data], [False]))
        edge = np.flatnonzero(on[1:] != on[:-1])
        s, e = edge[0::2], edge[1::2]
        # a run that crosses from one row to the next is cut there
        row_s, row_e = np.searchsorted(begins, s, side="right") - 1, np.searchsorted(begins, e - 1, side="right") - 1
        crossing = np.flatnonzero(row_s != row_e)
        if len(crossing):
            extra = [(max(int(s[i]), int(begins[r])), min(int(e[i]), int(begins[r + 1]))) for i in crossing for r in range(row_s[i], row_e[i] + 1)]
            keep = np.ones(len(s), bool)
            keep[crossing] = False
            s = np.concatenate((s[keep], [a for a, _ in extra])).astype(np.int64)
            e = np.concatenate((e[keep], [z for _, z in extra])).astype(np.int64)
            order = np.argsort(s, kind="stable")
            s, e = s[order], e[order]
        long = e - s >= widest
        s, e = s[long], e[long]
        if not len(s):
            return []
        at = kernels.runs(s, e - s)
        piece = np.repeat(np.arange(len(s)), e - s)
        found: list[tuple[int, int, int, int, int]] = []
        # what earlier classes have reported: intervals in order, none of which overlap
        taken_from, taken_to = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k, (c, t) in enumerate(zip(classes, tables)):
            sym = t[data[at]]
            inside = np.concatenate(([False], sym != 255, [False]))
            joined = np.concatenate(([True], piece[1:] != piece[:-1], [True]))
            begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | joined[:-1]))
            end = np.flatnonzero(inside[1:-1] & (~inside[2:] | joined[1:])) + 1
            ok = end - begin >= c.window
            begin, end = begin[ok], end[ok]
            texts = [data[at[b] : at[b] + z - b].tobytes().decode("ascii") for b, z in zip(begin.tolist(), end.tolist())]
            cut = np.array([lead.match(x).end() for x in texts], np.int64)
            some = np.flatnonzero(end - begin - cut >= c.window)
            if not len(some):
                continue
            begin, end = begin[some] + cut[some], end[some]
            bits = window_entropy(sym, begin, end - begin, c.window, len(c.chars))
            good = [i for i in np.flatnonzero(bits >= c.bits - 1e-9) if not allow.fullmatch(texts[some[i]], cut[some[i]])]  # counts that change step by step leave a rounding error
            lo = at[begin[good]]
            hi = at[end[good] - 1] + 1
            row = np.searchsorted(begins, lo, side="right") - 1
            if c.pad:
                for _ in range(2):
                    more = hi < begins[row + 1]
                    hi = hi + (more & (data[np.minimum(hi, len(data) - 1)] == ord("=")))
            i = np.searchsorted(taken_from, hi)
            free = (i == 0) | (np.concatenate(([0], taken_to))[i] <= lo)
            for r, a, z, h in zip(row[free].tolist(), lo[free].tolist(), hi[free].tolist(), bits[good][free]):
                found.append((r, k, a, z - a, int(np.floor(h * 1000 + 0.5 + 1e-6))))
            taken_from, taken_to = np.concatenate((taken_from, lo[free])), np.concatenate((taken_to, hi[free]))
            order = np.argsort(taken_from, kind="stable")
            taken_from, taken_to = taken_from[order], taken_to[order]
        return found

    def row_pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[str]]]:
        """Rows, the characters that come before, and texts; a long text in pieces that cut no run."""
        for lo, hi in kernels.slices(texts):
            if hi == lo + 1 and texts[lo] and len(texts[lo]) > kernels.SLICE_CHARS:
                for a, z in kernels.cuts(texts[lo], parted.__contains__):
                    yield [lo], [a], [texts[lo][a:z]]
            else:
                yield list(range(lo, hi)), [0] * (hi - lo), [t or "" for t in texts[lo:hi]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[tuple] = []
            for rows, before, texts in row_pieces(b.column(1).to_pylist()):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                begins = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
                data = np.frombuffer(b"".join(raw), np.uint8)
                found = slice_findings(data, begins)
                if not found:
                    continue
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                for row, k, at, n, bits in found:
                    start = before[row] + int(chars[at] - chars[begins[row]])
                    out.append((ids[rows[row]], classes[k].name, start, n, bits, data[at : at + 4].tobytes().decode("ascii") + "..."))
            out.sort(key=lambda x: (x[0] is None, x[0] or 0, x[2]))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "char_class", "start", "length", "millibits", "preview"])

    d = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, char_class string, start int, length int, millibits int, preview string")
