"""Secret scans: patterns, and sliding-window Shannon entropy by character class."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, prepare

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Character classes of candidates, narrow before wide: name, characters, least entropy in bits of a window.
CLASSES = (
    ("entropy_hex", frozenset("0123456789abcdefABCDEF"), 3.0),
    ("entropy_base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.6),
)

#: A word of at most 20 letters: in capitals, or of lower-case parts that each begin at most with a capital. One alone has 15 at most,
#: or several parts, because a longer run of letters may be a key.
_WORD = r"(?:[A-Z]{1,20}|[A-Z]?[a-z]{1,20}|[A-Z]?[a-z]{2,15}(?:[A-Z][a-z]{2,15}){1,7})"
_ALONE = _WORD.replace("1,20", "1,15")

#: Candidates that look random and are not secret: UUIDs, dates and numbers, words joined by dashes with a number.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9/_=+-]+",
    rf"[-_/=+]*(?:(?:{_WORD}[-_/=+]+)+{_WORD}|{_ALONE})(?:[-_/=+]+|[-_/]?[0-9]{{0,4}})",
)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the pattern matches, each kind leftmost and without overlaps."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def entropy_runs(s: str, chars: frozenset, width: int, least: float) -> Iterator[tuple[int, int]]:
    """Maximal unions of windows of ``width`` characters of the class whose entropy is at least ``least``.

    Sliding by one changes two counts, so sum(c log c) is corrected, never summed again.
    """
    clog = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    total, counts, run = 0.0, {}, 0
    start = end = -1
    for i, ch in enumerate(s):
        if ch not in chars:
            counts, total, run = {}, 0.0, 0
            continue
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += clog[c + 1] - clog[c]
        run += 1
        if run > width:
            old = s[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += clog[c - 1] - clog[c]
        if run >= width and math.log2(width) - total / width >= least - 1e-9:
            if start >= 0 and i - width + 1 <= end:
                end = i + 1
            else:
                if start >= 0:
                    yield start, end
                start, end = i - width + 1, i + 1
    if start >= 0:
        yield start, end


class Spans:
    """Spans by start, of which one can ask whether any holds another span."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.reach, most = [], [], -1
        for a, b in sorted(spans):
            most = max(most, b)
            self.starts.append(a)
            self.reach.append(most)

    def hold(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        return i > 0 and self.reach[i - 1] >= b


def scan(text: str, width: int = 20, allowed: Iterable[str] = ALLOWED) -> tuple[list, list]:
    """(base spans, all spans); an entropy span inside an allowed candidate or a base span is suppressed."""
    base = base_spans(text)
    rules, more, known = [re.compile(p) for p in allowed], [], None
    for m in _CANDIDATE.finditer(text):
        s = m.group()
        if any(r.fullmatch(s) for r in rules):
            continue
        known = known or Spans((a, b) for a, _, b in base)
        narrow = Spans(())
        for kind, chars, least in CLASSES:
            runs = [(a + m.start(), b + m.start()) for a, b in entropy_runs(s, chars, width, least)]
            own = [(a, kind, b) for a, b in runs if not narrow.hold(a, b) and not known.hold(a, b)]
            more += own
            narrow = Spans((a, b) for a, _, b in own)
    order = (*KINDS, *(k for k, _, _ in CLASSES))
    return base, sorted(base + more, key=lambda s: (s[0], order.index(s[1]), s[2]))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def _scan_batches(batches, width: int, allowed: tuple, keep_text: bool):
    for batch in batches:
        cols = [[], [], [], [], []]
        for text in batch.column("text").to_pylist():
            base, spans = scan(text or "", width, allowed)
            for k, kind in enumerate(KINDS):
                cols[k].append(sum(s[1] == kind for s in base))
            cols[3].append(joined(base))
            cols[4].append(joined(spans))
        names = ["doc_id", "text"] if keep_text else ["doc_id"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], [*names, "n_assign", "n_access", "n_hex", "base_spans", "spans"])


def find_secrets(docs: DataFrame, width: int = 20, allowed: Iterable[str] = ALLOWED, keep_text: bool = False) -> DataFrame:
    """A row for each document: doc_id, (text,) n_assign, n_access, n_hex, base_spans, spans.

    Spans are kind:start:end in code points, end exclusive, by start and kind. A null or empty text
    has none; repeated rows give repeated rows; other columns are ignored; no rows give no rows. Each text is scanned whole in
    one pass, row by row, so nothing is shuffled and a hot key changes nothing.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    allowed = tuple(allowed)
    text = "text string, " if keep_text else ""
    return rows.mapInArrow(lambda it: _scan_batches(it, width, allowed, keep_text), f"doc_id {kind}, {text}n_assign long, n_access long, n_hex long, base_spans string, spans string")


def _redact(text: str | None, spans: str, mask: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted((s.split(":") for s in spans.split(",")), key=lambda s: (int(s[1]), -int(s[2]))):
        a, b = int(a), int(b)
        if b <= at:
            continue
        out += [text[at : max(a, at)], mask if a >= at else ""]
        at = b
    return "".join(out) + text[at:]


def _redact_batches(batches, width: int, allowed: tuple, mask: str):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        clean = [t and _redact(t, joined(scan(t, width, allowed)[1]), mask) for t in texts]
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {"text": pa.array(clean, pa.string())}
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def redact_secrets(docs: DataFrame, width: int = 20, allowed: Iterable[str] = ALLOWED, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by ``mask``; all rows and columns stay, null texts stay null."""
    prepare(docs.sparkSession)
    allowed = tuple(allowed)
    return docs.mapInArrow(lambda it: _redact_batches(it, width, allowed, mask), docs.schema)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """find_secrets() of the whole table documents; the base spans as a digest."""
    found = find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def sha256_hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
