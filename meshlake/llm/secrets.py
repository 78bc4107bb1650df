"""Secret scan: known shapes, and windows of high entropy in candidate strings.

Candidates are stretches without blanks of the characters of a class (``CLASSES``), of at
least a window.  Over each a window of fixed length slides; the counts of its
characters, and with them the sum of c log2 c, change by the one that enters and the
one that leaves, and its Shannon entropy is log2(window) less that sum over the window.
Windows that reach the class' bound are joined where they touch and become a finding.

Suppressed are findings in a stretch that the allow list knows (``ALLOWED``: addresses,
counting sequences, placeholders, labelled checksums), in stretches without digits
(long words of any language), and findings that lie within one of a known shape.  The known
shapes (``password=...`` and the like, access keys, long hexadecimal numbers) are never suppressed.

Cases: a null text counts as empty and has no finding; places are code points, ends
exclusive; very long texts are scanned whole, in memory of a few times their size; rows that
repeat are scanned each; an empty table gives no rows; further columns play no part
(``redact`` passes them through).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The known shapes and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGNED, ACCESS_LENGTH = 6, 20
#: Texts without one of these have no assignment.
NAMES = ("password", "passwd", "secret", "token", "key")


@dataclass(frozen=True)
class Kind:
    """A class of characters with its window in characters and the entropy in bits that is suspicious."""

    name: str
    pattern: str
    window: int
    bits: float


#: A random window of 24 characters has 3.3 bits of 16 symbols and 4.3 of 64, on average.
CLASSES = (
    Kind("entropy_hex", r"[0-9A-Fa-f]{24,}", 24, 3.0),
    Kind("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 4.0),
)

#: Whole stretches between blanks and quotes that hold no secret.
ALLOWED = (
    r"(?i)https?://[^\s?#@]*",
    r"(?i)[\w.+-]+@[\w.-]+",
    r"(?i)(?:sha(?:1|224|256|384|512)|md5|crc32)[-:=][0-9A-Za-z+/=]+",
    r"(?i).*(?:example|sample|placeholder|dummy|changeme).*",
    r"(?i).*(?:abcdefghij|0123456789|9876543210).*",
    r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}",
)
_BLANKS = re.compile(r"[\s\"'`<>()\[\]{},;]")
_DIGIT = re.compile("[0-9]")


class Cover:
    """Whether one of some spans holds another span."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        spans = sorted(spans)
        self.starts = [a for a, _, _ in spans]
        self.ends = list(accumulate((b for _, b, _ in spans), max))

    def holds(self, start: int, end: int) -> bool:
        n = bisect_right(self.starts, start)
        return n > 0 and self.ends[n - 1] >= end


class Stretches:
    """The stretches of a text between blanks, and whether the allow list knows them."""

    def __init__(self, text: str, allowed: list[re.Pattern]):
        self.text, self.allowed = text, allowed
        self.blanks = [m.start() for m in _BLANKS.finditer(text)]
        self.verdicts: dict[int, bool] = {}

    def at(self, start: int, end: int) -> bool:
        """Of the stretch around a place that has no blank inside."""
        n = bisect_right(self.blanks, start)
        if n not in self.verdicts:
            first = self.blanks[n - 1] + 1 if n else 0
            whole = self.text[first : self.blanks[n] if n < len(self.blanks) else len(self.text)]
            self.verdicts[n] = any(p.fullmatch(whole) for p in self.allowed)
        return self.verdicts[n]


class Scanner:
    """Finds spans (start, end, kind) in texts."""

    def __init__(self, classes: tuple[Kind, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED):
        self.classes = [(k, re.compile(k.pattern)) for k in classes]
        self.allowed = [re.compile(p) for p in allowed]
        self.order = {k: n for n, k in enumerate(["assign", "access", "hex", *[k.name for k in classes]])}

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """The known shapes, by start and then kind."""
        low = text.lower()
        found = []
        if any(name in low for name in NAMES):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGNED]
        if "AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        return sorted(found, key=self._key)

    def _key(self, span: tuple[int, int, str]) -> tuple[int, int, int]:
        return span[0], self.order[span[2]], span[1]

    def entropic(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """What windows of high entropy add to the spans of known shapes."""
        found: list[tuple[int, int, str]] = []
        allowed = None
        for kind, pattern in self.classes:
            known = Cover(base + found)
            for m in pattern.finditer(text):
                for start, end in hot_windows(m.group(), kind.window, kind.bits):
                    start, end = start + m.start(), end + m.start()
                    if known.holds(start, end) or not _DIGIT.search(text, start, end):
                        continue
                    allowed = allowed or Stretches(text, self.allowed)
                    if not allowed.at(start, end):
                        found.append((start, end, kind.name))
        return found

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Those of known shapes, and all, each by start and then kind."""
        base = self.base(text)
        return base, sorted(base + self.entropic(text, base), key=self._key)


def hot_windows(candidate: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Maximal stretches of a candidate that windows of at least ``bits`` of entropy cover."""
    n = len(candidate)
    if n < window:
        return []
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = (math.log2(window) - bits) * window + 1e-9  # the largest sum of c log2 c that is suspicious
    counts: dict[str, int] = {}
    total = 0.0
    for c in candidate[:window]:
        now = counts.get(c, 0)
        total += weight[now + 1] - weight[now]
        counts[c] = now + 1
    out: list[tuple[int, int]] = []
    for start in range(n - window + 1):
        if start:
            gone, come = candidate[start - 1], candidate[start + window - 1]
            if gone != come:
                now = counts[gone]
                total += weight[now - 1] - weight[now]
                counts[gone] = now - 1
                now = counts.get(come, 0)
                total += weight[now + 1] - weight[now]
                counts[come] = now + 1
        if total <= most:
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], start + window)
            else:
                out.append((start, start + window))
    return out


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, kind, start, end (code points) and the text of every finding."""
    own = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                text = text.as_py() or ""
                rows += [(doc.as_py(), kind, a, b, text[a:b]) for a, b, kind in own.spans(text)[1]]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "kind", "start", "end", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, kind string, start long, end long, found string")


def redact(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """The rows with every finding replaced by its kind in brackets; overlapping ones by the first."""
    own = scanner or Scanner()

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        parts, at = [], 0
        for start, end, kind in own.spans(text)[1]:
            if start >= at:
                parts += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        return "".join(parts) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t.as_py()) for t in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), texts], ["doc", "text"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text"))
    out = packed.mapInArrow(run, f"doc {packed.schema['doc'].dataType.simpleString()}, text string")
    return out.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def report(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the known shapes' spans) and spans (all) of every row."""
    own = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[list[int], ...] = ([], [], [])
            sha, told = [], []
            for text in batch.column("text"):
                base, every = own.spans(text.as_py() or "")
                for kind, column in zip(("assign", "access", "hex"), counts):
                    column.append(sum(k == kind for _, _, k in base))
                sha.append(hashlib.sha256(_told(base).encode()).hexdigest())
                told.append(_told(every))
            columns = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(told, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
