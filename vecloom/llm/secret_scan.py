"""Secret scan with multipart credential linking.

Base findings are three patterns that stand alone. On top of them, weaker parts (identifiers, short secrets,
endpoints) are candidates only; an interval join inside one scope of the text links a candidate with
complementary parts near it, and only linked candidates are reported.

Scopes are the blocks between blank lines. Each part's interval is widened by `window` code points on both
sides and cut at its scope's borders; two parts are linked when one's interval overlaps the other's widened one.
  identifier <-> secret    access keys of the base count as identifiers, its assign and hex findings as secrets
  endpoint   <-> secret    only with a secret that was assigned by name
Parts whose spans overlap are one thing seen twice (a hex value of an identifier, a token in a URL) and are not linked.
The join counts overlaps from sorted starts and sorted ends, so a text with n parts costs n log n, however
many of them meet; no pairs are formed.

Defined cases: a null text is empty and has no finding; very long texts are scanned whole; of findings that start at one
place, the kind listed first comes first; repeated rows each get their own result; an empty table gives an empty result;
other columns of the input may have any names, they are kept by redact() and ignored by scan().
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vecloom.llm.common import at, texts

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

#: Weak parts: they count only when linked.
WEAK_IDENT = re.compile(r"""\b(?:(?:access|client|account|user|app)[_\- ]?(?:key[_\- ]?)?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{4,})""", re.I | re.A)
WEAK_SECRET = re.compile(r"""\b(?:pwd|pass|private[_-]?key|credential|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", re.I | re.A)
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+]{1,15}://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?""", re.I | re.A)
WEAK_SECRET_LEAST, WEAK_ACCESS_LEAST = 6, 10
BLANK = re.compile(r"\n[ \t\r]*\n")

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
WINDOW = 200

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base findings, and those matches that are only too short."""
    found: list[Span] = []
    short: list[Span] = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            (found if m.end(2) - m.start(2) >= ASSIGN_LEAST else short).append((m.start(), 0, m.end()))
            if short and short[-1][0] == m.start() and m.end(2) - m.start(2) < WEAK_SECRET_LEAST:
                short.pop()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                found.append((m.start(), 1, m.end()))
            elif m.end() - m.start() >= WEAK_ACCESS_LEAST:
                short.append((m.start(), 1, m.end()))
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found, short


class _Overlaps:
    """How many of these intervals overlap [a, b): those that begin before b less those that end by a."""

    def __init__(self, spans: Iterable[Span]):
        spans = list(spans)
        self.starts, self.ends = sorted(s[0] for s in spans), sorted(s[2] for s in spans)

    def count(self, a: int, b: int) -> int:
        return bisect_left(self.starts, b) - bisect_right(self.ends, a)


def linked_spans(text: str, base: list[Span], short: list[Span], window: int = WINDOW) -> tuple[list[Span], int]:
    """The weak parts that have a complementary part within the window and scope; and the number of links."""
    weak = [(s, 4, e) for s, k, e in short if k == 0] + [(s, 3, e) for s, k, e in short if k == 1]
    if "=" in text or ":" in text:
        weak += [(m.start(), 3, m.end()) for m in WEAK_IDENT.finditer(text)]
        weak += [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text)]
        weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    if not weak:
        return [], 0
    covered = _Overlaps(s for s in base if s[1] != 2)
    weak = sorted({s for s in weak if not covered.count(s[0], s[2])})
    idents = _Overlaps([s for s in base if s[1] == 1] + [s for s in weak if s[1] == 3])
    named = [s for s in base if s[1] == 0] + [s for s in weak if s[1] == 4]
    assigned, secrets = _Overlaps(named), _Overlaps(named + [s for s in base if s[1] == 2])
    ends = _Overlaps(s for s in weak if s[1] == 5)
    cuts = [m.start() for m in BLANK.finditer(text)]
    found, links = [], 0
    for s, kind, e in weak:
        i = bisect_right(cuts, s)
        low = max(s - window, cuts[i - 1] if i else 0)
        j = bisect_left(cuts, e)
        high = min(e + window, cuts[j] if j < len(cuts) else len(text))
        n = sum(x.count(low, high) - x.count(s, e) for x in ((secrets,) if kind == 3 else (assigned,) if kind == 5 else (idents, ends)))
        if n:
            found.append((s, kind, e))
            links += n
    return found, links


def scan_text(text: str, window: int = WINDOW) -> tuple[list[Span], list[Span], int]:
    """Base findings, linked weak parts, number of links; findings ordered by start, then kind."""
    base, short = base_spans(text)
    more, links = linked_spans(text, base, short, window)
    return sorted(base), sorted(more), links


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document: counts and digest of the base findings, and all spans (code points, end exclusive)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches, "t"):
            rows = [scan_text(x, window) for x in values]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("i"),
                    *(pa.array([sum(s[1] == k for s in base) for base, _, _ in rows], pa.int64()) for k in range(3)),
                    pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _, _ in rows]),
                    pa.array([written(sorted(base + more)) for base, more, _ in rows]),
                    pa.array([len(more) for _, more, _ in rows], pa.int64()),
                    pa.array([n for _, _, n in rows], pa.int64()),
                ],
                ["i", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked", "n_links"],
            )

    out = docs.select(at(id_col).alias("i"), at(text_col).cast("string").alias("t")).mapInArrow(kernel, f"i {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long, n_links long")
    return out.withColumnRenamed("i", id_col)


def mask(text: str, window: int = WINDOW) -> str:
    """The text with each run of overlapping findings replaced by the first one's kind."""
    base, more, _ = scan_text(text, window)
    out, end = [], 0
    for s, k, e in sorted(base + more):
        if s >= end:
            out += [text[end:s], f"[{KINDS[k]} removed]"]
        end = max(end, e)
    return "".join([*out, text[end:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The input with its findings masked; every row and column stays, null texts stay null."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in texts(batches, text_col):
            there = part.column(text_col).is_valid().to_pylist()
            i = part.schema.get_field_index(text_col)
            yield part.set_column(i, part.schema.field(i), pa.array([mask(x, window) if ok else None for x, ok in zip(values, there, strict=True)], part.schema.field(i).type))

    return docs.mapInArrow(kernel, docs.schema)
