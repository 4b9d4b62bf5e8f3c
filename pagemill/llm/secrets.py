"""Secret scans: fixed patterns plus sliding-window Shannon entropy over candidate strings.

The patterns find assignments, access keys and long hexadecimal runs. The entropy scan finds what
they miss: each candidate string is read once with a window whose character counts are kept
incrementally, separately for each character class, and stretches whose entropy reaches the class's
threshold become spans unless the allow-list explains them.

Defined results: a null text counts as empty and has no spans; a null ``doc_id`` is carried along;
repeated rows give repeated results; spans with one start go by kind; long texts are scanned whole, in time that grows
with their length; other columns, whatever their names, are left out; an empty table gives an empty table. Memory is one Arrow batch.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base patterns of the contract. ASCII letters only are matched in either case.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings for the entropy scan and, for each class, its alphabet and the entropy in bits that a window must reach.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
CLASSES = {
    "hexadecimal": (frozenset("0123456789abcdefABCDEF"), 3.1),
    "base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"), 3.9),
}
WINDOW = 20

#: Candidates that are random by nature but no secrets.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"[0-9+/_=-]+"),  # digits and punctuation alone: numbers, dates, rules
)
ALLOW_WORDS = re.compile(r"example|sample|dummy|placeholder|changeme|xxxx", re.IGNORECASE)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind index)`` of the three pattern kinds, in code points, end exclusive."""
    spans = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(spans)


#: c log2 c in units of 2^-40, so that sums are exact whatever the order of additions.
_UNIT = 1 << 40
_PLOGP = [round(c * math.log2(c) * _UNIT) if c else 0 for c in range(WINDOW + 2)]


def dense_stretches(chars: str, alphabet: frozenset, bits: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Unions of all windows inside ``alphabet`` whose Shannon entropy is at least ``bits``; ``window`` is ``WINDOW`` at most.

    H = log2(w) - sum(c log2 c) / w. One step of the window changes two counts, so the sum follows
    by two differences of a small table and the whole string costs one pass.
    """
    most = round(window * (math.log2(window) - bits) * _UNIT)  # the sum may be this at most
    counts: dict[str, int] = {}
    total, run, out = 0, 0, []
    for i, ch in enumerate(chars):
        if ch not in alphabet:
            counts, total, run = {}, 0, 0
            continue
        c = counts.get(ch, 0)
        counts[ch] = c + 1  # window + 1 for a moment, if all of the window is this character
        total += _PLOGP[c + 1] - _PLOGP[c]
        run += 1
        if run > window:
            gone = chars[i - window]
            c = counts[gone]
            counts[gone] = c - 1
            total += _PLOGP[c - 1] - _PLOGP[c]
        if run >= window and total <= most:
            start, end = i - window + 1, i + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return out


def free_pieces(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, str]]:
    """``(place, piece)``: candidates without what ``taken`` (by start) covers and without words of the allow-list, in one pass over both."""
    nth, covered = 0, 0
    for m in CANDIDATE.finditer(text):
        if text[max(0, m.start() - 3) : m.start()].endswith("://"):
            continue
        at = m.start()
        while at < m.end():
            while nth < len(taken) and taken[nth][0] <= at:
                covered = max(covered, taken[nth][1])
                nth += 1
            if covered > at:
                at = covered
                continue
            end = min(m.end(), taken[nth][0] if nth < len(taken) else m.end())
            begin = at
            for w in ALLOW_WORDS.finditer(text, at, end):
                yield begin, text[begin : w.start()]
                begin = w.end()
            yield begin, text[begin:end]
            at = end


def entropy_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Dense stretches with a digit, of candidates outside ``taken`` and off the allow-list."""
    spans = []
    for s, word in free_pieces(text, taken):
        if len(word) < WINDOW or not any(ch.isdigit() for ch in word) or any(a.fullmatch(word) for a in ALLOW):
            continue
        merged: list[tuple[int, int]] = []
        for a, b in sorted({x for alphabet, bits in CLASSES.values() for x in dense_stretches(word, alphabet, bits)}):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        spans += [(s + a, s + b, 3) for a, b in merged if any(ch.isdigit() for ch in word[a:b])]
    return spans


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a text by start, then kind."""
    base = base_spans(text or "")
    return sorted(base + entropy_spans(text or "", base), key=lambda x: (x[0], x[2], x[1]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind and ``found``, the spans as structs in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in scan(t.as_py())] for t in batch.column("text")]
            kinds = [[x["kind"] for x in row] for row in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([k.count(name) for k in kinds], pa.int64()) for name in KINDS), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", *(f"n_{name}" for name in KINDS), "found"],
            )

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, found array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, schema)


def sha256_hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
