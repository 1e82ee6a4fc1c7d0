"""Secrets in texts: patterns, and windows of high Shannon entropy.

Base spans come from three patterns (an assignment to a name such as password or token, an access key's prefix, long runs of
hexadecimal digits). The method adds spans that no pattern names: candidates are runs of characters that tokens are written
in and that hold both a digit and a letter. For each character class (an alphabet with a window and a threshold) a window
slides over each run of the class within a candidate; its entropy comes from counts of which one rises and one falls at each
step, so a run costs time in proportion to its length. Windows at or above the threshold with both letters and digits are
merged; of overlapping spans of several classes the longest stays. Spans on the allow list go: identifiers and digests that
are no secrets, addresses, embedded media, placeholders, and what the caller names. So do added spans that meet a base span.

Defined results: a null text counts as empty and has no spans; identical rows get identical spans; ties of spans of one length
go to the class listed first; a text of any length is read whole; extra columns are kept by `find`, whatever their names; an
empty table gives an empty table. Positions are code points, the end is exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base patterns, the group that is measured, and its least length.
BASE = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),  # what is shorter fails and ends where its run ends
}


@dataclass(frozen=True)
class Alphabet:
    """A character class: what its runs are made of, the window's length, and the least entropy in bits a character."""

    run: re.Pattern[str]
    window: int
    least: float


#: A window of random characters of a class is above its threshold nearly always, one of names or words isn't.
CLASSES = {
    "entropy_hex": Alphabet(re.compile("[0-9A-Fa-f]+"), 20, 2.9),
    "entropy_alnum": Alphabet(re.compile("[0-9A-Za-z]+"), 24, 3.95),
    "entropy_base64": Alphabet(re.compile("[0-9A-Za-z+/=_-]+"), 24, 4.05),
}
KINDS = (*BASE, *CLASSES)
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")

#: The allow list. What a span's own characters are, and what stands before it on the same line.
ALLOWED = re.compile(
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"  # UUID
    r"|.*(?:example|placeholder|changeme|change_me|dummy|sample|xxxx|your[_-]|0123456789|123456789|abcdefgh)",
    re.I | re.S,
)
#: Names of code: words that begin in capitals, at most one character of twelve a digit.
NAME = re.compile("(?:[A-Z]{0,3}[a-z]++[0-9]{0,2}[_-]?)++")
ALLOWED_BEFORE = re.compile(
    r"(?:\b(?:sha-?(?:1|224|256|384|512)|md5|crc32|digest|checksum|etag|commit|revision|blob|tree|integrity)[\"']?[\x20:=-]{0,3}[\"']?"  # digests
    r"|;base64,"  # embedded media
    r"|(?:://|www\.)[^\s\"'<>]*)$",  # within an address
    re.I,
)
#: Characters before a span that the allow list reads.
BEFORE = 200

SPANS = "array<struct<start:int,end:int,kind:string,base:boolean,entropy:double>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("entropy", pa.float64())]))


def windows(run: str, width: int, least: float) -> Iterator[tuple[int, int, float]]:
    """Merged windows of ``width`` characters with an entropy of ``least`` or more and both letters and digits: start, end, highest entropy.

    The sum of c * log2(c) over the counts c is kept from window to window: one count rises, one falls.
    """
    if len(run) < width:
        return
    weigh = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    most, counts, total, digits, letters = math.log2(width), {}, 0.0, 0, 0
    start = end = -1
    best = 0.0
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += weigh[n + 1] - weigh[n]
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= width:
            out = run[i - width]
            n = counts[out]
            counts[out] = n - 1
            total += weigh[n - 1] - weigh[n]
            digits -= out.isdigit()
            letters -= out.isalpha()
        if i < width - 1:
            continue
        entropy = most - total / width
        if entropy < least or not digits or not letters:
            continue
        first = i - width + 1
        if first > end:
            if end > 0:
                yield start, end, best
            start, best = first, 0.0
        end, best = i + 1, max(best, entropy)
    if end > 0:
        yield start, end, best


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and kind as listed."""
    found = [(m.start(), m.end(), kind) for kind, (pattern, group, least) in BASE.items() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def allowed(text: str, start: int, end: int, allow: re.Pattern[str] | None) -> bool:
    """Whether a span is on the allow list."""
    word = text[start:end]
    name = NAME.fullmatch(word) and 12 * len(DIGIT.findall(word)) <= len(word)
    return bool(ALLOWED.match(word) or name or ALLOWED_BEFORE.search(text, max(0, start - BEFORE), start) or (allow and allow.fullmatch(word)))


def added_spans(text: str, taken: list[tuple[int, int, str]], allow: re.Pattern[str] | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, entropy) of windows of high entropy that meet none of the spans taken; by start."""
    out: list[tuple[int, int, str, float]] = []
    ends = sorted((s, e) for s, e, _ in taken)
    k, reach = 0, 0
    for c in CANDIDATE.finditer(text):
        word = c.group()
        if not DIGIT.search(word) or not LETTER.search(word):
            continue
        if allowed(text, c.start(), c.end(), allow):
            continue
        found = [
            (c.start() + r.start() + a, c.start() + r.start() + b, kind, bits)
            for kind, of in CLASSES.items()
            for r in of.run.finditer(word)
            for a, b, bits in windows(r.group(), of.window, of.least)
        ]
        if not found:
            continue
        # the longest of each chain of overlapping spans; a candidate has few
        found.sort(key=lambda s: (s[0] - s[1], KINDS.index(s[2]), s[0]))
        own: list[tuple[int, int, str, float]] = []
        for s in found:
            if all(s[1] <= o[0] or o[1] <= s[0] for o in own):
                own.append(s)
        for s in sorted(own):
            while k < len(ends) and ends[k][0] < s[1]:
                reach = max(reach, ends[k][1])
                k += 1
            if reach <= s[0] and not allowed(text, s[0], s[1], allow):
                out.append(s)
    return out


def spans_of(text: str | None, allow: re.Pattern[str] | None = None) -> list[dict]:
    """All spans of a text by start, then kind as listed."""
    if not text:
        return []
    base = base_spans(text)
    found = [(s, e, kind, True, None) for s, e, kind in base] + [(s, e, kind, False, bits) for s, e, kind, bits in added_spans(text, base, allow)]
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return [dict(zip(("start", "end", "kind", "base", "entropy"), s)) for s in found]


def spans(text: Column, allow: str | None = None) -> Column:
    """Spans of a text column; ``allow`` is a pattern of whole spans that are no secrets."""
    known = re.compile(allow) if allow else None

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array((spans_of(t.as_py(), known) for t in texts), SPAN_TYPE, size=len(texts))

    return found(text)


def find(docs: DataFrame, carry: list[Column] | None = None, allow: str | None = None) -> DataFrame:
    """Every row of ``docs``: its columns (or those in ``carry``) in a struct ``row``, and ``spans``, an array of (start, end,
    kind, base, entropy) by start and kind."""
    own = carry or [docs[f"`{c}`"] for c in docs.columns]
    return docs.select(F.struct(*own).alias("row"), spans(docs["text"], allow).alias("spans"))


def redact(docs: DataFrame, by: str = "[secret]", allow: str | None = None) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``by``; overlapping spans become one. Null texts stay null."""
    known = re.compile(allow) if allow else None

    def cleaned(text: str | None) -> str | None:
        if not text:
            return text
        parts, at = [], 0
        for s in spans_of(text, known):
            if s["start"] >= at:
                parts += [text[at : s["start"]], by]
            at = max(at, s["end"])
        return "".join([*parts, text[at:]])

    @F.arrow_udf("string")
    def column(texts: pa.Array) -> pa.Array:
        return pa.array((cleaned(t.as_py()) for t in texts), pa.string(), size=len(texts))

    return docs.withColumn("text", column(docs["text"]))
