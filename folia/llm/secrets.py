"""Secret scans: fixed patterns, and Shannon entropy in sliding windows.

Candidates are runs of token characters. A run is cut where its character
class changes for good: the classes are tried from the narrowest (hexadecimal
digits of one case, then letters and digits, then Base64 with URL signs), and a
window slides over the stretches of each class. The window's entropy is kept
as counts: a step adds one character and removes one, and the sum of
n * log2(n) changes by two terms. Windows whose entropy reaches the class's
threshold, and that mix letters with digits, are merged to spans. Candidates on
the allow-list (identifiers that are no secrets) are suppressed. Words of
well-known examples and placeholders suppress only the part between ``/``,
``=``, ``_`` and ``-`` that they stand in, and none of more than 64 characters (the
Base64 alphabet's), which may hold them by chance.

Spans are half-open and count code points.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folia.llm.common import with_kernel

#: The base patterns with what each match must fulfil, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Name, characters, window, least bits a character.
CLASSES = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 24, 3.0),
    ("alnum", re.compile(r"[A-Za-z0-9]+"), 20, 3.9),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 24, 4.1),
)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

#: Parts of candidates, of up to so many characters, that hold one of these words are no secrets.
PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|redacted|xxxx|0123456789|abcdefghij")
PART, PART_LENGTH = re.compile(r"[^/=_-]+"), 64

#: Candidates that match one of these as a whole are no secrets.
ALLOWED = (
    re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    re.compile(r"^[0-9]+(?:[-_/][0-9]+)*$"),
    re.compile(r"^[A-Za-z]+(?:[-_/][A-Za-z]+)*$"),
)

_NLOGN = [n * math.log2(n) if n else 0.0 for n in range(65)]


def entropy_windows(run: str, window: int, least: float) -> list[tuple[int, int]]:
    """Merged stretches of ``run`` that windows of at least ``least`` bits a character cover.

    The entropy of a window of W characters with counts n_c is
    log2(W) - sum(n_c * log2(n_c)) / W. A window must hold a digit and a letter.
    """
    if len(run) < window:
        return []
    counts: dict[str, int] = {}
    mass, digits = 0.0, 0
    most = (math.log2(window) - least) * window + 1e-9
    out: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        mass += _NLOGN[n + 1] - _NLOGN[n]
        counts[c] = n + 1
        digits += c.isdigit()
        if i >= window:
            gone = run[i - window]
            n = counts[gone]
            mass += _NLOGN[n - 1] - _NLOGN[n]
            counts[gone] = n - 1
            digits -= gone.isdigit()
        if i >= window - 1 and mass <= most and 0 < digits < window:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def searched(candidate: str) -> list[tuple[int, str]]:
    """What is left of a candidate without the parts that hold placeholders: pieces with their starts."""
    out, at = [], 0
    if PLACEHOLDER.search(candidate):
        for part in PART.finditer(candidate):
            if len(part[0]) <= PART_LENGTH and PLACEHOLDER.search(part[0]):
                out.append((at, candidate[at : part.start()]))
                at = part.end()
    return [*out, (at, candidate[at:])]


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of high entropy of all classes, overlapping ones merged, by their start."""
    found: list[tuple[int, int]] = []
    for candidate in CANDIDATE.finditer(text):
        if any(rule.search(candidate[0]) for rule in ALLOWED):
            continue
        for at, piece in searched(candidate[0]):
            for _, chars, window, least in CLASSES:
                for run in chars.finditer(piece):
                    base = candidate.start() + at + run.start()
                    found.extend((base + a, base + b) for a, b in entropy_windows(run[0], window, least))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans, by start and then by kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by start and then by kind as listed."""
    if not text:
        return []
    found = base_spans(text) + [("entropy", a, b) for a, b in entropy_spans(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None) -> str | None:
    """A text with each stretch that spans cover replaced by ``[SECRET]``; null stays null."""
    out, at = [], 0
    for _, a, b in sorted(scan(text), key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return text if at == 0 else "".join(out) + text[at:]


_SPANS = T.StructField("secrets", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
_DIGEST = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def secret_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``secrets``, an array of (kind, start, end). Null and empty texts have none; rows stay as they are."""

    def make():
        return lambda texts: [[[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in texts]]

    return with_kernel(docs, make, [text_col], [_SPANS], keep)


def secret_digests(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds counts of the base kinds, a digest of the base spans and all spans as one string.

    ``base_sha256`` is over the base spans only; a text without spans has that
    of the empty string. Null counts as empty. Repeated rows get equal results;
    kept columns with the names of new ones give way; no rows give no rows.
    """

    def make():
        def kernel(texts):
            rows = []
            for t in texts:
                spans = scan(t)
                base = [s for s in spans if s[0] != "entropy"]
                kinds = [k for k, _, _ in base]
                rows.append((*[kinds.count(k) for k in KINDS[:3]], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in _DIGEST]

        return kernel

    return with_kernel(docs, make, [text_col], _DIGEST, keep)


def redacted(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows with secrets in their texts replaced by ``[SECRET]``; columns and their order stay, null and empty texts and repeated rows too."""
    columns = docs.columns if keep is None else keep

    def make():
        return lambda texts: [[redact(t) for t in texts]]

    return with_kernel(docs, make, [text_col], [T.StructField(text_col, T.StringType())], columns).select(*columns)
