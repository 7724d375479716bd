"""Pre-token patterns in ``re``, equal to the tokenizer files' own.

``re`` has no ``\\p{L}``, so the classes are built from ``unicodedata``, over the
basic plane, where ``re`` looks a class up in a table. A text with other code
points, or with one that this Python's tables don't assign, is left to the
library (``UNSURE``).
"""

from __future__ import annotations

import re
import unicodedata

#: White space as the tokenizer files' ``\\s`` has it (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _classes() -> dict[str, str]:
    """Bodies of character classes: letters, numbers and unassigned code points."""
    spans: dict[str, list[list[int]]] = {"L": [], "N": [], "Cn": []}
    for point in range(0x10000):
        category = unicodedata.category(chr(point))
        kind = "Cn" if category == "Cn" else category[0]
        if kind in spans:
            found = spans[kind]
            if found and found[-1][1] == point - 1:
                found[-1][1] = point
            else:
                found.append([point, point])
    return {k: "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in v) for k, v in spans.items()}


_CLASS = _classes()
UNSURE = re.compile(f"[{_CLASS['Cn']}\\U00010000-\\U0010ffff]")
_L, _N = _CLASS["L"], _CLASS["N"]

#: Splits a text completely; a space goes with what follows it.
BYTE_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{SPACE}{_L}{_N}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: Finds words, single digits and runs of signs; white space is dropped.
WORD_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{SPACE}{_L}{_N}]+")


def known(text: str) -> bool:
    """Whether the patterns above are sure to agree with the library on this text."""
    return text.isascii() or not UNSURE.search(text)


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves; the others are numbered from
    U+0100 in their order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}
