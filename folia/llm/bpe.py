"""BPE through a deterministic tokenization automaton.

The automaton reads tokens, and accepts a sequence of tokens exactly if the
merges would produce it. It is compiled merge by merge. At first there is one
state, with an arc for each base symbol back to it. The gadget of a merge
(u, v) -> w does three things to the automaton so far:

* w gets an arc from every state that has an arc for u, provided that v can
  follow u; it leads where v leads;
* u's arcs are turned to a copy of their target that has no arc for v, since
  "u v" is now written w;
* all other arcs stay.

All arcs of one token share their target, so a token names a state. States
differ from the one they were copied from by a single missing arc, and arcs
of w mirror those of u until the gadget; that is how both are stored. Whether
a state has an arc is answered from that store once and then read from a
transition table.

To encode a pre-split word is to find the accepted path whose labels spell it.
There is exactly one, and for each beginning of the word at most one accepted
path spells it, so a search that takes the longest label first and marks the
positions that failed visits each position once. To decode is to emit the
labels of the arcs.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import operator
import os
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folia.llm.common import HELD, with_kernel
from folia.llm.pretokens import WORD_LEVEL, byte_alphabet, known

_NEVER = 1 << 60
_FIRST, _SECOND = operator.itemgetter(0), operator.itemgetter(1)


class TokenAutomaton:
    """The compiled merges of one vocabulary; ``suffix`` marks the last symbol of a word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "", table_entries: int = 150_000):
        self.suffix = suffix
        self.label = {i: s for s, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}  # the missing arc that the gadget of this merge made
        self.made: dict[int, tuple[int, int, int]] = {}  # token: left part, right part, merge
        self._table: dict[int, dict[int, bool]] = {}
        self._filled = 0
        self._table_entries = table_entries
        dead = set()
        for k, (left, right) in enumerate(merges):
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            if w in self.made:
                raise ValueError(f"two merges make {left + right!r}")
            if u in dead or v in dead or not self._arc(u, v):
                dead.add(w)  # never produced: v can't follow u by now
                self.made[w] = (u, v, k)
                continue
            self.made[w] = (u, v, k)
            self.rank[u, v] = k
        self.arcs = {s: i for s, i in vocab.items() if i not in dead}
        #: The labels without end marks, and for four characters the lengths, longest first, of the labels of four or more that begin so.
        self._bodies = {s.removesuffix(suffix) if suffix else s for s in self.arcs}
        begun: dict[str, set[int]] = {}
        for s in self._bodies:
            if len(s) >= 4:
                begun.setdefault(s[:4], set()).add(len(s))
        self._begun = {k: tuple(sorted(v, reverse=True)) for k, v in begun.items()}
        self._lengths: dict[str, tuple[int, ...]] = {}

    def _arc(self, state: int, token: int) -> bool:
        """Whether the state that ``state``'s arcs lead to has an arc for ``token``.

        The state's missing arcs: its own, and what its right part's state
        lacked when it was made. ``token``'s arcs mirror its left part's as they
        were when it was made. A merge of a symbol with itself takes its new
        token's arc from the copied state too: of three in a row it takes the
        first two.
        """
        rank, made = self.rank, self.made
        q, before = state, _NEVER
        while True:
            t, until = token, _NEVER
            while True:
                k = rank.get((q, t))
                if k is not None and k < before and k <= until:
                    return False
                if t not in made:
                    break
                t, _, k = made[t]
                until = min(until, k)
            if q not in made:
                return True
            _, q, k = made[q]
            before = min(before, k)

    def follows(self, state: int, token: int) -> bool:
        """The transition table's entry."""
        row = self._table.setdefault(state, {})
        got = row.get(token)
        if got is None:
            if self._filled >= self._table_entries:
                self._table.clear()
                self._filled, row = 0, self._table.setdefault(state, {})
            got = row[token] = self._arc(state, token)
            self._filled += 1
        return got

    def lengths(self, ahead: str) -> tuple[int, ...]:
        """The lengths, longest first, of the labels that may stand before ``ahead``, a word's next four characters."""
        got = self._lengths.get(ahead)
        if got is None:
            if len(self._lengths) >= self._table_entries:
                self._lengths.clear()
            got = self._lengths[ahead] = self._begun.get(ahead, ()) + tuple(n for n in (3, 2, 1) if n <= len(ahead) and ahead[:n] in self._bodies)
        return got

    def encode(self, word: str) -> list[int]:
        """The ids of a word given in the vocabulary's own characters, without its end mark."""
        n, arcs, table, known = len(word), self.arcs, self._table, self._lengths
        path: list[int] = []
        before: list[tuple] = []  # for each label of the path its start and the lengths that weren't tried
        failed = bytearray(n + 1)
        at, last, row = 0, -1, {}
        left = iter(known.get(word[:4]) or self.lengths(word[:4]))
        while at < n:
            token = None
            for size in left:
                stop = at + size
                if stop > n or failed[stop]:
                    continue
                token = arcs.get(word[at:stop] if stop < n else word[at:] + self.suffix)
                if token is not None:
                    if last < 0:
                        break
                    may = row.get(token)
                    if may or may is None and self.follows(last, token):
                        break
                    token = None
            if token is not None:
                path.append(token)
                before.append((at, left))
                at, last = stop, token
                row = table.get(last, {})
                if at < n:
                    ahead = word[at : at + 4]
                    left = iter(known.get(ahead) or self.lengths(ahead))
            else:
                failed[at] = 1
                if not path:
                    raise ValueError(f"no path for {word!r}")
                path.pop()
                at, left = before.pop()
                last = path[-1] if path else -1
                row = table.get(last, {})
        return path


class WordTokenizer:
    """A tokenizer file of the kind "BPE over byte-level words, lower case, white space dropped".

    Raises ``ValueError`` for a file with other settings.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [s["type"] for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"] or spec.get("decoder") is not None:
            raise ValueError(f"{path}: not a word-level BPE file")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.path = path
        self.automaton = TokenAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._letters = byte_alphabet()
        self._library = None
        self.labels = self.automaton.label | {i: s for s, i in self.special.items()}

    def word(self, word: str) -> list[int]:
        """The ids of one pre-split word."""
        letters = self._letters
        return self.automaton.encode("".join([letters[b] for b in word.encode("utf-8")]))

    def words(self, text: str) -> list[str | int]:
        """A text's words in order; special strings appear as their ids."""
        if self._split is None or not self._split.search(text):
            return self._plain(text)
        out: list[str | int] = []
        for part in self._split.split(text):
            out.extend([self.special[part]] if part in self.special else self._plain(part))
        return out

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if not known(text) or "Σ" in text or "İ" in text:  # capitals whose lower case depends on the place or the tables
                return self._by_library(text)
            text = unicodedata.normalize("NFC", text)
        return WORD_LEVEL.findall(text.lower())

    def _by_library(self, text: str) -> list[str]:
        """The library's own normalizer and splitter, for texts outside this Python's tables."""
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            with open(self.path, encoding="utf-8") as f:
                spec = json.load(f)
            # normalizer and splitter are all that is wanted of it
            self._library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        back = {c: b for b, c in self._letters.items()}
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(back[c] for c in p).decode("utf-8") for p, _ in pieces]

    def decode(self, ids: list[int]) -> str:
        """The labels of the path, special strings included."""
        return " ".join([self.labels[i] for i in ids])


#: Words of a text that are looked up at a time.
_SOME_WORDS = 20_000


class _Encoded:
    """What a worker keeps for a file: the tokenizer and two generations of encoded words, about ``cache_bytes`` each.

    An entry is a word's ids, and with ``digests`` (ids, labels), both joined
    by spaces.
    """

    def __init__(self, path: str, digests: bool):
        self.tokenizer = WordTokenizer(path)
        self.entries(digests)

    def entries(self, digests: bool) -> None:
        """Sets what entries hold; others than before drop those there are."""
        if getattr(self, "digests", None) != digests:
            self.digests, self.young, self.old, self.size = digests, {}, {}, 0

    def _entry(self, word: str | int):
        ids = [word] if isinstance(word, int) else self.tokenizer.word(word)
        return (" ".join(map(str, ids)), self.tokenizer.decode(ids)) if self.digests else tuple(ids)

    def look_up(self, words: list[str | int], cache_bytes: int) -> list:
        """The entries of some words, in order."""
        if self.size >= cache_bytes:  # the young generation becomes the old one
            self.young, self.old, self.size = {}, self.young, 0
        for word in set(words).difference(self.young):
            got = self.old.get(word)
            if got is None:
                got = self._entry(word)
            self.young[word] = got
            length = len(word) if isinstance(word, str) else 0
            self.size += 350 + 4 * length if self.digests else 250 + 4 * length
        return list(map(self.young.__getitem__, words))


#: Of this worker process, by path.
_WORKER: dict[str, _Encoded] = {}
HELD[__name__] = _WORKER


def _worker(path: str, digests: bool) -> _Encoded:
    if path not in _WORKER:
        _WORKER[path] = _Encoded(path, digests)
    _WORKER[path].entries(digests)
    return _WORKER[path]


_OUT = [
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("decoded", T.StringType()),
]
_DIGEST = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def bpe_encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None, digests: bool = False, decode: bool = True, cache_bytes: int = 40_000_000) -> DataFrame:
    """Adds ``ids`` (array of int) and ``decoded`` (text; not without ``decode``), or with ``digests`` their number and SHA-256 values.

    Equal to the library's encoding without added special tokens and its
    decoding with special tokens kept. Null counts as the empty text: no ids,
    empty decoded text. ``ids_sha256`` is over the decimal ids joined by one
    space. Rows stay as they are, repeated ones too; no rows give no rows; a
    column with an output's name gives way. Workers keep words that they have
    encoded, up to about twice ``cache_bytes``.
    """

    def make():
        encoded = _worker(tokenizer_path, digests)

        def entries(text: str | None) -> list:
            words = encoded.tokenizer.words(text) if text else []
            return [e for at in range(0, len(words), _SOME_WORDS) for e in encoded.look_up(words[at : at + _SOME_WORDS], cache_bytes)]

        def kernel(texts):
            columns: list[list] = [[], [], []]
            for text in texts:
                got = entries(text)
                if digests:
                    joined = " ".join(map(_FIRST, got))
                    columns[0].append(joined.count(" ") + 1 if got else 0)
                    columns[1].append(hashlib.sha256(joined.encode()).hexdigest())
                    columns[2].append(hashlib.sha256(" ".join(map(_SECOND, got)).encode("utf-8")).hexdigest())
                else:
                    columns[0].append(np.fromiter(itertools.chain.from_iterable(got), dtype=np.int32))
                    if decode:  # from the ids, so that workers keep no labels of words
                        columns[1].append(encoded.tokenizer.decode(columns[0][-1].tolist()))
            return columns if digests else columns[:2] if decode else columns[:1]

        return kernel

    return with_kernel(docs, make, [text_col], _DIGEST if digests else _OUT if decode else _OUT[:1], keep)


def bpe_decode(docs: DataFrame, tokenizer_path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``decoded``: the labels of an array of ids. A null array, or an id outside the vocabulary, gives null."""

    def make():
        labels = _worker(tokenizer_path, False).tokenizer.labels

        def kernel(rows):
            return [[" ".join([labels[i] for i in ids]) if ids is not None and all(i in labels for i in ids) else None for ids in rows]]

        return kernel

    return with_kernel(docs, make, [ids_col], _OUT[1:], keep)
