"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ``order`` bytes is grown
from labelled texts and then frozen. A byte's code length is that of PPM with
method C escapes and exclusion: in the longest context that the tree knows, a
byte seen n times of N, among D different ones, has probability n / (N + D);
the escape, D / (N + D), hands over to the next shorter context, where the
bytes that the longer one knew are excluded. Below the empty context all 256
bytes are alike. A text's code length under a language is the exact sum; the
shortest names the language.

Since the statistics are frozen, a context's whole distribution is a constant.
The trees of all languages are laid over each other: one state for each
context that any of them knows, with the code lengths of all 256 bytes under
every language, so that a text is scored by table lookups over arrays.

Training is on a bounded sample: of each language at most ``train_docs`` texts
of at most ``train_bytes`` bytes in sum (see :func:`sample`). Contexts seen
fewer than ``min_count`` times in a language are left out of its tree. In a
worker the model takes some 12 MB for each language.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folia.llm.common import HELD, local_table, unused, with_kernel

UNDETERMINED = "und"

#: Stands before a text's first byte, as contexts see it.
_START = 0x20

_OUT = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("bits_per_byte", T.DoubleType()),
]
#: The columns that :func:`language_id` adds.
OUTPUTS = ("lang_pred", "score", "bits_per_byte", "held_out")
_ASCII_LETTER = re.compile("[A-Za-z]")
_DIGIT = re.compile(r"\d")


def has_letter(text: str) -> bool:
    """Whether some character is a letter by its Unicode category; numerals such as \u2167 or \u00bd are none."""
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text))


#: For n = 0, 1, ...: runs of n + 1 bytes as numbers, sorted, and how often each stood in the texts.
Tree = list[tuple[np.ndarray, np.ndarray]]


def context_counts(texts: list[str], order: int, min_count: int) -> Tree:
    """The context tree of some texts: contexts of up to ``order`` bytes with what followed them, as arrays."""
    data = [bytes([_START]) * order + t.encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= order
    tree: Tree = []
    packed = flat.copy()
    for n in range(order + 1):
        if n:
            packed[n:] |= flat[:-n] << (8 * n) if len(flat) > n else 0
        keys, times = np.unique(packed[inside], return_counts=True)
        if n:
            contexts, at = np.unique(keys >> 8, return_inverse=True)
            often = np.bincount(at, weights=times, minlength=len(contexts))[at] >= min_count
            keys, times = keys[often], times[often]
        tree.append((keys, times.astype(np.int32)))
    return tree


def _escaped(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probabilities after contexts (rows): counted bytes, and the escape's share of the shorter context for the others."""
    known = counts > 0
    kinds = known.sum(axis=1, keepdims=True)
    total = counts.sum(axis=1, keepdims=True) + np.where(kinds < 256, kinds, 0)
    rest = np.where(known, 0.0, below)
    left = rest.sum(axis=1, keepdims=True)
    p = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
    p += np.divide(kinds * rest, total * left, out=np.zeros_like(counts), where=(total > 0) & (left > 0))
    return np.where(total > 0, p, below)


class Model:
    """Frozen trees of some languages as tables: ``state`` of the last three bytes' numbers, ``bits`` by state, byte and language."""

    def __init__(self, trees: dict[str, Tree], order: int = 3):
        if not 0 <= order <= 3:
            raise ValueError("order must lie between 0 and 3")
        self.languages, self.order = sorted(trees), order
        contexts = [np.zeros(1, dtype=np.int64)] + [np.unique(np.concatenate([trees[name][n][0] >> 8 for name in self.languages])) for n in range(1, order + 1)]
        first = np.cumsum([0, *map(len, contexts)])
        self.bits = np.empty((first[-1], 256, len(self.languages)), dtype=np.float32)
        for i, name in enumerate(self.languages):
            p = np.empty((first[-1], 256), dtype=np.float32)
            for n, (own, (keys, times)) in enumerate(zip(contexts, trees[name], strict=True)):
                rows = np.searchsorted(own, keys >> 8)
                shorter = first[n - 1] + np.searchsorted(contexts[n - 1], own & ((1 << (8 * (n - 1))) - 1)) if n else None
                for at in range(0, len(own), 2048):
                    end = min(len(own), at + 2048)
                    lo, hi = np.searchsorted(rows, [at, end])
                    counts = np.zeros((end - at, 256))
                    counts[rows[lo:hi] - at, keys[lo:hi] & 255] = times[lo:hi]
                    below = p[shorter[at:end]].astype(np.float64) if n else np.full((1, 256), 1 / 256)
                    p[first[n] + at : first[n] + end] = _escaped(counts, below)
            self.bits[:, :, i] = -np.log2(p)
        # bytes of contexts are numbered from 1, all others are 0; the state after bytes a, b, c is that of the longest known suffix
        seen = sorted({b for n, own in enumerate(contexts) for j in range(n) for b in np.unique(own >> (8 * j) & 255).tolist()})
        self.number = np.zeros(256, dtype=np.int32)
        self.number[seen] = np.arange(1, len(seen) + 1)
        self.kinds = len(seen) + 1
        self.state = np.zeros(self.kinds**3, dtype=np.uint16 if first[-1] < 1 << 16 else np.int32)
        for n, own in enumerate(contexts[1:], 1):
            place = sum(self.number[own >> (8 * j) & 255].astype(np.int64) * self.kinds**j for j in range(n))
            self.state.reshape(-1, self.kinds**n)[:, place] = np.arange(first[n], first[n + 1])
        self.bits = self.bits.reshape(-1, len(self.languages))

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of a text under each language."""
        total = np.zeros(len(self.languages))
        padded = np.frombuffer(bytes([_START]) * 3 + data, dtype=np.uint8)
        for at in range(0, len(data), 1 << 18):
            part = padded[at : at + (1 << 18) + 3]
            kind = self.number[part]
            state = self.state[(kind[:-3] * self.kinds + kind[1:-2]) * self.kinds + kind[2:-1]].astype(np.int32)
            total += self.bits[state * 256 + part[3:]].sum(axis=0, dtype=np.float64)
        return total


class Models:
    """Models of a few languages each, side by side, so that tables grow in proportion to the languages."""

    def __init__(self, trees: dict[str, Tree], order: int = 3, together: int = 4):
        self.languages = sorted(trees)
        self.parts = [Model({name: trees[name] for name in self.languages[i : i + together]}, order) for i in range(0, len(trees), together)]

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of a text under each language."""
        return np.concatenate([m.code_lengths(data) for m in self.parts])


def sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 400, train_bytes: int = 1_000_000, all_bytes: int = 64_000_000) -> dict[str, list[str]]:
    """The training texts of the languages in ``labelled``; rows with a null text or language are passed over.

    Of each language the texts with the smallest hashes of their ids, one to an
    id (of different texts of one id the shortest): at most ``train_docs``
    texts of at most ``train_bytes`` bytes in sum, none longer than an eighth of
    that; with so many languages that they would have more than ``all_bytes``
    together, each has its share of those. A language without a text that fits
    is learned from its shortest one. Only these texts come to the driver.

    Rows are drawn by a threshold on the hash that lets through a few times
    the sample for each language, so what is dealt out by language is bounded.
    """
    draw = F.xxhash64(F.col(id_col).cast("string"), F.lit(5))
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.col(text_col).alias("text"))
    often = {lang: n for lang, n in rows.groupBy("lang").agg(F.approx_count_distinct("draw")).collect()}
    if not often:
        return {}
    train_bytes = min(train_bytes, all_bytes // len(often))
    share = {lang: min(1.0, 4 * train_docs / max(1, n)) for lang, n in often.items()}
    up_to = local_table(labelled.sparkSession, [(lang, int(-(1 << 63) + p * ((1 << 64) - 1)) if p < 1 else (1 << 63) - 1) for lang, p in share.items()], "lang string, up_to long")
    size = F.octet_length("text")
    drawn = rows.join(F.broadcast(up_to), "lang").where((F.col("draw") <= F.col("up_to")) & F.col("text").isNotNull() & (size <= train_bytes // 8))
    one = drawn.groupBy("lang", "draw").agg(F.min(F.struct(size.alias("size"), "text")).alias("t")).select("lang", "draw", "t.size", "t.text")
    by_draw = Window.partitionBy("lang").orderBy("draw")
    picked = one.withColumns({"n": F.row_number().over(by_draw), "sum": F.sum("size").over(by_draw)}).where((F.col("n") <= train_docs) & (F.col("sum") <= train_bytes))
    found: dict[str, list[str]] = {}
    for lang, text in picked.orderBy("lang", "n").select("lang", "text").toLocalIterator():
        found.setdefault(lang, []).append(text)
    if missing := sorted(set(often) - set(found)):
        shortest = rows.where(F.col("lang").isin(missing) & F.col("text").isNotNull()).groupBy("lang").agg(F.min(F.struct(size.alias("size"), "text")).alias("t"))
        found |= {lang: [text] for lang, text in shortest.select("lang", "t.text").collect()}
    return {name: found[name] for name in sorted(found)}


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 3, min_count: int = 3, **bounds) -> dict[str, Tree]:
    """The context trees of the languages in ``labelled``, grown from their :func:`sample` (which ``bounds`` go to)."""
    return {name: context_counts(texts, order, min_count) for name, texts in sample(labelled, id_col, text_col, lang_col, **bounds).items()}


def usual_bits(texts: list[str], order: int = 3, min_count: int = 3) -> float:
    """The median of some texts' bits a byte, each half of them under the tree of the other half; infinite for less than two texts."""
    texts = [t for t in texts if t]
    found: list[float] = []
    for own, other in ((texts[::2], texts[1::2]), (texts[1::2], texts[::2])):
        if own and other:
            model = Model({"": context_counts(other, order, min_count)}, order)
            data = [t.encode("utf-8", "surrogatepass") for t in own]
            found += [float(model.code_lengths(d)[0]) / len(d) for d in data]
    return float(np.median(found)) if found else float("inf")


#: The model of this worker process, by the name that its broadcast was given.
_WORKER: dict[str, Models | None] = {}
HELD[__name__] = _WORKER


def _worker_model(name: str, frozen, order: int) -> Models | None:
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Models(frozen.value, order) if frozen.value else None
    return _WORKER[name]


def identify(docs: DataFrame, trees: dict[str, Tree], text_col: str = "text", order: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``bits_per_byte`` to each row.

    ``score`` is the language's share of 2 to the power of minus the code
    length, all languages being alike beforehand. Null texts, texts without a
    letter, and all texts when no language was learned are ``und`` with score
    0. Ties go to the language that sorts first. Repeated rows stay.
    """
    frozen, name = docs.sparkSession.sparkContext.broadcast(trees), uuid.uuid4().hex

    def make():
        model = _worker_model(name, frozen, order)

        def kernel(texts):
            out: list[list] = [[], [], []]
            for text in texts:
                if model is None or not text or not has_letter(text):
                    row = (UNDETERMINED, 0.0, None)
                else:
                    data = text.encode("utf-8", "surrogatepass")
                    bits = model.code_lengths(data)
                    best = int(bits.argmin())
                    row = (model.languages[best], float(1 / np.exp2(np.minimum(0, bits[best] - bits)).sum()), float(bits[best] / len(data)))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return kernel

    return with_kernel(docs, make, [text_col], _OUT, keep)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether a row is kept from training: ``crc32`` of its id's text leaves ``part``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, **settings) -> DataFrame:
    """Learns from the rows that are not :func:`held_out` and identifies all of them.

    Adds ``lang_pred``, ``score``, ``bits_per_byte`` and ``held_out`` (if the id
    is kept) to the columns of ``keep`` (default: all); columns with these names
    give way. Nulls, ties and repeated rows: see :func:`identify`. An empty
    table gives no rows.
    """
    trees = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col, **settings)
    out = identify(docs, trees, text_col, settings.get("order", 3), keep)
    return out.withColumn("held_out", held_out(id_col)) if id_col in out.columns else out


def in_a_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 3, min_count: int = 3, slack: float = 2.5, spare_bytes: int = 16, **bounds) -> DataFrame:
    """The rows whose texts are in one of the languages learned; columns and their order stay.

    Learns as :func:`language_id` does. A text of n bytes is in the language of
    its shortest code length if that is at most ``slack`` times the language's
    :func:`usual_bits` for each of n + ``spare_bytes`` bytes (the latter for
    short texts, of which little can be told). Words with digits (numbers, keys)
    are in no language and don't count unless there are no others. Null texts and texts without a
    letter are in none; when no language was learned, all others stay.
    """
    texts = sample(docs.where(~held_out(id_col)), id_col, text_col, lang_col, **bounds)
    trees = {name: context_counts(some, order, min_count) for name, some in texts.items()}
    most = np.array([slack * usual_bits(texts[name], order, min_count) for name in sorted(texts)])
    frozen, name = docs.sparkSession.sparkContext.broadcast(trees), uuid.uuid4().hex

    def make():
        model = _worker_model(name, frozen, order)

        def told(text: str | None) -> bool:
            if not text or not has_letter(text):
                return False
            if model is None:
                return True
            plain = " ".join(w for w in text.split(" ") if not _DIGIT.search(w)) if _DIGIT.search(text) else text
            data = (plain if has_letter(plain) else text).encode("utf-8", "surrogatepass")
            bits = model.code_lengths(data)
            best = int(bits.argmin())
            return bool(bits[best] <= most[best] * (len(data) + spare_bytes))

        return lambda some: [[told(t) for t in some]]

    own = unused("__told", docs)
    return with_kernel(docs, make, [text_col], [T.StructField(own, T.BooleanType())]).where(own).select(*docs.columns)


__all__ = ["Model", "Models", "context_counts", "has_letter", "held_out", "identify", "in_a_language", "language_id", "sample", "train", "usual_bits"]
