"""Token counts through a two-tier lookup of pre-token lengths, without a shuffle.

Tier one is a table that is built once on the driver and broadcast: the
pre-tokens that the tokenizer's merges were made for, which are the frequent
ones of general text, each with its number of tokens. It has at most one
entry for each entry of the vocabulary, whatever the corpus. Tier two is a
cache in each Python worker, which outlives the task: pre-tokens that tier one
lacks are encoded by the library, all misses of a batch in one call, and kept
up to ``cache_bytes``. A full cache is dropped and fills anew; that costs
time, never a count.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folia.llm.common import HELD, with_kernel

_OUT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]


def _load(path: str):
    """The tokenizer file, without truncation and padding, and its special strings."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path), []
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def _lengths(tokenizer, texts: list[str]) -> list[int]:
    if not texts:
        return []
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _byte_level(path: str) -> bool:
    """Whether a file splits texts by the byte-level pattern and does nothing else before its merges."""
    import json

    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and plain


def frequent_lengths(path: str) -> dict[str, int]:
    """Tier one: the vocabulary's entries that are whole pre-tokens, with their numbers of tokens."""
    from folia.llm.pretokens import BYTE_LEVEL, byte_alphabet

    tokenizer, special = _load(path)
    byte_of = {c: b for b, c in byte_alphabet().items()}
    found = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(byte_of[c] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if BYTE_LEVEL.fullmatch(text) and text not in special:
            found.append(text)
    return dict(zip(found, _lengths(tokenizer, found), strict=True))


#: Of this worker process, by tokenizer path: library, special strings, both tiers in one table, bytes of the second.
_WORKER: dict[str, tuple] = {}
HELD[__name__] = _WORKER


def token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 1024, keep: list[str] | None = None, cache_bytes: int = 48_000_000) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (``n_tokens > limit``) to each row.

    Counts are those of the library for the file: no begin, end or other added
    tokens, special strings inside a text as the library takes them, no
    truncation. Null counts as the empty text: 0 bytes, 0 tokens, false. Rows
    stay as they are, repeated ones too; an empty table gives no rows.
    """
    spark = docs.sparkSession
    by_parts = _byte_level(tokenizer_path)
    first = spark.sparkContext.broadcast(frequent_lengths(tokenizer_path) if by_parts else {})

    def make():
        if tokenizer_path not in _WORKER:
            tokenizer, special = _load(tokenizer_path)
            _WORKER[tokenizer_path] = (tokenizer, re.compile("|".join(map(re.escape, special)) or "(?!)"), dict(first.value), [0])
        tokenizer, special, table, held = _WORKER[tokenizer_path]

        def whole(texts: list[str]) -> list[int]:
            if tokenizer_path.endswith(".model"):
                return [len(x) for x in tokenizer.encode(texts, num_threads=1)] if texts else []
            return _lengths(tokenizer, texts)

        def kernel(texts):
            from folia.llm.pretokens import BYTE_LEVEL, known

            texts = [t or "" for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            counts = [0] * len(texts)
            rest = [i for i, t in enumerate(texts) if t and not (by_parts and known(t))]
            for i, n in zip(rest, whole([texts[i] for i in rest]), strict=True):
                counts[i] = n
            left = set(rest)
            parts: list[tuple[int, list[str]]] = []
            for i, t in enumerate(texts):
                if not t or i in left:
                    continue
                if special.search(t):
                    counts[i] = len(special.findall(t))
                    parts.extend((i, BYTE_LEVEL.findall(p)) for p in special.split(t))
                else:
                    parts.append((i, BYTE_LEVEL.findall(t)))
            if held[0] > cache_bytes:
                table.clear()
                table.update(first.value)
                held[0] = 0
            missing = list(set().union(*(p for _, p in parts)).difference(table))
            table.update(zip(missing, _lengths(tokenizer, missing), strict=True))
            held[0] += sum(map(len, missing)) + 110 * len(missing)
            for i, p in parts:
                counts[i] += sum(map(table.__getitem__, p))
            return [sizes, counts, [n > limit for n in counts]]

        return kernel

    return with_kernel(docs, make, [text_col], _OUT, keep)
