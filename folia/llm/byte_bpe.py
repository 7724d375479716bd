"""Byte-level BPE by overlapping chunks.

A text is cut into chunks of a fixed number of code points, each sharing its
end with the beginning of the next. Chunks are split into pre-tokens on their
own, wherever they lie. A chunk that begins within a pre-token goes wrong at
first; but a pre-token depends only on what follows its beginning, so from the
first place at which both chunks begin one, they agree for good. There the two
are stitched together. Chunks that share no such place (a run of letters longer
than what they share) are joined to one, and that is split anew, until every
seam has a place. What lies between two seams is then encoded, again wherever
it lies, and a text's ids are its chunks' ids in order. Decoding concatenates
the bytes of the ids' labels.

A text of one chunk has no seam and is encoded where it is read; only chunks of
longer texts are dealt out.

The merges of a pre-token are its neighbouring parts joined again and again,
always the pair of the lowest rank and of those the first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folia.llm.common import HELD, release_others, with_kernel, written, written_with
from folia.workers import reach_workers

#: How far behind a pre-token's end a pattern may look: what ends nearer to a chunk's end may not be one.
LOOK = 4
#: Longer pre-tokens are merged through a heap.
_LONG = 256


class Ranks:
    """A file of ranks (a token in Base64 and its number a line), with what this worker has encoded."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.labels = {rank: token for token, rank in self.ranks.items()}
        self.never = max(self.labels) + 1
        self.split = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.size = 0

    def merged(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > _LONG:
            return self._merged_by_heap(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        never = self.never
        pair = [ranks.get(a + b, never) for a, b in itertools.pairwise(parts)]
        while pair:
            least = min(pair)
            if least == never:
                break
            i = pair.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], never)
        return [ranks[p] for p in parts]

    def _merged_by_heap(self, word: bytes) -> list[int]:
        """The same with pairs in a heap and parts by their bounds; a pair that has changed meanwhile is passed over."""
        ranks, n = self.ranks, len(word)
        ends, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at a place; a part's predecessor
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            middle = ends[i]
            if middle < n and (rank := ranks.get(word[i : ends[middle]])) is not None:
                heapq.heappush(heap, (rank, i, ends[middle]))

        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if middle == 0 or middle >= n or middle >= end or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, 0  # no part begins at the middle any more
            if end < n:
                before[end] = i
            offer(i)
            if i:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : ends[i]]])
            i = ends[i]
        return out

    def encoded(self, words: list[str], cache_bytes: int) -> bytes:
        """The ids of some pre-tokens, four bytes each, least significant first."""
        if self.size > cache_bytes:
            self.known, self.size = {}, 0
        known = self.known
        for word in set(words).difference(known):
            known[word] = np.array(self.merged(word.encode()), dtype="<u4").tobytes()
            self.size += 160 + 3 * len(word) + len(known[word])
        return b"".join(map(known.__getitem__, words))

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def starts(self, text: str, at: int = 0) -> list[int]:
        """Where pre-tokens begin."""
        return [m.start() for m in self.split.finditer(text, at)]


#: Of this worker process, by path and pattern.
_WORKER: dict[tuple[str, str], Ranks] = {}
HELD[__name__] = _WORKER


def _worker(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _WORKER:
        _WORKER[path, pattern] = Ranks(path, pattern)
    return _WORKER[path, pattern]


_OUT = [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.BinaryType())]
_DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


class _Result:
    """What is told of one text, from its ids piece by piece."""

    def __init__(self, ranks: Ranks, digests: bool):
        self.ranks, self.digests, self.n = ranks, digests, 0
        self.ids, self.bytes = (hashlib.sha256(), hashlib.sha256()) if digests else ([], [])

    def add(self, ids: bytes) -> None:
        self.n += len(ids) // 4
        take = (lambda x, part: x.update(part)) if self.digests else (lambda x, part: x.append(part))
        take(self.ids, ids)
        take(self.bytes, self.ranks.decoded(ids))

    def row(self) -> tuple:
        if self.digests:
            return self.n, self.ids.hexdigest(), self.bytes.hexdigest()
        return np.frombuffer(b"".join(self.ids), dtype="<u4").astype(np.int64), b"".join(self.bytes)


def _cut(texts: DataFrame, chunk: int, shared: int) -> DataFrame:
    """(text_id, text) as chunks (text_id, at, text); ``at`` is a chunk's first place."""
    step = chunk - shared

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch["text_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                places = range(0, max(1, len(text) - shared), step)
                for some in itertools.batched(places, 256):
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(some)), pa.array(some, pa.int64()), pa.array([text[p : p + chunk] for p in some])], names=["text_id", "at", "text"])

    return texts.mapInArrow(work, "text_id bigint, at bigint, text string")


def _seams(chunks: DataFrame, path: str, pattern: str, shared: int) -> DataFrame:
    """(text_id, at, begin, end): the part of a chunk that is its own, as places in the text.

    ``begin`` is null where a chunk and the one before begin no pre-token at the same place; ``end`` is null where the next chunk's is, and for the last.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _worker(path, pattern)
        for batch in batches:
            heads, tails = [], []
            for at, text in zip(batch["at"].to_pylist(), batch["text"].to_pylist(), strict=True):
                places = ranks.starts(text)
                heads.append([at + p for p in places if p < shared])
                tails.append([at + p for p in places if len(text) - shared <= p <= len(text) - LOOK])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["text_id"], batch["at"], pa.array(heads, lists), pa.array(tails, lists)], names=["text_id", "at", "head", "tail"])

    found = chunks.mapInArrow(work, "text_id bigint, at bigint, head array<bigint>, tail array<bigint>")
    along = Window.partitionBy("text_id").orderBy("at")
    both = F.array_min(F.array_intersect("head", F.lag("tail").over(along)))
    begun = found.select("text_id", "at", F.when(F.col("at") == 0, F.lit(0)).otherwise(both).alias("begin"))
    return begun.withColumn("end", F.lead("begin").over(along))


def _joined(chunks: DataFrame, seams: DataFrame) -> DataFrame:
    """Chunks without a seam before them are appended to those before them."""
    along = Window.partitionBy("text_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = seams.select("text_id", "at", F.count("begin").over(along).alias("group"))
    grouped = chunks.join(numbered, ["text_id", "at"]).groupBy("text_id", "group").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts"))
    following = lambda i: F.get("parts", i + 1)["at"]
    own = F.transform("parts", lambda part, i: F.when(following(i).isNull(), part["text"]).otherwise(F.substring(part["text"], F.lit(1), (following(i) - part["at"]).cast("int"))))
    return grouped.select("text_id", F.col("parts")[0]["at"].alias("at"), F.array_join(own, "").alias("text"))


def _encoded(chunks: DataFrame, seams: DataFrame, path: str, pattern: str, cache_bytes: int) -> DataFrame:
    """(text_id, at, ids): the ids of each chunk's own part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others(__name__)
        ranks = _worker(path, pattern)
        for batch in batches:
            out = []
            for at, text, begin, end in zip(*[batch[c].to_pylist() for c in ("at", "text", "begin", "end")], strict=True):
                stop = len(text) if end is None else end - at
                words = [m[0] for m in itertools.takewhile(lambda m: m.start() < stop, ranks.split.finditer(text, begin - at))]  # noqa: B023
                out.append(ranks.encoded(words, cache_bytes))
            yield pa.RecordBatch.from_arrays([batch["text_id"], batch["at"], pa.array(out, pa.binary())], names=["text_id", "at", "ids"])

    return chunks.join(seams, ["text_id", "at"]).select("text_id", "at", "text", "begin", "end").mapInArrow(work, "text_id bigint, at bigint, ids binary")


def _in_order(encoded: DataFrame, path: str, pattern: str, digests: bool) -> DataFrame:
    """One row for each text_id, from its chunks' ids in order."""
    outputs = _DIGEST if digests else _OUT
    schema = T.StructType([T.StructField("text_id", T.LongType()), *outputs])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _worker(path, pattern)
        rows = ((i, ids) for batch in batches for i, ids in zip(batch["text_id"].to_pylist(), batch["ids"].to_pylist(), strict=True))
        for i, pieces in itertools.groupby(rows, lambda row: row[0]):
            result = _Result(ranks, digests)
            for _, ids in pieces:
                result.add(ids)
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((i, *result.row()), arrow, strict=True)], names=arrow.names)

    return encoded.repartition("text_id").sortWithinPartitions("text_id", "at").mapInArrow(work, schema)


def byte_bpe_encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    text_col: str = "text",
    keep: list[str] | None = None,
    digests: bool = False,
    chunk: int = 32_768,
    shared: int = 1_024,
    cache_bytes: int = 120_000_000,
) -> DataFrame:
    """Adds ``ids`` (array of long) and ``decoded`` (the bytes that they stand for), or with ``digests`` their number and SHA-256 values.

    Equal to the library's encoding without special tokens by the same ranks
    and pattern. ``pattern`` may look ahead of a match by up to four code points
    and not behind it; what it leaves out is not encoded. Null counts as the
    empty text: no ids. ``ids_sha256`` is over the ids as little-endian unsigned
    32-bit numbers. Rows stay as they are, repeated ones too; no rows give no
    rows; a column with an output's name gives way. ``chunk`` and ``shared`` are
    counts of code points. Workers keep pre-tokens that they have encoded, up to
    ``cache_bytes`` and those of one chunk.
    """
    if not LOOK < shared < chunk // 2:
        raise ValueError("chunks must be more than twice what they share")
    outputs = _DIGEST if digests else _OUT
    new = {f.name for f in outputs}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    one = F.coalesce(F.length(docs[text_col]), F.lit(0)) <= chunk

    def make():
        ranks = _worker(ranks_path, pattern)

        def told(text: str | None) -> tuple:
            result = _Result(ranks, digests)
            result.add(ranks.encoded(ranks.split.findall(text), cache_bytes) if text else b"")
            return result.row()

        def kernel(texts):
            return [list(c) for c in zip(*map(told, texts), strict=True)] if texts else [[] for _ in outputs]

        return kernel

    short = with_kernel(docs.where(one), make, [text_col], outputs, kept)
    own = [F.col(text_col).alias("text"), *[docs[c].alias(f"k{i}") for i, c in enumerate(kept)]]
    reach_workers(docs.sparkSession)
    # written, so that texts keep their numbers
    texts, (n,) = written_with(docs.where(~one).select(F.monotonically_increasing_id().alias("text_id"), *own), "long-texts", F.count(F.lit(1)))
    if not n:
        return short
    chunks = _cut(texts.select("text_id", "text"), chunk, shared)
    chunks = written(chunks.repartition("text_id", "at"), "chunks")
    while True:
        seams, (missing,) = written_with(_seams(chunks, ranks_path, pattern, shared), "seams", F.count(F.when(F.col("begin").isNull(), 1)))
        if not missing:
            break
        chunks = written(_joined(chunks, seams), "chunks")
    told = _in_order(_encoded(chunks, seams, ranks_path, pattern, cache_bytes), ranks_path, pattern, digests)
    long = texts.drop("text").join(told, "text_id").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *[f.name for f in outputs])
    return short.union(long)


def byte_bpe_decode(docs: DataFrame, ranks_path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``decoded``: the bytes of an array of ids. A null array, or an id outside the file, gives null."""

    def make():
        labels = _worker(ranks_path, "").labels

        def kernel(rows):
            return [[b"".join([labels[i] for i in ids]) if ids is not None and all(i in labels for i in ids) else None for ids in rows]]

        return kernel

    return with_kernel(docs, make, [ids_col], _OUT[1:], keep)
