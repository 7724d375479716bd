"""Hard negatives by exact inner products, multiplied in a residue number system.

Components are integers. Modulo a prime below 512 they are at most 254 in size,
so float32 adds up the products of some 130 of them without rounding, and matrix
multiplication in float32 is what processors do fastest. A few primes tell
apart all scores that can occur; how many depends on the largest component and
the vectors' length, which are measured first. From a score's residues the
Chinese remainder theorem gives the score: its digits in the mixed radix of the
primes are found one by one, each between minus and plus half its prime, and
such digits reach negative numbers as well.

Anchors meet all rows in blocks: a task gets one block of anchors, which it
holds, and one block of rows, which stream past it; the numbers of blocks follow
from those of anchors and rows. Blocks are cut by rows' numbers, so copies and
labels that many rows share are spread evenly. The first pass finds each
anchor's best rows of its own label, the second, for each of these positives,
the best rows of other labels whose scores lie in its window. A task keeps the
best few of what it has seen, and only those are dealt out to be ranked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folia.llm.common import written, written_with
from folia.workers import reach_workers

#: float32 holds all whole numbers up to twice this.
_EXACT = 1 << 23
_NONE = np.iinfo(np.int64).min
#: Anchors that are multiplied with a batch of rows at a time.
_TILE = 256


def _primes(below: int) -> Iterator[int]:
    """The primes below a number, from the largest."""
    return (p for p in range(below - 1, 2, -1) if all(p % q for q in range(2, math.isqrt(p) + 1)))


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues between minus and plus half of p."""
    r = np.mod(x, p)
    return r - p * (r > p // 2)


class Residues:
    """Matrix multiplication of whole numbers whose results are at most ``largest`` in size, which must be below 2 ** 63."""

    def __init__(self, largest: int):
        if largest >= 1 << 63:
            raise ValueError("scores may pass the range of 64-bit numbers")
        self.primes: list[int] = []
        for p in _primes(512):
            if math.prod(self.primes) > 2 * largest:
                break
            self.primes.append(p)

    def of(self, matrix: np.ndarray) -> list[np.ndarray]:
        """A matrix of 64-bit numbers modulo each prime."""
        return [_balanced(matrix, p).astype(np.float32) for p in self.primes]

    def scores(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """All inner products of the rows of two matrices given by their residues."""
        out = np.zeros((len(a[0]), len(b[0])), dtype=np.int64)
        place, digits = 1, []
        for i, p in enumerate(self.primes):
            t = self._product(a[i], b[i], p)
            for q, digit in zip(self.primes, digits, strict=False):
                t = np.mod((t - digit) * np.int32(pow(q, -1, p)), np.int32(p))
            digits.append(_balanced(t, np.int32(p)))
            # the sum of all places is in range even where a place's value alone is not
            out += digits[-1].astype(np.int64) * np.array(place % (1 << 64), dtype=np.uint64).astype(np.int64)
            place *= p
        return out

    @staticmethod
    def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
        """The product modulo p, as 32-bit numbers between minus p and p; the inner dimension is cut so that no sum is rounded."""
        span = _EXACT // (p // 2) ** 2
        total = np.zeros((len(a), len(b)), dtype=np.int32)
        for at in range(0, a.shape[1], span):
            total += np.fmod((a[:, at : at + span] @ b[:, at : at + span].T).astype(np.int32), np.int32(p))
            total = np.fmod(total, np.int32(p))
        return total


class Best:
    """For each of n lists the k entries with the highest scores, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), _NONE, dtype=np.int64)
        self.id = np.zeros((n, k), dtype=np.int64)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offers a matrix of scores to the lists from ``first`` on; ``ids`` rise, and ``_NONE`` is no score."""
        n, m = scores.shape
        k = self.score.shape[1]
        held, held_id = self.score[first : first + n], self.id[first : first + n]
        least = held[:, -1]
        if not (scores.max(axis=1, initial=_NONE) >= np.maximum(least, _NONE + 1)).any():
            return
        if m > k:
            least = np.maximum(least, np.partition(scores, m - k, axis=1)[:, m - k])
        wanted = scores >= np.maximum(least, _NONE + 1)[:, None]
        tied = (scores == least[:, None]) & wanted
        if tied.sum() > 4 * k * n:  # of many ties the first k will do
            wanted &= ~tied | (np.cumsum(tied, axis=1) <= k)
        at, column = np.nonzero(wanted)
        old_at, old_column = np.nonzero(held > _NONE)
        at = np.concatenate([old_at, at])
        score = np.concatenate([held[old_at, old_column], scores[wanted]])
        id_ = np.concatenate([held_id[old_at, old_column], ids[column]])
        order = np.lexsort((id_, -score, at))
        at, score, id_ = at[order], score[order], id_[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        some = rank < k
        held[:] = _NONE
        held[at[some], rank[some]] = score[some]
        held_id[at[some], rank[some]] = id_[some]


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), min(high * positive // 100, (1 << 63) - 1)


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Lists as rows of a matrix; shorter ones are padded with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy()
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


_ANCHOR = "key bigint, label bigint, v array<bigint>, positives array<bigint>"


class _Task:
    """One block of anchors, and the best of the rows that have streamed past it."""

    def __init__(self, field: Residues, dims: int, k: int, windows: tuple[int, int] | None):
        self.field, self.dims, self.k, self.windows = field, dims, k, windows
        self.batches: list[pa.RecordBatch] = []
        self.ready = False

    def _start(self) -> None:
        anchors = pa.Table.from_batches(self.batches).combine_chunks()
        self.batches, self.ready = [], True
        self.keys, self.labels = (anchors[c].to_numpy() for c in ("key", "label"))
        self.residues = self.field.of(_matrix(anchors["v"].combine_chunks(), self.dims))
        if self.windows is None:
            self.best = [Best(len(self.keys), self.k)]
            return
        positives = anchors["positives"].to_pylist()
        slots = max(map(len, positives), default=0)
        self.best = [Best(len(self.keys), self.k) for _ in range(slots)]
        # a slot without a positive has an empty window
        self.ends = np.array([[window(p[i], *self.windows) if i < len(p) else (1, 0) for p in positives] for i in range(slots)], dtype=np.int64).reshape(slots, len(positives), 2)

    def meet(self, rows: pa.RecordBatch) -> None:
        if not self.ready:
            if not self.batches:
                return
            self._start()
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        residues = self.field.of(_matrix(rows["v"], self.dims))
        for at in range(0, len(self.keys), _TILE):
            tile = slice(at, at + _TILE)
            scores = self.field.scores([m[tile] for m in self.residues], residues)
            alike = self.labels[tile][:, None] == labels[None, :]
            if self.windows is None:
                self.best[0].add(at, np.where(alike, scores, _NONE), ids)
                continue
            scores[alike] = _NONE
            for slot, best in enumerate(self.best):
                low, high = self.ends[slot, tile, 0][:, None], self.ends[slot, tile, 1][:, None]
                best.add(at, np.where((scores >= low) & (scores <= high), scores, _NONE), ids)

    def results(self) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            return
        for slot, best in enumerate(self.best):
            at, rank = np.nonzero(best.score > _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[at]), pa.array(np.full(len(at), slot, dtype=np.int32)), pa.array(best.id[at, rank]), pa.array(best.score[at, rank])], names=["key", "slot", "id", "score"])


def _met(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], make: Callable[[], _Task]) -> DataFrame:
    """Each block of anchors with each block of rows: (key, slot, id, score), the best of each task."""
    n_anchors, n_rows = blocks
    block = F.pmod(F.xxhash64("key"), F.lit(n_anchors)).cast("int")
    dealt = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_rows - 1)), lambda i: i + block * n_rows))
    left = anchors.select(dealt.alias("task"), F.lit(True).alias("anchor"), "key", F.lit(None).cast("bigint").alias("id"), "label", "v", "positives")
    share = F.pmod("at", F.lit(n_rows)).cast("int")
    own = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_anchors - 1)), lambda i: i * n_rows + share))
    right = rows.select(own.alias("task"), F.lit(False).alias("anchor"), F.lit(None).cast("bigint").alias("key"), "id", "label", "v", F.lit(None).cast("array<bigint>").alias("positives"))
    # one task for each pair of blocks, its anchors first
    both = left.unionByName(right).repartitionById(n_anchors * n_rows, "task").sortWithinPartitions(F.desc("anchor"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = make()
        for batch in batches:
            anchors_here = batch["anchor"].true_count
            if anchors_here:
                task.batches.append(batch.slice(0, anchors_here))
            if anchors_here < len(batch):
                task.meet(batch.slice(anchors_here))
        yield from task.results()

    return both.mapInArrow(work, "key bigint, slot int, id bigint, score bigint")


def whole_vectors(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(id, label, v) with components floor(scale * x), x as double, of the rows that take part.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.select(
        F.col(id_col).cast("bigint").alias("id"),
        (F.col("label") if label is None else label).cast("bigint").alias("label"),
        F.when(finite, F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))).alias("v"),
    ).where("id is not null and label is not null and v is not null")


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    row_block: int = 4096,
    anchor_block: int = 16_384,
    most_tasks: int = 4096,
) -> DataFrame:
    """For each anchor and positive, the best rows of other labels with low * positive's score <= 100 * score <= high * positive's score.

    ``rows`` has id, label and v (:func:`whole_vectors`); ``anchors`` is a
    condition on them. An anchor's positives are the ``positives`` other rows of
    its label with the highest scores; all orders are by score, then by smaller
    id. Columns: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    A positive without such rows has none in the result, as has one with a
    score below zero. Repeated rows count each, as anchors, positives and
    negatives; an anchor's own row is one of those that equal it. Shorter
    vectors are padded with zeros. An empty table gives no rows. Scores that may
    pass 64 bits raise a ``ValueError``. ``row_block`` is the least number of
    rows that a task is worth, ``most_tasks`` bounds the tasks where blocks of
    anchors are few, and ``anchor_block`` what a task holds (64 MB at most).
    """
    spark = rows.sparkSession
    reach_workers(spark)
    v = F.col("v")
    size = F.greatest(F.abs(F.coalesce(F.array_max(v), F.lit(0))), F.abs(F.coalesce(F.array_min(v), F.lit(0))))
    numbered = rows.select("id", "label", "v", F.coalesce(anchors, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("at"))
    # written, so that rows keep their numbers
    base, (n, n_anchors, largest, dims) = written_with(numbered, "vectors", F.count(F.lit(1)), F.count(F.when(F.col("anchor"), 1)), F.max(size), F.max(F.size("v")))
    field = Residues((dims or 0) * (largest or 0) ** 2)
    fits = (64 << 20) // (4 * max(1, dims or 0) * max(1, len(field.primes)))
    a_blocks = max(1, math.ceil(n_anchors / max(_TILE, min(anchor_block, fits))))
    blocks = (a_blocks, max(1, min(math.ceil(n / row_block), math.ceil(most_tasks / a_blocks))))

    asked = written(base.where("anchor").groupBy("id", "label", "v").agg(F.min("at").alias("key"), F.count(F.lit(1)).alias("times")), "anchors")
    found = _met(asked.withColumn("positives", F.lit(None).cast("array<bigint>")), base, blocks, lambda: _Task(field, dims, positives + 1, None))
    by_score = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    first = found.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= positives + 1)
    lists = first.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("near"))
    # of the rows that equal the anchor, one is the anchor's own
    own = F.struct(F.col("id"), F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x * x).alias("score"))
    near = F.transform("near", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))
    others = F.slice(F.filter("near", lambda x, i: i + 1 != F.array_position("near", F.col("own"))), 1, positives)
    with_positives = written(
        asked.join(lists.withColumn("near", near), "key").withColumn("own", own).withColumn("found", others).where(F.size("found") > 0).select("key", "id", "label", "v", "times", "found"),
        "positives",
    )

    windows = (low, high)
    hits = _met(with_positives.withColumn("positives", F.col("found.score")), base, blocks, lambda: _Task(field, dims, negatives, windows))
    ranks = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    pairs = with_positives.select("key", F.col("id").alias("anchor_id"), "times", F.posexplode("found").alias("slot", "positive"))
    return (
        ranked.join(pairs, ["key", "slot"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
        .select("anchor_id", F.col("positive.id").alias("positive_id"), "rank", "negative_id", F.col("positive.score").alias("positive_score"), "negative_score")
    )
