"""How filters interact: what each removes, in every order of applying them, read off decision diagrams.

Each document's failures are a mask, one bit for a filter. Masks are counted
for each part of the corpus, and each part's counts become a decision diagram:
a level for each filter, from each node one edge for documents that pass and
one for those that fail, and at each node the counts of all documents below it.
Equal subdiagrams are one node, and what no document reaches is left out.

The path of passes from the root goes through the documents that are left step
by step: at each of its nodes the failing edge counts what the step removes and
the passing edge what it keeps. A filter at the root counts all that fail it, a
filter at the last level those that fail nothing else. The orders are visited
so that each differs from the one before by two neighbours, and the diagram is
carried along by swapping these two levels, which leaves all others as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folia.workers import reach_workers

Counts = tuple[int, ...]


class Diagram:
    """Counts of failure masks under an order of the filters. A node is a number; 0 is the one that no document reaches."""

    def __init__(self, n_filters: int, counts: dict[int, Counts]):
        self.order = list(range(n_filters))
        self._width = len(next(iter(counts.values()), ()))
        self.weight: list[Counts] = [(0,) * self._width]
        self._ends: dict[Counts, int] = {}
        self._levels: list[dict[int, tuple[int, int]]] = [{} for _ in range(n_filters)]  # nodes with their edges: passing, failing
        self._shared: list[dict[tuple[int, int], int]] = [{} for _ in range(n_filters)]
        self.root = self._built(0, counts)

    def _new(self, weight: Counts) -> int:
        self.weight.append(weight)
        return len(self.weight) - 1

    def _node(self, level: int, passing: int, failing: int) -> int:
        if not passing and not failing:
            return 0
        got = self._shared[level].get((passing, failing))
        if got is None:
            got = self._new(tuple(map(sum, zip(self.weight[passing], self.weight[failing], strict=True))))
            self._shared[level][passing, failing] = got
            self._levels[level][got] = (passing, failing)
        return got

    def _built(self, level: int, counts: dict[int, Counts]) -> int:
        if not counts:
            return 0
        if level == len(self.order):
            (weight,) = counts.values()
            if weight not in self._ends:
                self._ends[weight] = self._new(weight)
            return self._ends[weight]
        bit = 1 << level
        return self._node(level, self._built(level + 1, {m: c for m, c in counts.items() if not m & bit}), self._built(level + 1, {m: c for m, c in counts.items() if m & bit}))

    def edges(self, level: int, node: int) -> tuple[int, int]:
        return self._levels[level][node] if node else (0, 0)

    def swap(self, level: int) -> None:
        """Exchanges the filters of a level and the next. Nodes of the upper level keep their numbers, so nothing above them changes."""
        upper, below = self._levels[level], level + 1
        split = {node: (self.edges(below, passing), self.edges(below, failing)) for node, (passing, failing) in upper.items()}
        self._levels[below], self._shared[below] = {}, {}
        for node, ((both_pass, only_lower), (only_upper, both_fail)) in split.items():
            upper[node] = (self._node(below, both_pass, only_upper), self._node(below, only_lower, both_fail))
        self._shared[level] = {edges: node for node, edges in upper.items()}
        self.order[level], self.order[below] = self.order[below], self.order[level]

    def steps(self) -> Iterator[tuple[int, Counts, Counts]]:
        """Along the path of passes: each step's filter, what the step keeps and what it removes."""
        node = self.root
        for level, which in enumerate(self.order):
            passing, failing = self.edges(level, node)
            yield which, self.weight[passing], self.weight[failing]
            node = passing


def neighbour_swaps(n: int) -> Iterator[int]:
    """The places of swaps that lead through all orders of n things: the last one wanders through each order of the others, to and fro."""
    if n < 2:
        return
    inner, leftwards = neighbour_swaps(n - 1), True
    for _ in range(math.factorial(n - 1)):
        yield from range(n - 2, -1, -1) if leftwards else range(n - 1)
        place = next(inner, None)
        if place is not None:
            yield place + leftwards  # the wanderer stands first or last
        leftwards = not leftwards


def audited(names: list[str], counts: dict[int, Counts]) -> list[tuple]:
    """Rows (filter_order, step, kept, removed, redundant, unique_fails, lost..., shapley) of all orders; of ``counts`` the first is that of documents."""
    n = len(names)
    diagram = Diagram(n, counts)
    rows, fails, alone, summed = [], [0] * n, [0] * n, [0] * n

    def visit() -> None:
        label = "".join(names[i] for i in diagram.order)
        for step, (which, kept, removed) in enumerate(diagram.steps(), 1):
            if step == 1:
                fails[which] = removed[0]
            if step == n:
                alone[which] = removed[0]
            summed[which] += removed[0]
            rows.append((label, step, which, kept[0], removed))

    visit()
    for place in neighbour_swaps(n):
        diagram.swap(place)
        visit()
    return [(label, step, kept, removed[0], fails[which] - removed[0], alone[which], *removed[1:], summed[which]) for label, step, which, kept, removed in rows]


def filter_audit(docs: DataFrame, failures: dict[str, Column], part: Column, lost: dict[str, Column] | None = None, times: Column | None = None) -> DataFrame:
    """What each filter removes, for each part and each order of the filters.

    ``failures`` gives a filter's one-letter name and its failure condition (a
    null one counts as passing), for up to seven filters; ``lost`` names further
    counts, of removed rows that fulfil a condition; a row counts ``times``
    times. Columns: part, filter_order, step, kept (after the step), removed
    (by it), redundant (fail the step's filter, removed earlier), unique_fails
    (fail that filter only), those of ``lost``, shapley (the filter's removed,
    summed over all orders). A null part is the empty string. Every order and
    step has a row, zeros included; an empty table has none. Repeated rows count
    each. No other column is looked at. Only masks' counts are dealt out, at
    most 2 to the number of filters for each part.
    """
    names, lost = list(failures), lost or {}
    if not 1 <= len(names) <= 7 or any(len(x) != 1 for x in names):
        raise ValueError("between one and seven filters, each named by one letter")
    reach_workers(docs.sparkSession)
    mask = F.lit(0)
    for i, condition in enumerate(failures.values()):
        mask = mask + F.when(condition, 1 << i).otherwise(0)
    times = F.lit(1) if times is None else times
    marked = docs.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), times.cast("bigint").alias("c0"), *[F.when(c, times).otherwise(0).cast("bigint").alias(f"c{i}") for i, c in enumerate(lost.values(), 1)])
    sums = [f"c{i}" for i in range(len(lost) + 1)]
    counted = marked.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in sums])
    columns = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"lost{i}" for i in range(len(lost))], "shapley"]
    schema = ", ".join(["part string"] + [f"{c} {'string' if c == 'filter_order' else 'int' if c == 'step' else 'bigint'}" for c in columns])

    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): tuple(map(int, c)) for m, *c in group[["mask", *sums]].itertuples(index=False)}
        out = pd.DataFrame(audited(names, counts), columns=columns)
        out.insert(0, "part", key[0])
        return out

    return counted.groupBy("part").applyInPandas(work, schema).toDF("part", *columns[:6], *lost, "shapley")


#: Words are parted by these (fixed values).
_BLANK = r"[\x20\x09-\x0D]+"


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per text, part and label: what filters A to E say, and how many rows stand for it.

    Columns part, A to E (whether a row fails), good, toxic (whether some row
    of ``labels`` has quality 1, toxic 1 for the id) and times. A: under 200
    words; B: fewer than half of the words are distinct; C: over 3 in 100 code
    points are A to Z; D: has one of ``#$%&*|``; E: some row with a smaller
    doc_id has the same text. A null text is the empty one. A row without an id
    fails no E, makes none fail and has no label.

    Texts go no further than the scan; equal texts are told by their SHA-256.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, _BLANK), lambda w: w != "")
    read = docs.select("doc_id", "lang", text.alias("text"), words.alias("words"))
    n_words = F.size("words")
    rows = read.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2("text", 256)).alias("same"),
        (n_words < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 50 * n_words).alias("B"),
        (100 * (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))) > 3 * F.length("text")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )
    # rows without an id are dealt by their texts: they may be many
    keys = {"key": F.coalesce("doc_id", F.xxhash64("same")), "known": F.col("doc_id").isNotNull()}
    judged = (
        labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
        .groupBy(F.col("doc_id").alias("key"), F.lit(True).alias("known"))
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    )
    what = ["same", "part", "A", "B", "C", "D", "good", "toxic"]
    joined = rows.withColumns(keys).join(judged, ["key", "known"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    each = joined.groupBy("key", "known", "doc_id", *what).agg(F.count(F.lit(1)).alias("n"))
    # of a text, part and label: all rows, those with the smallest id, and those without an id
    texts = each.groupBy(*what).agg(
        F.sum("n").alias("all"),
        F.min(F.when(F.col("known"), F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(~F.col("known"), F.col("n")).otherwise(0)).alias("without"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("same"))
    kept = F.col("without") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = F.array(F.struct(F.lit(False).alias("E"), kept.alias("times")), F.struct(F.lit(True).alias("E"), (F.col("all") - kept).alias("times")))
    return texts.withColumn("least", least).select("part", "A", "B", "C", "D", "good", "toxic", F.inline(copies)).where("times > 0")


def document_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`filter_audit` of :func:`document_failures`, with good_lost and toxic_lost."""
    rows = document_failures(docs, labels)
    return filter_audit(rows, {c: F.col(c) for c in "ABCDE"}, F.col("part"), {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")}, F.col("times"))
