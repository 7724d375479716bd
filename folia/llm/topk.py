"""Exact top-k search over binary codes through incremental multi-index hashing.

A 64-bit code is cut into ``segments``, each with a table of its own. Codes at
distance D from a query agree with it up to ``D // segments`` bits on at least
one segment, so once every segment's table has been probed with all patterns of
up to r differing bits, every code at distance ``segments * (r + 1) - 1`` or
less has been seen. The radius grows from zero, a job for each; a query ends
when k verified codes lie within that bound, and only the others go on.

A segment's table is dealt to shards by the leading bits of the segment's
value, so that a shard holds a bounded number of codes; shards that many codes
share are dealt further by a hash. This is done once; all radii's jobs find the
tables where they were put. A query goes to the shards whose leading bits
differ from its own by no more than the radius, and is probed there with the
patterns that spend the rest of it. Where those patterns are more than the
values that the table has, the values are gone through in their place, and
those at the distance are the ones that the patterns would have found. No query
is compared with a code that doesn't share a near segment with it.

Rows are reduced to distinct codes first, each with its k + 1 smallest ids and
how often each stands there (more can't be asked for), so a vector that a third
of all rows share is one code. A query whose id stands at m codes looks for
k + m pairs of id and code, so that k are left without its own.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from folia.llm.common import checkpointed, local_table, with_kernel, written, written_with
from folia.workers import reach_workers

BITS = 64


def sign_code(vector: list[float | None] | None) -> int | None:
    """Bit i is set if component i is positive; of over 64 components, bit i is that of the sum of every 64th from i.

    A null or NaN component counts as not positive. Null for a null vector.
    """
    if vector is None:
        return None
    v = np.array([x if x is not None else 0.0 for x in vector], dtype=np.float64)
    v = np.nan_to_num(v, nan=0.0)
    if len(v) > BITS:
        v = np.concatenate([v, np.zeros(-len(v) % BITS)]).reshape(-1, BITS).sum(axis=0)
    code = sum(1 << i for i in np.nonzero(v > 0)[0].tolist())
    return code - (1 << 64) if code >> 63 else code


def binary_codes(vectors: DataFrame, vector_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Adds ``code``, the vector's signs as a long (null for a null vector)."""

    def make():
        return lambda rows: [[sign_code(v) for v in rows]]

    return with_kernel(vectors, make, [vector_col], [T.StructField("code", T.LongType())], keep)


def _patterns(bits: int, r: int) -> np.ndarray:
    """All words of ``bits`` bits with exactly r set."""
    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(bits), r)], dtype=np.uint64)


def _segments(n_codes: int) -> int:
    """As many segments as make a segment's values about as many as the codes, eight at most."""
    return min(8, max(1, round(BITS / math.log2(max(2, n_codes)))))


class _Layout:
    """The cuts of codes into segments, and of segments' tables into shards of ``prefix`` leading bits."""

    def __init__(self, segments: int, prefix: int):
        self.cuts = [BITS * i // segments for i in range(segments + 1)]
        self.prefix = min(prefix, *(b - a for a, b in itertools.pairwise(self.cuts)))

    def bits(self, segment: int) -> int:
        return self.cuts[segment + 1] - self.cuts[segment]

    def values(self, codes: np.ndarray, segment: int) -> np.ndarray:
        return (codes >> np.uint64(self.cuts[segment])) & np.uint64((1 << self.bits(segment)) - 1)

    def shards(self, codes: np.ndarray, segment: int) -> np.ndarray:
        return (self.values(codes, segment) >> np.uint64(self.bits(segment) - self.prefix)).astype(np.int64) + (segment << self.prefix)


def nearest(queries: np.ndarray, need: np.ndarray, owner: np.ndarray, at: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates (query, code) as positions, those that may be among a query's nearest: up to the distance by which ``need`` rows are seen."""
    pair = np.unique(owner * np.int64(len(codes)) + at) if len(at) else np.zeros(0, dtype=np.int64)
    owner, at = pair // max(1, len(codes)), pair % max(1, len(codes))
    d = np.bitwise_count(codes[at] ^ queries[owner]).astype(np.int64)
    slot = owner * (BITS + 1) + d
    seen = np.bincount(slot, weights=sizes[at], minlength=len(queries) * (BITS + 1)).reshape(len(queries), BITS + 1).cumsum(axis=1)
    last = (seen < need[:, None]).sum(axis=1)  # the first distance at which enough are seen
    keep = d <= last[owner]
    return owner[keep], at[keep], d[keep]


def probe(layout: _Layout, shard: int, r: int, codes: np.ndarray, sizes: np.ndarray, queries: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of some queries in one shard at radius r exactly."""
    segment, bits = shard >> layout.prefix, layout.bits(shard >> layout.prefix) - layout.prefix
    low = np.uint64((1 << bits) - 1)
    values = layout.values(codes, segment) & low
    order = np.argsort(values, kind="stable")
    values = values[order]
    spent = np.bitwise_count(layout.shards(queries, segment) ^ shard).astype(np.int64)
    owners, places = [], []
    starts = np.nonzero(np.diff(values, prepend=~values[:1]))[0] if len(values) else np.zeros(0, dtype=np.int64)
    distinct, ends = values[starts], np.append(starts[1:], len(values))
    for used in np.unique(spent).tolist():
        if not 0 <= r - used <= bits:
            continue
        some = np.nonzero(spent == used)[0]
        few = math.comb(bits, r - used) <= len(distinct)
        masks = _patterns(bits, r - used) if few else distinct
        step = max(1, (1 << 20) // max(1, len(masks)))
        for i in range(0, len(some), step):
            part = some[i : i + step]
            own = layout.values(queries[part], segment) & low
            met = own[:, None] ^ masks[None, :]
            if few:
                at = np.minimum(np.searchsorted(distinct, met), len(distinct) - 1)
                asker, column = np.nonzero(distinct[at] == met)
                found = at[asker, column]
            else:
                asker, found = np.nonzero(np.bitwise_count(met) == r - used)
            n = (ends - starts)[found]
            places.append(order[np.repeat(starts[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            owners.append(np.repeat(part[asker], n))
    empty = np.zeros(0, dtype=np.int64)
    return nearest(queries, need, np.concatenate([empty, *owners]), np.concatenate([empty, *places]), codes, sizes)


_FOUND = "qcode long, need long, code long, size long, distance int"


def _answers(ask: np.ndarray, need: np.ndarray, own: np.ndarray, sizes: np.ndarray, q: np.ndarray, c: np.ndarray, d: np.ndarray):
    import pandas as pd

    return pd.DataFrame({"qcode": ask[q], "need": need[q], "code": own[c], "size": sizes[c], "distance": d.astype(np.int32)})


def _dealt(codes: DataFrame, layout: _Layout) -> DataFrame:
    """Codes by the shards of their segments: (shard, code, size)."""

    def dealt(batches):
        import pyarrow as pa

        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(len(layout.cuts) - 1):
                yield pa.RecordBatch.from_arrays([pa.array(layout.shards(own.view(np.uint64), i)), batch.column(0), batch.column(1)], names=["shard", "code", "size"])

    return codes.select("code", F.col("size").cast("long").alias("size")).mapInArrow(dealt, "shard long, code long, size long")


def _placed(stored: DataFrame, parts: dict[int, int]) -> DataFrame:
    """The tables where all probes will find them. ``parts``: of shards that very many codes share, how many parts they are dealt to."""
    times = F.broadcast(local_table(stored.sparkSession, list(parts.items()), "shard long, times int"))
    part = F.pmod(F.xxhash64("code", F.lit(13)), F.coalesce(F.col("times"), F.lit(1))).cast("int")
    n = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored.join(times, "shard", "left").select("shard", part.alias("part"), "code", "size").repartition(n, "shard", "part").persist(StorageLevel.DISK_ONLY)


def _probed(placed: DataFrame, queries: DataFrame, layout: _Layout, r: int, parts: dict[int, int]) -> DataFrame:
    """Candidates of open queries at radius r."""
    n_segments = len(layout.cuts) - 1

    def asked(batches):
        import pyarrow as pa

        masks = np.concatenate([_patterns(layout.prefix, i) for i in range(min(r, layout.prefix) + 1)]).astype(np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(n_segments):
                home = layout.shards(own.view(np.uint64), i)
                for mask in masks.tolist():
                    yield pa.RecordBatch.from_arrays([pa.array(home ^ mask), batch.column(0), batch.column(1)], names=["shard", "qcode", "need"])

    times = F.broadcast(local_table(placed.sparkSession, list(parts.items()), "shard long, times int"))
    wanted = queries.select("qcode", "need").mapInArrow(asked, "shard long, qcode long, need long")
    wanted = wanted.join(times, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("times"), F.lit(1)) - 1)).alias("part"), "qcode", "need")

    def answer(key, table, some):
        own, ask, need = table["code"].to_numpy(np.int64), some["qcode"].to_numpy(np.int64), some["need"].to_numpy(np.int64)
        sizes = table["size"].to_numpy(np.int64)
        return _answers(ask, need, own, sizes, *probe(layout, int(key[0]), r, own.view(np.uint64), sizes, ask.view(np.uint64), need))

    return placed.groupBy("shard", "part").cogroup(wanted.groupBy("shard", "part")).applyInPandas(answer, _FOUND)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", code_col: str = "code", segments: int | None = None, shard_codes: int = 16_384) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest rows of each query, its own row excepted.

    Ties of distance go to the smaller id; ranks begin at 1. A query with fewer
    than k other rows gets them all. Rows with a null code or id are neither
    found nor asked for; of repeated ids in ``queries`` one is asked. All rows
    whose id equals the query's id are the query's own; repeated rows of another
    id are neighbours each. Columns other than id and code are not looked at.
    Either table may be empty: no rows then.
    """
    spark = rows.sparkSession
    reach_workers(spark)
    base = rows.select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).where("id is not null and code is not null")
    entries = checkpointed(base.groupBy("id", "code").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("times")))
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(code_col).alias("code")).where("query_id is not null and code is not null").dropDuplicates(["query_id"])
    own = entries.groupBy(F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("m"))
    # one of k for each code that holds the query's own id: at least k pairs of other ids are among so many
    asked = checkpointed(asked.join(own, "query_id", "left").select("query_id", "code", (k + F.coalesce("m", F.lit(1))).alias("need")))
    # k + 1 ids of each code: the query's own may be among them. A rank limit is applied before rows are dealt out.
    first = Window.partitionBy("code").orderBy("id")
    few = checkpointed(entries.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("code", "id", "times", "n"))
    codes = checkpointed(few.groupBy("code").agg(F.max("n").alias("size")))
    open_ = asked.select(F.col("code").alias("qcode"), "need").distinct()
    n_codes, n_open = codes.count(), open_.count()
    layout = _Layout(segments or _segments(n_codes), max(0, math.ceil(math.log2(max(1, n_codes / shard_codes)))))
    stored = _dealt(codes, layout)
    crowded = stored.groupBy("shard").count().where(F.col("count") > 4 * shard_codes).collect() if n_codes > shard_codes else []
    crowded = {shard: -(-n // (2 * shard_codes)) for shard, n in crowded}
    placed = _placed(stored, crowded)
    found = local_table(spark, [], _FOUND)
    parts = []
    r = 0
    while n_open:
        near = found.unionByName(_probed(placed, open_, layout, r, crowded)).distinct()
        # what may still be among the nearest: codes up to the distance by which enough rows are seen
        closer = Window.partitionBy("qcode", "need").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
        near = near.withColumn("__closer", F.coalesce(F.sum("size").over(closer), F.lit(0))).where(F.col("__closer") < F.col("need")).drop("__closer")
        covered = len(layout.cuts[1:]) * (r + 1) - 1
        sure = F.sum(F.when(F.col("distance") <= covered, F.col("size"))).over(Window.partitionBy("qcode", "need"))
        # a query for more rows than there are is done when all distances are covered
        near = written(near.withColumn("done", F.lit(covered >= BITS) | F.coalesce(sure >= F.col("need"), F.lit(False))), f"radius-{r}")
        parts.append(near.where("done").drop("done"))
        if covered >= BITS:
            break
        found = near.where("not done").drop("done")
        settled = parts[-1].select("qcode", "need").distinct()
        open_, (n_open,) = written_with(open_.join(settled, ["qcode", "need"], "left_anti"), "open", F.count(F.lit(1)))
        r += 1
    placed.unpersist()
    pairs = reduce(DataFrame.unionByName, parts, local_table(spark, [], _FOUND))
    by_code = Window.partitionBy("qcode", "need").orderBy("distance", "id")
    near = pairs.join(few, "code").withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= F.col("need")).select("qcode", "need", "id", "times", "distance")
    mine = Window.partitionBy("query_id").orderBy("distance", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        asked.withColumnRenamed("code", "qcode")
        .join(near, ["qcode", "need"])
        .where("id <> query_id")
        .withColumn("before", F.sum("times").over(mine) - F.col("times"))
        .where(F.col("before") < k)
        .select("query_id", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("times"), F.lit(k)))).alias("rank"), "id", "distance")
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("neighbor_id"), "distance")
    )
