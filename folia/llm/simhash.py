"""SimHash near-duplicates through vantage-point trees.

Fingerprints are computed once for each text and written to the shared folder.
Equal fingerprints collapse to one row before anything else happens, so a
group of copies, however large, is a single point of the metric space.

Two fingerprints with at most ``max_distance`` differing bits agree, up to
``max_distance // bands`` bits, on at least one of ``bands`` blocks of bits,
however the bits are parted (the differing bits cannot exceed that on every block). Each block is a
smaller Hamming space with a vantage-point tree of its own:

* the upper levels, built from a bounded sample, partition the points into
  shards by their distance from vantage points. A point is stored in one shard
  and asked about in every shard that the triangle bound can't exclude: at a
  node with vantage ``v`` and radius ``m``, a point at distance ``d`` visits the
  inner side if ``d - r <= m`` and the outer side if ``d + r > m``;
* a shard that got far more points than its share is parted anew, like the whole,
  by blocks of its own: bits that its points have in common say nothing, so
  those that vary are dealt evenly to the blocks; so on while that helps;
* each shard builds the lower levels over all that it holds, in memory, and
  answers its queries through the same bounds, many queries at a time; where
  all points have the same bits in a block, the other blocks part them; leaves
  verify the distance over the whole fingerprint.

The sample decides how even the shards are, never what is found. A shard
reports a spanning forest of the links that it finds, at most one edge for
each point that it saw, in place of the links themselves; components are then
found by alternating star contraction over tables.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import drop_written, local_table, release_others, unused, with_kernel, written, written_with
from folia.workers import reach_workers

#: Seed of the shingle hash.
SEED = 42

#: For a byte, one 8-bit counter for each of its bits, packed in a 64-bit number.
_COUNTERS = np.array([sum(1 << (8 * j) for j in range(8) if v >> j & 1) for v in range(256)], dtype=np.uint64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of a text: bit i is set if over half of its shingles' hashes have it set.

    Words are runs without ASCII white space, ``A-Z`` in lower case. A text of
    fewer than ``width`` words is one shingle; no words (or null) gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 255 * 64):  # a packed counter holds sums of up to 255
        packed = _COUNTERS[octets[at : at + 255 * 64]]
        sums = np.add.reduceat(packed, np.arange(0, len(packed), 255), axis=0)
        counts += sums.astype("<u8").view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, width: int = 4) -> DataFrame:
    """Adds ``fp`` (the 64 bits as a signed long) to each row."""

    def make():
        def kernel(texts):
            return [[v - (1 << 64) if (v := fingerprint(t, width)) >> 63 else v for t in texts]]

        return kernel

    return with_kernel(docs, make, [text_col], [T.StructField("fp", T.LongType())], keep)


def _blocks(bands: int, sample: np.ndarray) -> tuple[int, ...]:
    """Bit masks that part 64 bits into ``bands`` blocks; the bits that vary most in the sample are dealt evenly."""
    ones = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").mean(axis=0) if len(sample) else np.zeros(64)
    order = np.argsort(np.abs(ones - 0.5), kind="stable").tolist()
    return tuple(sum(1 << b for b in order[i::bands]) for i in range(bands))


def _halves(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point, the radius that parts the points most evenly, and the points' distances."""
    best = None
    for v in rng.choice(points, size=min(4, len(points)), replace=False):
        d = np.bitwise_count(points ^ v).astype(np.int64)
        inside = np.cumsum(np.bincount(d, minlength=65))
        m = int(np.argmin(np.abs(inside * 2 - len(points))))
        share = min(int(inside[m]), len(points) - int(inside[m]))
        if share and (best is None or share > best[0]):
            best = (share, v, m, d)
    return best and best[1:]


def _tree(sample: np.ndarray, depth: int, rng: np.random.Generator, leaves: list[int]) -> tuple | int:
    """Nested (vantage, radius, inner, outer); a leaf is the number of a shard."""
    parted = _halves(sample, rng) if depth and len(sample) > 1 else None
    if parted is None:
        leaves.append(len(leaves))
        return leaves[-1]
    v, m, d = parted
    return int(v), m, _tree(sample[d <= m], depth - 1, rng, leaves), _tree(sample[d > m], depth - 1, rng, leaves)


def _routes(tree, points: np.ndarray, at: np.ndarray, r: int, out: list[tuple[int, np.ndarray]]) -> None:
    """The shards that each point must visit to see all points within ``r``; r = 0 gives its home."""
    if not len(at):
        return
    if isinstance(tree, int):
        out.append((tree, at))
        return
    v, m, inner, outer = tree
    d = np.bitwise_count(points[at] ^ np.uint64(v)).astype(np.int64)
    _routes(inner, points, at[d - r <= m], r, out)
    _routes(outer, points, at[d + r > m], r, out)


class _Forest:
    """Union-find over positions of an array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if np.array_equal(nxt, self.up):
                return nxt
            self.up = nxt

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins all pairs (a[i], b[i]): the larger root goes under the smaller, until nothing changes."""
        while len(a):
            root = self.roots()
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.up, hi, lo)


def _search(members: np.ndarray, queries: np.ndarray, codes: np.ndarray, mask: int, rest: tuple[int, ...], r: int, limit: int, forest: _Forest, rng, leaf: int = 48, cells: int = 1 << 20) -> None:
    """Joins each query with the members within ``limit`` bits, by descending a tree over the members.

    ``members`` and ``queries`` are positions in ``codes``. Work is done for
    all queries of a node at a time; a leaf compares in blocks of ``cells``.
    Members that agree on the whole of ``mask`` are parted by the blocks of
    ``rest``.
    """
    stack = [(members, queries, mask, rest, r)]
    while stack:
        own, ask, mask, rest, r = stack.pop()
        if not len(own) or not len(ask):
            continue
        m64 = np.uint64(mask)
        parted = _halves(codes[own] & m64, rng) if len(own) > leaf and len(ask) > 8 else None
        if parted is not None:
            v, m, d = parted
            far = np.bitwise_count((codes[ask] & m64) ^ v).astype(np.int64)
            stack.append((own[d <= m], ask[far - r <= m], mask, rest, r))
            stack.append((own[d > m], ask[far + r > m], mask, rest, r))
            continue
        first = codes[own[0]] & m64
        if rest and len(own) > leaf and len(ask) > 8 and np.all(codes[own] & m64 == first):
            ask = ask[np.bitwise_count((codes[ask] & m64) ^ first) <= r]
            stack.extend((own, ask, block, tuple(b for b in rest if b != block), limit // len(rest)) for block in rest)
            continue
        step = max(1, cells // len(own))
        for at in range(0, len(ask), step):
            part = ask[at : at + step]
            near = np.bitwise_count(codes[part][:, None] ^ codes[own][None, :]) <= limit
            i, j = np.nonzero(near)
            forest.join(part[i], own[j])


class _Level:
    """A tree over one block of bits, whose leaves are the shards from ``first`` on."""

    def __init__(self, sample: np.ndarray, mask: int, rest: tuple[int, ...], limit: int, points: int, shard_points: int, first: int):
        self.mask, self.rest, self.first = mask, rest, first
        self.r = limit // (len(rest) + 1)
        leaves: list[int] = []
        depth = max(5, math.ceil(math.log2(max(2, points / shard_points))))
        self.tree = _tree(sample & np.uint64(mask), depth, np.random.default_rng(first), leaves)
        self.after = first + len(leaves)

    def visits(self, codes: np.ndarray, r: int) -> list[tuple[int, np.ndarray]]:
        """(shard, positions of the codes that visit it) for a radius; 0 gives each code's home."""
        out: list = []
        _routes(self.tree, codes & np.uint64(self.mask), np.arange(len(codes)), r, out)
        return [(self.first + shard, at) for shard, at in out]

    def homes(self, codes: np.ndarray) -> np.ndarray:
        home = np.empty(len(codes), dtype=np.int64)
        for shard, at in self.visits(codes, 0):
            home[at] = shard
        return home


def _levels(sample: np.ndarray, masks: tuple[int, ...], limit: int, points: int, shard_points: int, first: int) -> list[_Level]:
    """A tree for each block of ``masks``."""
    out: list[_Level] = []
    for mask in masks:
        out.append(_Level(sample, mask, tuple(b for b in masks if b != mask), limit, points, shard_points, out[-1].after if out else first))
    return out


def _routed(rows: DataFrame, plan, stored_only: bool = False) -> DataFrame:
    """Rows (shard, fp, stored) of shards in ``plan`` dealt to that plan's shards; other rows stay."""

    def route(batches):
        import pyarrow as pa

        release_others(__name__)
        for batch in batches:
            shards, fps, stored = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for shard in np.unique(shards).tolist():
                own = np.nonzero(shards == shard)[0]
                some, keeps = fps[own].astype(np.int64), stored[own].astype(bool)
                if shard not in plan.value:
                    yield batch.take(pa.array(own))
                    continue
                for level in plan.value[shard]:
                    home = level.homes(some.view(np.uint64))
                    parts = ((s, np.nonzero(home == s)[0]) for s in np.unique(home).tolist()) if stored_only else level.visits(some.view(np.uint64), level.r)
                    for target, at in parts:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), target, dtype=np.int32)), pa.array(some[at]), pa.array((home[at] == target) & keeps[at])], names=["shard", "fp", "stored"])

    return rows.mapInArrow(route, "shard int, fp long, stored boolean")


def _bound(share: float) -> int:
    """The hash up to which a share of fingerprints lies."""
    return min((1 << 63) - 1, int(-(1 << 63) + share * ((1 << 64) - 1)))


def _shards(points: DataFrame, total: int, max_distance: int, bands: int, sample_rows: int, shard_points: int) -> tuple[DataFrame, list[_Level]]:
    """Rows (shard, fp, stored), each point in the shards that it is stored in or asked about, and all trees' levels."""
    spark = points.sparkSession
    wanted = min(max(sample_rows, total // 64), 2_000_000)
    sample = points.where(F.xxhash64(F.col("fp"), F.lit(7)) <= _bound(wanted / total)).select("fp").toArrow()["fp"].to_numpy().view(np.uint64)
    plan, sizes = {-1: _levels(sample, _blocks(bands, sample), max_distance, total, shard_points, 0)}, {-1: total}
    levels = plan[-1]
    routed = held = points.select(F.lit(-1).alias("shard"), "fp", F.lit(True).alias("stored"))
    while plan:
        shared = spark.sparkContext.broadcast(plan)
        # what is looked at for crowds are homes, of shards that have just been parted
        routed, held = _routed(routed, shared), _routed(held.where(F.col("shard").isin(list(plan))), shared, stored_only=True)
        heavy = dict(held.groupBy("shard").count().where(F.col("count") > 16 * shard_points).collect())
        parent = {shard: next(p for p, own in plan.items() if own[0].first <= shard < own[-1].after) for shard in heavy}
        # one that its parent's trees hardly made smaller stays as it is
        heavy = {shard: n for shard, n in heavy.items() if parent[shard] == -1 or n < sizes[parent[shard]] * 0.9}
        plan, sizes = {}, sizes | heavy
        if not heavy:
            break
        each = max(64, min(sample_rows, 2_000_000 // len(heavy)))
        bounds = local_table(spark, [(shard, _bound(each / n)) for shard, n in heavy.items()], "shard int, bound long")
        drawn = held.join(F.broadcast(bounds), "shard").where(F.xxhash64(F.col("fp"), F.lit(7)) <= F.col("bound")).select("shard", "fp").toArrow()
        of, fps = drawn["shard"].to_numpy(), drawn["fp"].to_numpy().view(np.uint64)
        for shard, n in heavy.items():
            sample = fps[of == shard]
            plan[shard] = _levels(sample, _blocks(bands, sample), max_distance, n, shard_points, levels[-1].after)
            levels = [*levels, *plan[shard]]
    return routed, levels


def links(points: DataFrame, max_distance: int = 4, bands: int = 4, sample_rows: int = 20_000, shard_points: int = 4_096) -> DataFrame:
    """Edges (a, b), a > b, whose components are those of "at most ``max_distance`` bits apart".

    ``points``: distinct longs in column ``fp``. A spanning forest of every
    shard's links, not all links. An empty table gives no edges. The driver
    sees a sample of some ``sample_rows`` fingerprints, or a 64th of more, up to
    two million (16 MB), and the same of each round's crowded shards, with their numbers of points.
    """
    spark = points.sparkSession
    reach_workers(spark)
    total = points.count()
    if total < 2:
        return local_table(spark, [], "a long, b long")
    routed, levels = _shards(points, total, max_distance, bands, sample_rows, shard_points)
    searched = spark.sparkContext.broadcast([(x.first, x.mask, x.rest, x.r) for x in levels])

    def search(key, table):
        import pandas as pd

        release_others(__name__)
        shard = int(key[0])
        _, mask, rest, r = max(x for x in searched.value if x[0] <= shard)
        fps = table["fp"].to_numpy(dtype=np.int64)
        order = np.argsort(fps)
        fps, stored = fps[order], table["stored"].to_numpy(dtype=bool)[order]
        forest = _Forest(len(fps))
        _search(np.nonzero(stored)[0], np.arange(len(fps)), fps.view(np.uint64), mask, rest, r, max_distance, forest, np.random.default_rng(shard))
        root = forest.roots()
        moved = np.nonzero(root != np.arange(len(fps)))[0]
        return pd.DataFrame({"a": fps[moved], "b": fps[root[moved]]})

    return routed.groupBy("shard").applyInPandas(search, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for each node but the smallest of its component, that smallest one, by alternating large and small stars.

    Every step takes minima by key with map-side combining and joins on the
    key; no neighbourhood is gathered in one place. Rounds are written to the
    shared folder, each in place of the last; their number grows with the
    logarithm of a component's size, and more than ``max_rounds`` raise an
    error. An empty table gives none.
    """
    n, sign = F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    now, seen = written_with(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", n, sign)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        before, last = now, seen
        now, seen = written_with(small, "edges", n, sign)
        drop_written(before)
        if seen == last:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Of a table that is broadcast, rows at most; of a fingerprint that is dealt by itself, rows at least.
_BROADCAST_ROWS, _HOT_ROWS, _SALTS = 500_000, 20_000, 8


def _placed(prints: DataFrame, id_col: str, max_distance: int, bands: int) -> DataFrame:
    """Of rows with ``fp`` and ``h``: (cfp, rows, component_id, component_size, keeper), one row for each fingerprint; the keeper has ``id`` and ``h``."""
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("h").alias("h"))
    classes = written(prints.groupBy("fp").agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("rows"), F.min(first).alias("first")), "classes")
    roots = written(components(links(classes.select("fp"), max_distance, bands)), "roots")
    members = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "low", "rows", "first", "root")
    # a component's own smallest fingerprint isn't among its members
    whole, (n,) = written_with(
        members.select("root", "low", F.col("rows").alias("size"), "first").unionByName(classes.join(roots.select("root").distinct(), classes["fp"] == F.col("root")).select("root", "low", F.col("rows").alias("size"), "first"))
        .groupBy("root").agg(F.min("low").alias("low"), F.sum("size").alias("size"), F.min("first").alias("first")), "components", F.count(F.lit(1)),
    )
    named = whole.select(F.col("root").alias("__root"), F.col("low").alias("component_id"), F.col("size").alias("component_size"), F.col("first").alias("keeper"))
    if n <= _BROADCAST_ROWS:
        joined = members.join(F.broadcast(named), F.col("root") == F.col("__root"))
    else:  # a component of very many fingerprints is dealt to several tasks
        salted = named.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(_SALTS)).cast("int")).join(salted, (F.col("root") == F.col("__root")) & (F.col("salt") == F.col("__salt")))
    others = classes.join(roots, classes["fp"] == roots["node"], "left_anti").join(named, classes["fp"] == F.col("__root"), "left")
    columns = ["component_id", "component_size", "keeper"]
    alone = others.select(F.col("fp").alias("cfp"), "rows", *[F.when(F.col("__root").isNull(), F.col(o)).otherwise(F.col(c)).alias(c) for c, o in zip(columns, ("low", "rows", "first"), strict=True)])
    return joined.select(F.col("fp").alias("cfp"), "rows", *columns).unionByName(alone)


def _with_component(prints: DataFrame, id_col: str, max_distance: int, bands: int) -> DataFrame:
    """``prints`` with the columns of :func:`_placed`; fingerprints of very many rows are looked up where those rows are."""
    named, (hot,) = written_with(_placed(prints, id_col, max_distance, bands), "placed", F.count_if(F.col("rows") >= _HOT_ROWS))
    if not hot:
        return prints.join(named, prints["fp"] == named["cfp"])
    often = F.broadcast(named.where(F.col("rows") >= _HOT_ROWS))
    rare = prints.join(often, prints["fp"] == F.col("cfp"), "left_anti").join(named.where(F.col("rows") < _HOT_ROWS), F.col("fp") == F.col("cfp"))
    return prints.join(often, prints["fp"] == F.col("cfp")).unionByName(rare)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4, width: int = 4, bands: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Each row with its fingerprint and component.

    Adds ``fp`` (long), ``fingerprint`` (16 hex digits), ``component_id`` (the
    smallest id reachable over links, its own included) and ``component_size``
    (rows) to the columns of ``keep`` (default: the id); kept columns of these
    names give way. Null and empty texts have fingerprint zero and link as any
    other. Rows with a null id take part; a component of null ids only has a
    null id. Repeated rows stay, with equal results. An empty table gives no
    rows.
    """
    if bands < 1 or max_distance < 0:
        raise ValueError("bands must be positive and max_distance not negative")
    new = ("fp", "fingerprint", "component_id", "component_size")
    out = [c for c in ([id_col] if keep is None else keep) if c not in new]
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.lit(0).cast("long").alias("h"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(out)])
    kept = [f"__k{i}" for i in range(len(out))]
    prints = written(fingerprints(source, "__text", ["__id", "h", *kept], width), "fingerprints")
    found = _with_component(prints, "__id", max_distance, bands)
    return found.select(*[F.col(k).alias(c) for k, c in zip(kept, out, strict=True)], "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4, width: int = 4, bands: int = 4) -> DataFrame:
    """One row of each component, columns as they are: the one with the smallest id.

    Null ids come after all others; of different texts of one id the one with
    the smallest hash stays, and of rows with equal id and text one. Null and
    empty texts are one component. Texts aren't written or dealt out: rows that
    go are told by id and a hash of the text.
    """
    h = lambda c: F.xxhash64(F.col(c))
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), h(text_col).alias("h"))
    prints = written(fingerprints(source, "__text", ["__id", "h"], width), "fingerprints")
    found = _with_component(prints, "__id", max_distance, bands)
    kept = (F.col("keeper.id").eqNullSafe(F.col("__id"))) & (F.col("keeper.h") == F.col("h"))
    id_name, h_name, row = unused("__id", docs), unused("__h", docs), unused("__r", docs)
    named = lambda rows: rows.select(F.col("__id").alias(id_name), F.col("h").alias(h_name))
    gone, (n_gone,) = written_with(named(found.where(~kept)).distinct(), "gone", F.count(F.lit(1)))
    again, (n_again,) = written_with(named(found.where(kept).groupBy("__id", "h").count().where("count > 1")), "repeated", F.count(F.lit(1)))
    same = docs[id_col].eqNullSafe(F.col(id_name)) & (h(text_col) == F.col(h_name))
    small = lambda table, n: F.broadcast(table) if n <= _BROADCAST_ROWS else table
    out = docs.join(small(gone, n_gone), same, "left_anti")
    if not n_again:
        return out
    same = out[id_col].eqNullSafe(F.col(id_name)) & (h(text_col) == F.col(h_name))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    # of rows that repeat, one: combined in each task before they are dealt out
    one = out.join(small(again, n_again), same, "left_semi").groupBy(F.col(id_col).alias(id_name), h(text_col).alias(h_name)).agg(F.min_by(whole, F.xxhash64(*plain)).alias(row))
    return out.join(small(again, n_again), same, "left_anti").unionByName(one.select(f"{row}.*"))
